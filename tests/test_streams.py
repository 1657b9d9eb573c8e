"""Keyed state of streamed changes, and a source tree as a stream of changes."""

import os

import pytest

from wattscan.sources.tree import Looks
from wattscan.streaming.rescan import CHANGES, current, progress, stream_findings, stream_scan, tree_changes

STAR, SQL = "from a import *\n", "q = 'SELECT * FROM t'\n"


class Log:
    """A folder of changes, scanned as far as it has come each time."""

    def __init__(self, spark, folder):
        self.spark, self.dir, self.n = spark, str(folder), 0

    def add(self, *rows):
        self.n += 1
        self.spark.createDataFrame([(*r, False)[:4] if len(r) < 4 else r for r in rows], CHANGES).coalesce(1).write.mode("append").parquet(f"{self.dir}/in")
        stream_scan(self.spark, f"{self.dir}/in", f"{self.dir}/out", f"{self.dir}/state").awaitTermination()

    def now(self):
        return sorted((r.file, r.rule, r.line) for r in current(self.spark, f"{self.dir}/out").collect())

    def added(self):
        return [(r.files, r.findings, r.replaced) for r in progress(self.spark, f"{self.dir}/out").collect()]


def test_versions_redelivery_and_deletion(spark, tmp_path):
    log = Log(spark, tmp_path)
    log.add(("a.py", 1, STAR), ("b.py", 1, SQL), ("c.py", 3, STAR), ("d.py", 1, "x = 1\n"))
    first = [("a.py", "GL028", 1), ("b.py", "GL005", 1), ("c.py", "GL028", 1)]
    assert log.now() == first
    # Delivered again, older, or the same text under a later version: nothing is added, nothing changes.
    log.add(("a.py", 1, STAR), ("b.py", 1, SQL), ("c.py", 2, SQL), ("c.py", 2, None, True), ("d.py", 5, "x = 1\n"))
    assert log.now() == first and log.added() == [(4, 3, 0)]
    # Two versions in one batch, an edit without findings, a deletion, a new file.
    log.add(("a.py", 2, SQL), ("a.py", 3, STAR + SQL), ("b.py", 2, "y = 1\n"), ("c.py", 4, None, True), ("e.yml", 1, "cron: '* * * * *'\n"))
    assert log.now() == [("a.py", "GL005", 2), ("a.py", "GL028", 1), ("e.yml", "GL003", 1)]
    assert log.added()[-1] == (4, 3, 3)
    # A deletion in a later batch wins over the same version; a late older version doesn't bring the file back.
    log.add(("a.py", 3, None, True), ("c.py", 3, STAR), ("e.yml", 1, "cron: '* * * * *'\n"))
    assert log.now() == [("e.yml", "GL003", 1)] and log.added()[-1] == (1, 0, 1)
    # Deleted, and back under a later version with the text it had.
    log.add(("c.py", 5, STAR), (None, 1, STAR), ("f.py", None, STAR), ("g.py", 1, None))
    assert log.now() == [("c.py", "GL028", 1), ("e.yml", "GL003", 1)] and log.added()[-1] == (2, 1, 0)


def test_streamed_findings_equal_one_scan(spark, tmp_path):
    from wattscan.operators.scan import scan

    log = Log(spark, tmp_path)
    files = {f"f{i}.py": (STAR * (i % 3) + SQL * (i % 2)) for i in range(40)}
    for version in (1, 2, 3):
        log.add(*[(p, version, t + f"# {version * (i % version)}\n") for i, (p, t) in enumerate(files.items())])
    last = [(p, t + f"# {3 * (i % 3)}\n") for i, (p, t) in enumerate(files.items())]
    want = scan(spark.createDataFrame(last, "path string, text string")).collect()
    assert log.now() == sorted((r.file, r.rule, r.line) for r in want)


def test_tree_as_a_stream(spark, tmp_path):
    """Edits, new and deleted files arrive; so they do after a restart, which each run is."""
    root, state, out, checkpoint = (str(tmp_path / x) for x in ("tree", "looks", "out", "checkpoint"))

    def put(name, text):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(text)

    def run():
        changes = tree_changes(spark, [root], state, ignore=["*/skip/*"], kinds=[".py", "Dockerfile"])
        stream_findings(changes, out, checkpoint).awaitTermination()
        return sorted((os.path.relpath(r.file, root), r.rule, r.line) for r in current(spark, out).collect())

    put("a.py", STAR)
    put("sub/b.py", SQL)
    put("skip/c.py", STAR)
    put("node_modules/d.py", STAR)
    put("e.yml", "cron: '* * * * *'\n")
    assert run() == [("a.py", "GL028", 1), ("sub/b.py", "GL005", 1)]
    assert run() == [("a.py", "GL028", 1), ("sub/b.py", "GL005", 1)]
    put("a.py", "\n" + STAR)
    put("img/Dockerfile", "FROM ubuntu\n")
    os.remove(f"{root}/sub/b.py")
    assert run() == [("a.py", "GL028", 2), ("img/Dockerfile", "GL006", 1)]
    # A touched file has a new time and its old text: seen, not scanned.
    os.utime(f"{root}/a.py", ns=(1, 1))
    before = progress(spark, out).collect()
    assert run() == [("a.py", "GL028", 2), ("img/Dockerfile", "GL006", 1)]
    assert [(r.files, r.findings) for r in progress(spark, out).collect()] == [(r.files, r.findings) for r in before]
    os.remove(f"{root}/a.py")
    assert run() == [("img/Dockerfile", "GL006", 1)]
    put("sub/b.py", SQL)
    assert run() == [("img/Dockerfile", "GL006", 1), ("sub/b.py", "GL005", 1)]


def test_looks_are_folded(tmp_path):
    looks = Looks(str(tmp_path))
    assert looks.look({}) == 0 and looks.look({"a": (1, 1), "b": (1, 2)}) == 1 and looks.look({"a": (1, 1), "b": (1, 2)}) == 1
    assert looks.look({"a": (2, 1), "c": (1, 1)}) == 2
    assert looks.changed(2) == [["a", 2, 1], ["c", 1, 1], ["b", 0, None]]
    assert looks.known(1) == {"a": (1, 1), "b": (1, 2)} and looks.known(2) == {"a": (2, 1), "c": (1, 1)}
    looks.forget(1)
    assert looks.known(2) == {"a": (2, 1), "c": (1, 1)} and looks.last() == 2
    looks.forget(2)
    assert sorted(os.listdir(tmp_path)) == ["whole-2.json.gz"] and looks.known(2) == {"a": (2, 1), "c": (1, 1)}
    looks.forget(2)
    assert looks.look({"a": (2, 1), "c": (1, 1)}) == 2 and looks.look({}) == 3
    with pytest.raises(FileNotFoundError):
        looks.changed(1)

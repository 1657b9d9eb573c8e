"""A session over a project: each call, and what it opens."""

import os

import pytest

from wattscan.operators import incremental
from wattscan.operators.rules import Rule
from wattscan.operators.scan import register_findings, scan
from wattscan.session import Session

STAR = "from a import *\n"


def rows(df):
    return sorted((r.file.rpartition("/")[2], r.rule, r.line) for r in df.collect())


def test_session(spark, tmp_path, monkeypatch):
    root = tmp_path / "p"
    for name, text in {"a.py": STAR, "sub/b.sql": "select * from t\n", "sub/c.png": "x", "big.py": STAR + "#" * 3000, "node_modules/d.py": STAR}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    session = Session(spark, str(root), str(tmp_path / "store"), str(tmp_path / "none.toml"), max_bytes=2000, buckets=2)
    assert ".py" in session.languages()
    first = session.scan_project()
    assert rows(first.findings) == [("a.py", "GL028", 1), ("b.sql", "GL005", 1)]
    assert first.counts == {"files": 4, "scanned": 2, "reused": 0, "skipped": 2} and first.cost.endswith("(2 scanned, 0 reused from cache, 2 skipped)")
    assert session.scan_project().counts == {"files": 4, "scanned": 0, "reused": 2, "skipped": 2}
    # Texts that aren't on disk, files one by one.
    assert rows(session.scan_text(str(root / "a.py"), "\n" + STAR)) == [("a.py", "GL028", 2)]
    assert session.scan_file(str(root / "a.py"))[1] == "stat" and session.scan_file(str(root / "big.py"))[1] == "skip" == session.scan_file(str(root / "sub/c.png"))[1]
    os.utime(root / "a.py", ns=(5, 5))
    found, how = session.scan_file(str(root / "a.py"))
    assert how == "hash" and rows(found) == [("a.py", "GL028", 1)]
    (root / "a.py").write_text("\n\n" + STAR)
    found, how = session.scan_file(str(root / "a.py"))
    assert how == "scan" and rows(found) == [("a.py", "GL028", 3)]
    session.invalidate([str(root / "a.py")])
    assert session.scan_project().counts["scanned"] == 1
    # A baseline hides what is there; other globs make everything stale, and take files away.
    path, n = session.write_baseline()
    assert n == 2 and rows(session.scan_project().findings) == [] == rows(session.scan_text(str(root / "a.py"), STAR))
    os.remove(path)
    assert session.configure(["*/sub/*"]) == ["*/sub/*"]
    again = session.scan_project()
    assert again.counts == {"files": 2, "scanned": 1, "reused": 0, "skipped": 1} and rows(again.findings) == [("a.py", "GL028", 3)]
    session.cancel()  # nothing runs
    session.close()


def test_findings_in_sql(spark):
    files = spark.createDataFrame([("src/a.py", STAR + "q = 'SELECT * FROM t'\n"), ("db/b.sql", "select * from u\n")], "path string, text string")
    register_findings(spark, files, "found_here")
    sql = lambda q: rows(spark.sql(q))
    assert sql("SELECT * FROM found_here()") == rows(scan(files)) and len(rows(scan(files))) == 3
    assert sql("SELECT * FROM found_here('src/%')") == [("a.py", "GL005", 2), ("a.py", "GL028", 1)] and sql("SELECT * FROM found_here('%', 'low')") == [("a.py", "GL028", 1)]
    assert spark.sql("SELECT * FROM found_here()").columns == scan(files).columns
    assert sql("SELECT f.* FROM (VALUES ('GL005')) v(r) JOIN found_here() f ON f.rule = v.r") == [("a.py", "GL005", 2), ("b.sql", "GL005", 1)]


def test_own_rules_of_one_scan(spark):
    files = spark.createDataFrame([("a.txt", "TODO\n"), ("a.py", STAR)], "path string, text string")
    rule = Rule("OWN09", "low", (".txt",), "regex", "m", "s", "", "TODO")
    assert rows(scan(files, own=(rule,))) == [("a.py", "GL028", 1), ("a.txt", "OWN09", 1)] and rows(scan(files)) == [("a.py", "GL028", 1)]
    with pytest.raises(ValueError, match="already"):
        scan(files, own=(rule, rule))
    assert incremental.config_fingerprint([], ["a"]) != incremental.config_fingerprint([], ["b"])

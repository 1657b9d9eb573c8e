"""Normal forms of paths, globs as one pattern, and filters that reach the source."""

import fnmatch
import itertools
import json
import os
import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, LessThan, Not, StringEndsWith, StringStartsWith

from wattscan import project
from wattscan.functions.paths import below, normal, normal_path, resolved, resolved_path
from wattscan.operators import baseline, globs
from wattscan.operators.scan import scan
from wattscan.sources import tree as source

PARTS = ["", ".", "..", "a", "b.py", "...", ".x", "d e", "ü"]
PATHS = ["/".join(p) for n in (1, 2, 3, 4) for p in itertools.product(PARTS, repeat=n)]


def test_paths_as_columns_equal_the_standard_library(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", normal(F.col("p")).alias("n"), resolved(F.col("p"), "/w/x").alias("r")).collect()
    for r in rows:
        # The standard library keeps exactly two leading slashes apart, which no store of files here does.
        assert r.n == normal_path(r.p) == str(PurePosixPath("/" + r.p.lstrip("/") if r.p.startswith("/") else r.p)), r.p
        want = os.path.normpath(os.path.join("/w/x", r.p))
        assert r.r == resolved_path(r.p, "/w/x") == "/" + want.lstrip("/"), r.p


def test_stores_keep_their_scheme(spark):
    paths = ["s3a://bucket//a/./b.py", "hdfs://h:1/a/../b.py", "s3a://bucket/a.py"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(normal(F.col("p")).alias("n"), resolved(F.col("p"), "/w").alias("r"), below(F.col("p"), "s3a://bucket").alias("b")).collect()
    assert [tuple(r) for r in got] == [("s3a://bucket/a/b.py", "s3a://bucket/a/b.py", "a/b.py"), ("hdfs://h:1/a/../b.py", "hdfs://h:1/b.py", "hdfs://h:1/a/../b.py"), ("s3a://bucket/a.py", "s3a://bucket/a.py", "a.py")]


def test_one_fingerprint_for_every_spelling(spark):
    spelled = ["src/b.py", "./src/b.py", "/p/src/b.py", "src/./b.py", "x/../src//b.py", "/p/q/../src/b.py"]
    found = scan(spark.createDataFrame([(p, "from a import *\n") for p in spelled], "path string, text string"))
    for root in ("", ".", "/p", "/p/", "q/.."):
        assert baseline.fingerprinted(found, root, "/p").select("fingerprint").distinct().count() == 1
    # Outside the root a path counts as given.
    assert baseline.fingerprinted(found, "/other", "/p").select("fingerprint").distinct().count() == 4


def plain_ignored(path, patterns):
    return any(fnmatch.fnmatchcase(p, g) for g in patterns for p in (path, "/" + path))


GLOBS = ["src/*", "src/a/*", "src/a/b.py", "*.py", "/src/*", "*/vendor/*", "vendor", "?rc/*", "[!s]*/x", "a[/]b", "[a/]b", "**/x/**", "*", "**", "?", "/", "", "docs/**/*.md", "a.b/*", "a+b/[", "src/*/c?", "x[]a]y", "[^a]b", "d*/e*/f", "//*", "*/*", "s*/b"]


def test_globs_as_one_pattern(spark):
    r = random.Random(9)
    paths = sorted({"/".join(r.choice(["src", "a", "b.py", "vendor", "x", "b", "docs", "m.md", "a.b", "a+b", "[", "c1", "x]y", "d1", "e", "f", "xay", "\n"]) for _ in range(r.randrange(1, 5))) for _ in range(600)} | {"/src/a", "/b", "b", ""})
    rows = spark.createDataFrame([(p,) for p in paths], "p string").cache()
    for n in range(60):
        some = r.sample(GLOBS, r.randrange(1, 9)) if n > len(GLOBS) else [GLOBS[n % len(GLOBS)]]
        want = {p for p in paths if plain_ignored(p, some)}
        assert {p for p in paths if globs.ignored_path(p, some)} == want, some
        if n % 6 == 0:
            # Columns judge the normal form.
            assert {x.p for x in rows.where(globs.ignored(F.col("p"), some)).collect()} == {p for p in paths if plain_ignored(normal_path(p), some)}, some
    assert not globs.ignored_path("a", [])


def test_leading_folders_are_looked_at_once():
    many = tuple(f"src/gen/m{i}/*" for i in range(300))
    assert globs.compiled(many).count("src/") == 1 and globs.ignored_path("src/gen/m299/x.py", many) and not globs.ignored_path("src/gen/m300/x.py", many)


def made(tmp_path, *names):
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("from a import *\n")


def test_wildcard_bases_prune_folders(tmp_path, monkeypatch):
    made(tmp_path, "a/vendor/x.py", "a/b/vendor/c/y.py", "vendor/z.py", "a/keep.py", "gen1/g.py", "gen2/deep/h.py", "other/gen3/i.py")
    monkeypatch.chdir(tmp_path)
    looked = []
    plain = source.listed
    monkeypatch.setattr(source, "listed", lambda p, *more: looked.append(p) or plain(p, *more))
    assert sorted(source.walk(".", ["*/vendor/*", "gen?/**"])) == ["a/keep.py", "other/gen3/i.py"]
    assert sorted(looked) == [".", "a", "a/b", "other", "other/gen3"]
    assert globs.prunable(["a/*", "b/**", "*/v/*", "*.py", "x", "/*", "*"]) == ["a", "b", "*/v"]


def test_scan_of_the_current_folder(spark, tmp_path, monkeypatch, capsys):
    """Paths below ``.`` are bare, globs fit them, and the baseline knows them from an absolute scan."""
    made(tmp_path, "src/b.py", "vendor/a.py", "x.py")
    monkeypatch.chdir(tmp_path)
    project.main(["--format", "json", "--exclude", "vendor/*"], spark)
    assert sorted(x["file"] for x in json.loads(capsys.readouterr().out)) == ["src/b.py", "x.py"]
    assert project.main([".", "--write-baseline"], spark) == 0 and "3 finding(s) accepted" in capsys.readouterr().out
    for paths in (["."], [str(tmp_path)], ["./src", "vendor/../vendor", "x.py"]):
        assert project.main([*paths, "--fail-on-findings"], spark) == 0
        assert "0 finding(s) (3 accepted" in capsys.readouterr().out


def test_filters_are_decided_before_files_are_opened(tmp_path, monkeypatch):
    made(tmp_path, "a.py", "b.png", "c.sql", "Dockerfile", "sub/d.py", ".py", "e.")
    (tmp_path / "big.py").write_text("x" * 5000)
    looked = []
    monkeypatch.setattr(source, "opened", lambda p: looked.append(os.path.relpath(p, tmp_path)) or "")
    text = StringStartsWith(("text",), "x")
    reader = source.FilteringTreeReader({"path": str(tmp_path)})
    mine = [In(("kind",), (".py", "Dockerfile")), LessThan(("size",), 1000), Not(StringEndsWith(("path",), "/d.py")), IsNotNull(("path",))]
    assert list(reader.pushFilters([*mine, text, EqualTo(("name",), None), Not(Not(mine[0]))])) == [text, EqualTo(("name",), None), Not(Not(mine[0]))]
    rows = list(reader.read(source.Chunk([], [str(tmp_path)])))
    assert sorted(looked) == ["Dockerfile", "a.py"] and sorted(r[4:] for r in rows) == [("Dockerfile", "Dockerfile"), ("a.py", ".py")]


def test_filters_reach_the_source(spark, tmp_path):
    made(tmp_path, "a.py", "b.png", "sub/c.yml")
    os.chmod(tmp_path / "b.png", 0)
    rows = project.tree(spark, [str(tmp_path)], [])
    assert sorted(r.name for r in rows.collect()) == ["a.py", "c.yml"]
    assert sorted(r.name for r in rows.where("size < 100 AND text LIKE '%import%' AND name <> 'a.py'").collect()) == ["c.yml"]
    plan = rows.where("size < 100")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0], plan
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    plain = spark.read.format("source_tree").load(str(tmp_path)).where("kind = '.py'")  # works without the setting, Spark filters
    assert [r.name for r in plain.collect()] == ["a.py"]


@pytest.mark.parametrize("name, kind", [("a/b.py", ".py"), ("Dockerfile", "Dockerfile"), ("x/Dockerfile", "Dockerfile"), (".py", ""), ("a.", ""), ("a", ""), ("a.b.c", ".c"), ("a.dockerfile", ".dockerfile")])
def test_kinds(name, kind):
    assert source.kind_of(name) == kind

"""One scan from end to end, its reports, own rules, configuration and the tree source."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from wattscan import project
from wattscan.functions.literals import required
from wattscan.functions.shared import numbered
from wattscan.functions.text import blank_comments, match_lines, with_parts
from wattscan.operators import baseline, globs, incremental, pyfacts, summary
from wattscan.operators.rules import BY_ID, Rule, drop_rule, register_rule
from wattscan.operators.scan import applicable, ordered, scan
from wattscan.sources.report import read_report, write_findings
from wattscan.sources.config import Config, load_config
from wattscan.sources.tree import TreeReader, TreeSource

FILES = [("src/a.py", "from os import *\nq = 'SELECT * FROM t'\n"), ("src/b.yml", "cron: '* * * * *'\n"), ("web/c.html", '<img src="<x>&.png">\n')]


def rows(spark, files=FILES):
    return spark.createDataFrame(files, "path string, text string")


def tree(tmp_path, files=FILES):
    for path, text in files:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


def run(spark, capsys, *argv):
    code = project.main(list(argv), spark)
    return code, capsys.readouterr().out.splitlines()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    root = tree(tmp_path)
    monkeypatch.chdir(tmp_path)
    code, out = run(spark, capsys, root)
    assert code == 0 and out[-1] == "wattscan: 4 finding(s)" and out[-2] == ""
    assert [x.rsplit(": [", 1)[1].split("/")[0] for x in out if ": [" in x] == ["GL003", "GL005", "GL028", "GL011"]
    assert sum(x.startswith("    \u21b3 ") for x in out) == sum(x.startswith("    ~ ") for x in out) == 4
    assert run(spark, capsys, root, "--fail-on-findings")[0] == 1
    code, out = run(spark, capsys, root, "--format", "json", "--exclude", "*.yml", "--exclude", "*/web/*")
    assert [(x["rule"], x["line"]) for x in json.loads("\n".join(out))] == [("GL005", 2), ("GL028", 1)]
    assert json.loads("\n".join(run(spark, capsys, root, "--format", "json", "--exclude", "*")[1])) == []
    assert run(spark, capsys, root, "--format", "github")[1][0].startswith("::error file=")
    assert len(run(spark, capsys, "--list-rules")[1]) == 38


def test_command_line_with_configuration_and_baseline(spark, tmp_path, capsys, monkeypatch):
    root = tree(tmp_path)
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".wattscan.toml").write_text('disable = ["GL028"]\nignore = ["*.yml"]\n')
    assert run(spark, capsys, root)[1][-1] == "wattscan: 2 finding(s)"
    kept = str(tmp_path / "kept.json")
    assert run(spark, capsys, root, "--write-baseline", kept)[1] == [f"wattscan: 2 finding(s) accepted in {kept}"]
    assert json.loads(open(kept).read())["version"] == 1
    code, out = run(spark, capsys, root, "--baseline", kept, "--fail-on-findings")
    assert code == 0 and out == ["", f"wattscan: 0 finding(s) (2 accepted by {kept})"]
    (tmp_path / "src/new.sql").write_text("select * from u\n")
    code, out = run(spark, capsys, root, "--baseline", kept, "--fail-on-findings")
    assert code == 1 and "new.sql:1: [GL005/medium]" in out[0]
    with pytest.raises(SystemExit, match="no such baseline"):
        project.main([root, "--baseline", "missing.json"], spark)


def test_command_line_with_a_store(spark, tmp_path, capsys, monkeypatch):
    """The second scan opens what changed, and says so."""
    root, store = tree(tmp_path / "p"), str(tmp_path / "store")
    monkeypatch.chdir(tmp_path / "p")
    code, out = run(spark, capsys, root, "--store", store, "--exclude", "*/web/*")
    assert out[-2] == "wattscan: 3 finding(s)" and "2 files in" in out[-1] and out[-1].endswith("(2 scanned, 0 reused from cache, 0 skipped)")
    (tmp_path / "p/src/b.yml").write_text("# cron\n")
    code, out = run(spark, capsys, root, "--store", store, "--exclude", "*/web/*", "--fail-on-findings")
    assert code == 1 and out[-2] == "wattscan: 2 finding(s)" and out[-1].endswith("(1 scanned, 1 reused from cache, 0 skipped)")
    with pytest.raises(SystemExit, match="one path"):
        project.main([root, root, "--store", store], spark)


def test_configuration(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert load_config() == Config() == load_config("missing.toml")
    path = tmp_path / "c.toml"
    path.write_text('disable = ["GL001", 7]\nignore = [\n  "a/*",\n]\n')
    assert load_config(str(path)) == Config(("GL001", "7"), ["a/*"])
    for bad in ('disable = "GL001"', "disable = ["):
        path.write_text(bad)
        with pytest.raises(SystemExit):
            load_config(str(path))
    assert globs.union(["a", "b"], ["b", "c"], []) == ["a", "b", "c"]
    assert globs.editor_excludes({"x": False, "**/y": True}, {"x": True, "z": "maybe"}, "/r") == ["/r/x", "/r/x/*", "/r/*/y", "/r/*/y/*"]


def test_baselines_are_read_by_spark(spark, tmp_path):
    found = scan(rows(spark))
    baseline.write_prints(found, str(tmp_path / "many"))
    assert baseline.write_baseline(found, str(tmp_path / "one.json")) == 4
    many, one = (sorted(r[0] for r in baseline.read_baseline(spark, str(tmp_path / x)).collect()) for x in ("many", "one.json"))
    assert many == one and len(one) == 4
    for text in ("[1]", "{", "", '{"fingerprints": null}'):
        (tmp_path / "bad.json").write_text(text)
        assert baseline.read_baseline(spark, str(tmp_path / "bad.json")).count() == 0
    assert baseline.read_baseline(spark, str(tmp_path / "none.json")).count() == 0


def test_reports(spark, tmp_path):
    found = scan(rows(spark))
    page = [r.text for r in summary.in_order(summary.html_report(found, "A & B", "src", summary.scan_cost(3, 10, 2, 1, 0))).collect()]
    assert page[1] == "<title>A &amp; B</title>" and "4 finding(s) \u00b7 3 files in 10 ms (2 scanned, 1 reused from cache, 0 skipped)" in page[2]
    assert [x for x in page if x.startswith("<h2>")] == ["<h2>b.yml <small>1</small></h2>", "<h2>a.py <small>2</small></h2>", "<h2>web/c.html <small>1</small></h2>"]
    assert any('<a href="#gl003--cron-job-scheduled-every-minute">GL003</a>' in x for x in page) and "</table>" in page
    empty = [r.text for r in summary.in_order(summary.html_report(found.limit(0))).collect()]
    assert "<h2>Nothing found</h2>" in empty
    summary.write_report(summary.text_report(found), str(tmp_path / "report"))
    parts = sorted(x for x in os.listdir(tmp_path / "report") if x.startswith("part-"))
    lines = "".join((tmp_path / "report" / x).read_text() for x in parts).splitlines()
    assert lines[0].startswith("src/b.yml:1: [GL003/high]") and lines[-1] == "wattscan: 4 finding(s)"


def test_equal_findings_and_repeated_roots(spark):
    """A root given twice gives every finding twice: the report stays valid, and a file has one heading."""
    found = scan(rows(spark, FILES + FILES))
    whole = json.loads("\n".join(r.text for r in summary.in_order(summary.json_report(found)).collect()))
    assert len(whole) == 8 and [x["rule"] for x in whole] == [x for r in ("GL003", "GL005", "GL028", "GL011") for x in (r, r)]
    page = [r.text for r in summary.in_order(summary.html_report(found, root="src")).collect()]
    assert [x for x in page if x.startswith("<h2>")] == ["<h2>b.yml <small>2</small></h2>", "<h2>a.py <small>4</small></h2>", "<h2>web/c.html <small>2</small></h2>"]
    assert json.loads("\n".join(r.text for r in summary.in_order(summary.json_report(found.limit(0))).collect())) == []


@pytest.mark.parametrize("times", [0, 1, 300])
def test_report_sink(spark, tmp_path, times):
    """Every task writes its part; the parts in the order of their names are one document."""
    files = [(f"{p}{i}{s}", t) for i in range(times) for p, s, t in (("src/a", ".py", FILES[0][1]), ("src/b", ".yml", FILES[1][1]), ("web/c", ".html", FILES[2][1]))]
    found = scan(spark.createDataFrame(files, "path string, text string").repartition(7))
    want = [(r.rule, r.file, r.line) for r in ordered(found).collect()]
    folder = str(tmp_path / "report")
    for _ in range(2):  # a second report takes the first one's place
        write_findings(found, folder, "json")
    assert [(x["rule"], x["file"], x["line"]) for x in json.loads("".join(read_report(folder)))] == want
    assert all(x.startswith("report-") for x in os.listdir(folder))
    write_findings(found, folder, "github")
    lines = "".join(read_report(folder)).splitlines()
    assert len(lines) == len(want) and all(" \u2014 " in x and x.startswith("::") for x in lines)
    write_findings(found, folder, "text")
    text = "".join(read_report(folder))
    assert text.endswith(f"\nwattscan: {len(want)} finding(s)\n") and text.count("\u21b3") == len(want)


def test_numbers_in_order(spark):
    table = spark.range(5000).selectExpr("id % 7 AS a", "id % 3 AS b").repartition(5)
    got = sorted((r.n, r.a, r.b) for r in numbered(table, "a", "b").collect())
    assert [n for n, *_ in got] == list(range(5000)) and [x[1:] for x in got] == sorted(x[1:] for x in got)
    assert numbered(table.limit(0), "a").count() == 0


def test_required_literals():
    assert required(r"a\s+bcd|xyz+") == ("bcd", "xy") and required(r"(?:ab)?c[de]") == ("c",) and required(r"\w+") == () == required("(") == required("a|\\d")
    assert required("SELECT x", "i") == ("select x",) and required("(?i:ab)c") == () and required(r"(?<!\w)\w++=\{") == ("={",)
    assert required(r"é+ab") == ("ab",)


def test_texts_without_a_literal_are_left_out_and_nothing_else_is(spark):
    """Findings are those of patterns alone, in texts with and without what they need, in any case."""
    r = random.Random(8)
    bits = ["SELECT * FROM t", "\u017felect * from u", "sele\u017fct", "from a import *", "FROM ubuntu", "PIP \u0130nstall x", "pip install y", "apt-get \u0131nstall z", "# select * from c", "time.sleep(0.05)", "x = 1", "<IMG src='a.G\u0130F'>", "for x in y:\n  cur.execute(q)", "\n"]
    files = [(f"{i}{s}", "\n".join(r.choice(bits) for _ in range(r.randrange(5)))) for i in range(150) for s in (".py", ".sql", "/Dockerfile", ".html")]
    table = spark.createDataFrame(files, "path string, text string")
    plain = with_parts(table).withColumn("code", blank_comments())
    for rule in (BY_ID[x] for x in ("GL002", "GL006", "GL009", "GL010", "GL011", "GL012", "GL017", "GL028")):
        want = plain.where(applicable(rule)).select("path", F.explode(F.expr(match_lines("code", rule.java))).alias("line")).collect()
        assert sorted((x.file, x.line) for x in scan(table, only=(rule.id,)).collect()) == sorted(map(tuple, want)), rule.id


def test_groups(spark):
    found = scan(rows(spark))
    got = [(r.group_label, r.group_note, r.rule) for r in summary.in_groups(summary.grouped(found, "file", "src")).collect()]
    assert got == [("b.yml", ". \u00b7 1", "GL003"), ("a.py", ". \u00b7 2", "GL005"), ("a.py", ". \u00b7 2", "GL028"), ("c.html", "web \u00b7 1", "GL011")]
    assert [r.group_label for r in summary.in_groups(summary.grouped(found, "severity")).collect()] == ["high", "medium", "low", "low"]
    one = summary.summarise(found).first()
    assert (one.total, one.high, one.medium, one.low, one.files) == (4, 1, 1, 2, 3) and [x.rule for x in one.by_rule] == ["GL003", "GL005", "GL011", "GL028"]
    assert summary.at_line(found, "src/a.py", 2).count() == 1 == summary.in_file(found, "src/b.yml").count()
    assert summary.exit_code(found, True) == 1 and summary.exit_code(found, False) == 0 == summary.exit_code(found.limit(0), True)


def test_own_rules(spark):
    rule = Rule("OWN01", "high", (".txt",), "regex", "todo left", "do it", "", r"TODO")
    register_rule(rule)
    try:
        got = scan(rows(spark, [("a.txt", "x\nTODO TODO\n"), ("b.py", "TODO\n")])).collect()
        assert [(r.rule, r.file, r.line, r.severity, r.suggestion) for r in got] == [("OWN01", "a.txt", 2, "high", "do it")] * 2
        with pytest.raises(ValueError, match="already"):
            register_rule(rule)
    finally:
        drop_rule("OWN01")
    assert scan(rows(spark, [("a.txt", "TODO")])).count() == 0
    with pytest.raises(ValueError, match="pattern"):
        register_rule(Rule("OWN02", "high", (".txt",), "regex", "m", "s", ""))


def test_facts_in_sql(spark):
    pyfacts.register_facts(spark, "facts_of")
    got = spark.sql("SELECT path, f.* FROM {files}, LATERAL facts_of(text) f", files=rows(spark, [("a.py", "while True:\n  for x in y:\n    sleep(1)\n"), ("b.py", "def ("), ("c.py", None)])).collect()
    assert sorted((r.path, r.kind, r.line, r.name) for r in got) == [("a.py", "endless", 1, None), ("a.py", "for", 2, "y"), ("a.py", "sleep", 3, None)]


def test_numbers_and_bindings():
    import ast

    number = lambda text: pyfacts.is_number(ast.parse(text, mode="eval").body)
    assert all(map(number, ["1", "2.5", "len(x)", "m.sum()", "a - b", "a + 1", "-len(x)", "a + (b + 3)", "x ** y", "s * len(t)"]))
    assert not any(map(number, ["True", "'a'", "x", "a + b", "f(1)", "[1][0]", "not x", "a + f(2)", "b'x' * n", "x.real"]))
    names = lambda text: sorted(pyfacts._assigned(ast.parse(text).body[0]))
    assert names("a, (b, c) = [], (0, [x for x in y])") == [("a", "list"), ("b", "number"), ("c", "list")]
    assert names("a, b = 1, 2, 3") == names("a.b = 1") == names("a = True") == names("a = [1].append") == names("a: int") == []
    assert names("a = b = 0") == [("a", "number"), ("b", "number")] and names("x: list = []") == [("x", "list")]


def test_options_of_a_manifest(spark):
    assert incremental.config_fingerprint(["b", "a"]) == incremental.config_fingerprint(["a", "b", "a"]) != incremental.config_fingerprint(["a"], ["b"])
    files = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "path string, text string, mtime_ns long")
    old, new = (incremental.manifest(files, incremental.config_fingerprint(x)) for x in (["GL001"], []))
    assert {r.how for r in incremental.reuse(new, old).collect()} == {"scan"} and {r.how for r in incremental.reuse(old, old).collect()} == {"stat"}
    assert incremental.invalidate(old).count() == 0
    assert [r.path for r in incremental.invalidate(old, spark.createDataFrame([("a",), ("a",)], "path string")).collect()] == ["b"]


def test_tree_is_walked_in_tasks(spark, tmp_path, monkeypatch):
    from wattscan.sources import tree as source

    files = [(f"d{i}/e{j}/f{k}.py", "x") for i in range(4) for j in range(3) for k in range(2)] + [("top.py", "y"), ("node_modules/m.py", "z"), (".git/g.py", "z"), ("d1/.hidden.yml", "h"), ("d2/skip/s.py", "s")]
    root = tree(tmp_path, files)
    monkeypatch.setattr(source, "LOOKED", 3)
    chunks = TreeReader({"path": root, "ignore": json.dumps(["*/skip/*"])}).partitions()
    assert sum(len(c.folders) for c in chunks) > 3
    spark.dataSource.register(TreeSource)
    got = spark.read.format("source_tree").option("ignore", json.dumps(["*/skip/*"])).load(root)
    assert sorted(os.path.relpath(r.path, root) for r in got.collect()) == sorted(p for p, _ in files if not p.startswith(("node_modules", ".git")) and "skip" not in p)
    both = spark.read.format("source_tree").options(paths=json.dumps([root + "/top.py", root + "/d0", root + "/missing"])).load()
    assert both.count() == 7


def test_lines_of_many_matches(spark):
    """Line numbers in a text with very many matches, and with the private characters that mark them."""
    many = "\n".join(["SELECT * FROM t"] * 20_000)
    got = [r.line for r in scan(rows(spark, [("a.sql", many), ("b.sql", "\ue000\ue001\nselect * from \ue000\n")]), only=("GL005",)).orderBy("file", "line").collect()]
    assert got == [*range(1, 20_001), 2]


def test_many_docstrings(spark):
    text = "".join(f'def f{i}():\n    """SELECT * FROM d{i}"""\n    q = "SELECT * FROM t"\n' for i in range(2000))
    assert [r.line for r in scan(rows(spark, [("a.py", text)]), only=("GL005",)).orderBy("line").collect()] == [3 * i + 3 for i in range(2000)]

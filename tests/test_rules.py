import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import duck, sparked
from wattscan.functions.text import STYLE_OF, blank_comments, quoted, universal_newlines, with_parts
from wattscan.operators import baseline, globs, incremental, summary
from wattscan.operators.pyfacts import facts
from wattscan.operators.rules import RULES, Rule
from wattscan.operators.scan import ordered, scan

SMALL = "/root/testdata/sf0.001"


def found(spark, *files, **options):
    rows = spark.createDataFrame([(p, t) for p, t in files], "path string, text string")
    return [(r.rule, r.file, r.line) for r in ordered(scan(rows, **options)).collect()]


def blanked(text, token, block):
    """A plain restatement of comment blanking."""
    out, i, quote = [], 0, None
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\n" or c == quote:
                quote = None
            elif c == "\\" and i + 1 < len(text) and text[i + 1] != "\n":
                out += [c, text[i + 1]]
                i += 2
                continue
            out.append(c)
        elif c == "'" and i and text[i - 1].isalpha() and i + 1 < len(text) and text[i + 1].isalpha():
            out.append(c)
        elif c in "\"'":
            quote = c
            out.append(c)
        elif text.startswith(token, i):
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
            out.append(" " * (end - i))
            i = end
            continue
        elif block and text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = len(text) if end < 0 else end + 2
            out += ["\n" if x == "\n" else " " for x in text[i:end]]
            i = end
            continue
        else:
            out.append(c)
        i += 1
    return "".join(out)


def test_every_rule_matches_its_templates(spark):
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sparked(queries["scan_all"](spark, SMALL)) == duck(SMALL, oracles["scan_all"])
    assert {f"rule_{r.id.lower()}" for r in RULES} <= set(queries)


@pytest.mark.parametrize("name", ["scan_ignored", "summary_by_severity", "baseline_anti_join", "incremental_reuse", "merge_batch", "prune_under", "stream_scan", "report_github", "report_html", "report_json", "list_rules", "languages", "docs_anchor"])
def test_query_equals_sql(spark, name):
    import __spark_entry__

    assert sparked(__spark_entry__.queries()[name](spark, SMALL)) == duck(SMALL, __spark_entry__.oracle_sql()[name])


def test_blanking_equals_restatement(spark):
    r = random.Random(3)
    kinds = {".py": ("#", False), ".c": ("//", True), ".sql": ("--", True)}
    rows = [(f"{i}{s}", "".join(r.choice(["a", "é", '"', "'", "\\", "\n", "#", "/", "//", "/*", "*/", "*", "-", "--", " "]) for _ in range(r.randrange(25)))) for s in kinds for i in range(600)]
    df = with_parts(spark.createDataFrame(rows, "path string, text string"))
    for row in df.withColumn("out", blank_comments()).collect():
        assert row.out == blanked(row.text, *kinds[row.suffix]), repr(row.text)


def test_long_strings_do_not_overflow(spark):
    text = '"' + "a\\n" * 400_000 + '" // x'
    df = with_parts(spark.createDataFrame([("a.c", text)], "path string, text string"))
    out = df.select(blank_comments().alias("x")).first().x
    assert len(out) == len(text) and out.endswith('"     ')


def test_suffixes(spark):
    names = ["a.py", ".bashrc", "Dockerfile", "x/Dockerfile.prod", "a.b.tf", "noext", "dot.", ".github/w.yml"]
    got = {r.path: r.suffix for r in with_parts(spark.createDataFrame([(n, "") for n in names], "path string, text string")).collect()}
    assert got == {"a.py": ".py", ".bashrc": "", "Dockerfile": "", "x/Dockerfile.prod": ".prod", "a.b.tf": ".tf", "noext": "", "dot.": "", ".github/w.yml": ".yml"}
    assert STYLE_OF["sql"] == [".sql"]


def test_order_disable_and_null_text(spark):
    files = [("b.py", "from a import *\nq = 'SELECT * FROM t'\n"), ("a.yml", "cron: '* * * * *'\n"), ("c.py", None), ("d.py", ""), ("broken.py", "def (:\nfrom a import *\n")]
    assert found(spark, *files) == [("GL003", "a.yml", 1), ("GL005", "b.py", 2), ("GL028", "b.py", 1), ("GL028", "broken.py", 2)]
    assert found(spark, *files, disable=("GL028",)) == [("GL003", "a.yml", 1), ("GL005", "b.py", 2)]
    assert found(spark) == []


def test_unicode_space_and_case(spark):
    assert found(spark, ("a.sql", "\u017felect\u00a0*\nfrom t")) == [("GL005", "a.sql", 1)]


def test_history_jobs(spark):
    clone = "      - uses: c\n        with:\n          fetch-depth: 0\n"
    text = f"jobs:\n  a:\n{clone}      - run: git describe\n  b:\n{clone}"
    assert found(spark, ("w.yml", text)) == [("GL004", "w.yml", 10)]
    assert found(spark, ("w.yml", "x: 1 # fetch-depth: 0\n")) == []


def test_scopes_of_facts():
    kinds = lambda text: [(f[0], f[2]) for f in facts(text)]
    assert ("exit", 3) in kinds("while True:\n  if x:\n    return_ = 1; break\n")
    assert ("exit", 3) not in kinds("while True:\n  def f():\n    return 1\n")
    assert facts("a\x00b") == [] and facts("def") == []


def test_globs():
    assert globs.prunable(["a/*", "b/**", "*.py", "c?/*"]) == ["a", "b", "c?"]
    assert globs.braces("{a,b{c,d}}") == ["a", "bc", "bd"]
    assert globs.editor_globs({"**/out/**": True, "x": False}, "/r") == ["/r/*/out", "/r/*/out/*"]


def test_baseline_file(spark, tmp_path):
    rows = scan(spark.createDataFrame([("r/a.py", "from a import *\nfrom b import *\n")], "path string, text string"))
    path = str(tmp_path / "b.json")
    assert baseline.write_baseline(rows, path, "r") == 1
    assert baseline.apply_baseline(rows, baseline.read_baseline(spark, path), "r").count() == 0
    assert baseline.apply_baseline(rows, baseline.read_baseline(spark, path + "x"), "r").count() == 2
    (tmp_path / "bad.json").write_text("[1]")
    assert baseline.read_baseline(spark, str(tmp_path / "bad.json")).count() == 0
    assert any("GL028" in r.text for r in summary.in_order(summary.html_report(rows)).collect())


def test_source_tree(spark, tmp_path):
    from wattscan.sources.config import load_config
    from wattscan.sources.tree import TreeSource

    for name in (".github/w.yml", "_x/a.py", "node_modules/b.py", ".git/c.py", "skip/d.py", "e.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x = 1\r\n\xff")
    spark.dataSource.register(TreeSource)
    rows = spark.read.format("source_tree").option("ignore", f'["{tmp_path}/skip/*"]').load(str(tmp_path)).collect()
    assert sorted(r.path[len(str(tmp_path)) + 1 :] for r in rows) == [".github/w.yml", "_x/a.py", "e.py"]
    assert {r.text for r in rows} == {"x = 1\n\ufffd"}
    assert spark.read.format("source_tree").load(str(tmp_path / "none")).count() == 0
    assert spark.range(1).select(universal_newlines(F.lit(b"a\r\nb\rc\xff")).alias("x")).first().x == "a\nb\nc\ufffd"
    (tmp_path / "c.toml").write_text('disable = "GL001"')
    with pytest.raises(SystemExit):
        load_config(str(tmp_path / "c.toml"))
    assert load_config(None).disable == ()


def test_reuse_and_config(spark):
    files = spark.createDataFrame([("a", "1", 5), ("b", "2", 5)], "path string, text string, mtime_ns long")
    now = incremental.manifest(files, "c2")
    assert {r.how for r in incremental.reuse(now, incremental.manifest(files, "c1")).collect()} == {"scan"}
    assert {r.how for r in incremental.reuse(now, now).collect()} == {"stat"}


def test_stream_takes_last_versions(spark, tmp_path):
    """Two versions in one batch, a version and its deletion, and a deletion in a later batch."""
    from wattscan.streaming.rescan import CHANGES, current, progress, stream_scan

    bad, good, work = "from a import *\n", "x = 1\n", str(tmp_path)
    for rows in ([("a.py", 1, bad, False), ("a.py", 2, good, False), ("b.py", 1, bad, False), ("b.py", 2, None, True), ("c.py", 1, bad, False), ("d.py", 2, bad, False), ("d.py", 1, good, None)], [("c.py", 2, None, True)]):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(f"{work}/changes")
        stream_scan(spark, f"{work}/changes", f"{work}/found", f"{work}/state").awaitTermination()
    assert [(r.file, r.rule) for r in current(spark, f"{work}/found").collect()] == [("d.py", "GL028")]
    assert [(r.batch, r.files) for r in progress(spark, f"{work}/found").collect()] == [(0, 4), (1, 1)]


def test_corpus_holds_whole_documents(spark):
    from wattscan.plans.corpus import TEMPLATES, files

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    for r in files(spark, "/root/testdata/sf0.001").collect():
        assert len(r.text) >= len(TEMPLATES[r.doc_id % len(TEMPLATES)][3]) + len(docs[r.doc_id]), r.path


def test_source_tree_reads_large_files(spark, tmp_path):
    from wattscan.sources.tree import TreeSource

    (tmp_path / "dump.sql").write_text("-- x\n" * 400_000 + "SELECT * FROM t;\n")
    spark.dataSource.register(TreeSource)
    rows = spark.read.format("source_tree").load(str(tmp_path))
    assert [(r.rule, r.line) for r in scan(rows).select("rule", "line").collect()] == [("GL005", 400_001)]
    capped = spark.read.format("source_tree").option("max_bytes", "1000000").load(str(tmp_path)).collect()
    assert [(r.text, r.size) for r in capped] == [(None, 2_000_017)]


def test_quoted_literals_are_read_back(spark):
    odd = ["it's", "\\", "\\\\", "a\\'b", "\\%\\_", "\\n\n\t", "\\u0041\\101", "\"x\" /* -- */ ; ${y}", "\ue000\U0001f600", ""]
    assert list(spark.range(1).select(*[F.expr(quoted(x)).alias(f"c{i}") for i, x in enumerate(odd)]).first()) == odd


def test_own_rules_with_quotes_and_backslashes_and_scans_without_rules(spark):
    table = spark.createDataFrame([("a.py", "x = 1\ny = 'it\\'s'\n"), ("b.py", "it's"), ("a.sql", "'it\\'s'")], "path string, text string")
    own = Rule("XX001", "low", (".py",), "regex", "it's \\n", "don't \\%", "\\", r"'it\\'s'")
    assert [(x.file, x.line, x.message, x.suggestion, x.co2e_estimate) for x in scan(table, only=("XX001",), own=(own,)).collect()] == [("a.py", 2, "it's \\n", "don't \\%", "\\")]
    assert scan(table, only=()).collect() == []

"""Exact dedup and quality rules against SQL and small cases."""

from pyspark.sql import functions as F

from tests.conftest import duck, sparked
from wattscan.llm import exact_dedup, quality

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _q int"


def odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long_text = " ".join(f"w{i % 4000}x" for i in range(40_000))
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", 1), (3, "a b", "en", None, 3, None, 2), (4, "a b", None, "s", 3, "y", 3), (4, "a b", None, "s", 3, "y", 3), (None, "a b", "en", "s", 3, "z", 4), (None, None, "en", "s", 3, "z", 4), (7, long_text, "en", "s", 9, None, 5), (8, "  \t\n", "de", "s", 1, None, 6)]
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_dedup_equals_sql(spark):
    assert sparked(exact_dedup.op2_exact_dedup(spark, SMALL)) == duck(SMALL, exact_dedup.OP2_SQL)


def test_exact_dedup_compares_texts(spark):
    """With a digest that many texts share, whole texts still decide."""
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "x"), (5, None), (6, "")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, digest=lambda t: F.length(t)).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1), 5: (6, 2), 6: (6, 2)}


def test_exact_dedup_odd_rows(spark):
    got = exact_dedup.exact_dedup(odd_rows(spark)).collect()
    assert len(got) == 9
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(1, 2, 3, False), (2, 2, 3, True), (3, 4, 4, False), (4, 4, 4, True), (None, 4, 4, False), (None, 2, 3, False), (7, 7, 1, True), (8, 8, 1, True)}
    assert exact_dedup.exact_dedup(odd_rows(spark).limit(0)).count() == 0
    kept = exact_dedup.stage(spark, odd_rows(spark), SMALL)
    assert kept.columns == odd_rows(spark).columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 7, 8]


def test_exact_dedup_stage_keeps_one_row_of_each_text(spark):
    """Also where rows or ids repeat, and where no row of a text has an id."""
    rows = [(4, "a b"), (4, "a b"), (3, "a b"), (5, "c d"), (5, "zz"), (6, "zz"), (None, "n"), (None, "n"), (7, "q"), (7, "q")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, digest int, n string")
    kept = exact_dedup.stage(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "n"), (4, "a b"), (5, "c d"), (6, "zz"), (7, "q")]
    assert exact_dedup.stage(spark, docs.limit(0), SMALL).count() == 0


def test_quality_equals_sql(spark):
    assert sparked(quality.op6_quality_rules(spark, SMALL)) == duck(SMALL, quality.OP6_SQL)


def test_quality_join_without_broadcast(spark):
    rows = quality.measured(spark.read.parquet(f"{SMALL}/documents.parquet")).drop("text")
    limits = quality.thresholds(rows)
    few = {r.doc_id: r.kept for r in quality.judged(rows, limits).collect()}
    many = {r.doc_id: r.kept for r in quality.judged(rows, limits, broadcast_groups=0).collect()}
    assert few == many and not all(few.values())


def test_sketch_buckets(spark):
    rows = spark.range(0, 5000).withColumn("b", quality.bucket(F.col("id"))).withColumn("top", quality.bucket_top(F.col("b"))).collect()
    assert all(r.id <= r.top <= r.id * (1 + 1 / 32) for r in rows)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_quality_odd_rows(spark):
    got = quality.quality(odd_rows(spark)).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[7].n_words == 40_000 and by[7].n_repeat_words == 40_000 and by[7].base_failed
    assert by[8].n_words == 1  # a no-break space is no white space here
    assert quality.quality(odd_rows(spark).limit(0)).count() == 0
    stage = quality.stage(spark, odd_rows(spark), SMALL)
    assert stage.columns == odd_rows(spark).columns and stage.count() == 0


def made_texts(word, n, words=100):
    return [" ".join(next(word) for _ in range(words)) for _ in range(n)]


def test_each_share_alone_rejects(spark):
    """In a clean group, a document that the base rule keeps fails by any one share."""
    word = iter(f"w{i}" for i in range(200_000))
    clean = made_texts(word, 150, 300)
    some = lambda n: [next(word) for _ in range(n)]
    again = some(22)
    lines = "\n".join(x for w in some(10) for x in (w, "same line"))
    planted = {"symbol_share": " ".join([w + "#" for w in some(30)] + some(270)), "mark_share": " ".join([w + "!" for w in some(30)] + some(270)), "dup_line_share": lines, "repeat_share": " ".join(again + some(250) + again)}
    rows = [(i, "\n".join(t[k * len(t) // 8 : (k + 1) * len(t) // 8] for k in range(8)) if i < 150 else t, "en", "s") for i, t in enumerate([*clean, *planted.values()])]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(150))
    for i, share in enumerate(planted, 150):
        assert not got[i].base_failed and not got[i].kept
        assert [s for s in quality.SHARES if got[i][s]] == [share]


def test_limits_follow_each_group(spark):
    """The same text is kept where such texts are usual and rejected where they are not; small groups lean on their language."""
    word = iter(f"w{i}" for i in range(700_000))
    some = lambda n: [next(word) for _ in range(n)]
    symbols = lambda k: " ".join([w + "#" for w in some(k)] + some(200 - k))
    rows = [(t, "en", "prose") for t in made_texts(word, 300, 200)] + [(symbols(10 + i % 60), "en", "tables") for i in range(300)] + [(t, "en", "long") for t in made_texts(word, 300, 1500)]
    rows += [(symbols(45), "en", "prose"), (symbols(45), "en", "tables"), (symbols(45), "en", "new")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert not got[900] and got[901] and sum(got[i] for i in range(300, 600)) >= 295 and all(got[i] for i in range(300))
    limit = {r.source_key: r.limits.symbol_share for r in quality.thresholds(quality.measured(docs)).collect()}
    assert limit["long"] < limit["prose"] < limit["tables"]
    assert len(set(limit.values())) == 4


def test_sketches_merge_in_any_order(spark):
    rows = quality.measured(spark.read.parquet(f"{SMALL}/documents.parquet")).withColumn("part", F.pmod("doc_id", F.lit(3)))
    whole = quality.sketches(rows, ["lang"])
    parts = quality.merged(quality.sketches(rows, ["part", "lang"]), ["lang"])
    assert sparked(whole) == sparked(parts)

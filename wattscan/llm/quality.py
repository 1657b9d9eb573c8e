"""Quality rules with adaptive thresholds.

Every document gets counts from its whole text. Four of them, as shares in thousandths, and the sizes they are shares of
go into quantile sketches per language and source: counts of logarithmic buckets (32 to each doubling, so a quantile is
off by 1/32 at most). Bucket counts add up, so sketches merge in any order to the same result. From a sketch comes the
limit of a share: ``median + max(REACH * (median - lower quartile), what OCCURRENCES are in a text of the median size)``.
The lower half of a group tells its spread, so up to half of a group may be junk, and all parts of a limit come from the
group's own quantiles. A group's limit is blended with its language's, which counts as ``PRIOR`` documents, and that with
the corpus's, so small groups follow the larger ones by degrees. A share fails above its limit if it also stands for more
than ``OCCURRENCES``, so that a short text is not rejected for one mark.

Nulls: a null text has no words; null language or source is a group of its own; a null id is kept as it is. Repeated rows
are judged alike. Ties: a share at its limit passes. Texts with no word fail the base rule. Very long texts are measured whole.
Extra columns are ignored by the query and kept by the stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattscan.llm.common import SPACE_CLASS, cut, once, table, text_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
#: Share -> (its count, what it is a share of, occurrences that are always allowed).
SHARES = {
    "symbol_share": ("n_symbols", "n_words", 16),
    "mark_share": ("n_marks", "n_words", 16),
    "dup_line_share": ("n_dup_lines", "n_lines", 2),
    "repeat_share": ("n_repeat_words", "n_words", 40),
}
SIZES = ["n_words", "n_lines"]
REACH = 6
#: Documents that the wider group's limit counts as.
PRIOR = 100
#: Threshold rows are broadcast up to this many (about 100 bytes each); beyond, they are joined by salted key.
BROADCAST_GROUPS = 50_000
SALTS = 16
DETAIL = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and the four shares; all in the row, nothing is shuffled."""
    text = text_of(text_col)
    # One projection per step: what a step uses more than once is then computed once.
    one = docs.withColumn("_q", F.struct(
        F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("lines"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, MARKS, ""))).cast("long").alias("n_marks"),
    ))
    words, n = F.col("_q.words"), F.size("_q.words")
    none = F.array().cast("array<long>")
    two = one.withColumn("_h", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(none))
    # Windows with different hashes differ, so only a text with equal hashes needs its windows sorted and compared.
    windows = F.sort_array(F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("g"), i.alias("at"))))
    three = two.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), windows)).drop("_h")
    same = lambda x, i: (x["g"] == F.get("_s", i - 1)["g"]) | (x["g"] == F.get("_s", i + 1)["g"])
    four = three.withColumn("_at", F.sort_array(F.transform(F.filter("_s", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["at"]))).drop("_s")
    # Windows overlap: a start adds the words beyond those of the start before it.
    fresh = F.transform("_at", lambda at, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), at - F.get("_at", i - 1))))
    five = four.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.col("_q.n_symbols").alias("n_symbols"),
        F.col("_q.n_marks").alias("n_marks"),
        F.size("_q.lines").cast("long").alias("n_lines"),
        (F.size("_q.lines") - F.size(F.array_distinct("_q.lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(fresh, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    shares = {s: F.floor(F.col(of) * 1000 / F.greatest(F.col(per), F.lit(1))).cast("long") for s, (of, per, _) in SHARES.items()}
    return once(five).withColumns({"base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")), **shares})


def bucket(v: Column) -> Column:
    """The sketch bucket of a non-negative whole number: itself below 64, then 32 to each doubling."""
    shift = F.greatest(F.length(F.bin(v)) - (DETAIL + 1), F.lit(0))
    return shift * (1 << DETAIL) + F.floor(v / F.pow(F.lit(2), shift))


def bucket_top(b: Column) -> Column:
    """The largest number in a bucket."""
    shift = F.greatest(F.floor(b / (1 << DETAIL)) - 1, F.lit(0))
    return ((b - shift * (1 << DETAIL) + 1) * F.pow(F.lit(2), shift) - 1).cast("long")


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable sketches of the shares and sizes: ``by, what, bucket, n``."""
    values = F.explode(F.array(*[F.struct(F.lit(s).alias("what"), bucket(F.col(s)).cast("long").alias("bucket")) for s in [*SHARES, *SIZES]]))
    return rows.where(~F.col("base_failed")).select(*by, values.alias("x")).groupBy(*by, "x.what", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The same sketches over fewer keys."""
    return sketch.groupBy(*by, "what", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, by: list[str], name: str) -> DataFrame:
    """``by``, ``name`` (a struct of the shares' limits) and ``name_rows``, a row for each group."""
    over = Window.partitionBy(*by, "what")
    counted = sketch.withColumn("upto", F.sum("n").over(over.orderBy("bucket"))).withColumn("rows", F.sum("n").over(over))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * q, bucket_top(F.col("bucket"))))
    quantiles = counted.groupBy(*by, "what").agg(at(50).alias("q50"), at(25).alias("q25"), F.max("rows").alias("rows"))
    of = lambda what, q: F.max(F.when(F.col("what") == what, F.col(q)))
    each = [(of(s, "q50") + F.greatest(REACH * (of(s, "q50") - of(s, "q25")), F.expr(f"{1000 * least}L div greatest(max(CASE WHEN what = '{per}' THEN q50 END), 1L)"))).alias(s) for s, (_, per, least) in SHARES.items()]
    return quantiles.groupBy(*by).agg(F.struct(*each).alias(name), F.max("rows").alias(f"{name}_rows"))


def blended(own: str, wider: str):
    """The limits of a group, with those of the wider group as ``PRIOR`` documents."""
    return F.struct(*[F.expr(f"({own}_rows * {own}.{s} + {PRIOR}L * {wider}.{s}) div ({own}_rows + {PRIOR}L)").alias(s) for s in SHARES])


def thresholds(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Limits per language and source: ``lang_key, source_key, limits``."""
    groups = sketches(rows.select(F.col(lang).alias("lang_key"), F.col(source).alias("source_key"), "base_failed", *SHARES, *SIZES), ["lang_key", "source_key"])
    own = limits(groups, ["lang_key", "source_key"], "own")
    everything = limits(merged(groups.withColumn("one", F.lit(1)), ["one"]), ["one"], "of_all")
    langs = limits(merged(groups, ["lang_key"]), ["lang_key"], "of_lang").withColumnRenamed("lang_key", "lang_2").withColumn("one", F.lit(1))
    langs = langs.join(everything, "one").select("lang_2", blended("of_lang", "of_all").alias("wider"))
    return own.join(langs, F.col("lang_key").eqNullSafe(F.col("lang_2"))).select("lang_key", "source_key", blended("own", "wider").alias("limits"))


def judged(rows: DataFrame, bounds: DataFrame, lang: str = "lang", source: str = "source", salt_by: str = "doc_id", broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``rows`` with ``kept``. ``bounds`` is a written table of limits; its size decides how it is joined."""
    if bounds.count() <= broadcast_groups:
        bounds, rows, same_salt = F.broadcast(bounds), rows.withColumn("_salt", F.lit(0)), F.lit(True)
    else:
        bounds = bounds.withColumn("salt_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows, same_salt = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")), F.col("_salt") == F.col("salt_key")
    joined = rows.join(bounds, F.col(lang).eqNullSafe(F.col("lang_key")) & F.col(source).eqNullSafe(F.col("source_key")) & same_salt, "left")
    fits = F.lit(True)
    for s, (count, _, least) in SHARES.items():
        fits = fits & F.coalesce((F.col(s) <= F.col("limits")[s]) | (F.col(count) <= least), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & fits).drop("lang_key", "source_key", "salt_key", "_salt")


def quality(docs: DataFrame) -> DataFrame:
    """Counts, shares, limits and verdict of each document, without its text."""
    rows = cut(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    return judged(rows, cut(thresholds(rows), "limits"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go. What is measured is written beside the documents, as measuring costs far more than that."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text", "lang", "source")
    rows = cut(measured(inner).drop("text"), "measured")
    return judged(rows, cut(thresholds(rows), "limits")).where("kept").select("doc.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", *SHARES)


def _share_sql(of: str, per: str) -> str:
    return f"CAST(floor({of} * 1000 / greatest({per}, 1)) AS BIGINT)"


def _limit_sql(name: str, by: str) -> str:
    """Quantiles of merged sketches, and the limits from them, one row for each group and share."""
    keys, using = f"{by}, " if by else "", " AND ".join(["true", *[f"q.{k} IS NOT DISTINCT FROM z.{k}" for k in by.split(", ") if k]])
    top = "((b - greatest(b // 32 - 1, 0) * 32 + 1) * CAST(pow(2, greatest(b // 32 - 1, 0)) AS BIGINT) - 1)"
    least = "CASE q.what " + " ".join(f"WHEN '{s}' THEN {1000 * n}" for s, (_, _, n) in SHARES.items()) + " END"
    per = "CASE q.what " + " ".join(f"WHEN '{s}' THEN '{x}'" for s, (_, x, _) in SHARES.items()) + " END"
    return f"""
{name}_c AS (SELECT {keys}what, b, sum(n) OVER (PARTITION BY {keys}what ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}what) AS total
    FROM (SELECT {keys}what, b, sum(n) AS n FROM sketch GROUP BY ALL)),
{name}_q AS (SELECT {keys}what, min({top}) FILTER (WHERE upto * 100 >= total * 50) AS q50, min({top}) FILTER (WHERE upto * 100 >= total * 25) AS q25, max(total) AS total
    FROM {name}_c GROUP BY ALL),
{name} AS (SELECT {"".join(f"q.{k}, " for k in by.split(", ") if k)}q.what AS share, q.total, q.q50 + greatest({REACH} * (q.q50 - q.q25), {least} // greatest(z.q50, 1)) AS lim
    FROM {name}_q q JOIN {name}_q z ON {using} AND z.what = {per})"""


OP6_SQL = f"""
WITH split AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text,
           list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents),
grams AS (
    SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5)),
starts AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (
    SELECT doc_id, sum(least(5, coalesce(gap, 5))) AS n
    FROM (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM starts) GROUP BY doc_id),
counted AS (
    SELECT s.doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
    FROM split s LEFT JOIN repeats r USING (doc_id)),
shares AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           {", ".join(f"{_share_sql(of, per)} AS {s}" for s, (of, per, _) in SHARES.items())}
    FROM counted),
long AS (UNPIVOT (SELECT doc_id, lang, source, base_failed, {", ".join([*SHARES, *SIZES])} FROM shares)
    ON {", ".join([*SHARES, *SIZES])} INTO NAME what VALUE v),
sketch AS (
    SELECT lang, source, what, sh * 32 + v // CAST(pow(2, sh) AS BIGINT) AS b, count(*) AS n
    FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS sh FROM long WHERE NOT base_failed) GROUP BY ALL),
{_limit_sql("own", "lang, source")}, {_limit_sql("of_lang", "lang")}, {_limit_sql("of_all", "")},
limits AS (
    SELECT o.lang, o.source, o.share, (o.total * o.lim + {PRIOR} * ((g.total * g.lim + {PRIOR} * a.lim) // (g.total + {PRIOR}))) // (o.total + {PRIOR}) AS lim
    FROM own o
    JOIN of_lang g ON g.share = o.share AND g.lang IS NOT DISTINCT FROM o.lang
    JOIN of_all a ON a.share = o.share),
counts AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, '{s}' AS share, {s} AS v, {of} > {n} AS many FROM shares" for s, (of, _, n) in SHARES.items())}),
verdict AS (
    SELECT c.doc_id, bool_and(v <= lim OR NOT many) AS fits
    FROM counts c
    JOIN limits l ON l.share = c.share AND l.lang IS NOT DISTINCT FROM c.lang AND l.source IS NOT DISTINCT FROM c.source
    GROUP BY c.doc_id)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(fits, true) AS kept, symbol_share, mark_share, dup_line_share, repeat_share
FROM shares s LEFT JOIN verdict v USING (doc_id)
"""

"""URL filter: host and path rules first, a logistic regression on hashed character n-grams for the rest.

The regression is trained on a small labelled table of URLs; ``labelled_urls`` builds one from word lists and made-up
names, from no table, and any table with ``url`` and ``bad`` can take its place. Everything stays in the JVM.

Nulls: a null URL, or one without ``://``, has an empty host and path and gets the regression's verdict on empty text,
which is ``allow``. Repeated rows are judged alike, longest rules win (ties: rules of one length that both fit are the
same rule), and a score of just a half allows. A very long URL is read whole. Extra columns are ignored. An empty table gives an empty result; an empty training table blocks nothing.
"""

from __future__ import annotations

from random import Random

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscan.llm.common import cut, table

#: (rule, verdict): a rule is a host, of which all subdomains count, and the start of a path.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Words of hosts and paths in the built-in training table, from general knowledge of the web.
BAD_WORDS = "casino pills cheap spam farm bets betting free adult xxx porn viagra cialis loan loans payday replica warez crack cracked torrent jackpot poker slots escort ads adserver track tracker clickbait win winner prize sex hack keygen lottery bonus pharmacy cams nude hookup crypto doubler giveaway rich quick weight miracle seo backlinks traffic proxy popunder affiliate redirect phish verify login-secure unlock".split()
GOOD_WORDS = "news wiki docs school library garden museum history science travel recipe kitchen weather music health sport city review forum journal photo book books story learn code data open river green stone north university college research institute gov court county council hospital clinic theatre gallery orchestra craft paper letters daily times post tribune herald standard chronicle society academy press review atlas maps nature birds trees forest ocean mountain railway bridge engine physics chemistry biology maths language poetry grammar cooking bread coffee tea bicycle hiking climbing sailing chess family parents teachers students work jobs careers union bank energy solar water".split()
GOOD_ENDS, BAD_ENDS = "com org net edu gov io co.uk de fr es info".split(), "com net org info biz top xyz click ru online site".split()
SEED = 5
FEATURES = 1 << 15
SIZES = (3, 4, 5)


def labelled_urls(spark: SparkSession, each: int = 1500) -> DataFrame:
    """``url, bad``: made-up URLs, a third bad; some good hosts are names without any known word."""
    r, rows = Random(SEED), []
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    name = lambda: "".join(r.choice("bcdfghjklmnprstvwy") + r.choice(["a", "e", "i", "o", "u", "ea", "ou"]) + r.choice(["", "n", "r", "s", "th", "ng"]) for _ in range(r.randint(2, 4)))
    number = lambda: str(r.randint(1, 10 ** r.randint(1, 6)))
    words = lambda of, n, by: by.join(r.choice(of) for _ in range(n))
    sub = lambda: r.choice(["", "", "www.", "m.", "blog.", "en.", "shop.", "app."])
    path = lambda of: r.choice(["", f"/{number()}", f"/{r.choice(['en', 'de', 'fr', 'es', 'it'])}/{number()}", f"/{words(of, r.randint(1, 3), '-')}", f"/{words(of, 2, '/')}.html", f"/20{number()[:2]}/{words(of, 2, '-')}", f"/{name()}/{name()}"])
    for _ in range(each):
        host = r.choice([words(BAD_WORDS, 1, "") + number(), words(BAD_WORDS, 2, r.choice(["-", ""])), words(BAD_WORDS, 3, "-"), r.choice(BAD_WORDS) + "-" + name(), name() + r.choice(BAD_WORDS)])
        rows.append((f"{r.choice(['http', 'https'])}://{sub()}{host}{r.choice(['', '', '.' + name()])}.{r.choice(BAD_ENDS)}{path(BAD_WORDS)}{r.choice(['', '?id=' + number()])}", 1))
        known = r.choice([words(GOOD_WORDS, 1, ""), words(GOOD_WORDS, 2, r.choice(["-", ""])), name() + r.choice(["", "-"]) + r.choice(GOOD_WORDS), r.choice(GOOD_WORDS) + number()[:2]])
        rows.append((f"https://{sub()}{known}{r.choice(['', '', '.' + name()])}.{r.choice(GOOD_ENDS)}{path(GOOD_WORDS)}", 0))
        unknown = r.choice([name(), name() + name(), f"{name()}-{name()}", some("aeioustrnlmdchbg", r.randint(4, 12)), name() + number()[:2]])
        rows.append((f"{r.choice(['http', 'https'])}://{sub()}{unknown}{r.choice(['', '', '.' + name() + number()[:1]])}.{r.choice(GOOD_ENDS)}{path(GOOD_WORDS)}", 0))
    return spark.createDataFrame(rows, "url string, bad int")


def split_url(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns({"host": F.translate(host, upper, lower), "path": F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)})


def ruled(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """``pages`` (with host and path) with the longest fitting ``rule`` and its ``rule_verdict``, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(RULES if rules is None else rules, key=lambda r: len(r[0])):  # the last that fits stands outermost
        host, slash, path = name.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def _runs(text, n: int, mark: str):
    """The marked character n-grams of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _grams(urls: DataFrame) -> DataFrame:
    """Hashed n-grams of host and path; digits are alike."""
    digits = lambda c: F.translate(F.col(c), "123456789", "000000000")
    host, path = F.concat(F.lit("^"), digits("host"), F.lit("$")), F.concat(digits("path"), F.lit("$"))
    terms = F.concat(*[_runs(host, n, "h") for n in SIZES], *[_runs(path, n, "p") for n in SIZES])
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_terms", outputCol="_features").transform(urls.withColumn("_terms", terms)).drop("_terms")


def fitted(labelled: DataFrame):
    """The regression, or None if the table lacks good or bad URLs."""
    rows = cut(_grams(split_url(labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()))).select("_features", F.col("bad").cast("double").alias("_label")), "urls")
    if rows.select("_label").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_at", maxIter=60, regParam=1e-4, standardization=False).fit(rows)


_BUILT_IN: dict[str, object] = {}


def built_in(spark: SparkSession):
    """The regression of the built-in table, fitted once in an application."""
    key = spark.sparkContext.applicationId
    if key not in _BUILT_IN:
        _BUILT_IN.clear()
        _BUILT_IN[key] = fitted(labelled_urls(spark))
    return _BUILT_IN[key]


def judged(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_score``; without a labelled table the built-in one."""
    rows, model = ruled(split_url(pages.select("page_id", "url")), rules), built_in(pages.sparkSession) if labelled is None else fitted(labelled)
    if model is None:
        scored = rows.withColumn("bad_score", F.lit(0.0))
    else:
        scored = model.transform(_grams(rows)).withColumn("bad_score", vector_to_array("_p")[1])
    verdict = F.coalesce("rule_verdict", F.when(F.col("bad_score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_score")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))

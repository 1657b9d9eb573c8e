"""The URL classifier: scores by hand, URLs of another making, and odd rows."""

import math

import pytest
from pyspark.ml.feature import HashingTF

from wattscan.llm import url_filter

#: (url, bad): written by hand, no word lists behind them.
WRITTEN = [
    ("https://www.best-casino-bonus-online.top/play", 1),
    ("http://cheap-viagra-pills.biz/buy-now", 1),
    ("http://freewarezdownloads.ru/crack/office-keygen.html", 1),
    ("http://xxx-adult-cams.xyz/live", 1),
    ("http://win-lottery-prize.click/claim?id=9", 1),
    ("http://payday-loans-fast.info/apply", 1),
    ("https://pokerslots777.com/", 1),
    ("http://adserver.tracker-popunder.net/r?u=1", 1),
    ("http://replica-watch-cheap.site/shop", 1),
    ("http://torrentz-crack.org/get/1", 1),
    ("https://en.wikipedia.org/wiki/Photosynthesis", 0),
    ("https://docs.python.org/3/library/json.html", 0),
    ("https://www.bbc.co.uk/news/science", 0),
    ("https://www.cityofboston.gov/council/minutes", 0),
    ("https://github.com/apache/spark", 0),
    ("https://www.nature.com/articles/s41586", 0),
    ("https://recipes.kitchenstories.de/apfelkuchen", 0),
    ("https://mit.edu/research/physics", 0),
    ("https://openstreetmap.org/relation/62422", 0),
    ("https://blog.weberfamily.net/2019/garden", 0),
    ("https://www.zvukolom.fr/12", 0),
    ("https://harbourlight.org/", 0),
]


def test_urls_of_another_making(spark):
    rows = [(i, u) for i, (u, _) in enumerate(WRITTEN)]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), rules=[]).collect()}
    wrong = [u for i, (u, bad) in enumerate(WRITTEN) if (got[i].verdict == "block") != bool(bad)]
    assert len(wrong) <= 2, wrong


def test_scores_equal_a_plain_sum(spark):
    """Every n-gram of host and path, hashed once, weighs in."""
    model, hashing = url_filter.built_in(spark), HashingTF(numFeatures=url_filter.FEATURES)
    urls = ["http://Spam-Farm.example.org/en/756", "https://thther.example.org/", "nothing", "http://a/b?c#d", "http://" + "long" * 3000 + ".com/x"]
    got = url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=[]).collect()
    zeros = str.maketrans("123456789", "0" * 9)
    for r in got:
        host, path = "^" + r.host.translate(zeros) + "$", r.path.translate(zeros) + "$"
        grams = {m + t[i : i + n] for m, t in (("h", host), ("p", path)) for n in url_filter.SIZES for i in range(len(t) - n + 1)}
        z = model.intercept + sum(model.coefficients[hashing.indexOf(k)] for k in {hashing.indexOf(g): g for g in grams}.values())
        assert r.bad_score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)
        assert r.verdict == ("block" if r.bad_score > 0.5 else "allow")


def test_url_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "x", 0.5), (None, "http://a.net/es/1", "y", 0.5), (3, "", None, None), (4, "http://win.casino.org", "h", 1.0), (4, "http://win.casino.org", "h", 1.0)], "page_id long, url string, host string, bad_score double")
    got = url_filter.judged(pages)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "bad_score"]
    rows = got.collect()
    assert len(rows) == 5 and {(r.page_id, r.host, r.path, r.rule) for r in rows} == {(1, "", "", None), (None, "a.net", "/es/1", "net/es/"), (3, "", "", None), (4, "win.casino.org", "", None)}
    assert [r.verdict for r in rows if r.page_id in (1, 3)] == ["allow", "allow"]
    assert url_filter.judged(pages.limit(0)).count() == 0
    labels = "url string, bad int"
    for labelled in ([], [("http://a.com", 1)], [(None, 1), ("http://b.com", None)]):
        none = url_filter.judged(pages, spark.createDataFrame(labelled, labels)).collect()
        assert {r.verdict for r in none if r.rule is None} == {"allow"} and {r.bad_score for r in none} == {0.0}

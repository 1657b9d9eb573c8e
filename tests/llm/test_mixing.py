"""Mixing against plain numpy, held-out labels and odd rows."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_native_ops import odd_rows
from wattscan.llm import mixing
from wattscan.llm.common import cut, table

MIDDLE = "/root/testdata/sf0.1"


def made_rows(spark, n=400):
    """A written table of posteriors and tokens."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([1, 0.5, 0.2], n)
    tokens = rng.integers(1, 500, n)
    rows = [(int(t), *map(float, x)) for t, x in zip(tokens, p)]
    return cut(spark.createDataFrame(rows, "_n long, p_clean double, p_poor double, p_toxic double")), p, tokens


def test_rates_meet_targets_and_equal_plain_steps(spark):
    rows, p, n = made_rows(spark)
    targets = {"clean": 0.6, "poor": 0.35, "toxic": 0.05}
    found = mixing.fit_rates(rows, targets, 60_000.0, strict=True)
    want = np.array([36_000, 21_000, 3_000.0])
    assert np.allclose([found.expected[d] for d in mixing.DOMAINS], want, rtol=2e-3)
    assert found.wanted == dict(zip(mixing.DOMAINS, want.tolist()))
    # The same steps without Spark, and the sums of the rates that the expression gives.
    rate, steps = np.ones(len(p)), []
    for _ in range(len(found.steps)):
        moved = (p * (n * (rate > 0))[:, None]).T @ p
        steps.append(np.linalg.solve(moved + 1e-6 * np.trace(moved) * np.eye(3), (rate * n) @ p - want))
        rate = np.maximum(0, rate - p @ steps[-1])
    assert np.allclose(steps, found.steps, rtol=1e-6)
    got = rows.withColumn("rate", mixing.rate(found.steps)).select("rate").toPandas()["rate"]
    assert np.allclose(sorted(got), sorted(rate), atol=1e-6) and got.min() >= 0


def test_targets_out_of_reach(spark):
    """No rates give tokens to a domain that has none: the rest is met, and a strict fit says so."""
    rows = cut(spark.createDataFrame([(100, 1.0, 0.0, 0.0), (50, 0.5, 0.5, 0.0)], "_n long, p_clean double, p_poor double, p_toxic double"))
    targets = {"clean": 0.5, "poor": 0.25, "toxic": 0.25}
    found = mixing.fit_rates(rows, targets)
    assert found.expected["toxic"] == 0 and found.expected["clean"] == pytest.approx(75, rel=0.01) and found.expected["poor"] == pytest.approx(37.5, rel=0.01)
    with pytest.raises(ValueError, match="no rates"):
        mixing.fit_rates(rows, targets, strict=True)


def test_bounded_rates_are_the_least_squares_optimum(spark):
    """Rates of [0, 1] against a long plain descent, and what is expected against the sums of the rates."""
    rows, p, n = made_rows(spark)
    wanted = {"clean": 1.0, "poor": 0.4, "toxic": 0.05}
    found = mixing.fit_rates(rows, wanted=wanted, most=1.0)
    total = n @ p
    want, scale = total * [1.0, 0.4, 0.05], 1 / total
    loss = lambda r: (scale * ((r * n) @ p - want) ** 2).sum()
    rate = np.ones(len(p))
    reach = np.linalg.eigvalsh(np.sqrt(scale)[:, None] * ((p * n[:, None]).T @ p) * np.sqrt(scale))[-1]
    for _ in range(20_000):
        rate = np.clip(rate - p @ (scale * ((rate * n) @ p - want)) / reach, 0, 1)
    mine = mixing.stepped(p, found.steps, 1.0)
    assert loss(mine) <= 1.05 * loss(rate) and np.all((mine >= 0) & (mine <= 1))
    assert np.allclose([found.expected[d] for d in mixing.DOMAINS], (mine * n) @ p)
    got = sorted(r.rate for r in rows.withColumn("rate", mixing.rate(found.steps, 1.0)).collect())
    assert np.allclose(got, sorted(mine), atol=1e-9)


@pytest.mark.parametrize("missing", [0, 1, 2])
def test_a_domain_without_labels_is_left_out(spark, missing):
    """Its posterior is 0 everywhere, the fit warns, and the others keep what is wanted of them."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    part = labels.join(mixing.domain_of(labels).where(f"label <> {missing}"), labels.doc_id == F.col("labelled_id"), "left_semi")
    with pytest.warns(UserWarning, match=mixing.DOMAINS[missing]):
        model = mixing.fitted(docs, part)
    rows = cut(mixing.posteriors(docs, model, "doc_id"))
    assert rows.agg(F.max(f"p_{mixing.DOMAINS[missing]}")).first()[0] == 0
    found = mixing.fit_rates(rows, wanted=mixing.WANTED, most=1.0)
    if missing:
        assert found.expected["clean"] >= 0.9 * found.wanted["clean"]
    free = mixing.fit_rates(rows, {d: 0.0 if i == missing else 0.5 for i, d in enumerate(mixing.DOMAINS)}, strict=True)
    assert free.expected[mixing.DOMAINS[missing]] == 0


def test_draw_takes_all_of_small_domains():
    assert mixing.draw_rates({0: 1000, 1: 10, 2: 500}, 410) == {1: 1.0, 2: 0.4, 0: 0.2}
    assert mixing.draw_rates({0: 3, 1: 2}, 100) == {0: 1.0, 1: 1.0} and mixing.draw_rates({}, 5) == {}


def test_scores_equal_plain_sums():
    rng = np.random.default_rng(1)
    slots = np.sort(rng.choice(1000, 60, replace=False))
    model = mixing.Model(np.array([0.1, -0.2, 0.3]), slots, rng.normal(size=(60, 3)))
    documents = [np.sort(rng.choice(1000, k, replace=False)) for k in (0, 5, 300, 0, 1, 0)]
    weights = dict(zip(slots.tolist(), model.weights))
    plain = [model.bias + sum((weights.get(s, np.zeros(3)) for s in d.tolist()), np.zeros(3)) for d in documents]
    starts = np.cumsum([0, *map(len, documents)])[:-1]
    assert np.allclose(mixing.scores(model, np.concatenate(documents), starts), plain)


def test_terms_equal_plain_words():
    """Words, stems and shapes of whole texts, hashed byte by byte."""
    top, mul, more = (1 << 64) - 1, int(mixing._MUL), int(mixing._MORE)

    def slot(data, kind):
        h = sum((c + 1) * pow(mul, i + 1, 1 << 64) for i, c in enumerate(data)) & top
        h = (h + kind) * more & top
        return ((h ^ h >> 31) * mul & top) >> 64 - 18

    def plain(text):
        low = text.lower()
        words = [w.encode() for w in re.split("[ \t-\r]+", low.translate(str.maketrans("", "", mixing.PUNCTUATION))) if w]
        shapes = [re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[0-9]+", b"9", w.encode())) for w in re.split("[ \t-\r]+", low) if w]
        return len(words), sorted({slot(w, 0) for w in words} | {slot(w[: mixing.STEM], 1) for w in words} | {slot(x, 2) for x in shapes})

    texts = ["", "  ", "Ab ab, (x)", "...", "D\u00e9j\u00e0 VU 12.5% a1b22", "long" * 500 + " z", "a\tb\x0bc\u00a0d", "\u0130x \u00df", "\x00 a"]
    n, slots, starts = mixing.terms(texts)
    assert [(int(k), slots[a:b].tolist()) for k, a, b in zip(n, starts, starts[1:])] == [plain(t) for t in texts]
    assert mixing.FEATURES == 1 << 18


def test_posteriors_of_held_out_labels(spark):
    """Fitted on labels of half the ids, judged on the other half; surer posteriors are righter."""
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    model = mixing.fitted(docs, labels.where("crc32(cast(doc_id as string)) % 2 = 0"))
    truth = {r.labelled_id: r.label for r in mixing.domain_of(labels.where("crc32(cast(doc_id as string)) % 2 = 1")).collect()}
    rows = [r for r in mixing.posteriors(docs, model, "doc_id").collect() if r.doc_id in truth]
    p, y = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows]), np.array([truth[r.doc_id] for r in rows])
    assert np.allclose(p.sum(1), 1) and len(rows) == len(truth) > 1000
    right = p.argmax(1) == y
    assert right.mean() >= 0.93 and right[y == 2].mean() >= 0.65 and right[y == 0].mean() >= 0.96
    sure = p.max(1)
    assert abs(sure.mean() - right.mean()) < 0.03  # calibrated


def test_mixed_query(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = mixing.mixed(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    for d in mixing.DOMAINS:
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) == pytest.approx(rows[0][f"expected_{d}"], rel=1e-6)
        assert rows[0][f"expected_{d}"] == pytest.approx(rows[0][f"wanted_{d}"], abs=0.01 * sum(r.n_tokens for r in rows))


def test_stage_keeps_clean_and_thins_toxic(spark):
    docs, labels = table(spark, MIDDLE, "documents"), {r.labelled_id: r.label for r in mixing.domain_of(table(spark, MIDDLE, "labels")).collect()}
    kept = mixing.stage(spark, docs, MIDDLE)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    share = [np.mean([i in left for i, d in labels.items() if d == k]) for k in range(3)]
    assert share[0] >= 0.97 and share[1] <= 0.7 and share[2] <= 0.3


def test_mixing_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(odd_rows(spark), labels).collect()
    assert len(got) == 9 and all(r.rate >= 0 and r.p_clean == pytest.approx(1 / 3) for r in got)  # too few labels of any domain
    assert len(mixing.mixed(odd_rows(spark), labels.limit(0)).collect()) == 9
    assert mixing.mixed(odd_rows(spark).limit(0), labels).count() == 0
    again = collections.Counter((r.doc_id, r.rate) for r in got)
    assert max(again.values()) >= 2  # repeated rows are judged alike


def test_stage_odd_rows(spark):
    rows = odd_rows(spark).withColumnRenamed("_q", "p_clean")
    got = mixing.stage(spark, rows, "/root/testdata/sf0.001")
    assert got.columns == rows.columns and got.count() <= 9
    assert mixing.stage(spark, rows.limit(0), "/root/testdata/sf0.001").count() == 0


def test_long_text_and_rare_words():
    """Every word counts: a rare word in a long text moves the posteriors."""
    r = random.Random(2)
    plain = [np.unique([r.randrange(1000) for _ in range(50)]) for _ in range(600)]
    labels = np.array([i % 2 * 2 for i in range(600)])
    examples = [np.union1d(x, [5000 + i % 7]) if labels[i] else x for i, x in enumerate(plain)]
    model = mixing.trained(examples, labels)
    long_text = np.arange(1000)
    z = [mixing.scores(model, x, [0])[0] for x in (long_text, np.union1d(long_text, [5003]))]
    assert z[1][2] - z[1][0] > z[0][2] - z[0][0] + 1

"""Mixing to target weights with soft domain membership.

A classifier trained on the labels table gives each document posteriors over the domains ``clean``, ``poor`` and
``toxic``. Rates (how often a document is taken, never negative) start at one and follow projected gradient steps of a
least-squares problem: the expected tokens of each domain, ``sum(rate * tokens * posterior)``, should equal the targets.
A step moves every rate along its document's posteriors. Misses count relative to a domain's size, so a plain gradient
step, as long as the Gram matrix of the posteriors allows, always comes nearer. Without an upper bound of the rates a step
scaled by the inverse of that matrix (over the documents whose rate is above zero) is tried first and kept only where it
comes nearer too. Totals and the matrix are sums over documents: each step is one pass over a narrow written table, and a
rate follows from the posteriors and steps. With the upper bound ``most`` of a rate the steps are projected on both bounds,
so what is expected is what a stage that takes each document at most once gives.

The classifier is a multinomial regression on which distinct words, word stems (``STEM`` bytes, beside the whole words)
and word shapes a text has, hashed to ``FEATURES`` slots; no word is left out. It is fitted, with an L1 penalty, on a bounded sample of labelled documents in one task (of
each domain as many as of the others while it has them; the posteriors are set right by the rates of the draw), and
its temperature on a tenth of them that the fit does not see, so posteriors are no surer than they are right.

Nulls: a null text has no tokens and gets the posteriors of a text without words; a null id is drawn as a number of its
own; null labels count as unlabelled. A domain with fewer than ``LEAST_LABELS`` labelled documents is left out, with a
warning: no document is in it, and its target is not sought. Without labels of two domains the posteriors are constant:
one domain's, or equal where no domain has labels enough. Repeated rows are judged alike, ties don't matter. Very long texts are read whole. A target that no
rates can meet is met as nearly as the steps come; ``fit_rates`` returns what is expected beside what is wanted, and
raises where ``strict``. Extra columns are ignored by the operator and kept by the stage. An empty table gives an empty
result.
"""

from __future__ import annotations

import warnings
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattscan.llm.common import cut, table

DOMAINS = ["clean", "poor", "toxic"]
#: Share of tokens that each domain should have.
TARGETS = {"clean": 0.9, "poor": 0.09, "toxic": 0.01}
#: What the pipeline wants of each domain, as a share of what there is: all that is clean, half of what is poor, and
#: little that is toxic.
WANTED = {"clean": 1.0, "poor": 0.5, "toxic": 0.05}
#: Labelled documents that a domain must have.
LEAST_LABELS = 10
#: Labelled documents that the classifier is fitted on, at most (about); the draw is by a hash of the id.
TRAIN_ROWS = 20_000
FEATURES = 1 << 18
#: Dropped from words; what is left of a text are its tokens.
PUNCTUATION = ".,;:!?\"'()"
#: Bytes of a word that are its stem.
STEM = 4
#: Of the fit: passes over the sample, learning rate, and L1 and L2 penalties.
EPOCHS, RATE, SPARSE, RIDGE = 6, 0.5, 5.0, 0.1
STEPS = 30
#: Steps end when every domain is within this share of its target, or within a tenth of it of all wanted tokens.
CLOSE = 1e-3
#: A strict fit raises when a domain is further from its target, as a share of all wanted tokens.
TOLERANCE = 0.01


class Model(NamedTuple):
    """Bias and weights of the domains; ``slots`` are the features with weights, rising."""

    bias: np.ndarray
    slots: np.ndarray
    weights: np.ndarray


class Rates(NamedTuple):
    steps: list[list[float]]
    wanted: dict[str, float]
    expected: dict[str, float]


_U = np.uint64
_MUL, _MORE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_BYTES = np.arange(256)
_SPACE = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
_MARK = np.isin(_BYTES, list(PUNCTUATION.encode()))
#: A byte's part of a shape: letters (and what isn't ASCII) as ``a``, digits as ``9``, runs of both as one; the rest as it is.
_SHAPE = np.where((_BYTES >= 128) | (_BYTES >= 97) & (_BYTES <= 122), 97, np.where((_BYTES >= 48) & (_BYTES <= 57), 57, _BYTES)).astype(np.uint8)


def _word_hashes(chars: np.ndarray, *least: int) -> list[np.ndarray]:
    """Where words start among the bytes (the last is a space), and hashes of the words, and of their first ``least`` bytes."""
    space = _SPACE[chars]
    first = ~space & np.r_[True, space[:-1]]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [starts, *[np.empty(0, _U)] * (1 + len(least))]
    at = np.arange(len(chars))
    place = at - np.maximum.accumulate(np.where(first, at, 0))
    powers = np.cumprod(np.full(int(place[~space].max()) + 1, _MUL))
    values = np.where(space, _U(0), (chars.astype(_U) + _U(1)) * powers[np.where(space, 0, place)])
    return [starts, np.add.reduceat(values, starts), *[np.add.reduceat(np.where(place < n, values, _U(0)), starts) for n in least]]


def _slot(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes + _U(kind)) * _MORE
    return ((mixed ^ (mixed >> _U(31))) * _MUL >> _U(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text; distinct slots of its words, stems and word shapes, text by text; and where each text's begin."""
    parts = [t.lower().encode() for t in texts]
    chars = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in parts])
    plain = np.flatnonzero(~_MARK[chars])
    shapes = _SHAPE[chars]
    shown = np.flatnonzero(np.r_[True, shapes[1:] != shapes[:-1]] | (shapes != 97) & (shapes != 57))
    starts, words, stems = _word_hashes(chars[plain], STEM)
    at, shaped = _word_hashes(shapes[shown])
    of, of_shape = np.searchsorted(ends, plain[starts], "right"), np.searchsorted(ends, shown[at], "right")
    both = np.unique(np.concatenate([of * FEATURES + _slot(words, 0), of * FEATURES + _slot(stems, 1), of_shape * FEATURES + _slot(shaped, 2)]))
    return np.bincount(of, minlength=len(texts)), both % FEATURES, np.searchsorted(both, np.arange(len(texts) + 1) * FEATURES)


def _sliced(batches, rows: int = 200, size: int = 1 << 21):
    """Slices of few rows and bytes (a longer text comes alone), with their texts."""
    for batch in batches:
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        ends, at = np.cumsum([0, *map(len, texts)]), 0
        while at < len(texts):
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1), len(texts))
            yield batch.slice(at, to - at), texts[at:to]
            at = to


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def trained(examples: list[np.ndarray], labels: np.ndarray) -> Model:
    """Follow-the-regularised-leader passes over the examples (distinct slots each), then the temperature on every tenth."""
    k = len(DOMAINS)
    held = np.arange(len(examples)) % 10 == 9 if len(examples) >= 100 else np.zeros(len(examples), bool)
    lead, seen, bias = np.zeros((FEATURES, k)), np.zeros((FEATURES, k)), np.log((np.bincount(labels, minlength=k) + 1.0) / (len(labels) + k))

    def weights(slots):
        z = lead[slots]
        return np.where(np.abs(z) <= SPARSE, 0.0, (np.sign(z) * SPARSE - z) / ((1 + np.sqrt(seen[slots])) / RATE + RIDGE))

    for _ in range(EPOCHS):
        for i in np.flatnonzero(~held):
            slots = examples[i]
            w = weights(slots)
            g = softmax(bias + w.sum(0))
            g[labels[i]] -= 1
            root = np.sqrt(seen[slots])
            seen[slots] += g * g
            lead[slots] += g - (np.sqrt(seen[slots]) - root) / RATE * w
            bias -= RATE / 10 * g
    used = np.flatnonzero((np.abs(lead) > SPARSE).any(1))
    model = Model(bias, used, weights(used))
    if held.any():
        z, truth = np.array([scores(model, examples[i], [0])[0] for i in np.flatnonzero(held)]), labels[held]
        loss = lambda t: -np.log(softmax(z * t)[np.arange(len(z)), truth] + 1e-12).mean()
        best = min(np.geomspace(0.1, 10, 81), key=loss)
        model = Model(bias * best, used, model.weights * best)
    return model


def scores(model: Model, slots: np.ndarray, starts) -> np.ndarray:
    """Sums of the weights of each document's slots; ``starts`` holds where each begins."""
    at = np.minimum(np.searchsorted(model.slots, slots), max(len(model.slots) - 1, 0))
    hit = np.flatnonzero(model.slots[at] == slots) if len(model.slots) else np.empty(0, int)
    of = np.searchsorted(starts, hit, "right") - 1
    found = model.weights[at[hit]] if len(hit) else np.zeros((0, len(DOMAINS)))
    return model.bias + np.stack([np.bincount(of, found[:, d], len(starts)) for d in range(len(DOMAINS))], 1)


def domain_of(labels: DataFrame):
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    return known.select(F.col("doc_id").alias("labelled_id"), F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1).alias("label"))


def draw_rates(counts: dict[int, int], train_rows: int) -> dict[int, float]:
    """The share of each domain's labels to draw: all of small domains, equally many of large ones, ``train_rows`` in all."""
    rates, left = {}, float(train_rows)
    for i, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        taken = min(n, left / (len(counts) - i))
        rates[label], left = taken / n, left - taken
    return rates


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    known = domain_of(labels)
    present = cut(known.join(docs.select(F.col("doc_id").alias("labelled_id")).distinct(), "labelled_id"), "labels")
    counts = dict(present.groupBy("label").count().collect())  # a row for each domain
    few = [d for i, d in enumerate(DOMAINS) if counts.get(i, 0) < LEAST_LABELS]
    rates = draw_rates({i: n for i, n in counts.items() if n >= LEAST_LABELS}, train_rows)
    if few:
        warnings.warn(f"fewer than {LEAST_LABELS} labelled documents are {' or '.join(few)}: left out of the mixture", stacklevel=2)
    if len(rates) < 2:
        shares = np.array([float(d in rates) for d in range(len(DOMAINS))])
        return Model(np.log(np.maximum(shares if shares.any() else np.ones(len(DOMAINS)), 1e-300)), np.empty(0, np.int64), np.zeros((0, len(DOMAINS))))
    share = F.lit(0.0)
    for label, part in rates.items():
        share = F.when(F.col("label") == label, part).otherwise(share)
    drawn = present.where(F.pmod(F.xxhash64("labelled_id"), F.lit(1_000_000)) < share * 1_000_000)  # about train_rows ids: small enough to broadcast

    def reduced(batches):
        for batch, texts in _sliced(batches):
            _, slots, starts = terms(texts)
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("place"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(slots.astype(np.int32)))], ["label", "place", "slots"])

    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled_id"))
    rows = cut(sample.select("label", F.xxhash64("doc_id", "text").alias("place"), F.col("text").alias("_text")).mapInArrow(reduced, "label int, place long, slots array<int>"), "train")
    def fit(batches):
        # The whole sample: train_rows lists of at most FEATURES slots.
        labels, examples = [], []
        for batch in batches:
            labels.append(batch.column("label").to_numpy())
            flat, ends = batch.column("slots").flatten().to_numpy(), np.cumsum([0, *batch.column("slots").value_lengths().to_pylist()])
            examples += [flat[a:b].copy() for a, b in zip(ends, ends[1:])]
        model = trained(examples, np.concatenate(labels))
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).ravel().tolist()]) for x in model], ["bias", "slots", "weights"])

    got = rows.repartition(1).sortWithinPartitions("place", "label").mapInArrow(fit, "bias array<double>, slots array<double>, weights array<double>").first()
    # Domains drawn at a lower rate are as much more frequent; those left out get no share.
    bias = np.array([b - np.log(rates[i]) if i in rates else -1e3 for i, b in enumerate(got["bias"])])
    weights = np.array(got["weights"]).reshape(-1, len(DOMAINS))
    weights[:, [i for i in range(len(DOMAINS)) if i not in rates]] = 0
    return Model(bias, np.array(got["slots"], np.int64), weights)


def posteriors(docs: DataFrame, model: Model, *keep) -> DataFrame:
    """``keep`` columns, ``_n`` (tokens) and ``p_<domain>`` of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES slots

    def run(batches):
        for batch, texts in _sliced(batches):
            n, slots, starts = terms(texts)
            p = softmax(scores(shared.value, slots, starts[:-1]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(n, pa.int64()), *[pa.array(p[:, d]) for d in range(len(DOMAINS))]], [*keep, "_n", *[f"p_{d}" for d in DOMAINS]])

    schema = docs.select(*keep).schema.add("_n", "long")
    for d in DOMAINS:
        schema = schema.add(f"p_{d}", "double")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def stepped(p: np.ndarray, steps: list[list[float]], most: float = np.inf) -> np.ndarray:
    """The rates after the steps; each step is projected on the bounds."""
    r = np.ones(len(p))
    for step in steps:
        r = np.clip(r - p @ np.array(step), 0.0, most)
    return r


def rate(steps: list[list[float]], most: float = np.inf):
    """The same as one expression."""
    r = F.lit(1.0)
    for step in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col(f"p_{d}") * F.lit(step[k]) for k, d in enumerate(DOMAINS)), F.lit(0.0)))
        r = F.least(F.lit(most), r) if np.isfinite(most) else r
    return r


def expected(rows: DataFrame, steps: list[list[float]], most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain after the steps, and what a move along the posteriors does to them: one pass."""
    k = len(DOMAINS)

    def run(batches):
        for batch in batches:
            p = np.stack([batch.column(f"p_{d}").to_numpy() for d in DOMAINS], 1)
            r, n = stepped(p, steps, most), batch.column("_n").to_numpy()
            moved = (p * (n * (r > 0))[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in [*((r * n) @ p), *moved.ravel()]], [f"x{i}" for i in range(k + k * k)])

    parts = rows.select("_n", *[f"p_{d}" for d in DOMAINS]).mapInArrow(run, ", ".join(f"x{i} double" for i in range(k + k * k)))
    sums = np.array([x or 0.0 for x in parts.agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(k + k * k)]).first()])
    return sums[:k], sums[k:].reshape(k, k)


def fit_rates(rows: DataFrame, targets: dict[str, float] | None = None, tokens: float | None = None, wanted: dict[str, float] | None = None, strict: bool = False, most: float = np.inf) -> Rates:
    """Gradient steps for the targets. ``rows`` (``_n`` and posteriors) is a written table; each step sums it once.

    ``targets`` are shares of ``tokens``, the wanted total (by default as many as there are); ``wanted`` are shares of
    what each domain has and take the place of both. No rate is over ``most``.
    """
    now, moved = start = expected(rows, [], most)
    if wanted is None:
        tokens = float(now.sum()) if tokens is None else tokens
        want = np.array([(TARGETS if targets is None else targets)[d] * tokens for d in DOMAINS])
    else:
        want = np.array([wanted[d] for d in DOMAINS]) * now
    live = start[0] > 0  # a domain that no document is in can't be sought
    scale = np.where(live, 1 / np.maximum(start[0], 1e-9), 0.0)
    reach = np.linalg.eigvalsh(np.sqrt(scale)[:, None] * start[1] * np.sqrt(scale))[-1] if live.any() else 0.0
    loss = lambda x: float((scale * (x - want) ** 2).sum())
    close = lambda x: np.all(np.abs(x - want)[live] <= CLOSE * np.maximum(np.maximum(want, want.sum() / 10), 1.0)[live])
    steps: list[list[float]] = []
    scaled = np.isinf(most)
    for _ in range(STEPS if reach > 0 else 0):
        if close(now):
            break
        step = np.zeros(len(want))
        if scaled and moved.any():
            part = moved[np.ix_(live, live)]
            step[live] = np.linalg.solve(part + 1e-6 * np.trace(part) * np.eye(live.sum()), (now - want)[live])
        else:
            step = scale * (now - want) / reach
        tried = [*steps, step.tolist()]
        then, then_moved = expected(rows, tried, most)
        if loss(then) < loss(now):
            small = loss(now) - loss(then) < 1e-4 * loss(now)
            steps, now, moved, was = tried, then, then_moved, scaled
            if small and not was:
                break
            scaled = np.isinf(most)
        elif scaled:
            scaled = False  # a plain step comes nearer
        else:
            break
    if strict and np.abs(now - want).max() > TOLERANCE * max(want.sum(), 1.0):
        raise ValueError(f"no rates found for the targets: wanted {dict(zip(DOMAINS, want))}, expected {dict(zip(DOMAINS, now))}")
    return Rates(steps, dict(zip(DOMAINS, want.tolist())), dict(zip(DOMAINS, now.tolist())))


def chance(col: str = "doc_id"):
    """A number of [0, 1) that belongs to an id."""
    return F.pmod(F.xxhash64(F.col(col), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, tokens: float | None = None, strict: bool = False) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>, rate, copies, wanted_<domain>, expected_<domain>``.

    ``copies`` is the rate's whole part, and one more by chance for the rest; wanted and expected tokens are of the whole
    mixture and the same in each row.
    """
    rows = cut(posteriors(docs, fitted(docs, labels), "doc_id"), "posteriors")
    found = fit_rates(rows, targets, tokens, strict=strict)
    totals = [F.lit(float(x[d])).alias(f"{name}_{d}") for name, x in (("wanted", found.wanted), ("expected", found.expected)) for d in DOMAINS]
    return rows.withColumn("rate", rate(found.steps)).select("doc_id", F.col("_n").alias("n_tokens"), *[f"p_{d}" for d in DOMAINS], "rate", F.floor(F.col("rate") + chance()).cast("long").alias("copies"), *totals)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a document stays with its rate, at most one, as chance, so ids stay unique.

    Where no feature tells domains apart (too few labels of any two), all documents stay.
    """
    model = fitted(docs, table(spark, sf_dir, "labels"))
    if not len(model.slots):
        return docs
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")
    rows = cut(posteriors(inner, model, "doc", "doc_id"), "posteriors")
    found = fit_rates(rows, wanted=WANTED, most=1.0)
    return rows.where(rate(found.steps, 1.0) + chance() >= 1).select("doc.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

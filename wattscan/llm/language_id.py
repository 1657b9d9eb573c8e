"""Language ID of mixed-language text.

The scripts of a word's letters narrow the candidates to the languages that training text wrote in that script. Each
word gets a score per candidate from hashed character n-grams, and Viterbi with a switching penalty labels the words, so
that spans of one language come out of mixed text. A document's language is the one with the most letters in its spans.

Counts come from a bounded, documented number of training documents; learning never sees ids, sources or other rows'
languages. Nulls: a null text, or one without letters, is ``und`` with a score of 0; null languages aren't learned from.
Ties go to the language that sorts first. Without any training rows every text is ``und``. Repeated rows are judged
alike. Very long texts are read whole, in blocks of words. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattscan.llm.common import crc_mod, cut, table

#: First code point of each script range and its script; a range ends where the next begins. Fixed values.
SCRIPTS = [(0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Other"), (0x750, "Arabic"), (0x780, "Other"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"), (0x32000, "Other")]
NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([at for at, _ in SCRIPTS])
_NUMBER = np.array([NAMES.index(name) for _, name in SCRIPTS])

BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
#: Training documents that counts are taken from, at most (about): all of small languages, an equal number of large ones.
TRAIN_ROWS = 20_000
#: Of each language so many are taken in any case, if it has them; with many languages the sum is over ``TRAIN_ROWS``.
LEAST_ROWS = 50
#: A language writes a script if that many of its letters in a thousand are of it.
LEAST_SHARE = 10
SWITCH = 12.0
#: A word's evidence is bounded, so that no single odd word turns a span.
MOST = 12.0
ROWS = 1000
#: Marks without a letter are no word.
WORDS = regex.compile(r"\p{M}*+\p{L}[\p{L}\p{M}]*+")


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word between boundary marks, and how many each word has."""
    text = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(text))  # characters from here to the word's end
    out, live = [], []
    hashed = np.zeros(len(text), np.uint32)
    for n in range(1, max(SIZES) + 1):
        hashed[: len(text) - n + 1] = hashed[: len(text) - n + 1] * np.uint32(16777619) + text[n - 1 :] + np.uint32(0x9E37)
        if n in SIZES:
            mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            out.append((mixed >> np.uint32(16)) % np.uint32(BUCKETS))
            live.append((left >= n) & ((n > 1) | ((text != 2) & (text != 3))))
    word = np.repeat(np.arange(len(words)), sizes)
    grams = np.concatenate([g[k] for g, k in zip(out, live)])
    of = np.concatenate([word[k] for k in live])
    order = np.argsort(of, kind="stable")
    return grams[order].astype(np.int64), np.bincount(of, minlength=len(words))


def scripts_of(words: list[str]) -> np.ndarray:
    """Letters of each script in each word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = _NUMBER[np.clip(np.searchsorted(_STARTS, points, "right") - 1, 0, None)]
    return np.bincount(np.repeat(np.arange(len(words)), sizes) * len(NAMES) + at, minlength=len(words) * len(NAMES)).reshape(-1, len(NAMES))


def _counted(batches):
    """Gram and script counts of a task's training rows: at most a row for each language and bucket."""
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            grams, scripts = np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)
            for at in range(0, len(rows), ROWS):
                words = [w for t in rows["text"].iloc[at : at + ROWS] for w in WORDS.findall(t.lower())]
                if words:
                    grams += np.bincount(grams_of(words)[0], minlength=BUCKETS)
                    scripts += scripts_of(words).sum(0)
            both = np.concatenate([grams, scripts])
            seen = np.flatnonzero(both)
            yield pd.DataFrame({"lang": lang, "feature": seen, "n": both[seen]})


class Model:
    """Log-probabilities of grams and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:, :BUCKETS].astype(float), counts[:, BUCKETS:]
        logp = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS))
        self.scores = (logp - logp.mean(0)).T.astype(np.float32).copy() if langs else np.zeros((BUCKETS, 0), np.float32)
        self.writes = scripts * 1000 >= LEAST_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Score per word and language; a language that doesn't write the word's script isn't a candidate."""
        grams, sizes = grams_of(words)
        # Overlapping grams repeat each other's evidence: their mean counts as two.
        sums = np.add.reduceat(self.scores[grams], np.r_[0, np.cumsum(sizes)[:-1]])
        found = np.clip(sums * (4.0 / len(SIZES)) / 2, -MOST, MOST)
        script = scripts_of(words).argmax(1)
        fits = self.writes[:, script].T
        return np.where(fits | ~fits.any(1, keepdims=True), found, -4 * MOST).astype(np.float32)

    def spans(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best language of each word of each document: Viterbi, all documents a word at a time."""
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        sizes = np.array([len(scores[i]) for i in order])
        k, longest = len(self.langs), int(sizes[0]) if len(sizes) else 0
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        flat = np.concatenate([scores[i] for i in order]) if longest else np.zeros((0, k), np.float32)
        came = np.zeros(flat.shape, np.int16 if k > 127 else np.int8)
        last = np.zeros((len(order), k), np.float32)
        active = np.searchsorted(-sizes, -np.arange(longest), "left")  # documents with a word at t
        every = np.arange(k)
        for t in range(longest):
            n = active[t]
            now = last[:n]
            best = now.argmax(1)
            switched = now[np.arange(n), best] - SWITCH
            stay = now >= switched[:, None]
            came[starts[:n] + t] = np.where(stay, every, best[:, None])
            last[:n] = np.maximum(now, switched[:, None]) + flat[starts[:n] + t]
            last[:n] -= last[:n].max(1, keepdims=True)
        out = np.zeros(len(flat), np.int64)
        state = last.argmax(1)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            out[starts[:n] + t] = state[:n]
            state[:n] = came[starts[:n] + t, state[:n]]
        found: list = [None] * len(order)
        for i, a, n in zip(order, starts, sizes):
            found[i] = out[a : a + n]
        return found

    def label(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Words, the language number of each, and the scores, for each text."""
        words = [WORDS.findall(t.lower()) for t in texts]
        number: dict[str, int] = {}
        ids = [np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in words]
        if not number or not self.langs:
            return [(ws, np.zeros(0, np.int64), np.zeros((0, len(self.langs)), np.float32)) for ws in words]
        scored = self.word_scores(list(number))
        scores = [scored[i] for i in ids]
        return list(zip(words, self.spans(scores), scores))

    def judge(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the share of its letters in spans of that language."""
        langs, shares = [], []
        for words, at, _ in self.label(texts):
            if not len(at):
                langs.append("und")
                shares.append(0.0)
                continue
            letters = np.bincount(at, weights=np.fromiter(map(len, words), np.float64, len(words)), minlength=len(self.langs))
            langs.append(self.langs[int(letters.argmax())])
            shares.append(float(letters.max() / letters.sum()))
        return langs, shares

    def span_list(self, text: str) -> list[tuple[str, int, int]]:
        """(language, first word, words) of each span of a text."""
        _, at, _ = self.label([text])[0]
        cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
        return [(self.langs[at[a]], int(a), int(b - a)) for a, b in zip(cuts, [*cuts[1:], len(at)])]


def quota(sizes: list[int], rows: int, least: int = LEAST_ROWS) -> int:
    """The most rows to take of each language, so that all take about ``rows`` together, but ``least`` at least."""
    left = max(rows, 0)
    for i, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if n > share:
            return max(share, least)
        left -= n
    return max([least, *sizes])


def fitted(training: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Count the training rows (``doc_id, text, lang``), about ``train_rows`` of them drawn by language and a hash of the id."""
    known = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != "und"))
    langs = [(r["lang"], r["count"]) for r in known.groupBy("lang").count().collect()]
    most, parts = quota([n for _, n in langs], train_rows), 1 << 40
    rates = known.sparkSession.createDataFrame([(x, min(parts, -(-parts * most // n))) for x, n in langs], "rate_lang string, rate long")
    drawn = known.join(F.broadcast(rates), F.col("lang") == F.col("rate_lang")).where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < F.col("rate"))
    counted = cut(drawn.select("text", "lang").mapInPandas(_counted, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")), "langs")
    names = sorted(x for x, _ in langs)
    number = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS + len(NAMES)), np.int64)
    for part in counted.toLocalIterator() if names else ():  # bounded by languages and buckets
        counts[number[part["lang"]], part["feature"]] = part["n"]
    return Model(names, counts)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                langs, shares = shared.value.judge([t or "" for t in some.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(langs, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("lang_pred", "string").add("score", "double"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return identified(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")

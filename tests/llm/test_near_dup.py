"""Near duplicates against brute force: the alignment, links, recall and components."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_native_ops import SMALL, odd_rows
from wattscan.llm import edits, near_dup
from wattscan.llm.common import table
from wattscan.llm.components import components


def docs_of(spark):
    return {r.doc_id: r.text for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_equals_brute_force():
    r = random.Random(2)
    for _ in range(600):
        a = [r.randrange(6) for _ in range(r.randrange(25))]
        b = list(a) if r.random() < 0.6 else [r.randrange(6) for _ in range(r.randrange(25))]
        for _ in range(r.randrange(5)):
            if b:
                b[r.randrange(len(b))] = r.randrange(6)
            if r.random() < 0.5:
                b.insert(r.randrange(len(b) + 1), r.randrange(6))
        distance, x, y = edit_distance(a, b), np.array(a, np.uint64), np.array(b, np.uint64)
        for limit in range(10):
            assert edits.within(x, y, limit) == (distance <= limit)


def test_near_classes_hold_all_similar_pairs(spark):
    docs = docs_of(spark)
    got = {r.doc_id: r.class_id for r in near_dup.op4_near_dup(spark, SMALL).collect()}
    words = {i: [w for w in re.split("[ \t-\r]+", t.lower()) if w] for i, t in docs.items()}
    runs = {i: set(zip(*[w[j:] for j in range(5)])) or {tuple(w)} for i, w in words.items()}
    hashed = {i: np.array([zlib.crc32(x.encode()) for x in w], np.uint64) for i, w in words.items()}
    linked = collections.defaultdict(set)
    for a in docs:
        for b in docs:
            if a < b:
                both = len(runs[a] & runs[b])
                # The alignment is held against brute force above.
                close = both and edits.within(hashed[a], hashed[b], int(0.2 * max(len(words[a]), len(words[b])) + 1e-9))
                if close:
                    linked[a].add(b), linked[b].add(a)
                if both / (len(runs[a]) + len(runs[b]) - both) >= 0.8:
                    assert got[a] == got[b]
    # No class joins texts without a chain of links.
    for i, c in got.items():
        seen, todo = {i}, [i]
        while todo:
            todo += [x for x in linked[todo.pop()] if x not in seen and not seen.add(x)]
        assert c in seen and c == min(x for x in got if got[x] == c)


def test_near_dup_families_and_odd_rows(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(w if r.random() > 0.03 else "edit" for w in base)) for i in range(60)] + [(100 + i, " ".join(f"v{r.randrange(10**6)}" for _ in range(80)) + " " + " ".join(base[:40])) for i in range(30)]
    got = {x.doc_id: x.class_id for x in near_dup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[100 + i] == 100 + i for i in range(30))
    odd = near_dup.near_classes(odd_rows(spark)).collect()
    assert len(odd) == 9 and {(x.doc_id, x.class_id) for x in odd if x.doc_id in (1, 2, 3, 4)} == {(1, 1), (2, 1), (3, 3), (4, 3)}
    assert all(x.kept and x.class_id is None for x in odd if x.doc_id is None)
    assert near_dup.near_classes(odd_rows(spark).limit(0)).count() == 0


def changed(r, words, share, spread=False):
    """Words with a share of them replaced; ``spread``: evenly, so that few runs outlive it."""
    n, out = len(words), list(words)
    k = int(share * n + 1e-9)
    for at in [int((i + 0.5) * n / k) for i in range(k)] if spread else r.sample(range(n), k):
        out[at] = f"v{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_near_dup_recall_up_to_the_edit_limit(spark, share):
    """Pairs with scattered edits share a class, whatever their length; texts of a pair have random words."""
    r = random.Random(9)
    rows, lengths, pairs = [], [10, 13, 20, 48, 100, 150, 151, 200, 300, 1000], 200
    for i in range(pairs):
        a = [f"w{r.randrange(10**6)}" for _ in range(lengths[i % len(lengths)])]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(changed(r, a, share)))]
    got = {x.doc_id: x.class_id for x in near_dup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == 2 * i for i in range(pairs))
    assert sum(got[2 * i + 1] == 2 * i for i in range(pairs)) >= (0.9 if share == 0.2 else 0.97) * pairs


@pytest.mark.parametrize("share, bucket", [(0.12, 8), (0.15, 32), (0.175, 32), (0.2, 32)])
def test_near_dup_recall_beside_a_shared_passage(spark, monkeypatch, share, bucket):
    """Texts that all hold one passage, half of each, meet in large buckets: near pairs among them are still found, others are not joined.

    Edits, as a share of the whole text, are all outside the passage. A tenth of the texts have only words that many others have.
    """
    assert near_dup.BUCKET == 32
    monkeypatch.setattr(near_dup, "BUCKET", bucket)
    r = random.Random(10)
    rows, pairs = [], 150
    passage = [f"p{i}" for i in range(150)]
    for i in range(pairs):
        n = r.choice([80, 150, 220])
        a = [f"w{r.randrange(300 if i % 10 == 0 else 10**6)}" for _ in range(n)]
        held = passage[:n]
        b = changed(r, a, share * (n + len(held)) / n)
        at = r.randrange(n)
        rows += [(2 * i, " ".join(a[:at] + held + a[at:])), (2 * i + 1, " ".join(b[:at] + held + b[at:]))]
    got = {x.doc_id: x.class_id for x in near_dup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == 2 * i for i in range(pairs))
    assert sum(got[2 * i + 1] == 2 * i for i in range(pairs)) >= (0.95 if share < 0.2 else 0.9) * pairs


@pytest.mark.parametrize("size", near_dup.PREFIX_RUNS)
def test_texts_within_the_limit_share_a_prefix(size):
    """Whatever the counts are and wherever the edits: a pair at the limit has a run in both prefixes."""
    r = random.Random(12)
    counts = np.array([r.randrange(4) for _ in range(near_dup.SLOTS)])
    for _ in range(400):
        a = np.array([r.randrange(30 if r.random() < 0.3 else 10**6) for _ in range(r.randrange(5, 90))], np.uint64)
        b = list(a)
        for _ in range(int(len(a) * 0.25)):
            kind, at = r.randrange(3), r.randrange(len(b))
            if kind == 0 and len(b) > 5:
                del b[at]
            elif kind == 1:
                b.insert(at, r.randrange(10**6))
            else:
                b[at] = r.randrange(10**6)
            now = np.array(b, np.uint64)
            if edits.within(a, now, int(0.2 * max(len(a), len(b)) + 1e-9)):
                assert np.intersect1d(near_dup.prefix(a, size, counts), near_dup.prefix(now, size, counts)).size


@pytest.mark.parametrize("bucket, share", [(32, 0.2), (4, 0.2)])
def test_no_pair_of_a_large_bucket_is_lost(spark, monkeypatch, bucket, share):
    """Texts of which half is one passage: all near pairs are found, also at the limit and where lists of words and runs are large too."""
    monkeypatch.setattr(near_dup, "BUCKET", bucket)
    r = random.Random(13)
    rows, pairs, passage = [], 150, [f"p{i}" for i in range(150)]
    for i in range(pairs):
        a = [f"w{r.randrange(8 if i % 2 else 10**6)}" for _ in range(150)]
        b = changed(r, a, 2 * share, i % 2 == 0)
        rows += [(2 * i, " ".join(a[:75] + passage + a[75:])), (2 * i + 1, " ".join(b[:75] + passage + b[75:]))]
    got = {x.doc_id: x.class_id for x in near_dup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(2 * pairs)}


def test_pairs_of_a_large_list_are_made_once(spark, monkeypatch):
    """Texts that share many words: each pair is made in one list, and no run that a single text holds is listed."""
    monkeypatch.setattr(near_dup, "BUCKET", 4)
    rows = [(i, " ".join([f"p{j}" for j in range(60)] + [f"w{i}x{j}" for j in range(8)])) for i in range(30)]
    texts = near_dup._words(spark.createDataFrame(rows, "doc_id long, text string")).select("id", F.size("words").alias("n"), "words")
    roots = spark.createDataFrame([], "id long, root long")
    *some, listed = near_dup._compared(texts, roots)
    for more in some:
        listed = listed.union(more)
    assert listed.groupBy("key").count().where("count < 2").isEmpty()
    assert listed.select("key").distinct().count() > 1
    got = near_dup._met(near_dup._open(near_dup._named(listed, roots))).collect()
    assert sorted((x.u, x.v) for x in got) == [(i, j) for i in range(30) for j in range(i + 1, 30)]


def test_variants_beyond_the_limit_are_no_pairs(spark, monkeypatch):
    """Variants of one text, all in large lists: pairs within the limit are made, and few of those beyond it."""
    monkeypatch.setattr(near_dup, "BUCKET", 4)
    r = random.Random(16)
    base, texts = [f"p{j}" for j in range(100)], {}
    for i in range(40):
        gone = set(r.sample(range(100), 12))
        texts[i] = [f"w{i}x{j}" if j in gone else w for j, w in enumerate(base)]
    docs = near_dup._words(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string"))
    roots = spark.createDataFrame([], "id long, root long")
    runs, words = near_dup._compared(docs.select("id", F.size("words").alias("n"), "words"), roots)
    opened = near_dup._open(near_dup._named(runs.union(words), roots))
    got = {(x.u, x.v) for x in near_dup._met(opened, near_dup._signed(docs)).collect()}
    differ = {(i, j): sum(x != y for x, y in zip(texts[i], texts[j])) for i in texts for j in texts if i < j}
    near = {p for p, d in differ.items() if d <= 20}
    assert near and near <= got
    assert len(got - near) < 0.1 * len(differ)


def test_parities_leave_out_no_pair_within_the_limit():
    """Whatever the counts are: the words that differ by parities are no more than those that do, repeated words and long texts included."""
    r = random.Random(17)
    for _ in range(200):
        some = r.choice([30, 10**6])
        a = [r.randrange(some) for _ in range(r.choice([5, 40, 300, 6000]))]
        b = [w if r.random() > 0.2 else r.randrange(some) for w in a if r.random() > 0.05]
        words = [np.array(x, np.uint64) for x in (a, b)]
        counts = np.ones(near_dup.SLOTS, np.int64)
        both = np.intersect1d(*(near_dup.labelled(near_dup.shingles(w, 1)) for w in words))
        counts[(both >> near_dup._SLOT).astype(np.int64)] = 2
        (own_a, odd_a), (own_b, odd_b) = (near_dup.parities(w, counts) for w in words)
        differ = len(a) + len(b) - 2 * sum((collections.Counter(a) & collections.Counter(b)).values())
        assert own_a + own_b + int(np.bitwise_count(odd_a ^ odd_b).sum()) <= differ


def test_no_pair_is_aligned_twice(spark, monkeypatch):
    """Texts that meet in buckets, splits, lists of runs and lists of words: what was compared once isn't compared again."""
    tried, linked = [], near_dup._linked
    monkeypatch.setattr(near_dup, "_linked", lambda pairs, docs: tried.extend((x.u, x.v) for x in pairs.collect()) or linked(pairs, docs))
    monkeypatch.setattr(near_dup, "BUCKET", 4)
    r = random.Random(15)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(passage + [f"w{r.randrange(30 if i % 2 else 10**6)}" for _ in range(30)])) for i in range(40)]
    near_dup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert tried and len(tried) == len(set(tried))


def test_near_dup_long_texts(spark):
    """A near pair of long texts is decided, and a long pair beyond the limit too."""
    r = random.Random(11)
    a = [f"w{r.randrange(20_000)}" for _ in range(60_000)]
    rows = [(1, " ".join(a)), (2, " ".join(changed(r, a, 0.15))), (3, " ".join(changed(r, a, 0.25)))]
    got = {x.doc_id: x.class_id for x in near_dup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_near_dup_text_ids_and_clashing_columns(spark):
    rows = [("7", "a b c d e f g h i j k l", 1, 2), ("8", "a b c d e f g h i j k m", 1, 2), ("x", "a b c d e f g h i j k l", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, u int, gone_id int")
    got = {x.doc_id: (x.class_id, x.kept) for x in near_dup.near_classes(docs).collect()}
    assert got == {"7": (7, True), "8": (7, False), "x": (None, True)}
    kept = near_dup.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == ["7", "x"]


def test_components(spark):
    """Chains, a ring and a hub come to their least ids; loops and repeated edges don't matter, and no edges give no rows."""
    edges = [(i, i + 1) for i in range(10, 40)] + [(50 + i, 50 + (i + 1) % 9) for i in range(9)] + [(100, 101 + i) for i in range(200)] + [(5, 5), (10, 11)]
    r = random.Random(3)
    r.shuffle(edges)
    got = {x.id: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 10 for i in range(11, 41)} | {i: 50 for i in range(51, 59)} | {i: 100 for i in range(101, 301)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

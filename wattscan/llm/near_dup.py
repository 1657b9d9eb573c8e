"""Near-duplicate classes by Order MinHash and banded alignment.

Of each text's runs of words, labelled by occurrence, a sketch takes the few least under its own hash and keeps them in
text order; two texts meet in a bucket when one sketch is the same. A pair is linked when the edit distance of its words
is at most a fifth of the longer text (similarity 0.8), which ``within`` decides exactly: by bounds where they suffice,
else by an alignment in the band that the limit allows.

Runs are of five words; texts of up to 150 words, in which few such runs would outlive a change of every fifth word, also
get sketches of single words (``TIERS``). Tiers overlap by more than a fifth, so a pair within the limit has one in
common. Texts under five words are only linked when equal.

Equal texts form one node first, so copies never meet in buckets. In each bucket the least id is compared with the others
(a star, no pairs among them). Where a bucket of over ``BUCKET`` members still holds several classes, it is large because
its texts share a passage or because it is a family with odd members. It is split by four times as many picks of the same
sketch, again and again, with a star in each part, until parts are small or all picks agree; the work stays in proportion
to its members. Splits only save work: the pairs of classes that they leave are found exactly, by prefix filters. Of a text
of n words, the rarest 2n/5 + 1 runs of two words (labelled by occurrence) hold one that any text within the limit has among
its own rarest, whatever the two share besides. Runs that no other text holds are not listed. Texts with a run in a list of
over ``BUCKET`` texts, or with one so common that it isn't listed, are also listed by their rarest n/5 + 1 single words. In
buckets and lists every pair of different classes is compared, also in those that are still large then; a pair that shares
several words is made once, in the first list of both, and no pair is aligned twice. Pairs that are over the limit by their
words alone, counted from parities of 128 bytes a text, are left out before words are fetched; that bound loses no link. In a
list that stays large the comparisons of parities, and the pairs within that bound, can still grow with the square of its texts. So every pair that met in a bucket is decided, and the sketches alone set the recall; tests hold it at 0.9 and
more up to the edit limit.

Nulls: a null text counts as empty; empty texts are equal, so they are one class. A row without an id, or whose id is no
whole number, is its own class (null) and stays. Rows repeating an id get the same class. Ties: a class is named by its
least id. Very long texts are sketched and aligned whole, in blocks of bounded memory. Extra columns are ignored by the
operator and kept by the stage. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattscan.llm.common import SPACE_CLASS, cut, table, text_of
from wattscan.llm.components import components
from wattscan.llm.edits import within

SIMILAR = 0.8
SKETCHES = 64
#: (least words, most words, words of a run, runs that a sketch picks); the most words of the last tier are unbounded.
TIERS = [(5, 12, 1, 3), (10, 150, 1, 5), (120, 1 << 62, 5, 2)]
SALTS = 16
#: Ids that are broadcast at most (16 bytes each); of more, the texts are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Open buckets with more members are split; in others each pair is compared.
BUCKET = 32
#: Words of the runs by which members of large open buckets are compared, one after the other while lists are large.
PREFIX_RUNS = (2, 1)
#: Slots of the counts that order runs by rarity (the order only has to be the same for all texts); a run is known to be in one text only where its slot is.
SLOTS = 1 << 22
_SLOT = np.uint64(64 - 22)
#: Runs in more than this share of the texts aren't listed where another kind of runs follows: their texts go on to it.
COMMON = 1 / 16
#: Lists of a text, the most common words first, in which a pair is known to have met before. More would only save more work.
MET = 64
#: Parities by which texts of large buckets are told apart before their words are fetched. More would leave fewer pairs.
PARITIES = 1024
_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ADD
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; a shorter text is one run."""
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for j in range(size):
        out = (out + words[j : len(words) - size + 1 + j]) * _MUL
    return _mixed(out)


def labelled(runs: np.ndarray) -> np.ndarray:
    """Runs with their occurrence number mixed in, so that a repeated run counts each time."""
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    if first.all():
        return _mixed(runs)
    at = np.arange(len(runs))
    number = np.empty(len(runs), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mixed(runs + number * _ADD)


def order_minhash(words: np.ndarray, sketches: int = SKETCHES, split: int = 0) -> np.ndarray:
    """Bucket keys of every tier that the text's length is in; each split makes the picks of a sketch fourfold."""
    keys = [_tier_keys(words, tier, size, picked << 2 * split, sketches) for tier, (least, most, size, picked) in enumerate(TIERS) if least <= len(words) <= most]
    return np.concatenate(keys) if keys else np.empty(0, np.int64)


def _least(values: np.ndarray, picked: int) -> np.ndarray:
    """Columns of the least values of each row, in column order."""
    if picked >= values.shape[1]:
        return np.broadcast_to(np.arange(values.shape[1]), (len(values), values.shape[1]))
    if picked > 2:
        return np.sort(np.argpartition(values, picked - 1, axis=1)[:, :picked], axis=1)
    rows, found = np.arange(len(values)), []
    for _ in range(picked):
        found.append(values.argmin(1))
        values[rows, found[-1]] = np.uint64(2**64 - 1)
    return np.sort(np.stack(found, 1), axis=1)


def _tier_keys(words: np.ndarray, tier: int, size: int, picked: int, sketches: int) -> np.ndarray:
    """One bucket key per sketch: the least labelled runs under its hash, in text order."""
    runs = labelled(shingles(words, size))
    seeds = _mixed(np.arange(1 + tier * sketches, 1 + (tier + 1) * sketches, dtype=np.uint64) * _MUL)
    out = np.empty(sketches, np.uint64)
    block = max(1, min(sketches, 500_000 // len(runs)))
    for i in range(0, sketches, block):
        at = _least((runs[None, :] ^ seeds[i : i + block, None]) * (seeds[i : i + block, None] | np.uint64(1)), picked)
        key = seeds[i : i + block].copy()
        for j in range(at.shape[1]):
            key = (key + runs[at[:, j]]) * _MUL
        out[i : i + block] = _mixed(key)
    return out.view(np.int64)


def _words(docs: DataFrame) -> DataFrame:
    """``id, words``: 64-bit hashes of the lower-cased words of whole texts."""
    words = F.array_remove(F.split(F.lower(text_of()), f"[{SPACE_CLASS}]+"), "")
    return docs.select(F.expr("try_cast(doc_id AS BIGINT)").alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"), F.md5(F.array_join(words, " ")).alias("same")).where("id IS NOT NULL")


def _lists(column: pa.ListArray, kind=np.uint64) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).view(kind)
    ends = column.offsets.to_numpy()
    return [values[x - ends[0] : y - ends[0]] for x, y in zip(ends[:-1], ends[1:])]


def _list_array(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(flat))


def _sketched(batches):
    for batch in batches:
        n = pa.array(np.diff(batch.column("words").offsets.to_numpy()).astype(np.int32))
        keys = _list_array([order_minhash(w) for w in _lists(batch.column("words"))])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("same"), n, keys], ["id", "same", "n", "keys"])


def _split(level: int):
    """From ``id, n, words, keys`` (of the split before) to the same with the keys of split ``level``."""

    def run(batches):
        for batch in batches:
            found = []
            for words, keys in zip(_lists(batch.column("words")), _lists(batch.column("keys"), np.int64)):
                found.append(order_minhash(words, split=level)[np.isin(order_minhash(words, split=level - 1), keys)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), _list_array(found)], ["id", "n", "keys"])

    return run


def prefix_size(n: int, size: int) -> int:
    """How many of its rarest runs a text of ``n`` words needs, so that it shares one with every text within the limit.

    An edit takes away ``size`` runs at most, so such texts share all runs of the longer one but ``size`` for each edit.
    """
    longer = np.arange(n, int(n / SIMILAR) + 2)
    return int((n - longer + size * np.floor((1 - SIMILAR) * longer + 1e-9)).max()) + 1


def prefix(words: np.ndarray, size: int, counts: np.ndarray) -> np.ndarray:
    """The rarest labelled runs of ``size`` words, in an order that is the same for all texts: by the count of a run's slot, then by hash."""
    runs = labelled(shingles(words, size))
    order = np.lexsort((runs, counts[(runs >> _SLOT).astype(np.int64)]))
    return runs[order[: prefix_size(len(words), size)]].view(np.int64)


def _counts(texts: DataFrame, size: int) -> np.ndarray:
    """In how many texts the runs of each slot are; the slots are of a fixed number, and those of one text stay at the driver's default."""

    def run(batches):
        for batch in batches:
            runs = [labelled(shingles(words, size)) >> _SLOT for words in _lists(batch.column("words"))]
            some, found = np.unique(np.concatenate([np.empty(0, np.uint64), *runs]).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found)], ["slot", "texts"])

    got = texts.select("words").mapInArrow(run, "slot int, texts long").groupBy("slot").agg(F.sum("texts").alias("texts")).where("texts > 1")
    got = got.select("slot", F.least("texts", F.lit(2**31 - 1)).cast("int").alias("texts")).toArrow()
    out = np.ones(SLOTS, np.int32)
    out[got.column("slot").to_numpy()] = got.column("texts").to_numpy()
    return out


def parities(words: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """How many labelled words only this text holds, by ``counts``, and of each of ``PARITIES`` parts of the others whether it holds an odd number.

    A word that one of two texts holds alone changes one part at most, so parts that differ are no more than such words.
    """
    runs = labelled(shingles(words, 1))
    others = runs[counts[(runs >> _SLOT).astype(np.int64)] > 1]
    odd = np.bincount((others % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return len(runs) - len(others), np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(texts: DataFrame) -> DataFrame:
    """``signed, own, odd``: the id and ``parities`` of each text (``id, words``); null where several rows have the id."""
    counts = texts.sparkSession.sparkContext.broadcast(_counts(texts, 1))  # SLOTS numbers

    def run(batches):
        for batch in batches:
            found = [parities(words, counts.value) for words in _lists(batch.column("words"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x for x, _ in found], pa.int32()), _list_array([x for _, x in found])], ["signed", "own", "odd"])

    found, one = texts.select("id", "words").mapInArrow(run, "signed long, own int, odd array<long>"), F.count(F.lit(1)) == 1
    return found.groupBy("signed").agg(F.when(one, F.first("own")).alias("own"), F.when(one, F.first("odd")).alias("odd"))


def _listed(texts: DataFrame, size: int, common: float) -> DataFrame:
    """``id, n, root, keys, more`` of each text (``id, n, root, words``): its prefix, the most common runs first.

    Runs that only this text holds are left out, and so are those in over ``common`` texts; ``more`` tells that there are such.
    """
    counts = texts.sparkSession.sparkContext.broadcast(_counts(texts, size))  # SLOTS numbers

    def run(batches):
        for batch in batches:
            keys, more = [], []
            for words in _lists(batch.column("words")):
                own = prefix(words, size, counts.value)[::-1]  # falling count, then falling hash: one order for all texts
                found = counts.value[(own.view(np.uint64) >> _SLOT).astype(np.int64)]
                keys.append(own[(found > 1) & (found <= common)])
                more.append(bool((found > common).any()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("root"), _list_array(keys), pa.array(more, pa.bool_())], ["id", "n", "root", "keys", "more"])

    return texts.select("id", "n", "root", "words").repartition("id").mapInArrow(run, "id long, n int, root long, keys array<long>, more boolean")


def _verified(batches):
    for batch in batches:
        found = [within(a, b, int(np.floor((1 - SIMILAR) * max(len(a), len(b)) + 1e-9))) for a, b in zip(_lists(batch.column("words_u")), _lists(batch.column("words_v")))]
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(found, pa.bool_())], ["u", "v", "linked"])


def _words_of(docs: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """``id, words`` of the texts with the written ``ids`` (one column); texts are only shuffled where ids aren't ``few``."""
    ids = ids.select(F.col(ids.columns[0]).alias("wanted"))
    ids = F.broadcast(ids) if few else ids
    return _words(docs.join(ids, F.expr("try_cast(doc_id AS BIGINT)") == F.col("wanted"), "left_semi")).drop("same")


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of written candidate pairs ``u, v``. A text that very many pairs share makes a skewed join, which is split as it runs."""
    few = pairs.count() <= BROADCAST_IDS
    of_v = _words_of(docs, pairs.select("v"), few).select(F.col("id").alias("v"), F.col("words").alias("words_v"))
    of_u = _words_of(docs, pairs.select("u"), few).select(F.col("id").alias("u"), F.col("words").alias("words_u"))
    checked = pairs.join(of_v, "v").join(of_u, "u").select("u", "v", "words_u", "words_v").mapInArrow(_verified, "u long, v long, linked boolean")
    return cut(checked.where("linked").select("u", "v"), "links")


def _stars(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of several members (``key, id, n``), and the candidate pairs of each one's least id with the others."""
    shared = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("least"), F.max("id").alias("last")).where("last > least.id")
    members = cut(members.join(shared, "key").select("key", "id", "n", F.col("least.id").alias("u"), F.col("least.n").alias("n_u")), "members")
    return members.drop("u", "n_u"), members.where((F.col("id") != F.col("u")) & _near()).select("u", F.col("id").alias("v")).distinct()


def _near():
    """Texts whose lengths differ by over a fifth of the longer are over that distance apart."""
    return F.least("n", "n_u") >= SIMILAR * F.greatest("n", "n_u") - 1e-9


def _alike():
    """Texts within the limit share all words of the longer one but one for each edit; of words told by parities, those that differ are counted."""
    longer = F.greatest("n", "n_u")
    most = F.least("n", "n_u") - longer + 2 * F.floor((1 - SIMILAR) * longer + 1e-9)
    differ = F.expr("own + own_u + aggregate(zip_with(odd, odd_u, (x, y) -> bit_count(x ^ y)), 0, (a, x) -> a + x)")
    return F.coalesce(differ <= most, F.lit(True))


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the ``root`` of their ``id``."""
    return rows.join(roots, "id", "left").select(*rows.columns, F.coalesce("root", "id").alias("root"))


def _shared(named: DataFrame) -> DataFrame:
    """``key, rows, top`` of buckets whose members are in several classes; ``top`` is the largest of these."""
    classes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    buckets = classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("rows").alias("rows"), F.max(F.struct("rows", "root")).alias("largest"))
    return buckets.where("classes > 1").select("key", "rows", F.col("largest.root").alias("top"))


def _open(named: DataFrame) -> DataFrame:
    """``key, id, n, root, rows, top`` of buckets whose members are in several classes."""
    return cut(named.join(_shared(named), "key"), "open")


def _compared(texts: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """``key, id, n, before`` of lists in which every pair of ``texts`` that is within the limit, and of two classes, is at least once.

    A pair is in a list of each kind of runs. Texts of large lists go on to the next kind; what is large in the last stays whole,
    and there ``before`` holds earlier lists of a text: of two texts that have one in common, the pair is made in that.
    """
    texts, found = cut(_named(texts.drop("keys"), roots), "texts"), []
    for size in PREFIX_RUNS[:-1]:
        prefixes = cut(_listed(texts, size, max(BUCKET, COMMON * texts.count())), "prefixes")
        listed = prefixes.select(F.explode("keys").alias("key"), "id", "n", "root")
        lists = cut(_shared(listed), "lists")
        listed = cut(listed.join(lists, "key").select("key", "id", "n", "rows"), "listed")
        found.append(listed.where(F.col("rows") <= BUCKET).select("key", "id", "n", _none()))
        on = listed.where(F.col("rows") > BUCKET).select("id").union(prefixes.where("more").select("id")).distinct()
        texts = cut(texts.join(on, "id", "left_semi"), "texts")
        if texts.isEmpty():
            return found
    prefixes = cut(_listed(texts, PREFIX_RUNS[-1], np.inf), "prefixes")
    listed = prefixes.select("id", "n", "root", F.slice("keys", 1, MET).alias("firsts"), F.posexplode("keys").alias("at", "key"))
    return [*found, cut(listed.join(cut(_shared(listed), "lists"), "key", "left_semi").select("key", "id", "n", F.expr(f"slice(firsts, 1, least(at, {MET}))").alias("before")), "listed")]


def _none():
    """No list before: the pairs of small buckets and lists are made in each of them."""
    return F.array().cast("array<long>").alias("before")


def _met(opened: DataFrame, signed: DataFrame | None = None) -> DataFrame:
    """``u, v`` of two classes that are in one of the ``opened`` buckets or lists, but for those over the limit by ``signed`` parities."""
    own, odd = F.lit(None).cast("int").alias("own"), F.lit(None).cast("array<long>").alias("odd")
    # Written, as both sides of the join below read it.
    opened = cut(opened.join(signed, F.col("id") == F.col("signed"), "left"), "met") if signed is not None else opened.select("*", own, odd)
    # Only members outside of a bucket's largest class are compared with the others.
    others = opened.where(F.col("root") != F.col("top")).select("key", F.col("id").alias("u"), F.col("root").alias("u_root"), *[F.col(c).alias(f"{c}_u") for c in ("n", "own", "odd", "before")])
    new = (F.col("root") != F.col("u_root")) & _near() & ((F.col("root") == F.col("top")) | (F.col("u") < F.col("id"))) & _alike() & ~F.arrays_overlap("before", "before_u")
    return opened.join(others, "key").where(new).select(F.least("u", "id").alias("u"), F.greatest("u", "id").alias("v"))


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, class_id, kept``; a class is named by its least id, and that document stays."""
    sketched = cut(_words(docs).mapInArrow(_sketched, "id long, same string, n int, keys array<long>"), "sketches")
    equal = sketched.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = sketched.join(equal, (sketched["same"] == equal["same"]) & (sketched["id"] == equal["rep"]), "left_semi")
    members, pairs = _stars(nodes.select("id", "n", F.explode("keys").alias("key")))
    tried = cut(pairs, "pairs")
    roots = components(_linked(tried, docs))
    small, level, signed = [], 0, None
    while True:
        opened = _open(_named(members, roots))
        small.append(opened.where(F.col("rows") <= BUCKET).select("key", "id", "n", _none()))
        large = opened.where(F.col("rows") > BUCKET)
        if large.isEmpty():
            break
        level += 1
        keys = cut(large.groupBy("id", "n").agg(F.collect_set("key").alias("keys")), "large")  # at most one a sketch
        texts = keys.join(_words_of(docs, keys.select("id"), keys.count() <= BROADCAST_IDS), "id")
        if level == 1:
            texts = crowded = cut(texts, "texts")
        split = texts.mapInArrow(_split(level), "id long, n int, keys array<long>")
        members, pairs = _stars(split.select("id", "n", F.explode("keys").alias("key")))
        pairs = cut(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        roots, tried = _joined(roots, _linked(pairs, docs)), tried.union(pairs)
    if level:
        small += _compared(crowded, roots)
        signed = cut(_signed(crowded), "signed")
    active = small[0]
    for more in small[1:]:
        active = active.union(more)
    pairs = _met(_open(_named(active, roots)), signed).distinct()  # buckets of at most BUCKET members, but for lists that stayed large
    pairs = cut(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")  # no pair is aligned twice
    roots = _joined(roots, _linked(pairs, docs))
    return _assembled(docs, sketched, equal, roots)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after more links: only the classes that the links join are looked at again."""
    if links.isEmpty():
        return roots
    root_of = lambda x: F.coalesce(F.col(f"root_{x}"), F.col(x))
    named = links
    for x in ("u", "v"):
        named = named.join(roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    merged = components(named.select(root_of("u").alias("u"), root_of("v").alias("v")))
    moved = roots.join(merged.select(F.col("id").alias("root"), F.col("root").alias("new")), "root", "left").select("id", F.coalesce("new", "root").alias("root"))
    return cut(moved.union(merged), "roots")


def _assembled(docs: DataFrame, sketched: DataFrame, equal: DataFrame, roots: DataFrame) -> DataFrame:
    """Every document's class; copies find their node by salted key."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    copied = equal.where("copies > 1").select("same", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    nodes = sketched.select("id", "same", salt.alias("salt")).distinct().join(copied, ["same", "salt"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    classes = nodes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root")).groupBy("id").agg(F.min("root").alias("class_id"))
    ids = docs.select(F.col("doc_id"), F.expr("try_cast(doc_id AS BIGINT)").alias("own_id"))
    return ids.join(classes, ids["own_id"] == classes["id"], "left").select("doc_id", "class_id", F.col("own_id").eqNullSafe(F.col("class_id")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one document goes on, the one with the least id."""
    gone = near_classes(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def op4_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))

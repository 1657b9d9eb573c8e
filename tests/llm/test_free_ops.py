"""The other operators against brute force, round trips and held-out accuracy."""

import collections
import html
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_native_ops import SMALL, odd_rows
from wattscan.llm import bpe, elias_fano, html_blocks, html_extract, language_id, lm_score, url_filter
from wattscan.llm.common import crc_mod, table



def docs_of(spark):
    return {r.doc_id: r.text for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}


# --- 9: BPE


def test_bpe_equals_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.WordBpe(bpe.vocabulary())
    r = random.Random(1)
    made = ["".join(r.choice(["a", "B", "'s", "'T", " ", "\n", "é", "Σ", "ß", "中", "<|endoftext|>", "<|", "!!", "İ", "\x1c", "​", "🙂", "٣", "word", "\x85"]) for _ in range(r.randrange(40))) for _ in range(1500)]
    for text in [*docs_of(spark).values(), *made, "a" * 500, "!#" * 300]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == ids
        assert mine.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_odd_rows(spark):
    rows = odd_rows(spark).withColumnRenamed("kept", "token_ids")
    got = bpe.stage(spark, rows, SMALL).collect()
    assert len(got) == 9 and {r.n_tokens for r in got if not (r.text or "").strip()} == {0}
    assert bpe.decoded(bpe.encoded(rows, keep=["doc_id"])).where("decoded = ''").count() == 4
    assert bpe.encoded(rows.limit(0)).count() == 0


# --- 8: language model


def test_elias_fano():
    rng = np.random.default_rng(0)
    for top in (1, 1000, 2**40, 2**64 - 1):
        for n in (0, 1, 10, 5000):
            values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            coded = elias_fano.EliasFano(elias_fano.encode(values))
            assert (coded.at(np.arange(n)) == values).all()
            asked = np.concatenate([rng.integers(0, top, 200, dtype=np.uint64, endpoint=True), values[:50]])
            at, found = coded.successor(asked)
            assert (at == np.searchsorted(values, asked)).all() and (found == np.isin(asked, values)).all()


@pytest.mark.parametrize("shard_rows", [2_000_000, 1500, 60])
def test_lm_equals_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(lm_score, "SHARD_ROWS", shard_rows)
    got = {r.doc_id: r for r in lm_score.op8_lm_score(spark, SMALL).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {i: [w for w in re.split("[ \t-\r]+", t.translate(lower)) if w] + [None] for i, t in docs_of(spark).items()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one = collections.Counter(w for t in train for w in t)
    tokens, base = sum(one.values()), 0.5 * (len(one) + 1)
    two = {k: n for k, n in collections.Counter(p for t in train for p in zip(["<s>", *t], t)).items() if n >= 2}
    three = {k: n for k, n in collections.Counter(p for t in train for p in zip(["<s>", *t], t, t[1:])).items() if n >= 2}
    total = one | {"<s>": len(train)}
    kept2, kept3 = collections.Counter(), collections.Counter()
    for k, n in two.items():
        kept2[k[0]] += n - 0.5
    for k, n in three.items():
        kept3[k[:2]] += n - 0.5

    def p1(w):
        return (one[w] + 0.5) / (tokens + base)

    def p2(v, w):
        return max(two.get((v, w), 0) - 0.5, 0) / total.get(v, 1) + (1 - kept2[v] / total.get(v, 1)) * p1(w)

    def p3(u, v, w):
        if (u, v) not in two:
            return p2(v, w)
        return max(three.get((u, v, w), 0) - 0.5, 0) / two[u, v] + max(1 - kept3[u, v] / two[u, v], 1e-16) * p2(v, w)

    for i, t in texts.items():
        r, seq = got[i], ["<s>", *t]
        score = math.log10(p2("<s>", t[0])) + sum(math.log10(p3(*seq[j - 2 : j + 1])) for j in range(2, len(seq)))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(one[w] > 0 for w in t), tokens, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10(p1(w)) for w in t), rel=1e-9)
        assert r.score == pytest.approx(score, abs=2.5e-4 * len(t))


def test_lm_hashes_equal_plain_words():
    """Words of the bytes of texts against plain splitting, in blocks of any size."""
    import pyarrow as pa

    texts = ["", " ", "A b\tC", "aé É z", "x" * 300, "a b a", "\x00\u00a0 ", "b", "ab", "a  b "]
    factors = [int(lm_score._factor(6 + i)) for i in range(2)]

    def hashed(word, i):
        return int(lm_score._mixed(np.array([sum((c + 1) * pow(factors[i], k + 1, 1 << 64) for k, c in enumerate(word)) % (1 << 64)], np.uint64))[0])

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [[w.encode() for w in re.split("[ \t-\r]+", t.translate(lower)) if w] + [b"\t"] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["_text"])
    for part in (batch, batch.slice(3, 5)):
        got = list(lm_score._texts([part], 3))
        of = want if part is batch else want[3:8]
        assert [n for x in got for n in x[3].tolist()] == [len(w) for w in of]
        for i in range(2):
            assert [h for x in got for h in x[1 + i].tolist()] == [hashed(w, i) for t in of for w in t]


def test_lm_hashes_are_the_same_at_any_place():
    """A word has one hash wherever it stands, also in a text that is longer than a block."""
    import pyarrow as pa

    texts = ["Ab c \xe9 " * 90000, "ab", "\xe9", " c"]
    assert len(texts[0].encode()) > lm_score.BYTES
    first, second, sizes = ([*x] for x in zip(*(y[1:] for y in lm_score._texts([pa.RecordBatch.from_arrays([pa.array(texts)], ["_text"])], 1))))
    first, second, sizes = np.concatenate(first), np.concatenate(second), np.concatenate(sizes)
    assert sizes.tolist() == [270001, 2, 2, 2]
    for i, got in enumerate((first, second)):
        factor = int(lm_score._factor(2 + i))
        want = [lm_score._mixed(np.array([sum((c + 1) * pow(factor, k + 1, 1 << 64) for k, c in enumerate(w)) % (1 << 64)], np.uint64))[0] for w in (b"ab", b"c", b"\xc3\xa9", b"\t")]
        assert (got[:270000].reshape(-1, 3) == want[:3]).all() and got[270000:].tolist() == [want[j] for j in (3, 0, 3, 2, 3, 1, 3)]


def test_lm_whole_keeps_what_occurs_once(spark):
    """The unpruned trie against brute force, with pairs and triples seen once."""
    r = random.Random(8)
    texts = {i: [f"w{r.randrange(12)}" for _ in range(r.randrange(1, 14))] for i in range(40)}
    train = [[*t, None] for i, t in texts.items() if i < 30]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {x.doc_id: x.score for x in lm_score.scored_texts(docs, lm_score.trained(docs.where("doc_id < 30"), 1)).collect()}
    one = collections.Counter(w for t in train for w in t)
    two = collections.Counter(p for t in train for p in zip(["<s>", *t], t))
    three = collections.Counter(p for t in train for p in zip(["<s>", *t], t, t[1:]))
    assert min(two.values()) == min(three.values()) == 1
    total = one | collections.Counter({"<s>": len(train)})
    types2, types3 = collections.Counter(k[0] for k in two), collections.Counter(k[:2] for k in three)

    def p1(w):
        return (one[w] + 0.5) / (sum(one.values()) + 0.5 * (len(one) + 1))

    def p2(v, w):
        return max(two[v, w] - 0.5, 0) / total[v] + (1 - (total[v] - 0.5 * types2[v]) / total[v]) * p1(w)

    def p3(u, v, w):
        return max(three[u, v, w] - 0.5, 0) / two[u, v] + 0.5 * types3[u, v] / two[u, v] * p2(v, w) if two[u, v] else p2(v, w)

    for i, t in texts.items():
        seq = ["<s>", *t, None]
        score = math.log10(p2(*seq[:2])) + sum(math.log10(p3(*seq[j - 2 : j + 1])) for j in range(2, len(seq)))
        assert got[i] == pytest.approx(score, abs=2.5e-4 * len(seq))


def test_lm_keys_are_a_row_for_each_part(monkeypatch):
    """Keys of a block are as many rows as parts, not one each, and the parts hold every count."""
    import pyarrow as pa
    import pyarrow.compute as pc

    r, items = random.Random(9), (1 << 32) + 15
    keys = [r.choice([0, 1, items, (1 << 64) - 1, r.randrange(1 << 64), r.randrange(5000)]) for _ in range(30000)]
    keys += [k for k in keys if r.random() < 0.5]
    blocks = [np.array(keys[a : a + 9000], np.uint64) for a in range(0, len(keys), 9000)]
    for row in (1 << 22, 700):
        monkeypatch.setattr(lm_score, "ROW", row)
        rows = [[*lm_score.dealt(block, 7)] for block in blocks]
        if row > 9000:
            assert all(len(x) == 1 and x[0].num_rows <= 7 for x in rows)
        table = pa.Table.from_batches([x for y in rows for x in y])
        for least in (1, 2):
            got = {}
            for part in range(7):
                some = table.filter(pc.equal(table["part"], part))
                found = lm_score.gathered(some, items, least).to_pylist()
                got |= {x["ctx"] * items + x["item"]: x["n"] for x in found}
                assert 0.5 * len(table) / 7 <= len(some) <= 2 * len(table) / 7
            assert got == {k: n for k, n in collections.Counter(keys).items() if n >= least}
    assert not [*lm_score.dealt(np.empty(0, np.uint64), 7)]


def test_lm_counts_in_parts_and_in_two_columns(spark, monkeypatch):
    """Many small parts, and keys too many for one number, give the same scores."""
    want = {r.doc_id: r.score for r in lm_score.op8_lm_score(spark, SMALL).collect()}
    for name, value in (("PART", 300), ("KEYS", 1)):
        monkeypatch.setattr(lm_score, name, value)
        assert {r.doc_id: r.score for r in lm_score.op8_lm_score(spark, SMALL).collect()} == want


def test_lm_odd_rows(spark):
    rows = odd_rows(spark)
    trie = lm_score.trained(rows.where(crc_mod("doc_id", 5) != 1))
    got = lm_score.scored_texts(rows, trie).collect()
    assert len(got) == 9 and all(r.n_tokens >= 1 and r.score <= 0 for r in got)
    empty = lm_score.trained(rows.limit(0))
    assert {r.score for r in lm_score.scored_texts(rows, empty).collect()} == {0.0}


# --- 3: languages


def test_languages_held_out(spark):
    truth = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").collect()}
    got = [r for r in language_id.op3_language_id(spark, "/root/testdata/sf0.01").collect()]
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_spans_and_odd_rows(spark):
    docs = table(spark, SMALL, "documents")
    model = language_id.fitted(docs)
    words = {r.lang: r.text.split() for r in docs.where("lang IN ('en', 'de')").collect() if len(r.text.split()) > 60 and "%" not in r.text and "|" not in r.text}
    spans = model.span_list(" ".join(words["en"][:30] + words["de"][:30]))
    assert [s[0] for s in spans] == ["en", "de"] and abs(spans[0][2] - 30) <= 2
    got = language_id.identified(odd_rows(spark), model).collect()
    assert len(got) == 9 and {r.lang_pred for r in got if r.doc_id in (1, 2, 8)} == {"und"}
    assert model.judge(["12 !?", "привет"])[0][0] == "und"
    assert model.judge(["\u0301\u0302 \u0300", "\u0301"]) == (["und", "und"], [0.0, 0.0])
    untrained = language_id.fitted(docs.limit(0))
    assert untrained.judge(["some text"]) == (["und"], [0.0])


def test_small_and_many_languages_are_learned(spark):
    """A language of few rows beside a large one is learned from them, and no language is left out."""
    r = random.Random(6)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(20))
    rows = [(i, text("abcdefg"), "large") for i in range(4000)] + [(5000 + i, text("tuvwxyz"), "small") for i in range(5)] + [(6000 + i, text("hijklm"), f"l{i}") for i in range(300)]
    model = language_id.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 40)
    assert len(model.langs) == 302 and model.writes[:, language_id.NAMES.index("Latin")].all()
    assert model.judge([text("tuvwxyz"), text("abcdefg")])[0] == ["small", "large"]
    assert language_id.quota([5, 10**7], 20_000) == 19_995 and language_id.quota([5, 6], 20_000) == 50 and language_id.quota([10**7] * 4, 20_000) == 5000


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(4)
    model = language_id.Model(["a", "b", "c"], np.ones((3, language_id.BUCKETS + len(language_id.NAMES)), np.int64))
    scores = [rng.normal(0, 6, (n, 3)).astype(np.float32) for n in (1, 5, 40, 3)]
    for s, at in zip(scores, model.spans(scores)):
        best = s[0].copy()
        for row in s[1:]:
            best = row + np.maximum(best, best.max() - language_id.SWITCH)
        mine = s[np.arange(len(s)), at].sum() - language_id.SWITCH * (np.diff(at) != 0).sum()
        assert mine == pytest.approx(best.max(), abs=1e-3)


# --- 7: URLs


def test_url_rules_and_verdicts(spark):
    pages = [(r.page_id, r.url) for r in table(spark, SMALL, "pages").collect()]
    extra = ["HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://a.example.com?x=/en/", "http://net/es/1", "http://notnet/es/1", "x.net/fr/1", None, "", "ftp://b.net/fr/#q", "http://spam-farm.example.org/en/1"]
    rows = pages + [(10_000 + i, u) for i, u in enumerate(extra)]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), url_filter.labelled_urls(spark)).collect()}
    for i, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(rule), rule, says) for rule, says in url_filter.RULES for h, _, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule, says = (max(fits)[1:]) if fits else (None, None)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (says is None or r.verdict == says)
    assert got[10_009].verdict == "block" and got[10_006].verdict == "allow"
    assert {r.verdict for r in got.values() if r.rule is None and r.host.startswith("th") and "farm" not in r.host} == {"allow"}


# --- 10: pages


def test_html_blocks_equal_the_articles(spark):
    rows = table(spark, SMALL, "pages").collect()
    got = {r.page_id: r for r in html_extract.op10_html_extract(spark, SMALL).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_html_held_out_layouts():
    weights, r = html_extract.trained(), random.Random(123)
    right = total = 0
    for _ in range(150):
        if page := html_extract.made_page(r):
            x, live = html_extract._padded([html_extract._vectors(page)], weights)
            chance = html_extract._labels(x, live, weights)[0][0]
            right += sum((c > 0.5) == bool(b[3]) for b, c in zip(page, chance))
            total += len(page)
    assert right >= 0.98 * total
    assert html_extract.main_texts(["", "<p", "plain", "<script>x"], weights)[0] == ""
    assert html_extract.main_texts(["<article><p>a&lt;b  c<br>d</article>"], weights) == ["a<b c d"]


def test_html_blocks_drop_no_text():
    texts = lambda page: [t for t, _, _ in html_blocks.blocks(page)]
    assert texts("<html><head><title>T</title><p>text") == ["text"] == texts("<head><meta charset=x><title>T</title>text") == texts("<head><title>T<body>text")
    assert texts("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["where x=2 holds"]
    for tag in ("noscript", "object", "button", "canvas", "audio", "video"):
        assert texts(f"<div><p>a <{tag}>b</{tag}> c</p></div><p>d") == ["a", "b", "c", "d"]
        assert [m[-1] for _, m, _ in html_blocks.blocks(f"<p>a <{tag}>b</{tag}> c</p>")] == ["p", tag, "p"]
        assert texts(f"<div>a<{tag}></div><p>b") == ["a", "b"]
    for tag in ("select", "iframe", "svg", "template", "textarea"):
        assert texts(f"<div>a<{tag}>x<div>y</div>z</div><p>b") == ["a", "b"] == texts(f"<div>a<{tag}>x</{tag}></div><p>b")
    marks = " ".join("u" * (i + 1) for i in range(12))
    assert ".comments" in html_blocks.blocks(f'<div class="{marks} comments">x</div>')[0][1]


def test_html_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (2, None, "<article>" + "<p>one two three.</p>" * 3000 + "</article>", 3)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extract.extracted(rows).collect()}
    assert got[None].text == got[1].text == "" and got[2].text.count("\n") == 2999
    assert html_extract.extracted(rows.limit(0)).count() == 0

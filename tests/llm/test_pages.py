"""Main text of pages written by hand, in layouts of other sites than the made-up ones."""

import numpy as np
import pytest

from wattscan.llm import html_blocks, html_extract

BRIDGE = ["The bridge was built in the year of the flood, and it has stood since then over the river.", "People cross it each morning on their way to the market, and again in the evening."]
PAGES = {
    "shop blog": (
        f"""<html><head><title>x</title></head><body><div id="top" class="site-header"><a href="/">Home</a> <a href="/about">About us</a></div>
        <ul class="menu"><li><a href="1">News</a></li><li><a href="2">Sport</a></li><li><a href="3">Weather</a></li></ul>
        <div class="content"><h1>The old bridge</h1><p>{BRIDGE[0]}</p><p>{BRIDGE[1]}</p><blockquote>It is the finest bridge in the county.</blockquote>
        <ul><li>It has four arches.</li><li>It carries no cars.</li></ul></div>
        <div class="sidebar"><h3>Related</h3><a href="x">Other bridges</a></div><div class="comments"><p>Great post!</p><p>I disagree.</p></div>
        <div class="cookie-notice">We use cookies. <button>Accept</button></div><div id="footer">Copyright 2024 <a href="p">Privacy</a></div></body></html>""",
        ["The old bridge", *BRIDGE, "It is the finest bridge in the county.", "It has four arches.", "It carries no cars."],
    ),
    "no body tag": (f"<html><head><title>T</title><p>{BRIDGE[0]}<p>{BRIDGE[1]}", BRIDGE),
    "formula": (f"<body><nav><a href=/>Start</a></nav><article><h1>On numbers</h1><p>Let <math><mi>x</mi></math> be five &amp; consider   its sum.</p><p>{BRIDGE[1]}</p></article><footer>Imprint</footer>", ["On numbers", "Let x be five & consider its sum.", BRIDGE[1]]),
    "wiki": (
        f"""<body><div class="navbar"><a href=1>Main page</a><a href=2>Contents</a><a href=3>Random</a></div><main><h1>Bridge</h1><p>{BRIDGE[0]}</p><h2>History</h2><p>{BRIDGE[1]}</p>
        <table><tr><td>Built</td><td>1789</td></tr></table></main><script>var a = "<p>no</p>"</script><div class="legal">Text is available under a licence.</div></body>""",
        ["Bridge", BRIDGE[0], "History", BRIDGE[1], "Built", "1789"],
    ),
    "news with adverts": (
        f"""<body><header><a href=/>The Daily</a></header><div class="advert">Buy one, get one free.</div><article><h1>Bridge reopens</h1><p>{BRIDGE[0]}</p><div class="promo"><p>Subscribe now!</p></div><p>{BRIDGE[1]}</p></article>
        <aside><h3>Most read</h3><ul><li><a href=1>Storm ahead</a></li><li><a href=2>Fair prices</a></li></ul></aside><section class="comments"><h3>2 comments</h3><div class=comment><p>About time, I say.</p></div></section><footer>All rights reserved.</footer></body>""",
        ["Bridge reopens", *BRIDGE],
    ),
    "only chrome": ("<body><nav><ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul></nav><form class=login><label>Name</label><input><label>Password</label></form><footer>&copy; 2020 Someone</footer></body>", []),
}


def test_pages_written_by_hand():
    got = {k: html_extract.main_texts([v[0]], html_extract.trained())[0].split("\n") for k, v in PAGES.items()}
    wrong = missed = total = 0
    for name, (_, want) in PAGES.items():
        total += len(want)
        missed += len([x for x in want if x not in got[name]])
        wrong += len([x for x in got[name] if x and x not in want])
    assert missed <= 0.08 * total and wrong <= 3, {k: (sorted(set(v[1]) - set(got[k])), sorted(set(got[k]) - set(v[1]))) for k, v in PAGES.items()}


def test_repeated_rows_and_extra_columns(spark):
    page = PAGES["formula"][0]
    rows = spark.createDataFrame([(1, "u", page, "x", 1), (1, "u", page, "x", 1), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extracted(rows)
    assert got.columns == ["page_id", "url", "text"] and sorted(r.text for r in got.collect())[0] == "" and len({r.text for r in got.collect()}) == 2


@pytest.mark.parametrize("html", ["<" * 20_000, "<p>" * 20_000, "<div>" * 5_000 + "x", "a " * 200_000, "&amp;" * 50_000, "<!--" + "x" * 50_000])
def test_odd_pages(html):
    assert isinstance(html_extract.main_texts([html], html_extract.trained())[0], str)


def test_a_page_alone_reads_as_among_others():
    """Padding and order of a batch don't change what a page gives."""
    pages = [v[0] for v in PAGES.values()]
    alone = [html_extract.main_texts([p], html_extract.trained())[0] for p in pages]
    assert html_extract.main_texts(pages, html_extract.trained()) == alone == html_extract.main_texts(pages[::-1], html_extract.trained())[::-1]


def plain_chances(page, p):
    """The two LSTMs and the labels of one page, block by block and without padding."""
    marks, words, counts = html_extract._vectors(page)
    size = html_extract.HIDDEN
    x = np.array([np.r_[p["marks"][m].mean(0), p["words"][w].mean(0), c] for m, w, c in zip(marks, words, counts)], float)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def read(rows, w, u, b):
        h = c = np.zeros(size)
        out = []
        for row in rows:
            z = row @ w + h @ u + b
            i, f, o, g = sigmoid(z[:size]), sigmoid(z[size : 2 * size]), sigmoid(z[2 * size : 3 * size]), np.tanh(z[3 * size :])
            c = f * c + i * g
            h = o * np.tanh(c)
            out.append(h)
        return np.array(out)

    both = np.c_[read(x, p["w1"], p["u1"], p["b1"]), read(x[::-1], p["w2"], p["u2"], p["b2"])[::-1]]
    return sigmoid(both @ p["v"] + p["v0"])


def test_labels_equal_a_plain_network():
    p = html_extract.trained()
    pages = [html_blocks.blocks(v[0]) for v in PAGES.values()]
    x, live = html_extract._padded([html_extract._vectors(page) for page in pages], p)
    chance = html_extract._labels(x, live, p)[0]
    for row, page in zip(chance, pages):
        assert np.allclose(row[: len(page)], plain_chances(page, p), atol=1e-4)


def test_gradients_equal_differences():
    """Of the loss by each kind of weight, against small steps of some of them."""
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) + rng.normal(0, 0.05, v.shape) for k, v in html_extract.trained().items()}
    pages = [html_blocks.blocks(v[0]) for v in list(PAGES.values())[:3]]
    known = [html_extract._vectors(page) for page in pages]
    want = None

    def loss(p):
        x, live = html_extract._padded(known, p)
        c = html_extract._labels(x, live, p)[0]
        return -((want * np.log(c) + (1 - want) * np.log(1 - c)) * live).sum()

    x, live = html_extract._padded(known, p)
    want = rng.integers(0, 2, live.shape).astype(float)
    kept = []
    chance, both, back = html_extract._labels(x, live, p, kept)
    d = (chance - want) * live
    size = html_extract.HIDDEN
    d_both = d[..., None] * p["v"]
    _, gw1, gu1, gb1 = html_extract._read_back(d_both[..., :size], x, p["w1"], p["u1"], kept)
    _, gw2, gu2, _ = html_extract._read_back(d_both[:, ::-1, size:], x[:, ::-1], p["w2"], p["u2"], back)
    grads = {"w1": gw1, "u1": gu1, "b1": gb1, "w2": gw2, "u2": gu2, "v": np.einsum("nt,nth->h", d, both)}
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            step = np.zeros_like(p[name])
            step[at] = 2e-3
            moved = (loss(p | {name: p[name] + step}) - loss(p | {name: p[name] - step})) / 4e-3
            assert moved == pytest.approx(g[at], rel=0.05, abs=0.02), name

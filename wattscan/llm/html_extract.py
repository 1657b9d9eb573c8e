"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks. Each block is a vector of its tag path, its hashed words and a few counts; a
bidirectional LSTM in numpy reads the sequence and labels every block as main text or not, knowing the whole page. It is
trained on made-up pages, whose layout and words come from rules with a fixed seed, and its weights (about 200 kB) are
broadcast.

Nulls: null html counts as empty and gives an empty text; null ids and URLs pass through. Repeated rows give repeated
results. Every block of any page is read, however long; a block whose chance is just a half (a tie) is left out. Extra columns are ignored by the query. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from functools import cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattscan.llm.common import table
from wattscan.llm.html_blocks import blocks

MARKS, WORDS, WIDE, HIDDEN = 512, 1024, 12, 16
COUNTS = 5
INPUT = 2 * WIDE + COUNTS
PAGES, ROUNDS, BATCH = 600, 260, 32
#: Blocks that are padded and read together, at most (a single longer page is read alone).
TOGETHER = 20_000

#: Layout words of the made-up pages: class or id, and what kind of block they hold.
ASIDE = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "topnav", "links"],
    "header": ["header", "masthead", "banner", "top", "branding"],
    "footer": ["footer", "bottom", "copyright", "legal", "colophon"],
    "sidebar": ["sidebar", "side", "widget", "related", "aside", "popular", "tags"],
    "ad": ["ad", "ads", "advert", "sponsor", "promo", "banner-ad", "adsense"],
    "notice": ["notice", "cookie", "consent", "alert", "gdpr", "popup", "newsletter", "subscribe"],
    "comments": ["comments", "comment", "replies", "discussion", "responses"],
    "form": ["form", "search", "login", "signup", "contact"],
}
MAIN = ["content", "post", "entry", "article", "main", "story", "body", "text", "page-content", "entry-content"]
PARTS = ["an", "be", "co", "de", "en", "er", "fo", "ga", "he", "in", "ka", "le", "mo", "na", "on", "pa", "re", "st", "th", "ti", "un", "ve", "wi", "zu", "é", "ü", "ñ", "ção"]


def _phrase(r: Random, few: int, many: int) -> str:
    words = ["".join(r.choice(PARTS) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", "", ",", "###"[: r.randint(0, 1)]]) for _ in range(r.randint(few, many))]
    return (" ".join(words)).capitalize() + r.choice([".", ".", ".", "", "!"])


def made_page(r: Random) -> list[tuple[str, list[str], int, int]]:
    """(text, marks, linked characters, 1 if main) of each block of a made-up page, read back from its html."""
    main, parts = "\x01", []

    def aside(kind: str) -> str:
        named = r.choice(ASIDE[kind])
        tag = r.choice({"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div"], "ad": ["div", "aside", "section"], "notice": ["div", "section"], "comments": ["section", "div", "ol"], "form": ["form", "div"]}[kind])
        named = "" if tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6 else f' {r.choice(["class", "class", "id"])}="{named}"'
        if kind in ("nav", "sidebar") and r.random() < 0.75 or tag in ("ul", "ol"):
            inner = "".join(f"<li><a href=#>{_phrase(r, 1, 4)}</a></li>" if kind != "comments" else f"<li><p>{_phrase(r, 3, 60)}</p></li>" for _ in range(r.randint(2, 8)))
            inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = "".join(f"<label>{_phrase(r, 1, 3)}</label><input>" for _ in range(r.randint(1, 4))) + f"<p>{_phrase(r, 2, 12)}</p>"
        elif kind == "comments":
            inner = f"<h3>{_phrase(r, 1, 3)}</h3>" + "".join(f"<div class=comment><p>{_phrase(r, 3, 60)}</p></div>" for _ in range(r.randint(1, 6)))
        elif kind == "footer":
            inner = "&copy; " + _phrase(r, 1, 25)
        else:
            inner = "".join(r.choice(["{}", "<p>{}</p>", "<h3>{}</h3>"]).format(_phrase(r, 1, 25)) for _ in range(r.randint(1, 3)))
        return f"<{tag}{named}>{inner}</{tag}>"

    def text(few=4, many=90) -> str:
        return main + _phrase(r, few, many)

    body = []
    for _ in range(r.randint(1, 14)):
        kind = r.random()
        if kind < 0.72:
            body.append(f"<p>{text(1, 90)}" + r.choice(["</p>", "</p>", ""]))
        elif kind < 0.8:
            body.append(f"<h{(n := r.randint(2, 4))}>{text(1, 8)}</h{n}>")
        elif kind < 0.87:
            body.append("<ul>" + "".join(f"<li>{text(1, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.92:
            body.append(f"<blockquote>{text()}</blockquote>")
        elif kind < 0.96:
            body.append(f"<p><b>{text(1, 12)}<br>")
        else:
            body.append(aside(r.choice(["ad", "form", "sidebar", "notice"])))
    if r.random() < 0.7:
        body.insert(0, f"<h1>{text(1, 12)}</h1>")
    shape = r.random()
    if shape < 0.55:
        body = ["<article>", *body, "</article>"]
    elif shape < 0.7:
        body = ["<main>", *body, "</main>"]
    elif shape > 0.9:  # paragraphs right in the body
        body = [*body]
    else:
        body = [f'<div {r.choice(["class", "id"])}="{r.choice(MAIN)}">', *body, "</div>"]
    if r.random() < 0.3:
        body = ["<div class=wrapper>", *body, "</div>"]
    for kind, chance in (("header", 0.5), ("nav", 0.8), ("notice", 0.25), ("form", 0.2), ("ad", 0.5), ("sidebar", 0.2)):
        if r.random() < chance:
            parts.append(aside(kind))
    parts += body
    for kind, chance in (("comments", 0.35), ("sidebar", 0.35), ("ad", 0.2), ("form", 0.2), ("footer", 0.85)):
        if r.random() < chance:
            parts.append(aside(kind))
    return [(t.replace(main, ""), marks, linked, int(main in t)) for t, marks, linked in blocks("<html><body>" + "".join(parts)) if t.replace(main, "")]


def _vectors(page) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Hashed marks, hashed words and counts of each block."""
    marks, words, counts = [], [], np.zeros((len(page), COUNTS), np.float32)
    for i, block in enumerate(page):
        text, path, linked = block[:3]
        marks.append([zlib.crc32(m.encode()) % MARKS for m in path] or [0])
        pieces = text.lower().split()
        words.append([zlib.crc32(w.encode()) % WORDS for w in pieces] or [0])
        counts[i] = np.log1p(len(pieces)) / 5, linked / max(len(text), 1), sum(text.count(c) for c in ".,;!?") / (len(pieces) + 1), i / len(page), text[0].isupper()
    return marks, words, counts


def _means(at: list[list[int]], vectors: np.ndarray) -> np.ndarray:
    """The mean vector of each list of rows."""
    sizes = np.array([len(x) for x in at])
    return np.add.reduceat(vectors[np.concatenate([np.asarray(x) for x in at])], np.r_[0, np.cumsum(sizes)[:-1]]) / sizes[:, None]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(x: np.ndarray, live: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, kept: list | None = None) -> np.ndarray:
    """One LSTM over (pages, blocks, inputs); padded blocks leave the state as it is."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, ahead = np.zeros((n, steps, HIDDEN), np.float32), x @ w + b
    for t in range(steps):
        gates = ahead[:, t] + h @ u
        s = _sigmoid(gates[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(gates[:, 3 * HIDDEN :])
        fresh = f * c + i * g
        squashed = np.tanh(fresh)
        on = live[:, t, None]
        if kept is not None:
            kept.append((h, c, i, f, o, g, squashed, on))
        h, c = on * (o * squashed) + (1 - on) * h, on * fresh + (1 - on) * c
        out[:, t] = h
    return out


def _read_back(d_out, x, w, u, kept):
    """Gradients of one LSTM: of its inputs, w, u and b."""
    d_gates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
    d_h, d_c, d_u = np.zeros_like(d_out[:, 0]), np.zeros_like(d_out[:, 0]), np.zeros_like(u)
    for t in range(x.shape[1] - 1, -1, -1):
        h, c, i, f, o, g, squashed, on = kept[t]
        d_h = d_h + d_out[:, t]
        d_new, d_cell = d_h * on, d_c * on + d_h * on * o * (1 - squashed**2)
        d_gates[:, t] = np.concatenate([d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), d_new * squashed * o * (1 - o), d_cell * i * (1 - g**2)], 1)
        d_u += h.T @ d_gates[:, t]
        d_h, d_c = d_h * (1 - on) + d_gates[:, t] @ u.T, d_c * (1 - on) + d_cell * f
    return d_gates @ w.T, np.einsum("nti,ntj->ij", x, d_gates), d_u, d_gates.sum((0, 1))


def _padded(pages, p):
    """Inputs (pages, blocks, INPUT), live blocks, and the live blocks' places."""
    sizes = [len(x[0]) for x in pages]
    live = (np.arange(max(sizes))[None] < np.array(sizes)[:, None]).astype(np.float32)
    rows = np.concatenate([_means([m for x in pages for m in x[0]], p["marks"]), _means([m for x in pages for m in x[1]], p["words"]), np.concatenate([x[2] for x in pages])], 1)
    x = np.zeros((*live.shape, INPUT), np.float32)
    x[live > 0] = rows
    return x, live


def _labels(x, live, p, kept=None):
    """Chance of main text for each block."""
    back = [] if kept is not None else None
    ahead = _read(x, live, p["w1"], p["u1"], p["b1"], kept)
    behind = _read(x[:, ::-1], live[:, ::-1], p["w2"], p["u2"], p["b2"], back)[:, ::-1]
    both = np.concatenate([ahead, behind], 2)
    return _sigmoid(both @ p["v"] + p["v0"]), both, back


@cache
def trained(seed: int = 7) -> dict:
    """Weights fitted by Adam on made-up pages; the same on every run."""
    r, rng = Random(seed), np.random.default_rng(seed)
    pages = [page for _ in range(PAGES) if (page := made_page(r))]
    known = [_vectors(page) for page in pages]
    truth = [np.array([x[3] for x in page], np.float32) for page in pages]
    shapes = {"marks": (MARKS, WIDE), "words": (WORDS, WIDE), "w1": (INPUT, 4 * HIDDEN), "u1": (HIDDEN, 4 * HIDDEN), "b1": (4 * HIDDEN,), "w2": (INPUT, 4 * HIDDEN), "u2": (HIDDEN, 4 * HIDDEN), "b2": (4 * HIDDEN,), "v": (2 * HIDDEN,), "v0": (1,)}
    p = {k: (rng.normal(0, 0.3 if k in ("marks", "words") else 0.2, s) if len(s) > 1 or k == "v" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, ROUNDS + 1):
        at = rng.choice(len(pages), BATCH, replace=False)
        some = [known[i] for i in at]
        x, live = _padded(some, p)
        kept: list = []
        chance, both, back = _labels(x, live, p, kept)
        want = np.zeros_like(live)
        want[live > 0] = np.concatenate([truth[i] for i in at])
        d = (chance - want) * live / live.sum()
        d_both = d[..., None] * p["v"]
        dx1, gw1, gu1, gb1 = _read_back(d_both[..., :HIDDEN], x, p["w1"], p["u1"], kept)
        dx2, gw2, gu2, gb2 = _read_back(d_both[:, ::-1, HIDDEN:], x[:, ::-1], p["w2"], p["u2"], back)
        dx = (dx1 + dx2[:, ::-1])[live > 0]
        grads = {"w1": gw1, "u1": gu1, "b1": gb1, "w2": gw2, "u2": gu2, "b2": gb2, "v": np.einsum("nt,nth->h", d, both), "v0": d.sum(keepdims=True).reshape(1)}
        for name, k, off in (("marks", 0, 0), ("words", 1, WIDE)):
            lists = [m for page in some for m in page[k]]
            sizes = np.array([len(m) for m in lists])
            grads[name] = np.zeros_like(p[name])
            np.add.at(grads[name], np.concatenate([np.asarray(m) for m in lists]), np.repeat(dx[:, off : off + WIDE] / sizes[:, None], sizes, 0))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = (p[k] - 0.02 * (1 - step / (ROUNDS + 60)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def main_texts(htmls: list[str], p: dict) -> list[str]:
    """The main text of each page."""
    pages = [blocks(h) for h in htmls]
    order = sorted((i for i, page in enumerate(pages) if page), key=lambda i: len(pages[i]))
    out = [""] * len(pages)
    while order:
        # Longest first: pages of like length share a padded array of bounded size.
        take = max(1, min(len(order), 256, TOGETHER // len(pages[order[-1]])))
        some, order = order[-take:], order[:-take]
        x, live = _padded([_vectors(pages[i]) for i in some], p)
        chance = _labels(x, live, p)[0]
        for row, i in enumerate(some):
            out[i] = "\n".join(block[0] for block, c in zip(pages[i], chance[row]) if c > 0.5)
    return out


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` of every page."""
    weights = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = main_texts([h or "" for h in some.column("html").to_pylist()], weights.value)
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = rows.drop("html").schema.add("text", "string")
    return rows.mapInArrow(run, schema)


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))

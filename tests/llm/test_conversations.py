"""Conversation repair against a plain search over all cheapest edits, and the query against plain code over its rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from wattscan.llm import conversation_repair as cr

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"


def plain_faults(rows):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Least (cost, audit) and the turns it gives, over every sequence of edits; states are what the grammar has read."""
    faults = plain_faults(rows)
    step = lambda state, letter: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, letter))
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def rest(i, state, inserts):
        """The best of what follows; at most three inserts in a row (more never pay)."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, edit, turn, then):
            if then is not None:
                found.append((cost + then[0], edit + then[1], ((turn,) if turn else ()) + then[2]))

        if inserts:
            for letter in "ua":
                if to := step(state, letter):
                    add(3, "I", (names[letter], ""), rest(i, to, inserts - 1))
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            add(4, "D", None, rest(i + 1, state, 3))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if to := step(state, role[:1]):
                    add(extra, "K", (role, text), rest(i + 1, to, 3))
                for letter in "ua":
                    if to := step(state, letter):
                        add(3 + extra, "R", (names[letter], text), rest(i + 1, to, 3))
        return min(found, default=None)

    return rest(0, "", 3)


def as_codes(rows):
    return [(ord(r[0]) if r[:1] in ("s", "u", "a") else 0) | {"": 0, "truncated": 256, "blank": 512, "duplicate": 512}[f] for (r, _), f in zip(rows, plain_faults(rows))]


def made(rnd, most):
    texts = ["Yes.", "No!", "cut", "", " \n", "Why? ", "well, ", "...", "é.", "end"]
    return [(rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "agent", " "]), rnd.choice(texts) if rnd.random() < 0.6 else f"{rnd.random()}.") for _ in range(rnd.randrange(most))]


def test_plan_is_the_cheapest_and_least():
    rnd = random.Random(5)
    for _ in range(4000):
        rows = made(rnd, 12)
        codes = as_codes(rows)
        cost, audit = cr.plan(codes)
        want = plain_repair(rows)
        assert (cost, audit) == want[:2], rows
        letters = cr.letters(audit, codes)
        assert "".join(letters) == "".join(t[0][:1] for t in want[2]) and re.fullmatch("(s?(ua)+)?", "".join(letters))


def test_plan_of_a_long_conversation():
    rnd = random.Random(6)
    rows = [(rnd.choice(["user", "assistant", "system"]), f"{i}{rnd.choice(['.', '.', ''])}") for i in range(150)]
    assert cr.plan(as_codes(rows)) == plain_repair(rows)[:2]
    many = [ord("u") | 256 * (i % 7 == 0) for i in range(50_000)]
    cost, audit = cr.plan(many)
    assert len(audit.replace("I", "")) == 50_000 and set(audit) <= set("DIKR") and cost == 3 * audit.count("I") + 3 * audit.count("R") + 4 * audit.count("D") + 3 * sum(e != "D" and bool(c & 256) for e, c in zip(audit.replace("I", ""), many))


def plain_query(conversations):
    """The contract over rows in plain code."""
    by_conv = {}
    for conv, turn, role, text in conversations:
        kept = by_conv.setdefault(conv, [])
        said = lambda x: " " if x is None else str(x)
        role, text = said(role), said(text)
        how = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        kept += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = []
    for conv, rows in by_conv.items():
        # Ties of turns: by role, then digest.
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        turns, faults = [r[0] for r in rows if r[0] is not None], plain_faults([r[1:] for r in rows])
        cost, audit, after = plain_repair([r[1:] for r in rows])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in after).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_equals_plain_code(spark):
    got = cr.op11_conversation_repair(spark, SF)
    assert got.columns == NAMES
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, got.collect()), key=str) == plain_query(map(tuple, rows))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_rows(spark, tmp_path, kind):
    rnd = random.Random(7)
    rows = []
    for conv in [None, *range(60)]:
        for turn, (role, text) in enumerate(made(rnd, 14)):
            turn = rnd.choice([turn, turn, turn, None, turn // 2])
            rows.append((conv, turn, rnd.choice([role, role, role, None, ""]), rnd.choice([text, text, None])))
    rows += [(1000, None, None, None), (1001, 5, "user", "é" * 100_000 + "."), (1001, 5, "user", "é" * 100_000 + "."), (1002, -3, "assistant", "a.")]
    want = [(None if r[0] is None or kind == "long" else str(r[0])) if kind == "string" else r[0] for r in rows]
    rows = [(c, *r[1:]) for c, r in zip(want, rows)]
    spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string").selectExpr("*", "1 AS audit", "2 AS digest", "3 AS cost").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, cr.op11_conversation_repair(spark, str(tmp_path)).collect()), key=str) == plain_query(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert cr.op11_conversation_repair(spark, str(tmp_path)).collect() == []


def test_repaired_turns(spark):
    rows = cr.rows_of(spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Why"), (2, 0, "system", "Be kind."), (2, 1, "user", "Hi."), (2, 2, "user", "Hi."), (2, 3, "assistant", "Yes.")], "conv_id long, turn long, role string, text string"))
    got = cr.repaired(rows, cr.plans(rows))
    by_conv = {r.conv_id: r for r in cr.plans(rows).collect()}
    assert (by_conv[1].cost, by_conv[1].audit, by_conv[1].truncated, by_conv[1].illegal) == (7, "IKD", 1, 0)
    assert (by_conv[2].cost, by_conv[2].audit, by_conv[2].duplicate, by_conv[2].illegal) == (4, "KKDK", 1, 1)
    assert [tuple(r) for r in got.orderBy("conv_id", "position").collect()] == [(1, 0, "user", "", "I"), (1, 1, "assistant", "Hello.", "K"), (2, 0, "system", "Be kind.", "K"), (2, 1, "user", "Hi.", "K"), (2, 2, "assistant", "Yes.", "K")]

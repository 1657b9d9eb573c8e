"""Repair of conversation structure at the least cost, by cost layers in bitsets.

A conversation's rows, in order, are edited until its role initials read ``(s?(ua)+)?``: a row is kept (0), given the role
user or assistant (3), or deleted (4); turns without text are inserted (3). Blank and repeated rows must be deleted, and a
truncated row that stays adds 3. For each row the grammar states that edits can reach are one bitset for each cost; the
layers of one row lie side by side in one integer, so an edit is a mask and a shift for all costs at once. The first
layer with an accepting state, after the last row, is the cost. A trace back through the bits leaves what lies on a
cheapest way, and a walk forward takes the least letter each time (D before I before K before R).

A row keeps ``LAYERS`` layers from its cheapest one on. No more can matter: from any state, inserts for at most 6 lead to
the state after an assistant turn or after a user turn, whichever is asked for, and what only the start would allow (a
system turn) can be deleted for 4.

Two streams: the first holds a few bytes for each row (sorted by Spark, no text) and gives one plan for each conversation;
the second brings the texts in the same order behind their plan and hands on the repaired turns. A task holds a batch of
rows and of one conversation its plan, a few bytes a turn, never its texts. One conversation is one task's work,
since its audit is one cell.

Nulls: null roles and texts count as one space, null turns come first; a null conversation id is a conversation of its
own. An empty text is blank. Very long texts are read whole. Ties of turns are ordered by role, then by a digest of the
text. A role without a first letter of the three can't be kept. Repeated rows are duplicates. Extra columns are
ignored. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattscan.llm.common import SPACE_CLASS, cut, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LAYERS = 11
ROLES = {"s": "system", "u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

#: Grammar states: nothing yet, after system, after user, after assistant. Bit ``4 * cost + state``.
_WIDTH = 4
_ALL = (1 << _WIDTH * LAYERS) - 1
_S0, _S1, _S2, _S3 = (sum(1 << _WIDTH * c + s for c in range(LAYERS)) for s in range(4))
_ACCEPT = _S0 | _S3


def forth(bits: int, letter: str) -> int:
    """The states after one more turn, in every layer."""
    if letter == "u":
        return (bits & _S0) << 2 | (bits & _S1) << 1 | (bits & _S3) >> 1
    if letter == "a":
        return (bits & _S2) << 1
    return (bits & _S0) << 1 if letter == "s" else 0


def back(bits: int, letter: str) -> int:
    """The states from which one more turn leads to any of ``bits``."""
    if letter == "u":
        x = bits & _S2
        return x >> 2 | x >> 1 | x << 1
    if letter == "a":
        return (bits & _S3) >> 1
    return (bits & _S1) >> 1 if letter == "s" else 0


def _later(bits: int, cost: int) -> int:
    return bits << _WIDTH * cost


def _sooner(bits: int, cost: int) -> int:
    return bits >> _WIDTH * cost


def _inserted(bits: int) -> int:
    """With all that inserts lead to."""
    while (more := (bits | _later(forth(bits, "u") | forth(bits, "a"), INSERT)) & _ALL) != bits:
        bits = more
    return bits


def _insertable(bits: int, reached: int) -> int:
    """With all reached states from which inserts lead to ``bits``."""
    while (more := (bits | _sooner(back(bits, "u") | back(bits, "a"), INSERT)) & reached) != bits:
        bits = more
    return bits


def _edits(code: int) -> tuple[str, int, bool]:
    """A row's letter, what it adds where it stays, and whether it may stay."""
    return chr(code & 127), TRUNCATED * bool(code & 256), not code & 512


def plan(codes) -> tuple[int, str]:
    """Cost and audit of a conversation, given for each row: its letter, 256 if truncated, 512 if it must go."""
    reached, shifts = array("Q", [_inserted(1)]), array("b")
    base = 0
    for code in codes:
        letter, extra, may_stay = _edits(code)
        now = reached[-1]
        after = _later(now, DELETE)
        if may_stay:
            after |= _later(forth(now, letter), extra) | _later(forth(now, "u") | forth(now, "a"), REROLE + extra)
        least = ((after & -after).bit_length() - 1) // _WIDTH
        reached.append(_inserted(_sooner(after, least) & _ALL))
        shifts.append(least)
        base += least
    done = reached[-1] & _ACCEPT
    first = ((done & -done).bit_length() - 1) // _WIDTH
    # Back through the bits: what is left of each row's lies on a way of the least cost.
    live = reached
    live[-1] = _insertable(done & _later((1 << _WIDTH) - 1, first), reached[-1])
    for i in range(len(shifts) - 1, -1, -1):
        letter, extra, may_stay = _edits(codes[i])
        after = _later(live[i + 1], shifts[i])
        before = _sooner(after, DELETE)
        if may_stay:
            dear = _sooner(after, REROLE + extra)
            before |= back(_sooner(after, extra), letter) | back(dear, "u") | back(dear, "a")
        live[i] = _insertable(before & reached[i], reached[i])
    return base + first, _least_audit(codes, live, shifts, first)


def _least_audit(codes, live, shifts, first: int) -> str:
    """The ASCII-least way through live states; ``at`` is the one bit of where it stands."""
    out, at, i = [], 1, 0
    while True:
        more = _later(forth(at, "u") | forth(at, "a"), INSERT)
        ended = i == len(codes)
        if ended and at & _later(_ACCEPT & 15, first):
            return "".join(out)
        letter, extra, may_stay = ("", 0, False) if ended else _edits(codes[i])
        ways = [] if ended else [("D", _later(at, DELETE))]
        ways.append(("I", more))
        if may_stay:
            ways += [("K", _later(forth(at, letter), extra)), ("R", _later(forth(at, "u") | forth(at, "a"), REROLE + extra))]
        for edit, to in ways:
            if edit == "I":
                good = to & live[i]
            else:
                good = _sooner(to, shifts[i]) & live[i + 1]
            if good:
                break
        out.append(edit)
        at = good
        i += edit != "I"


def letters(audit: str, codes) -> list[str]:
    """Role initials of the repaired turns, in order: only a system row that opens a conversation is kept as one."""
    out, rows = [], iter(codes)
    for edit in audit:
        code = next(rows) if edit != "I" else 0
        if edit == "D":
            continue
        out.append("s" if edit == "K" and chr(code & 127) == "s" else "u" if not out or out[-1] != "u" else "a")
    return out


def rows_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with nulls of role and text as one space."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return conversations.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))


def _digest() -> Column:
    """Of role and text together: equal for equal pairs only."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _code() -> Column:
    """A row's first letter, 256 if truncated, 512 if blank; letters beyond the three are 0."""
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin(*ROLES), F.ascii(initial)).otherwise(0)
    last = F.regexp_extract("text", rf"(?s)([^{SPACE_CLASS}])[{SPACE_CLASS}]*\z", 1)
    return (letter + F.when(last == "", 512).when(~last.isin(".", "!", "?"), 256).otherwise(0)).cast("int")


_PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, codes binary"


class _Conversation:
    """What the first stream gathers of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.seen = conv_id, array("H"), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.before = ""

    def add(self, turn, code: int, digest: bytes) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last, self.first = self.turns + 1, turn, turn if self.first is None else self.first
        letter = chr(code & 127)
        self.illegal += bool(self.codes) and self.before + letter not in LEGAL
        self.before = letter
        if code & 512:
            self.blank += 1
        elif digest in self.seen:
            self.duplicate += 1
            code = code & 127 | 512
        elif code & 256:
            self.truncated += 1
        self.seen.add(digest)
        self.codes.append(code)

    def row(self) -> list:
        cost, audit = plan(self.codes)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return [self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, self.codes.tobytes()]


def plans(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows_of``: counts of its faults, cost, audit, and its rows' codes."""
    narrow = rows.select("conv_id", "turn", "role", _digest().alias("digest"), _code().alias("code"))
    narrow = narrow.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest").drop("role")
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(_PLAN).fields])
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary()]

    def run(batches):
        open_, done = None, []
        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, turn, code, digest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code", "digest"))):
                if open_ is None or conv_id != open_.conv_id:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Conversation(conv_id)
                open_.add(turn, code, digest)
            if done:
                yield packed(done, [kind, *kinds], schema.names)
                done = []
        if open_ is not None:
            yield packed([open_.row()], [kind, *kinds], schema.names)

    return narrow.mapInArrow(run, schema)


def packed(rows: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)], names)


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, edit`` of the repaired turns, conversation by conversation and in order in each partition."""
    kind = rows.schema["conv_id"].dataType
    heads = planned.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), "audit", "codes", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("binary").alias("digest"))
    bodies = rows.select("conv_id", F.lit(1).alias("part"), "turn", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("binary").alias("codes"), "role", "text", _digest().alias("digest"))
    both = heads.union(bodies).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", F.asc_nulls_first("turn"), "role", "digest").drop("turn", "digest")
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())])

    def run(batches):
        audit, roles, at, position, conv_id = "", [], 0, 0, None

        def inserts(out):
            nonlocal at, position
            while at < len(audit) and audit[at] == "I":
                out.append([conv_id, position, ROLES[roles[position]], "", "I"])
                at, position = at + 1, position + 1

        for batch in batches:
            out = []
            for conv, part, said, codes, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "audit", "codes", "role", "text"))):
                if part == 0:
                    conv_id, audit, at, position = conv, said, 0, 0
                    roles = letters(said, array("H", codes))
                    inserts(out)
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    out.append([conv_id, position, role if edit == "K" else ROLES[roles[position]], text, edit])
                    position += 1
                inserts(out)  # those behind this row
            if out:
                yield packed(out, [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()], schema.names)

    return both.mapInArrow(run, schema)


def hashed(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``repaired`` turns: of ``role:text``, joined by line ends."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        conv_id, sha, kind = None, None, None
        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            for conv, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if sha is not None:
                        done.append([conv_id, sha.hexdigest()])
                    conv_id, sha = conv, hashlib.sha256()
                sha.update(f"{'' if position == 0 else chr(10)}{role}:{text}".encode())
            if done:
                yield packed(done, [kind, pa.string()], schema.names)
        if sha is not None:
            yield packed([[conv_id, sha.hexdigest()]], [kind, pa.string()], schema.names)

    return turns.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """``rows_of`` a table whose rows were damaged by a checksum of id and turn: dropped, emptied, cut, repeated or given the role user."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    rows = rows_of(conversations).withColumn("_how", F.pmod(F.crc32(key.cast("binary")), F.lit(20)))
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("_how <> 0").withColumns({"text": text, "role": F.when(F.col("_how") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_n", F.explode(F.when(F.col("_how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_how", "_n")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    planned = cut(plans(rows), "plans")
    hashes = hashed(repaired(rows, planned)).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select("conv_id").distinct()
    known = planned.drop("codes").withColumnRenamed("conv_id", "_id")
    found = ids.join(known, F.col("conv_id").eqNullSafe(F.col("_id")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

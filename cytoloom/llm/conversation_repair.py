"""Repair of conversations' structure: a forward Viterbi pass over four grammar states.

The roles of a sound conversation are an optional system turn and then user and assistant in turns, or nothing:
``(s?(ua)+)?`` in initials. The states are: nothing yet, after s, after u, after a; the first and the last accept.
A layer belongs to each turn. In it a turn is kept (0), given the role user or assistant (1) or deleted (2), and the
layer is closed by at most two insertions of empty turns (5 each), which is the longest way between two states. A
turn left in place though it is cut off adds 5; blank and repeated turns must be deleted. Each state carries its least
(cost, audit), the audit being the edits' initials, and ties go to the smaller string.

Costs follow from audits, so of two audits of one cost neither begins the other, and the least one stays least
whatever is appended. What is compared are ranks: without the insertions at their ends no audit of a layer begins
another, so their order never changes, and a new one needs its predecessor's rank and its own few letters only. Time is
linear in the turns, and a conversation's texts are never held together: each state carries a running SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Costs of the edits, and of a cut-off turn that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where each role may follow, and the state it leads to.
_MOVES = {"s": ((NOTHING, SYSTEM),), "u": ((NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
_CHUNK = 512
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and gone: rows damaged by a hash of conversation and turn (a null is one space).

    By crc32 mod 20: 0 drops the row (``gone``; it stays to name its conversation, without role and text), 1 empties
    its text, 2 takes its ``.!?``, 3 repeats it (``copy`` 1), 4 makes its role user. Other columns are left out.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("h") != 0, F.col("text"))
    role = F.when(F.col("h") == 4, "user").when(F.col("h") != 0, F.col("role"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("h") == 0).alias("gone"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`damage` with each row's first ``fault``: blank, duplicate (role and text seen earlier), truncated.

    One shuffle, by conversation; the window over equal rows keeps its partitions.
    """
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy"))
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(F.length(bare) == 0, BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return rows.repartition("conv_id").withColumn("seen", seen).select("conv_id", "turn", "role", "text", "copy", "gone", fault.alias("fault"))


class Viterbi:
    """The layers of one conversation; :meth:`turn` takes its rows in order."""

    def __init__(self) -> None:
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.initial = None
        # A state: cost, rank of the audit up to its last row, insertions behind, the audit's end, what is before, hash.
        self.state: list[tuple | None] = [(0, 0, "", "", None, hashlib.sha256()), None, None, None]

    def turn(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.turns += 1
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        if turn is not None:
            self.distinct += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        best: list[tuple | None] = [None] * 4

        def offer(source: int, to: int, letter: str, cost: int, name: str | None) -> None:
            s = self.state[source]
            if s is not None:
                key = (s[0] + cost, s[1], s[2] + letter)
                if best[to] is None or key < best[to][0]:
                    best[to] = (key, source, name, letter)

        for s in range(4):
            offer(s, s, "D", DELETE, None)
        if fault not in (BLANK, DUPLICATE):
            more = CUT_OFF if fault == TRUNCATED else 0
            for source, to in _MOVES.get(initial, ()):
                offer(source, to, "K", more, role)
            for name in ("user", "assistant"):
                for source, to in _MOVES[name[0]]:
                    offer(source, to, "R", more + REROLE, name)
        rank = {k: i for i, k in enumerate(sorted({b[0][1:] for b in best if b is not None}))}
        new: list[tuple | None] = [None] * 4
        raw, frozen = None, {}
        for to, b in enumerate(best):
            if b is not None:
                key, source, name, letter = b
                _, _, _, end, before, sha = self.state[source]
                if name is not None:
                    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
                    sha = _added(sha, source, name, raw)
                end += letter
                if len(end) >= _CHUNK:
                    before, end = frozen.setdefault((id(before), end), (before, end)), ""
                new[to] = (key[0], rank[key[1:]], "", end, before, sha)
        self.state = new
        self.close()

    def close(self) -> None:
        """Insert turns where that reaches a state at less: no way between two states has more than two."""
        for _ in range(2):
            now = list(self.state)
            for name in ("user", "assistant"):
                for source, to in _MOVES[name[0]]:
                    s = self.state[source]
                    if s is not None and (now[to] is None or (s[0] + INSERT, s[1], s[2] + "I") < now[to][:3]):
                        now[to] = (s[0] + INSERT, s[1], s[2] + "I", s[3] + "I", s[4], _added(s[5], source, name, b""))
            self.state = now

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and the repaired conversation's hash."""
        cost, _, _, end, before, sha = min((s for s in (self.state[NOTHING], self.state[ASSISTANT]) if s is not None), key=lambda s: s[:3])
        parts = [end]
        while before is not None:
            before, end = before
            parts.append(end)
        return cost, "".join(reversed(parts)), sha.hexdigest()

    def gaps(self) -> int:
        """Turn numbers that are missing between the first and the last, as 64-bit arithmetic has it."""
        found = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (found + (1 << 63)) % (1 << 64) - (1 << 63)


def _added(sha, source: int, name: str, raw: bytes):
    out = sha.copy()
    out.update((b"" if source == NOTHING else b"\n") + name.encode("utf-8", "surrogatepass") + b":" + raw)
    return out


def repair(rows: DataFrame) -> DataFrame:
    """Per conv_id of ``rows`` (as :func:`damage` gives them): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, ties by role, text and copy. A row can be kept only if its role begins with
    s, u or a; an empty role cannot. A null conv_id is a conversation like others, one whose rows are all gone has
    zeros, an empty audit and the hash of the empty text; an empty table gives no rows. Repeated rows count each.

    One shuffle. A task streams its conversations from a sort that spills and holds one row's text and four states,
    so a conversation of any length needs one task's time (its hash has to run over it in order) but not its memory; the
    audit, a byte per turn, is part of the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, any_row, v, out = None, False, Viterbi(), []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []

        for b in batches:
            kinds = [b.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                for conv, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if not any_row or conv != now:
                        if any_row:
                            out.append((now, v.gaps(), v.blank, v.duplicate, v.truncated, v.illegal, *v.result()))
                        now, any_row, v = conv, True, Viterbi()
                    if not gone:
                        v.turn(turn, role, text, fault)
                if len(out) >= 1024:
                    yield from flush()
        if any_row:
            out.append((now, v.gaps(), v.blank, v.duplicate, v.truncated, v.illegal, *v.result()))
            yield from flush()

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = faults(rows).sortWithinPartitions("conv_id", *_order()).select("conv_id", "turn", "role", "text", "gone", "fault")
    return ordered.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations' turns: conv_id, at (from 1), edit, role and text, from :func:`repair`'s audits.

    An inserted turn has an empty text. Conversations that nothing is left of have no turns.
    """
    w = Window.partitionBy("conv_id")
    letters = repaired.select("conv_id", F.posexplode(F.split(F.col("audit"), "")).alias("p", "edit")).where("edit <> ''")
    upto = w.orderBy("p")
    letters = letters.withColumn("n", F.when(F.col("edit") != "I", F.sum((F.col("edit") != "I").cast("int")).over(upto)))
    letters = letters.where("edit <> 'D'").withColumn("at", F.row_number().over(upto))
    own = rows.where("not gone").withColumn("n", F.row_number().over(w.orderBy(*_order()))).select(F.col("conv_id").alias("c"), F.col("n").alias("m"), "role", "text")
    both = letters.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("m")), "left")
    system = F.max(((F.col("at") == 1) & (F.col("edit") == "K") & F.col("role").startswith("s")).cast("int")).over(w)
    dealt = F.when((F.col("at") - system) % 2 == 1, "user").otherwise("assistant")
    return both.select("conv_id", "at", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(dealt).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _crc32(text: str) -> str:
    """DuckDB SQL for the checksum of a short ASCII string."""
    byte = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)), lambda a, b: {byte}))"


def oracle() -> str:
    """The same layers as a recursive query: a state is {k: cost and audit in one string, t: the repaired text}."""
    cost = lambda s: f"substr({s}.k, 1, 12)::BIGINT"

    def step(s: str, more: str, letter: str, role: str | None, text: str = "''", nothing: bool = False) -> str:
        added = f"{s}.t" if role is None else f"{'' if nothing else s + '.t || chr(10) || '}{role} || ':' || {text}"
        return f"CASE WHEN {s} IS NOT NULL THEN {{'k': lpad(({cost(s)} + {more})::VARCHAR, 12, '0') || substr({s}.k, 13) || '{letter}', 't': {added}}} END"

    def least(*parts: str) -> str:
        return f"list_min(list_filter([{', '.join(parts)}], lambda z: z IS NOT NULL))"

    def when(test: str, x: str) -> str:
        return f"CASE WHEN {test} THEN {x} END"

    cut = "(5 * (f = 3)::INT)"
    stays, starts = "f NOT IN (1, 2)", lambda c: f"f NOT IN (1, 2) AND substr(role, 1, 1) = '{c}'"
    names = ("n", "s", "u", "a")
    layer = {x: [step(x, "2", "D", None)] for x in names}
    layer["s"].append(when(starts("s"), step("n", cut, "K", "role", "txt", True)))
    for x in ("n", "s", "a"):
        layer["u"] += [when(starts("u"), step(x, cut, "K", "role", "txt", x == "n")), when(stays, step(x, f"1 + {cut}", "R", "'user'", "txt", x == "n"))]
    layer["a"] += [when(starts("a"), step("u", cut, "K", "role", "txt")), when(stays, step("u", f"1 + {cut}", "R", "'assistant'", "txt"))]
    moved = ", ".join(f"{least(*layer[x])} AS {x}" for x in names)
    closed = "n, s, " + least("u", *(step(x, "5", "I", "'user'", nothing=x == "n") for x in ("n", "s", "a"))) + " AS u, " + least("a", step("u", "5", "I", "'assistant'")) + " AS a"
    state = "STRUCT(k VARCHAR, t VARCHAR)"
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
bad AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE h <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(txt, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM bad),
r AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ord),
ids AS (SELECT DISTINCT conv_id FROM conversations),
v AS (
  SELECT conv_id, 0::BIGINT AS i, {{'k': '000000000000', 't': ''}}::{state} AS n, NULL::{state} AS s, NULL::{state} AS u, NULL::{state} AS a FROM ids
  UNION ALL
  SELECT conv_id, i, {closed} FROM (SELECT conv_id, i, {closed} FROM (SELECT v.conv_id, r.i, {moved} FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1))),
e AS (SELECT conv_id, {least("n", "a")} AS z FROM v WHERE i = (SELECT coalesce(max(r.i), 0) FROM r WHERE r.conv_id IS NOT DISTINCT FROM v.conv_id)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
  count(*) FILTER (i > 1 AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  {cost("z")} AS cost, substr(z.k, 13) AS audit, sha256(z.t) AS repaired_sha256
FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""

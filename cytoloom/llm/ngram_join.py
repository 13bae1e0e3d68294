"""Exact Jaccard self-join of documents on word shingles, by a token-group matrix.

1. Documents with equal shingle sets become one node (its smallest id).
2. Every token's frequency is found once, from packed arrays shuffled by token; equal sets of one batch of texts
   count once, and a batch sends each token once with its count, so a token that every document has makes one entry
   a batch. A document can have a partner only if ceil(t n) of its n tokens occur elsewhere; only such *active*
   nodes go on, with the tokens they share (others are in no intersection). With tokens ordered by frequency, two
   partners share one of the first n - ceil(t n) + 1 of the larger and of the first n - ceil(2 t n / (1 + t)) + 1 of
   the smaller. Texts are read twice and never shuffled, whatever the number of documents.
3. Active documents are partitioned into groups of similar ones (by the minimum hash of their shared tokens),
   at most ``GROUP`` in each. Links inside a group are settled by one matrix product.
4. A document is a query to another group when the token-group matrix has one of its prefix tokens in that
   group's row (from documents that may be the smaller partner) and they are not yet in one component. The group's token union bounds the overlap with any
   member; only groups whose bound reaches ceil(t n) are opened and compared member by member.
5. Components of all links.

No pair is emitted inside a group of copies, and no group, list or component reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, forget, mix, shingles_of, signed, slices, utf8_of, words_of, written
from .components import components

GROUP = 256
#: Tokens of one slice of the frequency table, of a bucket of groups and (twice as many) of a group: 8 bytes each.
SLICE = 1_000_000
KEYS = 3


def needed(n, num: int, den: int):
    """ceil(n num / den)."""
    return -(-n * num // den)


def linked(inter, a, b, num: int, den: int):
    return den * inter >= num * (a + b - inter)


def row_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every row, and where each row's begin."""
    h, before, _, _ = words_of(*utf8_of(column), SPACE_WORDS)
    x, r = shingles_of(h, before, k)
    order = np.argsort(x)
    if len(column) > 1:
        order = order[np.argsort(r[order].astype(np.uint16) if len(column) <= 1 << 16 else r[order], kind="stable")]
    x, r = x[order], r[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    return x[keep], np.searchsorted(r[keep], np.arange(len(column) + 1))


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Wrapping sum of each row."""
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]
    return total[at[1:]] - total[at[:-1]]


def _signs(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two sums of hashes of each row's set: equal for equal sets."""
    return np.diff(at), signed(_sums(mix(x), at)), signed(_sums(mix(x ^ np.uint64(0x5851F42D4C957F2D)), at))


def _signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            n, s1, s2 = _signs(*row_sets(b.column(1), k))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2)], ["i", "n", "s1", "s2"])

    return docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t")).mapInArrow(run, "i long, n long, s1 long, s2 long")


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, ``many`` each, one after the other."""
    total = np.r_[0, np.cumsum(many)]
    return np.repeat(start - total[:-1], many) + np.arange(total[-1])


PACKED = "slice long, batch long, a binary, b binary, c binary, d binary"
SHARED = "batch long, slice long, a binary, b binary, c binary, d binary"
ACTIVE = "node long, n long, family long, short int, keys array<long>, prefix array<long>, tokens binary"


def _active(docs: DataFrame, id_col: str, text_col: str, n_slices: int, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Documents that may have a partner, one of equal sets in a batch: ACTIVE, ``tokens`` being the 64-bit shared tokens, rarest first; and a table to forget.

    A batch sends its different tokens (48 bits) with their counts to slices of the token space, and the rows that
    have them past the slices to its own place, where the answers (a bit for each token sent, and of those that are
    shared the frequency and the token) meet them.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for b in slices(batches, "t", 4 << 20):
            x, at = row_sets(b.column(1), k)
            ids = b.column(0).to_numpy()
            n, s1, s2 = _signs(x, at)
            order = np.lexsort((ids, s2, s1, n))
            same = np.zeros(len(order), bool)
            same[1:] = (n[order][1:] == n[order][:-1]) & (s1[order][1:] == s1[order][:-1]) & (s2[order][1:] == s2[order][:-1])
            mine = n > 0
            mine[order[same]] = False
            place = np.cumsum(mine) - 1
            has = np.repeat(mine, n)
            row = np.repeat(place, n)[has].astype(np.uint16)
            x = x[has]
            order = np.argsort(x, kind="stable")
            x, row = x[order], row[order]
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
            many = np.diff(np.r_[first, len(x)]).astype("<u2")
            x = x[first]
            at_slice = ((x >> np.uint64(40)) * np.uint64(n_slices) >> np.uint64(24)).astype(np.int64)
            full, begin = np.unique(at_slice, return_index=True)
            ends = [*begin.tolist(), len(x)]
            low, mid = x.astype("<u4"), (x >> np.uint64(32)).astype("<u2")
            cut = lambda z: [z[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            cols = [
                pa.array([-1 - number % n_slices, *full.tolist()], pa.int64()),
                pa.array([number] * (len(full) + 1), pa.int64()),
                pa.array([np.concatenate([ids[mine], n[mine]]).astype("<i8").tobytes(), *cut(low)], pa.binary()),
                pa.array([many.tobytes(), *cut(mid)], pa.binary()),
                pa.array([np.stack([full, begin], 1).astype("<u8").tobytes(), *cut(many)], pa.binary()),
                pa.array([row.astype("<u2").tobytes(), *[b""] * len(full)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["slice", "batch", "a", "b", "c", "d"])
            number += 1

    def count(group: pa.Table) -> pa.Table:
        s = group.column("slice")[0].as_py()
        if s < 0:
            return group.select(["batch", "slice", "a", "b", "c", "d"])
        raw = [group.column(c).to_pylist() for c in ("a", "b", "c")]
        size = [len(x) // 4 for x in raw[0]]
        token = np.frombuffer(b"".join(raw[1]), "<u2").astype(np.uint64) << np.uint64(32) | np.frombuffer(b"".join(raw[0]), "<u4")
        many = np.frombuffer(b"".join(raw[2]), "<u2")
        del raw
        order = np.argsort(token)
        value = token[order]
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        times = np.add.reduceat(many[order].astype(np.int64), first)
        seen = np.empty(len(token), np.uint16)
        seen[order] = np.repeat(np.minimum(times, 65535).astype(np.uint16), np.diff(np.r_[first, len(value)]))
        del order, value, first, times
        out: list[tuple] = []
        at = 0
        for b, m in zip(group.column("batch").to_pylist(), size, strict=True):
            hit = np.flatnonzero(seen[at : at + m] > 1)
            if len(hit):
                x = token[at + hit]
                out.append((b, s, np.packbits(seen[at : at + m] > 1).tobytes(), seen[at + hit].astype("<u2").tobytes(), x.astype("<u4").tobytes(), (x >> np.uint64(32)).astype("<u2").tobytes()))
            at += m
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["batch", "slice", "a", "b", "c", "d"])

    def active(group: pa.Table) -> pa.Table:
        own: tuple = ()
        which, times, name = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint64)]
        answers = sorted(zip(*(group.column(c).to_pylist() for c in ("slice", "a", "b", "c", "d")), strict=True), key=lambda x: x[0])
        for x in answers:
            if x[0] < 0:  # the batch's own record comes first
                own = x[1:]
                begins = np.frombuffer(own[2], "<u8")
                continue
            at_slice = int(begins[2 * np.searchsorted(begins[::2], x[0]) + 1])
            which.append(at_slice + np.flatnonzero(np.unpackbits(np.frombuffer(x[1], np.uint8))))
            times.append(np.frombuffer(x[2], "<u2"))
            name.append(mix((np.frombuffer(x[4], "<u2").astype(np.uint64) << np.uint64(32) | np.frombuffer(x[3], "<u4")) + np.uint64((x[0] << 48) & (1 << 64) - 1)))
        which, times, name = (np.concatenate(y) for y in (which, times, name))
        ids, n = np.frombuffer(own[0], "<i8").reshape(2, -1)
        many, rows = np.frombuffer(own[1], "<u2"), np.frombuffer(own[3], "<u2")
        begin = (np.cumsum(many, dtype=np.int64) - many)[which]
        each = many[which].astype(np.int64)
        row = rows[_ranges(begin, each)]
        shared = np.bincount(row, minlength=len(ids))
        need = needed(n, num, den)
        good = (shared >= need) & (n > 0)
        mine = good[row]
        row, name, times = row[mine], np.repeat(name, each)[mine], np.repeat(times, each)[mine]
        order = np.lexsort((name, times, row))
        row, name = row[order], name[order]
        who = np.flatnonzero(good)
        cut = np.searchsorted(row, np.r_[who, len(ids)])
        place = np.arange(len(row)) - np.repeat(cut[:-1], np.diff(cut))
        prefix = name[place < (shared - need + 1)[row]]
        size = np.minimum((shared - need + 1)[who], np.diff(cut))
        least = lambda h: signed(np.minimum.reduceat(h, cut[:-1])) if len(who) else np.zeros(0, np.int64)
        keys = np.stack([least(mix(name ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) for seed in range(KEYS)], 1)
        lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x))
        short = np.maximum(shared - needed(2 * n, num, num + den) + 1, 0)
        return pa.table({
            "node": pa.array(ids[who], pa.int64()), "n": pa.array(n[who], pa.int64()), "family": pa.array(least(mix(name)), pa.int64()),
            "short": pa.array(short[who].astype(np.int32)), "keys": lists(np.arange(len(who) + 1) * KEYS, keys.reshape(-1)),
            "prefix": lists(np.r_[0, np.cumsum(size)], signed(prefix)),
            "tokens": pa.array([name[i:j].tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
        })

    rows = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t"))
    shared = written(rows.mapInArrow(emit, PACKED).groupBy("slice").applyInArrow(count, SHARED), "shared")
    return shared.groupBy("batch").applyInArrow(active, ACTIVE), shared


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by matrix products over blocks of the tokens that two or more have."""
    m = len(sets)
    value, inverse, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(many > 1, np.cumsum(many > 1) - 1, -1)[inverse]
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((m, m), np.float32)
    for start in range(0, int((many > 1).sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        block = np.zeros((m, 4096), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        out += block @ block.T
    return out.astype(np.int64)


def leaders(link: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node of each row's component."""
    now = nodes.copy()
    while True:
        new = np.where(link, now[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(now, new)
        if (new == now).all():
            return now
        now = new


def _groups(table: pa.Table, names: list[str]) -> dict:
    return table.select(names).to_pandas().groupby(names, sort=False).indices


def _within(num: int, den: int):
    def run(bucket: pa.Table) -> pa.Table:
        """Links of each (key, chunk) of the bucket, as (a, its leader)."""
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        nodes, sizes = bucket.column("node").to_numpy(), bucket.column("n").to_numpy()
        tokens = bucket.column("tokens")
        for at in _groups(bucket, ["key", "chunk"]).values():
            if len(at) < 2:
                continue
            node, n = nodes[at], sizes[at]
            shared = intersections([np.frombuffer(tokens[i].as_py(), "<u8") for i in at.tolist()])
            lead = leaders(linked(shared, n[:, None], n[None, :], num, den), node)
            a_out.append(node[lead != node])
            b_out.append(lead[lead != node])
        return pa.table({"a": np.concatenate(a_out), "b": np.concatenate(b_out)})

    return run


def _open(num: int, den: int):
    def run(asked: pa.Table, members: pa.Table) -> pa.Table:
        """Compare queries with the groups they may overlap; a group is opened only if its union's bound allows."""
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        names = ["family", "chunk", "salt"]
        inside = _groups(members, names)
        sets = lambda t, at: [np.frombuffer(t.column("tokens")[i].as_py(), "<u8") for i in at.tolist()]
        column = lambda t, c, at: t.column(c).to_numpy()[at]
        for group, ask in _groups(asked, names).items():
            at = inside.get(group)
            if at is None:
                continue
            own = sets(members, at)
            token, who = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
            order = np.argsort(token)
            token, who = token[order], who[order]
            node, n, comp = (column(members, c, at) for c in ("node", "n", "component"))
            for a, size, c, mine in zip(*(column(asked, x, ask).tolist() for x in ("node", "n", "component")), sets(asked, ask), strict=True):
                low = np.searchsorted(token, mine, "left")
                many = np.searchsorted(token, mine, "right") - low
                if (many > 0).sum() < needed(size, num, den):  # overlap with the union
                    continue
                shared = np.bincount(who[_ranges(low, many)], minlength=len(own))
                good = np.flatnonzero(linked(shared, size, n, num, den) & (comp != c) & (n <= size))
                good = good[np.unique(comp[good], return_index=True)[1]]
                a_out.append(np.full(len(good), a))
                b_out.append(node[good])
        return pa.table({"a": np.concatenate(a_out), "b": np.concatenate(b_out)})

    return run


def _chunks(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with _m, the rows of their key, and chunk: rows of one key are dealt by a hash of the node into parts of
    about GROUP rows and 2 SLICE tokens. Also the table of keys, which is written so that the join can split a hot one."""
    many = written(rows.groupBy(key).agg(F.count("*").alias("_m"), F.sum("size").alias("_t")), "keys")
    parts = F.ceil(F.greatest(F.col("_m") / F.lit(GROUP), F.col("_t") / F.lit(2 * SLICE)))
    return rows.join(many, key).withColumn("chunk", F.pmod(F.xxhash64("node", key), parts).cast("int")).drop("_t"), many


def _buckets(tokens: int | None) -> int:
    return max(8, -(-(tokens or 0) // SLICE))


def similar(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles and component_id, the smallest id reachable by links.

    Texts without words have no set and are linked with nothing. Rows with one id are one document whose sets are all
    linked through it, so they have one component, however they are partitioned; a row with a null id is in no component (null). Sets are compared by 64-bit hashes of shingles.
    """
    sig = written(_signatures(docs, id_col, text_col, k), "signatures")
    known = sig.where("i IS NOT NULL AND n > 0")
    node_of = known.groupBy("s1", "s2", "n").agg(F.min("i").alias("node"))
    total = known.agg(F.sum("n")).first()[0] or 0
    active, shared = _active(docs, id_col, text_col, max(4, -(-total // SLICE)), k, num, den)
    active = written(active.join(node_of.select("node").distinct().hint("shuffle_hash"), "node", "left_semi").withColumn("size", F.octet_length("tokens") / 8), "active")
    forget(shared)
    sets = active.select("node", "n", "tokens")

    # Links inside groups: three partitions by minimum hashes join most near copies.
    rows = active.select("node", "n", "size", "tokens", F.posexplode("keys").alias("r", "h"))
    rows = rows.withColumn("key", F.xxhash64("r", "h")).drop("h", "r")
    rows, keys = _chunks(rows, "key")
    rows = rows.where("_m > 1")
    buckets = _buckets(int(active.agg(F.sum("size")).first()[0] or 0) * KEYS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "chunk"), F.lit(buckets))).select("bucket", "key", "chunk", "node", "n", "tokens")
    inner = written(rows.groupBy("bucket").applyInArrow(_within(num, den), "a long, b long"), "links")
    comp = components(inner)
    label = active.drop("tokens", "keys").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label, families = _chunks(label, "family")
    label = written(label.drop("_m"), "labels")

    # Queries to other groups, by the prefix tokens that more than one component has.
    cells = label.select("node", "n", "component", "family", "chunk", "short", F.posexplode("prefix").alias("place", "token"))
    mixed = cells.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    cells = written(cells.join(mixed, "token"), "cells")
    matrix = cells.where("place < short").groupBy("token", "family", "chunk").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    ask = cells.select("token", "node", "n", "component").alias("q").join(matrix.alias("g"), "token")
    fits = (F.col("n_hi") * den >= F.col("q.n") * num) & (F.col("n_lo") <= F.col("q.n"))
    other = ~((F.col("g.lo") == F.col("q.component")) & (F.col("g.hi") == F.col("q.component")))
    ask = written(ask.where(fits & other).select("q.node", "q.component", "g.family", "g.chunk").distinct(), "queries")
    size = label.groupBy("node").agg(F.sum("size").alias("size"))
    per = ask.join(size, "node").groupBy("family", "chunk").agg(F.count("*").alias("m"), F.sum("size").alias("asked"))
    per = per.withColumn("salts", F.ceil(F.greatest(F.col("m") / 2000, F.col("asked") / F.lit(SLICE))).cast("int"))
    salted = written(per.join(label.groupBy("family", "chunk").agg(F.sum("size").alias("inside")), ["family", "chunk"]), "salts")
    buckets = _buckets(int(salted.agg(F.sum(F.col("asked") + F.col("inside") * F.col("salts"))).first()[0] or 0))
    per = salted.select("family", "chunk", "salts")
    b = F.pmod(F.xxhash64("family", "chunk", "salt"), F.lit(buckets))
    queries = ask.join(per, ["family", "chunk"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).join(sets, "node").withColumn("bucket", b)
    theirs, salts = sets.toDF(*sets.columns), per.toDF(*per.columns)  # new column ids: both sides of the cogroup have these tables
    members = label.select("node", "n", "component", "family", "chunk").join(salts, ["family", "chunk"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(theirs, ["node", "n"]).withColumn("bucket", b)
    columns = ["bucket", "node", "n", "component", "family", "chunk", "salt", "tokens"]
    outer = queries.select(columns).groupBy("bucket").cogroup(members.select(columns).groupBy("bucket")).applyInArrow(_open(num, den), "a long, b long")
    outer = written(outer, "links")

    # Ids of one class and sets of one id.
    edges = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(outer)
    sets_of = known.groupBy("i").agg(F.min(F.struct("s1", "s2", "n")).alias("lo"), F.max(F.struct("s1", "s2", "n")).alias("hi"))
    several = sets_of.where("lo <> hi").select("i")
    if not several.isEmpty():
        edges = edges.unionByName(known.join(several, "i").join(node_of, ["s1", "s2", "n"]).select(F.col("i").alias("a"), F.col("node").alias("b")))
    final = components(edges)
    forget(keys, families, inner, comp, active, label, cells, ask, salted, outer)
    final = node_of.join(final, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component"))
    rows = sig.where("n > 0").join(final, ["s1", "s2", "n"], "left").select("i", "n", "component")
    # A row without words is in the component of its id's other rows.
    bare = sig.where("n = 0").select("i", "n")
    mixed = known.join(bare.select("i").distinct(), "i", "left_semi")
    if mixed.isEmpty():
        others = bare.select("i", F.col("i").alias("component")).where("false")
    else:
        others = mixed.join(final, ["s1", "s2", "n"]).groupBy("i").agg(F.min("component").alias("component"))
    rows = rows.unionByName(bare.join(others, "i", "left").select("i", "n", "component"))
    return rows.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("i").isNotNull(), F.coalesce("component", "i")).alias("component_id"))

"""A positional inverted index of the corpus, and exact phrase and proximity search of benchmark items in it.

The index is partitioned by documents: a row is a block of documents with the sorted 64-bit hashes of its
terms and each term's positions in the block, so building it needs no shuffle and a query reads every block
once. Positions leave a gap between documents; no phrase spans two.

A phrase is searched from its rarest term in the block: its positions, moved by the term's place in the
phrase, are intersected with the moved lists of the other terms, rarer ones first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import ALNUM_WORDS, slices, utf8_of, words_of, written

#: Windows searched in one pass; more are searched in further passes over the index. 100,000 windows of ten terms take 8 MB.
PASS = 100_000
#: Places of rare terms that a proximity search looks at together.
PLACES = 1 << 18


def _block_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Words of each text, and first, terms, at and positions of a block of them (little-endian)."""
    h, before, _, _ = words_of(*utf8_of(texts), ALNUM_WORDS)
    n = np.diff(before)
    first = before[:-1] + np.arange(len(n))
    position = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
    order = np.argsort(h, kind="stable")
    terms, at = np.unique(h[order], return_index=True)
    return n, [x.astype(t).tobytes() for x, t in ((first, "<i8"), (terms, "<u8"), (np.r_[at, len(h)], "<u4"), (position[order], "<u4"))]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Blocks of about ``block_bytes`` of text: block, ids, n_words, first, terms, at, positions (little-endian arrays).

    Null and empty texts are documents without words. Written once to the shared folder.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in slices(batches, "t", block_bytes):
            n, parts = _block_of(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([b.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([n.tolist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in parts)],
                ["block", "ids", "n_words", "first", "terms", "at", "positions"],
            )
            number += 1

    rows = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    return written(rows.mapInArrow(run, f"block long, ids array<{kind}>, n_words array<long>, first binary, terms binary, at binary, positions binary"), "index")


def documents(index: DataFrame) -> DataFrame:
    """block, place, doc_id and n_words of every indexed document."""
    return index.select("block", F.posexplode(F.arrays_zip("ids", "n_words")).alias("place", "d")).select("block", "place", F.col("d.ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))


class Block:
    """One row of the index."""

    def __init__(self, first: bytes, terms: bytes, at: bytes, positions: bytes):
        self.first, self.terms = np.frombuffer(first, "<i8"), np.frombuffer(terms, "<u8")
        self.at, self.positions = np.frombuffer(at, "<u4"), np.frombuffer(positions, "<u4")

    def look(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each term's number here and its count (0: it does not occur)."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return k, np.where(self.terms[k] == terms, self.at[k + 1].astype(np.int64) - self.at[k], 0)

    def list(self, k: int) -> np.ndarray:
        return self.positions[self.at[k] : self.at[k + 1]].astype(np.int64)

    def place(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1


def _has(sorted_list: np.ndarray, values: np.ndarray) -> np.ndarray:
    k = np.minimum(np.searchsorted(sorted_list, values), len(sorted_list) - 1)
    return sorted_list[k] == values


def phrases(block: Block, windows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window number, start position) of every exact occurrence; rows of ``windows`` are padded beyond ``length``."""
    k, n = block.look(windows)
    inside = np.arange(windows.shape[1]) < length[:, None]
    alive = np.flatnonzero((n > 0).all(axis=1, where=inside))
    found, starts = [], []
    for w in alive.tolist():
        order = np.argsort(n[w, : length[w]], kind="stable").tolist()
        start = block.list(k[w, order[0]]) - order[0]
        for j in order[1:]:
            start = start[_has(block.list(k[w, j]), start + j)]
            if not len(start):
                break
        if len(start):
            found.append(np.full(len(start), w))
            starts.append(start)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(found), cat(starts)


def near(block: Block, windows: np.ndarray, length: np.ndarray, span: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, different terms) of every run of ``span`` words of one document that begins with a term of the
    window and holds ``least`` different ones of its terms (all, where it has fewer).

    Of n different terms such a run holds one of the n - least + 1 rarest, so runs are sought around those alone: a place of
    one is left as soon as too few of the other terms stand within a run's length of it, and frequent terms are looked up
    there and never read whole.
    """
    k, n = block.look(windows)
    first = np.arange(windows.shape[1]) < length[:, None]
    for j in range(windows.shape[1]):
        first[:, j] &= ~(windows[:, :j] == windows[:, j : j + 1]).any(axis=1)
    want = np.minimum(least, first.sum(axis=1))
    there = first & (n > 0)
    many = there.sum(axis=1)
    order = np.argsort(np.where(there, n, np.iinfo(np.int64).max), axis=1, kind="stable")
    k, n = np.take_along_axis(k, order, 1), np.take_along_axis(np.where(there, n, 0), order, 1)
    # Every position under its term's number: ascending, as terms are and positions within a term.
    keys = (np.repeat(np.arange(len(block.terms)), np.diff(block.at.astype(np.int64))) << 32) | block.positions
    ends = np.r_[block.first[1:] - 1, np.iinfo(np.int64).max]
    rare = np.where(np.arange(n.shape[1]) < np.maximum(1, many - want + 1)[:, None], n, 0)
    alive = np.flatnonzero((many >= want) & (many > 0))
    before = np.cumsum(rare[alive].sum(axis=1))
    found = [np.zeros((3, 0), np.int64)]
    low = 0
    while low < len(alive):
        high = max(low + 1, int(np.searchsorted(before, (before[low - 1] if low else 0) + PLACES, "right")))
        some, low = alive[low:high], high
        r = rare[some].reshape(-1)
        w = np.repeat(np.repeat(some, rare.shape[1]), r)
        p = block.positions[np.repeat(block.at[k[some].reshape(-1)].astype(np.int64), r) + _within(r)].astype(np.int64)
        got = np.zeros(len(p), np.int64)
        for j in range(k.shape[1]):
            place = block.place(p)
            from_ = np.maximum(p - span + 1, block.first[place])
            got += (n[w, j] > 0) & _between(keys, k[w, j], from_, np.minimum(p + span, ends[place]))
            keep = got + np.maximum(many[w] - j - 1, 0) >= want[w]
            w, p, got = w[keep], p[keep], got[keep]
        # Runs that may count begin with a term of the window at most a run's length before such a place.
        starts = []
        for a in range(0, len(p), PLACES // 16):
            v, q = w[a : a + PLACES // 16], p[a : a + PLACES // 16]
            from_, begin = np.maximum(q - span + 1, block.first[block.place(q)]), np.zeros(0, np.int64)
            for j in range(k.shape[1]):
                lo, hi = np.searchsorted(keys, (k[v, j] << 32) | from_), np.searchsorted(keys, (k[v, j] << 32) | q, "right")
                r = np.where(n[v, j] > 0, hi - lo, 0)
                begin = np.r_[begin, (np.repeat(v, r) << 32) | block.positions[np.repeat(lo, r) + _within(r)]]
            starts.append(np.unique(begin))
        starts = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
        w, p = starts >> 32, starts & 0xFFFFFFFF
        stop, count = np.minimum(p + span, ends[block.place(p)]), np.zeros(len(p), np.int64)
        for j in range(k.shape[1]):
            count += (n[w, j] > 0) & _between(keys, k[w, j], p, stop)
        good = count >= want[w]
        found.append(np.stack([w[good], p[good], count[good]]))
    return tuple(np.concatenate(found, axis=1))


def _within(many: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``many`` groups, one after the other."""
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def _between(keys: np.ndarray, term: np.ndarray, low: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether the term stands anywhere from ``low`` and before ``stop``."""
    at = np.searchsorted(keys, (term << 32) | low)
    return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] < ((term << 32) | stop))


def _windows(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different windows (padded rows of term hashes), their lengths, and (window, item) pairs."""
    h, before, _, _ = words_of(*utf8_of(pa.array(texts, pa.string())), ALNUM_WORDS)
    rows, items = [], []
    for i in range(len(texts)):
        w = h[before[i] : before[i + 1]]
        for a in range(max(1, len(w) - size + 1) if len(w) else 0):
            rows.append(w[a : a + size])
            items.append(i)
    length = np.array([len(x) for x in rows], np.int64)
    table = np.zeros((len(rows), size), np.uint64)
    for r, x in enumerate(rows):
        table[r, : len(x)] = x
    if not len(rows):
        return table, length, np.zeros((0, 2), np.int64)
    _, keep, inverse = np.unique(np.c_[table, length.astype(np.uint64)], axis=0, return_index=True, return_inverse=True)
    pairs = np.unique(np.c_[inverse.reshape(-1), np.array(items)], axis=0)
    return table[keep], length[keep], pairs


def _passes(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple]]:
    """Items in portions whose windows number about PASS at most; one portion is on the driver at a time."""
    held: list[tuple] = []
    n = 0
    for r in items.select(items[id_col].cast("string").alias("i"), items[text_col].alias("t")).toLocalIterator():
        many = (len(r["t"] or "") + 1) // 2
        if held and n + many > 4 * PASS:
            yield held
            held, n = [], 0
        held.append((r["i"], r["t"]))
        n += many
    if held:
        yield held


def matches(index: DataFrame, items: DataFrame, size: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """block, place, item (as text), start, stop: the longest runs of words covered by an item's windows.

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null items texts have no window; an item without an id still matches, with a null item.
    """
    spark = index.sparkSession
    schema = "block long, place int, item string, start long, stop long"
    out = spark.createDataFrame([], schema)
    for portion in _passes(items, item_col, text_col, size):
        ids = [i for i, _ in portion]
        data = spark.sparkContext.broadcast((ids, *_windows([t for _, t in portion], size)))
        out = out.unionByName(index.select("block", "first", "terms", "at", "positions").mapInArrow(_search(data), schema))
    return out


def _search(data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, windows, length, pairs = data.value
        starts_of = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
        for b in batches:
            for row in range(b.num_rows):
                number = b.column(0)[row].as_py()
                block = Block(*(c[row].as_py() for c in b.columns[1:]))
                w, start = phrases(block, windows, length)
                if not len(w):
                    continue
                many = starts_of[w + 1] - starts_of[w]
                at = np.repeat(np.arange(len(w)), many)
                item = pairs[np.repeat(starts_of[w] - (np.cumsum(many) - many), many) + np.arange(len(at)), 1]
                s, e = start[at], start[at] + length[w[at]]
                place = block.place(s)
                order = np.lexsort((s, item, place))
                place, item, s, e = place[order], item[order], s[order], e[order]
                group = np.cumsum(np.r_[False, (place[1:] != place[:-1]) | (item[1:] != item[:-1])])
                reach = np.maximum.accumulate(e + group * (1 << 40)) - group * (1 << 40)  # of all before, in the group
                head = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (s[1:] > reach[:-1])])
                stop = reach[np.r_[head[1:], len(s)] - 1]
                base = block.first[place[head]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(head), pa.int64()), pa.array(place[head].astype(np.int32)), pa.array([ids[i] for i in item[head].tolist()], pa.string()), pa.array(s[head] - base), pa.array(stop - base)],
                    ["block", "place", "item", "start", "stop"],
                )

    return run


def proximity(index: DataFrame, items: DataFrame, size: int = 10, span: int = 20, least: int = 8, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """block, place, item, position, n_terms: runs of ``span`` words that begin with a term of one of the item's windows and
    hold ``least`` different terms of it, in any order; n_terms is the most of any window. No block decides: the rows are
    the same however the documents are dealt to blocks."""
    spark = index.sparkSession
    schema = "block long, place int, item string, position long, n_terms long"
    out = spark.createDataFrame([], schema)
    for portion in _passes(items, item_col, text_col, size):
        data = spark.sparkContext.broadcast(([i for i, _ in portion], *_windows([t for _, t in portion], size)))

        def run(batches: Iterator[pa.RecordBatch], data=data) -> Iterator[pa.RecordBatch]:
            ids, windows, length, pairs = data.value
            starts_of = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
            for b in batches:
                for row in range(b.num_rows):
                    block = Block(*(c[row].as_py() for c in b.columns[1:]))
                    w, p, n = near(block, windows, length, span, least)
                    each = starts_of[w + 1] - starts_of[w]
                    at = np.repeat(np.arange(len(w)), each)
                    item = pairs[np.repeat(starts_of[w] - (np.cumsum(each) - each), each) + np.arange(len(at)), 1]
                    p, n = p[at], n[at]
                    order = np.lexsort((-n, p, item))
                    item, p, n = item[order], p[order], n[order]
                    head = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (p[1:] != p[:-1])]) if len(p) else np.zeros(0, np.int64)
                    place = block.place(p[head])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column(0)[row].as_py()] * len(head), pa.int64()), pa.array(place.astype(np.int32)), pa.array([ids[i] for i in item[head].tolist()], pa.string()), pa.array(p[head] - block.first[place]), pa.array(n[head])],
                        ["block", "place", "item", "position", "n_terms"],
                    )

        out = out.unionByName(index.select("block", "first", "terms", "at", "positions").mapInArrow(run, schema))
    return out


def near_passages(docs: DataFrame, benchmark: DataFrame, size: int = 10, span: int = 20, least: int = 8, id_col: str = "doc_id") -> DataFrame:
    """Per document and item with a proximity match: id, item_id (as text), n_places and n_terms, the most terms of a run.

    Texts without words match nothing; repeated rows and rows with a null id are matched each on its own.
    """
    index = build_index(docs, id_col)
    found = proximity(index, benchmark, size, span, least).groupBy("block", "place", "item").agg(F.count("*").alias("n_places"), F.max("n_terms").alias("n_terms"))
    return found.join(documents(index), ["block", "place"]).select(F.col("doc_id").alias(id_col), F.col("item").alias("item_id"), "n_places", "n_terms")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Repeated rows and rows with a null id each give a row. Without items, or words, nothing is hit.
    """
    index = build_index(docs, id_col)
    span = F.aggregate(
        F.sort_array(F.collect_list(F.struct("start", "stop"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["stop"]).alias("reach")),
        lambda a: a["n"],
    )
    hits = matches(index, benchmark, size).groupBy("block", "place").agg(span.alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    all_docs = documents(index).join(hits, ["block", "place"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return all_docs.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item, with all their columns.

    The verdict falls beside the row: each task indexes blocks of its own rows, searches the windows there and passes
    the clean rows on, so nothing is shuffled, joined or written; equal rows have equal verdicts. Null and empty texts
    stay, as does everything where ``benchmark`` has no words.
    """
    text = docs.columns.index(text_col)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = StructType([StructField("row", docs.schema)])
    for portion in _passes(benchmark, "item_id", "text", size):
        windows, length, _ = _windows([t for _, t in portion], size)
        rows = rows.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast((windows, length)), text, block_bytes), schema)
    return rows.select("row.*")


def _clean(data, text: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, length = data.value
        both = (pa.RecordBatch.from_arrays([b.column(0).field(text), b.column(0)], ["t", "row"]) for b in batches)
        for b in slices(both, "t", block_bytes):
            block = Block(*_block_of(b.column(0))[1])
            _, start = phrases(block, windows, length)
            clean = np.ones(b.num_rows, bool)
            clean[block.place(start)] = False
            yield b.select(["row"]).filter(pa.array(clean))

    return run

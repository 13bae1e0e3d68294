"""Token counts by rank-synchronous array merging.

Different pre-tokens of a batch form one ragged numpy array of symbols. Every pass finds each sequence's
lowest-rank pair (leftmost on a tie) and applies it in all sequences at once; sequences without a pair that
merges leave. The surviving symbols are counted, a character outside the vocabulary as its UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

#: Longer pre-tokens are cut between characters that are neighbours in no piece, where no merge can cross. What is still
#: longer (a run of one letter, say) is merged with a heap: the same result without a pass over the whole for each merge.
#: Applying a pair everywhere at once would need no heap, but is not exact here: in this vocabulary a merge can make a
#: pair of better rank than its own.
LONG = 256
_NONE = np.int64(1) << 40


class PieceCounter:
    """Counts of a SentencePiece BPE model without normalisation, with a leading space and byte fallback."""

    def __init__(self, path: str, limit: int = 1_000_000):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [(m.id_to_piece(i).replace("▁", " "), m.get_score(i)) for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        score = dict(normal)
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        chars = sorted({c for p in score for c in p})
        number = {s: i for i, s in enumerate(dict.fromkeys([*chars, *score]))}
        self.size = len(number) + 1
        self.char = np.full(0x110000, len(number), np.int64)  # the last number: a character in no piece
        self.char[[ord(c) for c in chars]] = [number[c] for c in chars]
        self.known_char = np.zeros(0x110000, bool)
        self.known_char[[ord(p) for p in score if len(p) == 1]] = True
        keys, ranks, made = [], [], []
        for p, s in score.items():
            for cut in range(1, len(p)):
                if (a := number.get(p[:cut])) is not None and (b := number.get(p[cut:])) is not None:
                    keys.append(a * self.size + b)
                    ranks.append(order[s])
                    made.append(number[p])
        at = np.argsort(keys)
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[at] for x in (keys, ranks, made))
        self.pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        beside = {number[p[i]] * self.size + number[p[i + 1]] for p in score for i in range(len(p) - 1)}
        self.beside = np.array(sorted(beside), np.int64)
        apart = any(" " in p.lstrip(" ") for p in score)
        if apart:
            raise ValueError("a piece has a space after another character: words are not independent")
        self.lines = not any("\n" in p for p in score)
        self.split = re.compile(r" +[^ \n]*|[^ \n]+|\n+" if self.lines else r" +[^ ]*|[^ ]+").findall
        self.limit, self.known = limit, {}

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index in the table of pairs, or -1."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def _parts(self, text: str) -> list[str]:
        """``text`` cut wherever no piece has the two characters beside each other."""
        sym = self.char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        key = sym[:-1] * self.size + sym[1:]
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        cut = [0, *(np.flatnonzero(self.beside[at] != key) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _one(self, text: str) -> int:
        """The same merges for one long sequence, by a heap of pairs."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        sym = self.char[code].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pair[k][0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (k := sym[i] * self.size + sym[i + 1]) in self.pair]
        heapq.heapify(heap)
        gone = [False] * n
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i] = self.pair[a * self.size + b][1]
            gone[j], left = True, left - 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (k := sym[x] * self.size + sym[y]) in self.pair:
                    heapq.heappush(heap, (self.pair[k][0], x, sym[x], sym[y]))
        return left + self._extra(code)

    def _extra(self, code: np.ndarray) -> int:
        odd = code[~self.known_char[code]]
        return int((odd > 0x7F).sum() + (odd > 0x7FF).sum() + (odd > 0xFFFF).sum())

    def merged(self, words: list[str]) -> np.ndarray:
        """Tokens of each sequence."""
        length = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(words)), length)
        odd = ~self.known_char[code]
        extra = odd * ((code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF))
        count = length + np.bincount(row, extra, len(words)).astype(np.int64)
        sym = self.char[code]
        while len(sym) > 1:
            at = np.where(row[:-1] == row[1:], self._look(sym[:-1], sym[1:]), -1)
            can = np.flatnonzero(at >= 0)
            if not len(can):
                break
            heads = np.flatnonzero(np.r_[True, row[can][1:] != row[can][:-1]])
            best = np.minimum.reduceat(self.ranks[at[can]] * _NONE + can, heads)  # lowest rank, then leftmost
            place = best & (_NONE - 1)
            sym[place] = self.made[at[place]]
            count[row[place]] -= 1
            alive = np.zeros(len(words), bool)
            alive[row[place]] = True
            keep = alive[row]
            keep[place + 1] = False
            sym, row = sym[keep], row[keep]
        return count

    def _learn(self, new: list[str], into: dict[str, int]) -> None:
        parts = {w: self._parts(w) for w in new if len(w) > LONG}
        every = sorted({x for x in new if len(x) <= LONG}.union(*parts.values()))
        short, got = [x for x in every if len(x) <= LONG], {x: self._one(x) for x in every if len(x) > LONG}
        for at in range(0, len(short), 50_000):
            part = short[at : at + 50_000]
            got.update(zip(part, self.merged(part).tolist(), strict=True))
        into.update((w, sum(got[x] for x in parts[w]) if w in parts else got[w]) for w in new)

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [self.split(" " + t.replace("▁", " ")) if t else [] for t in texts]
        known = self.known
        new = {x for x in set().union(*pieces) if x not in known}
        gone: list[str] = []
        if new:
            extra: dict[str, int] = {}
            self._learn(sorted(new), extra)
            room = self.limit - len(known)
            gone = [x for i, x in enumerate(extra) if i >= room or len(x) > 40]
            known.update(extra)  # those over the limit leave again below
        get = known.__getitem__
        out = [sum(map(get, p)) for p in pieces]
        for x in gone:
            del known[x]
        return out


_open: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit of every row.

    Null and empty texts have no bytes and no tokens; a null id stays null; repeated rows each give a row.
    One pass without a shuffle; a worker remembers a bounded number of pre-tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _open:
            _open[path] = PieceCounter(path)
        for b in slices(batches, "t"):
            texts = texts_of(b.column(1))
            n = _open[path].counts(texts)
            size = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > max_tokens for x in n], pa.bool_())], ["i", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, f"i {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("i", id_col)

"""Exact library token ids through a cache of text units.

Both vocabularies split a text before merging, and no merge crosses a split. In a text of plain characters (ASCII
printables, line ends, Latin-1 letters) a split stands wherever the kind of character changes (letters, digits,
other symbols, white space), except beside an apostrophe, which may begin a contraction. What stands between two
splits is a unit; units are found and looked up by 64-bit hashes for whole batches at once, and the library encodes
those that the cache lacks. A text where a split might not hold (other characters, runs of white space, special
tokens) goes to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import hashed, utf8_of

SPACE, LINE, LETTER, DIGIT, SYMBOL, APOSTROPHE, OTHER = range(7)


def _kinds() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    t[0x21:0x7F] = SYMBOL
    t[0x30:0x3A] = DIGIT
    t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = LETTER
    t[0x20], t[0x0A], t[0x27] = SPACE, LINE, APOSTROPHE
    return t


_KIND = _kinds()
#: Slots of the cache, two units in each; with the ids some 60 MB a worker, whatever the corpus.
_SLOTS = 1 << 20
#: Longer units are encoded anew in each batch.
_LONG = 40


class CachedTokenizer:
    """Ids of whole columns of texts; the cache holds ``limit`` ids at most and then starts anew."""

    def __init__(self, path: str, limit: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.lower = self.model.normalizer is not None
        names = self.model.get_vocab()
        self.wide = max(names.values(), default=0) >= 1 << 16
        self.size = np.zeros(max(names.values(), default=0) + 1, np.int64)  # bytes of each token
        for name, i in names.items():
            self.size[i] = len(name) - 4 * name.endswith("</w>")
        self.limit = limit
        self.key, self.start, self.many = np.zeros((2, _SLOTS), np.uint64), np.zeros((2, _SLOTS), np.uint32), np.zeros((2, _SLOTS), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.key[:] = 0
        self.pool, self.held = np.zeros(1 << 16, np.uint32 if self.wide else np.uint16), 0

    def _whole(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _odd(self, raw: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Rows that the library must see whole."""
        bad = [np.flatnonzero(kind == OTHER), np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))]
        high = np.flatnonzero(raw >= 0x80)
        if len(high):
            x, before = raw[high], raw[np.maximum(high - 1, 0)]
            bad.append(high[(x != 0xC3) & ((before != 0xC3) | (x >= 0xC0) | (x == 0x97) | (x == 0xB7))])
        odd = np.zeros(len(at) - 1, bool)
        if not self.lower:  # white space makes tokens: only single spaces and line ends between other characters
            white = kind <= LINE
            twice = np.flatnonzero(white[:-1] & white[1:])
            bad += [twice, twice + 1]
            full = np.flatnonzero(np.diff(at))
            odd[full] = white[at[full]] | white[at[full + 1] - 1]
        bad = np.concatenate(bad)
        if len(bad):
            odd[np.searchsorted(at, bad, "right") - 1] = True
        return odd

    def _units(self, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of all units."""
        n = len(kind)
        a, b = kind[:-1], kind[1:]
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        inner = (a != b) & (a != APOSTROPHE) & (b != APOSTROPHE)
        if self.lower:
            inner |= (a <= LINE) != (b <= LINE)
        else:
            inner &= a != SPACE  # a space belongs to what follows
            inner |= (b <= LINE) | (a == LINE)
        cut[1:n] |= inner
        place = np.flatnonzero(cut)
        s, e = place[:-1], place[1:]
        if self.lower:
            keep = kind[s] > LINE
            s, e = s[keep], e[keep]
        return s, e

    def _learn(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in the pool and number of ids of the units ``raw[s:e]``: encoded joined by line ends, cut where each ends."""
        data = raw.tobytes()
        start, many = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        line = np.flatnonzero((e - s == 1) & (raw[s] == 0x0A)) if not self.lower else np.zeros(0, np.int64)
        rest = np.setdiff1d(np.arange(len(s)), line, assume_unique=True)
        extra = 0 if self.lower else 1
        parts, held = [], self.held
        for low in range(0, len(rest), 20_000):
            part = rest[low : low + 20_000]
            text = b"\n".join(data[x:y] for x, y in zip(s[part].tolist(), e[part].tolist(), strict=True)).decode()
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(e[part] - s[part] + extra) - extra) + 1
            begins = np.r_[0, ends[:-1] + extra]
            start[part], many[part] = held + begins, ends - begins
            parts.append(ids)
            held += len(ids)
        if len(line):
            ids = np.array(self._whole("\n"), np.int64)
            start[line], many[line] = held, len(ids)
            parts.append(ids)
            held += len(ids)
        if held > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.held], np.zeros(max(held, 2 * len(self.pool)) - self.held, self.pool.dtype)])
        if parts:
            self.pool[self.held : held] = np.concatenate(parts)
        self.held = held
        return start, many

    def _keep(self, h: np.ndarray, start: np.ndarray, many: np.ndarray) -> None:
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        left = np.arange(len(h))
        for way in (0, 1):
            free = left[self.key[way, slot[left]] == 0]
            self.key[way, slot[free]] = h[free]
            mine = free[self.key[way, slot[free]] == h[free]]
            self.start[way, slot[mine]], self.many[way, slot[mine]] = start[mine], many[mine]
            left = np.setdiff1d(left, mine, assume_unique=True)
        way = (h[left] >> np.uint64(40) & np.uint64(1)).astype(np.int64)  # both taken: one gives way
        self.key[way, slot[left]] = h[left]
        mine = self.key[way, slot[left]] == h[left]
        left, way = left[mine], way[mine]
        self.start[way, slot[left]], self.many[way, slot[left]] = start[left], many[left]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after the other, and where each row's end; a null or empty text has none."""
        raw, at = utf8_of(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        if self.held > self.limit:
            self._reset()
        kind = _KIND[raw]
        odd = self._odd(raw, at, kind)
        s, e = self._units(kind, at)
        del kind
        if odd.any():
            fine = ~odd[np.searchsorted(at, s, "right") - 1]
            s, e = s[fine], e[fine]
        h = hashed(raw, s, e, fold=self.lower)
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        two = self.key[1, slot] == h
        found = two | (self.key[0, slot] == h)
        start = np.where(two, self.start[1, slot], self.start[0, slot]).astype(np.int64)
        many = np.where(two, self.many[1, slot], self.many[0, slot]).astype(np.int64)
        miss = np.flatnonzero(~found)
        if len(miss):
            new, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            first = miss[first]
            got, number = self._learn(raw, s[first], e[first])
            start[miss], many[miss] = got[inverse], number[inverse]
            short = e[first] - s[first] <= _LONG
            self._keep(new[short], got[short], number[short])
        total = np.r_[0, np.cumsum(many)]
        ids = self.pool[np.repeat(start - total[:-1], many) + np.arange(total[-1])].astype(np.uint32)
        ends = total[np.searchsorted(s, at[1:])]
        if not odd.any():
            return ids, ends
        parts, last, more = [], 0, np.zeros(len(ends), np.int64)
        for r in np.flatnonzero(odd).tolist():
            own = np.array(self._whole(raw[at[r] : at[r + 1]].tobytes().decode()), np.uint32)
            parts += [ids[last : ends[r]], own]
            last, more[r] = int(ends[r]), len(own)
        return np.concatenate([*parts, ids[last:]]), ends + np.cumsum(more)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]


_open: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """One per Python worker."""
    if path not in _open:
        _open[path] = CachedTokenizer(path)
    return _open[path]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with ``end_id`` behind every row's, and the new ends."""
    new = ends + np.arange(1, len(ends) + 1)
    out = np.empty(len(ids) + len(ends), np.uint32)
    out[new - 1] = end_id
    at = np.ones(len(out), bool)
    at[new - 1] = False
    out[at] = ids
    return out, new

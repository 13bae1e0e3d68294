"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word's symbols are its bytes, the last one marked as a word's end. One Aho-Corasick pass over all new words of a
batch gives the longest token that begins at every place. A word is then cut from left to right: a token is taken if
it is compatible with the token before it, that is if merging the two tokens' symbols by rank gives just these two;
else the next shorter token is tried, and where none is left the place is marked dead and the token before gives way.
A cut whose neighbours are all compatible is the one that merging by rank finds, and as a place has one such cut at
most, no place is marked twice: the time is linear in the word's length.

Normalizing and splitting follow the vocabulary's file: NFC, white space, lower case, then contractions, runs of
letters, single digits and runs of other symbols. Special tokens are found in the text as it stands.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import slices, texts_of

#: Symbols that one Aho-Corasick pass looks at; matches of a longer batch are gathered piece by piece.
_STEP = 1 << 18
#: Words and compatible pairs that a worker remembers; longer words than _KEEP characters are encoded anew.
_WORDS, _PAIRS, _KEEP = 600_000, 1_000_000, 40
#: Characters whose words are looked up at once. No token and no normal form crosses a space.
_PART = 1 << 20
#: Up to here the letter classes and lower cases of all Unicode versions in use agree; texts beyond are split by the library.
_PLAIN = "ԯ"


def _byte_letters() -> list[str]:
    """The printable letter of each byte in a byte-level vocabulary: itself where it is printable, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _portions(text: str) -> Iterator[str]:
    """``text`` cut before spaces into parts of about _PART characters; a run without a space stays whole."""
    at = 0
    while len(text) - at > _PART:
        cut = text.rfind(" ", at + 1, at + _PART)
        cut = cut if cut > 0 else text.find(" ", at + _PART)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class BpeCodec:
    """Encoder and decoder of one vocabulary file of the kind described above."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>":
            raise ValueError(f"{path} is no byte-pair vocabulary with word ends")
        self.path, self.library = path, None
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.specials = regex.compile("|".join(regex.escape(m) for m in sorted(special, key=len, reverse=True))) if special else None
        # The file's pattern with its classes of letters, numbers and white space written out, as far as texts are plain.
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            has = [bool(regex.match(name, chr(c))) for c in range(ord(_PLAIN) + 1)]
            edges = np.flatnonzero(np.diff(np.r_[0, has, 0])).tolist()
            pattern = pattern.replace(name, "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True)))
        self.words = re.compile(pattern).findall
        # Offset table: all tokens' printed forms with a space behind each, and where each begins.
        names = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in special.items()}
        printed = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(printed), np.uint8)
        self.offset = np.r_[0, np.cumsum([len(p) for p in printed])]
        # Merges: rank and parts of each token, and the token of each pair.
        vocab, end = model["vocab"], "</w>"
        n = len(printed)
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.merge: dict[int, int] = {}
        for r, (x, y) in enumerate(model["merges"]):
            a, b, t = vocab[x], vocab[y], vocab[x + y]
            if self.rank[t] >= 0 or max(self.rank[a], self.rank[b]) >= r:
                raise ValueError("a token has two merges, or a merge comes before its parts")
            self.rank[t], self.left[t], self.right[t] = r, a, b
            self.merge[a << 32 | b] = r
        byte_of = {c: chr(b) for b, c in enumerate(_byte_letters())}
        whole: list[str | None] = [None] * n  # symbols of each token
        for s, i in vocab.items():
            if s.endswith(end) and s != end:
                body = [byte_of[c] for c in s[: -len(end)]]
                body[-1] = chr(256 + ord(body[-1]))
            else:
                body = [byte_of[c] for c in s]
            whole[i] = "".join(body)
        self.single = {s: i for i, s in enumerate(whole) if s is not None and len(s) == 1}
        if len(self.single) != 512:
            raise ValueError("the vocabulary lacks single symbols")
        # A token that merging its own symbols does not give never stands in a result: parts come before wholes by rank.
        good = [self.rank[i] < 0 and s is not None for i, s in enumerate(whole)]
        for t in sorted((t for t in range(n) if self.rank[t] >= 0), key=self.rank.__getitem__):
            good[t] = good[self.left[t]] and good[self.right[t]] and self._meet(self.left[t], self.right[t], self.rank[t])
        self.trie = ahocorasick.Automaton()
        for i, s in enumerate(whole):
            if good[i]:
                self.trie.add_word(s, i)
        self.trie.make_automaton()
        self.length = [len(s) if s else 0 for s in whole]
        self.length_of = np.array(self.length, np.int64)
        self.longest_token = max(self.length)
        by_text = {s: i for i, s in enumerate(whole) if good[i]}
        self.shorter = [-1] * n  # the longest token that begins this one
        for s, i in by_text.items():
            for cut in range(len(s) - 1, 0, -1):
                if (p := by_text.get(s[:cut], -1)) >= 0:
                    self.shorter[i] = p
                    break
        self.known: dict[str | int, bytes] = {i: np.int32(i).tobytes() for i in special.values()}
        self.pairs: dict[int, bool] = {}

    def _meet(self, a: int, b: int, until: int = 1 << 40) -> bool:
        """Whether ``a`` and ``b`` stay apart while their symbols merge by rank, both being whole before rank ``until``.

        While they merge, parts from the right edge of ``a`` and the left edge of ``b`` touch. A touching pair merges
        if its rank comes before the merge that uses up the left part; at the same rank the leftmost place goes first,
        so the right part is already lost to it.
        """
        x, x_used = a, until
        while x >= 0:
            y, y_used = b, until
            while y >= 0:
                r = self.merge.get(x << 32 | y)
                if r is not None and r < x_used and (r <= y_used if y_used < until else r < y_used):
                    return False
                y, y_used = self.left[y], self.rank[y]
            x, x_used = self.right[x], self.rank[x]
        return True

    def _longest(self, symbols: str) -> array:
        """The longest token that begins at each place."""
        out = np.empty(len(symbols), np.int32)
        for at in range(0, len(symbols), _STEP):
            got = np.fromiter(self.trie.iter(symbols[at : at + _STEP + self.longest_token]), np.dtype("i8,i4"))
            start = got["f0"] - self.length_of[got["f1"]] + 1 + at
            inside = start < min(at + _STEP, len(symbols))
            out[start[inside]] = got["f1"][inside]  # ends ascend, so the longest of a start is the last
        found = array("i")
        found.frombytes(out.tobytes())
        return found

    def _cut(self, longest: array, start: int, stop: int) -> array:
        """Tokens of the word between two places."""
        length, shorter, pairs = self.length, self.shorter, self.pairs
        out, dead = array("i"), bytearray(stop - start + 1)
        at, token, last = start, longest[start], -1
        while True:
            end = at + length[token]
            fits = end <= stop and not dead[end - start]
            if fits and last >= 0:
                key = last << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= _PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self._meet(last, token)
            if fits:
                out.append(token)
                if end == stop:
                    return out
                at, last, token = end, token, longest[end]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: the token before gives way
                dead[at - start] = 1
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = shorter[token]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of each word as bytes."""
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        symbols = "".join(b[:-1].decode("latin-1") + chr(256 + b[-1]) for b in raw)
        longest = self._longest(symbols)
        out, at = {}, 0
        for w, b in zip(new, raw, strict=True):
            out[w] = self._cut(longest, at, at + len(b)).tobytes()
            at += len(b)
        return out

    def _split(self, text: str) -> list[str]:
        if text.isascii() or max(text) <= _PLAIN:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter
            return self.words(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.letter = {c: b for b, c in enumerate(_byte_letters())}
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.letter[c] for c in p).decode("utf-8", "surrogatepass") for p, _ in parts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and each text's number of ids. Words are looked up for _PART characters at a time."""
        raw, count = [], np.zeros(len(texts), np.int64)
        held, owner, size = [], [], 0
        for i, t in enumerate(texts):
            for part in _portions(t):
                held.append(part)
                owner.append(i)
                size += len(part)
                if size >= _PART:
                    got = self._some(held)
                    np.add.at(count, owner, [len(r) >> 2 for r in got])
                    raw += got
                    held, owner, size = [], [], 0
        got = self._some(held)
        np.add.at(count, owner, [len(r) >> 2 for r in got])
        return np.frombuffer(b"".join(raw + got), "<i4"), count

    def _some(self, texts: list[str]) -> list[bytes]:
        rows: list[list] = []
        for t in texts:
            if self.specials and "<" in t and (marks := self.specials.findall(t)):
                pieces = self.specials.split(t)
                row = self._split(pieces[0])
                for mark, piece in zip(marks, pieces[1:], strict=True):
                    row.append(self.special[mark])
                    row += self._split(piece)
                rows.append(row)
            else:
                rows.append(self._split(t))
        known = self.known
        new = [w for w in set().union(*rows) if w not in known]
        gone: list[str] = []
        if new:
            learned = self._learn(sorted(new))
            gone = [w for i, w in enumerate(learned) if len(known) + i >= _WORDS or len(w) > _KEEP]
            known.update(learned)
        get = known.__getitem__
        raw = [b"".join(map(get, row)) for row in rows]
        for w in gone:
            del known[w]
        return raw

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of each row's printed tokens joined by spaces, one after the other, and where each row begins.

        Ids outside the vocabulary print nothing, as in the library.
        """
        ids = np.where((ids >= 0) & (ids < len(self.offset) - 1), ids, -1)
        size = np.where(ids >= 0, self.offset[ids + 1] - self.offset[np.maximum(ids, 0)], 0)
        upto = np.r_[0, np.cumsum(size)]
        out = self.blob[np.repeat(self.offset[np.maximum(ids, 0)] - upto[:-1], size) + np.arange(upto[-1])]
        ends = upto[np.cumsum(count)] if len(count) else np.zeros(0, np.int64)
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        last = ends[ends > starts] - 1  # no space behind a row's last token
        keep = np.ones(len(out), bool)
        keep[last] = False
        size = ends - starts - (ends > starts)
        return out[keep], np.r_[0, np.cumsum(size)]


_open: dict[str, BpeCodec] = {}


def _codec(path: str) -> BpeCodec:
    """One per Python worker."""
    if path not in _open:
        _open[path] = BpeCodec(path)
    return _open[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ids array<int> of every row's whole text, special strings as their ids, nothing added or cut.

    Null and empty texts have no ids; a null id stays null; repeated rows each give a row; other columns are left out,
    whatever their names. One pass without a shuffle. A worker remembers a bounded number of words. A very long text is
    looked at in parts cut at spaces, in time proportional to its length; a run without a space stays whole, at some
    30 bytes a character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            ids, count = _codec(path).encode(texts_of(b.column(1)))
            at = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32)))], ["i", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, f"i {kind}, ids array<int>").withColumnRenamed("i", id_col)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with a column ``into``: the printed tokens of ``ids_col`` joined by spaces, special tokens too.

    Null ids give null, no ids the empty text; ids outside the vocabulary print nothing. Raises if ``into`` is there.
    """
    if into in rows.columns:
        raise ValueError(f"there is a column {into!r}")
    where = rows.columns.index(ids_col)
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema.fields)] + [StructField("out", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                col = b.column(where)
                count = np.asarray(col.value_lengths().fill_null(0), np.int64)
                out, start = _codec(path).decode(np.asarray(col.flatten().fill_null(-1), np.int64), count)
                text = pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(start.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
                if col.null_count:
                    text = pc.if_else(col.is_valid(), text, None)
                yield pa.RecordBatch.from_arrays([*b.columns, text], plain.names)

    return rows.toDF(*plain.names[:-1]).mapInArrow(run, plain).toDF(*rows.columns, into)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the decimal ids joined by spaces and of the text decoded from them.

    Nulls, repeats and very long texts as in :func:`encode`: a null or empty text has no tokens and both hashes of the empty string.
    """
    both = decode(encode(docs, path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Secret scans: pattern findings, and a character convolutional network over every candidate in its context.

Three base patterns give findings that always stay. Other long tokens of letters and digits are candidates;
each candidate (base ones too) is scored by a small network in numpy over its characters and those around it;
of a token longer than the network's window every part is scored, and the largest score counts.
The network is trained on labelled findings (by default drawn from a seeded generator), its score calibrated
on a second part, and the threshold is the largest that keeps a stated recall on a third part.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

BEFORE, VALUE, AFTER = 28, 48, 12
#: Longer tokens are seen through windows of VALUE characters, one every so many, and piece by piece between / and =.
STEP = 16
PIECE = re.compile(r"[^/=]{16,}")
WIDTH = BEFORE + VALUE + AFTER
_CODE = np.full(0x110000, 97, np.uint8)
_CODE[32:127] = np.arange(1, 96)
_CODE[[9, 10, 13]] = 96


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in code points: leftmost, non-overlapping within a kind, short ones dropped."""
    out: list[tuple[int, int, int]] = []
    low = text.encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z change
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Long tokens with both a letter and a digit."""
    out = []
    for m in CANDIDATE.finditer(text):
        t = m[0]
        if not (t.isalpha() or t.isdigit()) and any(c.isdigit() for c in t) and any(c.isalpha() for c in t):
            out.append((m.start(), m.end()))
    return out


def encoded(found: list[tuple[str, int, int]]) -> np.ndarray:
    """Rows of character codes: context, the value's start, context; inside the value the codes are moved by 98."""
    out = np.zeros((len(found), WIDTH), np.uint8)
    for r, (text, a, b) in enumerate(found):
        for piece, at, move, right in ((text[max(0, a - BEFORE) : a], BEFORE, 0, True), (text[a : min(b, a + VALUE)], BEFORE, 98, False), (text[b : b + AFTER], BEFORE + VALUE, 0, False)):
            if piece:
                code = _CODE[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")] + move
                if right:
                    out[r, at - len(code) : at] = code
                else:
                    out[r, at : at + len(code)] = code
    return out


def views(text: str, a: int, b: int) -> Iterator[tuple[str, int, int]]:
    """What the network sees of a token: its start, and for a token beyond VALUE characters all the rest."""
    yield text, a, b
    if b - a > VALUE:
        for k in (*range(a, b - VALUE, STEP), b - VALUE):
            yield text, k, k + VALUE
        for m in PIECE.finditer(text, a, b):
            yield text, m.start(), m.end()


@dataclass
class Network:
    """Embedding, one convolution of width five, maximum and mean over places, logistic output, calibration."""

    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _forward(self, x: np.ndarray):
        e = self.emb[x]
        n, w, d = e.shape
        cols = np.concatenate([e[:, k : w - 4 + k] for k in range(5)], axis=2)
        z = cols @ self.conv + self.bias
        a = np.maximum(z, 0)
        top = a.argmax(axis=1)
        h = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(axis=1)], axis=1)
        return cols, z, top, h, h @ self.out + self.out_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        p = [1 / (1 + np.exp(-np.clip(self.slope * self._forward(x[i : i + 512])[-1] + self.shift, -30, 30))) for i in range(0, len(x), 512)]
        return np.concatenate(p) if p else np.zeros(0)

    def scores(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """The largest probability over the views of each token, some thousands of views at a time."""
        out = np.zeros(len(found))
        for part in itertools.batched(((i, v) for i, x in enumerate(found) for v in views(*x)), 4096):
            np.maximum.at(out, [i for i, _ in part], self.probability(encoded([v for _, v in part])))
        return out


def train(x: np.ndarray, y: np.ndarray, recall: float = 0.98, epochs: int = 14, seed: int = 7) -> Network:
    """Fit on 60 % of the rows, calibrate on 20 %, choose the threshold on 20 %."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    fit, cal, held = np.split(order, [int(0.6 * len(x)), int(0.8 * len(x))])
    d, f = 8, 16
    net = Network(rng.normal(0, 0.3, (196, d)), rng.normal(0, (2 / (5 * d)) ** 0.5, (5 * d, f)), np.zeros(f), rng.normal(0, 0.3, 2 * f), 0.0)
    names = ("emb", "conv", "bias", "out")
    m, v, t = {k: 0.0 for k in (*names, "b")}, {k: 0.0 for k in (*names, "b")}, 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            xb, yb = x[at], y[at]
            cols, z, top, h, s = net._forward(xb)
            g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - yb) / len(at)
            dh = g[:, None] * net.out
            da = np.repeat(dh[:, None, f:] / z.shape[1], z.shape[1], axis=1)
            np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dh[:, None, :f], 1)
            dz = da * (z > 0)
            dcols = dz @ net.conv.T
            demb = np.zeros_like(net.emb)
            for k in range(5):
                np.add.at(demb, xb[:, k : xb.shape[1] - 4 + k], dcols[..., k * d : (k + 1) * d])
            grads = {"emb": demb, "conv": np.tensordot(cols, dz, ([0, 1], [0, 1])), "bias": dz.sum((0, 1)), "out": h.T @ g, "b": g.sum()}
            t += 1
            for k, grad in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                step = 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                if k == "b":
                    net.out_bias -= float(step)
                else:
                    setattr(net, k, getattr(net, k) - step)
    # Platt's calibration by Newton steps, lightly held to slope 1.
    s = net._forward(x[cal])[-1]
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - y[cal]) * s).sum() + 0.1 * (a - 1), (p - y[cal]).sum() + 0.1 * b])
        hess = np.array([[(w * s * s).sum() + 0.1, (w * s).sum()], [(w * s).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    net.slope, net.shift = float(a), float(b)
    good = np.sort(net.probability(x[held])[y[held] == 1])
    net.threshold = float(min(0.9, good[int((1 - recall) * len(good))])) if len(good) else 0.5
    return net


def labelled_findings(n: int = 4000, seed: int = 11) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Candidates in context with labels: random credentials in code and prose, against names, slugs, numbers, joined words."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    some = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    syllables = "the an re on en er ti es le que ion ment cho ier eau sch ung lich ver ado cia mos tra ble ing".split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.integers(2, 7)))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ("password", "passwd", "secret", "token", "api_key", "apikey", "Authorization", "access_key", "client_secret", "key", "auth", "PRIVATE_TOKEN")
    found, label = [], []
    for _ in range(n):
        good = rng.random() < 0.5
        if good:
            value = pick([lambda: some(hexa, rng.integers(32, 65)), lambda: "AKIA" + some(alnum[:26] + "0123456789", 16), lambda: some(alnum, rng.integers(16, 44)), lambda: some(alnum + "+/", rng.integers(24, 48)) + "=", lambda: "ghp_" + some(alnum, 36), lambda: "sk_live_" + some(alnum, 24), lambda: some(alnum + "_-", rng.integers(20, 43))])()
            before = pick([lambda: f"{pick(keys)} = \"", lambda: f"{pick(keys)}: ", lambda: f"{pick(keys)}=", lambda: "Bearer ", lambda: f"'{pick(keys)}': '", lambda: f"{prose()} "])()
        else:
            value = pick([
                lambda: "-".join(word() for _ in range(6)) + f"-{rng.integers(1, 3000)}",
                lambda: "_".join(word() for _ in range(5)) + f"_v{rng.integers(1, 40)}",
                lambda: "/".join(word() for _ in range(5)) + f"/{rng.integers(1, 999)}",
                lambda: "".join(word().capitalize() for _ in range(6)) + str(rng.integers(1, 99)),
                lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}-{rng.integers(10, 60)}-00Z",
                lambda: f"page{rng.integers(1, 99)}=" + "=".join(word() for _ in range(4)),
                lambda: "".join(word() for _ in range(9)) + str(rng.integers(0, 9)),
                lambda: some("0123456789", 12) + "-" + word() + "-" + some("0123456789", 6),
                lambda: (word() + word() + word())[:18] + str(rng.integers(0, 2100)),
                lambda: "=" * rng.integers(18, 40) + word() + str(rng.integers(1, 9)),
                lambda: pick(("your", "my", "example", "changeme")) + "_" + pick(keys) + "_goes_here_" + str(rng.integers(1, 99)),
            ])()
            before = pick([lambda: f"{prose()} ", lambda: f"{prose()}: ", lambda: f"{pick(keys)} = \"", lambda: "https://example.com/", lambda: f"{prose()}.\n", lambda: f"{prose()} | "])()
        left = f"{prose()} {before}"
        text = f"{left}{value}{pick((' ', chr(34), chr(10), ', ', ''))} {prose()}"
        found.append((text, len(left), len(left) + len(value)))
        label.append(good)
    return found, np.array(label, float)


@functools.lru_cache(maxsize=2)
def network(recall: float = 0.98) -> Network:
    found, y = labelled_findings()
    return train(encoded(found), y, recall)


def _uncovered(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of ``found`` that lie in none of ``base``; both ascend by start."""
    out, at, reach = [], 0, -1
    for s, e in found:
        while at < len(base) and base[at][0] <= s:
            reach = max(reach, base[at][1])
            at += 1
        if reach < e:
            out.append((s, e))
    return out


def scan(texts: list[str], net: Network) -> list[list[tuple[int, int, int, float]]]:
    """(start, end, kind number, probability) of each text, by start, then kind."""
    base = [base_findings(t) for t in texts]
    more = []
    for t, b in zip(texts, base, strict=True):
        more.append(_uncovered(candidates(t), b))
    found = [(t, s, e) for t, b, c in zip(texts, base, more, strict=True) for s, e, *_ in (*b, *c)]
    p = net.scores(found).tolist()
    out, at = [], 0
    for b, c in zip(base, more, strict=True):
        here = [(s, e, k, p[at + i]) for i, (s, e, k) in enumerate(b)]
        at += len(b)
        here += [(s, e, 3, p[at + i]) for i, (s, e) in enumerate(c) if p[at + i] >= net.threshold]
        at += len(c)
        out.append(sorted(here, key=lambda x: (x[0], x[2], x[1])))
    return out


SPAN = "array<struct<kind: string, start: long, end: long, probability: double>>"


def find_secrets(docs: DataFrame, text_col: str = "text", recall: float = 0.98, redact: bool = False, spans_col: str = "secret_spans") -> DataFrame:
    """``docs`` with ``spans_col`` (by start, then kind), whole texts scanned; null and empty texts have none.

    With ``redact`` each covered stretch of the text becomes ``[secret]``. Other columns pass through; a column
    that is already named so is replaced.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    net = docs.sparkSession.sparkContext.broadcast(network(recall))  # some 10 kB, whatever the input
    docs = docs.drop(spans_col)
    names, at = docs.columns, docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # any names, dots in them too
    schema = T.StructType(list(plain.schema.fields)).add("spans", T._parse_datatype_string(SPAN))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, f"c{at}"):
            texts = texts_of(b.column(at))
            spans = scan(texts, net.value)
            cols = list(b.columns)
            if redact and any(spans):
                kept = b.column(at).to_pylist()
                for i, found in enumerate(spans):
                    if found:
                        kept[i] = redacted(texts[i], found)
                cols[at] = pa.array(kept, arrow.field(at).type)
            cols.append(pa.array([[{"kind": KINDS[k], "start": s, "end": e, "probability": p} for s, e, k, p in x] for x in spans], arrow.field(len(cols)).type))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return plain.mapInArrow(run, schema).toDF(*names, spans_col)


def redacted(text: str, found: list[tuple[int, int, int, float]]) -> str:
    out, at = [], 0
    for s, e, *_ in found:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = e
    return "".join([*out, text[at:]])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.98) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans and all spans as text, per document."""
    from pyspark.sql import functions as F

    found = find_secrets(docs.select(id_col, text_col), text_col, recall)
    base = F.filter("secret_spans", lambda x: x["kind"] != KINDS[3])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    many = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(id_col, *(many(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secret_spans")).alias("spans"))

"""The backtracking encoder and the decoder against the library."""

import hashlib
import random
import time

import pytest

from cytoloom.llm import bpe_codec as B
from cytoloom.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return B.BpeCodec(PATH)


def odd_texts(library):
    rnd, names = random.Random(1), list(library.get_vocab())
    out = ["", " ", "<|endoftext|>", "a<|startoftext|><|endoftext|>B", "<|ENDOFTEXT|>", "<|endoftext", "I'LL I'm we're", "ΑΣ Σ ς", "é İ ²½ \x1c\x85 ", "日本語 テキスト 𝔘𝔫𝔦", "\x00\x7f", "'s's"]
    for _ in range(200):
        out.append("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))))
        out.append("".join(rnd.choice(names).replace("</w>", "") for _ in range(rnd.randint(0, 20))))
        out.append("".join(rnd.choice("thein gaors'td!?..-") for _ in range(rnd.randint(0, 200))))
        out.append("".join(chr(rnd.choice([rnd.randint(0, 0x300), rnd.randint(0, 0x530), rnd.randint(0, 0xD7FF), rnd.randint(0x10000, 0x10FFFF)])) for _ in range(30)))
        out.append(rnd.choice("a!1=-é") * rnd.randint(0, 300))
    return out


def test_ids_and_texts_are_the_librarys(library, codec, monkeypatch):
    texts = odd_texts(library)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for part in (1 << 20, 50):  # also with texts cut at spaces
        monkeypatch.setattr(B, "_PART", part)
        ids, count = codec.encode(texts)
        at = [0, *count.cumsum().tolist()]
        got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == want
    out, start = codec.decode(ids.astype("int64"), count)
    texts = [out[a:b].tobytes().decode() for a, b in zip(start[:-1], start[1:], strict=True)]
    assert texts == [library.decode(w, skip_special_tokens=False) for w in want]


def test_every_token_stands_for_itself(library, codec):
    """A token is in the automaton exactly if merging its own text gives it back."""
    names = [(n[:-4], i) for n, i in library.get_vocab().items() if n.endswith("</w>") and n.isascii() and n[:-4].isalpha()]
    ids, count = codec.encode([n for n, _ in names])
    assert count.tolist() == [len(library.encode(n, add_special_tokens=False).ids) for n, _ in names]


def test_long_runs_take_linear_time(codec):
    def took(n):
        start = time.perf_counter()
        codec.encode(["ab" * n])
        return time.perf_counter() - start

    assert took(400_000) < 8 * took(100_000) + 1


def test_caches_are_bounded(library, codec, monkeypatch):
    monkeypatch.setattr(B, "_WORDS", 5)
    monkeypatch.setattr(B, "_PAIRS", 3)
    small = B.BpeCodec(PATH)
    text = "one two three four five six seven eight nine ten eleven twelve"
    for _ in range(2):
        assert small.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(small.known) <= 8 and len(small.pairs) <= 3


def test_operator(spark, library):
    rows = [(1, "Hello, world!", 1, 2), (1, "Hello, world!", 1, 2), (None, "x", 1, 2), (3, None, 1, 2), (4, "", 1, 2), (5, "wort " * 300_000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded int")
    for parts in (1, 4):
        got = sorted(map(tuple, B.digest(docs.repartition(parts), PATH).collect()), key=str)
        want = []
        for i, t, _, _ in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert B.digest(docs.where("false"), PATH).count() == 0
    back = B.decode(spark.createDataFrame([(1, None), (2, []), (3, [0, 99_999_999])], "out int, ids array<int>"), PATH)
    assert {r["out"]: r["decoded"] for r in back.collect()} == {1: None, 2: "", 3: "!"}
    with pytest.raises(ValueError):
        B.decode(back, PATH)

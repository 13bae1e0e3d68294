"""The pipeline's stages against brute force on a small corpus with planted cases."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("the an re on er ti es le que ion".split()) for _ in range(rnd.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, text(20)) for i in range(5)]
    docs = [text(rnd.randrange(40, 200)) for _ in range(60)]
    planted = {
        "exact": docs[3], "near": docs[4] + " extra", "leak": docs[5] + " " + bench[2][1].upper() + " " + text(30),
        "secret": text(40) + ' token = "0123456789abcdef0123456789abcdef01234567" ' + text(20), "short": "too short", "repeats": text(12) + " " + "same words over and over again " * 20, "empty": "",
    }
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*docs, *planted.values()])] + [(900, None, None, None, None), (901, docs[7], "de", "s", None)]
    at = dict(zip(planted, range(len(docs), len(docs) + len(planted)), strict=True))
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, at


def test_stages(spark, corpus):
    path, rows, at = corpus
    text_of = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = {r[0] for r in rows}
    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == COLUMNS, name
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(got) == docs.count()
        steps.append(got)
    assert ids - set(steps[0]) == {at["short"], at["repeats"], at["empty"], 900}
    assert set(steps[0]) - set(steps[1]) == {at["exact"], at["near"], 901}
    assert set(steps[1]) - set(steps[2]) == {at["leak"]}
    assert set(steps[2]) == set(steps[3])
    assert steps[3][at["secret"]] == re.sub(r'token = "[0-9a-f]+', "[secret]", text_of[at["secret"]])
    assert all(t == text_of[i] for i, t in steps[3].items() if i != at["secret"])
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in packed} == set(steps[3])
    for i in steps[3]:
        pieces = sorted((r["start"], r["length"], r["doc_tokens"]) for r in packed if r["doc_id"] == i)
        assert sum(p[1] for p in pieces) == pieces[0][2]


def test_near_duplicates_without_unique_ids(spark):
    rnd = random.Random(5)
    text = lambda n=60: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(n))
    one, two, three, four, five, six, seven = (text() for _ in range(7))
    rows = [
        (1, one), (1, two),  # one id, different texts: both stay
        (1, two + " extra"), (2, one + " extra"),  # near copies of either
        (None, three), (None, three), (None, three + " extra"), (None, four),  # without ids
        (7, four + " extra"), (None, one),  # an id goes before none
        (5, five), (5, five), (5, five),  # equal rows
        (-3, six), (3, six), (4, six + " extra"), (None, None), (8, ""), (9, ""), (10, seven),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == COLUMNS and got.schema == docs.schema
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    sure = [(1, one), (7, four + " extra"), (5, five), (-3, six), (None, None), (8, ""), (9, ""), (10, seven)]
    either = [((1, two), (1, two + " extra")), ((None, three), (None, three + " extra"))]
    assert all(left.count(x) == 1 for x in sure) and all(left.count(x) + left.count(y) == 1 for x, y in either)
    assert len(left) == len(sure) + len(either)


def test_stages_of_odd_tables(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows, and extra columns named like the stages' own."""
    extra = COLUMNS + ["_cytoloom_key", "row", "_row", "kept", "n_words", "secret_spans", "a.b"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _cytoloom_key string, row int, _row int, kept string, n_words int, secret_spans string, `a.b` array<int>"
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "en", "s", 9, "k", 1, 2, "x", 3, "y", [1]), (1, good, "en", "s", 9, "k", 1, 2, "x", 3, "y", [1]), (None, good + " more", None, None, None, *[None] * 7), *[(None, None, *[None] * 10)] * 3, (5, good.replace("word", "other"), None, None, None, *[None] * 7)]
    full = spark.createDataFrame(rows, kinds)
    bench = spark.createDataFrame([(1, "some words of an item that no document of this table has at all")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for number, (docs, some_bench, some_labels) in enumerate([(full, bench, labels), (full, bench.limit(0), labels.limit(0)), (full.limit(0), bench, labels)]):
        path = str(tmp_path / str(number))
        for name, table in (("documents", docs), ("benchmark", some_bench), ("labels", some_labels)):
            table.write.parquet(f"{path}/{name}.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, path)
            assert docs.columns == extra and [f.dataType for f in docs.schema] == [f.dataType for f in full.schema], name
        left = docs.collect()
        assert sorted(r["doc_id"] for r in left) == ([] if number == 2 else [1, 5])
        assert all(r["_cytoloom_key"] == "k" and r["a.b"] == [1] for r in left if r["doc_id"] == 1)
        packed = corpus_pipeline.run(spark, path).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in left}

"""From raw documents to packed training sequences: five stages over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.llm.common import written
from cytoloom.llm.decontamination import uncontaminated
from cytoloom.llm.ngram_join import similar
from cytoloom.llm.packing import pack
from cytoloom.llm.quality_rules import keep_good
from cytoloom.llm.queries import table, vocabulary
from cytoloom.llm.secret_scan import find_secrets

#: Shingles of five words, Jaccard similarity of 0.8 or more.
NEAR = (5, 80, 100)
#: The stages' own key; a column of ``docs`` with this name stays what it is.
KEY = "_cytoloom_key"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled rule reject go; a null text has no words and goes."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def _keyed(docs: DataFrame) -> DataFrame:
    """KEY, a hash of id and text, and the whole row as ``row``, whatever the columns' names."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(F.xxhash64("doc_id", "text").alias(KEY), F.col("text"), F.col("doc_id"), whole.alias("row"))


def _without(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """``rows`` whose KEY is not in ``bad``: one hash join at every size, for which each row crosses the network once."""
    return rows.join(bad.select(KEY).distinct().hint("shuffle_hash"), KEY, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays, one without an id only where none has one.

    Rows are told apart by a hash of id and text, so that rows of one id go only if their texts are equal or linked,
    and null ids are compared too. Of equal rows one stays. Null and empty texts are near nothing but their equals.
    """
    keyed = _keyed(docs)
    found = written(similar(keyed, *NEAR, id_col=KEY), "near")
    linked = found.where(f"{KEY} <> component_id").select(KEY, F.col("component_id").alias("component")).distinct()
    linked = written(linked.union(linked.select("component", "component").distinct()), "linked")
    ids = keyed.groupBy(KEY).agg(F.min("doc_id").alias("doc_id")).join(linked, KEY)
    best = ids.groupBy("component").agg(F.min_by(KEY, F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias(KEY))
    bad = written(linked.join(best.select(KEY), KEY, "left_anti"), "dropped")
    # Equal rows are combined before the shuffle, whatever their number, and the join keeps its partitions.
    order = F.xxhash64(*(F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
    each = keyed.groupBy(KEY).agg(F.min_by("row", order).alias("row"))
    return _without(each, bad).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of ten words of a benchmark item go; repeated rows go or stay together, as the verdict
    follows the text. Null and empty texts stay, as does everything where ``benchmark`` has no rows."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"), 10)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; stretches that hold a secret become ``[secret]`` and n_chars follows. Null texts stay null."""
    spans = next(c for c in (KEY + "_" * k for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    rows = find_secrets(docs, redact=True, spans_col=spans)
    changed = F.size(spans) > 0
    rows = rows.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in sequences of 2048 tokens; a null or empty text is the end id alone."""
    return pack(docs, vocabulary("word_bpe_49k.json"), 2048, 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", packing),
]
#: A trained network and the tokenizer are not SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

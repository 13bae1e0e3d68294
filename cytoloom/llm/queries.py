"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048, 1)


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .grammar import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), 0)


ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS f FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(x, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM d"""


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


ORACLES["op10_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS p, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, array_to_string(w[i : i + k - 1], ' ') AS p, k AS n FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT n AS k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (p, n)),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query
def near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of op10's method, in a query of its own: runs of 20 words with 8 of a window's 10, in any order."""
    from . import decontamination

    return decontamination.near_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest

    return digest(table(spark, sf_dir, "documents"))


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op1_oracle() -> str:
    from .quality_rules import oracle

    return oracle()


ORACLES["op1_quality_rules"] = _op1_oracle()


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import digest

    return digest(table(spark, sf_dir, "documents"))


def _op5_oracle() -> str:
    from .license_scan import oracle

    return oracle()


ORACLES["op5_licenses"] = _op5_oracle()


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar

    return similar(table(spark, sf_dir, "documents"), 4, 85, 100)


#: All pairs of documents that share a shingle, then the smallest id reachable: for small tables.
ORACLES["op3_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify, grades_of

    return classify(table(spark, sf_dir, "documents"), grades_of(table(spark, sf_dir, "labels")))


@query
def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import digest

    return digest(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")))


def _op11_oracle() -> str:
    from .conversation_repair import oracle

    return oracle()


ORACLES["op11_conversation_repair"] = _op11_oracle()


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import written
    from .prefix_trie import numbered, prefix_trie, rebuilt

    return prefix_trie(*rebuilt(written(numbered(table(spark, sf_dir, "conversations")), "turns")))


def _op13_oracle() -> str:
    from .prefix_trie import oracle

    return oracle()


ORACLES["op13_prefix_trie"] = _op13_oracle()

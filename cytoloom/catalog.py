"""Named queries over the test tables and their DuckDB counterparts.

``embeddings`` stands in for both sets: even vec_id are reference cells, odd ones query cells, label is the
reference's cluster. ``lineitem`` gives sizes, blanks, places and counts. Doubles are rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distributions import normal_cdf
from .operators import anchors as A
from .operators import annotate, cca, clean, cluster, communities, consensus, correct, density, embed, gates, knn, lanczos, pivots, transfer
from .params import Params
from .plans import integration
from .sources import cells as sources
from .sources.scratch import fresh_path, settled
from .streaming.score import label_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

P = Params()
K, K_ANCHOR, K_FILTER, K_SCORE, K_WEIGHT, MASK = P.k_find_nn, P.k_find_anchor, P.k_filter_anchor, P.k_score_anchor, P.k_find_weights, P.mask_threshold
#: Between the mean distances here, none of which is below the default: a discard that keeps some cells and drops some.
TELLING = 0.66
NB = (("A", 4.0, 20.0), ("N", 6.0, 30.0), ("R", 2.5, 25.0))
GATES: list[gates.Gate] = [(0, 0.1), (3, 0.05), ((1, 2), (0.4, 0.3))]


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str, side: int | None = None) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    if side is not None:
        rows = rows.where(F.col("vec_id") % 2 == side)
    return rows.select(F.floor(F.col("vec_id") / (1 if side is None else 2)).alias("ord"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _ref(spark, sf_dir):
    return _cells(spark, sf_dir, 0)


def _query(spark, sf_dir):
    return _cells(spark, sf_dir, 1)


def _long(cells: DataFrame, key: str = "ord") -> DataFrame:
    return cells.select(key, F.posexplode("v").alias("feature", "x")).select(key, "feature", F.round("x", 6).alias("value"))


# ------------------------------------------------------------------ SQL pieces

_E = """e AS (SELECT vec_id, vec_id % 2 AS side, vec_id // 2 AS ord, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
c AS (SELECT *, list_avg(v) AS m FROM e), d AS (SELECT *, list_transform(v, lambda x: x - m) AS u FROM c),
z AS (SELECT side, ord, label, v, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS z FROM d)"""


def _sql_knn(name: str, src: int, dst: int, k: int | str, metric: str = "correlation", where: str = "") -> str:
    dist = "1 - list_dot_product(a.z, b.z)" if metric == "correlation" else "list_distance(a.v, b.v)"
    return f"""{name} AS (SELECT src, dst, rank, dist FROM (SELECT a.ord AS src, b.ord AS dst, round({dist}, 12) AS dist,
  row_number() OVER (PARTITION BY a.ord ORDER BY round({dist}, 12), b.ord) AS rank FROM z a, z b WHERE a.side = {src} AND b.side = {dst} {where}) WHERE rank <= {k})"""


_NN = ", ".join([_E, _sql_knn("rr", 0, 0, K + 1), _sql_knn("qq", 1, 1, K + 1, "euclidean"), _sql_knn("rq", 0, 1, K, "euclidean"), _sql_knn("qr", 1, 0, K, "euclidean")])
_MUTUAL = f"{_NN}, mu AS (SELECT rq.src AS cellr, rq.dst AS cellq FROM rq JOIN qr ON rq.src = qr.dst AND rq.dst = qr.src WHERE rq.rank <= {K_ANCHOR} AND qr.rank <= {K_ANCHOR})"
_FILTER = ", ".join([_MUTUAL, _sql_knn("f1", 0, 1, K_FILTER), _sql_knn("f2", 1, 0, K_FILTER), "an AS (SELECT * FROM mu WHERE (cellr, cellq) IN (SELECT (src, dst) FROM f1 UNION SELECT (dst, src) FROM f2))"])
_SCORE = f"""{_FILTER}, nb AS (SELECT 'r' AS own, src, 'r' AS side, dst FROM rr WHERE rank <= {K_SCORE} UNION ALL SELECT 'r', src, 'q', dst FROM rq WHERE rank <= {K_SCORE}
  UNION ALL SELECT 'q', src, 'r', dst FROM qr WHERE rank <= {K_SCORE} UNION ALL SELECT 'q', src, 'q', dst FROM qq WHERE rank <= {K_SCORE}),
sh AS (SELECT cellr, cellq, count(*) AS shared FROM an JOIN nb a ON a.own = 'r' AND a.src = cellr JOIN nb b ON b.own = 'q' AND b.src = cellq AND b.side = a.side AND b.dst = a.dst GROUP BY ALL),
qt AS (SELECT quantile_cont(shared, 0.01) AS lo, quantile_cont(shared, 0.9) AS hi FROM sh),
sc AS (SELECT cellr, cellq, CASE WHEN hi = lo THEN 1.0 ELSE greatest(0, least(1, (shared - lo) / (hi - lo))) END AS score FROM sh, qt)"""
_WEIGHT = f"""{_SCORE}, pt AS (SELECT (cellq << 31) + cellr AS anchor_id, cellr, cellq, score, z, v FROM sc JOIN z ON z.side = 1 AND z.ord = cellq),
nw AS (SELECT src AS cellq, anchor_id, score, dist, max(dist) OVER (PARTITION BY src) AS dk, rank, max(rank) OVER (PARTITION BY src) AS n FROM (SELECT a.ord AS src, anchor_id, score, round(1 - list_dot_product(a.z, pt.z), 12) AS dist,
  row_number() OVER (PARTITION BY a.ord ORDER BY round(1 - list_dot_product(a.z, pt.z), 12), anchor_id) AS rank FROM z a, pt WHERE a.side = 1) WHERE rank <= {K_WEIGHT}),
uw AS (SELECT cellq, anchor_id, 1 - exp(-(1 - CASE WHEN dk < 1e-12 THEN CASE WHEN rank = n THEN 1 ELSE 0 END ELSE dist / dk END) * score / 4) AS u FROM nw),
tw AS (SELECT *, sum(u) OVER (PARTITION BY cellq) AS t, row_number() OVER (PARTITION BY cellq ORDER BY anchor_id) AS f FROM uw),
wt AS (SELECT cellq, anchor_id, CASE WHEN t = 0 THEN 'nan'::DOUBLE ELSE u / t END AS w FROM tw WHERE u > 0 OR (t = 0 AND f = 1))"""
_AUTO = "(SELECT greatest(1, CASE WHEN count(*) < 1000 THEN count(*) * 2 // 100 ELSE count(*) * 2 // 1000 END) FROM z WHERE side = 1)"
_TRANSFER = f"""{_E}, {_sql_knn("kn", 1, 0, _AUTO)},
tw AS (SELECT src, dst, dist, exp(-dist / 0.1) / sum(exp(-dist / 0.1)) OVER (PARTITION BY src) AS w FROM kn)"""
_LABEL = f"""{_TRANSFER}, tl AS (SELECT src, label, s FROM (SELECT src, label, sum(w) AS s FROM tw JOIN z ON side = 0 AND ord = dst GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(s, 12) DESC, label) = 1),
mk AS (SELECT src, avg(dist) AS mean_dist, avg(dist) < {MASK} AS keep FROM tw GROUP BY src)"""
_DISCARD = _LABEL.replace(f"avg(dist) < {MASK}", f"avg(dist) < {TELLING}")
_TRUTH = f"{_LABEL}, tt AS (SELECT q.label::VARCHAR AS truth, tl.label::VARCHAR AS label FROM tl JOIN z q ON q.side = 1 AND q.ord = tl.src)"


#: Two of three query cells lie near the reference cell of their number, the third where it was.
_NEAR = _TRANSFER.replace(_E, _E.replace("e AS (SELECT vec_id, vec_id % 2 AS side, vec_id // 2 AS ord, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)", """r AS (SELECT vec_id, vec_id % 2 AS side, vec_id // 2 AS ord, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
e AS (SELECT a.vec_id, a.side, a.ord, a.label, CASE WHEN a.side = 1 AND a.ord % 3 > 0 THEN list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * 0.3 + b.v[i] * 0.7) ELSE a.v END AS v FROM r a JOIN r b ON b.side = 0 AND b.ord = a.ord)""")).replace(_AUTO, "2")
_NEAR_LABEL = f"{_NEAR}, {_LABEL[len(_TRANSFER) + 2 :]}"


def _near_query(spark, sf_dir):
    ref = _ref(spark, sf_dir).select("ord", F.col("v").alias("r"))
    near = F.zip_with("v", "r", lambda q, r: q * 0.3 + r * 0.7)
    return _query(spark, sf_dir).join(ref, "ord").select("ord", F.when(F.col("ord") % 3 > 0, near).otherwise(F.col("v")).alias("v"), "label")


# ------------------------------------------------------------------ neighbours and anchors


@query(f"WITH {_E}, {_sql_knn('k', 1, 0, 80)} SELECT src, dst, rank, round(dist, 6) AS dist FROM k")
def corr_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn(_query(spark, sf_dir), _ref(spark, sf_dir), 80).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_E}, {_sql_knn('k', 1, 0, 80, 'euclidean')} SELECT src, dst, rank, round(dist, 6) AS dist FROM k")
def euclid_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn(_query(spark, sf_dir), _ref(spark, sf_dir), 80, "euclidean").withColumn("dist", F.round("dist", 6))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = _ref(spark, sf_dir)
    return settled(knn.four_way(ref, _query(spark, sf_dir), ref, K))


@query(f"WITH {_NN} SELECT 'rr' AS kind, src, dst, rank, round(dist, 6) AS dist FROM rr UNION ALL SELECT 'qq', src, dst, rank, round(dist, 6) FROM qq UNION ALL SELECT 'rq', src, dst, rank, round(dist, 6) FROM rq UNION ALL SELECT 'qr', src, dst, rank, round(dist, 6) FROM qr")
def four_way_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_NN}, n AS (SELECT count(*) AS r FROM z WHERE side = 0) SELECT src AS i, dst + r AS j FROM rq, n")
def neighbour_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = _ref(spark, sf_dir)
    return knn.indicator(_neighbours(spark, sf_dir).where("kind = 'rq'"), 0, ref.count())


@query(f"WITH {_MUTUAL} SELECT cellr, cellq FROM mu")
def mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mutual(_neighbours(spark, sf_dir), K_ANCHOR)


def _anchors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    near = _neighbours(spark, sf_dir)
    return near, A.filtered(A.mutual(near, K_ANCHOR), _ref(spark, sf_dir), _query(spark, sf_dir), K_FILTER)


@query(f"WITH {_FILTER} SELECT cellr, cellq FROM an")
def filter_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchors(spark, sf_dir)[1]


@query(f"WITH {_SCORE} SELECT cellr, cellq, shared FROM sh")
def score_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.shared_counts(*_anchors(spark, sf_dir), K_SCORE)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(A.scored(*_anchors(spark, sf_dir), K_SCORE))


@query(f"WITH {_SCORE} SELECT cellr, cellq, round(score, 6) AS score FROM sc")
def score_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {_E}, " + ", ".join([_sql_knn("rr", 0, 0, K + 1, "euclidean"), _sql_knn("qq", 1, 1, K + 1), _sql_knn("rq", 0, 1, K, "euclidean"), _sql_knn("qr", 1, 0, K, "euclidean")]) + " SELECT 'rr' AS kind, src, dst, rank, round(dist, 6) AS dist FROM rr UNION ALL SELECT 'qq', src, dst, rank, round(dist, 6) FROM qq UNION ALL SELECT 'rq', src, dst, rank, round(dist, 6) FROM rq UNION ALL SELECT 'qr', src, dst, rank, round(dist, 6) FROM qr")
def four_way_query_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _query(spark, sf_dir)
    return knn.four_way(_ref(spark, sf_dir), q, q, K, reference_first=False).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_E} SELECT a.ord AS src, b.ord AS dst, round(1 - list_dot_product(a.z, b.z), 6) AS dist FROM z a, z b WHERE a.side = 1 AND b.side = 0")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.distances_to(_query(spark, sf_dir), _ref(spark, sf_dir)).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_E}, {_sql_knn('k', 1, 0, 80)} SELECT src, dst, rank, round(dist, 6) AS dist FROM k")
def corr_knn_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of blocks, as for a data side beyond the broadcast's bound."""
    return knn.knn(_query(spark, sf_dir), knn.Vectors(_ref(spark, sf_dir), 1 << 16), 80).withColumn("dist", F.round("dist", 6))


@query(ORACLES["corr_knn"])
def corr_knn_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join through the partition of space, exact."""
    return pivots.Index(_ref(spark, sf_dir), "correlation").search(_query(spark, sf_dir), 80).withColumn("dist", F.round("dist", 6))


@query(ORACLES["euclid_knn"])
def euclid_knn_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.Index(_ref(spark, sf_dir)).search(_query(spark, sf_dir), 80).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_E}, {_sql_knn('k', 1, 0, 20, 'euclidean')} SELECT src, rank, true AS is_pair, true AS within FROM k")
def eps_knn_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For eps 0.1: each returned distance is that of its pair, and at most 1.1 times the exact one of its rank."""
    ref, q, eps = _ref(spark, sf_dir), _query(spark, sf_dir), 0.1
    near = pivots.Index(ref).search(q, 20, eps)
    exact = knn.knn(q, ref, 20, "euclidean").select("src", "rank", F.col("dist").alias("least"))
    square = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = near.join(q.select(F.col("ord").alias("src"), F.col("v").alias("a")), "src").join(ref.select(F.col("ord").alias("dst"), F.col("v").alias("b")), "dst")
    rows = pairs.join(exact, ["src", "rank"])
    return rows.select("src", F.col("rank").cast("long").alias("rank"), (F.abs(F.sqrt(square) - F.col("dist")) < 1e-6).alias("is_pair"), (F.col("dist") <= F.col("least") * (1 + eps) + 1e-9).alias("within"))


# ------------------------------------------------------------------ correction


@query(f"WITH {_SCORE} SELECT cellr, cellq, j - 1 AS feature, round(q.v[j] - r.v[j], 6) AS value FROM sc JOIN z q ON q.side = 1 AND q.ord = cellq JOIN z r ON r.side = 0 AND r.ord = cellr, range(1, 65) t(j)")
def integration_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = correct.differences(_scored(spark, sf_dir).select("cellr", "cellq"), _ref(spark, sf_dir), _query(spark, sf_dir))
    return rows.select("cellr", "cellq", F.posexplode("dv").alias("feature", "x")).select("cellr", "cellq", "feature", F.round("x", 6).alias("value"))


def _weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = settled(correct.numbered(_scored(spark, sf_dir)))
    return found, correct.anchor_weights(found, _query(spark, sf_dir), K_WEIGHT)


@query(f"WITH {_WEIGHT} SELECT cellq, anchor_id, round(w, 6) AS w FROM wt")
def anchor_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir)[1].withColumn("w", F.round("w", 6))


@query(f"""WITH {_WEIGHT}, dv AS (SELECT cellq, j, sum(w * (p.v[j] - r.v[j])) AS s FROM wt JOIN (SELECT anchor_id, cellr, v FROM pt) p USING (anchor_id) JOIN z r ON r.side = 0 AND r.ord = p.cellr, range(1, 65) t(j) GROUP BY ALL)
SELECT ord, i - 1 AS feature, round(v[i] - coalesce(s, 0), 6) AS value FROM (SELECT ord, v, i FROM z, range(1, 65) t(i) WHERE side = 1) LEFT JOIN dv ON dv.cellq = ord AND dv.j = i""")
def corrected_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, q = _ref(spark, sf_dir), _query(spark, sf_dir)
    found, w = _weights(spark, sf_dir)
    return _long(correct.corrected(q, w, correct.anchor_differences(found, ref, q)))


# ------------------------------------------------------------------ transfer


def _transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.transfer_weights(_query(spark, sf_dir), _ref(spark, sf_dir))


@query(f"WITH {_TRANSFER} SELECT src, dst, round(w, 6) AS w FROM tw")
def transfer_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transfer(spark, sf_dir).select("src", "dst", F.round("w", 6).alias("w"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.transfer_labels(_transfer(spark, sf_dir), _ref(spark, sf_dir).select("ord", "label"))


@query(f"WITH {_LABEL} SELECT src, label::VARCHAR AS label, round(s, 6) AS score FROM tl")
def transfer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {_LABEL} SELECT src, round(mean_dist, 6) AS mean_dist, keep FROM mk")
def query_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.query_mask(_transfer(spark, sf_dir), MASK).withColumn("mean_dist", F.round("mean_dist", 6))


@query(f"WITH {_LABEL} SELECT src, CASE WHEN keep THEN label::VARCHAR ELSE 'Not Assigned' END AS label, round(mean_dist, 6) AS mean_dist, keep FROM tl JOIN mk USING (src)")
def masked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = settled(_transfer(spark, sf_dir))
    rows = transfer.masked_labels(transfer.transfer_labels(w, _ref(spark, sf_dir).select("ord", "label")), transfer.query_mask(w, MASK))
    return rows.withColumn("mean_dist", F.round("mean_dist", 6))


@query(f"WITH {_DISCARD} SELECT ord FROM z WHERE side = 1 AND ord IN (SELECT src FROM mk WHERE keep)")
def discard_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.discard(_query(spark, sf_dir), transfer.query_mask(_transfer(spark, sf_dir), TELLING)).select("ord")


@query(f"WITH {_DISCARD}, k AS (SELECT ord, v FROM z WHERE side = 1 AND ord IN (SELECT src FROM mk WHERE keep)) SELECT t AS name, ord, round(v[j], 6) AS value FROM k, (VALUES ('blanks', 1, 2), ('protein', 2, 3), ('protein_clean', 3, 5), ('protein_corrected', 4, 7), ('size', 5, 11), ('spatial', 6, 13), ('transfer', 7, 17)) n(t, j, m) WHERE ord % m > 0")
def discard_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mask = _query(spark, sf_dir), settled(transfer.query_mask(_transfer(spark, sf_dir), TELLING))
    lacking = {"blanks": 2, "protein": 3, "protein_clean": 5, "protein_corrected": 7, "size": 11, "spatial": 13, "transfer": 17}
    tables = {name: rows.where(F.col("ord") % m > 0).select("ord", F.get("v", F.lit(i)).alias(f"{name}_value")) for i, (name, m) in enumerate(lacking.items())}
    out = None
    for name, kept in transfer.discard_everywhere(tables, mask).items():
        kept = kept.select(F.lit(name).alias("name"), "ord", F.round(f"{name}_value", 6).alias("value"))
        out = kept if out is None else out.unionByName(kept)
    return out


# ------------------------------------------------------------------ canonical correlation


@query(f"WITH {_E} SELECT vec_id AS ord, i - 1 AS feature, round(u[i] / sqrt(list_dot_product(u, u) / 63), 6) AS value FROM d, range(1, 65) t(i)")
def cell_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(cca.standardized(_cells(spark, sf_dir)))


@query(f"WITH {_E}, s AS (SELECT list_transform(u, lambda x: x / sqrt(list_dot_product(u, u) / 63)) AS s FROM d WHERE side = 0) SELECT a.i - 1 AS i, b.j - 1 AS j, round(sum(s[a.i] * s[b.j]), 6) AS g FROM s, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cca.gram(_ref(spark, sf_dir))
    return spark.createDataFrame([(i, j, round(float(g[i, j]), 6)) for i in range(len(g)) for j in range(len(g))], "i long, j long, g double")


@query()
def cca_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, q, _ = cca.cca(_ref(spark, sf_dir), _query(spark, sf_dir), 63)
    both = r.select(F.lit("ref").alias("side"), "ord", "v").unionByName(q.select(F.lit("query").alias("side"), "ord", "v"))
    return both.select("side", "ord", F.posexplode("v").alias("component", "x")).select("side", "ord", "component", F.round("x", 6).alias("value"))


@query()
def pca_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(cca.pca(_cells(spark, sf_dir), 2))


@query("SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS g FROM range(0, 63) a(i), range(0, 63) b(j)")
def cca_orthonormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gram matrix of the reference's embedding: singular vectors are orthonormal."""
    r = cca.cca(_ref(spark, sf_dir), _query(spark, sf_dir), 63)[0]
    g = cca.gram(r, standardize=False)
    return spark.createDataFrame([(i, j, round(float(g[i, j]), 6) + 0.0) for i in range(len(g)) for j in range(len(g))], "i long, j long, g double")


@query(f"WITH {_E}, s AS (SELECT side, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u) / 63)) AS s FROM d), g AS (SELECT a.i, b.j, sum(s[a.i] * s[b.j]) FILTER (side = 0) AS r, sum(s[a.i] * s[b.j]) FILTER (side = 1) AS q FROM s, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL) SELECT round(sum(x.r * y.q), 2) AS total FROM g x JOIN g y ON x.i = y.j AND x.j = y.i")
def cca_singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the squared singular values is the trace of the product of both Gram matrices."""
    s = cca.cca(_ref(spark, sf_dir), _query(spark, sf_dir), 63)[2]
    return spark.createDataFrame([(round(float((s**2).sum()), 2),)], "total double")


#: Both Gram matrices' product, squared twelve times over: powers of 4096 leave the largest eigenvalue alone.
_POWERS = ", ".join(f"p{i + 1} AS MATERIALIZED (SELECT x.i, y.j, sum(x.a * y.a) / (SELECT sum(a) FILTER (i = j) FROM p{i}) ** 2 AS a FROM p{i} x JOIN p{i} y ON x.j = y.i GROUP BY ALL)" for i in range(12))


@query(f"WITH {_E}, s AS (SELECT side, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u) / 63)) AS s FROM d), g AS MATERIALIZED (SELECT a.i, b.j, sum(s[a.i] * s[b.j]) FILTER (side = 0) AS r, sum(s[a.i] * s[b.j]) FILTER (side = 1) AS q FROM s, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL), p0 AS MATERIALIZED (SELECT x.i, y.j, sum(x.q * y.r) AS a FROM g x JOIN g y ON x.j = y.i GROUP BY ALL), {_POWERS} SELECT round(sqrt(sum(x.a * y.a) / (SELECT sum(a) FILTER (i = j) FROM p12)), 3) AS largest FROM p12 x JOIN p0 y ON x.i = y.j AND x.j = y.i")
def lanczos_largest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest singular value by restarted bidiagonalisation."""
    s = lanczos.cca_by_lanczos(settled(_ref(spark, sf_dir)), settled(_query(spark, sf_dir)), 1)[2]
    return spark.createDataFrame([(round(float(s[0]), 3),)], "largest double")


@query(f"WITH {_E}, m AS (SELECT i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY i) SELECT round(sum((v[i] - m) ** 2), 4) AS total FROM e JOIN m ON true")
def pca_total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All principal components together have the whole variance."""
    rows = cca.pca(_cells(spark, sf_dir), 64).select(F.explode("v").alias("x"))
    return rows.agg(F.round(F.sum(F.col("x") * F.col("x")), 4).alias("total"))


@query()
def neighbour_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(embed.neighbour_embedding(_cells(spark, sf_dir)))


# ------------------------------------------------------------------ gates and projections


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 1000).alias("y"), F.col("l_linenumber").cast("double").alias("z"), (F.col("l_quantity") * 500).alias("size"), F.array("l_discount", "l_tax").alias("blanks"))


_SPOT = "s AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity * 1000 AS y, l_linenumber::DOUBLE AS z, l_quantity * 500 AS size, l_discount AS b1, l_tax AS b2 FROM lineitem)"


@query(f"WITH {_SPOT} SELECT l_orderkey, l_linenumber FROM s WHERE x < 40000 AND y < 40000")
def border_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.border_filter(_spots(spark, sf_dir), 40000).select("l_orderkey", "l_linenumber")


@query(f"WITH {_SPOT}, m AS (SELECT min(x) AS mx, min(y) AS my FROM s) SELECT l_orderkey, l_linenumber, round((x - (mx - 1)) * 188, 4) AS x, round((y - (my - 1)) * 188, 4) AS y, z * 900 AS z FROM s, m")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gates.unit_convert(_spots(spark, sf_dir))
    return rows.select("l_orderkey", "l_linenumber", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "z")


@query(f"WITH {_SPOT} SELECT l_orderkey, l_linenumber FROM s WHERE (b1 >= 0.04 OR b2 >= 0.06) AND b1 <= 0.09 AND b2 <= 0.07 AND size BETWEEN 1000 AND 22000")
def blank_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.blank_size_gate(_spots(spark, sf_dir), (1000, 22000), (0.04, 0.06), (0.09, 0.07)).select("l_orderkey", "l_linenumber")


@query(f"""WITH {_SPOT}, q AS (SELECT quantile_cont(b1, 0.002) AS l1, quantile_cont(b1, 0.995) AS h1, quantile_cont(b2, 0.002) AS l2, quantile_cont(b2, 0.995) AS h2, quantile_cont(size, 0.025) AS lo, quantile_cont(size, 0.99) AS hi FROM s)
SELECT l_orderkey, l_linenumber FROM s, q WHERE (b1 >= l1 OR b2 >= l2) AND b1 <= h1 AND b2 <= h2 AND size BETWEEN lo AND hi""")
def quantile_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.blank_size_gate(_spots(spark, sf_dir), None, None, None).select("l_orderkey", "l_linenumber")


@query("SELECT vec_id AS ord, label FROM embeddings WHERE vec_id < 100")
def take_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.take_subset(_cells(spark, sf_dir), 100).select("ord", "label")


_TOPS = ", ".join(f"row_number() OVER (ORDER BY v[{f + 1}] DESC, vec_id) <= floor({t} * count(*) OVER ()) AS g{f}" for f, t in ((0, 0.1), (3, 0.05), (1, 0.4), (2, 0.3)))


@query(f"WITH {_E}, g AS (SELECT vec_id, {_TOPS} FROM e) SELECT vec_id AS ord, CASE WHEN g1 AND g2 THEN 3 WHEN g3 THEN 2 WHEN g0 THEN 1 ELSE -1 END AS cluster FROM g")
def marker_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.marker_gate(_cells(spark, sf_dir), GATES)


@query("SELECT ord FROM (SELECT vec_id AS ord, list_transform(embedding, lambda x: CASE WHEN vec_id % 7 = 0 AND x < 0 THEN 'nan'::DOUBLE ELSE x END) AS v FROM embeddings) WHERE len(list_filter(v, lambda x: isnan(x))) = 0")
def drop_nan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh cell has NaN for its negative values."""
    cells = _cells(spark, sf_dir)
    spoilt = F.transform("v", lambda x: F.when((F.col("ord") % 7 == 0) & (x < 0), F.lit(float("nan"))).otherwise(x))
    return gates.drop_nan(cells.withColumn("v", spoilt)).select("ord")


@query(f"WITH {_E} SELECT vec_id AS ord, round(v[6], 6) AS a, round(v[2], 6) AS b FROM e")
def select_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = [f"m{i}" for i in range(64)]
    rows = gates.select_panel(_cells(spark, sf_dir), panel, gates.common_panel(["m5", "x", "m1"], panel))
    return rows.select("ord", F.round(F.get("v", F.lit(0)), 6).alias("a"), F.round(F.get("v", F.lit(1)), 6).alias("b"))


# ------------------------------------------------------------------ cleaning


@query(f"""WITH {_E}, m AS (SELECT min(list_min(v)) AS lo FROM e), s AS (SELECT vec_id, list_transform(v, lambda x: x - (SELECT lo FROM m)) AS v FROM e), t AS (SELECT *, list_sum(v) AS t FROM s), a AS (SELECT avg(t) AS a FROM t)
SELECT vec_id AS ord, i - 1 AS feature, round(CASE WHEN t <> 0 THEN v[i] / t * a ELSE v[i] END, 6) AS value FROM t, a, range(1, 65) r(i)""".replace("list_transform(v, lambda x: x - (SELECT lo FROM m)) AS v FROM e", "list_transform(v, lambda x: x - lo) AS v FROM e, m"))
def total_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(clean.total_normalize(_cells(spark, sf_dir)))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings), s AS (SELECT vec_id, list_transform(v, lambda x: x / list_sum(v)) AS v FROM e WHERE list_sum(v) <> 0),
l AS (SELECT vec_id, i, v[i] AS x FROM s, range(1, 65) r(i)), h AS (SELECT i, min(x) AS lo, max(x) AS hi FROM l GROUP BY i)
SELECT vec_id AS ord, i - 1 AS feature, round(CASE WHEN hi = lo THEN 0 ELSE (x - lo) / (hi - lo) END, 6) AS value FROM l JOIN h USING (i)""")
def ref_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(clean.reference_normalize(_cells(spark, sf_dir).withColumn("v", F.transform("v", lambda x: F.abs(x)))))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("feature"), F.col("l_quantity").alias("value"))


_PMF = """c AS (SELECT l_returnflag AS feature, l_quantity::BIGINT AS value, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT feature, max(value) AS hi, sum(n) AS total FROM c GROUP BY 1),
g AS (SELECT feature, total, unnest(range(0, hi + 1)) AS value FROM t), p AS (SELECT feature, value, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / total AS p FROM g LEFT JOIN c USING (feature, value))"""


@query(f"WITH {_PMF} SELECT feature, value, n, round(p, 6) AS p FROM p")
def nb_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.count_pmf(_counts(spark, sf_dir)).withColumn("p", F.round("p", 6))


@query(f"""WITH {_PMF}, f(feature, size, mean) AS (VALUES {", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in NB)})
SELECT feature, value, round(least(1, sum(exp(lgamma(value + size) - lgamma(value + 1) - lgamma(size) + size * ln(size / (size + mean)) + value * ln(mean / (size + mean)))) OVER (PARTITION BY feature ORDER BY value)), 6) AS cdf FROM p JOIN f USING (feature)""")
def nb_cdf_fixed_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = spark.createDataFrame(list(NB), "feature string, size double, mean double")
    return clean.nb_cdf_table(clean.count_pmf(_counts(spark, sf_dir)), fits).withColumn("cdf", F.round("cdf", 6))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / (10 * sqrt(2)) AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, round(0.5 + list_sum(list_transform(range(0, 40), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(z, 2 * n + 1) / (gamma(n + 1.0) * (2 * n + 1)))) / sqrt(pi()), 6) AS p FROM q""")
def normal_cdf_fixed_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(normal_cdf("l_quantity", F.lit(25.0), F.lit(10.0)), 6).alias("p"))


@query()
def nb_mixture_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.nb_fits(_counts(spark, sf_dir))


@query()
def gaussian_mixture_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(clean.clean_query(_cells(spark, sf_dir)))


@query()
def negative_binomial_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _cells(spark, sf_dir).withColumn("v", F.transform("v", lambda x: F.floor(F.abs(x) * 20).cast("double")))
    return _long(clean.clean_reference(counts)[0])


# ------------------------------------------------------------------ annotation and evaluation


@query(f"WITH {_E} SELECT label AS cluster, i - 1 AS feature, round(avg(least(v[i], 0.1)), 6) AS mean FROM e, range(1, 65) r(i) GROUP BY ALL")
def cluster_means_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return annotate.cluster_means(cells.select("ord", "v"), cells.select("ord", F.col("label").alias("cluster")), 0.1).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_E} SELECT label AS cluster, round(avg(v[1]), 6) AS f0, round(avg(v[2]), 6) AS f1 FROM e GROUP BY ALL")
def cluster_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    wide = annotate.heatmap(annotate.cluster_means(cells.select("ord", "v"), cells.select("ord", F.col("label").alias("cluster"))).where("feature < 2"), [0, 1])
    return wide.select("cluster", F.round("0", 6).alias("f0"), F.round("1", 6).alias("f1"))


@query(f"WITH {_E}, g(i, gene) AS (VALUES {', '.join(f"({i + 1}, '{g}')" for i, g in enumerate(annotate.DEFAULT_GENES))}) SELECT label AS cluster, gene, round(avg(least(v[i] * 100, 10)), 6) AS mean FROM e, g GROUP BY ALL")
def default_gene_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("v", F.transform("v", lambda x: x * 100))
    panel = [*annotate.DEFAULT_GENES, *(f"other{i}" for i in range(64 - len(annotate.DEFAULT_GENES)))]
    return annotate.gene_means(cells, panel, cells.select("ord", F.col("label").alias("cluster"))).withColumn("mean", F.round("mean", 6))


@query("SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.cluster_sizes(_cells(spark, sf_dir).select(F.col("label").alias("cluster")))


@query("SELECT vec_id AS ord, label - 1 AS cluster, CASE WHEN label = 0 THEN '' WHEN label = 1 THEN 'B' WHEN label = 3 THEN 'T' ELSE '' END AS name FROM embeddings")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(0, "B"), (2, "T"), (-1, "noise")], "cluster int, name string")
    return annotate.named(_cells(spark, sf_dir).select("ord", (F.col("label") - 1).alias("cluster")), names).select("ord", "cluster", "name")


@query("WITH s AS (SELECT value AS score FROM events), m AS (SELECT min(score) AS lo, max(score) AS hi FROM s) SELECT least(floor((score - lo) / (hi - lo) * 100), 99)::INT AS bin, count(*) AS n FROM s, m GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.score_histogram(_table(spark, sf_dir, "events").select(F.col("value").alias("score")))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _query(spark, sf_dir).select(F.col("ord").alias("src"), F.col("label").cast("string").alias("truth"))
    return _labels(spark, sf_dir).select("src", "label").join(truth, "src")


@query(f"WITH {_TRUTH} SELECT t.truth AS type, round(count(*) FILTER (a.truth = t.truth AND a.label = t.truth) / count(*) FILTER (a.truth = t.truth), 6) AS tpr, round(count(*) FILTER (a.truth <> t.truth AND a.label <> t.truth) / nullif(count(*) FILTER (a.truth <> t.truth), 0), 6) AS tnr FROM (SELECT DISTINCT truth FROM tt) t, tt a GROUP BY 1")
def tpr_tnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.rates(_truth(spark, sf_dir)).select("type", F.round("tpr", 6).alias("tpr"), F.round("tnr", 6).alias("tnr"))


def _sql_majority(by: str, label: str) -> str:
    return f"""WITH {_TRUTH}, k AS (SELECT {by} AS g, {label} AS l, count(*) AS n FROM tt GROUP BY ALL), y AS (SELECT *, sum(n) OVER (PARTITION BY g) AS size FROM k)
SELECT g AS {by}, l AS best, n, size::BIGINT AS size, round(100 * n / size, 6) AS share FROM y QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, l) = 1"""


@query(_sql_majority("truth", "label"))
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.majority(_truth(spark, sf_dir), "truth", "label").withColumnRenamed("label", "best").withColumn("share", F.round("share", 6))


@query(_sql_majority("label", "truth"))
def cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotate.majority(_truth(spark, sf_dir).withColumnRenamed("label", "cluster"), "cluster", "truth")
    return rows.withColumnRenamed("label", "best").withColumnRenamed("cluster", "label").withColumn("share", F.round("share", 6))


@query(f"WITH {_TRUTH}, n AS (SELECT truth = label AS agree FROM tt) SELECT agree, count(*) AS n FROM n GROUP BY 1")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.agreement(_truth(spark, sf_dir)).groupBy("agree").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ clustering


@query(f"""WITH {_E}, k AS (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_dot_product(a.z, b.z), 12), b.vec_id) AS r
  FROM (SELECT side + 2 * ord AS vec_id, z FROM z) a, (SELECT side + 2 * ord AS vec_id, z FROM z) b WHERE a.vec_id <> b.vec_id QUALIFY r <= 29)
SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS w FROM k GROUP BY ALL""")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.knn_edges(_cells(spark, sf_dir))


@query(f"""WITH {_E}, p AS (SELECT a.side + 2 * a.ord AS i, a.label AS la, b.label AS lb, 1 - list_dot_product(a.z, b.z) AS dist FROM z a, z b WHERE a.side + 2 * a.ord <> b.side + 2 * b.ord),
m AS (SELECT i, la, lb, avg(dist) AS m FROM p GROUP BY ALL), s AS (SELECT i, min(m) FILTER (la = lb) AS a, min(m) FILTER (la <> lb) AS b FROM m GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS score FROM s""")
def silhouette_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return cluster.silhouettes(cells, cells.select("ord", "label")).select(F.round("score", 6).alias("score"))


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.graph_clusters(_cells(spark, sf_dir))


@query(f"""WITH {_E}, k AS (SELECT a.side + 2 * a.ord AS src, b.side + 2 * b.ord AS dst, row_number() OVER (PARTITION BY a.side, a.ord ORDER BY round(1 - list_dot_product(a.z, b.z), 12), b.side + 2 * b.ord) AS r
  FROM z a, z b WHERE (a.side, a.ord) <> (b.side, b.ord) QUALIFY r <= 29), l AS (SELECT vec_id, label FROM e),
g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*)::DOUBLE AS w FROM k GROUP BY ALL), h AS (SELECT x.label AS x, y.label AS y, w FROM g JOIN l x ON x.vec_id = a JOIN l y ON y.vec_id = b),
per AS (SELECT l, sum(w) AS mass, sum(i) AS inside FROM (SELECT x AS l, w, CASE WHEN x = y THEN w ELSE 0 END AS i FROM h UNION ALL SELECT y, w, CASE WHEN x = y THEN w ELSE 0 END FROM h) GROUP BY 1)
SELECT sum(mass) / 2 AS weight, count(*) AS communities, round(sum(inside) / sum(mass) - sum(mass * mass) / sum(mass) ** 2, 9) AS modularity FROM per""")
def label_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of the given labels on the neighbour graph."""
    cells = _cells(spark, sf_dir)
    return communities.modularity(cluster.knn_edges(cells), cells.select("ord", F.col("label").alias("cluster"))).withColumn("modularity", F.round("modularity", 9))


@query()
def communities_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the neighbour graph, every level made of distributed rounds."""
    return cluster.graph_clusters(_cells(spark, sf_dir), small=0)


@query(f"""WITH {_E}, p AS (SELECT a.ord, round(1 - list_dot_product(a.z, b.z), 12) AS d, row_number() OVER (PARTITION BY a.ord ORDER BY round(1 - list_dot_product(a.z, b.z), 12), b.ord) AS r FROM z a, z b WHERE a.side = 0 AND b.side = 0 AND a.ord <> b.ord)
SELECT ord, round(d, 6) AS core FROM p WHERE r = 9""")
def core_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _ref(spark, sf_dir)
    return density.core_distances(knn.knn(cells, cells, 15, drop_self=True), cells, 10).withColumn("core", F.round("core", 6))


#: Prim's algorithm: a step takes the least distance to the tree and brings every distance up to date.
_PRIM = f"""WITH RECURSIVE {_E}, p AS (SELECT a.ord AS a, b.ord AS b, greatest(0, round(1 - list_dot_product(a.z, b.z), 12)) AS d FROM z a, z b WHERE a.side = 0 AND b.side = 0),
k AS (SELECT a, d AS core FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p WHERE a <> b) WHERE r = 9),
m AS MATERIALIZED (SELECT p.a, list(greatest(p.d, x.core, y.core) ORDER BY p.b) AS row FROM p JOIN k x ON x.a = p.a JOIN k y ON y.a = p.b GROUP BY 1),
t AS (SELECT 1::BIGINT AS n, 0.0::DOUBLE AS total, row AS best, [0::BIGINT] AS inside FROM m WHERE a = 0
  UNION ALL SELECT n + 1, total + least_d, list_transform(range(1, len(best) + 1), lambda i: least(best[i], m.row[i])), list_append(inside, next) FROM
  (SELECT n, total, best, inside, list_min(list_transform(range(1, len(best) + 1), lambda i: CASE WHEN list_contains(inside, i - 1) THEN NULL ELSE {{'d': best[i], 'i': i - 1}} END)).d AS least_d,
   list_min(list_transform(range(1, len(best) + 1), lambda i: CASE WHEN list_contains(inside, i - 1) THEN NULL ELSE {{'d': best[i], 'i': i - 1}} END)).i AS next FROM t WHERE n < len(best)) JOIN m ON m.a = next)
SELECT n - 1 AS edges, round(total, 6) AS weight FROM t ORDER BY n DESC LIMIT 1"""


@query(_PRIM)
def reach_tree_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and weight of the minimum spanning tree of mutual reachability, made in distributed rounds."""
    return density.reach_tree(_ref(spark, sf_dir), 10).agg(F.count("*").alias("edges"), F.round(F.sum("d"), 6).alias("weight"))


@query()
def hdbscan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.density_grid(_ref(spark, sf_dir), range(5, 21, 4), range(10, 41, 3))


@query()
def parameter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integration.scan(_ref(spark, sf_dir))[1]


@query()
def query_scan_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integration.cluster_cells(_query(spark, sf_dir), 2)


@query()
def query_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integration.cluster_cells(_query(spark, sf_dir), 3)


@query()
def query_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integration.cluster_cells(_query(spark, sf_dir), 5)


@query()
def reference_scan_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integration.cluster_reference(_ref(spark, sf_dir), 1)


@query()
def reference_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integration.cluster_reference(_ref(spark, sf_dir), 2)


@query()
def reference_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integration.cluster_reference(_ref(spark, sf_dir), 3)


@query()
def refined_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir, 0)
    return cluster.refined_clusters(cells, cells.select("ord", F.col("label").alias("cluster")))


_RUNS = "l AS (SELECT r AS run, vec_id AS ord, CASE WHEN (vec_id + r) % 11 = 0 THEN -1 ELSE (vec_id // (r + 3)) % 20 END AS label, r / 10 AS score FROM embeddings, range(0, 6) t(r))"


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = F.col("run")
    rows = _cells(spark, sf_dir).select("ord", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("run"))
    labels = rows.select("run", "ord", F.when((F.col("ord") + r) % 11 == 0, -1).otherwise(F.floor(F.col("ord") / (r + 3)) % 20).alias("label"))
    return labels, spark.range(6).select(F.col("id").cast("int").alias("run"), (F.col("id") / 10).alias("score"))


@query(f"WITH {_RUNS} SELECT x.ord AS a, y.ord AS b, round(1 - count(*) / 4, 6) AS d FROM l x JOIN l y ON x.run = y.run AND x.label = y.label AND x.label <> -1 AND x.ord < y.ord AND x.score >= 0.2 GROUP BY ALL")
def consensus_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.consensus_distance(*_runs(spark, sf_dir), 0.2).withColumn("d", F.round("d", 6))


_CLASSES = f"{_RUNS}, w AS (SELECT ord, list(label ORDER BY run) AS s FROM l WHERE score >= 0.2 GROUP BY 1), c AS (SELECT s, min(ord) AS node, count(*) AS size FROM w GROUP BY 1)"


@query(f"WITH {_CLASSES} SELECT ord, node, size, round(len(list_filter(s, lambda x: x <> -1)) / 4, 6) AS own FROM w JOIN c USING (s)")
def consensus_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's class of cells that the kept runs treat alike."""
    labels, scores = _runs(spark, sf_dir)
    members, classes = consensus.consensus_classes(labels, *consensus.kept_runs(scores, 0.2))
    return members.join(classes, "node").select("ord", "node", "size", F.round("own", 6).alias("own"))


@query(f"WITH {_CLASSES} SELECT x.node AS a, y.node AS b, round(1 - len(list_filter(list_zip(x.s, y.s), lambda p: p[1] = p[2] AND p[1] <> -1)) / 4, 6) AS d FROM c x JOIN c y ON x.node < y.node AND len(list_filter(list_zip(x.s, y.s), lambda p: p[1] = p[2] AND p[1] <> -1)) > 0")
def consensus_class_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between classes, a row per pair that some run joins."""
    labels, scores = _runs(spark, sf_dir)
    runs, many = consensus.kept_runs(scores, 0.2)
    return consensus.class_distances(consensus.consensus_classes(labels, runs, many)[1], many).withColumn("d", F.round("d", 6))


@query(f"WITH {_RUNS}, m AS (SELECT label, dense_rank() OVER (ORDER BY label) AS c FROM (SELECT DISTINCT label FROM l WHERE run = 2 AND label <> -1)) SELECT ord, coalesce(c, -1)::INT AS cluster FROM l LEFT JOIN m USING (label) WHERE run = 2")
def consensus_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.relabel(_runs(spark, sf_dir)[0].where("run = 2").select("ord", "label"))


@query(f"WITH {_RUNS}, m AS (SELECT label, dense_rank() OVER (ORDER BY label) AS c FROM (SELECT DISTINCT label FROM l WHERE run = 2 AND label <> -1)) SELECT ord, c::INT AS cluster FROM l JOIN m USING (label) WHERE run = 2")
def without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.without_noise(cluster.relabel(_runs(spark, sf_dir)[0].where("run = 2").select("ord", "label")))


@query()
def consensus_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.consensus(*_runs(spark, sf_dir), 0.2, inconsistent=0.5, min_size=3)


# ------------------------------------------------------------------ sources and sinks


def _csv(cells: DataFrame, panel: list[str], name: str) -> str:
    to = fresh_path(cells.sparkSession, name)
    sources.write_wide(cells, panel, to)
    return to


def _named_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).withColumn("cell_id", F.concat(F.lit("c"), F.col("ord").cast("string")))


_FILES = "SELECT 'c' || vec_id AS cell_id, t AS name, i - a AS feature, round(v[i], 6) AS value FROM e, (VALUES ('latent', 1, 10), ('protein', 11, 40), ('mrna', 41, 64)) p(t, a, z), range(1, 65) r(i) WHERE i BETWEEN a AND z"


@query(f"WITH {_E} {_FILES}")
def reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three CSV files of the reference set, written and read back."""
    cells, out = _named_cells(spark, sf_dir), None
    parts = {"latent": (1, 10), "protein": (11, 30), "mrna": (41, 24)}
    paths = {name: _csv(cells.withColumn("v", F.slice("v", a, n)), [f"{name}{i}" for i in range(n)], name) for name, (a, n) in parts.items()}
    for name, (rows, panel) in sources.read_reference(spark, **paths).items():
        assert len(panel) == parts[name][1]
        rows = rows.select("cell_id", F.lit(name).alias("name"), F.posexplode("v").alias("feature", "x")).select("cell_id", "name", "feature", F.round("x", 6).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {_SPOT.replace("s AS (", "a AS (", 1)}, s AS (SELECT l_orderkey, l_linenumber, max(x) AS x, max(y) AS y, max(z) AS z, max(size) AS size, max(b1) AS b1, max(b2) AS b2 FROM a GROUP BY ALL),
m AS (SELECT min(x) AS mx, min(y) AS my FROM s), t AS (SELECT l_orderkey || '-' || l_linenumber AS cell_id, size, b1, b2, (x - (mx - 1)) * 188 AS x, (y - (my - 1)) * 188 AS y, z * 900 AS z FROM s, m)
SELECT cell_id, size AS protein, b1, b2, size, round(x, 4) AS x, round(y, 4) AS y, z FROM t WHERE x < 5640000 AND y < 5640000""")
def query_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four CSV files of the query set, written, read back, joined, converted to nm and cut at the border."""
    first, second = F.get("blanks", F.lit(0)), F.get("blanks", F.lit(1))
    spots = _spots(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("x", "y", "z", "size")), F.array(F.max(first), F.max(second)).alias("blanks"))
    spots = spots.withColumn("cell_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    wide = lambda *c: spots.select("cell_id", F.array(*(F.col(x).cast("double") if isinstance(x, str) else x for x in c)).alias("v"))
    blanks = _csv(wide(first.cast("double"), second.cast("double")), ["b1", "b2"], "blanks")
    files = [blanks, _csv(wide("size"), ["protein"], "protein"), _csv(wide("size"), ["size"], "size"), _csv(wide("x", "y", "z"), ["x", "y", "z"], "spatial")]
    rows, _ = sources.read_query(spark, *files, convert=True, border=5640000)
    at = lambda c, i: F.get(c, F.lit(i))
    return rows.select("cell_id", at("v", 0).alias("protein"), at("blanks", 0).alias("b1"), at("blanks", 1).alias("b2"), "size", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "z")


@query(f"WITH {_E} SELECT vec_id::VARCHAR AS cell_id, vec_id AS ord, round(v[1], 6) AS a, round(v[3], 6) AS b FROM e")
def wide_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells from a table in memory, numbered in its order."""
    table = _cells(spark, sf_dir).orderBy("ord").select("ord", *(F.get("v", F.lit(i)).alias(f"m{i}") for i in range(3)))
    rows = sources.from_wide(table.withColumnRenamed("ord", "cell"), "cell", ["m0", "m2"])
    return rows.select("cell_id", "ord", F.round(F.get("v", F.lit(0)), 6).alias("a"), F.round(F.get("v", F.lit(1)), 6).alias("b"))


@query("SELECT 'c' || vec_id AS cell_id, label::VARCHAR AS label FROM embeddings")
def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = fresh_path(spark, "labels")
    _named_cells(spark, sf_dir).select("cell_id", "label").write.option("header", True).csv(to)
    return sources.read_labels(spark, to)


@query("SELECT n_nationkey AS cluster, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def cluster_name_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines ``name: i, j, k``, written and read back."""
    to = fresh_path(spark, "names")
    nations = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = nations.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list(F.col("n_nationkey").cast("string"))), ", ").alias("k"))
    lines.select(F.concat_ws(": ", "r_name", "k").alias("value")).write.text(to)
    return sources.read_cluster_names(spark, to)


# ------------------------------------------------------------------ whole pipelines


@query()
def map_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(integration.map_query(_query(spark, sf_dir), _ref(spark, sf_dir)).corrected)


@query()
def integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = _ref(spark, sf_dir)
    return integration.integrate(_query(spark, sf_dir), ref, ref.select("ord", "label"), p=Params())


@query(f"WITH {_NEAR_LABEL} SELECT tl.src, CASE WHEN keep THEN label::VARCHAR ELSE 'Not Assigned' END AS label, round(mean_dist, 6) AS mean_dist, keep FROM tl JOIN mk USING (src)")
def near_masked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and mask of a query that lies near the reference for two cells of three."""
    ref = _ref(spark, sf_dir)
    w = settled(transfer.transfer_weights(_near_query(spark, sf_dir), ref, 2))
    out = transfer.masked_labels(transfer.transfer_labels(w, ref.select("ord", "label")), transfer.query_mask(w))
    return out.select("src", "label", F.round("mean_dist", 6).alias("mean_dist"), "keep")


@query(ORACLES["near_masked_labels"])
def streamed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same labels for a stream of the query's files, one file a batch, written and read back."""
    source, path = fresh_path(spark, "stream"), fresh_path(spark, "labelled")
    _near_query(spark, sf_dir).select("ord", "v").repartition(3, "ord").write.parquet(source)
    cells = spark.readStream.schema("ord long, v array<double>").option("maxFilesPerTrigger", 1).parquet(source)
    ref = _ref(spark, sf_dir)
    label_batches(cells, ref, ref.select("ord", "label"), path, fresh_path(spark, "offsets"), 2).awaitTermination()
    return spark.read.parquet(path).select("src", "label", F.round("mean_dist", 6).alias("mean_dist"), "keep")


@query()
def near_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline on that query: each query cell with its mask and cluster."""
    panel = [f"m{i}" for i in range(64)]
    out = integration.pipeline(_near_query(spark, sf_dir), panel, _ref(spark, sf_dir), panel, prepared=True, k=2)
    return out.mask.join(out.query_clusters.withColumnRenamed("ord", "src"), "src", "left").select("src", "keep", F.round("mean_dist", 6).alias("mean_dist"), "cluster")


@query()
def whole_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subset, map, transfer, mask, discard and cluster prepared sets: each query cell with its mask and cluster."""
    panel = [f"m{i}" for i in range(64)]
    out = integration.pipeline(_query(spark, sf_dir), panel, _ref(spark, sf_dir), panel, prepared=True)
    return out.mask.join(out.query_clusters.withColumnRenamed("ord", "src"), "src", "left").select("src", "keep", F.round("mean_dist", 6).alias("mean_dist"), "cluster")

"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every rule compares one measure of a document with a cutoff. Cutoffs come from labelled documents that no
cutoff was fitted to: in each stratum (language) a rule's grid is tested from the loosest cutoff on, and a
cutoff passes when the exact binomial test at level ``delta / (strata * rules)`` says that it rejects fewer than
``alpha / rules`` of the good documents. Testing stops at the first failure (fixed-sequence testing), so with
probability 1 - delta no stratum loses more than alpha of its good documents. Among passing cutoffs the one
that catches most bad documents for the good ones it costs is taken; a rule without one is off there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rule: (measure of the columns, ascending cutoffs); a document above the cutoff fails it.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0, 3.0)),
    "shouting": ("n_bang / n_words", (0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0)),
    "capitals": ("n_upper / word_chars", (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    "lines": ("n_dup_lines / n_lines", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    "repeats": ("n_repeat_words / n_words", (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18)),
    "long_words": ("word_chars / n_words", (7.0, 7.5, 8.0, 8.5, 9.0, 9.5, 10.0, 11.0, 12.0, 14.0, 17.0, 20.0)),
}
STRATA = ("en", "de", "fr", "es")
COST = 4


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, n_upper, n_bang, n_lines and base_failed.

    A null text has no words and fails. A repeated window is screened by its hash and settled by its words, so
    n_repeat_words is exact; only documents with a repeat sort their windows.
    """
    rows = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    bare = F.translate("_t", SPACE, "")
    rows = rows.withColumn("_s", F.expr(r"trim(BOTH ' \t\n\u000b\u000c\r' FROM _t)"))
    rows = rows.withColumn("_w", F.when(F.col("_s") != "", F.split("_s", r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, SPACE, "") != "")
    rows = rows.withColumn("_l", lines)
    rows = rows.withColumn("_n", F.size("_w"))
    window = F.transform(F.sequence(F.lit(0), F.col("_n") - 5), lambda i: F.xxhash64(*(F.get("_w", i + j) for j in range(5))))
    rows = rows.withColumn("_h", F.when(F.col("_n") >= 6, window))
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    keyed = F.transform(F.sequence(F.lit(0), F.col("_n") - 5), lambda i: F.struct(F.array_join(F.slice("_w", i + 1, 5), " ").alias("k"), i.alias("i")))
    rows = rows.withColumn("_k", F.when(repeated, F.sort_array(keyed)))
    twice = F.filter("_k", lambda x, j: (x["k"] == F.get("_k", j - 1)["k"]) | (x["k"] == F.get("_k", j + 1)["k"]))
    rows = rows.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda j: F.least(F.lit(5), F.get("_p", j) - F.get("_p", j - 1)))
    covered = F.when(F.size("_p") >= 2, F.lit(5) + F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))
    rows = rows.select(
        *docs.columns,
        F.col("_n").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        _count(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        _count(F.col("_t"), UPPER).alias("n_upper"),
        _count(F.col("_t"), "!").alias("n_bang"),
        F.size("_l").cast("long").alias("n_lines"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _measure(rule: str) -> Column:
    a, b = RULES[rule][0].split(" / ")
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def stratum(lang: str = "lang") -> Column:
    return F.when(F.col(lang).isin(*STRATA), F.col(lang)).otherwise("other")


def _log_gamma(z: Column) -> Column:
    """Stirling's series at z + 8, stepped back; absolute error below 1e-11 for z >= 1."""
    y = z + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    back = F.lit(0.0)
    for k in range(8):
        back = back + F.log(z + k)
    return series - back


def binomial_tail(n: Column, x: Column, p: float) -> Column:
    """P(Bin(n, p) <= x) for x < n p, else 1: exact but for terms far below x, which are bounded from above."""
    n, x = n.cast("double"), x.cast("double")
    log_pmf = lambda k: _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    low = F.greatest(F.lit(0.0), x - F.ceil(40 + 12 * F.sqrt(n * p)))
    terms = F.transform(F.sequence(low.cast("long"), x.cast("long")), lambda k: F.exp(log_pmf(k.cast("double"))))
    total = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) + low * F.exp(log_pmf(low))
    return F.when(x < n * p, total).otherwise(F.lit(1.0))


def calibrate(stats: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, id_col: str = "doc_id") -> DataFrame:
    """stratum, rule, cutoff, good, false_rejected, bad, caught, p_value, passed, chosen for every grid point.

    ``labels`` has the id and quality (0 or 1); of several labels of a document the worst counts, a null one
    does not. Documents that the base rules reject take no part.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy(id_col).agg((F.min("quality") >= 1).alias("good"))
    rows = stats.where(~F.col("base_failed")).join(known, id_col).withColumn("stratum", stratum())
    level = lambda rule: F.size(F.filter(F.array(*map(F.lit, RULES[rule][1])), lambda c: _measure(rule) > c))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES)))
    counts = rows.select("stratum", "good", each.alias("x")).groupBy("stratum", "x.rule", "x.level").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    grid = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(i).alias("level"), F.lit(c).cast("double").alias("cutoff")) for r in RULES for i, c in enumerate((None, *RULES[r][1])))))
    every = counts.select("stratum").distinct().select("stratum", grid.alias("x")).select("stratum", "x.*")
    every = every.join(counts, ["stratum", "rule", "level"], "left").fillna(0, ["g", "b"])
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stratum", "rule")
    every = every.select("stratum", "rule", "level", "cutoff", F.sum("g").over(down).alias("false_rejected"), F.sum("b").over(down).alias("caught"), F.sum("g").over(whole).alias("good"), F.sum("b").over(whole).alias("bad"))
    every = every.where("level > 0").withColumn("p_value", binomial_tail(F.col("good"), F.col("false_rejected"), alpha / len(RULES)))
    every = every.withColumn("passed", F.min(F.col("p_value") <= delta / ((len(STRATA) + 1) * len(RULES))).over(down))
    gain = F.when(F.col("passed"), F.col("caught") - COST * F.col("false_rejected"))
    every = every.withColumn("gain", gain)
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc_nulls_last("gain"), F.desc("level"))
    return every.withColumn("chosen", (F.row_number().over(best) == 1) & F.coalesce(F.col("gain") > 0, F.lit(False))).drop("gain")


def cutoffs(table: DataFrame) -> DataFrame:
    """One row per stratum, at most five: the chosen cutoff of each rule, null where the rule is off."""
    return table.groupBy("stratum").agg(*(F.max(F.when(F.col("chosen") & (F.col("rule") == r), F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))


def judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` of :func:`measured` with ``kept``. The strata are a fixed list, so ``cuts`` has at most five rows."""
    out = rows.withColumn("stratum", stratum()).join(F.broadcast(cuts), "stratum", "left")
    fired = F.lit(False)
    for r in RULES:
        fired = fired | F.coalesce(_measure(r) > F.col(f"cut_{r}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~fired).drop("stratum", *(f"cut_{r}" for r in RULES))


def quality(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Per document of (doc_id, text, lang): the measures, base_failed and kept.

    Counts of every document are written once and read twice. Repeated rows each give a row; a null id takes
    no part in calibration; a null language belongs to the stratum "other".
    """
    stats = written(measured(docs.select("doc_id", "lang", "text")).drop("text"), "quality")
    cuts = cutoffs(calibrate(stats, labels.select("doc_id", "quality"), alpha, delta))
    return judged(stats, cuts).drop("lang")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Every text is measured once: rows and measures are written, calibrated on the measures alone, and judged as they
    are read again; texts are never shuffled. Nulls, empty texts and repeated rows as in :func:`quality`; without
    labels only the base rules act.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    stats = written(measured(docs.select("doc_id", "lang", "text", whole)).drop("text"), "quality")
    cuts = written(cutoffs(calibrate(stats.drop("_row"), labels.select("doc_id", "quality"), alpha, delta)), "cutoffs")
    return judged(stats, cuts).where("kept").select("_row.*")


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, p) > 1),
rep AS (SELECT doc_id, count(DISTINCT x) AS r FROM (SELECT doc_id, unnest(range(i, i + 5)) AS x FROM dup) GROUP BY 1),
s AS (SELECT doc_id, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END AS stratum, len(w)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
  (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
  (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bang, len(l)::BIGINT AS n_lines
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
m AS (SELECT doc_id, stratum, base_failed, unnest([%(measures)s]) AS x FROM b),
known AS (SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
grid AS (SELECT unnest([%(grid)s]) AS g),
c AS (SELECT stratum, g.rule AS rule, g.level AS level, g.cutoff AS cutoff,
  count(*) FILTER (good AND x.v > g.cutoff) AS fr, count(*) FILTER (NOT good AND x.v > g.cutoff) AS caught, count(*) FILTER (good) AS n
  FROM m JOIN known USING (doc_id) JOIN grid ON g.rule = x.rule WHERE NOT base_failed GROUP BY ALL),
p AS (SELECT *, CASE WHEN fr < n * %(alpha)s THEN (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(%(alpha)s) + (n - k) * ln(1 - %(alpha)s))) FROM (SELECT unnest(range(0, fr + 1)) AS k)) ELSE 1 END AS pv FROM c),
q AS (SELECT *, bool_and(pv <= %(level)s) OVER (PARTITION BY stratum, rule ORDER BY level DESC) AS passed FROM p),
best AS (SELECT stratum, rule, cutoff FROM q WHERE passed AND caught - %(cost)s * fr > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - %(cost)s * fr DESC, level DESC) = 1),
fired AS (SELECT doc_id, bool_or(x.v > cutoff) AS fired FROM m JOIN best ON best.stratum = m.stratum AND best.rule = x.rule GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_bang, n_lines, base_failed,
  NOT base_failed AND NOT coalesce(fired, false) AS kept
FROM b LEFT JOIN fired USING (doc_id)"""


def oracle(alpha: float = 0.05, delta: float = 0.05) -> str:
    """DuckDB SQL of :func:`quality` for documents with different ids."""
    value = lambda r: "coalesce({}::DOUBLE / nullif({}, 0), 0)".format(*RULES[r][0].split(" / "))
    return ORACLE % {
        "measures": ", ".join(f"{{'rule': '{r}', 'v': {value(r)}}}" for r in RULES),
        "grid": ", ".join(f"{{'rule': '{r}', 'level': {i}, 'cutoff': {c}::DOUBLE}}" for r in RULES for i, c in enumerate(RULES[r][1], 1)),
        "alpha": repr(alpha / len(RULES)),
        "level": repr(delta / ((len(STRATA) + 1) * len(RULES))),
        "cost": COST,
    }

"""The trie of conversations' common beginnings, by partition refinement.

All conversations start in one class, the root. In each round every class that has more than one member is split by its
members' next turn; the parts are the trie's nodes of that depth. A part of one member retires: its remaining turns are a
chain of nodes that nothing branches from, written for all retired members at once. A round reads only the turns
of its depth. When no class is left, the rounds are folded back from the deepest: children are summed into their parents.

A node is named by its depth and its smallest member, of which a depth has one each. A class may have a third of all
members: its count and smallest member combine before the shuffle, and members learn their part by a broadcast of the
largest parts, of which there are ``LARGEST`` at most whatever the corpus (each holds a share of 1/LARGEST), the rest
by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, written

#: A part is broadcast if it has more than 1/LARGEST of the round's rows.
LARGEST = 1000
#: Depths that are folded in one plan.
FOLD = 4
#: Ids whose list is one string in the hash of a node's ends: bounded whatever the number of members.
_RUN = 4096
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, pos, turn key and chars of ``rows``: turns from 1 in order, nulls first, ties by role and hash of the text.

    The key is a 128-bit hash of role and text (null as empty). Texts end here: only hashes and lengths are shuffled.
    Rows without conv_id belong to no conversation and are left out. A conversation of very many turns is numbered in one
    task, streamed from a sort that spills.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("h"), key.alias("key"), F.length(text).cast("long").alias("chars"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "h")
    return rows.select("conv_id", F.row_number().over(w).cast("long").alias("pos"), "key", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (conv_id, length) and turns (conv_id, pos, key, chars) of conversations that begin as their hundred's first.

    Conversation c takes the first h = crc32(c) mod 6 turns of c - c mod 100, then its own after its first h.
    ``turns`` is what :func:`numbered` gives. A leader serves 100 conversations (199 around zero), so no join is skewed.
    """
    count = turns.groupBy("conv_id").agg(F.count("*").alias("own"), F.count(F.when(F.col("pos") <= 5, 1)).alias("head"))
    ids = count.select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("leader"))
    ids = ids.join(count.select(F.col("conv_id").alias("leader"), "head"), "leader", "left")
    ids = ids.withColumn("lead", F.least("h", F.coalesce("head", F.lit(0)))).select("conv_id", "leader", "h", "lead", (F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    head = turns.where("pos <= 5").withColumnRenamed("conv_id", "leader").join(ids.select("conv_id", "leader", "h"), "leader").where("pos <= h").select("conv_id", "pos", "key", "chars")
    tail = turns.join(ids.select("conv_id", "h", "lead"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "key", "chars")
    return ids.select("conv_id", "length"), head.unionByName(tail)


def _ends(members: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of ``members`` (depth, node, conv_id): a hash over each node's ids in order.

    Ids are first joined in runs of at most _RUN different ids, so that the task that hashes a node's runs in order
    (it streams them from a sort) reads few rows however many members a node has.
    """
    run = F.floor(F.col("conv_id") / _RUN)
    runs = members.withColumn("run", run).groupBy("depth", "node", "run").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out = []
            for depth, node, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (depth, node) != now:
                    if sha is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (depth, node), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield batch(out)
        if sha is not None:
            yield batch([(*now, sha.hexdigest())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "node", "ends_sha256"])

    ordered = runs.repartition("depth", "node").sortWithinPartitions("depth", "node", "run").select("depth", "node", "ids")
    return ordered.mapInArrow(hashes, "depth long, node long, ends_sha256 string")


def _parts(rows: DataFrame, parts: DataFrame, floor: int) -> DataFrame:
    """``rows`` with the name of their part, for parts of more than one member: the largest by a broadcast, the rest by a join."""
    parts = parts.where("n > 1").select("class", "key", "node", "n")
    large, small = parts.where(F.col("n") > floor).drop("n"), parts.where(F.col("n") <= floor).drop("n")
    one = rows.join(F.broadcast(large.withColumnRenamed("node", "large")), ["class", "key"], "left")  # at most LARGEST rows
    two = one.where("large IS NULL").drop("large").join(small, ["class", "key"])
    return one.where("large IS NOT NULL").select("conv_id", F.col("large").alias("class")).unionByName(two.select("conv_id", F.col("node").alias("class")))


def prefix_trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, pos from 1, key, chars) of ``members`` (conv_id, length).

    conv_id is the node's smallest member, n_convs counts its members, n_children its children, n_leaves the nodes
    without children in its subtree, saved_tokens sums (n_convs - 1) times chars over its subtree, ends_sha256 hashes
    the members that end here. The root (depth 0) stands for all members, those without turns too. Equal conversations
    end in one node; an empty table gives no rows. As many rounds as the deepest beginning that two members share.
    """
    spark = members.sparkSession
    members = written(members, "trie-members")
    total = members.count()
    if not total:
        forget(members)
        return spark.createDataFrame([], NODES)
    turns = written(turns.repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id"), "trie-turns")
    least = members.agg(F.min("conv_id")).first()[0]
    active = members.select("conv_id", F.lit(least).cast("long").alias("class"))
    levels: list[DataFrame] = []  # of each depth from 1: class (the parent), key, node, n, chars
    shared = [active.select("conv_id", "class", F.lit(0).cast("long").alias("length"))]  # members of classes, by depth
    depth = 0
    while total > 1:
        depth += 1
        rows = written(turns.where(F.col("pos") == depth).join(active, "conv_id").select("conv_id", "class", "key", "chars"), "trie-round")
        level = written(rows.groupBy("class", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.min("chars").alias("chars")), "trie-level")
        size, many = level.agg(F.sum("n"), F.count(F.when(F.col("n") > 1, 1))).first()
        if not size:
            forget(rows, level)
            break
        levels.append(level)
        if not many:
            forget(rows)
            break
        active = written(_parts(rows, level, size // LARGEST), "trie-active")
        shared.append(active.select("conv_id", "class", F.lit(depth).cast("long").alias("length")))
        forget(rows)
    # Members that stand alone: their first own node has the class as its parent, the others follow in a chain.
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    alone = [lv.where("n = 1").select(F.col("node").alias("conv_id"), F.lit(d).cast("long").alias("since"), F.col("class").alias("parent")) for d, lv in enumerate(levels, 1)]
    if total == 1:
        alone.append(members.select("conv_id", F.lit(1).cast("long").alias("since"), F.col("conv_id").alias("parent")))
    nothing = F.sha2(F.lit(""), 256)
    outs = []
    if alone:
        chain = turns.join(union(alone), "conv_id").where("pos >= since").join(members, "conv_id")
        last = F.col("pos") == F.col("length")
        outs.append(
            chain.select(
                "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("since"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
            )
        )
    # Fold back: sums of the children, one depth after the other.
    root = spark.createDataFrame([(least, None, total)], "node long, class long, n long").withColumn("chars", F.lit(0).cast("long"))
    below, folded = None, []
    for d in range(len(levels), -1, -1):
        own = (levels[d - 1] if d else root).where("n > 1 OR class IS NULL").select("node", F.col("class").alias("parent"), "n", ((F.col("n") - 1) * F.col("chars")).alias("own"))
        single = levels[d].where("n = 1").groupBy("class").agg(F.count("*").alias("kids"), F.count("*").alias("leaves"), F.lit(0).cast("long").alias("saved")) if d < len(levels) else None
        if d == 0 and total == 1:
            single = members.where("length > 0").groupBy(F.col("conv_id").alias("class")).agg(F.count("*").alias("kids"), F.count("*").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        kids = [x for x in (below, single) if x is not None]
        if kids:
            sums = union(kids).groupBy(F.col("class").alias("node")).agg(F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            own = own.join(sums, "node", "left")
        else:
            own = own.select("*", *(F.lit(None).cast("long").alias(x) for x in ("kids", "leaves", "saved")))
        done = own.select(
            F.col("node").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.coalesce("kids", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.col("own") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        )
        done = written(done, "trie-nodes") if d % FOLD == 0 else done
        folded.append(done)
        below = done.groupBy(F.col("parent_conv_id").alias("class")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    ends = _ends(union(shared).join(members, ["conv_id", "length"]).select(F.col("length").alias("depth"), F.col("class").alias("node"), "conv_id"))
    nodes = union(folded).join(ends.withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    outs.append(nodes.select(*[c.split()[0] for c in NODES.split(", ")]))
    return union(outs)


def oracle() -> str:
    """Beginnings as strings of turn hashes; a subtree's nodes are found by their smallest member's own beginnings."""
    from .conversation_repair import _crc32

    return f"""
WITH t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, length(coalesce(text, ''))::BIGINT AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS own, list({{'k': key, 'c': chars}} ORDER BY pos) AS l FROM t GROUP BY 1),
i AS (SELECT conv_id, l, conv_id - conv_id % 100 AS leader, ({_crc32("conv_id::VARCHAR")} % 6)::BIGINT AS h FROM c),
b AS (SELECT i.conv_id, list_concat(coalesce(x.l, [])[1 : h], i.l[h + 1 : len(i.l)]) AS l FROM i LEFT JOIN c x ON x.conv_id = i.leader),
p AS (SELECT conv_id, d, len(l) = d AS ends, array_to_string(list_transform(l[1 : d], lambda z: z.k), '') AS prefix, array_to_string(list_transform(l[1 : d - 1], lambda z: z.k), '') AS parent, CASE WHEN d > 0 THEN l[d].c ELSE 0 END AS chars
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM b)),
n AS (SELECT d, prefix, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars, string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS e FROM p GROUP BY 1, 2),
k AS (SELECT d - 1 AS d, parent AS prefix, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (d, prefix)),
s AS (SELECT p.d, p.prefix, count(*) FILTER (kids = 0) AS leaves, sum((f.n_convs - 1) * f.chars) AS saved FROM f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY 1, 2)
SELECT f.conv_id, f.d::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(f.e, '')) AS ends_sha256
FROM f JOIN s USING (d, prefix) LEFT JOIN n q ON q.d = f.d - 1 AND q.prefix = f.parent AND f.d > 0"""

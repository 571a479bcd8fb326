"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Every source gets a share of the total budget by its weight. A document's virtual finish time is the
number of words its source has sent once it is through, in a shuffled order, divided by the source's
weight. Taking all documents (a source's are offered up to ``max_repeats`` times) in the order of
these times, until the budget is used up, serves all sources at once in proportion to their weights.

Scale: documents are read once for a narrow table (id, source, size, key). Running sums never put a
whole source into one task: each source is cut into ranges of its shuffle key, summed by range, and a
prefix sum over the ranges (in two steps) is added to the sum inside a range. The global order is cut in the same
way into ranges of the virtual time, which serve about equal numbers of words by construction; there are many
more of them than tasks, so that tasks get about equal rows too. The decision is a key per source and repeat, so it is applied to the documents without a shuffle.

Defined cases: a null or empty text, or one of white space only, has size 0 and takes 0 words; such a
document goes with the one behind it in its source, and not at all where its source has no words. A null
source is a source of its own, the last. Repeated rows are documents of their own; equal rows stay
together. An empty table gives an empty result. Columns beyond those named are ignored or, in
``apply_mix``, returned as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomatch.llm.common import WS, small, table, unused, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Rows that one range of keys or virtual times holds on average; small, so that ranges even out over the tasks.
RANGE_ROWS = 2_000
SEED = 7


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    body = F.regexp_replace(text, rf"^[{WS}]+", "")
    return F.coalesce(F.length(F.regexp_replace(body, rf"[^{WS}]++[{WS}]*+", "x")), F.lit(0)).cast("long")


def shuffle_key(seed: int) -> Column:
    """A key that orders documents as if shuffled, the same in every run."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), text("doc_id"), F.lit(":"), text("text")))


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(seed).alias("key")), "mix-sizes")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: rank, weight, source_size, n_docs, budget, level (the virtual time at which
    the budget is used up) and target. One row per source only, so its windows are small."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", rank).withColumn("weight", weight)
    cap = F.col("source_size").cast("double") * max_repeats
    order = W.orderBy(cap / F.col("weight"), "rank")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    per = per.withColumn("budget", F.sum("source_size").over(W.partitionBy()))
    # the level if exactly the sources before this one stop at their cap
    per = per.withColumn("_level", (F.col("budget") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after))
    first = F.when(cap / F.col("weight") >= F.col("_level"), F.struct(cap / F.col("weight"), "rank", "_level"))
    per = per.withColumn("level", F.coalesce(F.min(first).over(W.partitionBy()).getField("_level"), F.lit(0.0)))
    return per.withColumn("target", F.least(cap, F.col("weight") * F.col("level"))).drop("_level")


def sums_before(sums: DataFrame, by: list[str], at: str, group: Column, size: str, name: str) -> DataFrame:
    """sums with the total of `size` at all places before each one, by `by` and in the order of `at`.

    Two steps, as there are as many places as rows of the corpus allow: inside groups of neighbouring places, then over
    the groups. Each window sorts about the square root of the places."""
    sums = sums.withColumn("_group", group)
    earlier = lambda df, keys, order, c: df.withColumn(name, F.coalesce(F.sum(c).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    groups = earlier(sums.groupBy(*by, "_group").agg(F.sum(size).alias("_all")), by, "_group", "_all").withColumnRenamed(name, "_base")
    inside = earlier(sums, [*by, "_group"], at, size)
    return inside.join(groups.select(*by, "_group", "_base"), [*by, "_group"]).withColumn(name, F.col(name) + F.col("_base")).select(*by, at, name)


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: its targets and last_keys, for each repeat the last key that is taken."""
    per = written(source_targets(sized, weights, max_repeats), "mix-sources")
    n = sized.count()
    digits = max(0, math.ceil(math.log(max(1, n / RANGE_ROWS), 16)))
    one = per.select(F.col("source").alias("_s"), "rank", "weight", "source_size", "level", "budget")
    rows = sized.join(small(one), F.col("source").eqNullSafe(F.col("_s"))).select(
        "rank", "weight", "source_size", "level", "budget", "size", "key", F.substring("key", 1, digits).alias("range")
    )
    in_range = rows.groupBy("rank", "range").agg(F.sum("size").alias("in_range"))
    before = sums_before(in_range, ["rank"], "range", F.substring("range", 1, digits // 2), "in_range", "before")
    inside = rows.withColumn("inside", F.sum("size").over(W.partitionBy("rank", "range").orderBy("key")))
    sent = inside.join(before, ["rank", "range"]).withColumn("sent", F.col("before") + F.col("inside"))
    rounds = F.array(*[F.lit(i) for i in range(max_repeats)])
    # documents without words queue nowhere: they would all have the virtual time of the one before them
    offers = sent.filter(F.col("size") > 0).withColumn("round", F.explode(rounds)).filter(F.col("round") * F.col("source_size") <= F.col("weight") * F.col("level"))
    offers = offers.withColumn("finish", (F.col("round") * F.col("source_size") + F.col("sent")) / F.col("weight"))
    slots = max(1, math.ceil(n / RANGE_ROWS))
    # ranges go on behind the level: what isn't taken there is no heap at the end
    slot = F.when(F.col("level") > 0, F.floor(F.col("finish") / F.col("level") * slots)).otherwise(0)
    offers = offers.withColumn("slot", slot.cast("long")).select("rank", "round", "key", "size", "finish", "slot", "budget")
    in_slot = offers.groupBy("slot").agg(F.sum("size").alias("in_slot"))
    earlier = sums_before(in_slot, [], "slot", F.floor(F.col("slot") / max(1, math.isqrt(slots))), "in_slot", "earlier")
    running = F.sum("size").over(W.partitionBy("slot").orderBy("finish", "rank", "key"))
    # a range that begins behind the budget has nothing to take
    open_ = offers.join(earlier, "slot").filter(F.col("earlier") < F.col("budget"))
    taken = open_.withColumn("running", running).filter(F.col("earlier") + F.col("running") <= F.col("budget"))
    last = taken.groupBy("rank").agg(F.array(*[F.max(F.when(F.col("round") == i, F.col("key"))) for i in range(max_repeats)]).alias("last_keys"))
    return written(per.join(last, "rank", "left"), "mix-plan")


def copies(key: Column, last_keys: Column) -> Column:
    """How often the mix takes a document with this key."""
    taken = F.transform(last_keys, lambda last: F.when(key <= last, 1).otherwise(0))
    return F.coalesce(F.aggregate(taken, F.lit(0), lambda a, b: a + b), F.lit(0))


def mix_sizes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document."""
    sized = sizes(docs, seed)
    plan = mix_plan(sized, weights, max_repeats).select(F.col("source").alias("_s"), "source_size", "target", "last_keys")
    out = sized.join(small(plan), F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.withColumn("copies", copies(F.col("key"), F.col("last_keys"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with the columns of docs."""
    own, last, copy = unused(docs, "mix_source", "mix_last", "mix_copy")
    plan = mix_plan(sizes(docs, seed), weights, max_repeats).select(F.col("source").alias(own), F.col("last_keys").alias(last))
    out = docs.join(small(plan), F.col("source").eqNullSafe(F.col(own)))
    n = copies(shuffle_key(seed), F.col(last))
    times = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return out.withColumn(copy, F.explode(times)).select(*docs.columns)


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
p0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM p0),
p2 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank - 1) % 3 + 1] AS weight, source_size::DOUBLE * 3 AS cap FROM p1),
p3 AS (SELECT *, (SELECT sum(size)::BIGINT FROM d) AS budget,
         ((SELECT sum(size)::BIGINT FROM d) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM p2),
p4 AS (SELECT *, coalesce((SELECT arg_min(lv, (cap / weight, rank)) FROM p3 WHERE cap / weight >= lv), 0.0) AS level FROM p3),
p AS (SELECT *, least(cap, weight * level) AS target FROM p4),
c AS (SELECT d.*, p.rank, p.weight, p.source_size, p.level, p.target, p.budget,
         sum(size) OVER (PARTITION BY p.rank ORDER BY key) AS sent
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
o AS (SELECT c.*, r.round, ((r.round * source_size + sent)::DOUBLE / weight) AS finish
      FROM c, (SELECT unnest([0, 1, 2]) AS round) r WHERE r.round * source_size <= weight * level),
t AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, key) AS running FROM o),
k AS (SELECT rank, round, max(key) AS last_key FROM t WHERE running <= budget GROUP BY ALL),
n AS (SELECT rank, max(last_key) FILTER (round = 0) AS k0, max(last_key) FILTER (round = 1) AS k1, max(last_key) FILTER (round = 2) AS k2 FROM k GROUP BY rank)
SELECT c.doc_id, c.size, c.source_size, c.target,
       (c.size * (coalesce((key <= k0)::INT, 0) + coalesce((key <= k1)::INT, 0) + coalesce((key <= k2)::INT, 0)))::BIGINT AS taken
FROM c LEFT JOIN n USING (rank)
"""

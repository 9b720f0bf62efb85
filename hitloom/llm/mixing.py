"""Mixing sources to target weights by capped water-filling.

Each source has a weight and may give `max_epochs` times its size at most. Sources
whose share would exceed that are held there and the rest is shared anew by weight,
until none is above: the level at which sum(min(cap, level * weight)) meets the
budget, found with running sums over the sources in order of cap / weight.

A document is taken floor(target / size) whole times; the fraction that remains is
filled with documents in the order of a seeded hash. That order is cut in hash
buckets whose sizes are summed first, so only the rows of the one bucket in which a
source's cut falls are ordered, and a source with a third of all rows is spread over
all buckets. Null sources are a source of their own, the last in order; null texts
have size 0, take part in whole repetitions and are never drawn for a rest. Equal rows
share their fate's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.common import WORD

#: Hash buckets in each source.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """sizes: source, source_size (one row a source). Adds target (double).

    Weights repeat over the sources in code point order, null last.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    known = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    known = known.withColumns({
        "held": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "budget": F.lit(float(share)) * F.sum("source_size").over(whole),
    }).withColumn("level", (F.col("budget") - F.col("held")) / F.col("open"))
    # a source is held if its cap lies under the level at its turn; the first that isn't sets the level for all after it
    level = F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(whole)["level"]
    return known.withColumn("_level", level).select(
        "source", "source_size",
        F.when(F.col("_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.greatest(F.col("_level"), F.lit(0.0)) * F.col("w"))).alias("target"),
    )


def draw(sized: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """sized: doc_id, source, size and any others. Adds source_size, target, repeats (int).

    One shuffle by source and bucket for the ranks and the join. Rerun or recomputed
    after a loss, the same rows are chosen: order is (hash, doc_id, size). Columns of sized
    that have the names of the results are replaced; any other name may occur.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in sized.columns]).alias("row")
    hashed = sized.select(row, "source", "size", "doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("hash")).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)).cast("int"))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    p, g = sums.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).alias("p"), goals.alias("g")
    plan = p.join(g, F.col("p.source").eqNullSafe(F.col("g.source"))).select(
        "p.source", "p.bucket", "base", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("whole"),
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    r, q = hashed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r"), plan.alias("q")
    joined = r.join(q, F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.bucket") == F.col("q.bucket")))
    more = (F.col("q.base") + F.col("r.before") + F.col("r.size") / 2 <= F.col("q.rest")) & (F.col("r.size") > 0)
    kept = [F.col("r.row").getField(c).alias(c) for c in sized.columns if c not in ("source_size", "target", "repeats")]
    return joined.select(*kept, F.col("q.source_size"), F.col("q.target"), (F.col("q.whole") + more.cast("int")).alias("repeats"))


def mix(sized: DataFrame, seed: int = 17, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Both steps over rows with doc_id, source, size (long)."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return draw(sized, targets(sizes, weights, share, max_epochs), seed)

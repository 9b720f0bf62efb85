"""Exact order statistics of groups without sorting a group, or holding its values, anywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.sources.shared import cut, discard

#: buckets of a group in a round, and values of a bucket that one task sorts
BUCKETS, FEW = 4_096, 10_000


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """0 to BUCKETS - 1, never falling as v grows from lo to hi: by logarithm first where that tells them apart."""
    log = lambda x: F.signum(x) * F.log1p(F.abs(x))
    part = lambda f: (f(v) / 2 - f(lo) / 2) / (f(hi) / 2 - f(lo) / 2)  # noqa: E731  halves: no overflow
    wide = (F.abs(lo) > 1e3 * F.abs(hi)) | (F.abs(hi) > 1e3 * F.abs(lo))
    share = F.when(wide & (log(hi) > log(lo)), part(log)).otherwise(part(lambda x: x))
    return F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor(share * BUCKETS))).cast("int")


def ranked(rows: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], Column], few: int = FEW) -> DataFrame:
    """keys, which, value: the values at some ranks (from 0) of each group. ranks: from a group's size, an array of them.

    Rounds of counting: values fall into BUCKETS buckets between a group's ends, the
    bucket that holds the rank gives the next ends, until it has `few` values or one
    value; those are numbered by a sort. All that a task holds is counts, and a round
    reads only the values between the ends. That some group is open is all that reaches the
    driver. Ends meet the values by group: where few groups are open they are broadcast
    (by their size, at run time), else the join of a large group is split at run time.
    Nulls and NaN are left out; values count as doubles, infinities too.
    """
    v = F.col(value).cast("double")
    keyed = keys or ["_all"]
    base = rows if keys else rows.withColumn("_all", F.lit(1))
    x = cut(base.select(*keyed, v.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)").withColumn("_v", F.col("_v") + F.lit(0.0)), "values")
    sizes = x.groupBy(*keyed).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = sizes.select(*keyed, "_n", "_lo", "_hi", F.posexplode(ranks(F.col("_n"))).alias("which", "_rank"))
    # infinities are ends of their own, beyond all buckets
    state = cut(wanted.withColumn("_rank", F.col("_rank").cast("long")), "ends")
    live = x
    while state.where((F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        open_ = (F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))
        ends = state.where(open_).select(*keyed, "which", "_lo", "_hi", "_rank")
        inside = live.join(ends, keyed).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        infinite = F.abs("_v") == float("inf")
        finite_lo, finite_hi = F.greatest("_lo", F.lit(-1.7976931348623157e308)), F.least("_hi", F.lit(1.7976931348623157e308))
        at = F.when(infinite, F.when(F.col("_v") < 0, -1).otherwise(BUCKETS)).otherwise(_bucket(F.col("_v"), finite_lo, finite_hi))
        counts = inside.groupBy(*keyed, "which", "_rank", at.alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keyed, "which").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        narrower = counts.withColumn("_before", before).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        narrower = narrower.select(*keyed, "_n", "_lo", "_hi", "which", (F.col("_rank") - F.col("_before")).alias("_rank"))
        last, state = state, cut(state.where(~open_).unionByName(narrower), "ends")
        discard(last)
    met = live.join(state, keyed).where(F.col("_v").between(F.col("_lo"), F.col("_hi")) & (F.col("_lo") < F.col("_hi")))
    order = Window.partitionBy(*keyed, "which").orderBy("_v")
    picked = met.withColumn("_r", F.row_number().over(order) - 1).where(F.col("_r") == F.col("_rank")).select(*keyed, "which", F.col("_v").alias("value"))
    alike = state.where(F.col("_lo") == F.col("_hi")).select(*keyed, "which", F.col("_lo").alias("value"))
    return alike.unionByName(picked).select(*keys, "which", "value")


def upper_median(rows: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
    """sorted[n // 2] of each group."""
    return ranked(rows, keys, value, lambda n: F.array(F.floor(n / 2))).select(*keys, F.col("value").alias(to))


def median(rows: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
    """The middle value of each group, the mean of the two in the middle of an even number; without keys one row, null for no values."""
    middle = ranked(rows, keys, value, lambda n: F.array(F.floor((n - 1) / 2), F.floor(n / 2)))
    return middle.groupBy(*keys).agg(F.avg("value").alias(to))

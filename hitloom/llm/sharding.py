"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` places on a ring; a key belongs to the first place at or
after its own hash. A shard takes its own keys up to its capacity, in ring order;
what is left continues clockwise to the next shard that still has room. Capacities
are n div s, one more for the first n mod s shards, so counts differ by one at most.

Only key counts per arc (vnodes * shards of them, whatever the input) are needed to
plan the overflow, so the plan is one small aggregate folded with SQL array
functions; every row then finds its segment by its rank in its arc. One shuffle of
rows, by arc and lane: an arc's rows are ranked in LANES parts by a hash of key and
`ties`, so that one repeated or null key is dealt to several tasks. Null keys hash like
any value. Rows that are equal in key and `ties` are interchangeable. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places on the ring where virtual nodes and keys can sit.
RING = 1 << 16
#: Parts in which an arc's rows are ranked.
LANES = 16


def ring(spark: SparkSession, n_shards: int, vnodes: int) -> DataFrame:
    """The virtual nodes: arc (0.. in ring order), place, shard. n_shards * vnodes rows."""
    nodes = spark.range(n_shards).select(F.col("id").cast("int").alias("shard")).select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("replica")
    )
    placed = nodes.withColumn("place", F.pmod(F.xxhash64(F.lit("node"), "shard", "replica"), F.lit(RING)))
    order = Window.orderBy("place", "shard", "replica")
    return placed.select((F.row_number().over(order) - 1).alias("arc"), "place", "shard")


def place_to_arc(nodes: DataFrame) -> DataFrame:
    """Each of the RING places with the arc that serves it: the next node clockwise."""
    spark = nodes.sparkSession
    first = nodes.groupBy("place").agg(F.min("arc").alias("arc"))
    # backwards, as a frame that grows is summed up once while one that shrinks is read anew for every row
    after = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    return spark.range(RING).withColumnRenamed("id", "place").join(first, "place", "left").select(
        "place", F.coalesce(F.last("arc", ignorenulls=True).over(after), F.lit(0)).alias("arc")
    )


def segments(nodes: DataFrame, counts: DataFrame, n_shards: int) -> DataFrame:
    """Which ranks of each arc go to which shard: arc, start, n, shard, base (first slot).

    nodes: as ring() gives them. counts: arc, n (rows). Both are of fixed size.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    cap = F.floor(F.col("total") / F.lit(n_shards)).cast("long")
    known = (
        nodes.join(counts, "arc", "left").crossJoin(F.broadcast(total))
        .select("arc", "shard", F.coalesce("n", F.lit(0)).alias("n"),
                (cap + (F.col("shard") < F.col("total") % n_shards).cast("long")).alias("cap"))
    )
    before = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.col("cap") - F.coalesce(F.sum("n").over(before), F.lit(0)), F.lit(0))
    home = known.select("arc", "shard", "cap", "n", F.least("n", room).alias("kept"))
    per_shard = home.groupBy("shard").agg((F.max("cap") - F.sum("kept")).alias("free"))
    free = per_shard.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "free"))), lambda x: x["free"]).alias("free"))
    around = nodes.agg(F.transform(F.array_sort(F.collect_list(F.struct("arc", "shard"))), lambda x: x["shard"]).alias("around"))
    left = home.where("n > kept").agg(
        F.array_sort(F.collect_list(F.struct("arc", F.col("kept").alias("start"), (F.col("n") - F.col("kept")).alias("need")))).alias("left")
    )

    segment = "struct<arc:int,start:bigint,n:bigint,shard:int>"
    one = left.crossJoin(F.broadcast(free)).crossJoin(F.broadcast(around))

    def give(state: Column, shard: Column, arc: Column) -> Column:
        """One step clockwise: as much of what is needed as this shard has room for."""
        take = F.least(state["need"], F.get(state["free"], shard))
        return F.when(take > 0, F.struct(
            (state["need"] - take).alias("need"),
            (state["start"] + take).alias("start"),
            F.transform(state["free"], lambda f, i: F.when(i == shard, f - take).otherwise(f)).alias("free"),
            F.concat(state["out"], F.array(F.struct(arc.cast("int").alias("arc"), state["start"].alias("start"), take.alias("n"), shard.cast("int").alias("shard")))).alias("out"),
        )).otherwise(state)

    def settle(state: Column, item: Column) -> Column:
        """All that is left of one arc, to the shards met clockwise from it."""
        met = F.array_distinct(F.concat(
            F.slice("around", item["arc"] + 1, F.size("around")), F.slice("around", F.lit(1), item["arc"] + 1)
        ))
        begin = F.struct(item["need"].alias("need"), item["start"].alias("start"), state["free"].alias("free"), state["out"].alias("out"))
        return F.aggregate(met, begin, lambda s, shard: give(s, shard, item["arc"]), lambda s: F.struct(s["free"].alias("free"), s["out"].alias("out")))

    start = F.struct(F.col("free").alias("free"), F.from_json(F.lit("[]"), f"array<{segment}>").alias("out"))
    moved = one.select(F.explode(F.aggregate("left", start, settle, lambda s: s["out"])).alias("s")).select("s.*", F.lit(1).alias("phase"))
    kept = home.where("kept > 0").select("arc", F.lit(0).cast("long").alias("start"), F.col("kept").alias("n"), "shard", F.lit(0).alias("phase"))
    so_far = Window.partitionBy("shard").orderBy("phase", "arc", "start").rowsBetween(Window.unboundedPreceding, -1)
    return kept.unionByName(moved).select(
        "arc", "start", "n", "shard", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base")
    )


def shard(df: DataFrame, key: str, n_shards: int, vnodes: int = 64, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with two more columns: shard (int) and slot (long, gapless from 0 in each shard).

    Counts are at most one apart. Columns of df that have these names are replaced; any
    other name may occur.
    """
    nodes = ring(df.sparkSession, n_shards, vnodes)
    arcs = place_to_arc(nodes).select("place", F.col("arc").cast("long").alias("arc"))

    def on_ring(x: DataFrame) -> DataFrame:
        """x: row (a struct of all columns), in its arc."""
        hashed = x.withColumn("hash", F.xxhash64(F.lit("key"), F.col("row").getField(key)))
        # RING rows, whatever the input
        return hashed.withColumn("place", F.pmod("hash", F.lit(RING))).join(F.broadcast(arcs), "place")

    def packed(columns: list[str]) -> DataFrame:
        return df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))

    fields = [F.col("row").getField(c) for c in dict.fromkeys((key, *ties))]
    lane = F.pmod(F.xxhash64(F.lit("lane"), *fields), F.lit(LANES)).cast("int")
    # arcs times LANES rows
    lanes = on_ring(packed(list(dict.fromkeys((key, *ties))))).groupBy("arc", lane.alias("lane")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    begin = lanes.select("arc", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    plan = segments(nodes, lanes.groupBy("arc").agg(F.sum("n").alias("n")), n_shards).alias("p")
    inside = Window.partitionBy("arc", "lane").orderBy("hash", *fields)
    ranked = on_ring(packed(df.columns)).withColumn("lane", lane).withColumn("inside", F.row_number().over(inside) - 1)
    ranked = ranked.join(F.broadcast(begin), ["arc", "lane"]).withColumn("rank", F.col("begin") + F.col("inside")).alias("r")
    # at most two segments an arc and one more a shard
    found = ranked.join(F.broadcast(plan), F.expr("r.arc = p.arc AND r.rank >= p.start AND r.rank < p.start + p.n"))
    kept = [F.col("r.row").getField(c).alias(c) for c in df.columns if c not in ("shard", "slot")]
    return found.select(*kept, F.col("p.shard").alias("shard"), F.expr("p.base + r.rank - p.start").alias("slot"))

"""Contributions of many sources to events, time windows and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# The tables of a source
SOURCE_TABLES = ("hits", "contributions", "particles")


def source_registry(spark, specs: list[dict]) -> DataFrame:
    """source_id, delay_ns, max_events of every source, and path and tables (what its SOURCE_TABLES are called) where given.

    An empty list, sources that lack a key or that give a path or names only in part are errors.
    """
    if not specs:
        raise ValueError("no sources")
    needed, more = {"source_id", "delay_ns", "max_events"}, {"path", "tables"}
    if any(not needed <= set(s) <= needed | more for s in specs):
        raise ValueError("every source needs source_id, delay_ns and max_events")
    if any(set(s) != set(specs[0]) for s in specs):
        raise ValueError("all sources need the same keys")
    if any(set(s["tables"]) != set(SOURCE_TABLES) for s in specs if "tables" in s):
        raise ValueError(f"every source needs names for {', '.join(SOURCE_TABLES)}")
    schema = "source_id int, delay_ns double, max_events long, path string, tables map<string,string>"
    x = spark.createDataFrame([(s["source_id"], float(s["delay_ns"]), s["max_events"], s.get("path"), s.get("tables")) for s in specs], schema)
    return x.select("source_id", "delay_ns", "max_events", *[c for c in ("path", "tables") if c in specs[0]])


def validate(df: DataFrame, required: list[str]) -> None:
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def cap_events(contributions: DataFrame, max_events: int) -> DataFrame:
    return contributions.where(F.col("event_idx") < max_events)


def source_report(contributions: DataFrame, registry: DataFrame) -> DataFrame:
    """Events of each registered source, and whether it runs out before the longest one."""
    n = contributions.groupBy("source_id").agg(F.countDistinct("event_idx").alias("n_events"))
    all_ = registry.join(n, "source_id", "left").select("source_id", F.coalesce("n_events", F.lit(0)).alias("n_events"))
    most = all_.agg(F.max("n_events").alias("most"))
    return all_.crossJoin(F.broadcast(most)).select("source_id", "n_events", (F.col("n_events") < F.col("most")).alias("exhausted"))  # one row


def attribute_pdg(contributions: DataFrame, particles: DataFrame) -> DataFrame:
    """Each contribution's particle code, 0 where there is no such particle."""
    p = particles.select("event_idx", "particle_idx", F.col("pdg").alias("particle_pdg"))
    return contributions.join(p, ["event_idx", "particle_idx"], "left").withColumn("particle_pdg", F.coalesce("particle_pdg", F.lit(0)))


def overlay(contributions: DataFrame, ends_of: DataFrame | None = None) -> DataFrame:
    """Event i of every source becomes window i; only events that all sources have (of ends_of, where the same are at hand for less)."""
    ends = (contributions if ends_of is None else ends_of).groupBy("source_id").agg(F.max("event_idx").alias("last")).agg(F.min("last").alias("last"))
    return contributions.join(F.broadcast(ends), F.col("event_idx") <= F.col("last")).drop("last").withColumn("window_id", F.col("event_idx"))  # one row


def on_time_axis(contributions: DataFrame, registry: DataFrame) -> DataFrame:
    """t = event_idx * delay + time, in single precision as landed times are."""
    shifted = contributions.join(F.broadcast(registry.select("source_id", "delay_ns")), "source_id")
    start = (F.col("event_idx").cast("double") * F.col("delay_ns")).cast("float")
    return shifted.withColumn("t", (start.cast("double") + F.col("time").cast("float").cast("double")).cast("float").cast("double")).drop("delay_ns")


def window_index(t: Column, t_start: Column, width: float) -> Column:
    """Truncated single-precision quotient, 0 for early data."""
    quotient = ((t.cast("float").cast("double") - t_start.cast("float").cast("double")).cast("float").cast("double") / F.lit(width)).cast("float")
    return F.greatest(quotient.cast("long"), F.lit(0))


def cut_windows(stream: DataFrame, width: float, t_col: str = "t") -> DataFrame:
    """window_id and time in the window, from the first time of the whole stream."""
    start = stream.agg(F.min(t_col).alias("t_start"))
    x = stream.join(F.broadcast(start))  # one row
    x = x.withColumn("window_id", window_index(F.col(t_col), F.col("t_start"), width))
    return x.withColumn("t_rel", F.col(t_col) - (F.col("t_start") + F.col("window_id") * F.lit(width))).drop("t_start")


#: windows of a stretch of the axis that has at least one row before it is filled up
STRETCH = 1 << 16


def all_windows(cut: DataFrame, width: float) -> DataFrame:
    """Every window from 0 to the last, empty ones too: window_id, t_window_start (from 0), n.

    Each stretch of STRETCH windows has a row for its first one; each window then fills
    the gap up to the next one of its stretch. So empty windows are made where they are
    read, after the shuffle, and no row makes more than a stretch of them.
    """
    last = cut.agg(F.max("window_id").cast("long").alias("last"))
    starts = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {STRETCH}"))).alias("k"))
    starts = starts.select((F.col("k") * STRETCH).alias("window_id"), F.lit(0).cast("long").alias("n"))
    known = cut.select(F.col("window_id").cast("long").alias("window_id"), F.lit(1).cast("long").alias("n")).unionByName(starts).groupBy("window_id").agg(F.sum("n").alias("n"))
    stretch = F.expr(f"window_id div {STRETCH}")
    after = F.lead("window_id").over(Window.partitionBy("stretch").orderBy("window_id"))
    end = F.least(F.col("last") + 1, (F.col("stretch") + 1) * STRETCH)
    gaps = known.withColumn("stretch", stretch).crossJoin(F.broadcast(last)).withColumn("until", F.coalesce(after, end))  # one row
    ids = gaps.select("window_id", "n", F.explode(F.sequence("window_id", F.col("until") - 1)).alias("id"))
    return ids.select(F.col("id").alias("window_id"), (F.col("id") * F.lit(width)).alias("t_window_start"), F.when(F.col("id") == F.col("window_id"), F.col("n")).otherwise(0).alias("n"))


def common_source(source: str = "source_id") -> Column:
    """The one source of a group, 0 when it is mixed."""
    return F.when(F.min(source) == F.max(source), F.min(source)).otherwise(F.lit(0))


def merge(contributions: DataFrame, keys: tuple[str, ...] = ("window_id", "detector", "cell_id"), order: tuple[str, ...] = ("seq",), parts: int | None = None) -> DataFrame:
    """Contributions to hits: energy, first position and time (by order), source, dominant particle (the first of equal ones), count.

    First by energy as well, then by hit alone: with one energy a row the dominant particle
    needs no compound order, so that with an order of one column both steps aggregate
    plain numbers by hash, after one shuffle, to `parts` partitions where given: both
    steps hold what a partition has.
    """
    dealt = contributions.repartition(parts, *keys) if parts else contributions.repartition(*keys)
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    first = {c: F.min_by(c, place).alias(f"_{c}") for c in ("hit_x", "hit_y", "hit_z", "time", "pdg")}
    per = dealt.groupBy(*keys, F.coalesce("energy", F.lit(float("-inf"))).alias("_level")).agg(
        F.sum("energy").alias("_e"), F.min(place).alias("_first"), F.min("source_id").alias("_lo"), F.max("source_id").alias("_hi"), F.count("*").alias("_n"), *first.values()
    )
    of = lambda c: F.min_by(f"_{c}", "_first")
    return per.groupBy(*keys).agg(
        F.sum("_e").alias("e"), of("hit_x").alias("x"), of("hit_y").alias("y"), of("hit_z").alias("z"), of("time").alias("t"),
        F.when(F.min("_lo") == F.max("_hi"), F.min("_lo")).otherwise(F.lit(0)).alias("source_id"), F.max_by("_pdg", "_level").alias("origin_pdg"), F.sum("_n").alias("n_contributions"),
    )


def cell_sources(contributions: DataFrame) -> DataFrame:
    """The source of each cell over the whole stream, 0 when mixed anywhere."""
    return contributions.groupBy("detector", "cell_id").agg(common_source().alias("cell_source"))


def with_cell_source(hits: DataFrame, sources: DataFrame) -> DataFrame:
    return hits.join(sources, ["detector", "cell_id"], "left").withColumn("source_id", F.coalesce("cell_source", F.lit(0))).drop("cell_source")


def accumulate_steps(steps: DataFrame) -> DataFrame:
    """Steps with energy to cells: energy, energy-weighted y, x and z of the first step."""
    first = F.min_by(F.struct("x", "z"), "seq")
    return steps.where("edep > 0").groupBy("event_idx", "cell_id").agg(
        F.sum("edep").alias("edep"), (F.sum(F.col("edep") * F.col("y")) / F.sum("edep")).alias("y"), first.alias("f")
    ).select("event_idx", "cell_id", "edep", "y", F.col("f.x").alias("x"), F.col("f.z").alias("z"))


def slice_parallel(hits: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Hit i owns the next n of a parallel list; short lists give 0.

    hits: keys, hit_no, n. values: keys, position (from 0), value. Returns keys, hit_no, k, value.
    """
    before = Window.partitionBy(*keys).orderBy("hit_no").rowsBetween(Window.unboundedPreceding, -1)
    owned = hits.withColumn("_at", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 0")
    owned = owned.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).withColumn("position", F.col("_at") + F.col("k"))
    return owned.join(values, [*keys, "position"], "left").select(*keys, "hit_no", "k", F.coalesce("value", F.lit(0)).alias("value"))


def time_structure(contributions: DataFrame, keys: list[str]) -> DataFrame:
    return contributions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("time") == 0).alias("n_zero"), F.count_if(F.col("time") > 0).alias("n_positive"),
        F.min("time").alias("t_min"), F.max("time").alias("t_max"),
    ).withColumn("zero_percent", F.round(100 * F.col("n_zero") / F.col("n"), 6)).withColumn("mostly_zero", F.col("n_zero") * 2 > F.col("n"))

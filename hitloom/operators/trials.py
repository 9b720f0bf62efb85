"""Design trials: objectives, fronts, hypervolumes, statuses and stores."""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators.ordered import walk
from hitloom.sources.shared import cut


@dataclass(frozen=True)
class Objective:
    name: str
    maximise: bool = True

    @property
    def sign(self) -> float:
        return 1.0 if self.maximise else -1.0


def objective_rows(trials: DataFrame, objectives: list[Objective]) -> DataFrame:
    """Completed trials with finite values of all objectives, signed so that more is better: y0, y1, ..."""
    x = trials.where("status = 'COMPLETED'")
    for o in objectives:
        v = F.col(o.name).cast("double")
        x = x.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.withColumns({f"y{i}": F.col(o.name).cast("double") * o.sign for i, o in enumerate(objectives)})


def with_metrics(trials: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Metrics by name as further columns, of completed trials; each can then be named as an objective."""
    clash = set(metrics) & set(trials.columns)
    if clash:
        raise ValueError(f"there are columns named {sorted(clash)}")
    return trials.withColumns({k: F.when(F.col("status") == "COMPLETED", v) for k, v in metrics.items()})


def front(rows: DataFrame, keys: list[str], tie: str = "trial_id") -> DataFrame:
    """Not dominated in y0, y1, one of equal points (the first by tie).

    Rows lie in ranges by group and falling values, a table. What dominates a row lies
    before it: in its own range (a running maximum there) or in an earlier one of its
    group (the maximum of each range, run over the few ranges that a group has). So no
    task reads more than a range, even where one group has all rows.
    """
    order = [F.desc("y0"), F.desc("y1"), F.asc(tie)]
    ranged = cut(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy("_range", *keys).agg(F.max("y1").alias("_top"))
    earlier = F.max("_top").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    known = ranged.withColumn("_best", F.max("y1").over(here)).join(tops.select("_range", *keys, earlier.alias("_earlier")), ["_range", *keys])
    best = F.greatest("_best", "_earlier")  # of those that are not null
    return known.where(best.isNull() | (F.col("y1") > best)).select(*rows.columns)


def _typed(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _undominated(found: list[tuple], row: tuple) -> tuple | None:
    """found: the kept points so far, of rows in falling order of their values."""
    point = row[:-1]
    if any(all(a >= b for a, b in zip(other, point, strict=True)) for other in found):
        return None
    found.append(point)
    return row


def front_of_many(rows: DataFrame, keys: list[str], dims: list[str], tie: str = "trial_id", parts: int = 16) -> DataFrame:
    """Not dominated in any number of dimensions, one of equal points (the first by tie).

    In falling order of the values a row is only dominated by rows before it, so one walk
    that holds the front finds it: first in `parts` parts of a group, then over what is left.
    """
    order = [*(F.desc(d) for d in dims), tie]
    columns = [*dims, tie]
    part = rows.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(parts)))
    some = walk(part, [*keys, "_part"], order, columns, list, _undominated, _typed(part, [*keys, "_part", *columns])).drop("_part")
    best = walk(some, keys, order, columns, list, _undominated, _typed(rows, [*keys, *columns]))
    return rows.join(best.select(*keys, tie), [*keys, tie], "left_semi")


def reference_points(trials: DataFrame, keys: list[str], objectives: list[Objective], factors: list[float]) -> DataFrame:
    """The baseline's metric times a factor, of the first completed trial where none is the baseline: r0, r1, ..."""
    done = objective_rows(trials, objectives)
    first = F.struct((F.col("tag") != "baseline").cast("int").alias("t"), "trial_id")
    picked = done.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"y{i}") for i in range(len(objectives))]), first).alias("b"))
    return picked.select(*keys, *[(F.col(f"b.y{i}") * f).alias(f"r{i}") for i, f in enumerate(factors)])


def hypervolume(rows: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Area that the points above the reference dominate, 0 with none: strips of the sorted front."""
    above = rows.join(refs, keys).where("y0 > r0 AND y1 > r1")
    best = front(above, keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("y0"))
    strips = best.withColumn("_low", F.coalesce(F.lag("y1").over(w), F.col("r1")))
    area = strips.groupBy(*keys).agg(F.sum((F.col("y0") - F.col("r0")) * (F.col("y1") - F.col("_low"))).alias("hv"))
    return refs.select(*keys).join(area, keys, "left").select(*keys, F.coalesce("hv", F.lit(0.0)).alias("hv"))


class Staircase:
    """What points of two values dominate above a reference: in rising order of the first and falling order of the second."""

    def __init__(self, ref: tuple[float, float]) -> None:
        self.points: list[tuple[float, float]] = []
        self.ref = ref

    def add(self, y: tuple[float, float]) -> float:
        """The area that a point adds."""
        at = bisect.bisect_left(self.points, y)
        if at < len(self.points) and self.points[at][1] >= y[1] or y[0] <= self.ref[0] or y[1] <= self.ref[1]:
            return 0.0
        first = at
        while first and self.points[first - 1][1] <= y[1]:
            first -= 1
        # strips from the last point that stays on the left up to y, over what lies there already
        left = self.points[first - 1][0] if first else self.ref[0]
        gained = 0.0
        for x, height in [*self.points[first:at], (y[0], self.points[at][1] if at < len(self.points) else self.ref[1])]:
            gained += (x - left) * (y[1] - height)
            left = x
        self.points[first:at] = [y]
        return gained


class Sweep:
    """Points in falling order of their last value, and what each adds.

    All points before have a larger last value, so a point adds its height times what it
    adds in the other values: with two of them on a staircase, with more the box without
    what the points before take of it (each cut down to the box: its limit set).
    """

    def __init__(self, ref: tuple[float, ...]) -> None:
        self.ref = ref
        self.flat = Staircase(ref[:2]) if len(ref) == 3 else None
        self.seen: list[tuple[float, ...]] = []

    def add(self, y: tuple[float, ...], measured: bool = True) -> float:
        """What y adds; without `measured` it is only remembered."""
        *rest, last = y
        rest, low = tuple(rest), self.ref[:-1]
        height = last - self.ref[-1]
        if height <= 0:
            return 0.0
        if self.flat is not None:
            return height * self.flat.add(rest)
        if any(r <= s for r, s in zip(rest, low, strict=True)):
            return 0.0
        gained = 0.0
        if measured:
            gained = math.prod(r - s for r, s in zip(rest, low, strict=True)) - volume([tuple(map(min, p, rest)) for p in self.seen], low)
        self.seen = [p for p in self.seen if any(a > b for a, b in zip(p, rest, strict=True))] + [rest]
        return height * gained


def volume(points: list[tuple[float, ...]], ref: tuple[float, ...]) -> float:
    """What points dominate above ref: n log n work for two and three values, n times that of one less for each further one."""
    if len(ref) == 1:
        return max((p[0] for p in points), default=ref[0]) - ref[0] if any(p[0] > ref[0] for p in points) else 0.0
    if len(ref) == 2:
        stairs = Staircase(ref)
        return sum(stairs.add(p) for p in sorted(set(points), reverse=True))
    sweep = Sweep(ref)
    return sum(sweep.add(p) for p in sorted(set(points), key=lambda p: (p[-1], p), reverse=True))


class _Trace:
    """The front of what was seen so far, and the volume that the measured points of it have added."""

    def __init__(self) -> None:
        self.points: list[tuple[float, ...]] = []
        self.flat: Staircase | None = None
        self.total = 0.0

    def add(self, y: tuple[float, ...], ref: tuple[float, ...], measured: bool = True) -> None:
        if not all(a > r for a, r in zip(y, ref, strict=True)):
            return
        if len(y) == 2:
            self.flat = self.flat or Staircase(ref)
            gained = self.flat.add(y)
            self.total += gained if measured else 0.0
            return
        if any(all(a >= b for a, b in zip(p, y, strict=True)) for p in self.points):
            return
        if measured:
            self.total += math.prod(a - r for a, r in zip(y, ref, strict=True)) - volume([tuple(map(min, p, y)) for p in self.points], ref)
        self.points = [p for p in self.points if not all(b >= a for a, b in zip(p, y, strict=True))] + [y]


def hypervolume_trace(rows: DataFrame, refs: DataFrame, keys: list[str], dims: tuple[str, ...] = ("y0", "y1"), tie: str = "trial_id", size: int = 20_000) -> DataFrame:
    """keys, tie, hv: the hypervolume after each trial in order. refs: keys and r0, r1, ... in the order of dims.

    Trials lie in ranges of about `size` by group and order. A range is walked from the
    fronts of its group's earlier ranges on, each on its own; what the earlier ranges add in
    all comes on top. A task holds a front, and the fronts of the ranges before.
    """
    n, limits = len(dims), [f"r{i}" for i in range(len(dims))]
    known = cut(rows.join(refs, keys).select(*keys, tie, *dims, *limits), "trace")
    ranges = -(-known.count() // size)
    placed = [*keys, "_range"]
    ranged = known.withColumn("_range", F.lit(0)) if ranges <= 1 else cut(known.repartitionByRange(ranges, *keys, tie).withColumn("_range", F.spark_partition_id()), "ranges")
    own = ranged.withColumn("_own", F.lit(True))
    if ranges > 1:
        above = ranged.where(" AND ".join(f"{d} > {r}" for d, r in zip(dims, limits, strict=True)))
        fronts = front_of_many(above, placed, list(dims), tie)
        later = ranged.select(*keys, F.col("_range").alias("_to")).distinct()
        seen = fronts.join(later, keys).where(F.col("_to") > F.col("_range")).withColumn("_range", F.col("_to")).withColumn("_own", F.lit(False))
        own = own.unionByName(seen.select(own.columns))

    def step(trace: _Trace, row: tuple) -> tuple | None:
        trace.add(row[1 : 1 + n], row[1 + n : 1 + 2 * n], row[-1])
        return (row[0], trace.total) if row[-1] else None

    walked = walk(own, placed, ["_own", tie], [tie, *dims, *limits, "_own"], _Trace, step, _typed(own, [*placed, tie]) + ", hv double")
    if ranges <= 1:
        return walked.drop("_range")
    walked = cut(walked, "walked")
    tops = walked.groupBy(*placed).agg(F.max("hv").alias("_top"))
    before = F.sum("_top").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = tops.select(*placed, F.coalesce(before, F.lit(0.0)).alias("_before"))
    return walked.join(offsets, placed).select(*keys, tie, (F.col("hv") + F.col("_before")).alias("hv"))


def hypervolume_of_many(rows: DataFrame, refs: DataFrame, keys: list[str], dims: tuple[str, ...], parts: int = 16, least: int = 512) -> DataFrame:
    """Like hypervolume(), for three and more objectives.

    The front in falling order of the last objective is cut into stretches (of `least`
    points at least, `parts` at most). What its points add to those before is found for
    each stretch by its own sweep, to which the points before are given, too; a task
    holds a front's points up to its stretch. The parts add up.
    """
    n = len(dims)
    limits = [f"r{i}" for i in range(n)]
    above = rows.join(refs, keys).where(" AND ".join(f"{d} > {r}" for d, r in zip(dims, limits, strict=True)))
    best = front_of_many(above, keys, list(dims)).select(*keys, *dims, *limits)
    falling = [F.desc(d) for d in reversed(dims)]
    placed = best.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*falling)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    size = F.greatest(F.lit(least), F.ceil(F.col("_n") / parts))
    cut_up = placed.withColumns({"_own": F.floor(F.col("_i") / size), "_last": F.floor((F.col("_n") - 1) / size)})
    spread = cut_up.withColumn("_part", F.explode(F.sequence("_own", "_last")))

    def step(sweep: list, row: tuple) -> tuple | None:
        y, ref, own = row[:n], row[n : 2 * n], row[2 * n]
        if not sweep:
            sweep.append(Sweep(ref))
        gained = sweep[0].add(y, own)
        return (gained,) if own else None

    spread = spread.withColumn("_mine", F.col("_own") == F.col("_part"))
    gains = walk(spread, [*keys, "_part"], ["_i"], [*dims, *limits, "_mine"], list, step, _typed(spread, [*keys, "_part"]) + ", hv double")
    summed = gains.groupBy(*keys).agg(F.sum("hv").alias("hv"))
    return refs.select(*keys).join(summed, keys, "left").select(*keys, F.coalesce("hv", F.lit(0.0)).alias("hv"))


def derived_seed(seed: Column, trial: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", seed.cast("string"), trial.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


TERMINAL = ("COMPLETED", "FAILED", "INFEASIBLE")


def retriable(attempt: Column, reason: Column, most: int) -> Column:
    return (attempt < most) & reason.isin("lost", "timeout", "held")


def verdict(metrics: Column, payload_error: Column, executor_reason: Column) -> Column:
    """Metrics beat everything; then the payload's own error; then what the executor says."""
    return F.when(metrics.isNotNull(), F.lit("COMPLETED")).otherwise(F.coalesce(payload_error, executor_reason, F.lit("lost")))


def status_counts(trials: DataFrame, keys: list[str]) -> DataFrame:
    per = trials.groupBy(*keys, "status").agg(F.count("*").alias("n"))
    total = Window.partitionBy(*keys)
    return per.withColumn("total", F.sum("n").over(total)).withColumn("failure_rate", F.sum(F.when(F.col("status").isin("FAILED", "INFEASIBLE"), F.col("n")).otherwise(0)).over(total) / F.col("total"))


def wall_times(trials: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """Wall times in minutes of each group, in equal bins between its shortest and longest: keys, bin, lo, hi, entries. Without a time, or with 0, a trial does not count."""
    known = trials.where(F.col("wall_time_s").isNotNull() & (F.col("wall_time_s") != 0)).select(*keys, (F.col("wall_time_s") / 60).alias("_m"))
    ends = known.groupBy(*keys).agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(step > 0, F.least(F.lit(bins - 1), F.floor((F.col("_m") - F.col("_lo")) / step).cast("int"))).otherwise(0)
    found = known.join(ends, keys).groupBy(*keys, place.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("entries"))
    return found.select(*keys, "bin", (F.col("_lo") + F.col("bin") * step).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * step).alias("hi"), "entries")


def minutes_since_first(trials: DataFrame, keys: list[str]) -> DataFrame:
    t = F.col("submitted_at").cast("timestamp").cast("double")
    return trials.withColumn("minutes", (t - F.min(t).over(Window.partitionBy(*keys))) / 60)


def next_ids(base: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """new with trial_id after the largest of base (from 0 in an empty one), in the order of a column.

    Rows are dealt in ranges and numbered inside each, from what the ranges before hold.
    """
    last = base.agg((F.coalesce(F.max("trial_id"), F.lit(-1)) + 1).alias("_next"))
    ranged = cut(new.repartitionByRange(order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id()), "new-trials")
    # as many rows as there are ranges
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    begin = sizes.withColumn("_begin", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    numbered = ranged.withColumn("_i", inside).join(F.broadcast(begin), "_range").crossJoin(F.broadcast(last))
    return numbered.withColumn("trial_id", F.col("_next") + F.col("_begin") + F.col("_i") - 1).drop("_next", "_begin", "_i", "_range")


def upsert(base: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """base with the rows of changes in place of those with the same keys (trial_id, where none are named)."""
    keys = keys or ("trial_id",)
    return base.join(changes.select(*keys), [*keys], "left_anti").unionByName(changes, allowMissingColumns=True)


def set_meta(base: DataFrame, changes: DataFrame, order: str, merge: bool = False) -> DataFrame:
    """Metadata (key, value as JSON text) after changes (key, value, and the column `order`); the last one of a key counts.

    A value is replaced, or, with merge, members of a JSON object are: those that the
    changes have, in their order, over those that are there; what isn't an object is
    replaced. Text that isn't JSON is an error.
    """
    old = base.select("key", "value", F.lit(False).alias("_new"), F.lit(None).cast(changes.schema[order].dataType).alias("_at"))
    rows = old.unionByName(changes.select("key", "value", F.lit(True).alias("_new"), F.col(order).alias("_at")))
    place = F.struct("_new", "_at", "value")
    if not merge:
        return rows.groupBy("key").agg(F.to_json(F.parse_json(F.max_by("value", place))).alias("value"))
    parsed = rows.withColumn("_v", F.parse_json("value"))
    whole = parsed.groupBy("key").agg(F.max_by(F.col("value"), place).alias("last"), F.max(F.when(~F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), place)).alias("cut"))
    # members after the last value that isn't an object
    kept = parsed.withColumn("_place", place).join(whole, "key").where(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")) & (F.col("cut").isNull() | (F.col("_place") > F.col("cut"))))
    members = kept.select("key", "_place", F.explode(F.from_json("value", "map<string,variant>")).alias("name", "member"))
    newest = members.groupBy("key", "name").agg(F.max_by(F.to_json("member"), "_place").alias("member"))
    objects = newest.groupBy("key").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.parse_json("member").alias("v"))), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)))).alias("merged"))
    return whole.join(objects, "key", "left").select("key", F.coalesce("merged", F.to_json(F.parse_json("last"))).alias("value"))


def get_meta(meta: DataFrame, path: str, kind: str, to: str = "value") -> DataFrame:
    """key and what each value holds at a JSON path, as a type; null where it has nothing there."""
    return meta.select("key", F.try_variant_get(F.parse_json("value"), path, kind).alias(to))


def by_name(wanted: DataFrame, trials: DataFrame) -> DataFrame:
    """The first trial of each wanted name."""
    w = Window.partitionBy("name").orderBy("trial_id")
    first = trials.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return wanted.join(first, "name", "left")


def to_params(u: Column, lo: float, hi: float, log: bool = False, integer: bool = False) -> Column:
    x = F.exp(F.lit(math.log(lo)) + u * (math.log(hi) - math.log(lo))) if log else lo + u * (hi - lo)
    x = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))
    return F.bround(x) if integer else x


def to_unit(x: Column, lo: float, hi: float, log: bool = False) -> Column:
    u = (F.log(x) - math.log(lo)) / (math.log(hi) - math.log(lo)) if log else (x - lo) / (hi - lo)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), u))


def overridden(base: Column, changes: Column) -> Column:
    """Constants of a variant: changes win."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(changes, k)), changes)


def unknown_keys(base: Column, changes: Column) -> Column:
    return F.array_except(F.map_keys(changes), F.map_keys(base))


def envelope_overlaps(parts: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Parts that start before the one in front ends."""
    end = F.lag("end").over(Window.partitionBy(*keys).orderBy("start", "end"))
    return parts.withColumn("previous_end", end).where(F.col("previous_end") > F.col("start") + tolerance)


def radical_inverse(i: Column, base: int, digits: int | None = None) -> Column:
    """Halton coordinate of index i below 2^50: its digits mirrored at the point; with digits, of that many of its last ones alone (a grid of base^digits steps)."""
    x, power = F.lit(0.0), 1
    while power <= 2**50 and (digits is None or power < base**digits):
        x = x + F.floor(i / F.lit(float(power))) % base * F.lit(1.0 / (power * base))
        power *= base
    return x


def primes(n: int) -> list[int]:
    found: list[int] = []
    at = 2
    while len(found) < n:
        if all(at % p for p in found):
            found.append(at)
        at += 1
    return found


def design_points(spark, dim: int, n: int, skip: int = 0) -> DataFrame:
    """n low-discrepancy points of the unit cube of any dimension, resumable by skip."""
    ids = spark.range(skip, skip + n)
    return ids.select("id", *[radical_inverse(F.col("id") + 1, p).alias(f"u{k}") for k, p in enumerate(primes(dim))])

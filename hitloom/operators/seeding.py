"""Crossings of strips, votes, peaks and seeds, for all windows at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators.ordered import TAIL, losers
from hitloom.sources.shared import cut


def station(z: Column, tolerance: float = 10.0) -> Column:
    return F.round(z / tolerance).cast("long")


def capped_groups(a: DataFrame, b: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Groups whose n_a * n_b doesn't exceed the cap; counted before anything is joined."""
    na = a.groupBy(*keys).agg(F.count("*").alias("_na"))
    nb = b.groupBy(*keys).agg(F.count("*").alias("_nb"))
    return na.join(nb, keys).where(F.col("_na") * F.col("_nb") <= most).select(*keys)


def crossings(x: DataFrame, y: DataFrame, keys: list[str], most: int = 500) -> DataFrame:
    """Each x strip with each y strip of its group, in groups under the cap.

    x, y: keys, hit_id, x or y, z. Returns keys, x_id, y_id, x, y, z (the mean), weight 2.
    """
    fine = capped_groups(x, y, keys, most)
    left = x.join(fine, keys).select(*keys, F.col("hit_id").alias("x_id"), "x", F.col("z").alias("_zx"))
    right = y.select(*keys, F.col("hit_id").alias("y_id"), "y", F.col("z").alias("_zy"))
    return left.join(right, keys).select(*keys, "x_id", "y_id", "x", "y", ((F.col("_zx") + F.col("_zy")) / 2).alias("z"), F.lit(2).alias("weight"))


#: strips of a plane that meet those of the other at once
STRIPS = 1024


def in_blocks(x: DataFrame, y: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """x and y with _bx and _by: a strip of one meets each of the other, in its group, in one block. A block has some STRIPS strips of each."""
    n = x.groupBy(*keys).agg(F.count("*").alias("_na")).join(y.groupBy(*keys).agg(F.count("*").alias("_nb")), keys)
    n = n.select(*keys, F.ceil(F.col("_na") / STRIPS).alias("_na"), F.ceil(F.col("_nb") / STRIPS).alias("_nb"))
    own = lambda n: F.pmod(F.xxhash64("hit_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = x.join(n, keys).withColumn("_bx", own("_na")).withColumn("_by", every("_nb"))
    right = y.join(n, keys).withColumn("_by", own("_nb")).withColumn("_bx", every("_na"))
    return left, right.drop("_na", "_nb")


def near_pads(strips: DataFrame, axis: str, pads: DataFrame, keys: list[str], within: list[str], radius: float) -> DataFrame:
    """Strips with each place of pads along an axis that is within radius: keys, hit_id, _px or _py, _d2 (the distance, squared)."""
    far = radius * (1 + 1e-9)  # a quotient may be rounded into the next cell
    p = F.col(f"_p{axis}")
    q = pads.select(*within, p).distinct().withColumn("_c", F.explode(F.sequence(F.floor((p - far) / radius), F.floor((p + far) / radius))))
    s = strips.select(*keys, "hit_id", F.col(axis).alias("_v"), F.floor(F.col(axis) / radius).alias("_c"))
    met = s.join(q.hint("merge"), [*within, "_c"]).withColumn("_d2", (F.col("_v") - p) * (F.col("_v") - p))
    return met.where(F.col("_d2") <= radius**2).select(*keys, "hit_id", p, "_d2")


def clear_crossings(x: DataFrame, y: DataFrame, pads: DataFrame, keys: list[str], within: list[str], radius: float) -> DataFrame:
    """What drop_ghosts() leaves of confirm()'s crossings, of every group, whatever its size: as crossings() has them.

    within: the keys of pads. Confirmed crossings are found from the strips near a pad. Each
    x strip takes the y strips along that it is confirmed with, each y strip whether there
    is one: a crossing is judged where it is made, and is not dealt again.
    """
    pads = pads.select(*within, F.col("x").alias("_px"), F.col("y").alias("_py")).distinct()
    a = near_pads(x, "x", pads, keys, within, radius).withColumnsRenamed({"hit_id": "x_id", "_d2": "_dx"})
    b = near_pads(y, "y", pads, keys, within, radius).withColumnsRenamed({"hit_id": "y_id", "_d2": "_dy"})
    a = a.join(pads.hint("merge"), [*within, "_px"]).select(*keys, "x_id", "_py", "_dx")
    sure = a.join(b.hint("merge"), [*keys, "_py"]).where(F.col("_dx") + F.col("_dy") <= radius**2).select(*keys, "x_id", "y_id").distinct()
    sure = cut(sure, "confirmed")  # read for both planes
    x = x.join(sure.groupBy(*keys, F.col("x_id").alias("hit_id")).agg(F.collect_set("y_id").alias("_sure")).hint("merge"), [*keys, "hit_id"], "left")
    y = y.join(sure.select(*keys, F.col("y_id").alias("hit_id")).distinct().withColumn("_fy", F.lit(True)).hint("merge"), [*keys, "hit_id"], "left")
    left, right = in_blocks(x, y, keys)
    here = F.filter("_sure", lambda i: F.pmod(F.xxhash64(i), F.col("_nb")) == F.col("_by"))  # of this block
    left = left.select(*keys, "_bx", "_by", F.col("hit_id").alias("x_id"), "x", F.col("z").alias("_zx"), here.alias("_sure"))
    right = right.select(*keys, "_bx", "_by", F.col("hit_id").alias("y_id"), "y", F.col("z").alias("_zy"), "_fy")
    ghost = F.col("_sure").isNotNull() & F.col("_fy").isNotNull() & ~F.array_contains("_sure", F.col("y_id"))
    met = left.join(right.hint("merge"), [*keys, "_bx", "_by"]).where(~ghost)
    return met.select(*keys, "x_id", "y_id", "x", "y", ((F.col("_zx") + F.col("_zy")) / 2).alias("z"), F.lit(2).alias("weight"))


def stereo_crossings(u: DataFrame, v: DataFrame, keys: list[str], angle: float = 5.0, most: int = 200) -> DataFrame:
    """u, v: keys, hit_id, loc0, z. Crossing x = (u + v) / 2, y = (v - u) / (2 sin)."""
    fine = capped_groups(u, v, keys, most)
    left = u.join(fine, keys).select(*keys, F.col("hit_id").alias("x_id"), F.col("loc0").alias("_u"), F.col("z").alias("_zu"))
    right = v.select(*keys, F.col("hit_id").alias("y_id"), F.col("loc0").alias("_v"), F.col("z").alias("_zv"))
    s = 2 * math.sin(math.radians(angle))
    return left.join(right, keys).select(
        *keys, "x_id", "y_id", (0.5 * (F.col("_u") + F.col("_v"))).alias("x"), ((F.col("_v") - F.col("_u")) / s).alias("y"), ((F.col("_zu") + F.col("_zv")) / 2).alias("z"), F.lit(2).alias("weight")
    )


def mtc_points(measurements: DataFrame, keys: list[str], angle: float = 5.0, most: int = 200) -> DataFrame:
    """Points of weight 2 from the measurements of mtc(): keys, x, y, z, weight.

    Those with both axes (is2d) are points as they are. The others are crossed, plane 0
    (quality 0) with plane 1, in each group of round(z / 5) under the cap.
    """
    two = measurements.where("is2d").select(*keys, "x", "y", "z", F.lit(2).alias("weight"))
    one = measurements.where("NOT is2d").select(*keys, F.round(F.col("z") / 5).cast("long").alias("_zbin"), F.col("cell_id").alias("hit_id"), F.col("x").alias("loc0"), "z", "quality")
    crossed = stereo_crossings(one.where("quality = 0"), one.where("quality = 1"), [*keys, "_zbin"], angle, most)
    return two.unionByName(crossed.select(*two.columns))


def confirm(points: DataFrame, pads: DataFrame, keys: list[str], row_id: list[str], radius: float) -> DataFrame:
    """points with confirmed: some pad of the group lies within radius (inclusive)."""
    points = cut(points, "crossings")  # read on both sides of the join
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = pads.select(*keys, F.col("x").alias("_px"), F.col("y").alias("_py"), cell("x").alias("_ci"), cell("y").alias("_cj"), F.explode(around).alias("o"))
    p = p.select(*keys, "_px", "_py", (F.col("_ci") + F.col("o.i")).alias("_i"), (F.col("_cj") + F.col("o.j")).alias("_j"))
    a = points.select(*keys, *row_id, F.col("x").alias("_ax"), F.col("y").alias("_ay"), cell("x").alias("_i"), cell("y").alias("_j"))
    hit = a.join(p.hint("merge"), [*keys, "_i", "_j"]).where(F.pow(F.col("_ax") - F.col("_px"), 2) + F.pow(F.col("_ay") - F.col("_py"), 2) <= radius**2)
    found = hit.select(*keys, *row_id).distinct().withColumn("confirmed", F.lit(True))
    return points.join(found.hint("merge"), [*keys, *row_id], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def drop_ghosts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Without crossings that aren't confirmed while both of their strips are, elsewhere in the group.

    points are read once and dealt by group, which crossings() keeps under a cap.
    """
    fine = lambda strip: F.max("confirmed").over(Window.partitionBy(*keys, strip))
    dealt = points.repartition(*keys).withColumn("_fx", fine("x_id")).withColumn("_fy", fine("y_id"))
    return dealt.where("confirmed OR NOT _fx OR NOT _fy").drop("_fx", "_fy")


def bin_of(v: Column, half: float = 200.0, width: float = 5.0) -> Column:
    n = int(2 * half / width) + 1
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), ((v + half) / width).cast("int")))


def bin_centre(i: Column, half: float = 200.0, width: float = 5.0) -> Column:
    return -half + (i + 0.5) * width


def votes(points: DataFrame, keys: list[str], half: float = 200.0, width: float = 5.0) -> DataFrame:
    """Weight in every bin that has any."""
    return points.groupBy(*keys, bin_of(F.col("x"), half, width).alias("ix"), bin_of(F.col("y"), half, width).alias("iy")).agg(F.sum("weight").alias("votes"))


def peaks(bins: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Bins with enough votes and no higher one among the eight around."""
    bins = cut(bins, "bins")  # read on both sides of the join
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    near = bins.select(*keys, F.col("votes").alias("_v"), F.explode(around).alias("o"), "ix", "iy").select(*keys, "_v", (F.col("ix") + F.col("o.i")).alias("ix"), (F.col("iy") + F.col("o.j")).alias("iy"))
    top = near.groupBy(*keys, "ix", "iy").agg(F.max("_v").alias("_top"))
    return bins.where(F.col("votes") >= least).join(top.hint("merge"), [*keys, "ix", "iy"], "left").where("_top IS NULL OR votes >= _top").drop("_top")


def near_peaks(found: DataFrame, points: DataFrame, keys: list[str], radius: float = 10.0) -> DataFrame:
    """Each peak with the points closer than radius to its centre: peaks, the fewer, are put in the nine grid cells around."""
    cell = lambda c: F.floor(c / radius)
    p = found.select(*keys, "ix", "iy", "votes", bin_centre(F.col("ix")).alias("px"), bin_centre(F.col("iy")).alias("py"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = p.withColumn("o", F.explode(around)).withColumns({"_i": cell(F.col("px")) + F.col("o.i"), "_j": cell(F.col("py")) + F.col("o.j")}).drop("o")
    q = points.select(*keys, "x", "y", "z", "weight", cell(F.col("x")).alias("_i"), cell(F.col("y")).alias("_j"))
    return p.join(q.hint("merge"), [*keys, "_i", "_j"]).where(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) < radius**2).drop("_i", "_j")


def multiplicity(met: DataFrame, keys: list[str]) -> DataFrame:
    """Weight of a peak's points over its stations, and its first z."""
    return met.groupBy(*keys, "ix", "iy", "votes").agg((F.sum("weight") / F.countDistinct(station(F.col("z")))).alias("multiplicity"), F.min("z").alias("z_start"))


def weighted_mode(met: DataFrame, keys: list[str], axis: str, pitch: float) -> DataFrame:
    """The strip of most weight along an axis (the smallest in a tie), as a coordinate."""
    n = met.groupBy(*keys, "ix", "iy", F.round(F.col(axis) / pitch).cast("long").alias("_s")).agg(F.sum("weight").alias("_w"))
    return n.groupBy(*keys, "ix", "iy").agg((F.max_by("_s", F.struct("_w", -F.col("_s"))) * pitch).alias(axis))


def suppress(found: DataFrame, keys: list[str], radius: int, tail: int = TAIL) -> DataFrame:
    """Peaks that no earlier kept one is near to, by votes, then place: keys, ix, iy.

    Near: at most `radius` bins off in both directions. Rivals meet by cells of that size,
    each pair once; what is decided from the pairs is losers()' work.
    """
    side = max(radius, 1)
    cell = lambda c: F.floor(F.col(c) / side)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    at = F.struct("ix", "iy")
    a = found.withColumn("_o", F.explode(around)).select(*keys, at.alias("better"), F.struct((-F.col("votes")).alias("n"), "ix", "iy").alias("_a"), (cell("ix") + F.col("_o.i")).alias("_i"), (cell("iy") + F.col("_o.j")).alias("_j"))
    b = found.select(*keys, at.alias("worse"), F.struct((-F.col("votes")).alias("n"), "ix", "iy").alias("_b"), cell("ix").alias("_i"), cell("iy").alias("_j"))
    near = a.join(b, [*keys, "_i", "_j"]).where((F.col("_a") < F.col("_b")) & (F.abs(F.col("better.ix") - F.col("worse.ix")) <= radius) & (F.abs(F.col("better.iy") - F.col("worse.iy")) <= radius))
    name = lambda c: F.col(f"{c}.ix") * F.lit(1 << 32) + F.col(f"{c}.iy")
    edges = near.select(*keys, name("better").alias("better"), name("worse").alias("worse"), F.col("_b.n").alias("order"))
    gone = losers(edges, keys, ["order"], tail)
    named = found.withColumn("node", F.col("ix") * F.lit(1 << 32) + F.col("iy"))
    return named.join(gone, [*keys, "node"], "left_anti").select(*keys, "ix", "iy")


def seeds(points: DataFrame, keys: list[str], most: int = 5, max_multiplicity: float = 3.0, pitch: float = 0.755, suppress_mm: float = 15.0, width: float = 5.0) -> DataFrame:
    """The best peaks of each group as seeds: x, y, z_start, n_votes, multiplicity.

    Showers (too many points a station) suppress others but take no seat.
    """
    points = cut(points, "seed-points")  # read by each of the steps below
    found = peaks(votes(points, keys), keys)
    met = cut(near_peaks(found, points, keys).drop("px", "py"), "seed-met")
    judged = cut(multiplicity(met, keys), "seed-peaks")
    radius = math.ceil(suppress_mm / width)
    kept = judged.join(suppress(judged, keys, radius).hint("merge"), [*keys, "ix", "iy"], "left_semi")
    order = Window.partitionBy(*keys).orderBy(F.desc("votes"), "ix", "iy")
    best = kept.where(F.col("multiplicity") <= max_multiplicity).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    at = [*keys, "ix", "iy"]
    refined = best.join(weighted_mode(met, keys, "x", pitch).hint("merge"), at).join(weighted_mode(met, keys, "y", pitch).hint("merge"), at)
    return refined.select(*keys, "x", "y", "z_start", F.col("votes").alias("n_votes"), "multiplicity")

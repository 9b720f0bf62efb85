"""Track pieces: duplicates, links between detectors, chains, states."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators.ordered import TAIL, in_rounds, losers, walk


def accept(segments: DataFrame, least: dict[int, int], most: float = 10.0) -> DataFrame:
    """Enough measurements for the detector and a small enough chi2 per degree of freedom."""
    need = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])[F.col("det")]
    return segments.where((F.col("n_meas") >= need) & (F.col("chi2") / F.greatest(F.lit(1), F.col("ndf")) <= most))


def shared_hits(hits: DataFrame) -> DataFrame:
    """Pairs of segments of a window with the number of hits they share."""
    a, b = hits.alias("a"), hits.alias("b")
    met = a.join(b, F.expr("a.window_id = b.window_id AND a.hit_id = b.hit_id AND a.segment_id < b.segment_id"))
    return met.groupBy(F.col("a.window_id").alias("window_id"), F.col("a.segment_id").alias("s1"), F.col("b.segment_id").alias("s2")).agg(F.count("*").alias("shared"))


def without_duplicates(segments: DataFrame, hits: DataFrame, most: float = 0.7, tail: int = TAIL) -> DataFrame:
    """Best chi2 first (then the smaller id); a segment goes if it shares more than `most` of the smaller set with a kept one.

    segments: window_id, segment_id, chi2, ndf; hits: window_id, segment_id, hit_id, each
    once. A pair that shares hits carries both sizes and the worse one's quality.
    """
    quality = F.coalesce(F.col("chi2") / F.greatest(F.lit(1), F.col("ndf")), F.lit(float("inf")))
    known = segments.select("window_id", "segment_id", quality.alias("q"))
    sized = hits.withColumn("n", F.count("*").over(Window.partitionBy("window_id", "segment_id"))).join(known, ["window_id", "segment_id"])
    a = sized.select("window_id", "hit_id", F.col("segment_id").alias("better"), F.col("q").alias("_q"), F.col("n").alias("_n"))
    b = sized.select("window_id", "hit_id", F.col("segment_id").alias("worse"), "q", "n")
    met = a.join(b, ["window_id", "hit_id"]).where((F.col("_q") < F.col("q")) | ((F.col("_q") == F.col("q")) & (F.col("better") < F.col("worse"))))
    clash = met.groupBy("window_id", "better", "worse", "q", "_n", "n").agg(F.count("*").alias("shared")).where(F.col("shared") > most * F.least("_n", "n"))
    gone = losers(clash.select("window_id", "better", "worse", "q"), ["window_id"], ["q"], tail)
    return segments.join(gone.withColumnRenamed("node", "segment_id"), ["window_id", "segment_id"], "left_anti")


def boundaries(surfaces: DataFrame) -> DataFrame:
    """det, plane: half way between the last surface of a detector and the first of the next, along the beam. surfaces: det, x."""
    ends = surfaces.groupBy("det").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    after = ends.select((F.col("det") - 1).alias("det"), F.col("lo").alias("next"))
    return ends.join(after, "det").select("det", ((F.col("hi") + F.col("next")) / 2).alias("plane"))


#: the least part of a direction along the beam with which a piece can be extrapolated
LEAST_SLOPE = 1e-6


def _pieces(ends: DataFrame, end: str, name: str, back: int = 0) -> DataFrame:
    """One end of each piece: window_id, det (that of the upstream one), its id, place, direction (d) and unit direction (u)."""
    size = F.sqrt(sum(F.col(f"{end}_d{c}") * F.col(f"{end}_d{c}") for c in "xyz"))
    return ends.select(
        "window_id", (F.col("det") - back).alias("det"), F.col("segment_id").alias(name),
        *[F.col(f"{end}_{c}").alias(c) for c in ("x", "y", "z", "dx", "dy", "dz")], *[F.try_divide(F.col(f"{end}_d{c}"), size).alias(f"u{c}") for c in "xyz"],
    )


def _at_plane(pieces: DataFrame) -> DataFrame:
    """Pieces with y, z where their line meets x = plane, without those that run along it."""
    step = (F.col("plane") - F.col("x")) / F.col("dx")
    return pieces.where(F.abs("dx") >= LEAST_SLOPE).withColumns({c: F.col(c) + F.col(f"d{c}") * step for c in "yz"})


def _met(up: DataFrame, down: DataFrame, keys: list[str], max_dist: float, max_angle: float, angle_weight: float) -> DataFrame:
    """Pairs on one plane, by the nine cells of max_dist around the upstream piece."""
    side = max(max_dist, 1e-9)
    cell = lambda c: F.floor(F.col(c) / side)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    kept = ("y", "z", "ux", "uy", "uz")
    u = up.withColumn("_o", F.explode(around)).select(*keys, "up", *[F.col(c).alias(f"_{c}") for c in kept], (cell("y") + F.col("_o.i")).alias("_i"), (cell("z") + F.col("_o.j")).alias("_j"))
    d = down.select(*keys, "down", *kept, cell("y").alias("_i"), cell("z").alias("_j"))
    off = (F.col("_y") - F.col("y"), F.col("_z") - F.col("z"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sum((F.col(f"_{c}") * F.col(c) for c in ("uy", "uz")), F.col("_ux") * F.col("ux"))))
    judged = u.join(d, [*keys, "_i", "_j"]).withColumns({"square": off[0] * off[0] + off[1] * off[1], "angle": F.acos(cosine)})
    judged = judged.withColumn("dist", F.sqrt("square")).where((F.col("dist") <= max_dist) & (F.col("angle") <= max_angle))
    return judged.select("window_id", F.col("det").cast("int").alias("det"), "up", "down", "dist", "angle", (F.col("square") + angle_weight * F.col("angle") * F.col("angle")).alias("score"))


def splice_candidates(ends: DataFrame, planes: DataFrame, max_dist: float = 15.0, max_angle: float = 0.1, angle_weight: float = 100.0) -> DataFrame:
    """Pieces of adjacent detectors whose lines meet at the plane between them: up, down, dist, angle, score.

    ends: window_id, segment_id, det, and place and direction of both ends, b_ the back
    (downstream) and f_ the front one: b_x, b_y, b_z, b_dx, ... planes: as boundaries()
    gives them. The back of the upstream and the front of the downstream piece are both
    extrapolated to the plane; a piece without direction along the beam has no candidates.
    """
    fixed = F.broadcast(planes)  # one row a detector
    up = _at_plane(_pieces(ends, "b", "up").join(fixed, "det"))
    down = _at_plane(_pieces(ends, "f", "down", back=1).join(fixed, "det"))
    return _met(up, down, ["window_id", "det"], max_dist, max_angle, angle_weight)


def stitch_candidates(ends: DataFrame, max_dist: float = 15.0, max_angle: float = 0.1, angle_weight: float = 100.0) -> DataFrame:
    """Like splice_candidates(), but the upstream piece is extrapolated to where the downstream one starts, which stays as it is.

    Starts lie on the surfaces of a detector, so an upstream piece meets each of the
    planes on which a piece of its window starts once, not each piece.
    """
    down = _pieces(ends, "f", "down", back=1).withColumn("plane", F.col("x"))
    planes = down.select("window_id", "det", "plane").distinct()
    up = _at_plane(_pieces(ends, "b", "up").join(planes, ["window_id", "det"]))
    return _met(up, down, ["window_id", "det", "plane"], max_dist, max_angle, angle_weight)


def _both_free(used: tuple[set[int], set[int]], row: tuple) -> tuple | None:
    det, up, down = row
    if up in used[0] or down in used[1]:
        return None
    used[0].add(up)
    used[1].add(down)
    return det, up, down


def _best_of_both(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that come first at both of their ends, and those with two free ends after that."""
    rank = F.struct("score", "up", "down")
    first = lambda side: live.groupBy("window_id", side).agg(F.min(rank).alias(f"_{side}"))
    taken = live.join(first("up"), ["window_id", "up"]).join(first("down"), ["window_id", "down"]).where((F.col("_up") == rank) & (F.col("_down") == rank)).select(live.columns)
    left = live
    for side in ("up", "down"):
        left = left.join(taken.select("window_id", side), ["window_id", side], "left_anti")
    return taken, left.select(live.columns)


def link(candidates: DataFrame, tail: int = TAIL) -> DataFrame:
    """Links of each window in order of (score, up, down), each side used once.

    Windows above `tail` candidates in rounds of links that are the best at both ends.
    """
    slim = candidates.select("window_id", "det", "up", "down", F.round("score", 9).alias("score"))
    taken, left = in_rounds(slim, ["window_id"], _best_of_both, tail)
    walked = walk(left, ["window_id"], ["score", "up", "down"], ["det", "up", "down"], lambda: (set(), set()), _both_free, "window_id long, det int, up long, down long")
    return walked if taken is None else walked.unionByName(taken.drop("score"))


def chains(links: DataFrame) -> DataFrame:
    """first, second, third (null in chains of two, of detectors 0, 1 or 1, 2)."""
    a = links.where("det = 0").select("window_id", F.col("up").alias("first"), F.col("down").alias("second"))
    b = links.where("det = 1").select("window_id", F.col("up").alias("second"), F.col("down").alias("third"))
    return a.join(b, ["window_id", "second"], "full").select(
        "window_id", F.coalesce("first", "second").alias("first"), F.when(F.col("first").isNull(), F.col("third")).otherwise(F.col("second")).alias("second"),
        F.when(F.col("first").isNull(), F.lit(None)).otherwise(F.col("third")).alias("third"),
    )


def accepted_chains(found: DataFrame, links: DataFrame, three: Column, score: str = "score") -> DataFrame:
    """Chains of three that `three` rejects fall back to the better of their two links, the first in a tie.

    found: as chains() gives them; links: window_id, up, down and a score, smaller is better;
    three: a predicate over the columns of found.
    """
    first = links.select("window_id", F.col("up").alias("first"), F.col("down").alias("second"), F.col(score).alias("_s1"))
    second = links.select("window_id", F.col("up").alias("second"), F.col("down").alias("third"), F.col(score).alias("_s2"))
    rejected = F.col("third").isNotNull() & ~F.coalesce(three, F.lit(False))
    known = found.withColumn("_rejected", rejected).join(first, ["window_id", "first", "second"], "left").join(second, ["window_id", "second", "third"], "left")
    later = F.col("_rejected") & (F.col("_s2") < F.col("_s1"))
    return known.select(
        "window_id", F.when(later, F.col("second")).otherwise(F.col("first")).alias("first"), F.when(later, F.col("third")).otherwise(F.col("second")).alias("second"),
        F.when(~F.col("_rejected"), F.col("third")).alias("third"),
    )


def remaining(hits: DataFrame, taken: DataFrame) -> DataFrame:
    """Hits of the pool that no accepted piece has taken."""
    return hits.join(taken.select("window_id", "hit_id").distinct(), ["window_id", "hit_id"], "left_anti")


def local_tracks(segments: DataFrame, linked: DataFrame) -> DataFrame:
    """Segments that no chain has absorbed."""
    used = linked.select("window_id", F.explode(F.array("up", "down")).alias("segment_id")).distinct()
    return segments.join(used, ["window_id", "segment_id"], "left_anti")


def type_mask(members: DataFrame, keys: list[str]) -> DataFrame:
    """A bit for every detector in a chain."""
    return members.groupBy(*keys).agg(F.bit_or(F.expr("shiftleft(1, det)")).alias("mask"))


def _openers(states: DataFrame, keys: list[str], order: list[str], fits) -> DataFrame:
    """states with _opens and _closes: a greedy walk pairs a state with the next one where fits(next column) holds.

    In a run of states that each could pair with the next, every second one opens a pair.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    x = states.withColumn("_fits", F.coalesce(fits(lambda c: F.lead(c).over(w)), F.lit(False)))
    x = x.withColumn("_new", (~F.coalesce(F.lag("_fits").over(w), F.lit(False))).cast("int"))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order)) - 1)
    return x.withColumns({"_opens": (F.col("_k") % 2 == 0) & F.col("_fits"), "_closes": F.col("_k") % 2 == 1})


def pair_states(states: DataFrame, keys: list[str], max_dz: float = 5.0, min_tilt: float = 0.01) -> DataFrame:
    """Adjacent states of opposite tilt become one, greedily from small z.

    states: keys, seq, z, x, y, tilt, chi2 and, where they are there, phi and tan_lambda.
    A pair has the mean place and direction, the sum of chi2, tilt 0 and loc0 0.
    """
    fits = lambda nxt: (F.col("tilt") * nxt("tilt") < 0) & (F.abs("tilt") > min_tilt) & (F.abs(nxt("tilt")) > min_tilt) & (F.abs(nxt("z") - F.col("z")) < max_dz)
    x = _openers(states, keys, ["z", "seq"], fits)
    nxt = lambda c: F.lead(c).over(Window.partitionBy(*keys).orderBy("z", "seq"))
    opens = F.col("_opens")
    values = {c: F.when(opens, (F.col(c) + nxt(c)) / 2).otherwise(F.col(c)) for c in ("x", "y", "z", "phi", "tan_lambda") if c in states.columns}
    values |= {"chi2": F.when(opens, F.col("chi2") + nxt("chi2")).otherwise(F.col("chi2")), "tilt": F.when(opens, 0.0).otherwise(F.col("tilt"))}
    values |= {"loc0": F.when(opens, 0.0).otherwise(F.col("loc0"))} if "loc0" in states.columns else {}
    done = x.select(*keys, "seq", *[v.alias(k) for k, v in values.items()], opens.alias("paired"), "_closes")
    return done.where("NOT _closes").drop("_closes")


def stereo_points(states: DataFrame, keys: list[str], angle: float = 5.0, max_dz: float = 5.0, min_tilt: float = 0.01, order: tuple[str, ...] = ("z", "seq")) -> DataFrame:
    """Points of a track from the strips themselves: keys, seq, paired, x, y, z.

    A tilted state and the next one in order, if that is tilted the other way and nearer
    than max_dz, are one point: x = (u + v) / 2, y = (v - u) / (2 tan angle) with u the
    loc0 of the positive and v of the negative tilt, whichever comes first, at their mean
    z. States without a partner and those without tilt keep the place that was fitted.
    """
    fits = lambda nxt: (F.abs("tilt") > min_tilt) & (F.abs(nxt("z") - F.col("z")) < max_dz) & (F.col("tilt") * nxt("tilt") < 0)
    found = _openers(states, keys, list(order), fits)
    nxt = lambda c: F.lead(c).over(Window.partitionBy(*keys).orderBy(*order))
    opens, first_u = F.col("_opens"), F.col("tilt") > 0
    u, v = F.when(first_u, F.col("loc0")).otherwise(nxt("loc0")), F.when(first_u, nxt("loc0")).otherwise(F.col("loc0"))
    paired = {"x": (u + v) / 2, "y": (v - u) / (2 * math.tan(math.radians(angle))), "z": (F.col("z") + nxt("z")) / 2}
    points = found.select(*keys, "seq", opens.alias("paired"), *[F.when(opens, p).otherwise(F.col(c)).alias(c) for c, p in paired.items()], "_closes")
    return points.where("NOT _closes").drop("_closes")


def number_states(states: DataFrame, keys: list[str], order: str = "reversed") -> DataFrame:
    """state_idx from 0, the largest z first ("beam": the smallest), and nmeas."""
    z = F.desc("z") if order == "reversed" else F.asc("z")
    w = Window.partitionBy(*keys).orderBy(z, F.desc("seq") if order == "reversed" else F.asc("seq"))
    return states.withColumn("state_idx", F.row_number().over(w) - 1).withColumn("nmeas", F.count("*").over(Window.partitionBy(*keys)))


def in_slab(points: DataFrame, slabs: list[tuple[float, float, float, float, float, float, float]]) -> DataFrame:
    """points with by: the field of the first slab that holds them, else 0. slabs: x, y and z from and to, and the field."""
    by = F.lit(0.0)
    for xlo, xhi, ylo, yhi, zlo, zhi, field in reversed(slabs):
        inside = F.col("x").between(xlo, xhi) & F.col("y").between(ylo, yhi) & F.col("z").between(zlo, zhi)
        by = F.when(inside, F.lit(float(field))).otherwise(by)
    return points.withColumn("by", by)


def region_tally(states: DataFrame, bounds: tuple[float, float] = (-150.0, 250.0), outlier: float = 3.0, hole: Column | None = None) -> DataFrame:
    """States, inliers, outliers (chi2 above a limit) and holes (states without a measurement) of each window and region along z."""
    region = F.when(F.col("z") < bounds[0], "SiTarget").when(F.col("z") < bounds[1], "SiPad").otherwise("MTC")
    empty = F.coalesce(hole, F.lit(False)) if hole is not None else F.lit(False)
    far = F.coalesce(F.col("chi2") > outlier, F.lit(False))
    return states.groupBy("window_id", region.alias("region")).agg(
        F.count("*").alias("n_states"), F.count_if(~empty & ~far).alias("n_inliers"), F.count_if(~empty & far).alias("n_outliers"), F.count_if(empty).alias("n_holes")
    )

"""Particles, histograms, sample quality, truth comparison and display tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators.ordered import walk
from hitloom.operators.selection import median, upper_median


def is_primary() -> Column:
    return F.col("generator_status") == 1


def is_final() -> Column:
    return F.col("n_daughters") == 0


def is_muon(pdg: str = "pdg") -> Column:
    return F.abs(pdg) == 13


def energy() -> Column:
    return F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2 + F.col("mass") ** 2)


def multiplicities(particles: DataFrame) -> DataFrame:
    e = energy()
    return particles.groupBy("event_idx").agg(
        F.count("*").alias("n"), F.count_if(is_primary()).alias("n_primary"), F.count_if(is_final()).alias("n_final"),
        F.sum(F.when(is_primary(), e).otherwise(0.0)).alias("e_primary"), F.sum(F.when(is_final(), e).otherwise(0.0)).alias("e_final"),
    )


def opening_angle(particles: DataFrame) -> DataFrame:
    """Degrees between the first two primaries with momentum of each event that has two."""
    p = F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2)
    some = particles.where(is_primary()).withColumn("p", p).where("p > 0")
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("event_idx").orderBy("particle_idx"))).where("r <= 2")
    at = {f"{c}{i}": F.max(F.when(F.col("r") == i, F.col(c))) for c in ("px", "py", "pz", "p") for i in (1, 2)}
    x = some.groupBy("event_idx").agg(*[v.alias(k) for k, v in at.items()]).where("p2 IS NOT NULL")
    cosine = (F.col("px1") * F.col("px2") + F.col("py1") * F.col("py2") + F.col("pz1") * F.col("pz2")) / (F.col("p1") * F.col("p2"))
    return x.select("event_idx", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).alias("angle"))


def bin_index(v: Column, lo: float, hi: float, n: int) -> Column:
    """0 .. n - 1, -1 below and n above."""
    return F.greatest(F.lit(-1), F.least(F.lit(n), F.floor((v - lo) / (hi - lo) * n).cast("int")))


def histogram(df: DataFrame, column: str, lo: float, hi: float, n: int) -> DataFrame:
    return df.groupBy(bin_index(F.col(column), lo, hi, n).alias("bin")).agg(F.count("*").alias("entries"))


# The histograms of an analysis of particles: what they are of, the value, bins, from, to.
# E is the largest energy, N the largest number of particles expected.
MC_HISTOGRAMS = {
    "h_nMCParticles": ("event", "n", 200, 0.0, "N"),
    "h_nPrimaries": ("event", "n_primary", 10, -0.5, 9.5),
    "h_nFinal": ("event", "n_final", 200, 0.0, "N"),
    "h_pdg_primary": ("primary", "pdg", 501, -250.5, 250.5),
    "h_E_primary": ("primary", "energy", 200, 0.0, "E"),
    "h_theta_primary": ("moving", "theta", 300, 0.0, 15.0),
    "h_phi_primary": ("moving", "phi", 72, -180.0, 180.0),
    "h_openingAngle": ("pair", "angle", 500, 0.0, 10.0),
    "h_vtx_x": ("primary", "vx", 100, -50.0, 50.0),
    "h_vtx_y": ("primary", "vy", 100, -50.0, 50.0),
    "h_vtx_z": ("primary", "vz", 200, -1100.0, 900.0),
    "h_E_final": ("final", "energy", 200, 0.0, "E"),
    "h_Esum_primary": ("event", "e_primary", 200, 0.0, "2E"),
    "h_Esum_final": ("event", "e_final", 200, 0.0, "2E"),
}


def mc_ranges(max_energy: float, max_particles: float) -> dict[str, tuple[str, str, int, float, float]]:
    ends = {"E": max_energy, "2E": 2 * max_energy, "N": max_particles}
    return {k: (of, v, n, lo, float(ends.get(hi, hi))) for k, (of, v, n, lo, hi) in MC_HISTOGRAMS.items()}


def mc_histograms(particles: DataFrame, max_energy: float, max_particles: float) -> DataFrame:
    """All of MC_HISTOGRAMS as one table: hist, bin (-1 below, n above), entries.

    particles: event_idx, particle_idx, pdg, generator_status, n_daughters, mass, px, py, pz, vx, vy, vz.
    """
    p = F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2)
    each = particles.withColumns({"energy": energy(), "p": p, "theta": F.degrees(F.acos(F.col("pz") / p)), "phi": F.degrees(F.atan2("py", "px"))})
    ranges = mc_ranges(max_energy, max_particles)

    def filled(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
        """One row an entry of every histogram that a row of df fills: a single pass, counted before the shuffle."""
        fills = [F.when(conditions[of], F.struct(F.lit(k).alias("hist"), bin_index(F.col(v).cast("double"), lo, hi, n).alias("bin"))) for k, (of, v, n, lo, hi) in ranges.items() if of in conditions]
        x = df.select(F.explode(F.filter(F.array(*fills), lambda f: f.isNotNull())).alias("f")).select("f.*")
        return x.groupBy("hist", "bin").agg(F.count("*").alias("entries"))

    moving = is_primary() & (F.col("p") > 0)
    parts = [
        filled(each, {"primary": is_primary(), "moving": moving, "final": is_final()}),
        filled(multiplicities(particles), {"event": F.lit(True)}),
        filled(opening_angle(particles), {"pair": F.lit(True)}),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def histogram_2d(df: DataFrame, x: str, y: str, range_x: tuple[float, float, int], range_y: tuple[float, float, int]) -> DataFrame:
    return df.groupBy(bin_index(F.col(x), *range_x).alias("bin_x"), bin_index(F.col(y), *range_y).alias("bin_y")).agg(F.count("*").alias("entries"))


def histogram_means(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Mean of the entries in range of several columns, in one pass."""
    pairs = F.explode(F.create_map(*[x for c in ranges for x in (F.lit(c), F.col(c).cast("double"))]))
    long = df.select(pairs.alias("hist", "value"))
    lo, hi = (F.create_map(*[F.lit(x) for c, r in ranges.items() for x in (c, float(r[i]))])[F.col("hist")] for i in (0, 1))
    inside = (F.col("value") >= lo) & (F.col("value") < hi)
    return long.groupBy("hist").agg(F.avg(F.when(inside, F.col("value"))).alias("mean"), F.count_if(inside).alias("n"))


def auto_histograms(df: DataFrame, columns: list[str], n: int = 100) -> DataFrame:
    """n bins between each column's smallest and largest value."""
    ends = df.agg(*[f(c).cast("double").alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    x = df.select(*columns).crossJoin(F.broadcast(ends))  # one row
    long = x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in columns])).alias("s")).select("s.*")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(n - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n).cast("int"))).otherwise(0)
    return long.where("v IS NOT NULL").groupBy("column", place.alias("bin")).agg(F.count("*").alias("entries"))


def sample_keys(files: DataFrame) -> DataFrame:
    """Pair and angle from a sample's file name."""
    pattern = r"tracks_(\w+?)_angle_([\d.]+)\."
    return files.withColumns({"pair": F.regexp_extract("file_name", pattern, 1), "angle": F.regexp_extract("file_name", pattern, 2)})


def sample_quality(windows: DataFrame, tracks: DataFrame, expected: dict[str, int]) -> DataFrame:
    """windows: pair, angle, window; tracks: window, quality. Windows without tracks count.

    Shares of windows with the expected number and with any track, the upper median
    of quality, and how many windows have how many tracks.
    """
    n = tracks.groupBy("window").agg(F.count("*").alias("n_tracks"))
    per = windows.join(n, "window", "left").withColumn("n_tracks", F.coalesce("n_tracks", F.lit(0)))
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[F.col("pair")]
    keys = ["pair", "angle"]
    base = per.groupBy(*keys).agg(
        F.count("*").alias("n_windows"), (100 * F.count_if(F.col("n_tracks") == want) / F.count("*")).alias("percent_expected"), (100 * F.count_if(F.col("n_tracks") > 0) / F.count("*")).alias("percent_any"),
    )
    spread = per.groupBy(*keys, "n_tracks").agg(F.count("*").alias("c")).groupBy(*keys).agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("n_tracks", "c"))), lambda s: F.concat(s["n_tracks"].cast("string"), F.lit(":"), s["c"].cast("string")))).alias("distribution")
    )
    median = upper_median(tracks.join(windows, "window"), keys, "quality", "median_quality")
    return base.join(spread, keys).join(median, keys, "left")


def energy_weighted(hits: DataFrame, keys: list[str], dz: float = 5.0) -> DataFrame:
    """Per z bin with both stereo planes: the mean of the planes' energy-weighted x."""
    per = hits.where("plane < 2").groupBy(*keys, F.floor(F.col("z") / dz).alias("zbin"), "plane").agg((F.sum(F.col("e") * F.col("x")) / F.sum("e")).alias("c"))
    both = per.groupBy(*keys, "zbin").agg(F.count("*").alias("planes"), F.avg("c").alias("x"))
    return both.where("planes = 2").select(*keys, "zbin", "x")


def recovered(hits: DataFrame, keys: list[str], dz: float = 5.0) -> DataFrame:
    """Points of the stereo planes per bin round(z / dz): keys, zbin, x, z, energy, paired.

    A bin with both planes gives one: the mean of the planes' energy-weighted x and z, the
    summed energy. Each hit of a bin with one plane gives its own z and energy, its x
    linear in z between the pairs around it; outside their range it goes. Bins round
    halves to even, energies of sum 0 count as 1e-30.
    """
    x = hits.where("plane < 2").withColumn("zbin", F.bround(F.col("z") / dz).cast("long"))
    total = F.when(F.sum("e") == 0, 1e-30).otherwise(F.sum("e"))
    per = x.groupBy(*keys, "zbin", "plane").agg((F.sum(F.col("e") * F.col("x")) / total).alias("x"), (F.sum(F.col("e") * F.col("z")) / total).alias("z"), total.alias("energy"))
    bins = per.groupBy(*keys, "zbin").agg(F.count("*").alias("planes"), F.avg("x").alias("x"), F.avg("z").alias("z"), F.sum("energy").alias("energy"))
    both = bins.where("planes = 2").select(*keys, "zbin", "x", "z", "energy", F.lit(True).alias("paired"))
    single = x.join(bins.where("planes = 1").select(*keys, "zbin"), [*keys, "zbin"]).select(*keys, "zbin", F.col("z").cast("double").alias("z"), F.col("e").cast("double").alias("energy"))
    # hits of one place share their x, so a place is asked once
    places = single.select(*keys, "z").distinct().withColumn("tid", F.lit(0).cast("long"))
    at = interpolate(places, both, keys, outside="drop").drop("tid")
    return both.unionByName(single.join(at, [*keys, "z"]).withColumn("paired", F.lit(False)))


def interpolate(targets: DataFrame, known: DataFrame, keys: list[str], outside: str = "clamp") -> DataFrame:
    """targets: keys, tid, z. known: keys, z, x. Adds x at each z: linear between the neighbours.

    outside: "clamp" takes the nearest end, "drop" leaves those rows out.
    """
    a = known.groupBy(*keys, "z").agg(F.avg("x").alias("x")).select(*keys, "z", "x", F.lit(None).cast("long").alias("tid"))
    b = targets.select(*keys, "z", F.lit(None).cast("double").alias("x"), "tid")
    w = Window.partitionBy(*keys).orderBy("z", F.col("tid").asc_nulls_first())
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.desc("z"), F.col("tid").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("tid").isNull(), F.struct("z", "x"))
    x = a.unionByName(b).withColumn("_l", F.last(point, ignorenulls=True).over(back)).withColumn("_r", F.last(point, ignorenulls=True).over(ahead)).where("tid IS NOT NULL")
    slope = (F.col("_r.x") - F.col("_l.x")) / (F.col("_r.z") - F.col("_l.z"))
    value = F.when(F.col("_l.z") == F.col("_r.z"), F.col("_l.x")).otherwise(F.col("_l.x") + slope * (F.col("z") - F.col("_l.z")))
    if outside == "drop":
        return x.where("_l IS NOT NULL AND _r IS NOT NULL").select(*keys, "tid", "z", value.alias("x"))
    return x.where("_l IS NOT NULL OR _r IS NOT NULL").select(*keys, "tid", "z", F.coalesce(value, F.col("_l.x"), F.col("_r.x")).alias("x"))


def parabola(points: DataFrame, keys: list[str], least: int = 3, field: float = 1.7, spread: float = 1e-9) -> DataFrame:
    """x = x0 + slope d + curvature d^2 / 2 with d = z - mean z, by sums and Cramer's rule.

    keys, n, x0, slope, curvature, radius (mm, as z and x are) and momentum (GeV, with the
    sign of the radius); the last two null for a straight track. Groups of fewer than
    `least` points, or whose determinant is below `spread` (fewer than three places), go.
    """
    mean = Window.partitionBy(*keys)
    p = points.withColumn("d", F.col("z") - F.avg("z").over(mean))
    s = p.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col("d") ** k).alias(f"s{k}") for k in range(1, 5)], *[F.sum(F.col("x") * F.col("d") ** k).alias(f"t{k}") for k in range(3)]).where(F.col("n") >= least)
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = det(n, s1, s2, s1, s2, s3, s2, s3, s4)
    c0, c1, c2 = det(t0, s1, s2, t1, s2, s3, t2, s3, s4), det(n, t0, s2, s1, t1, s3, s2, t2, s4), det(n, s1, t0, s1, s2, t1, s2, s3, t2)
    solved = s.where(F.abs(whole) > spread).select(*keys, "n", (c0 / whole).alias("x0"), (c1 / whole).alias("slope"), (2 * c2 / whole).alias("curvature"))
    bent = F.abs("curvature") >= 2e-20
    radius = F.when(bent, 1 / F.col("curvature"))
    return solved.withColumns({"radius": radius, "momentum": momentum(radius, field)})


def residuals(pairs: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """pairs: keys, z, x, truth."""
    d = F.col("x") - F.col("truth")
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(d)).alias("mean_abs"), F.max(F.abs(d)).alias("max_abs"), F.min_by(d, F.struct("z", "x", d.alias("d"))).alias("first"), F.max_by(d, F.struct("z", "x", d.alias("d"))).alias("last")
    ).where(F.col("n") >= least)


def _next_of_path(path: list[tuple[float, float]], row: tuple) -> tuple:
    """One candidate: it. Several: first the most energetic, then the nearest to the one before, then the nearest to
    the line through the last two at the candidates' mean z; the first in a tie."""
    zbin, found = row
    if len(found) == 1:
        at = found[0]
    elif not path:
        at = max(found, key=lambda c: c["e"])
    else:
        (c0, z0), (c1, z1) = path[0], path[-1]
        mean = sum(c["z"] for c in found) / len(found)
        goal = c1 + (mean - z1) * (c1 - c0) / (z1 - z0) if z1 != z0 else c1
        at = min(found, key=lambda c: abs(c["c"] - goal))
    path[:] = [*path[-1:], (at["c"], at["z"])]
    return zbin, at["c"], at["z"]


def follow_paths(candidates: DataFrame, keys: list[str], width: float = 5.0) -> DataFrame:
    """candidates: keys, coord, z, e. One path through each group, a bin of z at a time: keys, zbin, coord, z.

    Bins are z / width rounded half to even; coord and z are those of the chosen candidate.
    Ties go by z, then coord, then e. Candidates without z, coord or e are left out.
    """
    fine = candidates.dropna(subset=["coord", "z", "e"]).withColumn("zbin", F.rint(F.col("z") / width).cast("long"))
    found = F.array_sort(F.collect_list(F.struct(F.col("z").cast("double").alias("z"), F.col("coord").cast("double").alias("c"), F.col("e").cast("double").alias("e"))))
    bins = fine.groupBy(*keys, "zbin").agg(found.alias("found"))
    schema = ", ".join(f"{k} {candidates.schema[k].dataType.simpleString()}" for k in keys)
    return walk(bins, keys, ["zbin"], ["zbin", "found"], list, _next_of_path, schema + ", zbin long, coord double, z double")


def campaign_medians(fits: DataFrame) -> DataFrame:
    """fits: radius, radius_truth. One row, medians null where nothing is to be ranked."""
    both = fits.select(F.abs("radius").alias("radius"), F.abs(F.try_divide(F.col("radius_truth"), F.col("radius"))).alias("ratio"))
    values = both.select(F.explode(F.create_map(F.lit("radius"), "radius", F.lit("ratio"), "ratio")).alias("what", "value"))
    found = median(values, ["what"], "value", "m").groupBy().agg(*[F.max(F.when(F.col("what") == w, F.col("m"))).alias(f"median_{w}") for w in ("radius", "ratio")])
    counts = fits.agg(F.count_if(F.signum("radius") == F.signum("radius_truth")).alias("same_sign"), F.count("*").alias("n"))
    return found.crossJoin(F.broadcast(counts))  # one row each


def gun_direction(i: Column, n: int, angle_deg: float, phi: Column) -> dict[str, Column]:
    """Direction of primary i of n: spread evenly over an opening angle, turned by phi."""
    theta = F.radians((i - (n - 1) / 2) * (angle_deg / max(n - 1, 1)))
    return {"dx": F.sin(theta) * F.cos(phi), "dy": F.sin(theta) * F.sin(phi), "dz": F.cos(theta)}


def select_hits(hits: DataFrame, window_id: int, filters: dict[str, int], z_range: tuple[float, float]) -> DataFrame:
    """One window's hits for display, in cm."""
    x = hits.where((F.col("window_id") == window_id) & F.col("z").between(*z_range))
    for k, v in filters.items():
        x = x.where(F.col(k) == v)
    return x.withColumns({c: F.col(c) / 10 for c in ("x", "y", "z")})


def labels(rows: DataFrame, defaults: dict[int, str], overrides: dict[int, str]) -> DataFrame:
    """A species' label by |pdg|: an override, else the default, else "other"."""
    table = F.create_map(*[F.lit(x) for kv in {**defaults, **overrides}.items() for x in kv])
    return rows.withColumn("label", F.coalesce(table[F.abs("pdg")], F.lit("other")))


def z_extents(hits: DataFrame, keys: list[str], margin: float = 3.0) -> DataFrame:
    """Range of z with a margin, and the different z to 4 decimals in order."""
    return hits.groupBy(*keys).agg((F.min("z") - margin).alias("z_lo"), (F.max("z") + margin).alias("z_hi"), F.array_sort(F.collect_set(F.round("z", 4))).alias("layers"))


def track_points(tracks: DataFrame, points: DataFrame, layers: DataFrame, parts: int | None = None) -> DataFrame:
    """Points of tracks with two or more, else the seed's x, y on each of the window's layers; tracks with less than two in the end are left out.

    tracks: window_id, track_id, seed_x, seed_y. points: of tracks, after pairing. layers: window_id, z.
    parts: partitions for what meets by window, where given; tracks and points meet as they are dealt.
    """
    keys = ["window_id", "track_id"]
    by = lambda df, *c: df.repartition(parts, *c) if parts else df
    n = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    known = tracks.join(n, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    fitted = points.join(known.where("_n >= 2").select(*keys), keys, "left_semi").select(*keys, "x", "y", "z", F.lit("fit").alias("kind"))
    several = by(layers, "window_id").withColumn("_layers", F.count("*").over(Window.partitionBy("window_id"))).where("_layers >= 2").drop("_layers")
    seed = by(known.where("_n < 2").select(*keys, F.col("seed_x").alias("x"), F.col("seed_y").alias("y")), "window_id").join(several, "window_id")
    return fitted.unionByName(seed.select(*keys, "x", "y", "z", F.lit("seed").alias("kind")))


def momentum(radius: Column, field: float = 1.7) -> Column:
    """GeV from a radius in mm and a field in T."""
    return 0.3 * field * (radius / 1000.0)


def panel_hits(hits: DataFrame, keys: list[str], dz: float = 5.0) -> DataFrame:
    """What the two side views show of every detector: keys, panel ("zx" or "zy"), detector, coord, z, e.

    SiTarget strips show on the side that they measure, plane 0 along x and 1 along y;
    SciFi on zx by recovered(), on zy by every hit; pads and Scint on both.
    hits: keys, detector, plane, x, y, z, e.
    """
    strip, fibre = F.col("detector") == "SiTarget", F.col("detector") == "SciFi"
    zx, zy = (F.struct(F.lit(p).alias("panel"), F.col(c).cast("double").alias("coord")) for p, c in (("zx", "x"), ("zy", "y")))
    sides = F.when(strip & (F.col("plane") == 0), F.array(zx)).when(strip & (F.col("plane") == 1), F.array(zy)).when(strip, F.array().cast("array<struct<panel:string,coord:double>>")).when(fibre, F.array(zy)).otherwise(F.array(zx, zy))
    shown = hits.select(*keys, "detector", F.col("z").cast("double").alias("z"), F.col("e").cast("double").alias("e"), F.explode(sides).alias("s")).select(*keys, "s.panel", "detector", "s.coord", "z", "e")
    fibres = recovered(hits.where(fibre), keys, dz).select(*keys, F.lit("zx").alias("panel"), F.lit("SciFi").alias("detector"), F.col("x").alias("coord"), "z", F.col("energy").alias("e"))
    return shown.unionByName(fibres)


def window_layers(measurements: DataFrame, keys: list[str], order: list[str], of: tuple[str, ...] = ("detector",), parts: int | None = None) -> DataFrame:
    """keys, z: of each detector the first z of every millimetre (halves away from zero) in an order of its measurements; found in `parts` partitions where given."""
    first = F.min_by("z", F.struct(*order))
    by = [*keys, *of, "_mm"]
    x = measurements.withColumn("_mm", F.round("z")).select(*dict.fromkeys([*by, "z", *order]))
    return (x.repartition(parts, *by) if parts else x).groupBy(*by).agg(first.alias("z")).select(*keys, *of, "z")

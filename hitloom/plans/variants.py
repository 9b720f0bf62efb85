"""Registered plans on geometry variants, joins of track facts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitloom.functions import bitfields
from hitloom.operators import hits, physics, trials, variants
from hitloom.plans.hits import HIT_CTES, contributions, overlaid_hits
from hitloom.plans.physics import ST, TR, trial_table
from hitloom.plans.registry import plan
from hitloom.plans.tracks import BASE, decoded, states
from hitloom.sources import io
from hitloom.sources.shared import cut

# The baseline geometry
BASELINE = {
    "SiPad_NLayers": 10, "SiPad_NASUsX": 3, "SiPad_NASUsY": 3, "SiPad_NWafersX": 2, "SiPad_NWafersY": 2, "SiPad_WaferSizeX": 89.70, "SiPad_WaferSizeY": 89.70,
    "SiPad_WThickness": 10.0, "SiPad_dim_x": 540.0, "SiPad_dim_y": 540.0, "SiPad_NcellsX": 96, "SiPad_NcellsY": 96, "SiTarget_NLayers": 120, "SiTarget_ncols": 4,
    "SiTarget_nrows": 2, "SiTarget_sensor_width": 99.25, "SiTarget_sensor_height": 199.5, "SiTarget_WThickness": 3.5, "SiTarget_env_width": 400.0,
    "SiTarget_env_height": 400.0, "SiTarget_strip_pitch": 0.0755,
}


def baseline_map():
    return F.create_map(*[F.lit(x) for k, v in BASELINE.items() for x in (k, float(v))])


@plan("p23_analytic_metrics", TR + """, c AS (SELECT experiment, trial_id, n_layers * (3 * 2 * 89.7e0) * (3 * 2 * 89.7e0) / 1e6 AS a, 2e0 * 120 * (4 * 99.25e0) * (2 * 199.5e0) / 1e6 AS b,
n_layers * w_thickness * 540e0 * 540e0 / 1e3 * 19.3e0 / 1e3 AS c, 120 * 3.5e0 * 400e0 * 400e0 / 1e3 * 19.3e0 / 1e3 AS d FROM trials)
SELECT experiment, trial_id, round(30 * (a + b) + 0.1e0 * (c + d), 4) AS cost_proxy, round(a + b, 6) AS si_area_m2, round(c + d, 4) AS w_mass_kg FROM c""")
def p23(spark, sf_dir):
    t = trial_table(spark, sf_dir)
    changes = F.create_map(F.lit("SiPad_NLayers"), F.col("n_layers").cast("double"), F.lit("SiPad_WThickness"), F.col("w_thickness").cast("double"))
    m = variants.analytic_metrics(trials.overridden(baseline_map(), changes))
    return t.select("experiment", "trial_id", F.round(m["cost_proxy"], 4).alias("cost_proxy"), F.round(m["si_area_m2"], 6).alias("si_area_m2"), F.round(m["w_mass_kg"], 4).alias("w_mass_kg"))


@plan("p24_feasibility", TR + """SELECT experiment, trial_id, CAST(w_thickness <= 20 AS INT) + CAST(540e0 / n_layers - 30 - 1e-4 >= 1e-6 AS INT) AS passed, CAST(floor(540e0 / (30 + 1e-4 + w_thickness)) AS BIGINT) AS most FROM trials""")
def p24(spark, sf_dir):
    fits = variants.slack(F.lit(540.0), F.col("n_layers"), F.lit(30.0)) >= 1e-6
    why = variants.reasons({"thickness": F.col("w_thickness") <= 20, "slack": fits})
    return trial_table(spark, sf_dir).select("experiment", "trial_id", (2 - F.size(why)).alias("passed"), variants.most_layers(F.lit(540.0), F.lit(30.0), F.col("w_thickness")).alias("most"))


@plan("a24_occupancy", BASE + """, p AS (SELECT CAST(floor(strip / 10e0) AS INT) AS bx, CAST(floor(pad / 5e0) AS INT) AS b_y, strip % 16 < 15 AS live FROM numbered WHERE detector = 'SiPad')
SELECT least(4, bx) AS bin_x, least(4, b_y) AS bin_y, count(*) FILTER (WHERE live) AS live, count(*) AS total, CASE WHEN count(*) FILTER (WHERE live) = 0 THEN 'dead' WHEN count(*) FILTER (WHERE live) = count(*) THEN 'full' ELSE 'partly' END AS state FROM p GROUP BY 1, 2""")
def a24(spark, sf_dir):
    pads = decoded(spark, sf_dir, "SiPad").select((F.col("x") / 5.5).cast("int").alias("i"), (F.col("y") / 5.5 * 2).alias("y"))
    samples = pads.select(F.col("i").cast("double").alias("x"), "y", (F.col("i") % 16 < 15).alias("live"))
    return variants.occupancy(samples, 50.0, 5)


GRID = """vr AS (SELECT experiment, trial_id, 32e0 + n_layers AS size, 1 + trial_id % 3 / 4e0 AS pad, w_thickness / 20e0 AS gap FROM trials),
pt AS (SELECT experiment, trial_id, size, pad, gap, 16 * pad + 2 * gap AS whole, (i + 0.5e0) * (size / 24) AS x, (j + 0.5e0) * (size / 20) AS y FROM vr, range(24) a(i), range(20) b(j)),
ins AS (SELECT *, x - floor(x / whole) * whole - gap AS ix, y - floor(y / whole) * whole - gap AS iy FROM pt),
ras AS (SELECT *, ix >= 0 AND ix < 16 * pad AND iy >= 0 AND iy < 16 * pad AS live, floor(x / whole) * 16 + floor(ix / pad) AS gx, floor(y / whole) * 16 + floor(iy / pad) AS gy FROM ins)"""


PLANE = ("size", "pad", "gap")


def rastered(spark, sf_dir):
    """The trials' planes, and the sample grid of each different one: trials with the same plane share it."""
    t = trial_table(spark, sf_dir)
    planes = t.select("experiment", "trial_id", (32 + F.col("n_layers")).cast("double").alias("size"), (1 + F.col("trial_id") % 3 / 4).alias("pad"), (F.col("w_thickness") / 20).alias("gap"))
    return planes, variants.raster(planes.select(*PLANE).distinct(), 24, 20)


def of_planes(planes, found):
    """What was found of each plane, for every trial that has it."""
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}")) for c in PLANE]
    rest = [F.col(f"p.{c}") for c in found.columns if c not in PLANE]
    return planes.alias("t").join(found.alias("p"), same).select("t.experiment", "t.trial_id", *rest)


@plan("x6_raster", TR + f", {GRID} SELECT experiment, trial_id, count(*) AS n_samples, count(*) FILTER (WHERE live) AS n_live, count(DISTINCT CASE WHEN live THEN gy * 1000 + gx END) AS n_pads, CAST(max(CASE WHEN live THEN gx END) AS BIGINT) AS last_gx FROM ras GROUP BY 1, 2")
def x6(spark, sf_dir):
    """The sample grid of every trial's plane, and what coverage it has."""
    live = F.col("live")
    planes, samples = rastered(spark, sf_dir)
    x = samples.groupBy(*PLANE).agg(
        F.count("*").alias("n_samples"), F.count_if("live").alias("n_live"), F.countDistinct(F.when(live, F.col("gy") * 1000 + F.col("gx"))).alias("n_pads"), F.max(F.when(live, F.col("gx"))).alias("last_gx")
    )
    return of_planes(planes, x.withColumn("last_gx", F.col("last_gx").cast("long")))


@plan("x6_occupancy", TR + f""", {GRID} SELECT experiment, trial_id, least(3, CAST(floor(x / (size / 4)) AS INT)) AS bin_x, least(3, CAST(floor(y / (size / 4)) AS INT)) AS bin_y, count(*) FILTER (WHERE live) AS live, count(*) AS total,
CASE WHEN count(*) FILTER (WHERE live) = 0 THEN 'dead' WHEN count(*) FILTER (WHERE live) = count(*) THEN 'full' ELSE 'partly' END AS state FROM ras GROUP BY 1, 2, 3, 4""")
def x6b(spark, sf_dir):
    planes, samples = rastered(spark, sf_dir)
    return of_planes(planes, variants.occupancy(samples, F.col("size"), 4, PLANE))


@plan("j18_track_facts", ST + """, t AS (SELECT window_id, track_id, max(chi2) AS worst FROM track_states WHERE z > 60 GROUP BY 1, 2), a AS (SELECT DISTINCT window_id, track_id FROM track_states)
SELECT a.window_id, a.track_id, round(coalesce(worst, -1), 6) AS worst FROM a LEFT JOIN t ON a.window_id = t.window_id AND a.track_id = t.track_id""")
def j18(spark, sf_dir):
    s, keys = states(spark, sf_dir), ["window_id", "track_id"]
    facts = s.where("z > 60").groupBy(*keys).agg(F.max("chi2").alias("worst"))
    return s.select(*keys).distinct().join(facts, keys, "left").withColumn("worst", F.round(F.coalesce("worst", F.lit(-1.0)), 6))


@plan("p16_panel_hits", HIT_CTES + """, f AS (SELECT window_id, plane, x, z, e, CAST(round_even(z / 5e0, 0) AS BIGINT) AS zbin FROM hits WHERE detector = 'SciFi' AND plane < 2),
per AS (SELECT window_id, zbin, plane, sum(e * x) / sum(e) AS x, sum(e * z) / sum(e) AS z, sum(e) AS energy FROM f GROUP BY 1, 2, 3),
bins AS (SELECT window_id, zbin, count(*) AS planes, avg(x) AS x, avg(z) AS z, sum(energy) AS energy FROM per GROUP BY 1, 2), both_ AS (SELECT * FROM bins WHERE planes = 2),
one AS (SELECT f.* FROM f JOIN bins USING (window_id, zbin) WHERE planes = 1), lf AS (SELECT o.window_id, o.z, o.e, l.z AS lz, l.x AS lx FROM one o ASOF JOIN both_ l ON o.window_id = l.window_id AND o.z >= l.z),
lr AS (SELECT lf.*, r.z AS rz, r.x AS rx FROM lf ASOF JOIN both_ r ON lf.window_id = r.window_id AND lf.z <= r.z),
al AS (SELECT window_id, 'zx' AS panel, 'SciFi' AS detector, x AS coord, z, energy AS e FROM both_ UNION ALL SELECT window_id, 'zx', 'SciFi', CASE WHEN lz = rz THEN lx ELSE lx + (rx - lx) / (rz - lz) * (z - lz) END, z, e FROM lr
UNION ALL SELECT window_id, 'zx', detector, x, z, e FROM hits WHERE detector IN ('SiPad', 'Scint') OR detector = 'SiTarget' AND plane = 0 UNION ALL SELECT window_id, 'zy', detector, y, z, e FROM hits WHERE detector <> 'SiTarget' OR plane = 1)
SELECT window_id, panel, detector, round(coord, 6) + 0 AS coord, round(z, 6) AS z, round(e * 1e9, 2) AS e_ev FROM al""")
def p16(spark, sf_dir):
    of = lambda name: bitfields.get(bitfields.LAYOUTS[name], "plane", F.col("cell_id"))
    plane = F.when(F.col("detector") == "SiTarget", of("SiTarget")).when(F.col("detector") != "SiPad", of("MTC")).otherwise(0)
    h = cut(overlaid_hits(spark, sf_dir).withColumn("plane", plane), "hits")  # read by each step of the fibres' recovery
    x = physics.panel_hits(h, ["window_id"])
    return x.select("window_id", "panel", "detector", (F.round("coord", 6) + 0).alias("coord"), F.round("z", 6).alias("z"), F.round(F.col("e") * 1e9, 2).alias("e_ev"))


@plan("p28_gun_direction", TR + """SELECT experiment, trial_id, round(sin(radians((trial_id % 3 - 1) * 2.5e0)) * cos(wall_time_s / 100e0), 5) + 0 AS dx, round(cos(radians((trial_id % 3 - 1) * 2.5e0)), 6) AS dz FROM trials""")
def p28(spark, sf_dir):
    d = physics.gun_direction(F.col("trial_id") % 3, 3, 5.0, F.col("wall_time_s") / 100)
    return trial_table(spark, sf_dir).select("experiment", "trial_id", (F.round(d["dx"], 5) + 0).alias("dx"), F.round(d["dz"], 6).alias("dz"))


def map_trials(spark, sf_dir):
    return trial_table(spark, sf_dir).select(
        "experiment", "trial_id", "status", F.create_map(F.lit("w"), F.col("w_thickness").cast("double"), F.lit("n"), F.col("n_layers").cast("double")).alias("params"),
        F.when(F.col("status") == "COMPLETED", F.create_map(F.lit("nhits"), F.col("nhits_sipad"), F.lit("n"), F.col("cost_proxy"))).alias("metrics"),
    )


@plan("u3_wide_trials", TR + """SELECT experiment, trial_id, CAST(n_layers AS DOUBLE) AS n, CAST(w_thickness AS DOUBLE) AS w, CASE WHEN status = 'COMPLETED' THEN cost_proxy END AS n_metric, CASE WHEN status = 'COMPLETED' THEN nhits_sipad END AS nhits FROM trials""")
def u3(spark, sf_dir):
    return io.wide_trials(map_trials(spark, sf_dir), ["experiment", "trial_id"])


@plan("p30_parallel_table", TR + """SELECT experiment, trial_id, CAST(w_thickness AS DOUBLE) AS w, CAST(n_layers AS DOUBLE) AS n, nhits_sipad AS nhits FROM trials WHERE status = 'COMPLETED'""")
def p30(spark, sf_dir):
    x = map_trials(spark, sf_dir).where("status = 'COMPLETED'")
    return x.select("experiment", "trial_id", F.col("params")["w"].alias("w"), F.col("params")["n"].alias("n"), F.col("metrics")["nhits"].alias("nhits"))


@plan("u1_union_of_detectors", HIT_CTES + "SELECT detector, count(*) AS n FROM hits GROUP BY detector")
def u1(spark, sf_dir):
    h = cut(overlaid_hits(spark, sf_dir), "hits")
    out = h.where("detector = 'SiPad'")
    for d in ("SiTarget", "SciFi", "Scint"):
        out = out.unionByName(h.where(F.col("detector") == d))
    return out.groupBy("detector").agg(F.count("*").alias("n"))


@plan("u4_difference", HIT_CTES + "SELECT DISTINCT window_id, detector, cell_id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.window_id = h.window_id + 1 AND o.detector = h.detector AND o.cell_id = h.cell_id)")
def u4(spark, sf_dir):
    """Cells of each window that are silent in the one after it."""
    cells = overlaid_hits(spark, sf_dir).select("window_id", "detector", "cell_id").distinct()
    after = cells.withColumn("window_id", F.col("window_id") - 1)
    return cells.join(after, ["window_id", "detector", "cell_id"], "left_anti")


@plan("s4_parallel_mismatch", HIT_CTES + """, v AS (SELECT window_id, routed AS detector, count(*) AS n_values FROM overlay WHERE time < 13 GROUP BY 1, 2), h AS (SELECT window_id, detector, sum(n_contributions) AS n_hits FROM hits GROUP BY 1, 2)
SELECT h.window_id, h.detector, n_hits, coalesce(n_values, 0) AS n_values FROM h LEFT JOIN v ON v.window_id = h.window_id AND v.detector = h.detector WHERE n_hits <> coalesce(n_values, 0)""")
def s4(spark, sf_dir):
    """A list of species in which late contributions are missing, against the hits that own it."""
    values = bitfields.route(hits.overlay(contributions(spark, sf_dir))).where("time < 13")
    return io.parallel_mismatch(overlaid_hits(spark, sf_dir).withColumnRenamed("n_contributions", "n"), values, ["window_id", "detector"])


@plan("t4_by_beam", HIT_CTES + "SELECT window_id, detector, cell_id, row_number() OVER (PARTITION BY window_id, detector ORDER BY z, cell_id) AS place FROM hits")
def t4(spark, sf_dir):
    w = Window.partitionBy("window_id", "detector").orderBy("z", "cell_id")
    return overlaid_hits(spark, sf_dir).select("window_id", "detector", "cell_id", F.row_number().over(w).alias("place"))

"""Registered plans on measurements, seeds, track pieces and states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitloom.functions import bitfields
from hitloom.operators import linking, measurements, seeding
from hitloom.plans.hits import HIT_CTES, overlaid_hits
from hitloom.plans.registry import plan
from hitloom.sources.fixtures import ctes, parts_of, spark_view
from hitloom.sources.shared import cut


def decoded(spark, sf_dir, detector: str, hits=None):
    """One detector's hits with the fields of their cell ids and a number in the window; hits: those of all detectors, where they are at hand."""
    layout = bitfields.LAYOUTS[{"SciFi": "MTC", "Scint": "MTC"}.get(detector, detector)]
    names = [n for n, *_ in bitfields.parse(layout) if n not in ("x", "y")]
    x = (overlaid_hits(spark, sf_dir) if hits is None else hits).where(F.col("detector") == detector)
    x = x.withColumns({n: bitfields.get(layout, n, F.col("cell_id")) for n in names})
    return x.withColumn("hit_id", F.row_number().over(Window.partitionBy("window_id").orderBy("cell_id")).cast("long"))


NUMBERED = """SELECT *, row_number() OVER (PARTITION BY window_id, detector ORDER BY cell_id) AS hit_id FROM hits"""
BASE = HIT_CTES + f", numbered AS ({NUMBERED}) "


@plan("p7_sitarget", BASE + """SELECT window_id, cell_id, CAST(plane AS INT) AS quality, CAST(layer AS INT) AS layer,
round(CASE WHEN plane = 0 THEN x ELSE 400e0 / 2 - 199.5e0 / 2 END, 6) AS x, round(CASE WHEN plane = 0 THEN 400e0 / 2 - 199.5e0 / 2 ELSE y END, 6) AS y, round(z, 4) AS z,
round(CASE WHEN plane = 0 THEN 0.0755e0 * 0.0755e0 / 12 ELSE 199.5e0 * 199.5e0 / 12 END, 9) AS var0 FROM numbered WHERE detector = 'SiTarget' AND layer * 2 + plane < 8""")
def p7(spark, sf_dir):
    x = measurements.sitarget(decoded(spark, sf_dir, "SiTarget"), n_surfaces=8)
    return x.select("window_id", "cell_id", "quality", "layer", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 4).alias("z"), F.round("var0", 9).alias("var0"))


@plan("p8_sipad", BASE + "SELECT window_id, cell_id, CAST(layer AS INT) AS quality, x, y, round(5.5e0 * 5.5e0 / 12, 9) AS var0 FROM numbered WHERE detector = 'SiPad' AND layer + 40 < 44")
def p8(spark, sf_dir):
    return measurements.sipad(decoded(spark, sf_dir, "SiPad"), n_surfaces=44).select("window_id", "cell_id", "quality", "x", "y", F.round("var0", 9).alias("var0"))


FIBRE = "fib AS (SELECT * FROM numbered WHERE detector = 'SciFi')"
PAIRS = """pairs AS (SELECT u.window_id, u.station, u.layer, u.cell_id, u.hit_id AS uid, v.hit_id AS vid, u.x AS ux, v.x AS vx, u.z AS uz, v.z AS vz, u.e + v.e AS e
FROM fib u JOIN fib v ON u.window_id = v.window_id AND u.station = v.station AND u.layer = v.layer AND u.plane = 0 AND v.plane = 1 AND abs(u.z - v.z) <= 25)"""


@plan("p10_mtc_pairs", BASE + f", {FIBRE}, {PAIRS}" + """ SELECT window_id, station, layer, cell_id, round((ux + vx) / 2, 4) + 0 AS x, round((vx - ux) * cos(radians(5e0)) / (2 * sin(radians(5e0))), 4) + 0 AS y, round(e * 1e9, 3) AS e_ev FROM pairs""")
def p10(spark, sf_dir):
    x = measurements.mtc(decoded(spark, sf_dir, "SciFi")).where("is2d")
    return x.select("window_id", "station", "layer", "cell_id", (F.round("x", 4) + 0).alias("x"), (F.round("y", 4) + 0).alias("y"), F.round(F.col("edep") * 1e9, 3).alias("e_ev"))


@plan("j6_unpaired", BASE + ", fib AS (SELECT * FROM numbered WHERE detector = 'SciFi' AND e > 9e-5), " + PAIRS + """ SELECT window_id, cell_id, round(x * cos(radians(5e0)), 6) AS x FROM fib f
WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.window_id = f.window_id AND (p.uid = f.hit_id OR p.vid = f.hit_id))""")
def j6(spark, sf_dir):
    """Hits above a threshold, with which some planes of a layer are empty."""
    x = measurements.mtc(decoded(spark, sf_dir, "SciFi").where("e > 9e-5"))
    return x.where("NOT is2d").select("window_id", "cell_id", F.round("x", 6).alias("x"))


@plan("p9_mtc_single", BASE + f", {FIBRE} SELECT window_id, plane AS quality, count(*) AS n, round(sum(x * cos(radians(5e0))), 4) AS sx FROM fib GROUP BY window_id, plane")
def p9(spark, sf_dir):
    x = measurements.mtc(decoded(spark, sf_dir, "SciFi"), method="None")
    return x.groupBy("window_id", "quality").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"))


def pad_surfaces(spark):
    return spark.range(4).select(F.col("id").cast("int").alias("layer"), (F.col("id") + 40).cast("int").alias("surface_id"))


@plan("j4_at_surface", BASE + "SELECT window_id, cell_id, CAST(40 + layer AS INT) AS surface_id FROM numbered WHERE detector = 'SiPad' AND layer < 4")
def j4(spark, sf_dir):
    x = measurements.sipad(decoded(spark, sf_dir, "SiPad"))
    return measurements.at_surface(x, pad_surfaces(spark), ["layer"]).select("window_id", "cell_id", "surface_id")


@plan("j4_without_surface", BASE + "SELECT layer, count(*) AS n FROM numbered WHERE detector = 'SiPad' AND layer >= 4 GROUP BY layer")
def j4b(spark, sf_dir):
    x = measurements.sipad(decoded(spark, sf_dir, "SiPad"))
    return measurements.without_surface(x, pad_surfaces(spark), ["layer"]).groupBy("layer").agg(F.count("*").alias("n"))


@plan("p11_pool", BASE + f", {FIBRE}, {PAIRS}" + """, pool AS (SELECT window_id, 0 AS det, cell_id FROM numbered WHERE detector = 'SiTarget' UNION ALL SELECT window_id, 1, cell_id FROM numbered WHERE detector = 'SiPad'
UNION ALL SELECT window_id, 2, cell_id FROM pairs UNION ALL SELECT window_id, 2, cell_id FROM fib f WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.window_id = f.window_id AND (p.uid = f.hit_id OR p.vid = f.hit_id)))
SELECT window_id, det, cell_id FROM pool""")
def p11(spark, sf_dir):
    h = cut(overlaid_hits(spark, sf_dir), "hits")  # read by each detector and by both sides of the fibres' pairs
    one = measurements.sitarget(decoded(spark, sf_dir, "SiTarget", h)).select("window_id", "det", "cell_id")
    two = measurements.sipad(decoded(spark, sf_dir, "SiPad", h)).select("window_id", "det", "cell_id")
    three = measurements.mtc(decoded(spark, sf_dir, "SciFi", h)).select("window_id", F.lit(2).alias("det"), "cell_id")
    return one.unionByName(two).unionByName(three)


@plan("p14_loc_to_global", ctes("track_states") + "SELECT window_id, track_id, seq, round(loc0 * cos(tilt) + y * sin(tilt), 6) AS gx, round(-loc0 * sin(tilt) + y * cos(tilt), 6) AS gy FROM track_states")
def p14(spark, sf_dir):
    gx, gy = measurements.loc_to_global(F.col("loc0"), F.col("y"), F.col("tilt"))
    return spark_view(spark, sf_dir, "track_states").select("window_id", "track_id", "seq", F.round(gx, 6).alias("gx"), F.round(gy, 6).alias("gy"))


@plan("p12_stereo_strip", ctes("contributions") + "SELECT event_idx, seq, CAST(floor((hit_x - hit_y * tan(radians(5e0)) - 0.25e0) / 1e0 + 0.5e0) AS BIGINT) AS strip FROM contributions WHERE detector = 'MTC'")
def p12(spark, sf_dir):
    x = spark_view(spark, sf_dir, "contributions").where("detector = 'MTC'")
    return x.select("event_idx", "seq", measurements.stereo_strip(F.col("hit_x"), F.col("hit_y"), 5.0, 1.0, 0.25).alias("strip"))


@plan("p13_wafer", ctes("contributions") + "SELECT event_idx, seq, CAST(floor(pad / 16e0) * 4 + floor(strip / 16e0) AS BIGINT) AS wafer FROM contributions WHERE detector = 'SiPad'")
def p13(spark, sf_dir):
    return spark_view(spark, sf_dir, "contributions").where("detector = 'SiPad'").select("event_idx", "seq", measurements.wafer(F.col("strip"), F.col("pad")).alias("wafer"))


@plan("j5_nearest_plane", ctes("track_states") + """SELECT window_id, track_id, seq, (SELECT p FROM (VALUES (0, 0e0), (1, 40e0), (2, 80e0), (3, 120e0)) v(i, p) ORDER BY abs(z - p), i LIMIT 1) AS plane_z FROM track_states""")
def j5(spark, sf_dir):
    return spark_view(spark, sf_dir, "track_states").select("window_id", "track_id", "seq", measurements.nearest_plane(F.col("z"), [0.0, 40.0, 80.0, 120.0]).alias("plane_z"))


@plan("j11_purge_1d", BASE + """, st AS (SELECT * FROM numbered WHERE detector = 'SiTarget'), n AS (SELECT a.window_id, a.layer, a.plane, a.cell_id, (SELECT count(*) FROM st b WHERE b.window_id = a.window_id AND b.layer = a.layer AND b.plane = a.plane AND abs(b.strip - a.strip) < 2) - 1 AS n FROM st a)
SELECT window_id, cell_id, n FROM n WHERE n <= 1""")
def j11(spark, sf_dir):
    x = decoded(spark, sf_dir, "SiTarget").withColumn("s", F.col("strip").cast("long"))
    return measurements.neighbours_1d(x, ["window_id", "layer", "plane"], "s", 2).where("n <= 1").select("window_id", "cell_id", "n")


@plan("j12_isolation_2d", BASE + """, sp AS (SELECT * FROM numbered WHERE detector = 'SiPad'), n AS (SELECT a.window_id, a.cell_id, (SELECT count(*) FROM sp b WHERE b.window_id = a.window_id AND b.layer = a.layer AND b.cell_id <> a.cell_id
AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) < 64) AS n FROM sp a) SELECT window_id, cell_id FROM n WHERE n <= 2""")
def j12(spark, sf_dir):
    x = measurements.neighbours_2d(decoded(spark, sf_dir, "SiPad"), ["window_id", "layer"], "cell_id", 8.0)
    return measurements.purge(x, 2).select("window_id", "cell_id")


CROSS = """stx AS (SELECT *, CAST(round(z / 10) AS BIGINT) AS station_no FROM numbered WHERE detector = 'SiTarget'),
fine AS (SELECT window_id, station_no FROM stx GROUP BY window_id, station_no HAVING count(*) FILTER (WHERE plane = 0) * count(*) FILTER (WHERE plane = 1) <= 500),
crossed AS (SELECT a.window_id, a.station_no, a.hit_id AS x_id, b.hit_id AS y_id, a.x, b.y, (a.z + b.z) / 2 AS z FROM stx a JOIN stx b ON a.window_id = b.window_id AND a.station_no = b.station_no AND a.plane = 0 AND b.plane = 1
JOIN fine f ON f.window_id = a.window_id AND f.station_no = a.station_no)"""


def silicon(spark, sf_dir):
    """Hits of strips and pads, a table: both are made from it."""
    return cut(overlaid_hits(spark, sf_dir).where("detector IN ('SiTarget', 'SiPad')").select("window_id", "detector", "cell_id", "x", "y", "z"), "hits")


#: the same without a cap
ALL_CROSSED = """stx AS (SELECT *, CAST(round(z / 10) AS BIGINT) AS station_no FROM numbered WHERE detector = 'SiTarget'),
crossed AS (SELECT a.window_id, a.station_no, a.hit_id AS x_id, b.hit_id AS y_id, a.x, b.y, (a.z + b.z) / 2 AS z FROM stx a JOIN stx b ON a.window_id = b.window_id AND a.station_no = b.station_no AND a.plane = 0 AND b.plane = 1)"""


def planes(spark, sf_dir, hits=None):
    """Strips of both planes, a table: each plane is counted and joined."""
    x = decoded(spark, sf_dir, "SiTarget", hits).withColumn("station_no", seeding.station(F.col("z")))
    x = cut(x.select("window_id", "station_no", "hit_id", "plane", "x", "y", "z"), "strips")
    return x.where("plane = 0"), x.where("plane = 1")


def crossed(spark, sf_dir, hits=None):
    return seeding.crossings(*planes(spark, sf_dir, hits), ["window_id", "station_no"])


@plan("j7_crossings", BASE + f", {CROSS} SELECT window_id, station_no, count(*) AS n, round(sum(x), 3) AS sx, round(sum(y), 3) AS sy FROM crossed GROUP BY window_id, station_no")
def j7(spark, sf_dir):
    return crossed(spark, sf_dir).groupBy("window_id", "station_no").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"))


@plan("j8_stereo_crossings", BASE + """, f AS (SELECT *, x * cos(radians(5e0)) AS loc0, CAST(round(z / 5) AS BIGINT) AS zbin FROM numbered WHERE detector = 'SciFi'), ok AS (SELECT window_id, station, layer FROM f GROUP BY window_id, station, layer HAVING count(*) FILTER (WHERE plane = 0) * count(*) FILTER (WHERE plane = 1) BETWEEN 1 AND 200)
SELECT u.window_id, u.station, u.layer, count(*) AS n, round(sum((u.loc0 + v.loc0) / 2), 3) AS sx, round(sum((v.loc0 - u.loc0) / (2 * sin(radians(5e0)))), 3) AS sy FROM f u JOIN f v ON u.window_id = v.window_id AND u.station = v.station AND u.layer = v.layer AND u.plane = 0 AND v.plane = 1
JOIN ok ON ok.window_id = u.window_id AND ok.station = u.station AND ok.layer = u.layer GROUP BY u.window_id, u.station, u.layer""")
def j8(spark, sf_dir):
    import math

    x = decoded(spark, sf_dir, "SciFi").withColumn("loc0", F.col("x") * math.cos(math.radians(5.0)))
    keys = ["window_id", "station", "layer"]
    y = seeding.stereo_crossings(x.where("plane = 0"), x.where("plane = 1"), keys)
    return y.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"))


@plan("j8_mtc_points", BASE + ", fib AS (SELECT * FROM numbered WHERE detector = 'SciFi' AND e > 8e-5), " + PAIRS + """, k AS (SELECT cos(radians(5e0)) AS c, sin(radians(5e0)) AS s),
one AS (SELECT window_id, plane, c * x AS u, z, CAST(round(z / 5) AS BIGINT) AS zb, s FROM fib f, k WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.window_id = f.window_id AND (p.uid = f.hit_id OR p.vid = f.hit_id))),
few AS (SELECT window_id, zb FROM one GROUP BY 1, 2 HAVING count(*) FILTER (WHERE plane = 0) * count(*) FILTER (WHERE plane = 1) BETWEEN 1 AND 200),
pt AS (SELECT window_id, (ux + vx) / 2 AS x, (vx - ux) * c / (2 * s) AS y, (uz + vz) / 2 AS z FROM pairs, k UNION ALL
SELECT a.window_id, (a.u + b.u) / 2, (b.u - a.u) / (2 * a.s), (a.z + b.z) / 2 FROM one a JOIN one b ON a.window_id = b.window_id AND a.zb = b.zb AND a.plane = 0 AND b.plane = 1 JOIN few ON few.window_id = a.window_id AND few.zb = a.zb)
SELECT window_id, round(z, 4) AS z, 2 AS weight, count(*) AS n, round(sum(x), 4) AS sx, round(sum(y), 4) AS sy FROM pt GROUP BY window_id, round(z, 4)""")
def j8_points(spark, sf_dir):
    """Points at each z of the measurements of hits above a threshold, resolved and crossed ones."""
    x = seeding.mtc_points(measurements.mtc(decoded(spark, sf_dir, "SciFi").where("e > 8e-5")), ["window_id"])
    return x.groupBy("window_id", F.round("z", 4).alias("z"), "weight").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy"))


PADS = "pads AS (SELECT window_id, x - 137.5e0 AS x, y - 27.5e0 AS y FROM numbered WHERE detector = 'SiPad'), pts AS (SELECT c.*, EXISTS (SELECT 1 FROM pads p WHERE p.window_id = c.window_id AND (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) <= 4) AS confirmed FROM crossed c)"


def pads_of(hits):
    return hits.where("detector = 'SiPad'").select("window_id", (F.col("x") - 137.5).alias("x"), (F.col("y") - 27.5).alias("y"))


def confirmed(spark, sf_dir):
    h = silicon(spark, sf_dir)
    return seeding.confirm(crossed(spark, sf_dir, h), pads_of(h), ["window_id"], ["x_id", "y_id"], 2.0)


@plan("j9_confirm", BASE + f", {CROSS}, {PADS} SELECT window_id, station_no, x_id, y_id, confirmed FROM pts")
def j9(spark, sf_dir):
    return confirmed(spark, sf_dir).select("window_id", "station_no", "x_id", "y_id", "confirmed")


GHOST = """clean AS (SELECT p.* FROM pts p LEFT JOIN (SELECT DISTINCT window_id, station_no, x_id, 1 AS fx FROM pts WHERE confirmed) a USING (window_id, station_no, x_id)
LEFT JOIN (SELECT DISTINCT window_id, station_no, y_id, 1 AS fy FROM pts WHERE confirmed) b USING (window_id, station_no, y_id) WHERE confirmed OR fx IS NULL OR fy IS NULL)"""


def cleaned(spark, sf_dir):
    """Crossings of all stations that are no ghosts."""
    h = silicon(spark, sf_dir)
    return seeding.clear_crossings(*planes(spark, sf_dir, h), pads_of(h), ["window_id", "station_no"], ["window_id"], 2.0)


def cleaned_under_cap(spark, sf_dir):
    """The same of stations under the cap of crossings()."""
    return seeding.drop_ghosts(confirmed(spark, sf_dir), ["window_id", "station_no"])


@plan("j10_drop_ghosts", BASE + f", {ALL_CROSSED}, {PADS}, {GHOST} SELECT window_id, station_no, x_id, y_id FROM clean")
def j10(spark, sf_dir):
    return cleaned(spark, sf_dir).select("window_id", "station_no", "x_id", "y_id")


VOTES = """bins AS (SELECT window_id, greatest(0, least(80, CAST(trunc((x + 200) / 5e0) AS INT))) AS ix, greatest(0, least(80, CAST(trunc((y + 200) / 5e0) AS INT))) AS iy, 2 * count(*) AS votes FROM clean GROUP BY 1, 2, 3)"""
PEAKS = """peaks AS (SELECT * FROM bins b WHERE votes >= 3 AND NOT EXISTS (SELECT 1 FROM bins o WHERE o.window_id = b.window_id AND abs(o.ix - b.ix) <= 1 AND abs(o.iy - b.iy) <= 1 AND o.votes > b.votes))"""
MET = """met AS (SELECT p.*, c.x, c.y, c.z FROM peaks p JOIN clean c ON c.window_id = p.window_id AND (c.x - (-200 + (p.ix + 0.5e0) * 5)) * (c.x - (-200 + (p.ix + 0.5e0) * 5)) + (c.y - (-200 + (p.iy + 0.5e0) * 5)) * (c.y - (-200 + (p.iy + 0.5e0) * 5)) < 100)"""
SEEDING = BASE + f", {ALL_CROSSED}, {PADS}, {GHOST}, {VOTES}, {PEAKS}, {MET} "
SEEDING_CAPPED = BASE + f", {CROSS}, {PADS}, {GHOST}, {VOTES}, {PEAKS}, {MET} "


@plan("a11_votes", SEEDING + "SELECT window_id, ix, iy, votes FROM bins")
def a11(spark, sf_dir):
    return seeding.votes(cleaned(spark, sf_dir), ["window_id"])


@plan("w7_peaks", SEEDING + "SELECT window_id, ix, iy, votes FROM peaks")
def w7(spark, sf_dir):
    return seeding.peaks(seeding.votes(cleaned(spark, sf_dir), ["window_id"]), ["window_id"])


def met_points(spark, sf_dir):
    points = cut(cleaned(spark, sf_dir), "points")  # vote, and lie near peaks
    return seeding.near_peaks(seeding.peaks(seeding.votes(points, ["window_id"]), ["window_id"]), points, ["window_id"])


@plan("j13_near_peaks", SEEDING + "SELECT window_id, ix, iy, count(*) AS n FROM met GROUP BY window_id, ix, iy")
def j13(spark, sf_dir):
    return met_points(spark, sf_dir).groupBy("window_id", "ix", "iy").agg(F.count("*").alias("n"))


@plan("a12_multiplicity", SEEDING + "SELECT window_id, ix, iy, votes, round(2e0 * count(*) / count(DISTINCT round(z / 10)), 6) AS multiplicity, round(min(z), 4) AS z_start FROM met GROUP BY window_id, ix, iy, votes")
def a12(spark, sf_dir):
    return seeding.multiplicity(met_points(spark, sf_dir), ["window_id"]).select("window_id", "ix", "iy", "votes", F.round("multiplicity", 6).alias("multiplicity"), F.round("z_start", 4).alias("z_start"))


@plan("a13_weighted_mode", SEEDING + """, s AS (SELECT window_id, ix, iy, CAST(round(x / 0.8e0) AS BIGINT) AS s, 2 * count(*) AS w FROM met GROUP BY 1, 2, 3, 4)
SELECT window_id, ix, iy, round(arg_max(s, {'w': w, 's': -s}) * 0.8e0, 6) AS x FROM s GROUP BY window_id, ix, iy""")
def a13(spark, sf_dir):
    return seeding.weighted_mode(met_points(spark, sf_dir), ["window_id"], "x", 0.8).select("window_id", "ix", "iy", F.round("x", 6).alias("x"))


JUDGED = """judged AS (SELECT window_id, ix, iy, votes, 2e0 * count(*) / count(DISTINCT round(z / 10)) AS multiplicity, min(z) AS z_start FROM met GROUP BY window_id, ix, iy, votes),
rk AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY votes DESC, ix, iy) AS r FROM judged),
nms AS (SELECT window_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS INT) AS ix, CAST(NULL AS INT) AS iy, FALSE AS taken, CAST([] AS INT[]) AS cells FROM rk WHERE r = 1 UNION ALL
  SELECT n.window_id, n.r, n.ix, n.iy, len(list_filter(cells, lambda c: abs(c // 1000 - n.ix) <= 3 AND abs(c % 1000 - n.iy) <= 3)) = 0,
    CASE WHEN len(list_filter(cells, lambda c: abs(c // 1000 - n.ix) <= 3 AND abs(c % 1000 - n.iy) <= 3)) = 0 THEN list_append(cells, n.ix * 1000 + n.iy) ELSE cells END
  FROM nms w JOIN rk n ON n.window_id = w.window_id AND n.r = w.r + 1)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@plan("w8_suppressed", recursive(SEEDING.rstrip() + f", {JUDGED} SELECT window_id, ix, iy FROM nms WHERE taken"))
def w8(spark, sf_dir):
    judged = seeding.multiplicity(met_points(spark, sf_dir), ["window_id"])
    return seeding.suppress(cut(judged, "peaks"), ["window_id"], 3)


def _mode(axis: str) -> str:
    return f"""(SELECT window_id, ix, iy, arg_max(s, {{'w': w, 's': -s}}) * 0.8e0 AS {axis} FROM (SELECT window_id, ix, iy, CAST(round({axis} / 0.8e0) AS BIGINT) AS s, 2 * count(*) AS w FROM met GROUP BY 1, 2, 3, 4) q GROUP BY window_id, ix, iy)"""


@plan("t2_seeds", recursive(SEEDING_CAPPED.rstrip() + f""", {JUDGED}, best AS (SELECT j.*, row_number() OVER (PARTITION BY window_id ORDER BY votes DESC, ix, iy) AS seat FROM judged j JOIN nms k USING (window_id, ix, iy) WHERE k.taken AND multiplicity <= 60)
SELECT window_id, round(x, 6) AS x, round(y, 6) AS y, round(z_start, 4) AS z_start, votes AS n_votes, round(multiplicity, 6) AS multiplicity FROM best JOIN {_mode('x')} USING (window_id, ix, iy) JOIN {_mode('y')} USING (window_id, ix, iy) WHERE seat <= 5"""))
def t2(spark, sf_dir):
    x = seeding.seeds(cleaned_under_cap(spark, sf_dir), ["window_id"], max_multiplicity=60.0, pitch=0.8)
    return x.select("window_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z_start", 4).alias("z_start"), "n_votes", F.round("multiplicity", 6).alias("multiplicity"))


# --- track pieces ------------------------------------------------------------------


def segments(spark, sf_dir):
    x = spark_view(spark, sf_dir, "segments")
    n = F.sqrt(1 + F.col("ty") ** 2 + F.col("tz") ** 2)
    return x.select("*", (1 / n).alias("dx"), (F.col("ty") / n).alias("dy"), (F.col("tz") / n).alias("dz"))


def segment_hits(spark, sf_dir):
    return spark_view(spark, sf_dir, "segment_hits")


SEG = ctes("segments", "segment_hits")


@plan("p19_accept", SEG + """SELECT s.window_id, s.segment_id FROM segments s JOIN (SELECT window_id, segment_id, count(*) AS n FROM segment_hits GROUP BY 1, 2) h USING (window_id, segment_id)
WHERE n >= CASE det WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 4 END AND chi2 / greatest(1, ndf) <= 2""")
def p19(spark, sf_dir):
    n = segment_hits(spark, sf_dir).groupBy("window_id", "segment_id").agg(F.count("*").alias("n_meas"))
    return linking.accept(segments(spark, sf_dir).join(n, ["window_id", "segment_id"]), {0: 3, 1: 2, 2: 4}, 2.0).select("window_id", "segment_id")


@plan("j14_shared_hits", SEG + "SELECT a.window_id, a.segment_id AS s1, b.segment_id AS s2, count(*) AS shared FROM segment_hits a JOIN segment_hits b ON a.window_id = b.window_id AND a.hit_id = b.hit_id AND a.segment_id < b.segment_id GROUP BY 1, 2, 3")
def j14(spark, sf_dir):
    return linking.shared_hits(segment_hits(spark, sf_dir))


@plan("w10_without_duplicates", recursive(SEG + """, sz AS (SELECT window_id, segment_id, count(*) AS n FROM segment_hits GROUP BY 1, 2),
pr AS (SELECT a.window_id, a.segment_id AS s1, b.segment_id AS s2, count(*) AS shared FROM segment_hits a JOIN segment_hits b ON a.window_id = b.window_id AND a.hit_id = b.hit_id AND a.segment_id <> b.segment_id GROUP BY 1, 2, 3),
rv AS (SELECT pr.window_id, s1 AS segment_id, list(s2) AS rivals FROM pr JOIN sz a ON a.window_id = pr.window_id AND a.segment_id = s1 JOIN sz b ON b.window_id = pr.window_id AND b.segment_id = s2 WHERE shared > 0.7e0 * least(a.n, b.n) GROUP BY 1, 2),
rk AS (SELECT s.window_id, s.segment_id, coalesce(rivals, CAST([] AS BIGINT[])) AS rivals, row_number() OVER (PARTITION BY s.window_id ORDER BY chi2 / greatest(1, ndf), s.segment_id) AS r FROM segments s LEFT JOIN rv ON rv.window_id = s.window_id AND rv.segment_id = s.segment_id),
wk AS (SELECT window_id, r, segment_id, TRUE AS taken, [segment_id] AS kept FROM rk WHERE r = 1 UNION ALL SELECT n.window_id, n.r, n.segment_id, NOT list_has_any(n.rivals, kept), CASE WHEN list_has_any(n.rivals, kept) THEN kept ELSE list_append(kept, n.segment_id) END FROM wk w JOIN rk n ON n.window_id = w.window_id AND n.r = w.r + 1)
SELECT window_id, segment_id FROM wk WHERE taken"""))
def w10(spark, sf_dir):
    return linking.without_duplicates(segments(spark, sf_dir), segment_hits(spark, sf_dir)).select("window_id", "segment_id")


def segment_ends(spark, sf_dir):
    return spark_view(spark, sf_dir, "segment_ends")


def spliced(spark, sf_dir):
    return linking.splice_candidates(segment_ends(spark, sf_dir), linking.boundaries(spark_view(spark, sf_dir, "surfaces")))


ENDS = ctes("segments", "segment_hits", "surfaces", "segment_ends")
# the plane between two detectors, both ends taken there along their lines, then distance and angle
CANDIDATES = """planes AS (SELECT u.det, (u.x + d.x) / 2 AS plane FROM (SELECT det, max(x) AS x FROM surfaces GROUP BY det) u JOIN (SELECT det, min(x) AS x FROM surfaces GROUP BY det) d ON d.det = u.det + 1),
cand AS (SELECT u.window_id, u.det, u.segment_id AS up, d.segment_id AS down, u.b_y + u.b_dy * ((plane - u.b_x) / u.b_dx) - (d.f_y + d.f_dy * ((plane - d.f_x) / d.f_dx)) AS off_y,
  u.b_z + u.b_dz * ((plane - u.b_x) / u.b_dx) - (d.f_z + d.f_dz * ((plane - d.f_x) / d.f_dx)) AS off_z, acos(greatest(-1e0, least(1e0, u.b_dx * d.f_dx + u.b_dy * d.f_dy + u.b_dz * d.f_dz))) AS angle
  FROM segment_ends u JOIN segment_ends d ON u.window_id = d.window_id AND d.det = u.det + 1 JOIN planes ON planes.det = u.det WHERE abs(u.b_dx) >= 1e-6 AND abs(d.f_dx) >= 1e-6),
ok AS (SELECT window_id, det, up, down, sqrt(off_y * off_y + off_z * off_z) AS dist, angle, off_y * off_y + off_z * off_z + 100 * angle * angle AS score FROM cand WHERE sqrt(off_y * off_y + off_z * off_z) <= 15 AND angle <= 0.1)"""


@plan("j15_link_candidates", ENDS + f", {CANDIDATES} SELECT window_id, det, up, down, round(dist, 6) AS dist, round(angle, 7) AS angle, round(score, 5) AS score FROM ok")
def j15(spark, sf_dir):
    return spliced(spark, sf_dir).select("window_id", "det", "up", "down", F.round("dist", 6).alias("dist"), F.round("angle", 7).alias("angle"), F.round("score", 5).alias("score"))


@plan("j16_stitch_candidates", ctes("segment_ends") + """, cand AS (SELECT u.window_id, u.det, u.segment_id AS up, d.segment_id AS down, u.b_y + u.b_dy * ((d.f_x - u.b_x) / u.b_dx) - d.f_y AS off_y, u.b_z + u.b_dz * ((d.f_x - u.b_x) / u.b_dx) - d.f_z AS off_z,
  acos(greatest(-1e0, least(1e0, (u.b_dx * d.f_dx + u.b_dy * d.f_dy + u.b_dz * d.f_dz) / (sqrt(u.b_dx * u.b_dx + u.b_dy * u.b_dy + u.b_dz * u.b_dz) * sqrt(d.f_dx * d.f_dx + d.f_dy * d.f_dy + d.f_dz * d.f_dz))))) AS angle
  FROM segment_ends u JOIN segment_ends d ON u.window_id = d.window_id AND d.det = u.det + 1 WHERE abs(u.b_dx) >= 1e-6)
SELECT window_id, det, up, down, round(off_y * off_y + off_z * off_z + 100 * angle * angle, 4) AS score FROM cand WHERE off_y * off_y + off_z * off_z <= 225 AND angle <= 0.1""")
def j16(spark, sf_dir):
    return linking.stitch_candidates(segment_ends(spark, sf_dir)).select("window_id", "det", "up", "down", F.round("score", 4).alias("score"))


LINKS = ENDS + f""", {CANDIDATES}, rk AS (SELECT window_id, det, up, down, score, row_number() OVER (PARTITION BY window_id ORDER BY round(score, 9), up, down) AS r FROM ok),
wk AS (SELECT window_id, r, det, up, down, score, TRUE AS taken, [up] AS ups, [down] AS downs FROM rk WHERE r = 1 UNION ALL SELECT n.window_id, n.r, n.det, n.up, n.down, n.score, NOT (list_contains(ups, n.up) OR list_contains(downs, n.down)),
  CASE WHEN list_contains(ups, n.up) OR list_contains(downs, n.down) THEN ups ELSE list_append(ups, n.up) END, CASE WHEN list_contains(ups, n.up) OR list_contains(downs, n.down) THEN downs ELSE list_append(downs, n.down) END
  FROM wk w JOIN rk n ON n.window_id = w.window_id AND n.r = w.r + 1), lk AS (SELECT window_id, det, up, down, score FROM wk WHERE taken)"""
CHAINS = """a AS (SELECT window_id, up AS f, down AS s FROM lk WHERE det = 0), b AS (SELECT window_id, up AS s, down AS t FROM lk WHERE det = 1),
ch AS (SELECT window_id, f AS first, s AS second, t AS third FROM a LEFT JOIN b USING (window_id, s) UNION ALL SELECT window_id, s, t, NULL FROM b ANTI JOIN a USING (window_id, s))"""


def links(spark, sf_dir):
    return linking.link(spliced(spark, sf_dir))


@plan("w11_links", recursive(LINKS + " SELECT window_id, det, up, down FROM lk"))
def w11(spark, sf_dir):
    return links(spark, sf_dir)


@plan("w11_chains", recursive(LINKS + f", {CHAINS} SELECT window_id, first, second, third FROM ch"))
def w11b(spark, sf_dir):
    return linking.chains(links(spark, sf_dir))


@plan("w11_accepted_chains", recursive(LINKS + f""", {CHAINS}, c2 AS (SELECT ch.*, third IS NOT NULL AND (ch.first + third) % 2 = 1 AS bad, x.score AS s1, y.score AS s2 FROM ch LEFT JOIN lk x ON x.window_id = ch.window_id AND x.up = first AND x.down = second LEFT JOIN lk y ON y.window_id = ch.window_id AND y.up = second AND y.down = third)
SELECT window_id, CASE WHEN bad AND s2 < s1 THEN second ELSE first END AS first, CASE WHEN bad AND s2 < s1 THEN third ELSE second END AS second, CASE WHEN NOT bad THEN third END AS third FROM c2"""))
def w11c(spark, sf_dir):
    found = links(spark, sf_dir)
    scored = found.join(spliced(spark, sf_dir).select("window_id", "up", "down", "score"), ["window_id", "up", "down"])
    return linking.accepted_chains(linking.chains(found), scored, (F.col("first") + F.col("third")) % 2 == 0)


@plan("j24_local_tracks", recursive(LINKS + " SELECT s.window_id, s.segment_id FROM segments s WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.window_id = s.window_id AND lk.up = s.segment_id) AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.window_id = s.window_id AND lk.down = s.segment_id)"))
def j24(spark, sf_dir):
    return linking.local_tracks(segments(spark, sf_dir), links(spark, sf_dir)).select("window_id", "segment_id")


@plan("j25_remaining", SEG + """SELECT h.window_id, h.segment_id, h.hit_id FROM segment_hits h WHERE NOT EXISTS (SELECT 1 FROM segment_hits t JOIN segments s USING (window_id, segment_id) WHERE s.chi2 / greatest(1, s.ndf) <= 0.4 AND t.window_id = h.window_id AND t.hit_id = h.hit_id)""")
def j25(spark, sf_dir):
    taken = linking.accept(segments(spark, sf_dir).withColumn("n_meas", F.lit(9)), {0: 0, 1: 0, 2: 0}, 0.4)
    pool = segment_hits(spark, sf_dir)
    return linking.remaining(pool, pool.join(taken, ["window_id", "segment_id"], "left_semi"))


@plan("p20_type_mask", SEG + "SELECT window_id, bit_or(1 << det) AS mask FROM segments GROUP BY window_id")
def p20(spark, sf_dir):
    return linking.type_mask(segments(spark, sf_dir), ["window_id"])


# --- states --------------------------------------------------------------------------


def states(spark, sf_dir):
    return spark_view(spark, sf_dir, "track_states")


def tracks(spark, sf_dir):
    """States dealt by track, for as many tasks as the input needs."""
    n = parts_of(spark, sf_dir, "lineitem")
    return states(spark, sf_dir).repartition(n, "window_id", "track_id") if n else states(spark, sf_dir)


PAIRED = ctes("track_states") + """, rk AS (SELECT *, row_number() OVER w AS r, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, lead(chi2) OVER w AS chi22, lead(loc0) OVER w AS loc2, lead(tilt) OVER w AS tilt2, lead(loc0 / 50) OVER w AS phi2,
  coalesce({fits}, FALSE) AS fits FROM track_states WINDOW w AS (PARTITION BY window_id, track_id ORDER BY z, seq)),
wk AS (SELECT *, fits AS opens, FALSE AS closes FROM rk WHERE r = 1 UNION ALL SELECT n.*, n.fits AND NOT w.opens, w.opens FROM wk w JOIN rk n ON n.window_id = w.window_id AND n.track_id = w.track_id AND n.r = w.r + 1)"""
AVERAGED = PAIRED.format(fits="tilt * lead(tilt) OVER w < 0 AND abs(tilt) > 0.01 AND abs(lead(tilt) OVER w) > 0.01 AND lead(z) OVER w - z < 5")
CROSSED = PAIRED.format(fits="abs(tilt) > 0.01 AND abs(lead(z) OVER w - z) < 5 AND tilt * lead(tilt) OVER w < 0")


@plan("w4_pair_states", recursive(AVERAGED + """ SELECT window_id, track_id, seq, opens AS paired, round(CASE WHEN opens THEN (x + x2) / 2 ELSE x END, 6) AS x, round(CASE WHEN opens THEN (y + y2) / 2 ELSE y END, 6) AS y,
round(CASE WHEN opens THEN (z + z2) / 2 ELSE z END, 6) AS z, round(CASE WHEN opens THEN 0 ELSE tilt END, 7) AS tilt, round(CASE WHEN opens THEN chi2 + chi22 ELSE chi2 END, 6) AS chi2,
round(CASE WHEN opens THEN (loc0 / 50 + phi2) / 2 ELSE loc0 / 50 END, 6) AS phi, round(CASE WHEN opens THEN (x / z + x2 / z2) / 2 ELSE x / z END, 6) + 0 AS tan_lambda, CASE WHEN opens THEN 0 ELSE loc0 END AS loc0 FROM wk WHERE NOT closes"""))
def w4(spark, sf_dir):
    x = tracks(spark, sf_dir).withColumns({"phi": F.col("loc0") / 50, "tan_lambda": F.col("x") / F.col("z")})
    x = linking.pair_states(x, ["window_id", "track_id"])
    return x.select("window_id", "track_id", "seq", "paired", *[(F.round(c, 6) + 0).alias(c) for c in ("x", "y", "z", "chi2", "phi", "tan_lambda")], F.round("tilt", 7).alias("tilt"), "loc0")


@plan("w5_stereo_states", recursive(CROSSED + """, uv AS (SELECT *, CASE WHEN tilt > 0 THEN loc0 ELSE loc2 END AS u, CASE WHEN tilt > 0 THEN loc2 ELSE loc0 END AS v FROM wk WHERE NOT closes)
SELECT window_id, track_id, seq, opens AS paired, round(CASE WHEN opens THEN (u + v) / 2 ELSE x END, 6) AS x, round(CASE WHEN opens THEN (v - u) / (2 * tan(radians(5e0))) ELSE y END, 6) AS y, round(CASE WHEN opens THEN (z + z2) / 2 ELSE z END, 6) AS z FROM uv"""))
def w5(spark, sf_dir):
    """Points of tracks for display: strips of both tilts crossed, other states as they are."""
    x = linking.stereo_points(tracks(spark, sf_dir), ["window_id", "track_id"])
    return x.select("window_id", "track_id", "seq", "paired", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")])


@plan("w3_number_states", ctes("track_states") + """SELECT window_id, track_id, seq, row_number() OVER (PARTITION BY window_id, track_id ORDER BY z DESC, seq DESC) - 1 AS state_idx, count(*) OVER (PARTITION BY window_id, track_id) AS nmeas FROM track_states""")
def w3(spark, sf_dir):
    return linking.number_states(states(spark, sf_dir), ["window_id", "track_id"]).select("window_id", "track_id", "seq", "state_idx", "nmeas")


@plan("j17_in_slab", ctes("track_states") + """SELECT window_id, track_id, seq, coalesce((SELECT 1.7e0 FROM range(15) r(i) WHERE z BETWEEN i * 10 AND i * 10 + 5 AND x BETWEEN -30 AND 30 AND y BETWEEN -30 AND 30 LIMIT 1), 0) AS field FROM track_states""")
def j17(spark, sf_dir):
    slabs = [(-30.0, 30.0, -30.0, 30.0, i * 10.0, i * 10.0 + 5, 1.7) for i in range(15)]
    return linking.in_slab(states(spark, sf_dir), slabs).select("window_id", "track_id", "seq", F.col("by").alias("field"))


@plan("a26_region_tally", ctes("track_states") + """SELECT window_id, CASE WHEN z < 50 THEN 'SiTarget' WHEN z < 100 THEN 'SiPad' ELSE 'MTC' END AS region, count(*) AS n_states,
count(*) FILTER (WHERE tilt <> 0 AND chi2 <= 3) AS n_inliers, count(*) FILTER (WHERE tilt <> 0 AND chi2 > 3) AS n_outliers, count(*) FILTER (WHERE tilt = 0) AS n_holes FROM track_states GROUP BY 1, 2""")
def a26(spark, sf_dir):
    return linking.region_tally(states(spark, sf_dir), (50.0, 100.0), hole=F.col("tilt") == 0)


@plan("a30_counts", BASE + "SELECT window_id, detector, count(*) AS n FROM numbered GROUP BY 1, 2")
def a30(spark, sf_dir):
    return overlaid_hits(spark, sf_dir).groupBy("window_id", "detector").agg(F.count("*").alias("n"))


@plan("a23_coverage", BASE + """SELECT layer, count(DISTINCT strip * 1000 + pad) AS n_cells, min(strip) AS x_lo, max(strip) AS x_hi, min(pad) AS y_lo, max(pad) AS y_hi,
count(DISTINCT strip * 1000 + pad) = (max(strip) - min(strip) + 1) * (max(pad) - min(pad) + 1) AS complete, count(DISTINCT floor(pad / 16e0) * 4 + floor(strip / 16e0)) AS n_wafers FROM numbered WHERE detector = 'SiPad' GROUP BY layer""")
def a23(spark, sf_dir):
    x = decoded(spark, sf_dir, "SiPad")
    cells = F.countDistinct("x_", "y_")
    x = bitfields.decode(x, bitfields.LAYOUTS["SiPad"], prefix="c_").withColumnsRenamed({"c_x": "x_", "c_y": "y_"})
    g = x.groupBy("layer").agg(
        cells.alias("n_cells"), F.min("x_").alias("x_lo"), F.max("x_").alias("x_hi"), F.min("y_").alias("y_lo"), F.max("y_").alias("y_hi"),
        F.countDistinct(measurements.wafer(F.col("x_"), F.col("y_"))).alias("n_wafers"),
    )
    return g.withColumn("complete", F.col("n_cells") == (F.col("x_hi") - F.col("x_lo") + 1) * (F.col("y_hi") - F.col("y_lo") + 1))

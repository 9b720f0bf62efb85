"""Registered plans on sources, windows, hits and digits."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitloom.functions import bitfields
from hitloom.operators import digitize, hits
from hitloom.plans.registry import plan
from hitloom.sources.fixtures import ctes, parts_of, spark_view

# Delays of the three sources in ns
DELAYS = {1: 25.0001, 2: 15.0, 3: 25.0}
WIDTH = 25.0


def registry(spark):
    return hits.source_registry(spark, [{"source_id": k, "delay_ns": v, "max_events": None} for k, v in DELAYS.items()])


def contributions(spark, sf_dir, name="contributions"):
    return spark_view(spark, sf_dir, name)


def overlaid_hits(spark, sf_dir):
    x = hits.overlay(contributions(spark, sf_dir), spark_view(spark, sf_dir, "contributions", numbered=False))
    return hits.merge(bitfields.route(x), parts=parts_of(spark, sf_dir, "lineitem"))


OVERLAY = """SELECT c.*, c.event_idx AS window_id, CASE WHEN detector <> 'MTC' THEN detector WHEN plane < 2 THEN 'SciFi' ELSE 'Scint' END AS routed
FROM contributions c WHERE event_idx <= (SELECT min(m) FROM (SELECT max(event_idx) AS m FROM contributions GROUP BY source_id) q)"""
HITS = """SELECT window_id, routed AS detector, cell_id, sum(energy) AS e, arg_min(hit_x, seq) AS x, arg_min(hit_y, seq) AS y, arg_min(hit_z, seq) AS z,
arg_min(time, seq) AS t, CASE WHEN min(source_id) = max(source_id) THEN min(source_id) ELSE 0 END AS source_id,
arg_max(pdg, {'e': energy, 's': -seq}) AS origin_pdg, count(*) AS n_contributions,
min(layer) AS layer, min(station) AS station, min(plane) AS plane, min(strip) AS strip, min(pad) AS pad
FROM overlay GROUP BY window_id, routed, cell_id"""
HIT_CTES = ctes("contributions", overlay=OVERLAY, hits=HITS)
ROUNDED = "round(e * 1e9, 3) AS e_ev, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(t, 4) AS t"


def _bits(*fields: tuple[str, int, int]) -> str:
    return ", ".join(f"CAST((cell_id >> {at}) & {(1 << width) - 1} AS INT) AS bf_{name}" for name, at, width in fields)


# Name, offset and width of the fields of each detector
SITARGET_BITS = (("system", 0, 8), ("layer", 8, 8), ("slice", 16, 4), ("plane", 20, 1), ("column", 21, 2), ("row", 23, 2), ("strip", 25, 14))
SIPAD_BITS = (("system", 0, 8), ("layer", 8, 8), ("slice", 16, 4), ("x", 20, 9), ("y", 29, 9))
MTC_BITS = (("system", 0, 8), ("station", 8, 2), ("layer", 10, 8), ("slice", 18, 4), ("plane", 22, 2), ("strip", 24, 14), ("x", 38, 9), ("y", 47, 9))


@plan("p1_decode_bits", ctes("contributions") + " UNION ALL BY NAME ".join(f"SELECT detector, event_idx, seq, {_bits(*bits)} FROM contributions WHERE detector = '{d}'" for d, bits in (("SiTarget", SITARGET_BITS), ("SiPad", SIPAD_BITS), ("MTC", MTC_BITS))))
def p1(spark, sf_dir):
    x = contributions(spark, sf_dir).select("detector", "event_idx", "seq", "cell_id")
    return bitfields.decode_all(x, bitfields.LAYOUTS).drop("cell_id")


@plan("p2_encode_bits", ctes("contributions") + "SELECT event_idx, seq, cell_id FROM contributions")
def p2(spark, sf_dir):
    layer, plane, strip = F.col("layer"), F.col("plane"), F.col("strip")
    values = {
        "SiTarget": {"system": F.lit(2), "layer": layer, "plane": plane, "strip": strip},
        "SiPad": {"system": F.lit(1), "layer": layer, "x": strip, "y": F.col("pad")},
        "MTC": {"system": F.lit(3), "station": F.col("station"), "layer": layer, "plane": plane, "strip": strip},
    }
    cell = F.coalesce(*[F.when(F.col("detector") == d, bitfields.encode(bitfields.LAYOUTS[d], v)) for d, v in values.items()])
    return contributions(spark, sf_dir).select("event_idx", "seq", cell.alias("cell_id"))


@plan("p3_route", ctes("contributions", overlay=OVERLAY) + "SELECT routed AS detector, count(*) AS n, count(DISTINCT cell_id) AS n_cells FROM overlay GROUP BY routed")
def p3(spark, sf_dir):
    x = bitfields.route(hits.overlay(contributions(spark, sf_dir)))
    return x.groupBy("detector").agg(F.count("*").alias("n"), F.countDistinct("cell_id").alias("n_cells"))


@plan("s5_source_report", ctes("overlay_contributions") + """, n AS (SELECT source_id, count(DISTINCT event_idx) AS n_events FROM overlay_contributions GROUP BY source_id)
SELECT r.s AS source_id, coalesce(n_events, 0) AS n_events, coalesce(n_events, 0) < (SELECT max(n_events) FROM n) AS exhausted FROM (VALUES (1), (2), (3), (4)) r(s) LEFT JOIN n ON n.source_id = r.s""")
def s5(spark, sf_dir):
    four = hits.source_registry(spark, [{"source_id": k, "delay_ns": 0, "max_events": None} for k in (1, 2, 3, 4)])
    return hits.source_report(contributions(spark, sf_dir, "overlay_contributions"), four)


@plan("p15_cap_events", ctes("overlay_contributions") + "SELECT source_id, count(*) AS n, max(event_idx) AS last FROM overlay_contributions WHERE event_idx < 10 GROUP BY source_id")
def p15(spark, sf_dir):
    return hits.cap_events(contributions(spark, sf_dir, "overlay_contributions"), 10).groupBy("source_id").agg(F.count("*").alias("n"), F.max("event_idx").alias("last"))


@plan("j1_attribute_pdg", ctes("contributions", "mc_particles") + """SELECT c.event_idx, c.seq, coalesce(p.pdg, 0) AS particle_pdg
FROM contributions c LEFT JOIN mc_particles p ON p.event_idx = c.event_idx AND p.particle_idx = c.particle_idx""")
def j1(spark, sf_dir):
    return hits.attribute_pdg(contributions(spark, sf_dir), spark_view(spark, sf_dir, "mc_particles")).select("event_idx", "seq", "particle_pdg")


@plan("j2_overlay", ctes("overlay_contributions") + """SELECT event_idx AS window_id, count(*) AS n, count(DISTINCT source_id) AS n_sources FROM overlay_contributions
WHERE event_idx <= (SELECT min(m) FROM (SELECT max(event_idx) AS m FROM overlay_contributions GROUP BY source_id) q) GROUP BY event_idx""")
def j2(spark, sf_dir):
    return hits.overlay(contributions(spark, sf_dir, "overlay_contributions")).groupBy("window_id").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("n_sources"))


@plan("a2_merge_hits", HIT_CTES + f"SELECT window_id, detector, cell_id, {ROUNDED}, n_contributions FROM hits")
def a2(spark, sf_dir):
    return overlaid_hits(spark, sf_dir).selectExpr("window_id", "detector", "cell_id", *ROUNDED.split(", r")[:1], *["r" + x for x in ROUNDED.split(", r")[1:]], "n_contributions")


@plan("a3_hit_source", HIT_CTES + "SELECT window_id, detector, source_id, count(*) AS n FROM hits GROUP BY window_id, detector, source_id")
def a3(spark, sf_dir):
    return overlaid_hits(spark, sf_dir).groupBy("window_id", "detector", "source_id").agg(F.count("*").alias("n"))


@plan("a4_origin_pdg", HIT_CTES + "SELECT window_id, detector, cell_id, origin_pdg, round(t, 4) AS t FROM hits")
def a4(spark, sf_dir):
    return overlaid_hits(spark, sf_dir).select("window_id", "detector", "cell_id", "origin_pdg", F.round("t", 4).alias("t"))


@plan("a5_slice_parallel", HIT_CTES + """, v AS (SELECT window_id, routed AS detector, row_number() OVER (PARTITION BY window_id, routed ORDER BY cell_id, seq) - 1 AS position, pdg FROM overlay),
h AS (SELECT window_id, detector, row_number() OVER (PARTITION BY window_id, detector ORDER BY cell_id) AS hit_no, n_contributions AS n, sum(n_contributions) OVER (PARTITION BY window_id, detector ORDER BY cell_id) - n_contributions AS at0 FROM hits)
SELECT h.window_id, h.detector, hit_no, position - at0 AS k, pdg AS value FROM h JOIN v ON h.window_id = v.window_id AND h.detector = v.detector AND position >= at0 AND position < at0 + n""")
def a5(spark, sf_dir):
    from pyspark.sql import Window

    x = bitfields.route(hits.overlay(contributions(spark, sf_dir)))
    keys = ["window_id", "detector"]
    values = x.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("cell_id", "seq")) - 1).cast("long").alias("position"), F.col("pdg").alias("value"))
    merged = hits.merge(x, parts=parts_of(spark, sf_dir, "lineitem")).select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("cell_id")).alias("hit_no"), F.col("n_contributions").alias("n"))
    return hits.slice_parallel(merged, values, keys)


@plan("a6_time_structure", ctes("contributions") + """SELECT detector, count(*) AS n, count(*) FILTER (WHERE time = 0) AS n_zero, count(*) FILTER (WHERE time > 0) AS n_positive, min(time) AS t_min, max(time) AS t_max,
round(100 * count(*) FILTER (WHERE time = 0) / count(*), 6) AS zero_percent, count(*) FILTER (WHERE time = 0) * 2 > count(*) AS mostly_zero FROM contributions GROUP BY detector""")
def a6(spark, sf_dir):
    return hits.time_structure(contributions(spark, sf_dir), ["detector"])


AXIS = """SELECT c.*, CAST(CAST(CAST(CAST(event_idx AS DOUBLE) * CASE source_id WHEN 1 THEN 25.0001e0 WHEN 2 THEN 15e0 ELSE 25e0 END AS FLOAT) AS DOUBLE) + CAST(CAST(time AS FLOAT) AS DOUBLE) AS FLOAT) AS t FROM contributions c"""
CUT = """SELECT a.*, greatest(CAST(trunc(CAST(CAST(CAST(CAST(t AS DOUBLE) - CAST((SELECT min(t) FROM axis) AS DOUBLE) AS FLOAT) AS DOUBLE) / 25e0 AS FLOAT)) AS BIGINT), 0) AS window_id FROM axis a"""
CUT_CTES = ctes("contributions", axis=AXIS, cut=CUT)


def stream_cut(spark, sf_dir):
    return hits.cut_windows(hits.on_time_axis(contributions(spark, sf_dir), registry(spark)), WIDTH)


@plan("st1_time_axis", ctes("contributions", axis=AXIS) + "SELECT event_idx, seq, round(CAST(t AS DOUBLE), 6) AS t FROM axis")
def st1(spark, sf_dir):
    return hits.on_time_axis(contributions(spark, sf_dir), registry(spark)).select("event_idx", "seq", F.round("t", 6).alias("t"))


@plan("st2_cut_windows", CUT_CTES + "SELECT event_idx, seq, window_id FROM cut")
def st2(spark, sf_dir):
    return stream_cut(spark, sf_dir).select("event_idx", "seq", "window_id")


@plan("st4_all_windows", CUT_CTES + """SELECT w.window_id, w.window_id * 25e0 AS t_window_start, coalesce(n, 0) AS n
FROM (SELECT unnest(range(0, (SELECT max(window_id) + 1 FROM cut))) AS window_id) w LEFT JOIN (SELECT window_id, count(*) AS n FROM cut GROUP BY window_id) c ON c.window_id = w.window_id""")
def st4(spark, sf_dir):
    return hits.all_windows(stream_cut(spark, sf_dir), WIDTH)


@plan("w1_relative_time", CUT_CTES + "SELECT event_idx, seq, round(CAST(t AS DOUBLE) - (CAST((SELECT min(t) FROM axis) AS DOUBLE) + window_id * 25e0), 4) AS t_rel FROM cut")
def w1(spark, sf_dir):
    return stream_cut(spark, sf_dir).select("event_idx", "seq", F.round("t_rel", 4).alias("t_rel"))


@plan("j3_cell_global_source", CUT_CTES + """, cells AS (SELECT detector, cell_id, CASE WHEN min(source_id) = max(source_id) THEN min(source_id) ELSE 0 END AS s FROM cut GROUP BY detector, cell_id)
SELECT c.window_id, c.detector, c.cell_id, round(sum(energy) * 1e9, 3) AS e_ev, any_value(s) AS source_id FROM cut c JOIN cells USING (detector, cell_id) GROUP BY c.window_id, c.detector, c.cell_id""")
def j3(spark, sf_dir):
    cut = stream_cut(spark, sf_dir)
    merged = hits.merge(cut, order=("t", "seq"), parts=parts_of(spark, sf_dir, "lineitem"))
    return hits.with_cell_source(merged, hits.cell_sources(cut)).select("window_id", "detector", "cell_id", F.round(F.col("e") * 1e9, 3).alias("e_ev"), "source_id")


@plan("a22_run_totals", CUT_CTES + "SELECT count(DISTINCT window_id) AS n_windows, count(*) AS n, round(CAST(min(t) AS DOUBLE), 4) AS t_min, round(CAST(max(t) AS DOUBLE), 4) AS t_max, round(count(*) / count(DISTINCT window_id), 6) AS per_window FROM cut")
def a22(spark, sf_dir):
    return stream_cut(spark, sf_dir).agg(
        F.countDistinct("window_id").alias("n_windows"), F.count("*").alias("n"), F.round(F.min("t"), 4).alias("t_min"), F.round(F.max("t"), 4).alias("t_max"),
        F.round(F.count("*") / F.countDistinct("window_id"), 6).alias("per_window"),
    )


@plan("a1_accumulate_steps", ctes("contributions") + """SELECT event_idx, cell_id, round(sum(energy) * 1e9, 3) AS edep_ev, round(sum(energy * hit_y) / sum(energy), 4) AS y, round(arg_min(hit_x, seq), 4) AS x, round(arg_min(hit_z, seq), 4) AS z
FROM contributions WHERE energy > 0 GROUP BY event_idx, cell_id""")
def a1(spark, sf_dir):
    steps = contributions(spark, sf_dir).selectExpr("event_idx", "cell_id", "seq", "energy AS edep", "hit_x AS x", "hit_y AS y", "hit_z AS z")
    return hits.accumulate_steps(steps).select("event_idx", "cell_id", F.round(F.col("edep") * 1e9, 3).alias("edep_ev"), F.round("y", 4).alias("y"), F.round("x", 4).alias("x"), F.round("z", 4).alias("z"))


@plan("p4_to_mip", HIT_CTES + "SELECT window_id, detector, cell_id, round(e * (1 / CASE detector WHEN 'SiTarget' THEN 9e-5 WHEN 'SiPad' THEN 9e-5 WHEN 'SciFi' THEN 2e-4 ELSE 3e-3 END), 9) AS mip FROM hits")
def p4(spark, sf_dir):
    mips = {"SiTarget": 9e-5, "SiPad": 9e-5, "SciFi": 2e-4, "Scint": 3e-3}
    return digitize.to_mip(overlaid_hits(spark, sf_dir), mips).select("window_id", "detector", "cell_id", F.round("mip", 9).alias("mip"))


@plan("p5_threshold", HIT_CTES + "SELECT window_id, detector, origin_pdg, count(*) AS n FROM hits WHERE e * (1 / 9e-5) > 0.5 GROUP BY window_id, detector, origin_pdg")
def p5(spark, sf_dir):
    """How many hits above half a MIP each detector sees per window, by dominant particle."""
    return digitize.threshold(digitize.to_mip(overlaid_hits(spark, sf_dir), 9e-5), 0.5).groupBy("window_id", "detector", "origin_pdg").agg(F.count("*").alias("n"))


@plan("p6_scifi_expected", HIT_CTES + """, d AS (SELECT *, CASE station WHEN 0 THEN 200e0 WHEN 1 THEN 250e0 ELSE 300e0 END AS half FROM hits WHERE detector = 'SciFi'),
l AS (SELECT *, 2 * half / cos(radians(5e0)) AS len, sqrt((half * tan(radians(5e0))) * (half * tan(radians(5e0))) + (y - half) * (y - half)) AS dist FROM d),
m AS (SELECT *, e * 160000e0 * (exp(-(dist - 20) / 3000e0) + 0.9e0 * exp(-((len - dist) - 20) / 3000e0)) AS light FROM l)
SELECT window_id, cell_id, round(light, 6) AS light, round(0.172e0 * (104 * (1 - exp(-light / 104))) - 1.31e0, 6) AS signal FROM m WHERE light >= 3""")
def p6(spark, sf_dir):
    x = overlaid_hits(spark, sf_dir).where("detector = 'SciFi'")
    x = x.withColumns({n: bitfields.get(bitfields.LAYOUTS["MTC"], n, F.col("cell_id")) for n in ("station", "plane")})
    return digitize.scifi(x).select("window_id", "cell_id", F.round("light", 6).alias("light"), F.round("signal", 6).alias("signal"))


@plan("p6_scifi_sampled")
def p6_sampled(spark, sf_dir):
    x = overlaid_hits(spark, sf_dir).where("detector = 'SciFi'")
    x = x.withColumns({n: bitfields.get(bitfields.LAYOUTS["MTC"], n, F.col("cell_id")) for n in ("station", "plane")})
    return digitize.scifi(x, mode="sampled").select("window_id", "cell_id", "photons", F.round("signal", 6).alias("signal"))


@plan("a25_species", HIT_CTES + "SELECT detector, abs(origin_pdg) AS species, count(*) AS n FROM hits GROUP BY detector, abs(origin_pdg)")
def a25(spark, sf_dir):
    return overlaid_hits(spark, sf_dir).groupBy("detector", F.abs("origin_pdg").alias("species")).agg(F.count("*").alias("n"))


@plan("s7_export_hits", HIT_CTES + """SELECT detector, window_id, cell_id, round(e * 1e9, 3) AS e_ev, source_id, origin_pdg, CAST(layer AS INT) AS bf_layer, CASE WHEN detector = 'SiPad' THEN CAST(strip AS INT) END AS bf_x, CASE WHEN detector = 'SiPad' THEN CAST(pad AS INT) END AS bf_y,
CASE WHEN detector <> 'SiPad' THEN CAST(plane AS INT) END AS bf_plane, CASE WHEN detector <> 'SiPad' THEN CAST(strip AS INT) END AS bf_strip, CASE WHEN detector IN ('SciFi', 'Scint') THEN CAST(station AS INT) END AS bf_station FROM hits""")
def s7(spark, sf_dir):
    """Flat tables of all detectors, with the fields that each one's layout has."""
    mtc = bitfields.LAYOUTS["MTC"].replace(",x:9,y:9", "")
    x = bitfields.decode_all(overlaid_hits(spark, sf_dir), {**bitfields.LAYOUTS, "SciFi": mtc, "Scint": mtc})
    fields = ["bf_layer", "bf_x", "bf_y", "bf_plane", "bf_strip", "bf_station"]
    return x.select("detector", "window_id", "cell_id", F.round(F.col("e") * 1e9, 3).alias("e_ev"), "source_id", "origin_pdg", *fields)

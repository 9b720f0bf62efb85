"""Registered plans on particles, histograms, quality, truth and trials."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hitloom.operators import physics, trials
from hitloom.plans.hits import HIT_CTES, overlaid_hits
from hitloom.plans.registry import plan
from hitloom.plans.tracks import states, tracks
from hitloom.sources.fixtures import SQL, ctes, parts_of, spark_view
from hitloom.streaming.windows import windowed_hits

MC = ctes("mc_particles")


def particles(spark, sf_dir):
    return spark_view(spark, sf_dir, "mc_particles")


E_ = "sqrt(px * px + py * py + pz * pz + mass * mass)"
PER_EVENT = f"""ev AS (SELECT event_idx, count(*) AS n, count(*) FILTER (WHERE generator_status = 1) AS n_primary, count(*) FILTER (WHERE n_daughters = 0) AS n_final,
sum(CASE WHEN generator_status = 1 THEN {E_} ELSE 0 END) AS e_primary, sum(CASE WHEN n_daughters = 0 THEN {E_} ELSE 0 END) AS e_final FROM mc_particles GROUP BY event_idx)"""


@plan("p17_predicates", MC + "SELECT pdg, count(*) FILTER (WHERE generator_status = 1) AS n_primary, count(*) FILTER (WHERE n_daughters = 0) AS n_final, bool_or(abs(pdg) = 13) AS muon FROM mc_particles GROUP BY pdg")
def p17(spark, sf_dir):
    return particles(spark, sf_dir).groupBy("pdg").agg(F.count_if(physics.is_primary()).alias("n_primary"), F.count_if(physics.is_final()).alias("n_final"), F.bool_or(physics.is_muon()).alias("muon"))


@plan("a7_multiplicities", MC + f", {PER_EVENT} SELECT event_idx, n, n_primary, n_final, round(e_primary, 6) AS e_primary, round(e_final, 6) AS e_final FROM ev")
def a7(spark, sf_dir):
    return physics.multiplicities(particles(spark, sf_dir)).select("event_idx", "n", "n_primary", "n_final", F.round("e_primary", 6).alias("e_primary"), F.round("e_final", 6).alias("e_final"))


@plan("w2_opening_angle", MC + """, p AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS p, row_number() OVER (PARTITION BY event_idx ORDER BY particle_idx) AS r FROM mc_particles WHERE generator_status = 1 AND px * px + py * py + pz * pz > 0)
SELECT a.event_idx, round(degrees(acos(greatest(-1, least(1, (a.px * b.px + a.py * b.py + a.pz * b.pz) / (a.p * b.p))))), 4) AS angle FROM p a JOIN p b ON a.event_idx = b.event_idx AND a.r = 1 AND b.r = 2""")
def w2(spark, sf_dir):
    return physics.opening_angle(particles(spark, sf_dir)).select("event_idx", F.round("angle", 4).alias("angle"))


@plan("a8_histogram", MC + f", {PER_EVENT} SELECT greatest(-1, least(50, CAST(floor((e_final - 0) / 60e0 * 50) AS INT))) AS bin, count(*) AS entries FROM ev GROUP BY 1")
def a8(spark, sf_dir):
    return physics.histogram(physics.multiplicities(particles(spark, sf_dir)), "e_final", 0.0, 60.0, 50)


# vertices of the fixture
VERTEX = "px * 300 AS vx, py * 300 + 0.25 AS vy, pz * 300 - 1100 AS vz"


def _mc_histograms_sql() -> str:
    tables = {
        "event": "ev", "pair": "ang", "primary": "ps WHERE generator_status = 1", "final": "ps WHERE n_daughters = 0",
        "moving": "ps WHERE generator_status = 1 AND px * px + py * py + pz * pz > 0",
    }
    value = {"energy": E_, "theta": "degrees(acos(pz / sqrt(px * px + py * py + pz * pz)))", "phi": "degrees(atan2(py, px))"}
    parts = [
        f"SELECT '{k}' AS hist, greatest(-1, least({n}, CAST(floor(({value.get(v, v)} - ({lo})) / ({hi - lo}) * {n}) AS INT))) AS bin, count(*) AS entries FROM {tables[of]} GROUP BY 2"
        for k, (of, v, n, lo, hi) in physics.mc_ranges(20.0, 10.0).items()
    ]
    return MC + f""", {PER_EVENT}, ps AS (SELECT *, {VERTEX} FROM mc_particles),
pp AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS p, row_number() OVER (PARTITION BY event_idx ORDER BY particle_idx) AS r FROM mc_particles WHERE generator_status = 1 AND px * px + py * py + pz * pz > 0),
ang AS (SELECT degrees(acos(greatest(-1, least(1, (a.px * b.px + a.py * b.py + a.pz * b.pz) / (a.p * b.p))))) AS angle FROM pp a JOIN pp b ON a.event_idx = b.event_idx AND a.r = 1 AND b.r = 2) """ + " UNION ALL ".join(parts)




@plan("a8_mc_histograms", _mc_histograms_sql())
def a8_all(spark, sf_dir):
    return physics.mc_histograms(particles(spark, sf_dir).selectExpr("*", *VERTEX.split(", ")), 20.0, 10.0)


@plan("a9_histogram_2d", MC + f", {PER_EVENT} SELECT greatest(-1, least(4, n_primary)) AS bin_x, greatest(-1, least(8, n_final)) AS bin_y, count(*) AS entries FROM ev GROUP BY 1, 2")
def a9(spark, sf_dir):
    return physics.histogram_2d(physics.multiplicities(particles(spark, sf_dir)), "n_primary", "n_final", (0, 4, 4), (0, 8, 8))


@plan("a10_histogram_means", MC + f""", {PER_EVENT} SELECT 'n' AS hist, round(avg(n) FILTER (WHERE n >= 0 AND n < 5), 6) AS mean, count(*) FILTER (WHERE n >= 0 AND n < 5) AS n FROM ev
UNION ALL SELECT 'e_final', round(avg(e_final) FILTER (WHERE e_final >= 0 AND e_final < 20), 6), count(*) FILTER (WHERE e_final >= 0 AND e_final < 20) FROM ev""")
def a10(spark, sf_dir):
    return physics.histogram_means(physics.multiplicities(particles(spark, sf_dir)), {"n": (0, 5), "e_final": (0, 20)}).select("hist", F.round("mean", 6).alias("mean"), "n")


AUTO = ("t", "x", "y", "z", "n_contributions", "source_id")


@plan("a31_auto_histograms", HIT_CTES + ", " + ", ".join(f"r_{c} AS (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM hits)" for c in AUTO) + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN hi > lo THEN least(99, CAST(floor(({c} - lo) / (hi - lo) * 100) AS INT)) ELSE 0 END AS bin, count(*) AS entries FROM hits, r_{c} GROUP BY 2" for c in AUTO))
def a31(spark, sf_dir):
    return physics.auto_histograms(overlaid_hits(spark, sf_dir), list(AUTO))


@plan("s10_sample_keys", ctes("samples") + r"SELECT regexp_extract(file_name, 'tracks_(\w+?)_angle_([\d.]+)\.', 1) AS pair, regexp_extract(file_name, 'tracks_(\w+?)_angle_([\d.]+)\.', 2) AS angle, count(*) AS n FROM samples GROUP BY 1, 2")
def s10(spark, sf_dir):
    return physics.sample_keys(spark_view(spark, sf_dir, "samples")).groupBy("pair", "angle").agg(F.count("*").alias("n"))


QUALITY = r"""k AS (SELECT o_orderkey AS w, regexp_extract(file_name, 'tracks_(\w+?)_angle_([\d.]+)\.', 1) AS pair, regexp_extract(file_name, 'tracks_(\w+?)_angle_([\d.]+)\.', 2) AS angle FROM samples),
t AS (SELECT window_id AS w, track_id, sum(chi2) / greatest(1, count(*)) AS q FROM track_states GROUP BY 1, 2), per AS (SELECT k.*, coalesce((SELECT count(*) FROM t WHERE t.w = k.w), 0) AS n FROM k)"""


@plan("a14_sample_quality", ctes("samples", "track_states") + f""", {QUALITY}, med AS (SELECT pair, angle, q FROM (SELECT pair, angle, q, row_number() OVER (PARTITION BY pair, angle ORDER BY q) - 1 AS r, count(*) OVER (PARTITION BY pair, angle) AS c FROM t JOIN k USING (w)) x WHERE r = floor(c / 2)),
d AS (SELECT pair, angle, string_agg(n || ':' || c, ' ' ORDER BY n) AS distribution FROM (SELECT pair, angle, n, count(*) AS c FROM per GROUP BY 1, 2, 3) y GROUP BY 1, 2)
SELECT pair, angle, count(*) AS n_windows, round(100 * count(*) FILTER (WHERE n = CASE pair WHEN 'mu_pi' THEN 14 ELSE 15 END) / count(*), 6) AS percent_expected, round(100 * count(*) FILTER (WHERE n > 0) / count(*), 6) AS percent_any, any_value(distribution) AS distribution, round(any_value(med.q), 6) AS median_quality
FROM per JOIN d USING (pair, angle) LEFT JOIN med USING (pair, angle) GROUP BY pair, angle""")
def a14(spark, sf_dir):
    windows = physics.sample_keys(spark_view(spark, sf_dir, "samples")).select(F.col("o_orderkey").alias("window"), "pair", "angle")
    t = states(spark, sf_dir).groupBy(F.col("window_id").alias("window"), "track_id").agg((F.sum("chi2") / F.greatest(F.lit(1), F.count("*"))).alias("quality"))
    x = physics.sample_quality(windows, t, {"mu_pi": 14, "e_pi": 15})
    return x.withColumns({c: F.round(c, 6) for c in ("percent_expected", "percent_any", "median_quality")})


@plan("w12_upper_median", ctes("track_states") + "SELECT window_id, round(chi2, 6) AS median_chi2 FROM (SELECT window_id, chi2, row_number() OVER (PARTITION BY window_id ORDER BY chi2) - 1 AS r, count(*) OVER (PARTITION BY window_id) AS c FROM track_states) x WHERE r = floor(c / 2)")
def w12(spark, sf_dir):
    return physics.upper_median(states(spark, sf_dir), ["window_id"], "chi2", "median_chi2").select("window_id", F.round("median_chi2", 6).alias("median_chi2"))


@plan("j23_windows_without_tracks", ctes("samples", "track_states") + "SELECT DISTINCT window_id FROM samples WHERE window_id NOT IN (SELECT window_id FROM track_states GROUP BY window_id, track_id HAVING count(*) >= 7)")
def j23(spark, sf_dir):
    """Windows without any track of seven states."""
    tracked = states(spark, sf_dir).groupBy("window_id", "track_id").count().where("count >= 7").select("window_id")
    return spark_view(spark, sf_dir, "samples").select("window_id").distinct().join(tracked, "window_id", "left_anti")


@plan("j20_all_windows", HIT_CTES + ", s AS (SELECT floor(o_orderkey / 64e0) AS w FROM orders) SELECT DISTINCT CAST(w AS BIGINT) AS window_id FROM (SELECT w FROM s UNION SELECT window_id FROM hits) x")
def j20(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(F.col("o_orderkey") / 64).alias("window_id"))
    return o.union(overlaid_hits(spark, sf_dir).select("window_id")).distinct()


@plan("u5_intersect", HIT_CTES + " SELECT window_id FROM hits WHERE detector = 'SciFi' INTERSECT SELECT floor(o_orderkey / 512) FROM orders")
def u5(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(F.col("o_orderkey") / 512).alias("window_id"))
    return overlaid_hits(spark, sf_dir).where("detector = 'SciFi'").select("window_id").intersect(o)


ST = ctes("track_states")


@plan("a17_parabola", ST + """, p AS (SELECT window_id, track_id, x * cos(radians(30e0)) + y * sin(radians(30e0)) AS x, z - avg(z) OVER (PARTITION BY window_id, track_id) AS d FROM track_states),
s AS (SELECT window_id, track_id, count(*)::DOUBLE AS n, sum(d) AS s1, sum(d*d) AS s2, sum(d*d*d) AS s3, sum(d*d*d*d) AS s4, sum(x) AS t0, sum(x*d) AS t1, sum(x*d*d) AS t2 FROM p GROUP BY 1, 2 HAVING count(*) >= 3),
q AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS w FROM s),
f AS (SELECT *, (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / w AS x0, (n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / w AS slope, 2 * (n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / w AS c FROM q WHERE abs(w) > 1)
SELECT window_id, track_id, CAST(n AS BIGINT) AS n, round(x0, 6) + 0 AS x0, round(slope, 6) + 0 AS slope, round(c, 7) + 0 AS curvature, round(CASE WHEN abs(c) > 0.01 THEN 1 / c END, 4) AS radius, round(CASE WHEN abs(c) > 0.01 THEN 0.3e0 * 1.7e0 / (1000 * c) END, 7) AS momentum FROM f""")
def a17(spark, sf_dir):
    """Curvature, radius and momentum of each track, along an axis turned by 30 degrees, whose places differ enough; the last two where it bends by more than 0.01 a mm."""
    turned = F.col("x") * F.cos(F.radians(F.lit(30.0))) + F.col("y") * F.sin(F.radians(F.lit(30.0)))
    s, keys = states(spark, sf_dir).withColumn("x", turned), ["window_id", "track_id"]
    bent = F.abs("curvature") > 0.01
    x = physics.parabola(s, keys, spread=1.0)
    return x.select(*keys, "n", *[(F.round(c, k) + 0).alias(c) for c, k in (("x0", 6), ("slope", 6), ("curvature", 7))], F.round(F.when(bent, F.col("radius")), 4).alias("radius"), F.round(F.when(bent, F.col("momentum")), 7).alias("momentum"))


@plan("a18_residuals", ST + """, d AS (SELECT window_id, z, x, x - loc0 AS d FROM track_states WHERE z > 30)
SELECT window_id, count(*) AS n, round(avg(abs(d)), 6) AS mean_abs, round(max(abs(d)), 6) AS max_abs, round(arg_min(d, {'z': z, 'x': x, 'd': d}), 6) AS first, round(arg_max(d, {'z': z, 'x': x, 'd': d}), 6) AS last FROM d GROUP BY window_id HAVING count(*) >= 3""")
def a18(spark, sf_dir):
    pairs = states(spark, sf_dir).where("z > 30").select("window_id", "z", "x", F.col("loc0").alias("truth"))
    return physics.residuals(pairs, ["window_id"]).select("window_id", "n", *[F.round(c, 6).alias(c) for c in ("mean_abs", "max_abs", "first", "last")])


@plan("a19_campaign_medians", ST + """, t AS (SELECT window_id, sum(x) + 0.5e0 AS radius, sum(y) + 0.25e0 AS radius_truth FROM track_states GROUP BY window_id)
SELECT round(quantile_cont(abs(radius), 0.5), 6) AS median_radius, round(quantile_cont(abs(radius_truth / radius), 0.5), 6) AS median_ratio, count(*) FILTER (WHERE sign(radius) = sign(radius_truth)) AS same_sign, count(*) AS n FROM t""")
def a19(spark, sf_dir):
    t = states(spark, sf_dir).groupBy("window_id").agg((F.sum("x") + 0.5).alias("radius"), (F.sum("y") + 0.25).alias("radius_truth"))
    return physics.campaign_medians(t).select(F.round("median_radius", 6).alias("median_radius"), F.round("median_ratio", 6).alias("median_ratio"), "same_sign", "n")


KNOWN = "kn AS (SELECT window_id, z, avg(x) AS x FROM track_states WHERE seq % 2 = 0 GROUP BY 1, 2), tg AS (SELECT window_id, track_id * 100 + seq AS tid, z FROM track_states WHERE seq % 2 = 1)"


@plan("j19_interpolate", ST + f""", {KNOWN}, b AS (SELECT t.*, (SELECT max({{'z': k.z, 'x': k.x}}) FROM kn k WHERE k.window_id = t.window_id AND k.z <= t.z) AS l, (SELECT min({{'z': k.z, 'x': k.x}}) FROM kn k WHERE k.window_id = t.window_id AND k.z >= t.z) AS r FROM tg t)
SELECT window_id, tid, round(CASE WHEN l IS NULL THEN r.x WHEN r IS NULL OR l.z = r.z THEN l.x ELSE l.x + (r.x - l.x) / (r.z - l.z) * (z - l.z) END, 4) AS x FROM b WHERE l IS NOT NULL OR r IS NOT NULL""")
def j19(spark, sf_dir):
    s = states(spark, sf_dir)
    targets = s.where("seq % 2 = 1").select("window_id", (F.col("track_id") * 100 + F.col("seq")).alias("tid"), "z")
    return physics.interpolate(targets, s.where("seq % 2 = 0").select("window_id", "z", "x"), ["window_id"]).select("window_id", "tid", F.round("x", 4).alias("x"))


@plan("a16_energy_weighted", HIT_CTES + """, c AS (SELECT window_id, CAST(floor(z / 25) AS BIGINT) AS zbin, plane, sum(e * x) / sum(e) AS c FROM hits WHERE detector = 'SciFi' GROUP BY 1, 2, 3)
SELECT window_id, zbin, round(avg(c), 4) AS x FROM c GROUP BY 1, 2 HAVING count(*) = 2""")
def a16(spark, sf_dir):
    from hitloom.plans.tracks import decoded

    return physics.energy_weighted(decoded(spark, sf_dir, "SciFi"), ["window_id"], 25.0).select("window_id", "zbin", F.round("x", 4).alias("x"))


@plan("a16_recovered_hits", HIT_CTES + """, f AS (SELECT window_id, plane, x, z, e, CAST(round_even(z / 25e0, 0) AS BIGINT) AS zbin FROM hits WHERE detector = 'SciFi' AND e > 8e-5),
per AS (SELECT window_id, zbin, plane, sum(e * x) / sum(e) AS x, sum(e * z) / sum(e) AS z, sum(e) AS energy FROM f GROUP BY 1, 2, 3),
bins AS (SELECT window_id, zbin, count(*) AS planes, avg(x) AS x, avg(z) AS z, sum(energy) AS energy FROM per GROUP BY 1, 2), both_ AS (SELECT * FROM bins WHERE planes = 2),
one AS (SELECT f.* FROM f JOIN bins USING (window_id, zbin) WHERE planes = 1),
lf AS (SELECT o.window_id, o.zbin, o.z, o.e, l.z AS lz, l.x AS lx FROM one o ASOF JOIN both_ l ON o.window_id = l.window_id AND o.z >= l.z),
lr AS (SELECT lf.*, r.z AS rz, r.x AS rx FROM lf ASOF JOIN both_ r ON lf.window_id = r.window_id AND lf.z <= r.z),
al AS (SELECT window_id, zbin, x, z, energy, TRUE AS paired FROM both_ UNION ALL SELECT window_id, zbin, CASE WHEN lz = rz THEN lx ELSE lx + (rx - lx) / (rz - lz) * (z - lz) END, z, e, FALSE FROM lr)
SELECT window_id, zbin, paired, count(*) AS n, round(sum(x), 4) AS sx, round(sum(z), 3) AS sz, round(sum(energy) * 1e9, 2) AS e_ev FROM al GROUP BY 1, 2, 3""")
def a16_recovered(spark, sf_dir):
    """Recovered hits above a threshold, with which some bins have one plane, by bin."""
    from hitloom.plans.tracks import decoded

    x = physics.recovered(decoded(spark, sf_dir, "SciFi").where("e > 8e-5"), ["window_id"], 25.0)
    return x.groupBy("window_id", "zbin", "paired").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("z"), 3).alias("sz"), F.round(F.sum("energy") * 1e9, 2).alias("e_ev"))


GOAL = "CASE WHEN w.z0 IS NULL OR w.z0 = w.z THEN w.c ELSE w.c + (n.mean_z - w.z) * (w.c - w.c0) / (w.z - w.z0) END"
# a walk from bin to bin: the chosen candidate's own z, the line through the last two at the candidates' mean z
PATHS = ctes("track_states") + f""", c AS (SELECT window_id, CAST(round_even(z / 5e0, 0) AS BIGINT) AS zbin, {{'z': z, 'c': x, 'e': chi2}} AS c, z FROM track_states),
rk AS (SELECT window_id, zbin, list(c ORDER BY c) AS f, sum(z) / count(*) AS mean_z, row_number() OVER (PARTITION BY window_id ORDER BY zbin) AS r FROM c GROUP BY window_id, zbin),
one AS (SELECT window_id, r, zbin, list_reduce(f, lambda a, b: CASE WHEN b.e > a.e THEN b ELSE a END) AS p FROM rk WHERE r = 1),
wk AS (SELECT window_id, r, zbin, p.c AS c, p.z AS z, CAST(NULL AS DOUBLE) AS c0, CAST(NULL AS DOUBLE) AS z0 FROM one UNION ALL
  SELECT window_id, r, zbin, p.c, p.z, c0, z0 FROM (SELECT n.window_id, n.r, n.zbin, w.c AS c0, w.z AS z0,
    list_reduce(n.f, lambda a, b: CASE WHEN abs(b.c - {GOAL}) < abs(a.c - {GOAL}) THEN b ELSE a END) AS p FROM wk w JOIN rk n ON n.window_id = w.window_id AND n.r = w.r + 1) q)
SELECT window_id, zbin, round(c, 6) AS coord, z FROM wk"""


@plan("w6_follow_paths", PATHS.replace("WITH ", "WITH RECURSIVE ", 1))
def w6(spark, sf_dir):
    c = states(spark, sf_dir).select("window_id", F.col("x").alias("coord"), "z", F.col("chi2").alias("e"))
    return physics.follow_paths(c, ["window_id"]).withColumn("coord", F.round("coord", 6))


@plan("p18_select_hits", HIT_CTES + " SELECT cell_id, round(x / 10, 6) AS x, round(z / 10, 6) AS z FROM hits WHERE window_id = 7 AND z BETWEEN -1500 AND 0 AND source_id = 1")
def p18(spark, sf_dir):
    return physics.select_hits(overlaid_hits(spark, sf_dir), 7, {"source_id": 1}, (-1500.0, 0.0)).select("cell_id", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


@plan("j21_labels", MC + "SELECT CASE abs(pdg) WHEN 13 THEN 'muon' WHEN 211 THEN 'pi' ELSE 'other' END AS label, count(*) AS n FROM mc_particles GROUP BY 1")
def j21(spark, sf_dir):
    return physics.labels(particles(spark, sf_dir), {13: "mu", 211: "pi"}, {13: "muon"}).groupBy("label").agg(F.count("*").alias("n"))


@plan("a15_z_extents", HIT_CTES + " SELECT detector, min(z) - 3 AS z_lo, max(z) + 3 AS z_hi, count(DISTINCT round(z, 4)) AS n_layers FROM hits GROUP BY detector")
def a15(spark, sf_dir):
    return physics.z_extents(overlaid_hits(spark, sf_dir), ["detector"]).select("detector", "z_lo", "z_hi", F.size("layers").cast("long").alias("n_layers"))


LAYERS = "ly AS (SELECT window_id, detector, arg_min(z, {'c': cell_id, 'z': z}) AS z FROM hits WHERE detector <> 'Scint' GROUP BY window_id, detector, round(z))"


def layers(spark, sf_dir):
    measured = overlaid_hits(spark, sf_dir).where("detector <> 'Scint'")
    return physics.window_layers(measured, ["window_id"], ["cell_id", "z"], parts=parts_of(spark, sf_dir, "lineitem"))


@plan("a15_window_layers", HIT_CTES + f", {LAYERS} SELECT window_id, detector, round(z, 4) AS z FROM ly")
def a15b(spark, sf_dir):
    return layers(spark, sf_dir).withColumn("z", F.round("z", 4))


@plan("p29_track_points", HIT_CTES.rstrip() + f", track_states AS ({SQL['track_states'].format(lineitem='lineitem')}), {LAYERS}" + """, s AS (SELECT * FROM track_states WHERE seq % 3 > 0), t AS (SELECT window_id, track_id, min(x) AS sx, min(y) AS sy FROM track_states GROUP BY 1, 2),
n AS (SELECT t.*, (SELECT count(*) FROM s WHERE s.window_id = t.window_id AND s.track_id = t.track_id) AS n FROM t), ok AS (SELECT window_id FROM ly GROUP BY 1 HAVING count(*) >= 2)
SELECT s.window_id, s.track_id, 'fit' AS kind, round(s.x, 6) AS x, round(s.y, 6) AS y, round(s.z, 4) AS z FROM s JOIN n USING (window_id, track_id) WHERE n >= 2
UNION ALL SELECT n.window_id, track_id, 'seed', round(sx, 6), round(sy, 6), round(z, 4) FROM n JOIN ly USING (window_id) JOIN ok USING (window_id) WHERE n < 2""")
def p29(spark, sf_dir):
    """Some states left out, so that tracks remain with fewer than two."""
    s = tracks(spark, sf_dir)
    t = s.groupBy("window_id", "track_id").agg(F.min("x").alias("seed_x"), F.min("y").alias("seed_y"))
    x = physics.track_points(t, s.where("seq % 3 > 0"), layers(spark, sf_dir).select("window_id", "z"), parts_of(spark, sf_dir, "lineitem"))
    return x.select("window_id", "track_id", "kind", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 4).alias("z"))


# --- trials ---------------------------------------------------------------------------

TR = ctes("trials")
OBJ = [trials.Objective("nhits_sipad"), trials.Objective("cost_proxy", False)]
ROWS = "ob AS (SELECT *, nhits_sipad AS y0, -cost_proxy AS y1 FROM trials WHERE status = 'COMPLETED')"
REFS = "rf AS (SELECT experiment, 0.5e0 * arg_min(y0, {'t': CASE WHEN tag <> 'baseline' THEN 1 ELSE 0 END, 'i': trial_id}) AS r0, 2e0 * arg_min(y1, {'t': CASE WHEN tag <> 'baseline' THEN 1 ELSE 0 END, 'i': trial_id}) AS r1 FROM ob GROUP BY experiment)"
FRONT = "fr AS (SELECT * FROM ob a WHERE NOT EXISTS (SELECT 1 FROM ob b WHERE b.experiment = a.experiment AND b.y0 >= a.y0 AND b.y1 >= a.y1 AND (b.y0 > a.y0 OR b.y1 > a.y1 OR b.trial_id < a.trial_id)))"
KEY = ["experiment"]


def trial_table(spark, sf_dir):
    return spark_view(spark, sf_dir, "trials")


def objective_rows(spark, sf_dir):
    return trials.objective_rows(trial_table(spark, sf_dir), OBJ)


def references(spark, sf_dir):
    return trials.reference_points(trial_table(spark, sf_dir), KEY, OBJ, [0.5, 2.0])


@plan("p21_objective_rows", TR + f", {ROWS} SELECT experiment, trial_id, y0, y1 FROM ob")
def p21(spark, sf_dir):
    return objective_rows(spark, sf_dir).select("experiment", "trial_id", "y0", "y1")


@plan("a27_front", TR + f", {ROWS}, {FRONT} SELECT experiment, trial_id FROM fr")
def a27(spark, sf_dir):
    return trials.front(objective_rows(spark, sf_dir), KEY).select("experiment", "trial_id")


@plan("a27_front_of_three", TR + """, ob AS (SELECT *, -wall_time_s AS y2, nhits_sipad AS y0, -cost_proxy AS y1 FROM trials WHERE status = 'COMPLETED')
SELECT experiment, trial_id FROM ob a WHERE NOT EXISTS (SELECT 1 FROM ob b WHERE b.experiment = a.experiment AND b.y0 >= a.y0 AND b.y1 >= a.y1 AND b.y2 >= a.y2 AND (b.y0 > a.y0 OR b.y1 > a.y1 OR b.y2 > a.y2 OR b.trial_id < a.trial_id))""")
def a27b(spark, sf_dir):
    rows = trials.objective_rows(trial_table(spark, sf_dir), [*OBJ, trials.Objective("wall_time_s", False)])
    return trials.front_of_many(rows, KEY, ["y0", "y1", "y2"]).select("experiment", "trial_id")


@plan("a29_reference_points", TR + f", {ROWS}, {REFS} SELECT experiment, round(r0, 4) AS r0, round(r1, 4) AS r1 FROM rf")
def a29(spark, sf_dir):
    return references(spark, sf_dir).select("experiment", F.round("r0", 4).alias("r0"), F.round("r1", 4).alias("r1"))


HV = f"""{ROWS}, {REFS}, ab AS (SELECT o.experiment, o.trial_id, y0, y1, r0, r1 FROM ob o JOIN rf USING (experiment) WHERE y0 > r0 AND y1 > r1),
fr AS (SELECT * FROM ab a WHERE NOT EXISTS (SELECT 1 FROM ab b WHERE b.experiment = a.experiment AND b.y0 >= a.y0 AND b.y1 >= a.y1 AND (b.y0 > a.y0 OR b.y1 > a.y1 OR b.trial_id < a.trial_id)))"""


@plan("a28_hypervolume", TR + f""", {HV}, st AS (SELECT experiment, (y0 - r0) * (y1 - coalesce(lag(y1) OVER (PARTITION BY experiment ORDER BY y0 DESC), r1)) AS a FROM fr)
SELECT rf.experiment, round(coalesce(sum(a), 0), 2) AS hv FROM rf LEFT JOIN st USING (experiment) GROUP BY rf.experiment""")
def a28(spark, sf_dir):
    return trials.hypervolume(objective_rows(spark, sf_dir), references(spark, sf_dir), KEY).select("experiment", F.round("hv", 2).alias("hv"))


STAIRS = """st AS (SELECT {keys}, (y0 - r0) * greatest(0e0, y1 - greatest(r1, coalesce(max(y1) OVER (PARTITION BY {keys} ORDER BY y0 DESC, y1 DESC, other ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r1))) AS a FROM px)"""


@plan("w9_hypervolume_trace", TR + f""", {ROWS}, {REFS}, al AS (SELECT o.experiment, o.trial_id, y0, y1, r0, r1 FROM ob o JOIN rf USING (experiment)),
px AS (SELECT t.experiment, t.trial_id, p.trial_id AS other, p.y0, p.y1, p.r0, p.r1 FROM al t JOIN al p ON p.experiment = t.experiment AND p.trial_id <= t.trial_id WHERE p.y0 > p.r0 AND p.y1 > p.r1),
{STAIRS.format(keys='experiment, trial_id')}, hv AS (SELECT experiment, trial_id, sum(a) AS hv FROM st GROUP BY 1, 2)
SELECT al.experiment, al.trial_id, round(coalesce(hv, 0) / 1000, 1) AS hv FROM al LEFT JOIN hv ON hv.experiment = al.experiment AND hv.trial_id = al.trial_id""")
def w9(spark, sf_dir):
    x = trials.hypervolume_trace(objective_rows(spark, sf_dir), references(spark, sf_dir), KEY)
    return x.select("experiment", "trial_id", F.round(F.col("hv") / 1000, 1).alias("hv"))


@plan("a28_hypervolume_of_three", TR + f""", {ROWS}, {REFS}, al AS (SELECT o.experiment, o.trial_id, y0, y1, -t.wall_time_s AS y2, r0, r1 FROM ob o JOIN rf USING (experiment) JOIN trials t ON t.experiment = o.experiment AND t.trial_id = o.trial_id WHERE y0 > r0 AND y1 > r1 AND -t.wall_time_s > -600),
lv AS (SELECT experiment, y2 AS level, y2 - coalesce(lag(y2) OVER (PARTITION BY experiment ORDER BY y2), -600) AS thick FROM (SELECT DISTINCT experiment, y2 FROM al) d),
px AS (SELECT l.experiment, l.level, p.trial_id AS other, p.y0, p.y1, p.r0, p.r1 FROM lv l JOIN al p ON p.experiment = l.experiment AND p.y2 >= l.level),
{STAIRS.format(keys='experiment, level')}, ar AS (SELECT experiment, level, sum(a) AS a FROM st GROUP BY 1, 2), sm AS (SELECT ar.experiment, sum(a * thick) AS hv FROM ar JOIN lv ON lv.experiment = ar.experiment AND lv.level = ar.level GROUP BY 1)
SELECT rf.experiment, round(coalesce(hv, 0) / 1000, 1) AS hv FROM rf LEFT JOIN sm ON sm.experiment = rf.experiment""")
def a28b(spark, sf_dir):
    rows = trials.objective_rows(trial_table(spark, sf_dir), [*OBJ, trials.Objective("wall_time_s", False)])
    refs = references(spark, sf_dir).withColumn("r2", F.lit(-600.0))
    return trials.hypervolume_of_many(rows, refs, KEY, ("y0", "y1", "y2")).select("experiment", F.round(F.col("hv") / 1000, 1).alias("hv"))


@plan("a21_status_counts", TR + """SELECT experiment, status, count(*) AS n, sum(count(*)) OVER (PARTITION BY experiment) AS total,
round(sum(CASE WHEN status = 'FAILED' THEN count(*) ELSE 0 END) OVER (PARTITION BY experiment) / sum(count(*)) OVER (PARTITION BY experiment), 6) AS failure_rate FROM trials GROUP BY 1, 2""")
def a21(spark, sf_dir):
    return trials.status_counts(trial_table(spark, sf_dir), KEY).withColumn("failure_rate", F.round("failure_rate", 6))


@plan("a21_wall_times", TR + """, m AS (SELECT experiment, wall_time_s / 60e0 AS m FROM trials WHERE wall_time_s <> 0), e AS (SELECT experiment, min(m) AS lo, max(m) AS hi FROM m GROUP BY 1)
SELECT experiment, CASE WHEN hi > lo THEN least(19, CAST(floor((m - lo) / ((hi - lo) / 20)) AS INT)) ELSE 0 END AS bin, round(any_value(lo + (CASE WHEN hi > lo THEN least(19, CAST(floor((m - lo) / ((hi - lo) / 20)) AS INT)) ELSE 0 END) * ((hi - lo) / 20)), 6) AS lo, count(*) AS entries FROM m JOIN e USING (experiment) GROUP BY 1, 2""")
def a21b(spark, sf_dir):
    return trials.wall_times(trial_table(spark, sf_dir), KEY).select("experiment", "bin", F.round("lo", 6).alias("lo"), "entries")


@plan("w15_minutes", TR + "SELECT experiment, trial_id, round((epoch(submitted_at) - min(epoch(submitted_at)) OVER (PARTITION BY experiment)) / 60, 4) AS minutes FROM trials")
def w15(spark, sf_dir):
    return trials.minutes_since_first(trial_table(spark, sf_dir), KEY).select("experiment", "trial_id", F.round("minutes", 4).alias("minutes"))


@plan("p25_derived_seed", TR + "SELECT experiment, trial_id, CAST(('0x' || substring(sha256(experiment || ':' || trial_id), 1, 8)) AS BIGINT) & 2147483647 AS seed FROM trials")
def p25(spark, sf_dir):
    return trial_table(spark, sf_dir).select("experiment", "trial_id", trials.derived_seed(F.col("experiment"), F.col("trial_id")).alias("seed"))


@plan("p26_retriable", TR + "SELECT experiment, trial_id, status IN ('COMPLETED', 'FAILED', 'INFEASIBLE') AS terminal, trial_id % 3 < 1 AND wall_time_s % 2 = 0 AS again FROM trials")
def p26(spark, sf_dir):
    reason = F.when(F.col("wall_time_s") % 2 == 0, "lost").otherwise("crash")
    return trial_table(spark, sf_dir).select("experiment", "trial_id", F.col("status").isin(*trials.TERMINAL).alias("terminal"), trials.retriable(F.col("trial_id") % 3, reason, 1).alias("again"))


@plan("p27_verdict", TR + "SELECT experiment, trial_id, CASE WHEN status = 'COMPLETED' THEN 'COMPLETED' WHEN trial_id % 2 = 0 THEN 'bad' WHEN trial_id % 3 = 0 THEN 'held' ELSE 'lost' END AS verdict FROM trials")
def p27(spark, sf_dir):
    done, i = F.when(F.col("status") == "COMPLETED", F.col("nhits_sipad")), F.col("trial_id")
    return trial_table(spark, sf_dir).select("experiment", "trial_id", trials.verdict(done, F.when(i % 2 == 0, "bad"), F.when(i % 3 == 0, "held")).alias("verdict"))


@plan("p22_search_space", TR + """SELECT experiment, trial_id, round(5 + (wall_time_s - 60) / 540e0 * 10, 6) AS thickness, round(exp(ln(1e-4) + (wall_time_s - 60) / 540e0 * (ln(1e-1) - ln(1e-4))), 8) AS tol, round((5 + (wall_time_s - 60) / 540e0 * 10 - 5) / 10, 6) AS back FROM trials""")
def p22(spark, sf_dir):
    u = (F.col("wall_time_s") - 60) / 540
    thick = trials.to_params(u, 5, 15)
    return trial_table(spark, sf_dir).select("experiment", "trial_id", F.round(thick, 6).alias("thickness"), F.round(trials.to_params(u, 1e-4, 1e-1, log=True), 8).alias("tol"), F.round(trials.to_unit(thick, 5, 15), 6).alias("back"))


@plan("j22_overridden", TR + "SELECT experiment, trial_id, 10 AS a, CAST(w_thickness AS INT) AS w, trial_id % 5 = 0 AS unknown FROM trials")
def j22(spark, sf_dir):
    base = F.create_map(F.lit("a"), F.lit(10), F.lit("w"), F.lit(1))
    changes = F.create_map(F.lit("w"), F.col("w_thickness").cast("int"))
    odd = F.when(F.col("trial_id") % 5 == 0, F.create_map(F.lit("zz"), F.lit(1))).otherwise(changes)
    m = trials.overridden(base, changes)
    return trial_table(spark, sf_dir).select("experiment", "trial_id", m["a"].alias("a"), m["w"].alias("w"), (F.size(trials.unknown_keys(base, odd)) > 0).alias("unknown"))


@plan("w13_envelope_overlaps", TR + """SELECT experiment, trial_id FROM (SELECT experiment, trial_id, trial_id * 10 AS s, lag(trial_id * 10 + w_thickness - 12) OVER (PARTITION BY experiment ORDER BY trial_id) AS e FROM trials) x WHERE e > s + 1e-6""")
def w13(spark, sf_dir):
    parts = trial_table(spark, sf_dir).select("experiment", "trial_id", (F.col("trial_id") * 10.0).alias("start"), (F.col("trial_id") * 10.0 + F.col("w_thickness") - 12).alias("end"))
    return trials.envelope_overlaps(parts, KEY).select("experiment", "trial_id")


@plan("s13_upsert", TR + "SELECT experiment * 100000 + trial_id AS trial_id, CASE WHEN status = 'SUBMITTED' THEN 'FAILED' ELSE status END AS status FROM trials")
def s13(spark, sf_dir):
    """By experiment and trial: the number made of both is only unique below 100,000 trials an experiment."""
    base = trial_table(spark, sf_dir).select("experiment", "trial_id", "status")
    stored = trials.upsert(base, base.where("status = 'SUBMITTED'").withColumn("status", F.lit("FAILED")), "experiment", "trial_id")
    return stored.select((F.col("experiment") * 100000 + F.col("trial_id")).alias("trial_id"), "status")


@plan("w14_next_ids", TR + "SELECT (SELECT max(trial_id) FROM trials) + row_number() OVER (ORDER BY order_id) AS trial_id, order_id FROM trials")
def w14(spark, sf_dir):
    t = trial_table(spark, sf_dir)
    return trials.next_ids(t, t.select("order_id"), "order_id").select("trial_id", "order_id")


@plan("j26_by_name", TR + """, t AS (SELECT 'w' || w_thickness || '_' || experiment AS name, trial_id FROM trials)
SELECT n.name, f.trial_id FROM (SELECT DISTINCT 'w' || w_thickness || '_' || (experiment + 20) AS name FROM trials) n LEFT JOIN (SELECT name, min(trial_id) AS trial_id FROM t GROUP BY name) f ON n.name = f.name""")
def j26(spark, sf_dir):
    t = trial_table(spark, sf_dir)
    name = lambda e: F.concat(F.lit("w"), F.col("w_thickness").cast("string"), F.lit("_"), e.cast("string"))
    return trials.by_name(t.select(name(F.col("experiment") + 20).alias("name")).distinct(), t.select(name(F.col("experiment")).alias("name"), "trial_id"))


@plan("a20_detector_counts", HIT_CTES + " SELECT window_id AS trial_id, nullif(count(*) FILTER (WHERE detector = 'SiTarget'), 0) AS nhits_sitarget, count(*) FILTER (WHERE detector = 'SiPad') AS nhits_sipad FROM hits GROUP BY window_id HAVING count(*) FILTER (WHERE detector = 'SiPad') > 0")
def a20(spark, sf_dir):
    x = overlaid_hits(spark, sf_dir).groupBy(F.col("window_id").alias("trial_id")).pivot("detector", ["SiTarget", "SiPad"]).count()
    # an absent detector has no metric; without SiPad there is no result
    return x.where("SiPad IS NOT NULL").select("trial_id", F.col("SiTarget").alias("nhits_sitarget"), F.col("SiPad").alias("nhits_sipad"))


@plan("t3_first_of_group", TR + "SELECT experiment, trial_id FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY trial_id) AS r FROM trials WHERE status = 'FAILED') x WHERE r <= 10")
def t3(spark, sf_dir):
    w = Window.partitionBy("experiment").orderBy("trial_id")
    return trial_table(spark, sf_dir).where("status = 'FAILED'").withColumn("r", F.row_number().over(w)).where("r <= 10").select("experiment", "trial_id")


WINDOWED = ctes("stream") + """SELECT time_bucket(INTERVAL '1 hour', ts) AS t_window_start, cell_id, round(sum(energy), 4) AS e, count(*) AS n, min(ts) AS t, CASE WHEN min(source_id) = max(source_id) THEN min(source_id) ELSE 0 END AS source_id FROM stream GROUP BY 1, 2"""


def as_rows(x):
    """Windowed hits as the SQL has them."""
    return x.withColumn("e", F.round("e", 4)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("t", "t_window_start")})


@plan("st5_windowed_hits", WINDOWED)
def st5(spark, sf_dir):
    x = spark_view(spark, sf_dir, "stream").withColumn("ts", F.col("ts").cast("timestamp"))
    return as_rows(windowed_hits(x, "1 hour", "10 minutes"))

"""Small tables worked by hand."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.functions import bitfields, draws
from hitloom.operators import digitize, hits, linking, measurements, physics, seeding, trials
from hitloom.streaming import feed, windows


def test_window_edges(spark):
    x = spark.createDataFrame([(24.999,), (25.0,), (-1.0,)], "t double")
    assert [r[0] for r in x.select(hits.window_index(F.col("t"), F.lit(0.0), 25.0)).collect()] == [0, 1, 0]


def test_cell_mixed_anywhere_is_mixed_everywhere(spark):
    rows = [(0, "SiPad", 7, 1), (3, "SiPad", 7, 2), (3, "SiPad", 8, 2)]
    c = spark.createDataFrame(rows, "window_id int, detector string, cell_id int, source_id int")
    h = hits.with_cell_source(c.drop("source_id"), hits.cell_sources(c))
    assert {(r.window_id, r.cell_id): r.source_id for r in h.collect()} == {(0, 7): 0, (3, 7): 0, (3, 8): 2}


def test_dominant_particle_of_a_tie_is_the_first(spark):
    rows = [(0, "SiPad", 7, 1, s, 2.0, 1.0, p, 0.0, 0.0, 0.0) for s, p in ((1, 13), (2, 211))]
    c = spark.createDataFrame(rows, "window_id int, detector string, cell_id int, source_id int, seq int, energy double, time double, pdg int, hit_x double, hit_y double, hit_z double")
    assert hits.merge(c).first().origin_pdg == 13


def test_route_and_fields(spark):
    x = spark.range(4).select((F.col("id") * (1 << 22)).alias("cell_id"), F.lit("MTC").alias("detector"))
    assert [r.detector for r in bitfields.route(x).orderBy("cell_id").collect()] == ["SciFi", "SciFi", "Scint", "Scint"]
    assert bitfields.parse("a:8,b:16:-4") == [("a", 0, 8, False), ("b", 16, 4, True)]
    signed = spark.createDataFrame([(15 << 16,)], "cell_id long")
    assert bitfields.decode(signed, "a:8,b:16:-4").first().bf_b == -1
    for bad in ("a", "a:70", "a:1:2:3"):
        with pytest.raises(ValueError):
            bitfields.parse(bad)


def test_threshold_is_strict(spark):
    x = spark.createDataFrame([(0.5,), (0.51,)], "mip double")
    assert digitize.threshold(x, 0.5).count() == 1


def test_neighbours_are_strictly_closer(spark):
    x = spark.createDataFrame([(0, v) for v in (0.0, 0.4, 0.9, 1.0)], "w int, x double")
    n = {r.x: r.n for r in measurements.neighbours_1d(x, ["w"], "x", 1.0).collect()}
    assert n == {0.0: 2, 0.4: 3, 0.9: 3, 1.0: 2}
    assert sorted(r.x for r in measurements.purge(measurements.neighbours_1d(x, ["w"], "x", 1.0), 2).collect()) == [0.0, 1.0]
    two = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate([(0, 0), (3, 4), (0.5, 0.5), (-1, -1)])], "w int, i int, x double, y double")
    assert {r.i: r.n for r in measurements.neighbours_2d(two, ["w"], "i", 5.0).collect()} == {0: 2, 1: 1, 2: 3, 3: 2}


def test_pairing_leaves_the_far_one_single(spark):
    rows = [(0, 0, 0, 1, 11, 0, 1.0, 0.0, 0.0, 1.0), (0, 0, 0, 2, 12, 1, 2.0, 2.0, 0.0, 1.0), (0, 0, 0, 3, 13, 1, 3.0, 30.0, 0.0, 1.0)]
    x = spark.createDataFrame(rows, "window_id int, station int, layer int, hit_id int, cell_id int, plane int, x double, z double, t double, e double")
    out = measurements.mtc(x)
    assert {(r.cell_id, r.is2d) for r in out.collect()} == {(11, True), (13, False)}
    assert measurements.mtc(x, "no such way").where("is2d").count() == 0


def test_resolved_measurements_are_points(spark):
    row = "window_id long, hit_id long, cell_id long, station int, layer int, plane int, x double, z double, t double, e double"
    # a pair, two singles that cross in round(z / 5), one that meets nothing
    rows = [(1, 1, 1, 0, 0, 0, 10.0, 100.0, 0.0, 1.0), (1, 2, 2, 0, 0, 1, 12.0, 101.0, 0.0, 1.0), (1, 3, 3, 0, 1, 0, 10.0, 201.0, 0.0, 1.0), (1, 4, 4, 0, 2, 1, 12.0, 199.0, 0.0, 1.0), (1, 5, 5, 0, 3, 0, 10.0, 300.0, 0.0, 1.0)]
    m = measurements.mtc(spark.createDataFrame(rows, row))
    out = sorted((round(r.z, 3), round(r.x, 3), r.weight) for r in seeding.mtc_points(m, ["window_id"]).collect())
    assert out == [(100.5, 11.0, 2), (200.0, round(11 * math.cos(math.radians(5)), 3), 2)]
    assert [r.z for r in seeding.mtc_points(m, ["window_id"], most=0).collect()] == [100.5]
    # pairs alone make the votes and the seed
    rows = [(1, 2 * i + p, 2 * i + p, 0, i, p, 10.0, 100.0 * i, 0.0, 1.0) for i in range(4) for p in (0, 1)]
    (seed,) = seeding.seeds(seeding.mtc_points(measurements.mtc(spark.createDataFrame(rows, row)), ["window_id"]), ["window_id"]).collect()
    assert seed.n_votes == 8 and abs(seed.x - 10) < 0.755


def test_recovered_hits(spark):
    # pairs at z 0 and 20; single ones between and outside; round and floor differ at 3
    hits = [(0, 1.0, 0.0, 1.0), (0, 3.0, 1.0, 3.0), (1, 4.0, 1.0, 2.0), (0, 8.0, 20.0, 1.0), (1, 10.0, 20.0, 1.0), (0, 99.0, 10.0, 5.0), (0, 98.0, 11.0, 6.0), (1, 97.0, 3.0, 7.0), (1, 96.0, 40.0, 1.0), (0, 95.0, -9.0, 1.0), (2, 1.0, 10.0, 1.0)]
    df = spark.createDataFrame([(1, *h) for h in hits] + [(2, 0, 1.0, 0.0, 1.0)], "window_id long, plane int, x double, z double, e double")
    out = sorted((r.window_id, r.z, r.x, r.energy, r.paired) for r in physics.recovered(df, ["window_id"]).collect())
    z0, x0 = (0.75 + 1) / 2, (2.5 + 4) / 2
    at = lambda z: x0 + (9 - x0) * (z - z0) / (20 - z0)
    want = [(1, z0, x0, 6.0, True), (1, 3.0, at(3), 7.0, False), (1, 10.0, at(10), 5.0, False), (1, 11.0, at(11), 6.0, False), (1, 20.0, 9.0, 2.0, True)]
    assert [r[0::4] for r in out] == [r[0::4] for r in want] and [x for r in out for x in r[1:4]] == pytest.approx([x for r in want for x in r[1:4]])


def test_ghosts(spark):
    pts = spark.createDataFrame([(0, f"x{i}", f"y{j}", float(i), float(j), 0.0, 2) for i in (1, 2) for j in (1, 2)], "w int, x_id string, y_id string, x double, y double, z double, weight int")
    pads = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 2.0)], "w int, x double, y double")
    kept = seeding.drop_ghosts(seeding.confirm(pts, pads, ["w"], ["x_id", "y_id"], 0.5), ["w"])
    assert {(r.x_id, r.y_id) for r in kept.collect()} == {("x1", "y1"), ("x2", "y2")}


def test_suppression_in_order_of_votes(spark):
    rows = [(w, ix, 0, v) for w in (1, 2) for ix, v in ((0, 5), (2, 4), (4, 3), (10, 1))]
    kept = seeding.suppress(spark.createDataFrame(rows, "w int, ix int, iy int, votes int"), ["w"], 3).collect()
    assert sorted((r.w, r.ix) for r in kept) == [(w, i) for w in (1, 2) for i in (0, 4, 10)]  # the second one is suppressed and suppresses nothing


def test_states_of_opposite_tilt(spark):
    s = spark.createDataFrame([(0, i, z, 0.0, 0.0, t, 1.0) for i, (z, t) in enumerate([(0.0, 0.09), (2.0, -0.09), (4.0, 0.09)])], "w int, seq int, z double, x double, y double, tilt double, chi2 double")
    assert sorted((r.z, r.paired) for r in linking.pair_states(s, ["w"]).collect()) == [(1.0, True), (4.0, False)]


@pytest.mark.parametrize(("most", "kept"), [(0.7, {0, 1, 2}), (0.6, {0, 2})])
def test_duplicates(spark, most, kept):
    seg = spark.createDataFrame([(0, i, 0.5 + i / 10, 1) for i in range(3)], "window_id long, segment_id long, chi2 double, ndf int")
    h = spark.createDataFrame([(0, i, i + k) for i in range(3) for k in range(3)], "window_id long, segment_id long, hit_id long")
    assert {r.segment_id for r in linking.without_duplicates(seg, h, most).collect()} == kept


def test_greedy_links_and_chains(spark):
    rows = [(0, 0, 1, 10, 1.0), (0, 0, 1, 11, 2.0), (0, 0, 2, 10, 3.0), (0, 1, 10, 20, 0.5), (0, 1, 12, 21, 0.1), (None, 0, 1, 2, 0.0)]
    found = linking.link(spark.createDataFrame(rows, "window_id long, det int, up long, down long, score double"))
    assert sorted((r.up, r.down) for r in found.collect()) == [(1, 10), (10, 20), (12, 21)]
    chains = linking.chains(found)
    assert {(r.first, r.second, r.third) for r in chains.collect()} == {(1, 10, 20), (12, 21, None)}
    scored = spark.createDataFrame([r for r in rows if r[0] is not None], "window_id long, det int, up long, down long, score double")
    for three, want in ((F.lit(True), (1, 10, 20)), (F.lit(False), (10, 20, None))):  # the better link of a rejected chain
        assert want in {(r.first, r.second, r.third) for r in linking.accepted_chains(chains, scored, three).collect()}


def test_upper_median(spark):
    x = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4)], "k int, v double")
    assert physics.upper_median(x, ["k"], "v", "m").first().m == 3


@pytest.mark.parametrize(("points", "area"), [([(-10.0, -1.0), (-2.0, -5.0), (-15.0, -5.5)], 48.0), ([(-20.0, -7.0)], 0.0)])
def test_hypervolume(spark, points, area):
    rows = spark.createDataFrame([(0, i, *p) for i, p in enumerate(points)], "e int, trial_id int, y0 double, y1 double")
    refs = spark.createDataFrame([(0, -18.0, -6.0)], "e int, r0 double, r1 double")
    assert trials.hypervolume(rows, refs, ["e"]).first().hv == area
    assert trials.hypervolume_trace(rows, refs, ["e"]).agg(F.max("hv")).first()[0] == area


def test_volumes_in_any_dimension(spark):
    rng = random.Random(4)
    for n in (2, 3, 4):
        points = [tuple(float(rng.randint(0, 5)) for _ in range(n)) for _ in range(12)]
        ref = (1.0,) * n
        cells = {c for p in points for c in itertools.product(*[range(1, int(v)) for v in p])} if n else set()
        above = [p for p in points if all(v > 1 for v in p)]
        assert trials.volume(above, ref) == len(cells)
        trace, seen = trials._Trace(), set()
        for p in points:
            trace.add(p, ref)
            seen |= set(itertools.product(*[range(1, int(v)) for v in p]))
            assert trace.total == len(seen)
        rows = spark.createDataFrame([(7, i, *p) for i, p in enumerate(points)], "e int, trial_id int, " + ", ".join(f"y{i} double" for i in range(n)))
        refs = spark.createDataFrame([(7, *ref), (8, *ref)], "e int, " + ", ".join(f"r{i} double" for i in range(n)))
        dims = tuple(f"y{i}" for i in range(n))
        assert {(r.e, r.hv) for r in trials.hypervolume_of_many(rows, refs, ["e"], dims).collect()} == {(7, len(cells)), (8, 0.0)}
        best = {i for i, p in enumerate(points) if not any(all(a >= b for a, b in zip(q, p)) and (q != p or j < i) for j, q in enumerate(points))}
        assert {r.trial_id for r in trials.front_of_many(rows, ["e"], list(dims)).collect()} == best


def test_ids_follow_in_order(spark):
    new = spark.createDataFrame([(f"n{i:03d}",) for i in range(50)], "name string").repartition(7)
    base = spark.createDataFrame([(3,), (9,)], "trial_id long")
    for b, first in ((base, 10), (base.limit(0), 0)):
        assert [(r.name, r.trial_id) for r in trials.next_ids(b, new, "name").orderBy("name").collect()] == [(f"n{i:03d}", first + i) for i in range(50)]
    assert trials.next_ids(base, new.limit(0), "name").count() == 0


def test_search_space_bounds(spark):
    x = spark.createDataFrame([(0.0,), (1.0,)], "u double").select(
        trials.to_params(F.col("u"), 5, 15).alias("a"), trials.to_params(F.col("u"), 4, 40, integer=True).alias("b"), trials.to_params(F.col("u"), 1e-4, 1e-1, log=True).alias("c"))
    lo, hi = x.orderBy("a").collect()
    assert (lo.a, hi.a, lo.b, hi.b) == (5, 15, 4, 40) and abs(lo.c - 1e-4) < 1e-12 and abs(hi.c - 1e-1) < 1e-9


def test_design_points_resume(spark):
    a = trials.design_points(spark, 3, 8).orderBy("id").collect()
    assert a[5:] == trials.design_points(spark, 3, 3, skip=5).orderBy("id").collect() and abs(a[0].u0 - 0.5) < 1e-9


def test_sources_must_be_complete(spark):
    full = {"source_id": 1, "delay_ns": 25, "max_events": None, "path": "/a", "tables": {"hits": "h", "contributions": "c", "particles": "p"}}
    assert hits.source_registry(spark, [full]).first().tables["hits"] == "h"
    for specs in ([], [{"source_id": 1}], [full, {k: v for k, v in full.items() if k != "path"}], [full | {"tables": {"hits": "h"}}]):
        with pytest.raises(ValueError):
            hits.source_registry(spark, specs)
    with pytest.raises(ValueError):
        hits.validate(spark.range(1), ["x"])


def test_poisson_counts_of_any_mean():
    rng = np.random.default_rng(5)
    for mean in (0.3, 20.0, 90.0, 350.0, 5000.0):
        k = draws.poisson_inverse(np.full(4000, mean), rng.random(4000))
        assert abs(k.mean() - mean) < 5 * (mean / 4000) ** 0.5 and 0.9 < k.var() / mean < 1.1
    many = draws.poisson_inverse(np.full(2000, 1e6), rng.random(2000))
    assert abs(many.mean() - 1e6) < 5e3 / 2000**0.5 and 0.85 < many.var() / 1e6 < 1.15
    again = rng.random(9)
    assert (draws.poisson_inverse(np.full(9, 1e9), again) == draws.poisson_inverse(np.full(9, 1e9), again)).all()
    assert list(draws.poisson_inverse(np.array([np.inf]), np.array([0.5])) > 4e18) == [True]
    # the inverse of the distribution, and its ends
    p = np.cumsum([math.exp(-3) * 3**k / math.factorial(k) for k in range(30)])
    u = rng.random(500)
    assert (draws.poisson_inverse(np.full(500, 3.0), u) == np.searchsorted(p, u)).all()
    assert list(draws.poisson_inverse(np.array([0.0, -1.0, np.nan, 90.0]), np.array([0.5, 0.5, 0.5, 1 - 2**-53]))[:3]) == [0, 0, 0]


def test_windows_of_a_file_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    # the most energetic one of 2 and 3 is a tie: the earlier counts
    rows = [(t + dt.timedelta(minutes=m), s, 5, e, q, p, float(q)) for m, s, e, q, p in ((2, 1, 2.0, 7, 13), (1, 1, 1.0, 9, 11), (3, 2, 2.0, 8, 22), (70, 1, 1.0, 1, 13), (200, 1, 1.0, 1, 13))]
    schema = "ts timestamp, source_id int, cell_id long, energy double, seq int, pdg int, hit_x double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    out = windows.windowed_hits(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 hour", "1 minute")
    q = out.writeStream.format("memory").queryName("hit_windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    found = spark.table("hit_windows").collect()
    assert sorted(r.n for r in found) == [1, 3]
    (first,) = [r for r in found if r.n == 3]
    assert (first.e, first.source_id, first.t, first.x, first.origin_pdg) == (5.0, 0, t + dt.timedelta(minutes=1), 9.0, 13)


def test_trial_feed_keeps_the_newest(spark, tmp_path):
    schema = "experiment int, trial_id int, status string, a double, b double, at int"
    log, read = str(tmp_path / "log"), lambda: {(r.trial_id, r.status, r.a) for r in feed.newest(spark, log).collect()}
    first = [(0, 1, "SUBMITTED", None, None, 1), (0, 2, "COMPLETED", 0.5, 1.0, 2)]
    last = [(0, 1, "COMPLETED", 1.0, 2.0, 3), (0, 2, "SUBMITTED", None, None, 1), (0, 1, "RUNNING", None, None, 2)]
    wants = [({(1, "SUBMITTED", None), (2, "COMPLETED", 0.5)}, 2), ({(1, "COMPLETED", 1.0), (2, "COMPLETED", 0.5)}, 3)]
    for rows, (want, n) in zip((first, last, last), (*wants, wants[1]), strict=True):  # the last ones come twice
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = feed.trial_feed(stream, log, str(tmp_path / "ck"), ["at"])
        query.awaitTermination(90)
        assert query.exception() is None and read() == want
        assert spark.read.parquet(log).count() == n  # only changes are written
    counts, front = feed.progress(spark, log, [trials.Objective("a"), trials.Objective("b")])
    assert [(r.status, r.n) for r in counts.collect()] == [("COMPLETED", 2)] and [r.trial_id for r in front.collect()] == [1]


def test_hits_are_merged_by_hash_after_one_shuffle(spark):
    rows = [(0, "SiPad", 1, 2.0, 5, 1, 13, 1.0, 2.0, 3.0, 9.0), (0, "SiPad", 1, 2.0, 4, 2, 11, 4.0, 5.0, 6.0, 8.0), (0, "SiPad", 1, 1.0, 1, 1, 22, 7.0, 8.0, 9.0, 7.0), (1, "SiPad", 1, None, 1, 3, 2, 0.0, 0.0, 0.0, 1.0)]
    c = spark.createDataFrame(rows, "window_id long, detector string, cell_id long, energy double, seq long, source_id int, pdg int, hit_x double, hit_y double, hit_z double, time double")
    merged = hits.merge(c)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan
    want = [(0, "SiPad", 1, 5.0, 7.0, 8.0, 9.0, 7.0, 0, 11, 3), (1, "SiPad", 1, None, 0.0, 0.0, 0.0, 1.0, 3, 2, 1)]
    assert sorted(tuple(r) for r in merged.collect()) == want
    assert sorted(tuple(r) for r in hits.merge(c, order=("seq", "time")).collect()) == want


def test_steps_are_configured_by_named_properties(spark):
    from hitloom.operators import steps

    assert steps.properties("splice") == {"max_dist": 15.0, "max_angle": 0.1, "angle_weight": 100.0}
    step = steps.configured("splice", {"max_dist": 8, "max_angle": 0.05})
    assert step.keywords == {"max_dist": 8.0, "max_angle": 0.05} and isinstance(step.keywords["max_dist"], float)
    assert steps.configured("region_tally", {"bounds": [1.0, 2.0]}).keywords == {"bounds": (1.0, 2.0)}
    for name, given in (("splice", {"maxDist": 1}), ("splice", {"max_dist": "far"}), ("nothing", {}), ("suppress", {"tail": 1.5}), ("seeds", {"most": True})):
        with pytest.raises(ValueError):
            steps.configured(name, given)
    rows = {(r.step, r.property): (r.kind, r.default) for r in steps.catalogue(spark).collect()}
    assert rows["seeds", "most"] == ("int", "5") and len({s for s, _ in rows}) == len([s for s in steps.STEPS if steps.properties(s)])

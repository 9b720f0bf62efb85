"""Operators that spread one giant group over tasks, against plain computations."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from hitloom.operators import hits, physics, selection, trials, variants


@pytest.mark.parametrize("few", [1, 10**6])
def test_order_statistics_equal_sorting(spark, few):
    rng = random.Random(few)
    groups = {
        "even": [rng.uniform(-5, 5) for _ in range(400)], "alike": [2.5] * 90, "steep": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(301)],
        "few": [3.0], "ties": [float(rng.randrange(4)) for _ in range(200)], "ends": [math.inf] * 30 + [-math.inf] * 29 + [1.0, 1e308, -1e308, 0.0, -0.0], "infinite": [math.inf] * 9 + [1.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("even", math.nan), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.which): r.value for r in selection.ranked(df, ["g"], "v", lambda n: F.array(F.lit(0), F.floor(n / 3), F.floor(n / 2), n - 1), few).collect()}
    want = {(g, k): sorted(vs)[i] for g, vs in groups.items() for k, i in enumerate((0, len(vs) // 3, len(vs) // 2, len(vs) - 1))}
    assert got == want


def test_medians_of_all_rows_and_of_none(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 9, 3)], "v double")
    assert [tuple(r) for r in selection.upper_median(df, [], "v", "m").collect()] == [(5.0,)]
    assert [tuple(r) for r in selection.median(df, [], "v", "m").collect()] == [(4.0,)]
    assert selection.median(df.limit(0), [], "v", "m").first().m is None
    fits = spark.createDataFrame([(2.0, 4.0), (-3.0, 3.0), (0.0, 1.0)], "radius double, radius_truth double")
    assert tuple(physics.campaign_medians(fits).first()) == (2.0, 1.5, 1, 3)
    assert tuple(physics.campaign_medians(fits.limit(0)).first()) == (None, None, 0, 0)


def test_front_of_one_giant_group(spark):
    rng = random.Random(2)
    points = [(e, t, float(rng.randrange(60)), float(rng.randrange(60))) for e, n in ((0, 3000), (1, 5), (2, 1)) for t in range(n)]
    points += [(3, t, float(t), float(400 - t)) for t in range(400)]  # none dominated
    df = spark.createDataFrame(points, "e long, trial_id long, y0 double, y1 double").repartition(7)
    got = {(r.e, r.trial_id) for r in trials.front(df, ["e"]).collect()}
    best = {}
    for e, t, a, b in sorted(points, key=lambda p: (p[0], -p[2], -p[3], p[1])):
        if b > best.get(e, -math.inf):
            best[e] = b
            best.setdefault("kept", set()).add((e, t))
    assert got == best["kept"]
    assert trials.front(df.limit(0), ["e"]).count() == 0


def inclusion(points, ref):
    """By inclusion and exclusion over all subsets."""
    total = 0.0
    for mask in range(1, 1 << len(points)):
        some = [p for i, p in enumerate(points) if mask >> i & 1]
        total -= (-1) ** len(some) * math.prod(max(0.0, min(c) - r) for c, r in zip(zip(*some, strict=True), ref, strict=True))
    return total


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_volumes(n):
    rng = random.Random(n)
    for _ in range(25):
        points = [tuple(float(rng.randrange(-1, 5)) for _ in range(n)) for _ in range(rng.randrange(9))]
        assert trials.volume(points, (0.0,) * n) == pytest.approx(inclusion(points, (0.0,) * n))


@pytest.mark.parametrize("n", [3, 4])
def test_volume_in_stretches(spark, n):
    rng = random.Random(n)
    dims, refs = [f"y{i}" for i in range(n)], [f"r{i}" for i in range(n)]
    points = [(e, t, *(rng.random() - 0.1 for _ in range(n))) for e in range(2) for t in range(150)]
    rows = spark.createDataFrame(points, "e long, trial_id long, " + ", ".join(f"{d} double" for d in dims))
    ref = spark.createDataFrame([(e, *[0.0] * n) for e in range(3)], "e long, " + ", ".join(f"{r} double" for r in refs))
    whole = {e: trials.volume([p[2:] for p in points if p[0] == e and min(p[2:]) > 0], (0.0,) * n) for e in range(2)} | {2: 0.0}
    for least in (5, 10**6):
        got = {r.e: r.hv for r in trials.hypervolume_of_many(rows, ref, ["e"], tuple(dims), parts=4, least=least).collect()}
        assert got == pytest.approx(whole)


@pytest.mark.parametrize("n", [2, 3])
def test_traces_in_ranges(spark, n):
    rng = random.Random(n)
    dims, refs = tuple(f"y{i}" for i in range(n)), [f"r{i}" for i in range(n)]
    points = [(e, t, *(float(rng.randrange(-2, 12)) for _ in range(n))) for e, k in ((0, 90), (1, 4), (2, 1)) for t in range(k)]
    rows = spark.createDataFrame(points, "e long, trial_id long, " + ", ".join(f"{d} double" for d in dims)).repartition(3)
    ref = spark.createDataFrame([(e, *[0.0] * n) for e in range(4)], "e long, " + ", ".join(f"{r} double" for r in refs))
    want = {(e, t): trials.volume([p[2:] for p in points if p[0] == e and p[1] <= t and min(p[2:]) > 0], (0.0,) * n) for e, t, *_ in points}
    for size in (10, 10**6):
        assert {(r.e, r.trial_id): r.hv for r in trials.hypervolume_trace(rows, ref, ["e"], dims, size=size).collect()} == pytest.approx(want)
    assert trials.hypervolume_trace(rows.limit(0), ref, ["e"], dims).count() == 0


def test_a_front_of_ten_thousand_points_takes_seconds():
    rng = random.Random(0)
    points = []
    for _ in range(10_000):  # on a sphere: none dominated
        x, y, z = (abs(rng.gauss(0, 1)) for _ in range(3))
        size = math.sqrt(x * x + y * y + z * z)
        points.append((x / size, y / size, z / size))
    begin = time.time()
    assert 0.5 < trials.volume(points, (0.0, 0.0, 0.0)) < math.pi / 6
    assert time.time() - begin < 5


def test_windows_beyond_any_array(spark):
    n = 3_000_000_000
    few = spark.createDataFrame([(3,), (3,), (70_000,), (n,)], "window_id long")
    found = hits.all_windows(few, 25.0)
    assert [tuple(r) for r in found.where("window_id BETWEEN 2 AND 4").limit(3).collect()] == [(2, 50.0, 0), (3, 75.0, 2), (4, 100.0, 0)]
    small = {r.window_id: r.n for r in hits.all_windows(few.where("window_id < 100000"), 25.0).collect()}
    assert sorted(small) == list(range(70_001)) and {w: k for w, k in small.items() if k} == {3: 2, 70_000: 1}
    assert hits.all_windows(few.limit(0), 25.0).count() == 0


def test_grids_of_several_planes(spark):
    planes = spark.createDataFrame([(1, 36.0, 1.0, 1.0), (2, 18.0, 1.0, 0.0)], "v long, size double, pad double, gap double")
    x = variants.raster(planes, 36, 1100)
    assert {(r["v"], r["count"]) for r in x.groupBy("v").count().collect()} == {(1, 36 * 1100), (2, 36 * 1100)}
    assert x.where("v = 2 AND NOT live").count() == 0 and x.where("v = 1 AND NOT live").count() > 0


def test_designs_of_any_dimension(spark):
    x = trials.design_points(spark, 13, 5)
    assert len(x.columns) == 14 and x.where("u12 >= 1 OR u12 <= 0").count() == 0
    assert x.where("id = 0").first().u12 == pytest.approx(1 / 41)


#: shuffles and sorted aggregations that a plan may have
SHAPES = {"a2_merge_hits": (4, 0), "s7_export_hits": (4, 0), "p1_decode_bits": (1, 0), "p11_pool": (6, 0), "w10_without_duplicates": (3, 0), "a27_front": (3, 0), "j16_stitch_candidates": (3, 0), "u1_union_of_detectors": (2, 0)}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_plans_keep_their_shape(spark, sf, name):
    import re

    from hitloom import plans

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    exchanges, sorted_ = (len(re.findall(rf"\b{k}\b", plan)) for k in ("Exchange", "SortAggregate"))
    assert exchanges <= SHAPES[name][0] and sorted_ <= SHAPES[name][1], plan
    assert "CartesianProduct" not in plan and "MapInPandas" not in plan or name == "w10_without_duplicates"

"""What larger tables than those of the other tests bring: numbers beyond a limit, steps that are read several times."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from hitloom import plans
from hitloom.plans import physics, stores, tracks, variants


def test_upsert_of_more_trials_than_the_number_has_room_for(spark, monkeypatch):
    t = spark.createDataFrame([(0, 100_000, "SUBMITTED"), (1, 0, "COMPLETED"), (1, 1, "SUBMITTED")], "experiment long, trial_id long, status string")
    monkeypatch.setattr(physics, "trial_table", lambda *_: t)
    got = sorted((r.trial_id, r.status) for r in plans.QUERIES["s13_upsert"](spark, "").collect())
    assert got == [(100_000, "COMPLETED"), (100_000, "FAILED"), (100_001, "FAILED")]


def test_design_points_of_high_indices(spark, monkeypatch):
    ids = [*range(4090, 4100), *range(19_680, 19_690), 1_000_000]
    t = spark.createDataFrame([(0, i) for i in ids], "experiment long, trial_id long")
    monkeypatch.setattr(stores, "trial_table", lambda *_: t)
    got = {(r.trial_id, r.u0, r.u1) for r in plans.QUERIES["x5_design_of_trials"](spark, "").collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE trials AS SELECT 0 AS experiment, unnest(?::BIGINT[]) AS trial_id", [ids])
    sql = "WITH d AS" + plans.ORACLES["x5_design_of_trials"].split(", d AS", 1)[1]
    assert got == {r[1:] for r in c.execute(sql).fetchall()}


def test_trials_share_the_grid_of_a_plane(spark, monkeypatch):
    t = spark.range(3000).select((F.col("id") % 7).alias("experiment"), F.expr("id div 7").alias("trial_id"), F.lit(12).alias("n_layers"), F.when(F.col("id") > 2, 15).alias("w_thickness"))
    monkeypatch.setattr(variants, "trial_table", lambda *_: t)
    made = []
    raster = variants.variants.raster
    monkeypatch.setattr(variants.variants, "raster", lambda *a: made.append(raster(*a)) or made[-1])
    got = plans.QUERIES["x6_raster"](spark, "")
    assert got.count() == got.select("experiment", "trial_id").distinct().count() == 3000 and got.where("n_samples <> 480").count() == 0
    assert {(r.experiment, r.n_live) for r in got.where("last_gx IS NULL").collect()} == {(0, 0), (1, 0), (2, 0)}
    assert made[0].count() == 4 * 480  # three pads, and trials 0 to 2 without a gap


@pytest.fixture(scope="module")
def busy():
    """Hits of two windows: stations of 750, 1,600 and 30 crossings, and pads on some of them."""
    rng = random.Random(4)
    rows = []
    for window, layer, n in ((1, 0, (30, 25)), (1, 1, (6, 5)), (2, 3, (40, 40))):
        for plane in (0, 1):
            for strip in rng.sample(range(1, 51), n[plane]):
                rows.append((window, "SiTarget", 2 + layer * 256 + plane * 1048576 + strip * 33554432, (strip - 25.5) * 0.8, (strip - 25.5) * 0.8, -1000 + layer * 20 + plane * 2.35, plane))
        rows += [(window, "SiPad", 1 + layer * 256 + i * 1048576 + j * 536870912, i * 5.5, j * 5.5, -200.0 + layer * 20, 0) for i in range(22, 29) for j in range(2, 9) if rng.random() < 0.4]
    return rows


@pytest.mark.parametrize("name", ["a11_votes", "a12_multiplicity", "a13_weighted_mode", "j10_drop_ghosts", "j13_near_peaks", "w7_peaks", "w8_suppressed"])
def test_stations_of_many_crossings_are_whole(spark, monkeypatch, busy, name):
    names = ("window_id", "detector", "cell_id", "x", "y", "z", "plane")
    hits = spark.createDataFrame(busy, "window_id long, detector string, cell_id long, x double, y double, z double, plane int").drop("plane")
    monkeypatch.setattr(tracks, "overlaid_hits", lambda *_: hits)
    monkeypatch.setattr(tracks.seeding, "STRIPS", 7, raising=False)  # so that stations take several blocks
    found = [r.asDict() for r in plans.QUERIES[name](spark, "").collect()]
    assert {r["window_id"] for r in found} == {1, 2}  # the second has but the largest station
    got = sorted(tuple(r[k] for k in sorted(r)) for r in found)
    c = duckdb.connect()
    c.execute("CREATE TABLE hits (" + ", ".join(f"{n} {t}" for n, t in zip(names, ("BIGINT", "VARCHAR", "BIGINT", "DOUBLE", "DOUBLE", "DOUBLE", "INT"), strict=True)) + ")")
    c.executemany("INSERT INTO hits VALUES (?, ?, ?, ?, ?, ?, ?)", busy)
    want = c.execute("WITH RECURSIVE numbered AS" + plans.ORACLES[name].split(", numbered AS", 1)[1]).df()
    want = sorted(tuple(r) for r in want[sorted(want.columns)].itertuples(index=False))
    assert got == want
    if name == "j10_drop_ghosts":
        n = {k: sum(1 for r in got if (r[1], r[0]) == k) for k in {(r[1], r[0]) for r in got}}
        kept = {k: 0 for k in n}
        at = lambda w, layer, plane, d="SiTarget": [h for h in busy if h[0] == w and h[1] == d and (d == "SiPad" or (h[2] >> 8 & 255, h[6]) == (layer, plane))]
        for w, layer in ((1, 0), (1, 1), (2, 3)):
            xs, ys, pads = {h[3] for h in at(w, layer, 0)}, {h[4] for h in at(w, layer, 1)}, [(h[3] - 137.5, h[4] - 27.5) for h in at(w, 0, 0, "SiPad")]
            sure = {(x, y) for x in xs for y in ys if any((x - a) ** 2 + (y - b) ** 2 <= 4 for a, b in pads)}
            fx, fy = {x for x, _ in sure}, {y for _, y in sure}
            kept[w, round((-1000 + layer * 20 + 1) / 10)] = sum((x, y) in sure or x not in fx or y not in fy for x in xs for y in ys)
        assert n == kept and sorted(kept.values())[-1] > 500 and sum(kept.values()) < 750 + 30 + 1600


@pytest.mark.parametrize("name", ["a11_votes", "a12_multiplicity", "a13_weighted_mode", "j10_drop_ghosts", "j13_near_peaks", "w7_peaks", "w8_suppressed"])
def test_seeding_reads_contributions_once(spark, sf, name):
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_tasks_stay_small_as_tables_grow(spark, sf, monkeypatch):
    import re

    from hitloom.sources import fixtures

    monkeypatch.setattr(fixtures, "ROWS_OF_A_TASK", 100, raising=False)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    found = plans.QUERIES["p4_to_mip"](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"Exchange hashpartitioning\([^\n]*, {n}\)", plan)) == 2 and found.rdd.getNumPartitions() == n
    monkeypatch.undo()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plans.QUERIES["p4_to_mip"](spark, sf).collect()))


@pytest.mark.parametrize("name", ["a15_window_layers", "p29_track_points"])
def test_layers_and_points_meet_in_small_tasks(spark, sf, monkeypatch, name):
    import re

    from hitloom.sources import fixtures

    want = sorted(map(str, plans.QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(fixtures, "ROWS_OF_A_TASK", 100)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    found = plans.QUERIES[name](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # with as many as the session has, only the last event of each source is found
    assert all(k.startswith("source_id#") for k in re.findall(r"Exchange hashpartitioning\(([^\n]*), 4\)", plan))
    assert len(re.findall(rf"Exchange hashpartitioning\([^\n]*, {n}\)", plan)) > 2
    assert sorted(map(str, found.collect())) == want

"""Reading, writing and small tables of sources."""

import json

import pytest
from pyspark.sql import functions as F

from hitloom.operators import trials, variants
from hitloom.plans.variants import baseline_map
from hitloom.sources import folders, io


def test_sources_are_joined_and_capped(spark, tmp_path):
    spark.createDataFrame([(0, 1.0), (5, 2.0)], "event_idx int, e double").write.parquet(str(tmp_path / "a"))
    x = io.read_source(spark, [str(tmp_path / "a")], 3, rename={"e": "energy"}, max_events=2)
    assert [r.asDict() for r in x.collect()] == [{"event_idx": 0, "energy": 1.0, "source_id": 3}]
    assert io.non_empty({3: x, 4: x.limit(0)}).count() == 1
    for bad in ({}, {4: x.limit(0)}):
        with pytest.raises(ValueError):
            io.non_empty(bad, "fail")


def test_windows_and_tracks_are_written(spark, tmp_path):
    h = spark.createDataFrame([(0, "SiPad", 1), (1, "SciFi", 2)], "window_id int, detector string, cell_id int")
    io.write_windows({"hits": h, "windows": h.select("window_id")}, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w/hits")).where("detector = 'SciFi'").count() == 1
    t = h.select("window_id")
    io.export_tracks({"ACTSTracks": (t, t), "Seq": (t, t)}, str(tmp_path / "t"))
    names = {p.name for p in (tmp_path / "t").iterdir()}
    assert names == {"ACTSTracks", "ACTSTrackStates", "Seq", "SeqStates"} and io.present_track_tables(names) == ["Seq"]
    assert io.present_track_tables({"ACTSTracks", "ACTSTrackStates"}) == ["ACTSTracks"]
    io.assert_same_windows(t, t)
    with pytest.raises(ValueError):
        io.assert_same_windows(t, t.limit(1))


def test_trial_folders(spark, tmp_path, monkeypatch):
    good, other = json.dumps({"nhits_sipad": 5.0}), json.dumps({"cost": 1.0})
    cases = {  # files, then status, error and metrics
        "t0": ({"DONE": "", "metrics.json": good}, ("COMPLETED", None, {"nhits_sipad": 5.0})),
        "t1": ({"FAILED": "from the payload\nmore"}, ("FAILED", "from the payload", None)),
        "t2": ({"metrics.json": good}, ("RUNNING", None, {"nhits_sipad": 5.0})),
        "t3": ({"FAILED": "x", "metrics.json": good}, ("COMPLETED", None, {"nhits_sipad": 5.0})),
        "t4": ({"DONE": "from the payload", "metrics.json": other}, ("FAILED", "metrics.json lacks nhits_sipad", {"cost": 1.0})),
        "t5": ({"DONE": "", "metrics.json": "{nhits"}, ("FAILED", "metrics.json cannot be read", None)),
        "t6": ({"DONE": ""}, ("FAILED", "ended without metrics.json or FAILED", None)),
        "t7": ({"DONE": "", "FAILED": ""}, ("FAILED", "failed without a message", None)),
        "t8": ({}, ("RUNNING", None, None)),
    }
    for name, (files, _) in cases.items():
        (tmp_path / name).mkdir()
        for f, text in {**files, "trial.json": json.dumps({"trial_id": int(name[1])})}.items():
            (tmp_path / name / f).write_text(text)
    out = {r.trial: (r.trial_id, r.status, r.error, r.metrics) for r in io.read_trials(spark, str(tmp_path)).collect()}
    assert out == {name: (int(name[1]), *want) for name, (_, want) in cases.items()}
    monkeypatch.setattr(io, "opens", lambda path: False)  # as for a store that only Spark reads
    assert {r.trial: (r.trial_id, r.status, r.error, r.metrics) for r in io.read_trials(spark, str(tmp_path)).collect()} == out
    every = folders.folder_files(spark, str(tmp_path), [], partitions=3)
    assert every.count() == sum(len(files) + 1 for files, _ in cases.values()) and every.rdd.getNumPartitions() == 3
    assert folders.opens("file:///tmp") and not folders.opens("nowhere://x/y")


def test_variants_results_and_histograms(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"base": {"a": 1.0}, "variants": [{"name": "x", "overrides": {"a": 2.0}}]}))
    assert io.read_variants(spark, str(tmp_path / "v.json")).first().overrides == {"a": 2.0}
    (tmp_path / "d.json").write_text(json.dumps({"detectors": {"SiPad": {"size": 5.5, "colour": "red"}, "MTC": {}}, "mc_labels": {"13": "muon"}}))
    config = {r.detector: (r.settings, r.mc_labels) for r in io.read_display_config(spark, str(tmp_path / "d.json")).collect()}
    assert config == {"SiPad": ({"size": "5.5", "colour": "red"}, {"13": "muon"}), "MTC": ({}, {"13": "muon"})}
    rows = "var_id int, name string, constants map<string,double>, nhits_SiPad int, status string"
    for batch, constants in ((0, {"b": 1.0, "a": 2.0}), (1, {"c": 3.0}), (1, {"c": 4.0})):  # the second one is written twice
        io.append_results(spark.createDataFrame([(batch, "x", constants, None, "FAILED")], rows), str(tmp_path / "r"), batch)
    back = io.read_results(spark, str(tmp_path / "r"), [0, 1])
    assert back.columns == ["var_id", "name", "a", "b", "c", "nhits_SiPad", "status"]
    assert sorted(tuple(r) for r in back.select("var_id", "a", "b", "c").collect()) == [("0", "2.0", "1.0", None), ("1", None, None, "4.0")]
    h = spark.createDataFrame([(0, 3), (1, 4)], "bin int, entries long")
    for _ in range(2):
        io.write_histograms({"h": (h, 0.0, 10.0, 5)}, str(tmp_path / "h"))
    found = spark.read.parquet(str(tmp_path / "h")).collect()
    assert len(found) == 2 and {(r.hist, r.lo, r.hi) for r in found} == {("h", 0.0, 2.0), ("h", 2.0, 4.0)}


def test_cost_of_the_baseline(spark):
    m = variants.analytic_metrics(baseline_map())
    r = spark.range(1).select(*[v.alias(k) for k, v in m.items()]).first()
    assert abs(r.cost_proxy - 1413.374) < 1e-3 and r.n_channels == 3889920 and abs(r.w_mass_kg - 1859.748) < 1e-6


def test_raster_and_occupancy(spark):
    x = variants.raster(spark.createDataFrame([(36.0, 1.0, 1.0)], "size double, pad double, gap double"), 40, 40)
    assert x.where("live").agg(F.countDistinct("gx", "gy")).first()[0] == 32 * 32
    assert {r.state for r in variants.occupancy(x, 36.0, 18).collect()} <= {"full", "partly", "dead"}


def test_buckets_save_shuffles_and_files(spark, tmp_path):
    from hitloom.operators import linking

    rows = [(w, s, h) for w in range(40) for s in range(3) for h in range(s, s + 3)]
    h = spark.createDataFrame(rows, "window_id long, segment_id long, hit_id long")
    io.write_bucketed({"bucketed_hits": h}, str(tmp_path), 8)
    own = io.co_located(spark)
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    stored = own.table("bucketed_hits")
    shared = linking.shared_hits(stored)
    assert "Exchange" not in shared._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in linking.shared_hits(h)._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in shared.collect()) == sorted(tuple(r) for r in linking.shared_hits(h).collect())
    one = stored.where("window_id = 5")
    assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 9


def test_metadata_is_set_and_merged(spark):
    meta = lambda *rows: spark.createDataFrame(rows, "key string, value string")
    changes = lambda *rows: spark.createDataFrame(rows, "key string, value string, at int")
    read = lambda df: {r.key: json.loads(r.value) for r in df.collect()}
    base = meta(("a", '{"x": 1, "y": {"z": [1, 2]}}'), ("b", "3"), ("c", "null"))
    new = changes(("a", '{"x": "2"}', 1), ("a", '{"w": null, "x": 2.5}', 2), ("b", '{"q": true}', 1), ("d", '"text"', 1), ("c", '{"m": 1}', 1), ("c", "[1]", 2))
    assert read(trials.set_meta(base, new, "at")) == {"a": {"w": None, "x": 2.5}, "b": {"q": True}, "c": [1], "d": "text"}
    merged = trials.set_meta(base, new, "at", merge=True)
    assert read(merged) == {"a": {"w": None, "x": 2.5, "y": {"z": [1, 2]}}, "b": {"q": True}, "c": [1], "d": "text"}
    assert {(r.key, r.value) for r in trials.get_meta(merged, "$.y.z[1]", "int").collect()} == {("a", 2), ("b", None), ("c", None), ("d", None)}
    assert read(trials.set_meta(base.limit(0), new.limit(0), "at", merge=True)) == {}
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING|INVALID_JSON"):
        trials.set_meta(base, changes(("a", "{", 1)), "at").collect()


def test_store_versions(spark, tmp_path):
    t = spark.createDataFrame([(2, "x"), (1, "y")], "trial_id int, status string")
    m = spark.createDataFrame([("k", "1")], "key string, value string")
    io.write_store(t, m, str(tmp_path), 0)
    io.write_store(t.limit(1).selectExpr("*", "1 AS more"), m.limit(0), str(tmp_path), 1)
    stored, meta = io.read_store(spark, str(tmp_path))
    assert stored.count() == 1 and meta.count() == 0

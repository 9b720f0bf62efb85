"""Reading and writing the library's tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.sources.folders import folder_files, opens


def read_source(spark: SparkSession, paths: list[str], source_id: int, rename: dict[str, str] | None = None, schema: str | None = None, max_events: int | None = None) -> DataFrame:
    """Landed Parquet files of one source, with its id; columns renamed, events capped."""
    reader = spark.read.schema(schema) if schema else spark.read
    x = reader.parquet(*paths).withColumnsRenamed(rename or {}).withColumn("source_id", F.lit(source_id))
    return x if max_events is None else x.where(F.col("event_idx") < max_events)


def read_registered(spark: SparkSession, registry: DataFrame, table: str) -> DataFrame:
    """One table of every source of a registry with paths, each read under the source's own name for it."""
    found = {}
    for r in registry.collect():  # as many rows as sources
        name = (r["tables"] if "tables" in registry.columns else {}).get(table, table)
        found[r.source_id] = read_source(spark, [f"{r.path}/{name}"], r.source_id, max_events=r.max_events)
    return non_empty(found)


def non_empty(sources: dict[int, DataFrame], on_empty: str = "skip") -> DataFrame:
    """All sources as one table. One without rows is an error ("fail") or left out with a warning ("skip")."""
    if on_empty not in ("fail", "skip"):
        raise ValueError(f"on_empty {on_empty!r} is neither 'fail' nor 'skip'")
    if not sources:
        raise ValueError("no sources")
    kept = []
    for source_id, df in sources.items():
        if not df.isEmpty():
            kept.append(df)
        elif on_empty == "fail":
            raise ValueError(f"source {source_id} has no events")
        else:
            warnings.warn(f"source {source_id} has no events and is left out", stacklevel=2)
    out = kept[0] if kept else next(iter(sources.values()))
    for df in kept[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def parallel_mismatch(hits: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose parallel list isn't as long as their contributions: keys, n_hits, n_values."""
    a = hits.groupBy(*keys).agg(F.sum("n").alias("n_hits"))
    b = values.groupBy(*keys).agg(F.count("*").alias("n_values"))
    return a.join(b, keys, "left").select(*keys, "n_hits", F.coalesce("n_values", F.lit(0)).alias("n_values")).where("n_hits <> n_values")


def write_windows(tables: dict[str, DataFrame], path: str) -> None:
    """One folder a table; those with a detector are partitioned by it, rows of a window together."""
    for name, df in tables.items():
        writer = df.repartition("window_id").write.mode("overwrite")
        (writer.partitionBy("detector") if "detector" in df.columns else writer).parquet(f"{path}/{name}")


def write_bucketed(tables: dict[str, DataFrame], path: str, buckets: int) -> None:
    """Tables of the catalog, their files in a folder each: rows of a window in one of `buckets` buckets, sorted by window.

    What is then joined or grouped by window and more needs no shuffle (in a co_located()
    session), and a read of one window opens one bucket. Every table needs the same number.
    """
    for name, df in tables.items():
        dealt = df.repartition(buckets, "window_id")  # one file a bucket
        dealt.write.mode("overwrite").bucketBy(buckets, "window_id").sortBy("window_id").option("path", f"{path}/{name}").saveAsTable(name)


def co_located(spark: SparkSession) -> SparkSession:
    """A session in which joins on the window and further keys use the buckets of the window alone."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # also where only one bucket is read
    return own


def write_store(trials: DataFrame, meta: DataFrame, root: str, version: int) -> None:
    """A version of a store: its trials and its metadata (key, value as JSON). It counts once its number is written, last; readers of others are not disturbed."""
    for name, df in (("trials", trials), ("meta", meta)):
        df.write.mode("overwrite").parquet(f"{root}/{name}/version={version}")
    trials.sparkSession.range(version, version + 1).write.mode("overwrite").parquet(f"{root}/versions/version={version}")


def read_store(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Trials in order of their ids and metadata of the latest version."""
    last = F.broadcast(spark.read.parquet(f"{root}/versions").agg(F.max("version").alias("version")))  # one row
    trials, meta = (spark.read.option("mergeSchema", True).parquet(f"{root}/{name}").join(last, "version", "left_semi").drop("version") for name in ("trials", "meta"))
    return trials.orderBy("trial_id"), meta


def export_tracks(collections: dict[str, tuple[DataFrame, DataFrame]], path: str) -> None:
    """Tracks and states of each collection as <name> and <name>States (ACTSTracks: ACTSTrackStates)."""
    for name, (tracks, states) in collections.items():
        tracks.write.mode("overwrite").parquet(f"{path}/{name}")
        states.write.mode("overwrite").parquet(f"{path}/{state_table(name)}")


def state_table(name: str) -> str:
    return "ACTSTrackStates" if name == "ACTSTracks" else f"{name}States"


def present_track_tables(names: set[str]) -> list[str]:
    """Track tables that have their states; sequential ones win over the legacy one."""
    found = sorted(n for n in names if state_table(n) in names)
    return [n for n in found if n != "ACTSTracks"] or found


def assert_same_windows(a: DataFrame, b: DataFrame) -> None:
    na, nb = (x.agg(F.countDistinct("window_id")).first()[0] for x in (a, b))
    if na != nb:
        raise ValueError(f"{na} windows of tracks and {nb} of hits")


def _files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """folder, name, text of trial files, empty ones too: read by tasks, or where those cannot open the path (a store that only Spark reads) by Spark, which needs the driver's list of empty ones."""
    if opens(root):
        return folder_files(spark, root, names)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{{{','.join(names)}}}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    empty = [(s.getPath().getParent().getName(), s.getPath().getName(), "") for s in found if s.getLen() == 0]
    read = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{','.join(names)}}}").option("recursiveFileLookup", True).load(root)
    parts = F.split("path", "/")
    read = read.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.col("content").cast("string").alias("text"))
    return read.unionByName(spark.createDataFrame(empty, "folder string, name string, text string"))


def read_trials(spark: SparkSession, root: str) -> DataFrame:
    """Trial folders: the columns of trial.json with trial (the folder), status, metrics and error.

    Without DONE or FAILED (also empty ones count; DONE is looked at first) a trial is
    RUNNING, whatever else there is. With one, readable metrics decide: COMPLETED if they
    have nhits_sipad, else FAILED; without metrics it is FAILED with FAILED's first line.
    """
    trial = spark.read.option("multiLine", True).option("pathGlobFilter", "trial.json").option("recursiveFileLookup", True).json(root)
    trial = trial.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("trial"))
    text = F.trim("text")
    line = F.nullif(F.substring(F.element_at(F.split(text, "\n"), 1), 1, 500), F.lit(""))
    of = lambda name, value: F.max(F.when(F.col("name") == name, value))
    marks = _files(spark, root, ["metrics.json", "DONE", "FAILED"]).groupBy(F.col("folder").alias("trial")).agg(
        F.bool_or(F.col("name") != "metrics.json").alias("_ended"), F.bool_or(F.col("name") == "FAILED").alias("_failed"),
        of("FAILED", line).alias("_line"), of("metrics.json", text).alias("_metrics"),
    )
    x = trial.join(marks, "trial", "left").withColumn("metrics", F.from_json("_metrics", "map<string,double>"))
    complete = F.coalesce(F.map_contains_key("metrics", F.lit("nhits_sipad")), F.lit(False))
    ended, written = F.coalesce("_ended", F.lit(False)), F.col("_metrics").isNotNull()
    error = (
        F.when(~ended | complete, F.lit(None))
        .when(written & F.col("metrics").isNull(), "metrics.json cannot be read")
        .when(written, "metrics.json lacks nhits_sipad")
        .when(F.col("_failed"), F.coalesce("_line", F.lit("failed without a message")))
        .otherwise("ended without metrics.json or FAILED")
    )
    status = F.when(~ended, "RUNNING").when(complete, "COMPLETED").otherwise("FAILED")
    return x.withColumn("status", status).withColumn("error", error).drop("_ended", "_failed", "_line", "_metrics")


FIRST, LAST = ("var_id", "name"), ("nhits_SiPad", "status")


def append_results(rows: DataFrame, path: str, batch: int) -> None:
    """A batch of results as CSV with its own header. rows: var_id, name, constants (map), nhits_SiPad, status.

    A batch that is written again replaces itself. The keys of constants, few by nature,
    are found with one aggregate.
    """
    keys = [r.k for r in rows.select(F.explode(F.map_keys("constants")).alias("k")).distinct().orderBy("k").collect()]
    wide = rows.select(*FIRST, *[F.col("constants")[k].alias(k) for k in keys], *LAST)
    wide.write.mode("overwrite").option("header", True).csv(f"{path}/batch={batch}")


def read_results(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    """All batches by column name: the header has every batch's constants in order, blanks are null."""
    parts = [spark.read.option("header", True).csv(f"{path}/batch={b}") for b in batches]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(*FIRST, *sorted(set(out.columns) - {*FIRST, *LAST}), *LAST)


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of base constants and variants with overrides: name, base, overrides (maps)."""
    maps = "base map<string,double>, variants array<struct<name:string,overrides:map<string,double>>>"
    x = spark.read.schema(maps).option("multiLine", True).json(path)
    return x.select("base", F.explode("variants").alias("v")).select("v.name", "base", "v.overrides")


def read_display_config(spark: SparkSession, path: str) -> DataFrame:
    """A nested display config, one row a detector: detector, then what its object holds as a map, and labels by |pdg|."""
    schema = "detectors map<string,map<string,string>>, mc_labels map<string,string>"
    x = spark.read.schema(schema).option("multiLine", True).json(path)
    return x.select(F.explode("detectors").alias("detector", "settings"), F.coalesce("mc_labels", F.expr("CAST(map() AS MAP<STRING,STRING>)")).alias("mc_labels"))


def write_histograms(histograms: dict[str, tuple[DataFrame, float, float, int]], path: str) -> None:
    """bin and entries of each histogram, one folder each: read together hist, bin, lo, hi, entries. Written again, it replaces itself."""
    for name, (h, lo, hi, n) in histograms.items():
        step = (hi - lo) / n
        x = h.select("bin", (lo + F.col("bin") * step).alias("lo"), (lo + (F.col("bin") + 1) * step).alias("hi"), "entries")
        x.write.mode("overwrite").parquet(f"{path}/hist={name}")


def wide_trials(trials: DataFrame, keys: list[str]) -> DataFrame:
    """One column for every key of the maps params and metrics, in order; a metric named like a param is <name>_metric.

    The keys, few by nature, are found with one aggregate.
    """
    found = trials.select(F.explode(F.array(F.struct(F.lit("p").alias("m"), F.map_keys("params").alias("k")), F.struct(F.lit("q").alias("m"), F.map_keys("metrics").alias("k")))).alias("s")).select("s.m", F.explode("s.k").alias("k")).distinct().collect()
    params, metrics = (sorted(r.k for r in found if r.m == m) for m in "pq")
    return trials.select(*keys, *[F.col("params")[k].alias(k) for k in params], *[F.col("metrics")[k].alias(f"{k}_metric" if k in params else k) for k in metrics])

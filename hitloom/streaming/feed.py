"""A feed of trials: state of the newest row of each, and a log of what changed it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hitloom.operators import trials

KEY = ("experiment", "trial_id")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def trial_feed(stream: DataFrame, log: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Starts a query that keeps each trial's newest row (by `order`, nulls first) in state and appends each change, with its batch as version, to a log.

    stream: experiment, trial_id, the columns `order` and any others that can be compared.
    Of rows alike in `order` the larger one counts, so that the order of arrival doesn't
    matter; of equal rows the earlier, whose batch's time stays with it: a row that has
    the time of the batch itself is a change. A batch becomes visible as a whole, so the
    log can be read at any time; a batch or a row that comes again changes nothing, as do
    rows older than the newest. Work and output of a batch grow with the trials in it, not
    with the store; state lies in RocksDB.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    since = -F.unix_micros(F.current_timestamp())  # one time a batch
    rest = [c for c in stream.columns if c not in order and c not in KEY]
    best = stream.withColumn("_since", since).groupBy(*KEY).agg(F.max(F.struct(*order, *rest, "_since")).alias("s"))
    changes = best.where(F.col("s._since") == since).select(*KEY, "s.*").select(*stream.columns)

    def publish(batch: DataFrame, number: int) -> None:
        """A batch is written aside and then put in place; one that is there was written before."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        aside, place = path(f"{log}/_batch={number}"), path(f"{log}/batch={number}")
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(place):
            batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(aside.toString())
            if not fs.rename(aside, place):
                raise OSError(f"{aside.toString()} cannot be put in place")

    writer = changes.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    spark.conf.set(PROVIDER, ROCKS)  # a query keeps the settings that it starts with
    try:
        return writer.outputMode("update").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def newest(spark: SparkSession, log: str) -> DataFrame:
    """The newest row of every trial in a log."""
    stored = spark.read.parquet(log).drop("batch")
    columns = [c for c in stored.columns if c not in KEY]
    latest = stored.groupBy(*KEY).agg(F.max_by(F.struct(*columns), "version").alias("s"))
    return latest.select(*KEY, "s.*").drop("version")


def progress(spark: SparkSession, log: str, objectives: list[trials.Objective]) -> tuple[DataFrame, DataFrame]:
    """Status counts of each experiment, and the front of its completed trials, as of the batches that have ended."""
    now = newest(spark, log)
    return trials.status_counts(now, ["experiment"]), trials.front(trials.objective_rows(now, objectives), ["experiment"])

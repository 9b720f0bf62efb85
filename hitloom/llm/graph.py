"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import discard, materialize

SALTS = 64


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component (its smallest node), for all nodes of edges.

    Labels sink to the smallest of the neighbours' and then jump to their own label's
    label, round by round, each written to the shared folder. The jump is looked up once a
    label and salt, so that nodes of a giant component are dealt to SALTS tasks. Only a
    count per round reaches the driver.
    """
    e = edges.where("a <> b")
    e = materialize(e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    label = materialize(e.groupBy("u").agg(F.least("u", F.min("v")).alias("l")), "labels")
    while True:
        near = e.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("near"))
        sunk = label.join(near, "u").select("u", F.col("l").alias("before"), F.least("l", "near").alias("l"))
        sunk = sunk.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)))
        to = sunk.select("l", "salt").distinct().join(label.select(F.col("u").alias("l"), F.col("l").alias("further")), "l")
        last, label = label, materialize(sunk.join(to, ["l", "salt"], "left").select("u", "before", F.least("l", F.coalesce("further", "l")).alias("l")), "labels")
        discard(last)
        if label.where("l < before").limit(1).count() == 0:
            discard(e)
            return label.select(F.col("u").alias("node"), F.col("l").alias("component"))

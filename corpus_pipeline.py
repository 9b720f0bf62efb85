"""A corpus pipeline of five stages over documents.

Each stage takes all that its predecessor kept, as (spark, docs, sf_dir), and returns a
DataFrame that is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm import mixing, near_dedup, pieces, secrets, token_counts, toxicity
from hitloom.llm.common import materialize, remove, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay."""
    return toxicity.without_toxic(docs, toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of sets of five-word runs similar by 0.8 or more stays: the smallest id."""
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    gone = found.where("NOT kept").select("doc_id").distinct().alias("g")
    return docs.alias("d").join(gone, F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced in the text, n_chars follows; all documents stay."""
    masked = secrets.masked(docs, secrets.fit(docs.select("doc_id", "text")))
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every repetition of a document in the mix; those with none go. Rows that share an id share its smallest source and size."""
    sized = materialize(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")).groupBy("doc_id").agg(F.min(F.struct("source", "size")).alias("s")).select("doc_id", "s.*"), "mix-sizes")
    repeats = mixing.mix(sized).where("repeats > 0").select("doc_id", "repeats").alias("r")
    chosen = docs.alias("d").join(repeats, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")))
    own = "_" * (1 + max(map(len, docs.columns)))  # no column has this name
    return chosen.select("d.*", F.explode(F.sequence(F.lit(1), F.col("r.repeats"))).alias(own)).drop(own)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row."""
    encoded = pieces.encode(docs, token_counts.public_path(pieces.MODEL))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "exact")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: a trained model and MinHash take part, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder; a stage's table goes once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs

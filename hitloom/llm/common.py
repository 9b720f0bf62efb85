"""Helpers shared by the corpus operators: reading tables and cutting lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.sources.shared import cut as materialize
from hitloom.sources.shared import discard, remove, shared_dir

__all__ = ["WORD", "discard", "materialize", "needed", "on_salted", "pieces", "remove", "salted", "shared_dir", "sole_cache", "table", "text_batches", "text_size"]

#: What counts as a word everywhere in this package: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_kept: dict[str, Callable[[], None]] = {}


def sole_cache(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Empties what other operators have kept in this Python worker, which tasks share. Each operator's functions call it first."""
    for other in [k for k in _kept if k != name]:
        _kept.pop(other)()
    _kept[name] = clear


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pd.DataFrame], column: str, most: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """Cut batches so that no piece holds much more than `most` characters of a text column."""
    for pdf in batches:
        sizes = pdf[column].map(lambda t: len(t) if t is not None else 0).to_numpy()
        begin, total = 0, 0
        for i, n in enumerate(sizes):
            if total + n > most and i > begin:
                yield pdf.iloc[begin:i]
                begin, total = i, 0
            total += n
        if len(pdf) > begin:
            yield pdf.iloc[begin:]


def text_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Like pieces(), for Arrow: slices of batches with the texts of a column, "" for null. Ids stay as Arrow has them."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        begin, total = 0, 0
        for i, t in enumerate(texts):
            if total + len(t) > most and i > begin:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, total = i, 0
            total += len(t)
        if len(texts) > begin:
            yield batch.slice(begin), texts[begin:]


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: rows that a broadcast of needed() can have at most
NEEDED = 1 << 20


def needed(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose doc_id is in ids (one column, doc_id).

    First by the ids' hash in NEEDED buckets, a broadcast of at most that many rows, so
    that most texts which aren't needed stay out of the shuffle; then exactly.
    """
    bucket = F.pmod(F.xxhash64(F.lit("needed"), F.col("doc_id").cast("long")), F.lit(NEEDED)).cast("int")
    wanted = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    some = df.withColumn("_bucket", bucket).join(F.broadcast(wanted.select(bucket.alias("_bucket")).distinct()), "_bucket", "left_semi").drop("_bucket")
    return some.join(wanted, "doc_id", "left_semi")


SALTS = 32


def salted(rows: DataFrame, keys: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with a small table of one row a key, each key dealt to SALTS tasks by a hash of column `by`."""
    part = "_part" + on
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    every = keys.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(every, [on, part], how).drop(part)


HEAVY = 1024


def on_salted(rows: DataFrame, keys: DataFrame, on: list[str], total: int, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """rows joined with keys (one row a key, with n, how many of `total` rows have it), heavy keys in SALTS parts by a hash of columns `by`.

    Keys with more than a HEAVY-th of all rows are heavy: fewer than HEAVY of them, which
    are broadcast. Rows without a key, which an outer join keeps, are dealt like heavy ones.
    """
    limit = total // HEAVY
    salts = F.explode(F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    heavy = F.broadcast(keys.where(F.col("n") > limit).select(*on, F.lit(True).alias("_heavy")))
    apart = F.col("_heavy") | F.greatest(*[F.col(c).isNull() for c in on], F.lit(False))
    dealt = rows.join(heavy, on, "left").withColumn("_salt", F.when(apart, F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0).cast("int"))
    return dealt.drop("_heavy").join(keys.withColumn("_salt", salts).drop("n"), [*on, "_salt"], how).drop("_salt")

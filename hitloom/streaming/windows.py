"""The time stream as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.operators.hits import common_source


def windowed_hits(stream: DataFrame, width: str, delay: str, time: str = "ts", order: str = "seq") -> DataFrame:
    """Hits of each window and cell, in append mode; rows later than the watermark go.

    stream: time, source_id, cell_id, energy, and order, pdg, hit_x, hit_y, hit_z where it
    has them. Energy, count and source; of the first contribution time and position; the
    dominant particle (the earlier in a tie). Empty windows are not emitted.
    """
    kept = stream.withWatermark(time, delay)
    found = [F.sum("energy").alias("e"), F.count("*").alias("n"), common_source().alias("source_id")]
    if order in stream.columns:
        first = F.struct(time, order)
        found.append(F.min_by(time, first).alias("t"))
        found += [F.min_by(c, first).alias(c[-1]) for c in ("hit_x", "hit_y", "hit_z") if c in stream.columns]
        if "pdg" in stream.columns:
            found.append(F.max_by("pdg", F.struct(F.col("energy").alias("a"), (-F.unix_micros(time)).alias("b"), (-F.col(order)).alias("c"))).alias("origin_pdg"))
    out = kept.groupBy(F.window(time, width), "cell_id").agg(*found)
    return out.select(F.col("window.start").alias("t_window_start"), *[c for c in out.columns if c != "window"])

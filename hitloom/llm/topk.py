"""Exact top-k by inner product, a block at a time.

Rows are ordered by their LEADING largest components (place and sign), then by id, and
cut in that order into blocks that keep a forward index (the matrix of their components,
the terms) and each term's largest and smallest value; alike rows thus share blocks. A
query starts with the k-th best score that it has in a sample of SEEDS rows, a lower
bound of its final one. The blocks of a pack are ordered by their bound, the sum over
terms of the larger of q * max and q * min; they are scored from the best bound down
until a bound falls below the query's k-th score. Every pack meets every pack of
queries, so the result is exact; a row leaves a pack only if it is among that pack's k
best. How many blocks are left out depends on the data: most where vectors are clustered
or sparse, none where they are spread evenly over all directions.

Components are floor(1024 * x) with x as a double. Vectors that are null or hold null
or non-finite components, and rows without an id, take no part. Vectors of other
lengths are filled up with zeros. vec_id names a row: rows that share the query's own
vec_id are not its candidates, and of several query rows with one vec_id the smallest
vector is asked; of candidates that share one each row counts. Ties go to the smaller
vec_id. No rows in, no rows out. Scores that could leave 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 128
PACK = 8192
QUERIES = 512
SEEDS = 8192
LEADING = 3
PACKED = "pack long, dim int, ids binary, rows binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of long) of the rows that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(
        F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))), F.lit(False)
    )
    return vectors.where(fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * 1024).cast("long")).alias("v")
    )


def _matrix(vs: list) -> np.ndarray:
    dim = max((len(v) for v in vs), default=0)
    m = np.zeros((len(vs), dim), np.int64)
    for i, v in enumerate(vs):
        m[i, : len(v)] = v
    return m


def same_width(*ms: np.ndarray) -> list[np.ndarray]:
    dim = max(m.shape[1] for m in ms)
    return [np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in ms]


def packer(most: int):
    """Rows of a partition, already in order of vec_id, to packs of `most` rows."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        vs: list = []

        def out() -> pd.DataFrame:
            m = _matrix(vs)
            return pd.DataFrame({"pack": [ids[0]], "dim": [m.shape[1]], "ids": [np.array(ids, np.int64).tobytes()], "rows": [m.tobytes()]})

        for pdf in batches:
            for i, v in zip(pdf["vec_id"], pdf["v"], strict=True):
                ids.append(i)
                vs.append(v)
                if len(ids) == most:
                    yield out()
                    ids, vs = [], []
        if ids:
            yield out()

    return pack


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """q @ m.T in whole numbers; through float64 where every sum is exact in it."""
    if not q.size or not m.size:
        return np.zeros((len(q), len(m)), np.int64)
    most = float(np.abs(q.astype(float)).max()) * float(np.abs(m.astype(float)).max()) * q.shape[1]
    if most < 2**52:
        return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    if most > 2**62:
        raise OverflowError("inner products may not fit in 64 bits")
    return q @ m.T


def leading(v: Column) -> Column:
    """Places and signs of a vector's largest components, the largest first."""
    by_size = F.array_sort(F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("size"), i.alias("i"), (x < 0).alias("down"))))
    return F.transform(F.slice(by_size, 1, LEADING), lambda x: x["i"] * 2 + x["down"].cast("int"))


def seeded(q: np.ndarray, q_ids: np.ndarray, m: np.ndarray, m_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among some rows, a lower bound of that among all."""
    s = products(q, m).astype(np.float64)
    s[q_ids[:, None] == m_ids[None, :]] = -np.inf
    return np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)


def best(
    q: np.ndarray, q_ids: np.ndarray, m: np.ndarray, m_ids: np.ndarray, k: int, kth: np.ndarray | None = None, block: int = BLOCK
) -> tuple[list[tuple[int, int, int]], int]:
    """(query, id, score) of each query's k best rows of m that reach kth, and how many blocks were scored for how many queries."""
    starts = range(0, len(m), block)
    high = np.stack([m[s : s + block].max(axis=0) for s in starts]).astype(np.float64)
    low = np.stack([m[s : s + block].min(axis=0) for s in starts]).astype(np.float64)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    bound = up @ high.T + down @ low.T
    bound += np.abs(bound) * 1e-12 + 1e-6  # floating sums may fall a little short
    order = np.argsort(-bound, axis=1, kind="stable")
    scores = [np.empty(0, np.int64)] * len(q)
    found = [np.empty(0, np.int64)] * len(q)
    kth = np.full(len(q), -np.inf) if kth is None else kth.astype(np.float64)
    open_, scored = np.ones(len(q), bool), 0
    for t in range(len(starts)):
        open_ &= bound[np.arange(len(q)), order[:, t]] >= kth
        if not open_.any():
            break
        for b in np.unique(order[open_, t]):
            asked = np.flatnonzero(open_ & (order[:, t] == b))
            scored += len(asked)
            ids = m_ids[b * block : (b + 1) * block]
            s = products(q[asked], m[b * block : (b + 1) * block])
            for row, i in zip(s, asked, strict=True):
                keep = (row >= kth[i]) & (ids != q_ids[i])
                a, c = np.concatenate([scores[i], row[keep]]), np.concatenate([found[i], ids[keep]])
                top = np.lexsort((c, -a))[:k]
                scores[i], found[i] = a[top], c[top]
                if len(top) == k:
                    kth[i] = max(kth[i], a[top[-1]])
    return [(int(q_ids[i]), int(c), int(a)) for i in range(len(q)) for a, c in zip(scores[i], found[i], strict=True)], scored


def scorer(k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q_ids, m_ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q, m = same_width(np.frombuffer(r.q_rows, np.int64).reshape(len(q_ids), r.q_dim), np.frombuffer(r.rows, np.int64).reshape(len(m_ids), r.dim))
                yield pd.DataFrame(best(q, q_ids, m, m_ids, k, np.frombuffer(r.kth))[0], columns=["query_id", "vec_id", "score"])

    return score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors, queries: vec_id, embedding. Returns query_id, rank, vec_id, score."""
    n = vectors.count()
    packs_wanted = max(1, -(-n // PACK))
    fine = quantised(vectors)
    rows = fine.withColumn("lead", leading(F.col("v"))).repartitionByRange(packs_wanted, "lead", "vec_id").sortWithinPartitions("lead", "vec_id", "v").select("vec_id", "v")
    packs = rows.mapInPandas(packer(PACK), PACKED)
    asked = quantised(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    lots = asked.repartitionByRange(max(1, -(-n // (100 * QUERIES))), "vec_id").sortWithinPartitions("vec_id").mapInPandas(packer(QUERIES), PACKED)
    # at most SEEDS rows
    some = fine.orderBy(F.xxhash64(F.lit("seed"), "vec_id"), "vec_id", "v").limit(SEEDS).toPandas()
    seeds = vectors.sparkSession.sparkContext.broadcast((some["vec_id"].to_numpy(np.int64), _matrix(list(some["v"]))))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m_ids, m = seeds.value
        for pdf in batches:
            kth = []
            for r in pdf.itertuples(index=False):
                q_ids = np.frombuffer(r.ids, np.int64)
                q, rows = same_width(np.frombuffer(r.rows, np.int64).reshape(len(q_ids), r.dim), m)
                kth.append(seeded(q, q_ids, rows, m_ids, k).tobytes())
            yield pdf.assign(kth=kth)

    lots = lots.mapInPandas(start, PACKED + ", kth binary")
    # the stated queries, a lot at a time, to every lane of packs
    lanes = min(packs_wanted, 4096)
    lots = lots.select(F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("dim").alias("q_dim"), "kth", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    pairs = packs.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int")).join(lots, "lane")
    local = pairs.select("q_ids", "q_rows", "q_dim", "kth", "ids", "rows", "dim").mapInPandas(scorer(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

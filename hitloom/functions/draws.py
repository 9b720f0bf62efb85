"""Random draws that depend on a row's keys alone, so on no partitioning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str) -> Column:
    """In the open interval from 0 to 1."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12).cast("double") + 0.5) / F.lit(float(2**52))


def normal(seed: int, *keys: str) -> Column:
    radius = F.sqrt(-2 * F.log(uniform(seed, *keys)))
    return radius * F.cos(2 * math.pi * uniform(seed + 7919, *keys))


#: the largest mean that is drawn by inversion
PART = 100.0


def _small(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Smallest k whose probability reaches u; means of PART at most."""
    k, term = np.zeros(len(mean)), np.exp(-mean)
    total, step = term.copy(), 0
    open_ = total < u
    while open_.any():
        step += 1
        k[open_] = step
        term = term * mean / step
        total = total + np.where(open_, term, 0)
        # beyond the mean the terms fall: those too small to count end a row whose u lies at 1
        open_ = open_ & (total < u) & ((step < mean) | (term > 1e-300))
    return k


def poisson_inverse(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Poisson count for each mean and uniform number: up to PART the inverse of its distribution.

    A larger mean is drawn by rejection, from a generator whose key is the row's number
    u, in a few steps whatever the mean. Means that are negative or missing count as 0,
    those above 2^62 as 2^62.
    """
    mean = np.minimum(np.maximum(np.nan_to_num(mean), 0), 2.0**62)
    out = np.zeros(len(mean))
    small = mean <= PART
    out[small] = _small(mean[small], u[small])
    keys = (u * 2.0**53).astype(np.uint64)
    for i in np.flatnonzero(~small):
        out[i] = np.random.Generator(np.random.Philox(key=int(keys[i]))).poisson(mean[i])
    return out


def poisson(mean: Column, u: Column) -> Column:
    @F.pandas_udf("double")
    def draw(mean: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(poisson_inverse(mean.to_numpy(float), u.to_numpy(float)))

    return draw(mean, u)

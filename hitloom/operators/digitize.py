"""Energies to digits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_mip(hits: DataFrame, mip: float | dict[str, float], energy: str = "e") -> DataFrame:
    """Energy in units of a minimum-ionising particle, by detector if a dict is given."""
    if isinstance(mip, dict):
        unit = F.create_map(*[F.lit(x) for k, v in mip.items() for x in (k, 1 / v)])[F.col("detector")]
    else:
        unit = F.lit(1 / mip)
    return hits.withColumn("mip", F.col(energy) * unit)


def threshold(hits: DataFrame, least: float, col: str = "mip") -> DataFrame:
    """Strictly above."""
    return hits.where(F.col(col) > least)


@dataclass(frozen=True)
class SciFi:
    """Fibre and photon-sensor constants; lengths in mm."""

    attenuation: float = 3000.0
    offset: float = 20.0
    photons: float = 1.6e5
    reflection: float = 0.9
    pixels: int = 104
    least_photons: float = 3.5
    gain: tuple[float, float] = (0.172, 0.006)
    pedestal: tuple[float, float] = (-1.31, 0.33)
    angle: float = 5.0
    side: int = 1
    half_heights: tuple[float, ...] = (200.0, 250.0, 300.0)


def scifi(hits: DataFrame, c: SciFi = SciFi(), mode: str = "expected", seed: int = 42) -> DataFrame:
    """hits: station, plane, x, y, e. Keeps fibre planes of known stations that fire enough.

    expected: means in place of draws. sampled: draws from per-row hashes of the cell and
    window, the same under any partitioning; Poisson by its inverse in a pandas UDF.
    """
    known = hits.where((F.col("plane") < 2) & F.col("station").between(0, len(c.half_heights) - 1))
    half = F.array(*[F.lit(h) for h in c.half_heights])[F.col("station").cast("int")]
    tilt = math.radians(c.angle)
    length = 2 * half / math.cos(tilt)
    # from the hit to the sensor's end of its fibre
    distance = F.sqrt(F.pow(half * math.tan(tilt), 2) + F.pow(F.col("y") - c.side * half, 2))
    yield_ = F.col("e") * c.photons * (F.exp(-(distance - c.offset) / c.attenuation) + c.reflection * F.exp(-((length - distance) - c.offset) / c.attenuation))
    lit = known.withColumn("light", yield_)
    if mode == "sampled":
        from hitloom.functions.draws import normal, poisson, uniform

        keys = ("window_id", "cell_id")
        lit = lit.withColumn("photons", poisson(F.col("light"), uniform(seed, *keys)))
        a = c.gain[0] + c.gain[1] * normal(seed + 1, *keys)
        b = c.pedestal[0] + c.pedestal[1] * normal(seed + 2, *keys)
    elif mode == "expected":
        lit = lit.withColumn("photons", F.col("light"))
        a, b = F.lit(c.gain[0]), F.lit(c.pedestal[0])
    else:
        raise ValueError(f"mode {mode!r} is neither 'expected' nor 'sampled'")
    fired = lit.where(F.col("photons") >= int(c.least_photons)).withColumn("n_fired", c.pixels * (1 - F.exp(-F.col("photons") / c.pixels)))
    return fired.withColumn("signal", a * F.col("n_fired") + b)

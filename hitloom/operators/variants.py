"""Geometry variants: metrics by arithmetic, feasibility, coverage of a plane."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.operators.measurements import wafer


@dataclass(frozen=True)
class Prices:
    """Thousands of euros a square metre of silicon and a kilogram of tungsten; density in g/cm3."""

    silicon: float = 30.0
    tungsten: float = 0.1
    density: float = 19.3


def analytic_metrics(constants: Column, prices: Prices = Prices()) -> dict[str, Column]:
    """Areas in m2, masses in kg, channels and cost of a map of geometry constants (lengths in mm)."""
    def product(*names: str) -> Column:
        out = F.lit(1.0)
        for n in names:
            out = out * constants[n]
        return out

    pads = product("SiPad_NLayers", "SiPad_NASUsX", "SiPad_NWafersX", "SiPad_WaferSizeX", "SiPad_NASUsY", "SiPad_NWafersY", "SiPad_WaferSizeY") / 1e6
    # two planes of strips a layer
    strips = 2 * product("SiTarget_NLayers", "SiTarget_ncols", "SiTarget_sensor_width", "SiTarget_nrows", "SiTarget_sensor_height") / 1e6
    to_kg = prices.density / 1e6
    w_pads = product("SiPad_NLayers", "SiPad_WThickness", "SiPad_dim_x", "SiPad_dim_y") * to_kg
    w_strips = product("SiTarget_NLayers", "SiTarget_WThickness", "SiTarget_env_width", "SiTarget_env_height") * to_kg
    per_sensor = sum((F.floor(constants[f"SiTarget_sensor_{s}"] / constants["SiTarget_strip_pitch"]) for s in ("width", "height")), F.lit(0))
    n_pads = product("SiPad_NLayers", "SiPad_NcellsX", "SiPad_NcellsY")
    n_strips = product("SiTarget_NLayers", "SiTarget_ncols", "SiTarget_nrows") * per_sensor
    return {
        "si_area_sipad_m2": pads, "si_area_sitarget_m2": strips, "si_area_m2": pads + strips, "w_mass_sipad_kg": w_pads, "w_mass_sitarget_kg": w_strips, "w_mass_kg": w_pads + w_strips,
        "n_channels_sipad": n_pads, "n_channels_sitarget": n_strips, "n_channels": n_pads + n_strips, "cost_proxy": prices.silicon * (pads + strips) + prices.tungsten * (w_pads + w_strips),
    }


def slack(dim: Column, n: Column, rigid: Column) -> Column:
    """What a layer may still take of a stack's length."""
    return dim / n - rigid - 1e-4


def most_layers(dim: Column, rigid: Column, least: Column, tolerance: float = 1e-4) -> Column:
    return F.floor(dim / (rigid + tolerance + least))


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail."""
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def raster(variants: DataFrame, nx: int, ny: int, per_wafer: int = 16) -> DataFrame:
    """A grid of sample points over each variant's square plane, the pad that each meets and whether it is live.

    variants: any columns with size, pad and gap. Wafers are per_wafer pads wide with a dead
    rim of gap around each. Points are made in two steps, a row of the grid and then its
    points, so that the rows of one large plane are dealt out.
    """
    whole = per_wafer * F.col("pad") + 2 * F.col("gap")
    line = variants.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ny - 1).cast("long"))))
    if ny > 1024:
        line = line.repartition(*variants.columns, "j")
    x = line.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx - 1).cast("long"))))
    x = x.withColumns({"x": (F.col("i") + 0.5) * (F.col("size") / nx), "y": (F.col("j") + 0.5) * (F.col("size") / ny)})

    def index(v: Column) -> tuple[Column, Column]:
        inside = v - F.floor(v / whole) * whole - F.col("gap")
        return F.floor(v / whole) * per_wafer + F.floor(inside / F.col("pad")), (inside >= 0) & (inside < per_wafer * F.col("pad"))

    (gx, live_x), (gy, live_y) = index(F.col("x")), index(F.col("y"))
    return x.withColumns({"gx": gx, "gy": gy, "live": live_x & live_y}).withColumn("wafer", wafer(F.col("gx"), F.col("gy"), per_wafer))


def occupancy(samples: DataFrame, size: float | Column, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Live and all samples of each of n x n bins (of each key): full, partly or dead."""
    b = lambda c: F.least(F.lit(n - 1), F.floor(F.col(c) / (size / n)).cast("int"))
    x = samples.groupBy(*keys, b("x").alias("bin_x"), b("y").alias("bin_y")).agg(F.count_if("live").alias("live"), F.count("*").alias("total"))
    return x.withColumn("state", F.when(F.col("live") == 0, "dead").when(F.col("live") == F.col("total"), "full").otherwise("partly"))

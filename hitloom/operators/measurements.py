"""Hits to measurements, and near-neighbour cleaning of the pool."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sitarget(hits: DataFrame, pitch: float = 0.0755, width: float = 99.25, height: float = 199.5, gap: float = 1.0, cols: int = 4, rows: int = 2, n_surfaces: int = 40) -> DataFrame:
    """hits: plane, layer, column, row, x, y, z, t, e. The strip gives one axis, the sensor's centre the other.

    In plane 1 sensors are turned by 90 degrees. Hits beyond the last surface go.
    """
    across, down = cols * width + (cols - 1) * gap, rows * height + (rows - 1) * gap
    along_col = -across / 2 + width / 2 + F.col("column") * (width + gap)
    along_row = down / 2 - height / 2 - F.col("row") * (height + gap)
    strip = F.col("plane") == 0
    fine, coarse = pitch**2 / 12, height**2 / 12
    return hits.where(F.col("layer") * 2 + F.col("plane") < n_surfaces).select(
        "window_id", "cell_id", F.lit(0).alias("det"), F.col("plane").cast("int").alias("quality"), "layer", "plane",
        F.when(strip, F.col("x")).otherwise(along_row).alias("x"), F.when(strip, along_row).otherwise(F.col("y")).alias("y"), "z",
        F.when(strip, fine).otherwise(coarse).alias("var0"), F.when(strip, coarse).otherwise(fine).alias("var1"), F.col("t").alias("time"), F.col("e").alias("edep"),
    )


def sipad(hits: DataFrame, sx: float = 5.5, sy: float = 5.5, n_surfaces: int = 60, offset: int = 40) -> DataFrame:
    """Pads measure both axes."""
    return hits.where(F.col("layer") + offset < n_surfaces).select(
        "window_id", "cell_id", F.lit(1).alias("det"), F.col("layer").cast("int").alias("quality"), "layer", "x", "y", "z",
        F.lit(sx**2 / 12).alias("var0"), F.lit(sy**2 / 12).alias("var1"), F.col("t").alias("time"), F.col("e").alias("edep"),
    )


def pair_all(hits: DataFrame, max_dz: float = 25.0) -> DataFrame:
    """U with V of a layer, |dz| <= max_dz: window_id, station, layer, u, v (structs)."""
    keys = ("window_id", "station", "layer")
    inner = F.struct("hit_id", "cell_id", "x", "z", "t", "e")
    u = hits.where("plane = 0").select(*keys, inner.alias("u"))
    v = hits.where("plane = 1").select(*keys, inner.alias("v"))
    return u.join(v, list(keys)).where(F.abs(F.col("u.z") - F.col("v.z")) <= max_dz)


#: pairing of stereo planes by name; an unknown one pairs nothing
PAIRINGS = {"AllPairs": pair_all, "None": lambda hits, max_dz=25.0: pair_all(hits, -1.0)}


def mtc(hits: DataFrame, method: str = "AllPairs", angle: float = 5.0, pitch: float = 1.0, max_dz: float = 25.0) -> DataFrame:
    """Fibre hits (plane 0 U, 1 V) to crossings of pairs, and to one-axis measurements of what stays single."""
    tilt = math.radians(angle)
    c, s = math.cos(tilt), math.sin(tilt)
    pairs = PAIRINGS.get(method, PAIRINGS["None"])(hits, max_dz)
    su, sv = c * F.col("u.x"), c * F.col("v.x")
    two = pairs.select(
        "window_id", "station", "layer", F.col("u.cell_id").alias("cell_id"), F.lit(3).alias("quality"), F.lit(True).alias("is2d"),
        ((su + sv) / (2 * c)).alias("x"), ((sv - su) / (2 * s)).alias("y"), ((F.col("u.z") + F.col("v.z")) / 2).alias("z"),
        F.lit(pitch**2 / (24 * c * c)).alias("var0"), F.lit(pitch**2 / (24 * s * s)).alias("var1"),
        ((F.col("u.t") + F.col("v.t")) / 2).alias("time"), (F.col("u.e") + F.col("v.e")).alias("edep"),
    )
    used = pairs.select("window_id", F.explode(F.array("u.hit_id", "v.hit_id")).alias("hit_id")).distinct()
    single = hits.where("plane < 2").join(used, ["window_id", "hit_id"], "left_anti").select(
        "window_id", "station", "layer", "cell_id", F.col("plane").cast("int").alias("quality"), F.lit(False).alias("is2d"),
        (c * F.col("x")).alias("x"), F.lit(0.0).alias("y"), "z", F.lit(c * c * pitch**2 / 12).alias("var0"), F.lit(0.0).alias("var1"), F.col("t").alias("time"), F.col("e").alias("edep"),
    )
    return two.unionByName(single)


def at_surface(measurements: DataFrame, surfaces: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose address has a surface, with its id. surfaces: one row an address, of the detector's fixed size."""
    return measurements.join(F.broadcast(surfaces.select(*keys, "surface_id")), keys)


def without_surface(measurements: DataFrame, surfaces: DataFrame, keys: list[str]) -> DataFrame:
    return measurements.join(F.broadcast(surfaces.select(*keys)), keys, "left_anti")


def nearest_plane(z: Column, planes: list[float]) -> Column:
    """The plane of smallest |z - plane|, the first in a tie."""
    return F.array_min(F.array(*[F.struct(F.abs(z - p).alias("d"), F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(planes)]))["p"]


def neighbours_1d(df: DataFrame, keys: list[str], x: str, radius: float) -> DataFrame:
    """df with n, the rows of its group closer than radius, itself excepted. Sorted once per group."""
    over = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY CAST(`{x}` AS DOUBLE) RANGE BETWEEN"
    r = float(radius)
    near = F.expr(f"count(1) {over} {r}D PRECEDING AND {r}D FOLLOWING) - count(1) {over} {r}D FOLLOWING AND {r}D FOLLOWING) - count(1) {over} {r}D PRECEDING AND {r}D PRECEDING)")
    return df.withColumn("n", near - 1)


def neighbours_2d(df: DataFrame, keys: list[str], row_id: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """As neighbours_1d in the plane: rows meet those of the nine grid cells around, so only near pairs are compared."""
    cell = lambda c: F.floor(F.col(c) / radius)
    a = df.select(*keys, F.col(row_id).alias("_a"), F.col(x).alias("_ax"), F.col(y).alias("_ay"), cell(x).alias("_i"), cell(y).alias("_j"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = df.select(*keys, F.col(row_id).alias("_b"), F.col(x).alias("_bx"), F.col(y).alias("_by"), F.explode(around).alias("o"), cell(x).alias("_ci"), cell(y).alias("_cj"))
    b = b.select(*keys, "_b", "_bx", "_by", (F.col("_ci") + F.col("o.i")).alias("_i"), (F.col("_cj") + F.col("o.j")).alias("_j"))
    far = F.pow(F.col("_ax") - F.col("_bx"), 2) + F.pow(F.col("_ay") - F.col("_by"), 2)
    n = a.join(b, [*keys, "_i", "_j"]).where((F.col("_a") != F.col("_b")) & (far < radius**2)).groupBy(*keys, F.col("_a").alias(row_id)).agg(F.count("*").alias("n"))
    return df.join(n, [*keys, row_id], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def purge(counted: DataFrame, most: int) -> DataFrame:
    """Rows with few enough neighbours."""
    return counted.where(F.col("n") <= most).drop("n")


def stereo_strip(x: Column, y: Column, angle: float, pitch: float, offset: float) -> Column:
    return F.floor((x - y * math.tan(math.radians(angle)) - offset) / pitch + 0.5)


def loc_to_global(l0: Column, l1: Column, tilt: Column) -> tuple[Column, Column]:
    return l0 * F.cos(tilt) + l1 * F.sin(tilt), -l0 * F.sin(tilt) + l1 * F.cos(tilt)


def wafer(gx: Column, gy: Column, per_wafer: int = 16, cols: int = 4) -> Column:
    """Number of the wafer that holds a global pad index."""
    return F.floor(gy / per_wafer) * cols + F.floor(gx / per_wafer)

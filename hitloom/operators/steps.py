"""Steps by name, configured by named properties: the keyword parameters of their functions."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from hitloom.operators import hits, linking, measurements, physics, seeding, trials, variants

STEPS: dict[str, Callable[..., DataFrame]] = {
    "all_windows": hits.all_windows, "cut_windows": hits.cut_windows, "sitarget": measurements.sitarget, "sipad": measurements.sipad, "mtc": measurements.mtc,
    "crossings": seeding.crossings, "stereo_crossings": seeding.stereo_crossings, "mtc_points": seeding.mtc_points, "near_peaks": seeding.near_peaks, "suppress": seeding.suppress, "seeds": seeding.seeds,
    "accept": linking.accept, "without_duplicates": linking.without_duplicates, "splice": linking.splice_candidates, "stitch": linking.stitch_candidates, "link": linking.link,
    "pair_states": linking.pair_states, "stereo_points": linking.stereo_points, "region_tally": linking.region_tally, "follow_paths": physics.follow_paths, "parabola": physics.parabola,
    "recovered": physics.recovered, "panel_hits": physics.panel_hits, "wall_times": trials.wall_times, "raster": variants.raster,
}


def properties(name: str) -> dict[str, Any]:
    """A step's properties with their defaults. Parameters without one, tables above all, are not properties."""
    if name not in STEPS:
        raise ValueError(f"no step is named {name!r}; there are {', '.join(sorted(STEPS))}")
    return {k: p.default for k, p in inspect.signature(STEPS[name]).parameters.items() if p.default is not inspect.Parameter.empty}


def _fitting(name: str, key: str, value: Any, default: Any) -> Any:
    """value as the default's type, where nothing is lost by it."""
    kind = type(default)
    if default is None or isinstance(value, kind) and not (kind is int and isinstance(value, bool)):
        return value
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind in (int, float) and number and kind(value) == value:
        return kind(value)
    if kind is tuple and isinstance(value, list):
        return tuple(value)
    raise ValueError(f"property {key} of {name} is {value!r}, not a {kind.__name__}")


def configured(name: str, given: Mapping[str, Any]) -> Callable[..., DataFrame]:
    """A step with some properties set; unknown ones, and values of another kind than the default, are errors."""
    known = properties(name)
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"{name} has no property {', '.join(unknown)}; there are {', '.join(sorted(known)) or 'none'}")
    return functools.partial(STEPS[name], **{k: _fitting(name, k, v, known[k]) for k, v in given.items()})


def catalogue(spark: SparkSession) -> DataFrame:
    """Every property of every step: step, property, kind, default (as text)."""
    rows = [(s, k, type(v).__name__, repr(v)) for s in sorted(STEPS) for k, v in properties(s).items()]
    return spark.createDataFrame(rows, "step string, property string, kind string, default string")

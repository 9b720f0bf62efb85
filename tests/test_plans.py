"""Every plan with SQL against another engine, and the plans without against hand-written loops."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from hitloom import plans
from hitloom.sources.fixtures import ctes

TABLES = ("lineitem", "orders", "events")


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float) and math.isnan(x) or x is None or x is pd.NaT or x is pd.NA:
        return None
    x = x.item() if hasattr(x, "item") else x
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_plan_equals_its_sql(spark, sf, duck, name):
    mine, other = plans.QUERIES[name](spark, sf).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


def collected(spark, sf, name):
    return [r.asDict() for r in plans.QUERIES[name](spark, sf).collect()]


def read(duck, name):
    return duck.execute(ctes(name) + f"SELECT * FROM {name}").df()


def test_sampled_light_has_the_expected_mean(spark, sf):
    sampled = collected(spark, sf, "p6_scifi_sampled")
    expected = collected(spark, sf, "p6_scifi_expected")
    light = {(r["window_id"], r["cell_id"]): r["light"] for r in expected}
    both = [(r["photons"], light[r["window_id"], r["cell_id"]]) for r in sampled if (r["window_id"], r["cell_id"]) in light]
    d = np.array([p - m for p, m in both]) / np.sqrt([m for _, m in both])
    assert abs(d.mean()) < 5 / math.sqrt(len(d)) + 0.05 and 0.8 < d.std() < 1.2

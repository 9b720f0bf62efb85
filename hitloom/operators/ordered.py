"""Steps that depend on the order of rows in a group: a walk over sorted partitions, rounds for giant groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.sources.shared import cut, discard


def walk(
    rows: DataFrame, keys: list[str], order: list[str | Column], columns: list[str],
    start: Callable[[], Any], step: Callable[[Any, tuple], tuple | None], schema: str,
) -> DataFrame:
    """step(state, values of columns) for every row of a group in order; start() makes a group's state.

    What step returns (None for nothing) follows the keys in a row of the result. Groups
    are streamed, many to a task and batch: only the state of one is held, never its rows.
    Rows with a null key are left out.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, None
        for pdf in batches:
            out = []
            for key, values in zip(zip(*(pdf[k].tolist() for k in keys), strict=True), zip(*(pdf[c].tolist() for c in columns), strict=True), strict=True):
                if key != group:
                    group, state = key, start()
                got = step(state, values)
                if got is not None:
                    out.append((*key, *got))
            yield pd.DataFrame(out, columns=names)

    dealt = rows.dropna(subset=keys).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*keys, *columns).mapInPandas(run, schema)


#: rows of a group that one task walks over
TAIL = 100_000


def in_rounds(rows: DataFrame, keys: list[str], settle: Callable[[DataFrame], tuple[DataFrame, DataFrame]], tail: int = TAIL) -> tuple[DataFrame | None, DataFrame]:
    """Settles groups of more than `tail` rows round by round, until so few are left: what was settled, and the rows left.

    settle(rows) gives what can be decided at once, for all rows in parallel, and the rows
    that it leaves open; taken again and again it must give what an ordered walk gives. A
    round that leaves more than 15 in 16 of the rows is the last, as after that the order
    is close to a chain, which a walk follows faster. Each round is a table, which cuts
    the lineage; only counts reach the driver.
    """

    def largest(df: DataFrame) -> tuple[int, int]:
        found = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        return found["most"] or 0, found["all"] or 0

    rows = cut(rows, "rows")
    settled = None
    most, n = largest(rows)
    while most > tail:
        done, left = settle(rows)
        done, left = cut(done, "settled"), cut(left, "rows")
        settled = done if settled is None else settled.unionByName(done)
        discard(rows)
        before, rows = n, left
        most, n = largest(rows)
        if n > before * 15 / 16:
            break
    return settled, rows


def first_come(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round of keeping nodes in order unless an earlier kept one is their rival: keys, node that goes; edges left.

    edges: keys, better, worse, one a pair of rivals. A node with no better rival is kept,
    so its worse rivals go, and with them all of their pairs.
    """
    kept = edges.select(*keys, "better").join(edges.select(*keys, F.col("worse").alias("better")).distinct(), [*keys, "better"], "left_anti").distinct()
    gone = edges.join(kept, [*keys, "better"], "left_semi").select(*keys, F.col("worse").alias("node")).distinct()
    left = edges.join(gone.withColumnRenamed("node", "worse"), [*keys, "worse"], "left_anti").join(gone.withColumnRenamed("node", "better"), [*keys, "better"], "left_anti")
    return gone, left


def losers(edges: DataFrame, keys: list[str], order: list[str], tail: int = TAIL) -> DataFrame:
    """keys, node: nodes that go when all are taken in order, each unless an earlier kept one is its rival.

    edges: keys, better, worse, and the columns `order` of the worse one (with its name
    the last in the order). Groups above `tail` pairs in rounds, what is left in a walk.
    """
    gone, left = in_rounds(edges, keys, lambda e: first_come(e, keys), tail)
    rivals = left.groupBy(*keys, "worse", *order).agg(F.collect_set("better").alias("rivals"))
    name = edges.schema["worse"].dataType.simpleString()
    schema = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys) + f", node {name}"
    walked = walk(rivals, keys, [*order, "worse"], ["worse", "rivals"], set, _gone, schema)
    return walked if gone is None else walked.unionByName(gone)


def _gone(gone: set, row: tuple) -> tuple | None:
    """A node goes if a better rival is kept, that is, has not gone."""
    node, rivals = row
    if gone.issuperset(rivals):
        return None
    gone.add(node)
    return (node,)

"""Which shard and slot a row gets, against a walk around the ring, row by row."""

import bisect

import pytest
from pyspark.sql import functions as F

from hitloom.llm import sharding


def walked(nodes, rows, n_shards):
    """rows: (key, hash, lane). Own keys up to a shard's capacity in ring order, then each of the rest on to the next shard with room."""
    places = [n.place for n in nodes]
    arcs = {a: [] for a in range(len(nodes))}
    for key, h, lane in rows:
        at = bisect.bisect_left(places, h % sharding.RING)
        arcs[at if at < len(nodes) else 0].append((lane, h, key))
    room = {s: len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)}
    taken, left = {s: [] for s in range(n_shards)}, []
    for arc in sorted(arcs):
        own = nodes[arc].shard
        for item in sorted(arcs[arc]):
            if room[own]:
                room[own] -= 1
                taken[own].append(item[2])
            else:
                left.append((arc, item[2]))
    for arc, key in left:
        at = next(nodes[(arc + k) % len(nodes)].shard for k in range(1, len(nodes) + 1) if room[nodes[(arc + k) % len(nodes)].shard])
        room[at] -= 1
        taken[at].append(key)
    return {key: (s, slot) for s, keys in taken.items() for slot, key in enumerate(keys)}


@pytest.mark.parametrize(("n", "n_shards", "vnodes"), [(400, 7, 3), (23, 9, 2), (3, 5, 4), (500, 4, 1)])
def test_shards_equal_a_walk_on_the_ring(spark, n, n_shards, vnodes):
    ids = spark.range(n).select((F.col("id") * 37).alias("id"))
    nodes = sorted(sharding.ring(spark, n_shards, vnodes).collect(), key=lambda r: r.arc)
    rows = [tuple(r) for r in ids.select("id", F.xxhash64(F.lit("key"), "id"), F.pmod(F.xxhash64(F.lit("lane"), "id"), F.lit(sharding.LANES))).collect()]
    got = {r.id: (r.shard, r.slot) for r in sharding.shard(ids, "id", n_shards, vnodes).collect()}
    assert got == walked(nodes, rows, n_shards)

"""Splices, paths, stereo points and greedy choices against literal loops on random windows."""

import math
import random

import pytest

from hitloom.operators import linking, ordered, physics, seeding

ENDS = "window_id long, segment_id long, det int, " + ", ".join(f"{e}_{c} double" for e in "fb" for c in ("x", "y", "z", "dx", "dy", "dz"))


def unit(rng):
    ty, tz = rng.uniform(-0.06, 0.06), rng.uniform(-0.06, 0.06)
    n = math.sqrt(1 + ty * ty + tz * tz)
    return (1 / n, ty / n, tz / n)


def pieces(rng, windows):
    rows = []
    for w in range(windows):
        for i in range(rng.randrange(2, 14)):
            det = rng.randrange(3)
            x = (-1000, -200, 2000)[det] + 20.0 * rng.randrange(3)
            front, back = unit(rng), unit(rng)
            if rng.random() < 0.1:
                front = (0.0, 1.0, 0.0)
            if rng.random() < 0.05:
                back = (1e-7, 1.0, 0.0)
            rows.append((w, 100 * w + i, det, x, rng.uniform(-30, 30), rng.uniform(-30, 30), *front, x + 40.0, rng.uniform(-30, 30), rng.uniform(-30, 30), *back))
    return rows


SURFACES = [(d, x0 + 20.0 * k) for d, x0 in enumerate((-1000.0, -200.0, 2000.0)) for k in range(5)]


def at(place, direction, plane):
    if abs(direction[0]) < 1e-6:
        return None
    step = (plane - place[0]) / direction[0]
    return place[1] + direction[1] * step, place[2] + direction[2] * step


def judged(a, b, d, e, max_dist, max_angle):
    dist = math.hypot(a[0] - b[0], a[1] - b[1])
    norm = math.sqrt(sum(v * v for v in d) * sum(v * v for v in e))
    angle = math.acos(max(-1.0, min(1.0, sum(p * q for p, q in zip(d, e, strict=True)) / norm)))
    return (dist, dist * dist + 100 * angle * angle) if dist <= max_dist and angle <= max_angle else None


def slow_candidates(rows, splice, max_dist, max_angle):
    planes = {d: (max(x for e, x in SURFACES if e == d) + min(x for e, x in SURFACES if e == d + 1)) / 2 for d in (0, 1)}
    out = {}
    for u in rows:
        for d in rows:
            if u[0] != d[0] or d[2] != u[2] + 1:
                continue
            plane = planes[u[2]] if splice else d[3]
            a = at(u[9:12], u[12:15], plane)
            b = at(d[3:6], d[6:9], plane) if splice else (d[4], d[5])
            found = a and b and judged(a, b, u[12:15], d[6:9], max_dist, max_angle)
            if found:
                out[u[0], u[2], u[1], d[1]] = found
    return out


@pytest.mark.parametrize("splice", [True, False])
def test_candidates_equal_a_loop_over_pairs(spark, splice):
    rows = pieces(random.Random(3), 120)
    ends = spark.createDataFrame(rows, ENDS)
    planes = linking.boundaries(spark.createDataFrame(SURFACES, "det int, x double"))
    got = linking.splice_candidates(ends, planes, 25.0, 0.08) if splice else linking.stitch_candidates(ends, 25.0, 0.08)
    got = {(r.window_id, r.det, r.up, r.down): (r.dist, r.score) for r in got.collect()}
    want = slow_candidates(rows, splice, 25.0, 0.08)
    assert len(want) > 30 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_candidates_meet_by_cell_not_by_window(spark):
    ends = spark.createDataFrame(pieces(random.Random(1), 2), ENDS)
    planes = linking.boundaries(spark.createDataFrame(SURFACES, "det int, x double"))
    for found in (linking.splice_candidates(ends, planes), linking.stitch_candidates(ends)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line]
        assert any("_i" in j and "_j" in j for j in joins)
        assert all("det" in j for j in joins)
    assert linking.splice_candidates(ends.limit(0), planes).count() == 0 and linking.stitch_candidates(ends, max_dist=0.0).count() == 0


def slow_path(points, width=5.0):
    bins = {}
    for z, c, e in sorted(points):
        bins.setdefault(round(z / width), []).append((c, z, e))
    path = []
    for k in sorted(bins):
        some = bins[k]
        if len(some) == 1:
            chosen = some[0]
        elif not path:
            chosen = max(some, key=lambda h: h[2])
        else:
            mean = sum(h[1] for h in some) / len(some)
            goal = path[-1][1]
            if len(path) > 1 and path[-1][2] != path[-2][2]:
                (_, c0, z0), (_, c1, z1) = path[-2], path[-1]
                goal = c1 + (mean - z1) * (c1 - c0) / (z1 - z0)
            chosen = min(some, key=lambda h: abs(h[0] - goal))
        path.append((k, chosen[0], chosen[1]))
    return path


def test_paths_equal_a_loop_on_200_windows(spark):
    rng = random.Random(5)
    windows = {w: [(rng.choice([rng.uniform(0, 200), 2.5 * rng.randrange(80)]), rng.uniform(-50, 50), rng.choice([1.0, 2.0, rng.random()])) for _ in range(rng.randrange(1, 60))] for w in range(200)}
    rows = [(w, c, z, e) for w, points in windows.items() for z, c, e in points]
    got = {}
    for r in physics.follow_paths(spark.createDataFrame(rows, "w long, coord double, z double, e double"), ["w"]).collect():
        got.setdefault(r.w, []).append((r.zbin, r.coord, r.z))
    assert {w: sorted(p) for w, p in got.items()} == {w: slow_path(p) for w, p in windows.items()}


def slow_stereo(states):
    out, i, tan = [], 0, 2 * math.tan(math.radians(5.0))
    states = sorted(states, key=lambda s: (s[3], s[0]))
    while i < len(states):
        seq, x, y, z, loc0, tilt = states[i]
        if abs(tilt) > 0.01 and i + 1 < len(states) and abs(z - states[i + 1][3]) < 5.0 and tilt * states[i + 1][5] < 0:
            other = states[i + 1]
            u, v = (loc0, other[4]) if tilt > 0 else (other[4], loc0)
            out.append((seq, True, (u + v) / 2, (v - u) / tan, (z + other[3]) / 2))
            i += 2
        else:
            out.append((seq, False, x, y, z))
            i += 1
    return out


def test_stereo_points_equal_a_loop(spark):
    rng = random.Random(9)
    tracks = {t: [(k, rng.uniform(-9, 9), rng.uniform(-9, 9), float(rng.randrange(40)), rng.uniform(-5, 5), rng.choice([0.0, 0.0872, -0.0872, 0.005])) for k in range(rng.randrange(1, 25))] for t in range(80)}
    rows = [(t, *s) for t, states in tracks.items() for s in states]
    got = {}
    for r in linking.stereo_points(spark.createDataFrame(rows, "t long, seq int, x double, y double, z double, loc0 double, tilt double"), ["t"]).collect():
        got.setdefault(r.t, []).append((r.seq, r.paired, r.x, r.y, r.z))
    assert sum(p[1] for points in got.values() for p in points) > 50
    for t, states in tracks.items():
        want = sorted(slow_stereo(states))
        assert [g[:2] for g in sorted(got[t])] == [w[:2] for w in want]
        assert [v for g in sorted(got[t]) for v in g[2:]] == pytest.approx([v for w in want for v in w[2:]])


def slow_links(rows):
    out, ups, downs = set(), set(), set()
    for w, det, up, down, score in sorted(rows, key=lambda r: (r[0], round(r[4], 9), r[2], r[3])):
        if (w, up) not in ups and (w, down) not in downs:
            ups.add((w, up))
            downs.add((w, down))
            out.add((w, det, up, down))
    return out


@pytest.mark.parametrize("tail", [0, 40, 10**6])
def test_rounds_and_walk_take_the_same_links(spark, tail):
    rng = random.Random(tail)
    rows = [(w, 0, u, d, float(rng.randrange(40))) for w, n in ((0, 30), (1, 4), (2, 0)) for u in range(n) for d in range(1000, 1000 + n) if rng.random() < 0.5]
    found = linking.link(spark.createDataFrame(rows, "window_id long, det int, up long, down long, score double"), tail=tail)
    assert {tuple(r) for r in found.collect()} == slow_links(rows)


@pytest.mark.parametrize("tail", [0, 25, 10**6])
def test_rounds_and_walk_drop_the_same_duplicates(spark, tail):
    rng = random.Random(4)
    segments = [(w, s, float(rng.randrange(9)) if s % 7 else None, 3) for w in range(3) for s in range(40)]
    hits = {(w, s): rng.sample(range(12), rng.randrange(1, 6)) for w, s, *_ in segments}
    got = linking.without_duplicates(
        spark.createDataFrame(segments, "window_id long, segment_id long, chi2 double, ndf int"),
        spark.createDataFrame([(w, s, h) for (w, s), hs in hits.items() for h in hs], "window_id long, segment_id long, hit_id int"), 0.5, tail,
    )
    want = set()
    for w, s, q, _ in sorted(segments, key=lambda r: (r[0], float("inf") if r[2] is None else r[2] / 3, r[1])):
        if not any(len(set(hits[w, s]) & set(hits[w, k])) > 0.5 * min(len(hits[w, s]), len(hits[w, k])) for v, k in want if v == w):
            want.add((w, s))
    assert {(r.window_id, r.segment_id) for r in got.collect()} == want


@pytest.mark.parametrize("tail", [0, 10**6])
def test_rounds_and_walk_suppress_the_same_peaks(spark, tail):
    rng = random.Random(6)
    peaks = [(w, x, y, rng.randrange(5)) for w in range(2) for x in range(-8, 8) for y in range(-8, 8) if rng.random() < 0.4]
    kept = set()
    for w, x, y, _ in sorted(peaks, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if not any(v == w and abs(x - a) <= 2 and abs(y - b) <= 2 for v, a, b in kept):
            kept.add((w, x, y))
    found = seeding.suppress(spark.createDataFrame(peaks, "w long, ix int, iy int, votes long"), ["w"], 2, tail)
    assert {tuple(r) for r in found.collect()} == kept


def test_a_chain_of_rivals_ends_in_the_walk(spark):
    n = 3000
    edges = spark.range(n).selectExpr("0L AS w", "id AS better", "id + 1 AS worse", "id + 1 AS q")
    gone = ordered.losers(edges, ["w"], ["q"], tail=10)
    assert {r.node for r in gone.collect()} == set(range(1, n + 1, 2))


def test_empty_tables_give_no_links(spark):
    none = spark.createDataFrame([], "window_id long, det int, up long, down long, score double")
    assert linking.link(none).count() == 0 and linking.link(none, tail=0).count() == 0

"""Secret scanning: rules, and a character convolutional network over candidates.

Three rules find the base spans (assign, access, hex), leftmost and non-overlapping
each. Candidates are those spans and every run of LEAST_ASSIGN or more of letters, digits
and +/_=- that has a digit and a letter. A network reads each whole candidate (of assign
the value) with the text around it, LEFT code points before and RIGHT after: learned
character vectors, one convolution, the largest response inside the candidate and in
its context, a logistic output. Every candidate has its calibrated probability; those
above their threshold that overlap no base span are added as kind "model", and base
spans always stay.

Training is on the labelled findings of all documents, each different one once. Secrets
are the findings of the rules, but hex runs of digits alone, with their text and as the
network meets secrets that no rule covers (masked): the value alone, without the keyword
and sign before it (an ordinary word or nothing in its place) or the prefix AKIA, and hex
also in upper case. Ordinary are runs of digits, long plain words, and other candidates
that the text itself calls an id, a checksum, a path or the like (ORDINARY). Candidates
outside the rules are else unlabelled: they may be secrets. Half of the rows, by hash,
train: dealt to blocks of some BLOCK_ROWS, each of which takes its steps over all its rows
from shared parameters, whose mean over the blocks the next of ROUNDS rounds starts from.
A quarter fits the calibration (Platt) and, for each shape of candidate, a threshold: the
largest, of those that are 1 / STEP of a raw output apart, that keeps a recall of `recall` on
its masked secrets, then half way down to the next ordinary row; `measured` has the recall on masked secrets of the last quarter,
which neither training nor thresholds have seen. Both come from counts of all its rows by
raw output. Without both labels nothing is added and no probability given.

Null texts are empty and have no spans. Rows that repeat an id or have none are scanned
like any other, one row in, one row out; ids come back as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import discard, materialize, pieces, sole_cache

# The rules as stated
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = {"assign": 0, "access": 1, "hex": 2, "model": 3}

#: the same matches as HEX of LEAST_HEX and more, as a run is taken whole
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_DIGIT = re.compile("[0-9]")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_WORD = re.compile(r"[A-Za-z]{12,}")
#: what just before a run says that it is no secret
ORDINARY = re.compile(r"""(?ai:\b(?:id|uuid|guid|md5|sha-?1|sha-?256|crc32|checksum|digest|etag|commit|rev|revision|version|isbn|doi|page|href|src|url|path)["']?\x20*[:=#/]?\x20*["']?)$""")
_RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS[s[0]], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def other_candidates(text: str, base: list[Span]) -> list[Span]:
    """Runs with a digit and a letter that overlap no base span."""
    out, at = [], 0
    while m := _DIGIT.search(text, at):
        start = m.start()
        while start > 0 and text[start - 1] in _RUN_CHARS:
            start -= 1
        at = _RUN.match(text, m.start()).end()
        run = text[start:at]
        if len(run) >= LEAST_ASSIGN and not run.isdigit() and any(c.isalpha() for c in run) and all(b <= start or a >= at for _, a, b in base):
            out.append(("model", start, at))
    return out


# --- the network -------------------------------------------------------------------

LEFT, RIGHT = 24, 8
#: 0 nothing, 1..95 printable ASCII, 96 other white space, 97 any other code point
SYMBOLS = 98
VECTOR, WIDE, FILTERS = 8, 5, 24
SHAPES = ("hex", "upper", "mixed")
#: code points that are convolved at a time
BLOCK = 1 << 16
#: rows of a batch, those at least that are of either label, and the weight of the parameters' squares, halved, in the loss
BATCH, LEAST, DECAY = 128, 16, 1e-3
#: rounds of training, and the steps that a block takes in one at least
ROUNDS, STEPS = 2, 200
#: rows of a block and their code points, about, and rows of either label, about, that it has at least
BLOCK_ROWS, BLOCK_POINTS, BLOCK_OF = 24_000, 4_000_000, 64
#: raw outputs are counted in steps of 1 / STEP from -LIMIT to LIMIT
STEP, LIMIT = 32, 256
#: parameters are summed in units of 1 / UNIT, so that the order of blocks says nothing
UNIT = 1 << 30


def window(text: str, start: int, end: int) -> str:
    """The candidate with LEFT characters before and RIGHT after it."""
    before, after = text[max(0, start - LEFT) : start], text[end : end + RIGHT]
    return before.rjust(LEFT, "\0") + text[start:end] + after.ljust(RIGHT, "\0")


def value_of(text: str, span: Span) -> tuple[int, int]:
    """What of a span is the candidate: all, or the value that is assigned."""
    kind, a, b = span
    return (ASSIGN.match(text, a).start(2), b) if kind == "assign" else (a, b)


def shape(candidate: str) -> int:
    if re.fullmatch(r"[0-9a-fA-F]+", candidate):
        return 0
    return 1 if candidate.upper() == candidate else 2


class Windows:
    """Windows as one row of symbols, each behind WIDE // 2 zeros, with the places of its three parts."""

    def __init__(self, windows: list[str]):
        gap = "\0" * (WIDE // 2)
        points = np.frombuffer((gap + gap.join(w + gap for w in windows)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.x = np.select([points == 0, (points >= 32) & (points < 127), (points >= 9) & (points < 14)], [0, points - 31, 96], 97)
        n = np.array([len(w) for w in windows])
        begin = np.cumsum(n + 2 * len(gap)) - (n + 2 * len(gap)) + len(gap)
        #: the text before, the candidate, the text after: first places, and where the last part ends
        self.parts = np.stack([begin, begin + LEFT, begin + n - RIGHT, begin + n], 1)


def initial(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {"e": r.normal(0, 0.3, (SYMBOLS, VECTOR)), "w": r.normal(0, (2 / (WIDE * VECTOR)) ** 0.5, (WIDE * VECTOR, FILTERS)), "b": np.zeros(FILTERS), "v": r.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1)}


def responses(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """What each filter says at each place but the WIDE // 2 outermost, as places, filters."""
    seen = np.concatenate([p["e"][x[i : len(x) - WIDE + 1 + i]] for i in range(WIDE)], axis=1)
    return np.maximum(seen @ p["w"] + p["b"], 0)


def respond(p: dict[str, np.ndarray], w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw outputs, the pooled responses (rows, inside and around) and the places they are from."""
    h = np.zeros((len(w.x), FILTERS))
    half = WIDE // 2
    for a in range(0, len(w.x) - WIDE + 1, BLOCK):
        part = w.x[a : a + BLOCK + WIDE - 1]
        h[a + half : a + half + len(part) - WIDE + 1] = responses(p, part)
    # parts and the gaps between windows, in turn
    edges = w.parts.ravel()
    top = np.maximum.reduceat(h, edges, axis=0).reshape(len(w.parts), 4, FILTERS)
    places = np.arange(len(h))[:, None]
    of = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(h))))
    first = np.where(h[edges[0] :] == top.reshape(-1, FILTERS)[of], places[edges[0] :], len(h))
    at = np.minimum.reduceat(first, edges - edges[0], axis=0).reshape(top.shape)
    before = top[:, 0] >= top[:, 2]
    pooled = np.concatenate([top[:, 1], np.where(before, top[:, 0], top[:, 2])], axis=1)
    return pooled @ p["v"] + p["c"][0], pooled, np.concatenate([at[:, 1], np.where(before, at[:, 0], at[:, 2])], axis=1)


def gradient(p: dict[str, np.ndarray], w: Windows, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    z, top, places = respond(p, w)
    d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    g = {"v": top.T @ d, "c": np.array([d.sum()]), "w": np.zeros_like(p["w"]), "b": np.zeros(FILTERS), "e": np.zeros_like(p["e"])}
    back = d[:, None] * p["v"] * (top > 0)  # rows, pooled
    filters = np.arange(2 * FILTERS) % FILTERS
    np.add.at(g["b"], filters, back.sum(axis=0))
    for i in range(WIDE):
        symbol = w.x[places + i - WIDE // 2]
        part = slice(i * VECTOR, (i + 1) * VECTOR)
        seen = np.einsum("nf,nfv->fv", back, p["e"][symbol])
        for k in range(2):
            g["w"][part] += seen[k * FILTERS : (k + 1) * FILTERS].T
        np.add.at(g["e"], symbol, back[:, :, None] * p["w"][part].T[filters][None])
    return g


def in_blocks(windows: list[str]) -> Iterator[slice]:
    """The windows, some at a time by their code points."""
    begin, total = 0, 0
    for i, w in enumerate(windows):
        if i > begin and total + len(w) > BLOCK:
            yield slice(begin, i)
            begin, total = i, 0
        total += len(w)
    if len(windows) > begin:
        yield slice(begin, len(windows))


def outputs(p: dict[str, np.ndarray], windows: list[str]) -> np.ndarray:
    return np.concatenate([np.empty(0), *[respond(p, Windows(windows[s]))[0] for s in in_blocks(windows)]])


def taught(p: dict[str, np.ndarray], windows: list[str], y: np.ndarray, seed: int, rate: float = 0.01) -> dict[str, np.ndarray]:
    """The steps of one block from p, over all of its rows: each batch has the next ones of both labels by their share, but LEAST at least, and both weigh the same."""
    r = np.random.default_rng(seed)
    of = [np.flatnonzero(y == k) for k in (0, 1)]
    if not all(map(len, of)):  # by the way rows are dealt, one block in e^BLOCK_OF
        return p
    first = min(max(round(BATCH * len(of[0]) / len(y)), LEAST), BATCH - LEAST)
    sizes = (first, BATCH - first)
    steps = max(STEPS, *(-(-len(o) // n) for o, n in zip(of, sizes, strict=True)))
    turns = [np.concatenate([r.permutation(o) for _ in range(-(-steps * n // len(o)))]) for o, n in zip(of, sizes, strict=True)]
    label, weight = np.repeat([0, 1], sizes), np.repeat([BATCH / 2 / n for n in sizes], sizes)
    p = {k: a.copy() for k, a in p.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        some = [windows[j] for turn, n in zip(turns, sizes, strict=True) for j in turn[(t - 1) * n : t * n]]
        whole = {k: DECAY * a for k, a in p.items()}
        for s in in_blocks(some):
            for k, g in gradient(p, Windows(some[s]), label[s], weight[s]).items():
                whole[k] += g * ((s.stop - s.start) / BATCH)
        for k, g in whole.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p


def platt(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the calibrated probability of rows, of n each where given, with the usual smoothed targets. Newton steps, halved until the loss falls."""
    n = np.ones(len(y)) if n is None else n
    n1, n0 = (y * n).sum(), ((1 - y) * n).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    f, ab = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])

    def loss(ab: np.ndarray) -> float:
        u = f @ ab
        return float(n @ np.logaddexp(0, u) - (n * goal) @ u)

    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(f @ ab, -500, 500)))
        h = (f * (n * q * (1 - q))[:, None]).T @ f + 1e-6 * np.eye(2)
        step, rate = np.linalg.solve(h, f.T @ (n * (q - goal))), 1.0
        while loss(ab - rate * step) > loss(ab) and rate > 1e-9:
            rate /= 2
        if rate <= 1e-9:
            break
        ab = ab - rate * step
    return float(ab[0]), float(ab[1])


class Scanner:
    """The trained network with its calibration and a threshold for each shape."""

    def __init__(self, p: dict[str, np.ndarray], ab: tuple[float, float], thresholds: list[float], measured: float | None = None):
        self.p, self.ab, self.thresholds, self.measured = p, ab, thresholds, measured

    def probability(self, windows: list[str]) -> np.ndarray:
        return self.calibrated(outputs(self.p, windows))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.ab[0] * z + self.ab[1], -30, 30)))

    def judged(self, texts: list[str]) -> list[list[tuple[Span, float]]]:
        """Base spans and accepted candidates of each text, in order, with their probabilities."""
        base = [base_spans(t) for t in texts]
        found = [[*b, *other_candidates(t, b)] for t, b in zip(texts, base, strict=True)]
        q = iter(self.probability([window(t, *value_of(t, s)) for t, f in zip(texts, found, strict=True) for s in f]).tolist())
        out = []
        for t, f in zip(texts, found, strict=True):
            some = {s: next(q) for s in f}
            keep = in_order([s for s, x in some.items() if s[0] != "model" or x >= self.thresholds[shape(t[s[1] : s[2]])]])
            out.append([(s, some[s]) for s in keep])
        return out


def judged(scanner: Scanner | None, texts: list[str]) -> list[list[tuple[Span, float | None]]]:
    return scanner.judged(texts) if scanner else [[(s, None) for s in base_spans(t)] for t in texts]


def step_of(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -LIMIT, LIMIT) * STEP).astype(np.int64)


def judge(p: dict[str, np.ndarray], counts: pd.DataFrame, recall: float) -> Scanner:
    """The scanner of a network. counts: part, y, shape, masked, step (of the raw output) and n, how many; of part 2 for calibration and thresholds, of part 3 to measure."""
    counts = counts.assign(secret=(counts["y"] == 1) & counts["masked"])
    held, apart = (counts[counts["part"] == k] for k in (2, 3))
    step = lambda c: c["step"].to_numpy(np.float64)
    scanner = Scanner(p, platt((step(held) + 0.5) / STEP, held["y"].to_numpy(np.float64), held["n"].to_numpy(np.float64)), [0.5] * len(SHAPES))

    def edges(c: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest probability in each step; the outermost have all beyond."""
        at = step(c)
        below, above = np.where(at <= -LIMIT * STEP, -1e9, at / STEP), np.where(at >= LIMIT * STEP, 1e9, (at + 1) / STEP)
        q = scanner.calibrated(below), scanner.calibrated(above)
        return np.minimum(*q), np.maximum(*q)

    def threshold(c: pd.DataFrame) -> float | None:
        secrets, ordinary = c[c["secret"]], c[c["y"] == 0]
        if secrets.empty:
            return None
        q = edges(secrets)[0]
        order = np.argsort(q, kind="stable")
        upto = secrets["n"].to_numpy()[order].cumsum()
        most = q[order][np.searchsorted(upto, math.floor((1 - recall) * upto[-1]), side="right")]
        under = edges(ordinary if len(ordinary) else held[held["y"] == 0])[1]
        under = under[under < most]
        logit = lambda x: math.log(x / (1 - x))
        return 1 / (1 + math.exp(-(logit(most) + logit(under.max())) / 2)) if len(under) else float(most)

    every = threshold(held)
    found = [threshold(held[held["shape"] == k]) for k in range(len(SHAPES))]
    # a shape without masked secrets has the threshold of all
    scanner.thresholds = [x if x is not None else every if every is not None else 0.5 for x in found]
    if len(unseen := apart[apart["secret"]]):
        reached = edges(unseen)[0] >= np.array(scanner.thresholds)[unseen["shape"]]
        scanner.measured = float((reached * unseen["n"]).sum() / unseen["n"].sum())
    return scanner


def fitted(windows: list[str], y: np.ndarray, shapes: np.ndarray, masked: np.ndarray, recall: float, seed: int = 5) -> Scanner | None:
    """What fit() does, with rows at hand, as one block: of each four rows, in the order given, two train; one fits calibration and thresholds; by one recall is measured."""
    part = np.arange(len(y)) % 4
    if len({*y[part < 2]}) < 2 or len({*y[part == 2]}) < 2:
        return None
    p = initial(seed)
    for k in range(ROUNDS):
        p = taught(p, [w for w, x in zip(windows, part, strict=True) if x < 2], y[part < 2], seed + k)
    counts = pd.DataFrame({"part": part, "y": y, "shape": shapes, "masked": masked, "step": step_of(outputs(p, windows)), "n": 1})
    return judge(p, counts, recall)


def bare(text: str, span: Span) -> list[tuple[str, int, int, bool]]:
    """A finding as it is, and masked, as the network meets secrets outside the rules: texts, each with the place of the value."""
    kind, _, b = span
    start, _ = value_of(text, span)
    before, value, after = text[max(0, start - LEFT) : start], text[start:b], text[b : b + RIGHT]
    out = [(before + value + after, len(before), len(before + value), False)]
    # in place of keyword and sign nothing, or the name of something
    names = ("", "value: ") if kind == "assign" else ("",)
    before = text[max(0, span[1] - LEFT) : span[1]]
    values = [value, value.upper()] if kind == "hex" else [value.removeprefix("AKIA") if kind == "access" else value]
    return out + [(before + n + v + after, len(before + n), len(before + n + v), True) for n in names for v in values]


def examples(text: str) -> list[tuple[int, str, int, bool]]:
    """Label, window, shape and whether it is masked, of what a text has to learn from."""
    base = base_spans(text)
    out = []
    for s in base:
        if text[s[1] : s[2]].isdigit():
            out.append((0, text, s[1], s[2], False))
        # a span inside another is no secret of its own, and a value must be one the network is asked about
        elif not any(o != s and o[1] <= s[1] and s[2] <= o[2] for o in base):
            out += [(1, *x) for x in bare(text, s) if _asked(x[0][x[1] : x[2]])]
    out += [(0, text, a, b, False) for _, a, b in other_candidates(text, base) if ORDINARY.search(text[max(0, a - LEFT) : a])]
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out += [(0, text, *w, False) for w in words if all(b <= w[0] or a >= w[1] for _, a, b in base)]
    return [(y, window(t, a, b), shape(t[a:b]), m) for y, t, a, b, m in out]


def _asked(value: str) -> bool:
    return len(value) >= LEAST_ASSIGN and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def dealt(rows: DataFrame, blocks: int, n: dict[int, int]) -> DataFrame:
    """rows with their block; those of a label (n: how many there are) of which not every block would have BLOCK_OF, in as many further ones."""
    copies = {k: min(blocks, max(1, math.ceil(blocks * BLOCK_OF / m))) for k, m in n.items()}
    more = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == 1, copies[1]).otherwise(copies[0]) - 1))
    return rows.withColumn("block", more).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "window", "masked") % blocks + F.col("block"), F.lit(blocks)).cast("int"))


def fit(docs: DataFrame, recall: float = 0.98, seed: int = 5) -> Scanner | None:
    """docs: doc_id, text. Only parameters, which are of fixed size, and counts reach the driver."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_cache("secrets")
        for pdf in pieces(batches, "text"):
            out = [x for t in pdf["text"] if t for x in examples(t)]
            yield pd.DataFrame(out, columns=["y", "window", "shape", "masked"])

    found = docs.select("text").mapInPandas(rows, "y int, window string, shape int, masked boolean").distinct()
    found = materialize(found.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "window", "masked"), F.lit(4)).cast("int")), "findings")
    n = {(r.part, r.y): r for r in found.groupBy("part", "y").agg(F.count("*").alias("n"), F.sum(F.length("window")).alias("points")).collect()}
    train = {y: sum(n[k, y].n for k in (0, 1) if (k, y) in n) for y in (0, 1)}
    if not all(train.values()) or not all((2, y) in n for y in (0, 1)):
        discard(found)
        return None
    blocks = max(-(-max(train.values()) // BLOCK_ROWS), -(-sum(r.points for (k, _), r in n.items() if k < 2) // BLOCK_POINTS))
    taken = dealt(found.where("part < 2"), blocks, train).repartition(blocks, "block")
    p = initial(seed)
    for k in range(ROUNDS):
        p = _round(taken, p, seed + k)

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_cache("secrets")
        for pdf in pieces(batches, "window"):
            yield pdf.drop(columns="window").assign(step=step_of(outputs(p, list(pdf["window"]))))

    judged_ = found.where("part > 1").mapInPandas(steps, "y int, shape int, masked boolean, part int, step long")
    counts = judged_.groupBy("part", "y", "shape", "masked", "step").agg(F.count("*").alias("n")).toPandas()
    discard(found)
    return judge(p, counts.sort_values(["part", "step", "y", "shape", "masked"]), recall)


def _round(taken: DataFrame, p: dict[str, np.ndarray], seed: int) -> dict[str, np.ndarray]:
    """The mean of what the blocks come to from p."""

    def steps(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        sole_cache("secrets")
        pdf = pdf.sort_values(["window", "y", "shape", "masked"])
        q = taught(p, list(pdf["window"]), pdf["y"].to_numpy(), seed + ROUNDS * int(key[0]))
        flat = np.concatenate([a.ravel() for a in q.values()])
        return pd.DataFrame({"i": np.arange(len(flat)), "v": np.rint(flat * UNIT).astype(np.int64)})

    means = taken.groupBy("block").applyInPandas(steps, "i int, v long").groupBy("i").agg(F.sum("v").alias("v"), F.count("*").alias("n")).orderBy("i").toPandas()
    flat, out, at = means["v"].to_numpy(np.float64) / means["n"].to_numpy() / UNIT, {}, 0
    for k, a in p.items():
        out[k] = flat[at : at + a.size].reshape(a.shape)
        at += a.size
    return out


def scan(docs: DataFrame, scanner: Scanner | None) -> DataFrame:
    """docs: doc_id, text. Adds the columns of the result to doc_id, one row in, one row out.

    probabilities: of the spans, in their order; null without a scanner.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner)  # of fixed size
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "probabilities"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_cache("secrets")
        model = shared.value
        for pdf in pieces(batches, "text"):
            out = []
            for i, found in zip(pdf["doc_id"], judged(model, [t or "" for t in pdf["text"]]), strict=True):
                spans = [s for s, _ in found]
                base = [s for s in spans if s[0] != "model"]
                kinds = [k for k, _, _ in base]
                out.append((i, *(kinds.count(k) for k in ("assign", "access", "hex")), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base), [q for _, q in found] if model else None))
            yield pd.DataFrame(out, columns=names)

    # ids as text, which pandas keeps whole beside a null
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, probabilities array<double>"
    )
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def masked(docs: DataFrame, scanner: Scanner | None, mask: str = "[secret]") -> DataFrame:
    """docs with every found span of `text` replaced by a mask; all else as it is. Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def without(text: str, spans: list[Span]) -> str:
        parts, at = [], 0
        for _, a, b in spans:
            if a >= at:
                parts += [text[at:a], mask]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        sole_cache("secrets")
        some = [t or "" for t in texts]
        found = judged(shared.value, some)
        return pd.Series([None if t is None else without(x, [s for s, _ in f]) for t, x, f in zip(texts, some, found, strict=True)], dtype=object)

    return docs.withColumn("text", cleaned("text"))

"""Repeated passages by a sparse enhanced suffix array.

Any two equal strings of `least` bytes hold the same anchor at the same place: the
GRAM bytes of smallest hash among all inside (the leftmost of equals). So it is enough
to compare suffixes that start at anchors which recur, with the text around them that
the strings anchored there can reach (their context). One shuffle counts anchors, a
second brings together those that recur. Then

* occurrences with an equal context are one; all but the first are covered whole;
* the different contexts of an anchor are a block: their suffixes from the anchor on
  are sorted, common prefixes of neighbours give the tree of prefix intervals in one
  scan with a stack; an interval's members are split by how far they also agree to the
  left of the anchor, again by sorting and a scan. Each part is a maximal repeat with
  all its occurrences, not only neighbours; those of `least` bytes and more cover all
  of their occurrences but the first.
* Blocks of more than BLOCK contexts are never gathered: their strings of `least`
  bytes are grouped by hash, aggregated before the shuffle, with equal results and
  without the tree.

"First" is the smaller doc_id, then the earlier start. A doc_id names one document:
rows that repeat it are the same document and get the same result. Rows with a null
id match nothing. Null texts are empty. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import materialize, needed, on_salted, pieces
from hitloom.llm.near_dedup import mixed, odd

GRAM = 24
BLOCK = 4096
BYTES, FACTORS = odd(256, 31), odd(8, 32)
STEP = int(odd(1, 33)[0])
BACK = pow(STEP, -1, 2**64)
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.array([1] + [x] * (n - 1), np.uint64)) for x in (STEP, BACK))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(14, (n - 1).bit_length()))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM = 16 + 8 bytes from each place on."""
    x, n = BYTES[raw], len(raw)
    for k, w in enumerate((1, 2, 4)):
        x = x[:-w] * FACTORS[k] + x[w:]
    y = x[:-8] * FACTORS[3] + x[8:]
    return mixed(y[: n - 23] * FACTORS[4] + x[16 : n - 7])


class Sums:
    """Hashes of any range of a sequence, from running sums."""

    def __init__(self, g: np.ndarray):
        self.up, self.down = powers(len(g) + 1)
        self.sums = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(g * self.up[: len(g)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * FACTORS[5])


def anchors(raw: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes of all places; of each anchor its place and the first and last start of a string anchored there."""
    n, wide = len(raw), least - GRAM + 1
    g = gram_hashes(raw)
    m = (g & HIGH) | np.arange(len(g), dtype=np.uint64)
    w = 1
    while 2 * w <= wide:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    starts = n - least + 1
    m = np.minimum(m[:starts], m[wide - w : wide - w + starts])
    at = (m & LOW).astype(np.int64)
    lo = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return g, at[lo], lo, np.concatenate([lo[1:] - 1, [starts - 1]]), g[at[lo]]


def raw_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def packed(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return a << 20 | (a - lo) << 10 | (hi - lo)


def unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, back, wide = p >> 20, p >> 10 & 1023, p & 1023
    return a, a - back, a - back + wide


def anchor_hashes(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, "text", 4_000_000):
            found = [anchors(np.frombuffer(raw, np.uint8), least)[4] for raw in map(raw_of, pdf["text"]) if len(raw) >= least]
            if found:
                yield pd.DataFrame({"h": np.concatenate(found).astype(np.int64)})

    return docs.select("text").mapInPandas(run, "h long")


def anchor_rows(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, "text", 4_000_000):
            out = []
            for i, raw in zip(pdf["doc_id"], map(raw_of, pdf["text"]), strict=True):
                if len(raw) >= least:
                    g, a, lo, hi, h = anchors(np.frombuffer(raw, np.uint8), least)
                    out.append((h.astype(np.int64), Sums(g)(lo, hi + least - GRAM + 1).astype(np.int64), np.full(len(a), i, np.int64), packed(a, lo, hi)))
            if out:
                yield pd.DataFrame(dict(zip(("h", "context", "doc", "place"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return docs.select("doc_id", "text").mapInPandas(run, "h long, context long, doc long, place long")


# --- one block ---------------------------------------------------------------------


def common(x: bytes, y: bytes) -> int:
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Value, first and last member of every prefix interval; lcp[i] is that of members i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            v, first = stack.pop()
            yield v, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def ordered(members: list[int], strings: list[bytes]) -> tuple[list[int], list[int]]:
    members = sorted(members, key=strings.__getitem__)
    return members, [common(strings[a], strings[b]) for a, b in zip(members, members[1:], strict=False)]


def maximal_repeats(left: list[bytes], right: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """Bytes to the left of the anchor (left: reversed), bytes from it on, and the members that agree in them."""
    order, lcp = ordered(list(range(len(right))), right)
    for r, i, j in intervals(lcp):
        inside, back = ordered(order[i : j + 1], left)
        for far, k, m in intervals(back):
            if far + r >= least:
                yield far, r, inside[k : m + 1]


def block_covers(docs: list[int], places: list[int], contexts: list[bytes], least: int) -> Iterator[tuple[int, int, int]]:
    """doc, start, end of what is covered in the contexts of one anchor, in order of doc and place."""
    a, lo, _ = unpacked(np.array(places, np.int64))
    left = [c[: x - y][::-1] for c, x, y in zip(contexts, a, lo, strict=True)]
    right = [c[x - y :] for c, x, y in zip(contexts, a, lo, strict=True)]
    spans: dict[int, list[tuple[int, int]]] = {}
    for back, ahead, members in maximal_repeats(left, right, least):
        first = min(members)
        for m in members:
            if m != first:
                spans.setdefault(m, []).append((int(a[m]) - back, int(a[m]) + ahead))
    for m, found in spans.items():
        yield from ((docs[m], x, y) for x, y in merged(found))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# --- the whole ---------------------------------------------------------------------


def covers(docs: DataFrame, least: int) -> DataFrame:
    """doc, start, end (bytes) of strings of `least` bytes or more that also start earlier."""
    if least - GRAM > 1022:
        raise ValueError("strings of more than 1046 bytes don't fit in packed places")
    again = materialize(anchor_hashes(docs, least).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "again")
    total = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = materialize(on_salted(anchor_rows(docs, least), again, ["h"], total, ("doc", "place")), "anchors")
    first = met.groupBy("h", "context").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n"))
    first = materialize(first.select("h", "context", "first.*", "n"), "contexts")
    f = first.select("h", "context", F.col("doc").alias("doc0"), F.col("place").alias("place0"), "n")
    same = on_salted(met, f.where("n > 1"), ["h", "context"], total, ("doc", "place")).where("doc > doc0 OR (doc = doc0 AND place > place0)")
    a = F.shiftright("place", 20)
    lo = a - F.shiftright("place", 10).bitwiseAND(1023)
    whole = same.select("doc", lo.alias("start"), (lo + F.col("place").bitwiseAND(1023) + least).alias("end"))

    several = first.groupBy("h").agg(F.count("*").alias("members")).where("members > 1")
    wanted = first.join(several, "h").groupBy("doc").agg(F.collect_list(F.struct("h", "place", "members")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    texts = needed(docs.select("doc_id", "text"), wanted.select(F.col("doc").alias("doc_id"))).dropDuplicates(["doc_id"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, "text", 2_000_000):
            out = []
            for i, text, rows in zip(pdf["doc"], pdf["text"], pdf["wanted"], strict=True):
                raw = raw_of(text)
                for r in rows:
                    _, lo, hi = unpacked(np.int64(r["place"]))
                    out.append((r["h"], i, r["place"], r["members"], raw[lo : hi + least]))
            yield pd.DataFrame(out, columns=["h", "doc", "place", "members", "bytes"])

    contexts = wanted.join(texts.withColumnRenamed("doc_id", "doc"), "doc").select("doc", "text", "wanted")
    contexts = materialize(contexts.mapInPandas(cut, "h long, doc long, place long, members long, bytes binary"), "blocks")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for pdf in batches:
            out = []
            for h, d, p, c in zip(pdf["h"], pdf["doc"], pdf["place"], pdf["bytes"], strict=True):
                if h != key:
                    out += block_covers(*map(list, zip(*rows, strict=True)), least) if len(rows) > 1 else []
                    key, rows = h, []
                rows.append((d, p, c))
            yield pd.DataFrame(out, columns=["doc", "start", "end"])
        if len(rows) > 1:
            yield pd.DataFrame(list(block_covers(*map(list, zip(*rows, strict=True)), least)), columns=["doc", "start", "end"])

    blocks = contexts.where(F.col("members") <= BLOCK).repartition("h").sortWithinPartitions("h", "doc", "place")
    parts = blocks.select("h", "doc", "place", "bytes").mapInPandas(solve, "doc long, start long, end long")

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, d, p, c in zip(pdf["h"], pdf["doc"], pdf["place"], pdf["bytes"], strict=True):
                _, lo, hi = unpacked(np.int64(p))
                s = np.arange(hi - lo + 1)
                yield pd.DataFrame({"h": h, "string": Sums(gram_hashes(np.frombuffer(c, np.uint8)))(s, s + least - GRAM + 1).astype(np.int64), "doc": d, "start": lo + s})

    large = contexts.where(F.col("members") > BLOCK).mapInPandas(strings, "h long, string long, doc long, start long")
    earliest = large.groupBy("h", "string").agg(F.min(F.struct("doc", "start")).alias("e")).select("h", "string", F.col("e.doc").alias("doc0"), F.col("e.start").alias("start0"))
    rest = large.join(earliest, ["h", "string"]).where("doc <> doc0 OR start <> start0").select("doc", "start", (F.col("start") + least).alias("end"))
    return whole.unionByName(parts).unionByName(rest)


def without_repeats(docs: DataFrame, least: int = 100) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row in, one row out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = covers(docs.where("doc_id IS NOT NULL"), least)
    spans = materialize(spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "covers")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, "text", 2_000_000):
            out = []
            for i, text, rows in zip(pdf["doc"], pdf["text"], pdf["spans"], strict=True):
                raw, at, kept = raw_of(text), 0, hashlib.sha256()
                found = merged([(r["start"], r["end"]) for r in rows])
                for a, b in found:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((i, sum(b - a for a, b in found), len(found), kept.hexdigest()))
            yield pd.DataFrame(out, columns=["doc", "n_removed", "n_spans", "sha"])

    texts = needed(docs, spans.select(F.col("doc").alias("doc_id"))).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "doc")
    changed = spans.join(texts, "doc").select("doc", "text", "spans").mapInPandas(cut, "doc long, n_removed long, n_spans long, sha string")
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    return plain.join(changed, plain["doc_id"] == changed["doc"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
    )

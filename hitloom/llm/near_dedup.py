"""Near duplicates by MinHash with tensored banding, verified on full sets.

Two collections of PARTS small hashes each (every one of them ROWS minhashes) are
paired: table (i, j) has the key (left i, right j). PARTS squared tables thus cost
2 * PARTS * ROWS minhashes; a pair of similarity s meets in one with probability
(1 - (1 - s**ROWS)**PARTS)**2, which is 0.9994 at 0.8 and 0.99998 at 0.85.

Documents with equal sets are one class from the start. Links are found in two steps:

1. in every bucket each class is tried against the smallest one; the links that hold
   give components;
2. where different components still share a bucket, single classes are tried in pairs
   (each in the first table that it meets in, large buckets a block by a block), and a class of the smaller component against all members of the larger one, in
   blocks that count common runs through an index and emit links only.

Pairs are dropped before their texts are read only by size, which is exact, and by a
sketch of 128 further minhashes of two bits each: a pair of similarity 0.8 falls short
of its limit with a chance of about 5e-6. No link is left out because a bucket is
large, and members of one component never meet in pairs. Links are confirmed on the
full sets of both texts.

Words and runs are told apart by 64-bit hashes. A text's set: its distinct runs of `words` words, lower case in ASCII; with fewer words
the whole sequence; without words it is empty and linked with nothing. A doc_id names
one document; rows with a null id are linked with nothing. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import materialize, needed, on_salted, pieces, salted, sole_cache
from hitloom.llm.graph import components

PARTS, ROWS = 8, 2
HASHES = 2 * PARTS * ROWS
SKETCH = 128
#: equal two-bit parts that similar pairs have at least, but for a chance of about 5e-6
SKETCH_LEAST = 90
#: classes in a block of step 2
BLOCK = 256
#: parts in which the pairs of one class are dealt
SALTS = 64
KEEP = 250_000


def odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


FACTORS, SHIFTS = odd(HASHES, 11), odd(64, 12)
SKETCH_FACTORS = (odd(SKETCH, 13) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class Words(dict):
    """64-bit hashes of words, kept as they recur."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEEP:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def known_words() -> Words:
    return Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's set."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known_words().__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    total = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        total += mixed(h[i : len(h) - k + 1 + i] * SHIFTS[i])
        total *= SHIFTS[32 + i]
    return np.unique(mixed(total))


def minhashes(s: np.ndarray) -> np.ndarray:
    """HASHES minima; s must not be empty."""
    out = np.full(HASHES, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 4096):
        out = np.minimum(out, (s[None, i : i + 4096] * FACTORS[:, None]).min(axis=1))
    return out


def part_hashes(m: np.ndarray) -> np.ndarray:
    """PARTS left and PARTS right hashes, each of ROWS minima."""
    return mixed(m.reshape(2 * PARTS, ROWS) * SHIFTS[None, :ROWS]).sum(axis=1, dtype=np.uint64)


def table_keys(m: np.ndarray) -> np.ndarray:
    """PARTS squared keys: each left part with each right part."""
    parts = part_hashes(m)
    left, right = mixed(parts[:PARTS] + SHIFTS[40 : 40 + PARTS]), mixed(parts[PARTS:] + SHIFTS[48 : 48 + PARTS])
    return mixed(left[:, None] * SHIFTS[60] + right[None, :]).ravel()


def sketch(s: np.ndarray) -> np.ndarray:
    """Two bits of each of SKETCH minima, 32 to a number."""
    high = (s >> np.uint64(32)).astype(np.uint32)
    m = np.full(SKETCH, np.iinfo(np.uint32).max)
    for i in range(0, len(high), 4096):
        m = np.minimum(m, (high[None, i : i + 4096] * SKETCH_FACTORS[:, None]).min(axis=1))
    bits = mixed(m.astype(np.uint64)) & np.uint64(3)
    return (bits.reshape(-1, 32) << (2 * np.arange(32, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).astype(np.int64)


def prints(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_cache("words", known_words().clear)
        for pdf in pieces(batches, "text"):
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingles(text, words)
                if len(s):
                    m = minhashes(s)
                    out.append((i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(s), table_keys(m).astype(np.int64), part_hashes(m).astype(np.uint32).view(np.int32)))
                else:
                    out.append((i, 0, None, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n", "set", "sketch", "keys", "parts"])

    # ids as text, which pandas keeps whole beside a null
    found = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n long, set binary, sketch array<long>, keys array<long>, parts array<int>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def texts_of(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """doc_id, text of the wanted documents, written once."""
    return materialize(needed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids), name)


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs a, b whose full sets have 100 * common >= percent * union.

    The pairs of one a are dealt in SALTS parts; its text goes once to each, followed by those of b.
    """
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), "texts")
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    tails = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    heads = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(tails).withColumn("head", F.col("b").isNull()).withColumn("b", F.coalesce("b", "a"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("head"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_cache("words", known_words().clear)
        s = np.empty(0, np.uint64)
        for pdf in batches:
            keep = []
            for head, text in zip(pdf["head"], pdf["text"], strict=True):
                t = shingles(text, words)
                if head:
                    s = t
                common = 0 if head else len(np.intersect1d(s, t, assume_unique=True))
                keep.append(not head and 100 * common >= percent * (len(s) + len(t) - common))
            yield pdf.loc[keep, ["a", "b"]]

    return rows.select("a", "b", "head", "text").mapInPandas(run, "a long, b long").distinct()


def block_links(members: list[np.ndarray], asked: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """For each asked set one member that it is similar to, if any: (place asked, place of the member)."""
    sizes = np.array([len(s) for s in members])
    known, place = np.unique(np.concatenate(members), return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner = np.repeat(np.arange(len(members)), sizes)[order]
    begin = np.searchsorted(place[order], np.arange(len(known) + 1))
    out = []
    for i, s in enumerate(asked):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        at = at[known[at] == s]
        if len(at):
            n = begin[at + 1] - begin[at]
            rows = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owner[rows], minlength=len(members))
            like = np.flatnonzero(100 * common >= percent * (sizes + len(s) - common))
            if len(like):
                out.append((i, int(like[0])))
    return out


def joined(asked: DataFrame, members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links a, b from asked classes to members of a component.

    asked: of (component), doc_id. members: of, doc_id. Both sides are dealt in blocks;
    every block of one meets every block of the other.
    """

    def dealt(x: DataFrame, name: str) -> DataFrame:
        return x.groupBy("of").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    n = dealt(members, "n_m").join(dealt(asked, "n_q"), "of")
    m, q = salted(members, n, "of", "doc_id"), salted(asked, n, "of", "doc_id")
    m = m.withColumn("bm", F.pmod(F.xxhash64("doc_id"), "n_m").cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1))).withColumn("asked", F.lit(False))
    q = q.withColumn("bq", F.pmod(F.xxhash64("doc_id"), "n_q").cast("int")).withColumn("bm", F.explode(F.sequence(F.lit(0), F.col("n_m") - 1))).withColumn("asked", F.lit(True))
    rows = materialize(m.select("of", "bm", "bq", "asked", "doc_id").unionByName(q.select("of", "bm", "bq", "asked", "doc_id")), "blocks")
    texts = texts_of(docs, rows.select("doc_id"), "block-texts")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = pdf[~pdf["asked"]], pdf[pdf["asked"]]
        found = block_links([shingles(t, words) for t in mine["text"]], [shingles(t, words) for t in theirs["text"]], percent) if len(mine) and len(theirs) else []
        return pd.DataFrame({"a": [theirs["doc_id"].iloc[i] for i, _ in found], "b": [mine["doc_id"].iloc[j] for _, j in found]}, dtype="int64")

    return rows.join(texts, "doc_id").groupBy("of", "bm", "bq").applyInPandas(compare, "a long, b long")


def alike(a: str, b: str, percent: int, exact: bool) -> str:
    """Whether two rows with n and sketch can be similar: by size for certain, by sketch almost so."""
    by_size = f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
    if exact:
        return by_size
    equal = []
    for i in range(SKETCH // 32):
        differs = f"({a}.sketch[{i}] ^ {b}.sketch[{i}])"
        equal.append(f"bit_count(({differs} | shiftrightunsigned({differs}, 1)) & 6148914691236517205L)")
    return f"{by_size} AND {SKETCH} - ({' + '.join(equal)}) >= {SKETCH_LEAST}"


def first_met() -> str:
    """Whether table t is the first that x and y share: no earlier left part and no earlier right part is equal."""
    left = [f"(x.t div {PARTS} <= {i} OR x.parts[{i}] <> y.parts[{i}])" for i in range(PARTS)]
    right = [f"(x.t % {PARTS} <= {i} OR x.parts[{PARTS + i}] <> y.parts[{PARTS + i}])" for i in range(PARTS)]
    return " AND ".join(left + right)


def rare_keys(docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """key, t, rep: each class's rarest runs, so many that any two similar sets share one of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_cache("words", known_words().clear)
        for pdf in pieces(batches, "text", 1_000_000):
            sets = [shingles(t, words).astype(np.int64) for t in pdf["text"]]
            yield pd.DataFrame({"rep": np.repeat(pdf["doc_id"].to_numpy(), [len(s) for s in sets]), "key": np.concatenate(sets)})

    every = materialize(texts_of(docs, reps.select(F.col("rep").alias("doc_id")), "rep-texts").mapInPandas(run, "rep long, key long").distinct(), "runs")
    counted = every.join(every.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"), "key")
    sizes = every.groupBy("rep").agg(F.count("*").alias("n"))
    # runs of one set alone come first in the order, so they take places of its beginning
    alone = sizes.join(counted.groupBy("rep").agg(F.count("*").alias("shared"), F.sort_array(F.collect_list(F.struct("often", "key"))).alias("runs")), "rep")
    places = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("shared"))
    begin = alone.where(places > 0).select("rep", F.explode(F.slice("runs", F.lit(1), places.cast("int"))).alias("run"))
    return begin.select("rep", F.lit(0).alias("t"), F.col("run.key").alias("key"))


def met_pairs(single: DataFrame, percent: int, exact: bool) -> DataFrame:
    """a < b: classes that share a bucket and can be similar.

    A bucket is dealt in blocks of about BLOCK classes, and a task holds two of them.
    """
    blocks = single.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = single.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    last = F.col("blocks") - 1
    x = dealt.withColumn("low", F.col("block")).withColumn("high", F.explode(F.sequence("block", last)))
    y = dealt.withColumn("high", F.col("block")).withColumn("low", F.explode(F.sequence(F.lit(0), "block")))
    met = F.expr(f"x.key = y.key AND x.low = y.low AND x.high = y.high AND (x.low < x.high OR x.rep < y.rep) AND {alike('x', 'y', percent, exact)} AND {'TRUE' if exact else first_met()}")
    found = x.alias("x").join(y.alias("y"), met)
    return found.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id, kept; one row in, one row out.

    exact: candidates are sets that share one of their rarest runs, in place of a bucket, and
    no sketch is asked. Then no link is left to chance, at the cost of a shuffle of all runs.
    """
    known = materialize(prints(docs, words), "prints")
    named = known.where("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    # the class's smallest row brings its keys
    reps = named.join(classes.select(F.col("rep").alias("doc_id"), F.col("set").alias("of")), "doc_id").where(F.col("set") == F.col("of"))
    reps = materialize(reps.dropDuplicates(["doc_id", "set"]).select(F.col("doc_id").alias("rep"), "n", "sketch", "keys", "parts"), "reps")
    rows = rare_keys(docs, reps, words, percent) if exact else reps.select(F.posexplode("keys").alias("t", "key"), "rep")
    leads = rows.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("most")).where("lead < most").select("key", "lead")
    met = materialize(rows.join(leads, "key"), "buckets")
    traits = reps.select("rep", "n", "sketch")

    # step 1
    stars = met.where("lead < rep").select("lead", "rep").distinct().alias("s")
    stars = stars.join(traits.alias("x"), F.expr("s.lead = x.rep")).join(traits.alias("y"), F.expr("s.rep = y.rep")).where(alike("x", "y", percent, exact))
    tried = materialize(stars.select(F.col("s.lead").alias("a"), F.col("s.rep").alias("b")), "stars")
    links = materialize(verified(tried, docs, words, percent), "links")
    first = components(links).select(F.col("node").alias("rep"), F.col("component"))

    # step 2
    sizes = first.groupBy("component").agg(F.count("*").alias("size"))
    sized = salted(first, sizes, "component", "rep")
    labelled = met.select("key", "t", "rep").join(sized, "rep", "left").select("key", "t", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    labelled = materialize(labelled, "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    apart = materialize(labelled.join(open_keys, "key"), "apart")
    single = materialize(apart.where("size = 1").select("key", "t", "rep").join(reps.select("rep", "n", "sketch", "parts"), "rep"), "single")
    pairs = met_pairs(single, percent, exact).join(tried, ["a", "b"], "left_anti")
    more = verified(materialize(pairs, "pairs"), docs, words, percent)

    larger = apart.where("size > 1").select("key", F.col("component").alias("of"), F.col("size").alias("of_size")).distinct()
    asked = apart.join(larger, "key").where("component <> of AND (of_size > size OR (of_size = size AND of < component))")
    asked = materialize(asked.select("of", F.col("rep").alias("doc_id")).distinct(), "asked")
    members = salted(first.select(F.col("component").alias("of"), F.col("rep").alias("doc_id")), asked.select("of").distinct(), "of", "doc_id")
    found = joined(asked, members, docs, words, percent)
    whole = components(links.unionByName(materialize(more.unionByName(found), "links")))

    named_class = classes.join(whole, classes["rep"] == whole["node"], "left").select("set", F.coalesce("component", "rep").alias("component"), "n")
    rows = known.select("doc_id", F.col("n").alias("n_shingles"), "set", F.monotonically_increasing_id().alias("_row"))
    found = on_salted(rows, named_class, ["set"], known.count(), ("_row",), "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

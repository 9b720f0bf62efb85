"""Phrase collocations, counted in tries that spill.

Three passes over the texts, each a count of phrases one word longer that starts from
what the pass before has found to be frequent:

1. words of each language, with a 64-bit hash as their number; that the numbers tell the
   words of a language apart is checked on the table of all words, and else another seed
   is taken;
2. pairs of frequent words;
3. triples of frequent pairs.

A task counts in one trie a language (a HAT-trie): the first word leads to a hash
container of the words behind it; a container above BURST entries is burst into one for
each of its next words. At MOST entries whole subtrees, the largest first, leave as
sorted runs until half are left, the rest at the end. Runs go to partitions by prefix
(all words but the last, and the first bits of the last one's number, so that the phrases
of one hot prefix are dealt out too) and are merged there. What a phrase of frequent
parts is, a task reads from a bit set of BITS bits, which never misses a frequent one;
other bits that are set only mean counts that the merge drops. Its size does not grow.

Text: A-Z in lower case, cut at `[.,;:!?\\x0A-\\x0D]` into pieces, these at spaces and tabs
into words. A null text is empty, a null language "und". Repeated rows count each. Long
texts are counted stretch by stretch. Products are decimals of 38 digits, exact up to
10^15 occurrences. Ties: as stated at score() and top(). Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.common import discard, materialize, on_salted, text_batches

BURST, MOST = 4_096, 1_000_000
BITS = 26
#: a task's word numbers: WIDTH bits each; all counts leave when it has met WORDS different ones, or their bytes
WIDTH, WORDS, WORD_BYTES = 21, 1 << 19, 64_000_000
STRETCH = 1 << 21
BREAK = b"\xff"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10 + b" ")


def bit(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """The place in the bit set of phrases, given the numbers of their words."""
    x = np.full(len(words[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for w in words:
        x = (x ^ w.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


class Burst(dict):
    """A burst container: a container for each next word."""


class Trie:
    """Counts of phrases of two or three words, given as numbers of WIDTH bits that are packed into one."""

    def __init__(self, words: int):
        self.below, self.root, self.sizes, self.entries = WIDTH * (words - 1), {}, {}, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: in order, each once."""
        if not len(keys):
            return
        first = keys >> self.below
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        rests, n = (keys & ((1 << self.below) - 1)).tolist(), counts.tolist()
        ends = [*starts[1:].tolist(), len(keys)]
        for word, a, b in zip(first[starts].tolist(), starts.tolist(), ends, strict=True):
            node = self.root.get(word)
            if node is None:
                node = self.root[word] = {}
            grown = 0
            if type(node) is Burst:
                for rest, c in zip(rests[a:b], n[a:b], strict=True):
                    box = node.setdefault(rest >> WIDTH, {})
                    rest &= (1 << WIDTH) - 1
                    grown += rest not in box
                    box[rest] = box.get(rest, 0) + c
            else:
                before = len(node)
                for rest, c in zip(rests[a:b], n[a:b], strict=True):
                    node[rest] = node.get(rest, 0) + c
                grown = len(node) - before
                if len(node) > BURST and self.below > WIDTH:
                    self.root[word] = burst(node)
            self.sizes[word] = self.sizes.get(word, 0) + grown
            self.entries += grown

    def spill(self, left: int = 0, some: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs (keys, counts) of whole subtrees, the largest first, until at most so many entries are left."""
        keys: list[int] = []
        counts: list[int] = []
        for word in sorted(self.sizes, key=self.sizes.__getitem__, reverse=True):
            if self.entries <= left:
                break
            node = self.root.pop(word)
            self.entries -= self.sizes.pop(word)
            above = word << self.below
            for base, box in [(above | w << WIDTH, box) for w, box in node.items()] if type(node) is Burst else [(above, node)]:
                keys += [base | rest for rest in box]
                counts += box.values()
            if len(keys) >= some:
                yield ordered(keys, counts)
                keys, counts = [], []
        if keys:
            yield ordered(keys, counts)


def ordered(keys: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.array(keys, np.int64), np.array(counts, np.int64)
    order = np.argsort(k)
    return k[order], n[order]


def burst(box: dict[int, int]) -> Burst:
    out = Burst()
    for rest, n in box.items():
        out.setdefault(rest >> WIDTH, {})[rest & ((1 << WIDTH) - 1)] = n
    return out


class Words(dict):
    """Bytes of a word to its number in this task, 0 for breaks and words that `frequent` lacks."""

    def __init__(self, lang: str, seed: int, frequent: np.ndarray | None):
        super().__init__({BREAK: 0})
        self.lang, self.seed, self.frequent = lang, seed, frequent
        self.names, self.hashes, self.size = [BREAK], [0], 0

    def learn(self, found: list[bytes]) -> None:
        new = [*set(found).difference(self)]
        self.size += sum(map(len, new))
        h = np.array([xxhash.xxh64_intdigest(w, self.seed) for w in new], np.uint64).view(np.int64)
        if self.frequent is not None and new:
            fine = is_set(self.frequent, bit(self.lang, [h]))
            self.update((w, 0) for w, ok in zip(new, fine.tolist(), strict=True) if not ok)
            new, h = [w for w, ok in zip(new, fine.tolist(), strict=True) if ok], h[fine]
        self.update(zip(new, range(len(self.names), len(self.names) + len(new)), strict=True))
        self.names += new
        self.hashes += h.tolist()


def stretches(texts: list[str], carry: int) -> Iterator[list[bytes]]:
    """Words and breaks of texts, some at a time, the last `carry` of one stretch again at the start of the next."""
    data = (b" " + BREAK + b" ").join(t.encode("utf-8").translate(LOWER).replace(BREAK, b" " + BREAK + b" ") for t in texts)
    begin, last = 0, [BREAK]
    while begin < len(data):
        end = begin + STRETCH
        end = len(data) if end >= len(data) else (data.find(b" ", end) + 1 or len(data))
        found = last + data[begin:end].split()
        yield found
        begin, last = end, found[len(found) - carry :] if carry else []


class Counter:
    """Phrases of n words in one language, as far as their words (and, for three, their pairs) are frequent."""

    def __init__(self, lang: str, n: int, seed: int, words: np.ndarray | None, pairs: np.ndarray | None):
        self.lang, self.n, self.pairs = lang, n, pairs
        self.words = Words(lang, seed, words)
        self.counts = np.zeros(0, np.int64)
        self.trie = Trie(n)

    def full(self) -> bool:
        return len(self.words) > WORDS or self.words.size > WORD_BYTES

    def add(self, found: list[bytes]) -> None:
        self.words.learn(found)
        x = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        if self.n == 1:
            more = np.bincount(x, minlength=len(self.words.names))
            more[: len(self.counts)] += self.counts
            self.counts = more
            return
        fine = (x[:-1] > 0) & (x[1:] > 0)
        if self.n == 3:
            h = np.array(self.words.hashes, np.int64)[x]
            fine[fine] = is_set(self.pairs, bit(self.lang, [h[:-1][fine], h[1:][fine]]))
            fine = fine[:-1] & fine[1:]
        at = np.flatnonzero(fine)
        key = x[at]
        for k in range(1, self.n):
            key = key << WIDTH | x[at + k]
        self.trie.add(*np.unique(key, return_counts=True))

    def out(self, left: int = 0) -> Iterator[pa.RecordBatch]:
        """Rows of what leaves: all, or subtrees until `left` entries are left."""
        if self.n == 1:
            used = np.flatnonzero(self.counts[1:]) + 1
            for a in range(0, len(used), 100_000):
                part = used[a : a + 100_000]
                names = [self.words.names[i].decode("utf-8") for i in part.tolist()]
                yield batch(self.lang, [np.array(self.words.hashes, np.int64)[part]], self.counts[part], names)
            self.counts = np.zeros(0, np.int64)
            return
        h = np.array(self.words.hashes, np.int64)
        for keys, counts in self.trie.spill(left):
            yield batch(self.lang, [h[(keys >> (WIDTH * k)) & ((1 << WIDTH) - 1)] for k in reversed(range(self.n))], counts)


def batch(lang: str, words: list[np.ndarray], counts: np.ndarray, names: list[str] | None = None) -> pa.RecordBatch:
    columns = {"lang": pa.repeat(lang, len(counts)), **{f"w{k + 1}": pa.array(w) for k, w in enumerate(words)}, "n": pa.array(counts)}
    return pa.RecordBatch.from_pydict(columns | ({"word": pa.array(names, pa.string())} if names is not None else {}))


def counted(texts: DataFrame, n: int, seed: int, words=None, pairs=None) -> DataFrame:
    """Runs of counts of phrases of n words: lang, w1 to wn, n (and, for words, word). words, pairs: broadcast bit sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        for rows, part in text_batches(batches, "text"):
            by: dict[str, list[str]] = {}
            for lang, text in zip(rows.column(0).to_pylist(), part, strict=True):
                by.setdefault(lang, []).append(text)
            for lang, some in by.items():
                for found in stretches(some, n - 1):
                    if lang not in counters:
                        counters[lang] = Counter(lang, n, seed, words and words.value, pairs and pairs.value)
                    counters[lang].add(found)
                    # the bounds hold for all languages of a task together
                    if sum(len(c.words) for c in counters.values()) > WORDS or sum(c.words.size for c in counters.values()) > WORD_BYTES:
                        for c in counters.values():
                            yield from c.out()
                        counters = {}
                    elif sum(c.trie.entries for c in counters.values()) > MOST:
                        for c in counters.values():
                            yield from c.out(c.trie.entries // 2)
        for c in counters.values():
            yield from c.out()

    schema = "lang string, " + ", ".join(f"w{k} long" for k in range(1, n + 1)) + ", n long" + ", word string" * (n == 1)
    return texts.mapInArrow(run, schema)


def merged(runs: DataFrame, n: int, least: int) -> DataFrame:
    """Runs merged by prefix partition: the phrases that occur `least` times at least."""
    keys = [f"w{k}" for k in range(1, n + 1)]
    prefix = F.xxhash64("lang", *keys[:-1], F.shiftrightunsigned(keys[-1], 58))
    dealt = runs.withColumn("prefix", prefix).repartition("prefix")
    return dealt.groupBy("prefix", "lang", *keys).agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("prefix")


def bit_set(phrases: DataFrame, n: int):
    """Broadcast bit set (BITS) of phrases of n words; at most 2^(BITS - 6) places of 16 bytes reach the driver, a partition at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unique(np.concatenate([bit(lang, [p[f"w{k}"].to_numpy(np.int64) for k in range(1, n + 1)]) for lang, p in pdf.groupby("lang")])) if len(pdf) else np.empty(0, np.int64)
            place, start = np.unique(at >> 6, return_index=True)
            ones = np.left_shift(np.int64(1), at & 63)
            yield pd.DataFrame({"place": place, "bits": np.bitwise_or.reduceat(ones, start) if len(at) else ones})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({c: [pdf[c].to_numpy(np.int64).tobytes()] for c in ("place", "bits")})

    found = phrases.mapInPandas(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(1 << (BITS - 6), np.int64)
    for row in found.mapInPandas(packed, "place binary, bits binary").toLocalIterator():
        bits[np.frombuffer(row["place"], np.int64)] = np.frombuffer(row["bits"], np.int64)
    return phrases.sparkSession.sparkContext.broadcast(bits)


def word_table(texts: DataFrame) -> tuple[DataFrame, int]:
    """lang, w1, word, n of all words, and the first seed whose numbers tell the words of each language apart."""
    seed = 0
    while True:
        words = counted(texts, 1, seed).groupBy("lang", "w1", "word").agg(F.sum("n").alias("n"))
        words = materialize(words, "words")
        if words.groupBy("lang", "w1").count().where("count > 1").limit(1).count() == 0:
            return words, seed
        discard(words)
        seed += 1


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a^2 / (left right)), at most 1000000 as a is at most either part."""
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))) div (CAST({left} AS DECIMAL(15,0)) * CAST({right} AS DECIMAL(15,0))) AS BIGINT)")


def with_parts(rows: DataFrame, parts: DataFrame, on: list[str], by: str) -> DataFrame:
    """rows joined with a table of one row a key, keys that many rows share in parts by a hash of column `by`."""
    n = rows.groupBy(*on).agg(F.count("*").alias("n"))
    return on_salted(rows, parts.join(n, on), on, rows.count(), (by,))


def top(rows: DataFrame, n: int) -> DataFrame:
    """The n best rows of each language: by score, then a, both descending, then phrase (UTF-8 byte order). A language is cut down in parts first."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for parts in (256, 16):
        rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= n).drop("part")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= n)


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, inside: int = 50, most: int | None = 2000) -> DataFrame:
    """Phrases of two to `longest` (2 or 3) words that occur `least` times: lang, rank, phrase, a, l, r, n, score.

    The lowest-scoring cut counts, the earlier in a tie. Pairs inside a triple that occurs
    at least `inside` percent as often go. most: how many of a language, None for all.
    """
    if longest not in (2, 3):
        raise ValueError("phrases have two or three words at most")
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    words, seed = word_table(texts)
    frequent = words.where(F.col("n") >= least)
    single = bit_set(frequent.select("lang", "w1"), 1)
    pairs = materialize(merged(counted(texts, 2, seed, single), 2, least), "pairs")
    known = frequent.select("lang", "w1", F.col("word").alias("word1"), F.col("n").alias("f1"))
    named = with_parts(pairs.withColumnRenamed("n", "a"), known, ["lang", "w1"], "w2")
    named = materialize(with_parts(named, known.withColumnsRenamed({"w1": "w2", "word1": "word2", "f1": "f2"}), ["lang", "w2"], "w1"), "named-pairs")
    found = named.select("lang", "w1", "w2", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("a", "f1", "f2").alias("score"))
    scratch = [pairs, named]
    if longest == 3:
        double = bit_set(pairs, 2)
        triples = materialize(merged(counted(texts, 3, seed, single, double), 3, least).withColumnRenamed("n", "a"), "triples")
        scratch.append(triples)
        head = named.select("lang", "w1", "w2", "word1", "word2", "f1", F.col("a").alias("f12"))
        tail = named.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("word2").alias("word3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
        whole = with_parts(with_parts(triples, head, ["lang", "w1", "w2"], "w3"), tail, ["lang", "w2", "w3"], "w1")
        whole = whole.withColumns({"s1": score("a", "f1", "f23"), "s2": score("a", "f12", "f3")})
        later = F.col("s2") < F.col("s1")
        pick = lambda second, first, name: F.when(later, F.col(second)).otherwise(F.col(first)).alias(name)
        longer = whole.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", pick("f12", "f1", "l"), pick("f3", "f23", "r"), F.least("s1", "s2").alias("score"))
        over = triples.select("lang", "w1", "w2", "a").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
        kept = found.join(over, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
        found = kept.select(*longer.columns).unionByName(longer)
    best = top(found.drop("w1", "w2"), most) if most is not None else found.drop("w1", "w2").withColumn("rank", F.lit(None).cast("int"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    # one row a language on one side, `most` a language on the other
    out = materialize(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for t in (words, *scratch):
        discard(t)
    return out

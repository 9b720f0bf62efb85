"""Toxicity from two class-conditional Kneser-Ney models.

An expression is a word (letters and digits, lower case), spelt with a mark before and
after it. Each class has a model of the next symbol after the ORDER - 1 last ones,

    P(x | h) = max(n(h x) - D, 0) / n(h) + sum of min(n(h .), D) / n(h) * S(x | last two)

with counts n of the class over all training rows and one shared backoff S: an
interpolated Kneser-Ney model of up to two symbols of context, from how many different
sequences each one ends. D is 3, as a class's rare sequences come from copies and chance:
what a class has seen up to three times is judged by the shared backoff alone. A word's
difference is that of its two log-likelihoods, toxic minus ordinary; whole words count,
however long. A document's score is logistic in the sum of what its words' differences
exceed MARGIN by, over its length in symbols (both logarithmic, see feature()).

Counts cover every training row and stay distributed tables. As sequences seen D times at
most in both classes have no term of their own, the model that scores is a table of the
others and of their contexts. It is broadcast when it has MOST rows at most; a larger one
stays distributed and is joined with the documents' distinct words (`joined`), with equal
results. Logarithms are whole numbers of 1 / UNIT, so no order of rows changes a score.

The two numbers of the logistic are fitted on a bounded sample: of the fifth of training
rows by a hash, the `per_class` rows of smallest hash of each label, scored by a model
without that fifth. Without training rows of both labels every score is 0. Null texts are
empty; equal texts have equal scores. A null id is not held out and gets a row as well.
Rows that repeat an id each get one; labels that repeat one count once, the larger.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import materialize, pieces, sole_cache, text_batches

WORD = re.compile(r"[^\W_]+")
FIRST, LAST = "^", "$"
#: symbols of a sequence, the next one included
ORDER = 8
DISCOUNT = 3
SHARED_DISCOUNT = 0.75
#: nats by which a word must be likelier in toxic text before it counts
MARGIN = 3.0
#: rows of a model that is broadcast, 12 bytes each
MOST = 1 << 21
UNIT = 1 << 20
CLASSES = ("toxic", "ordinary")
BASE = int(np.random.default_rng(61).integers(0, 2**62)) * 2 + 1
BACK = pow(BASE, -1, 2**64)
SALT = {"step": np.uint64(0x9E3779B97F4A7C15), "other": np.uint64(0xC2B2AE3D27D4EB4F)}
#: symbols whose sequences are looked up at a time
BLOCK = 1 << 19


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string")) % 5


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


# --- counts ------------------------------------------------------------------------


def sequences(words: DataFrame, counts: list[str]) -> DataFrame:
    """words: word and counts. gram, with the sums of counts: every symbol of a word behind its context."""
    spelt = F.concat(F.lit(FIRST), "word", F.lit(LAST))
    grams = F.transform(F.sequence(F.lit(2), F.length(spelt)), lambda i: F.substring(spelt, F.greatest(i - (ORDER - 1), F.lit(1)), F.least(i, F.lit(ORDER))))
    return words.select(F.explode(grams).alias("gram"), *counts).groupBy("gram").agg(*[F.sum(c).alias(c) for c in counts])


def backoff(grams: DataFrame) -> DataFrame:
    """tail (the last three symbols of a sequence, or all of a shorter one), shared."""
    n = F.length("gram")
    tails = F.filter(F.array(*[F.when(n >= k, F.substring("gram", -k, k)) for k in (1, 2, 3)]), lambda g: g.isNotNull())
    ends = materialize(grams.select(F.explode(tails).alias("tail")).groupBy("tail").agg(F.count("*").alias("e")), "toxic-tails")
    before = F.substring("tail", 1, 1)
    found: list[DataFrame] = []
    for k in (1, 2, 3):
        here = ends.where(F.length("tail") == k).withColumn("context", F.lit("") if k == 1 else before if k == 2 else F.substring("tail", 1, 2))
        after = here.groupBy("context").agg(F.sum("e").alias("t"), F.count("*").alias("kinds"))
        here = here.join(after, "context")
        if k == 1:
            lower = here.withColumn("p", 1 / (F.col("kinds") + 1))
        else:
            lower = here.join(found[-1].select(F.col("tail").alias("_shorter"), F.col("shared").alias("p")), F.substring("tail", 2, k - 1) == F.col("_shorter"))
        shared = (F.greatest(F.col("e") - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * F.col("kinds") * F.col("p")) / F.col("t")
        found.append(lower.select("tail", shared.alias("shared")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def units(x: Column) -> Column:
    return F.round(x * UNIT).cast("long")


def table(grams: DataFrame, toxic: str, ordinary: str) -> DataFrame:
    """gram, kind, value: "step", what a sequence adds to the difference of log-likelihoods; "other", what one
    does after this context that has no step. All others add nothing."""
    t, o = F.col(toxic), F.col(ordinary)
    seen = grams.where(t + o > 0)
    context = F.expr("substring(gram, 1, length(gram) - 1)")
    d = F.lit(DISCOUNT).cast("long")
    of = seen.groupBy(context.alias("context")).agg(
        F.sum(t).alias("nt"), F.sum(o).alias("no"), F.sum(F.least(t, d)).alias("kt"), F.sum(F.least(o, d)).alias("ko"), F.max(F.greatest(t, o)).alias("most")
    ).where(F.col("most") > DISCOUNT)
    of = materialize(of.drop("most"), "toxic-contexts")
    steps = seen.where(F.greatest(t, o) > DISCOUNT).withColumn("context", context).withColumn("tail", F.expr("right(gram, 3)"))
    steps = steps.join(of, "context").join(backoff(seen), "tail")

    def p(n: Column, total: str, rest: str) -> Column:
        return F.when(F.col(total) > 0, (F.greatest(n - DISCOUNT, F.lit(0)) + F.col(rest) * F.col("shared")) / F.col(total)).otherwise(F.col("shared"))

    def share(total: str, rest: str) -> Column:
        return F.when(F.col(total) > 0, F.col(rest) / F.col(total)).otherwise(F.lit(1.0))

    step = units(F.log(p(t, "nt", "kt") / p(o, "no", "ko")))
    other = units(F.log(share("nt", "kt") / share("no", "ko")))
    return steps.select("gram", F.lit("step").alias("kind"), step.alias("value")).unionByName(of.select(F.col("context").alias("gram"), F.lit("other").alias("kind"), other.alias("value")))


# --- the model as arrays -------------------------------------------------------------


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    n = BLOCK + 2 * ORDER
    return tuple(np.multiply.accumulate(np.array([1] + [x] * (n - 1), np.uint64)) for x in (BASE, BACK))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def key(gram: str, kind: str) -> int:
    """The number by which arrays find a sequence."""
    h = 0
    for i, c in enumerate(gram):
        h = (h + (ord(c) + 1) * pow(BASE, i, 2**64)) % 2**64
    return int(mixed(np.array([h], np.uint64) + SALT[kind])[0])


def in_order(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising keys with their values, and one more that is larger than all."""
    order = np.argsort(keys)
    return np.append(keys[order], np.iinfo(np.uint64).max), np.append(values[order], 0).astype(np.int32)


class Arrays:
    """Values by key, of arrays in_order(); what isn't there is 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(8, int(len(keys)).bit_length())
        self.begin = np.searchsorted(self.keys[:-1], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the key is there."""
        at = self.begin[(k >> np.uint64(64 - self.bits)).astype(np.int64)]
        low = np.flatnonzero(self.keys[at] < k)
        while len(low):
            at[low] += 1
            low = low[self.keys[at[low]] < k[low]]
        hit = self.keys[at] == k
        return np.where(hit, self.values[at], 0), hit


_kept: dict[str, Arrays] = {}


def kept(name: str, keys: np.ndarray, values: np.ndarray) -> Arrays:
    """The arrays of one model, which the tasks of a Python worker share."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = Arrays(keys, values)
    return _kept[name]


@functools.cache
def in_words() -> np.ndarray:
    """Whether each code point belongs to words."""
    out = np.zeros(0x110000, bool)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    out[[ord(c) for c in re.findall(r"[^\W_]", every)]] = True
    return out


def spelt(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words, where words begin, and how many words each text has."""
    lower = [t.lower() for t in texts]
    x = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], in_words()[x], [False]])
    edge = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = end - start
    begin = np.cumsum(n + 2) - (n + 2)
    out = np.empty(int((n + 2).sum()), np.uint32)
    out[begin], out[begin + n + 1] = ord(FIRST), ord(LAST)
    body = np.ones(len(out), bool)
    body[begin] = body[begin + n + 1] = False
    out[body] = x[inside[1:-1]]
    ends = np.cumsum([len(t) + 1 for t in lower])
    upto = np.searchsorted(start, ends)
    return out, begin, np.diff(upto, prepend=0)


def sequence_values(x: np.ndarray, begin: np.ndarray, model: Arrays) -> np.ndarray:
    """What each symbol of the words adds."""
    out = np.zeros(len(x), np.int64)
    up, down = powers()
    place = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
    for a in range(0, len(x), BLOCK):
        low, b = max(0, a - ORDER + 1), min(len(x), a + BLOCK)
        sums = np.zeros(b - low + 1, np.uint64)
        np.cumsum((x[low:b].astype(np.uint64) + np.uint64(1)) * up[: b - low], out=sums[1:])
        i = np.arange(a, b)[place[a:b] > 0]
        first = i - np.minimum(place[i], ORDER - 1) - low
        h = i - low

        def found(to: np.ndarray, kind: str, first: np.ndarray = first, sums: np.ndarray = sums) -> tuple[np.ndarray, np.ndarray]:
            return model.find(mixed((sums[to] - sums[first]) * down[first] + SALT[kind]))

        value, hit = found(h + 1, "step")
        other, _ = found(h, "other")
        out[i] = np.where(hit, value, other)
    return out


def excess(texts: list[str], model: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the sum of what its words' differences exceed MARGIN by, in units, and its symbols (a word's and one)."""
    x, begin, words = spelt(texts)
    first = np.cumsum(words) - words
    if not len(begin):
        return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    over = np.maximum(np.add.reduceat(sequence_values(x, begin, model), begin) - int(MARGIN * UNIT), 0)
    size = np.diff(np.append(begin, len(x))) - 1
    sums = [np.concatenate([[0], np.cumsum(v)]) for v in (over, size)]
    return tuple(s[first + words] - s[first] for s in sums)


def feature(over: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The length-normalised excess, as a logarithm that is 0 for none."""
    return np.log1p(1000 * (over / UNIT) / np.maximum(size, 1))


class Steps:
    """A model's table, and its arrays where it is small enough."""

    def __init__(self, grams: DataFrame, toxic: str, ordinary: str, most: int | None = None):
        self.table = materialize(table(grams, toxic, ordinary), "toxic-steps")
        self.arrays = None
        if self.table.count() <= (MOST if most is None else most):

            def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    k = [key(g, c) for g, c in zip(b.column("gram").to_pylist(), b.column("kind").to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(k, np.uint64).view(np.int64)), b.column("value")], ["k", "value"])

            x = self.table.mapInArrow(keyed, "k long, value long").toArrow()
            self.arrays = in_order(x.column("k").to_numpy().view(np.uint64), x.column("value").to_numpy())

    def features(self, docs: DataFrame, columns: list[str]) -> DataFrame:
        """docs: columns, text. columns, f: one row in, one row out."""
        return self.broadcast(docs, columns) if self.arrays else self.joined(docs, columns)

    def broadcast(self, docs: DataFrame, columns: list[str]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(self.arrays)  # MOST rows at most
        names, name = [*columns, "f"], uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sole_cache("toxicity", _kept.clear)
            model = kept(name, *shared.value)
            for batch, texts in text_batches(batches, "text", 1_000_000):
                f = feature(*excess(texts, model))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(f)], names)

        return docs.select(*columns, "text").mapInArrow(run, _typed(docs, columns) + ", f double")

    def joined(self, docs: DataFrame, columns: list[str]) -> DataFrame:
        """The same without any broadcast: by the documents' words."""
        rows = materialize(docs.select(F.expr("uuid()").alias("_row"), *columns, "text"), "toxic-rows")

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pieces(batches, "text"):
                found = [(row, w, n) for row, text in zip(pdf["_row"], pdf["text"], strict=True) for w, n in Counter(words_of(text)).items()]
                yield pd.DataFrame(found, columns=["_row", "word", "times"])

        words = rows.select("_row", "text").mapInPandas(count, "_row string, word string, times long")
        spelt_, i = F.concat(F.lit(FIRST), "word", F.lit(LAST)), F.col("i")
        gram = F.substring(spelt_, F.greatest(i - (ORDER - 1), F.lit(1)), F.least(i, F.lit(ORDER)))
        asked = words.select("word").distinct().select("word", F.explode(F.sequence(F.lit(2), F.length(spelt_))).alias("i")).select("word", gram.alias("gram"))
        asked = asked.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
        steps = self.table.where("kind = 'step'").select("gram", F.col("value").alias("step"))
        other = self.table.where("kind = 'other'").select(F.col("gram").alias("context"), F.col("value").alias("other"))
        value = asked.join(steps, "gram", "left").join(other, "context", "left").groupBy("word").agg(F.sum(F.coalesce("step", "other", F.lit(0))).alias("v"))
        over = value.select("word", (F.col("v") - int(MARGIN * UNIT)).alias("over")).where("over > 0")
        sums = words.join(over, "word").groupBy("_row").agg(F.sum(F.col("times") * F.col("over")).alias("over"))
        sizes = words.groupBy("_row").agg(F.sum(F.col("times") * (F.length("word") + 1)).alias("size"))
        known = rows.select("_row", *columns).join(sums, "_row", "left").join(sizes, "_row", "left")
        return known.select(*columns, F.log1p(1000 * (F.coalesce("over", F.lit(0)) / UNIT) / F.coalesce("size", F.lit(1))).alias("f"))


def _typed(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


class Model:
    def __init__(self, steps: Steps, weights: tuple[float, float]):
        self.steps, self.weights = steps, weights

    def scored(self, docs: DataFrame, columns: list[str]) -> DataFrame:
        """docs: columns, text. Returns columns, score."""
        a, b = self.weights
        z = F.lit(a) + F.lit(b) * F.col("f")
        return self.steps.features(docs, columns).select(*columns, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def logistic(f: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Offset and slope, by Newton steps that are halved until the loss falls."""
    x, w = np.stack([np.ones_like(f), f], 1), np.zeros(2)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge * (w @ w) / 2)

    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(2), x.T @ (q - y) + ridge * w)
        rate = 1.0
        while loss(w - rate * step) > loss(w) and rate > 1e-9:
            rate /= 2
        w = w - rate * step
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8_000, most: int | None = None) -> Model | None:
    """docs: doc_id, text; labels: doc_id, toxic. Rows held out by remainder() are not read.

    per_class bounds the rows for the two weights; the counts are of all training rows.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fifth", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)) == 0)
    rows = docs.select("doc_id", "text").join(known, "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, "text"):
            n: Counter = Counter()
            for (fifth, c), some in pdf.groupby(["fifth", "toxic"])["text"]:
                for w, x in Counter(w for t in some for w in words_of(t)).items():
                    n[w, fifth, c] += x
            yield pd.DataFrame([(w, x * c, x * (1 - c), 0 if fifth else x * c, 0 if fifth else x * (1 - c)) for (w, fifth, c), x in n.items()], columns=["word", *counts])

    counts = [*CLASSES, *(f"{c}_rest" for c in CLASSES)]
    words = rows.select("fifth", "toxic", "text").mapInPandas(count, "word string, " + ", ".join(f"{c} long" for c in counts))
    words = words.groupBy("word").agg(*[F.sum(c).alias(c) for c in counts])
    grams = materialize(sequences(words, counts), "toxic-sequences")
    n = grams.where(F.length("gram") == 2).agg(*[F.sum(c).alias(c) for c in counts]).first()
    if not all(n[c] for c in CLASSES):
        return None
    steps = Steps(grams, *CLASSES, most=most)
    order = F.xxhash64(F.lit("fit"), "doc_id"), F.col("doc_id")
    fifth = known.where("fifth")
    # at most 2 * per_class ids
    chosen = F.broadcast(materialize(fifth.where("toxic = 0").orderBy(*order).limit(per_class).unionByName(fifth.where("toxic = 1").orderBy(*order).limit(per_class)), "toxic-chosen").select("doc_id", "toxic"))
    held = None
    if all(n[f"{c}_rest"] for c in CLASSES):
        sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", "text")
        held = Steps(grams, *(f"{c}_rest" for c in CLASSES), most=most).features(sample, ["toxic"]).toPandas().sort_values(["toxic", "f"])
    if held is None or held["toxic"].nunique() < 2:
        return Model(steps, (-4.0, 2.0))
    return Model(steps, logistic(held["f"].to_numpy(float), held["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """docs: doc_id, text. Returns doc_id, held_out, score, predicted."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), "text")
    scored = model.scored(known, ["doc_id", "held_out"]) if model else known.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that score below 0.5, all columns kept. Equal texts score alike."""
    if not model:
        return docs
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return model.scored(rows, ["row"]).where("score < 0.5").select("row.*")

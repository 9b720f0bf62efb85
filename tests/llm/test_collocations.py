"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from hitloom.llm import collocations


def plain(docs, least, inside, most):
    words, grams = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split("[ \t]", piece) if x]
            words.update((lang, x) for x in w)
            grams.update((lang, tuple(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    fine = {k: a for k, a in grams.items() if len(k[1]) > 1 and a >= least}
    rows = []
    for (lang, p), a in fine.items():
        if any(other == lang and len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * b >= inside * a for (other, q), b in fine.items()):
            continue
        cuts = [(10**6 * a * a // (grams[lang, p[:k]] * grams[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows.append((lang, -score, -a, " ".join(p).encode(), grams[lang, p[:k]], grams[lang, p[k:]], sum(n for (g, _), n in words.items() if g == lang)))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return out


def texts():
    rng = random.Random(3)
    words = ["Aa", "b", "cc", "DD", "é", "É", "ee\x1c", "日本", "f-g", "h" * 400]
    docs = [(rng.choice(["en", "en", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ". ", "\n", ", "]) for _ in range(rng.randrange(60)))) for _ in range(160)]
    docs += [("en", "new york city " * 30), ("en", "of the " * 4000), ("fr", None), (None, ""), ("fr", "..."), ("de", "x"), ("en", "tail new york")]
    return docs + docs[:5]


@pytest.mark.parametrize("small", [False, True])
def test_counts_scores_and_ranks(spark, monkeypatch, small):
    if small:  # bursts, spills, stretches and full word tables
        limits = {"BURST": 4, "MOST": 20, "STRETCH": 300, "WORDS": 8}
        made = collocations.counted

        def counted(*args):
            for k, v in limits.items():
                monkeypatch.setattr(collocations, k, v)
            return made(*args)

        monkeypatch.setattr(collocations, "counted", counted)
    docs = texts()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "lang string, text string, word string, n int").repartition(3)
    for most in (2000, 3):
        got = collocations.collocations(df, most=most)
        assert [tuple(r) for r in got.orderBy("lang", "rank").collect()] == plain(docs, 10, 50, most)
    pairs = collocations.collocations(df, longest=2, most=None).collect()
    assert {(r.lang, r.phrase) for r in pairs} >= {("en", "new york"), ("en", "york city"), ("en", "of the")}
    with pytest.raises(ValueError):
        collocations.collocations(df, longest=4)


def in_task(docs, n, monkeypatch, **limits):
    """What one task emits, run here, with small limits."""
    import pyarrow as pa

    for k, v in limits.items():
        monkeypatch.setattr(collocations, k, v)

    class Frame:
        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_pydict({"lang": pa.array([d[0] or "und" for d in docs]), "text": pa.array([d[1] for d in docs])})
            return list(run(iter([batch])))

    class Ones:
        value = np.full(1 << (collocations.BITS - 6), -1, np.int64)

    return collocations.counted(Frame(), n, 0, Ones() if n > 1 else None, Ones() if n > 2 else None)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_spilled_runs_are_sorted_and_add_up(monkeypatch, n):
    whole = in_task(texts(), n, monkeypatch)
    small = in_task(texts(), n, monkeypatch, BURST=4, MOST=20, STRETCH=300, WORDS=8)
    keys = [f"w{k + 1}" for k in range(n)]

    def total(batches):
        out = Counter()
        for b in batches:
            for row in b.to_pylist():
                out[(row["lang"], *(row[k] for k in keys))] += row["n"]
        return out

    assert total(whole) == total(small) and sum(total(whole).values()) > 1000
    assert len(small) > len(whole)


def test_trie_bursts_and_spills_whole_subtrees():
    rng = random.Random(5)
    trie, want = collocations.Trie(3), Counter()
    for _ in range(30):
        keys = np.unique(np.array([rng.choice([1, 1, 1, rng.randrange(90)]) << 42 | rng.randrange(200) << 21 | rng.randrange(200) for _ in range(900)], np.int64))
        trie.add(keys, np.full(len(keys), 2))
        want.update(dict.fromkeys(keys.tolist(), 2))
    assert type(trie.root[1]) is collocations.Burst and trie.entries == len(want)
    got, firsts = Counter(), set()
    for left in (trie.entries // 2, 0):
        part = set()
        for k, n in trie.spill(left, some=500):
            assert (np.diff(k) > 0).all()
            got.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
            part |= set((k >> 42).tolist())
        assert trie.entries <= left and not part & firsts
        firsts |= part
    assert got == want and trie.entries == 0 and not trie.root


def test_equal_numbers_of_two_words_take_another_seed(spark, monkeypatch):
    df = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    made = collocations.counted

    def counted(texts, n, seed, *more):
        from pyspark.sql import functions as F

        return made(texts, n, seed, *more).withColumn("w1", F.lit(1).cast("long")) if seed == 0 else made(texts, n, seed, *more)

    monkeypatch.setattr(collocations, "counted", counted)
    words, seed = collocations.word_table(df)
    assert seed == 1 and {r.word for r in words.collect()} == {"a", "b", "c"}


def test_scores_beyond_64_bits(spark):
    big = 10**13 + 7
    df = spark.createDataFrame([(big - 5, big, big - 1)], "a long, l long, r long")
    assert df.select(collocations.score("a", "l", "r").alias("s")).first().s == 10**6 * (big - 5) ** 2 // (big * (big - 1))

"""BPE encoding and decoding in batched merge rounds.

A text is cut at the strings of special tokens, then at white space (as the tokenizer
file has it) into chunks; a chunk is composed (NFC), lower-cased and split by the file's
pattern into words, whose UTF-8 bytes are the first symbols, the last one marked as the
end of its word. No merge crosses a word, so the words that a batch of texts has not met
before are solved together, each once: their symbols lie in one flat array, and a round

1. looks every neighbouring pair up by binary search in the sorted keys of mergeable pairs;
2. takes each word's lowest rank (a minimum over its stretch of the array);
3. merges all places of that rank, from the left where they overlap, and drops words
   without a mergeable pair.

Merging all places of a rank at once gives what merging the leftmost again and again
gives, as a pair with a new symbol always ranks behind the merge that made the symbol; a
file in which it does not is an error. Words above LONG symbols, whose rounds would each
pass over the whole word, go through the same merges rank by rank with places kept by
rank, so that a round touches only what it merges.

Every row in gives one row out; null texts are empty; empty texts have no ids, and the
text of no ids is empty. Other columns are not returned. Texts are taken whole, one at a
time if long: memory grows with the longest text. Results do not depend on the batches.
Decoding joins the ids' tokens by a space, as a file without a decoder asks for.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import sole_cache, text_batches

VOCABULARY = "word_bpe_49k.json"
LONG = 2_048
#: words and chunks kept from batch to batch, at most, and the longest of them (code points)
KEPT, KEPT_LENGTH = 400_000, 64
#: white space of str.split() that the file's pattern does not count as such, and the pattern's own
ODD = regex.compile(r"[\x1c-\x1f]")
SPACES = regex.compile("[\t-\r \x85\xa0  -     　]+")
NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where Latin-1 prints it, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def chunks_of(text: str) -> list[str]:
    return [c for c in SPACES.split(text) if c] if ODD.search(text) else text.split()


class Model:
    """Sorted pair keys with their ranks and merged symbols, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        vocab, merges = given["model"]["vocab"], given["model"]["merges"]
        end = given["model"]["end_of_word_suffix"]
        self.tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in given["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {}
        for t in given["added_tokens"]:
            self.tokens[t["id"]] = t["content"]
            self.special[t["content"]] = t["id"]
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = given["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.normalizer = tokenizers.Tokenizer.from_file(path).normalizer
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.size = np.int64(len(self.tokens))
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = np.full(len(self.tokens), -1, np.int64)
        born[made] = np.arange(len(made))
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any() or len(np.unique(made)) != len(made):
            raise ValueError(f"{path}: a pair ranks before the merge that makes one of its symbols")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.left, self.right, self.made = keys[order], order.astype(np.int64), left, right, made
        self.known: dict[str, bytes] = {}
        self.forget()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, NEVER for those that do not merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of words in one flat array, and how many each has."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        out, ends = self.inner[flat], np.cumsum(sizes) - 1
        out[ends] = self.last[flat[ends]]
        return out, sizes

    def rounds(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Ids (32 bits each) of words (symbols in one flat array, how many each has), solved together."""
        done = [b""] * len(sizes)
        names = np.arange(len(sizes))
        ends = np.cumsum(sizes) - 1
        rank = np.full(len(flat), NEVER)  # of the pair that a symbol forms with the next, which the last of a word has not
        if len(flat):
            rank[:-1] = self.rank(flat[:-1], flat[1:])
            rank[ends] = NEVER
        while len(names):
            starts = np.concatenate([[0], ends[:-1] + 1])
            least = np.minimum.reduceat(rank, starts)
            owner = np.repeat(np.arange(len(names)), sizes)
            idle = least == NEVER
            if idle.any():
                out = flat[idle[owner]].astype(np.int32).tobytes()
                stops = (4 * np.cumsum(sizes[idle])).tolist()
                for name, a, b in zip(names[idle].tolist(), [0, *stops], stops, strict=False):
                    done[name] = out[a:b]
            place = np.flatnonzero((rank == least[owner]) & (rank != NEVER))
            place = place[apart(place)]
            flat[place] = self.made[rank[place]]
            keep = ~idle[owner]
            keep[place + 1] = False
            sizes = (sizes - np.bincount(owner[place], minlength=len(names)))[~idle]
            place = (np.cumsum(keep) - 1)[place]
            flat, rank, names = flat[keep], rank[keep], names[~idle]
            ends = np.cumsum(sizes) - 1
            # only pairs with a new symbol have a new rank
            near = np.unique(np.concatenate([place, place[place > 0] - 1]))
            inner = np.ones(len(flat), bool)
            inner[ends] = False
            rank[near] = NEVER
            near = near[inner[near]]
            rank[near] = self.rank(flat[near], flat[near + 1])
        return done

    def by_rank(self, symbols: np.ndarray) -> bytes:
        """Ids of one long word: ranks in order, each at all its places, which are kept by rank."""
        n = len(symbols)
        symbols, alive = symbols.copy(), np.ones(n, bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: none
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.rank(symbols[at], symbols[after[at]])
            order = np.argsort(rank, kind="stable")
            found, first = np.unique(rank[order], return_index=True)
            for r, part in zip(found.tolist(), np.split(at[order], first[1:]), strict=False):
                if r != NEVER:
                    if r not in places:
                        places[r] = []
                        heapq.heappush(queue, r)
                    places[r].append(part)

        add(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (symbols[at] == self.left[r])]
            at = at[after[at] < n]
            at = at[symbols[after[at]] == self.right[r]]
            # with equal halves a place and the next may overlap
            index = np.cumsum(alive) - 1 if len(at) and self.left[r] == self.right[r] else None
            at = at[apart(index[at])] if index is not None else at
            gone = after[at]
            symbols[at], alive[gone] = self.made[r], False
            after[at] = after[gone]
            has = after[at] < n
            before[after[at][has]] = at[has]
            near = np.concatenate([at[has], before[at][before[at] >= 0]])
            if len(near):
                add(np.unique(near))
        return symbols[alive].astype(np.int32).tobytes()

    def solve(self, words: list[str]) -> dict[str, bytes]:
        short = [w for w in words if len(w) <= LONG]
        out = dict(zip(short, self.rounds(*self.symbols(short)), strict=True))
        out.update((w, self.by_rank(self.symbols([w])[0])) for w in words if len(w) > LONG)
        return out

    def split(self, chunk: str) -> list[str]:
        """Words of a chunk. The file's normalizer and pattern carry the Unicode tables that decide beyond ASCII."""
        if chunk.isascii():
            return self.words.findall(chunk.lower())
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def forget(self) -> None:
        self.known = {s: np.int32(i).tobytes() for s, i in self.special.items()}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.at_special.split(t) if self.at_special and "<" in t else [t] for t in texts]
        chunks = [chunks_of(parts[0]) if len(parts) == 1 else [c for p in parts for c in ([p] if p in self.special else chunks_of(p))] for parts in cut]
        if len(self.known) > KEPT:
            self.forget()
        new = set().union(*chunks).difference(self.known)
        split = {c: self.split(c) for c in new}
        ids = self.solve(sorted(set(itertools.chain.from_iterable(split.values()))))
        self.known.update((c, ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws))) for c, ws in split.items())
        found = [np.frombuffer(b"".join(map(self.known.__getitem__, cs)), np.int32) for cs in chunks]
        for c in new:
            if len(c) > KEPT_LENGTH:
                del self.known[c]
        return found

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def apart(places: np.ndarray) -> np.ndarray:
    """Which of some places in order to merge, so that none touches the one taken before: every second of a run of neighbours."""
    if not len(places):
        return np.zeros(0, bool)
    at = np.arange(len(places))
    first = np.concatenate([[True], np.diff(places) != 1])
    return (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0


@functools.lru_cache(maxsize=1)
def model(path: str) -> Model:
    sole_cache("bpe", model.cache_clear)
    return Model(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """id, ids (array of int) and, if a name for it is given, the text that the ids decode to."""
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch, texts in text_batches(batches, "text", 2_000_000):
            ids = m.encode_all(texts)
            ends = np.cumsum([0, *map(len, ids)])
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(map(m.decode, ids), pa.string())] * bool(decoded), ["id", "ids"] + ["decoded"] * bool(decoded))

    kind = kept.schema["id"].dataType.simpleString()
    out = kept.mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * bool(decoded))
    return out.withColumnsRenamed({"id": id_col} | ({"decoded": decoded} if decoded else {}))


def decode(df: DataFrame, path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """df with the text of its ids; null for null ids."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        m = model(path)
        return ids.map(lambda x: None if x is None else m.decode(np.asarray(x, np.int32)))

    return df.withColumn(to, text(F.col(ids_col)))

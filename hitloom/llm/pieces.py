"""SentencePiece encoding and decoding as a max-plus lattice.

Encoding finds the segmentation of highest total piece score. No piece crosses the
start of a run of spaces or a line feed, so a text falls apart there into units (spaces
and the word after them) whose best segmentations are independent. All units of a batch
are solved position by position at once, as arrays; those above LOCKSTEP code points on
their own.

Documents above `giant` code points are cut into chunks of `chunk` that are solved
apart, with the same ids as in one pass:

1. a chunk's transfer matrix T[s, e] is the best score of a path that enters s code
   points after its start and leaves e after its end (pieces reach over the cut). With
   unit starts inside, only the parts before the first and after the last of them have
   more than one state, and T = head[s] + middle + tail[e];
2. matrices are combined in max-plus algebra, which is associative: products over
   segments of SEGMENT chunks, the segments of a document in order, then inside each
   segment. This gives the best score F[s] of every state at every cut;
3. with F every chunk says, for each state it may leave in, where that path entered:
   a small map. Composed from a document's end they give the state at each cut;
4. every chunk is traced back on its own between its two states.

Scores are whole numbers, so sums are exact in any order. Code points without a piece
become byte pieces, as one step with the lowest score less 10. Of equal paths the one
with the longer last piece wins at each position, also across cuts, as step 3 and 4
carry on from F. Spaces are written as U+2581 and one is put before the text, which
decoding takes off again; decode(encode(t)) = t for any text without U+2581, also an
empty one (no ids). Null texts are empty. Rows that are equal in id and text have equal
results; null ids stay null. Other columns of the input are not returned.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import materialize, sole_cache, text_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
GIANT, CHUNK, SEGMENT = 32_768, 16_384, 128
NONE = float("-inf")
#: units of at most so many code points are solved together
LOCKSTEP = 64
SPACE_POINT, FEED = 32, 10
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def unit_starts(x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Places in x where a unit starts; firsts: where texts start."""
    start = np.zeros(len(x), bool)
    start[firsts] = True
    feed, space = x == FEED, x == SPACE_POINT
    start |= feed
    start[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
    return np.flatnonzero(start)


class Trie:
    """Steps from a beginning of pieces to the next, for arrays of beginnings at once.

    The step from node a with the code point of class c has the key a * classes + c; keys
    lie in a table by a multiplicative hash, those that find their place taken in a second.
    """

    def __init__(self, scores: dict[str, tuple[int, float]]):
        known = sorted({p[:n] for p in scores for n in range(1, len(p) + 1)}, key=len)
        number = {p: i + 1 for i, p in enumerate(known)}
        letters = sorted({c for p in known for c in p})
        self.classes = len(letters) + 1
        self.of_point = np.zeros(0x110000, np.int32)
        self.of_point[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        own = dict(zip(letters, range(1, len(letters) + 1), strict=True))
        self.score = np.full(len(known) + 1, NONE)
        self.piece = np.full(len(known) + 1, -1, np.int32)
        for p, (i, s) in scores.items():
            self.piece[number[p]], self.score[number[p]] = i, s
        keys = np.array([number.get(p[:-1], 0) * self.classes + own[p[-1]] for p in known], np.int64)
        if keys.max(initial=0) >= 2**31:
            raise ValueError("the model has too many pieces")
        self.tables = []
        to = np.arange(1, len(known) + 1, dtype=np.int32)
        while len(keys):
            bits = max(8, len(keys).bit_length() + 3)
            slot = self.slots(keys, bits, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            at, node = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.int32)
            at[slot[first]], node[slot[first]] = keys[first], to[first]
            taken = np.zeros(1 << bits, bool)
            rest = np.delete(np.arange(len(keys)), first)
            taken[slot[rest]] = True
            self.tables.append((bits, at, node, taken))
            keys, to = keys[rest], to[rest]

    @staticmethod
    def slots(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        return ((keys.astype(np.uint64) + np.uint64(level << 40)) * FACTOR >> np.uint64(64 - bits)).astype(np.int64)

    def step(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next nodes, 0 where there is none."""
        return self.found(node.astype(np.int64) * self.classes + c, 0)

    def found(self, keys: np.ndarray, level: int) -> np.ndarray:
        bits, at, node, taken = self.tables[level]
        slot = self.slots(keys, bits, level)
        hit = at[slot] == keys
        out = np.where(hit, node[slot], 0)
        if level + 1 < len(self.tables):
            again = np.flatnonzero(~hit & taken[slot])
            if len(again):
                out[again] = self.found(keys[again], level + 1)
        return out


class Model:
    """Piece scores of a model file, and the best segmentation of texts."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.text = [p.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.of = {self.text[i].replace(SPACE, " "): (i, float(round(p.get_score(i)))) for i in plain}
        self.unknown = min(s for _, s in self.of.values()) - 10
        self.longest = max(map(len, self.of))
        #: pieces and what pieces start with: the score, or None for a mere beginning
        self.known: dict[str, float | None] = {p[:n]: None for p in self.of for n in range(1, len(p))}
        self.known |= {p: s for p, (_, s) in self.of.items()}
        self.plain = {i: self.text[i].replace(SPACE, " ") for i in plain}
        if any("\n" in t or " " in t.lstrip(" ") for t in self.of):
            raise ValueError("the model has pieces that cross the start of a unit")
        #: what each id adds to a text; control pieces add nothing
        self.raw = [b""] * n
        for i, t in self.plain.items():
            self.raw[i] = t.encode("utf-8", "replace")
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.byte_ids = np.array([self.byte.get(b, 0) for b in range(256)], np.int32)
        self.trie = Trie(self.of)

    # --- one text --------------------------------------------------------------------

    def forward(self, text: str, end: int, enter: list[float]) -> tuple[list[float], list[int]]:
        """Best scores of all positions, by pieces that begin before end; enter: scores that the first positions have
        already. With each one's last piece's beginning, or -1 where it was entered."""
        last = min(len(text), end + self.longest - 1)
        score, back = [NONE] * (last + 1), [-1] * (last + 1)
        score[: len(enter)] = enter[: last + 1]
        known = self.known
        for i in range(end):
            here = score[i]
            if here == NONE:
                continue
            for j in range(i + 1, last + 1):
                piece = text[i:j]
                if piece not in known:
                    break
                value = known[piece]
                if value is not None and here + value > score[j]:
                    score[j], back[j] = here + value, i
            if known.get(text[i]) is None and here + self.unknown > score[i + 1]:
                score[i + 1], back[i + 1] = here + self.unknown, i
        return score, back

    def ids(self, piece: str) -> list[int]:
        found = self.of.get(piece)
        return [found[0]] if found else [self.byte[b] for b in piece.encode("utf-8", "replace")]

    def along(self, text: str, back: list[int], to: int) -> tuple[list[int], int]:
        """Ids up to a position, and where the path was entered."""
        cuts = [to]
        while back[cuts[-1]] >= 0:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        return [x for i, j in itertools.pairwise(cuts) for x in self.ids(text[i:j])], cuts[0]

    # --- all units of a batch ----------------------------------------------------------

    def solve(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x: code points; starts: of its units, the first at 0. All ids in order, and each unit's number of ids and score."""
        n = np.diff(np.append(starts, len(x)))
        count, score = np.zeros(len(n), np.int64), np.zeros(len(n))
        short = np.flatnonzero(n <= LOCKSTEP)
        long = {}
        for u in np.flatnonzero(n > LOCKSTEP):
            text = x[starts[u] : starts[u] + n[u]].tobytes().decode("utf-32-le", "surrogatepass")
            found, back = self.forward(text, int(n[u]), [0.0])
            long[u] = np.array(self.along(text, back, int(n[u]))[0], np.int32)
            count[u], score[u] = len(long[u]), found[n[u]]
        order = short[np.argsort(-n[short], kind="stable")]
        pieces, places = self.lockstep(x, starts[order], n[order])
        last, k, value = pieces
        # of each piece its id, or the UTF-8 bytes of a code point without one
        point = x[places[1]]
        size = np.where(places[0] >= 0, 1, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))
        per = np.zeros(len(order), np.int64)
        np.add.at(per, last, size)
        count[order], score[order] = per, value
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        # places of the pieces: their unit's begin and what is before them in the unit
        before = np.cumsum(size) - size
        first_of = np.cumsum(per) - per
        at = begin[order][last] + before - first_of[last]
        one = places[0] >= 0
        out[at[one]] = places[0][one]
        if not one.all():
            some, c, m = at[~one], point[~one].astype(np.int64), size[~one]
            lead = np.choose(m - 1, [c, 0xC0 | c >> 6, 0xE0 | c >> 12, 0xF0 | c >> 18])
            out[some] = self.byte_ids[lead]
            for i in range(1, 4):
                w = m > i
                out[some[w] + i] = self.byte_ids[0x80 | c[w] >> 6 * (m[w] - 1 - i) & 0x3F]
        for u, found in long.items():
            out[begin[u] : begin[u] + len(found)] = found
        return out, count, score

    def lockstep(self, x: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[tuple, tuple]:
        """Best paths of units by falling length. Position p is a row of the units longer than p, all rows in one array."""
        rows = np.arange(len(n))
        if not len(n):
            none = np.empty(0, np.int64)
            return (none, none, np.empty(0)), (np.empty(0, np.int32), none)
        most = int(n[0])
        # units with more than p code points: the first above[p]
        above = np.searchsorted(-n, -np.arange(most + 1), "left")
        begin = np.concatenate([[0], np.cumsum(np.concatenate([[len(n)], above[:most]]))])
        letters = [self.trie.of_point[x[starts[: above[p]] + p]] for p in range(most)]
        score = np.full(int(begin[-1]), NONE)
        score[: len(n)] = 0.0
        back, chosen = np.zeros(len(score), np.int8), np.full(len(score), -1, np.int32)
        for p in range(most):
            here, who, node = score[begin[p] : begin[p] + above[p]], None, np.zeros(above[p], np.int32)
            for k in range(1, min(self.longest, most - p) + 1):
                a = above[p + k - 1]
                if who is None:
                    c = letters[p + k - 1]
                else:
                    cut = np.searchsorted(who, a)
                    who, node = who[:cut], node[:cut]
                    if not cut:
                        break
                    c = letters[p + k - 1][who]
                node = self.trie.step(node, c)
                value = self.trie.score[node]
                if k == 1:
                    who = rows[:a]
                    value = np.where(value == NONE, self.unknown, value)
                step = here[who] + value
                to = begin[p + k] + who
                better = step > score[to]
                at = to[better]
                score[at], back[at], chosen[at] = step[better], k, self.trie.piece[node[better]]
                alive = node > 0
                who, node = who[alive], node[alive]
        at, count = n.copy(), np.zeros(len(n), np.int64)
        open_, steps = rows, []
        while len(open_):
            place = begin[at[open_]] + open_
            at[open_] -= back[place]
            steps.append((open_, chosen[place], starts[open_] + at[open_]))
            count[open_] += 1
            open_ = open_[at[open_] > 0]
        # steps go from the end; put each unit's pieces in order
        first = np.cumsum(count) - count
        ids, where, last = np.empty(int(count.sum()), np.int32), np.empty(int(count.sum()), np.int64), np.repeat(rows, count)
        for t, (who, piece, place) in enumerate(steps):
            to = first[who] + count[who] - 1 - t
            ids[to], where[to] = piece, place
        return (last, count, score[begin[n] + rows]), (ids, where)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, which get their leading space here, and each one's number of them."""
        full = [i for i, t in enumerate(texts) if t]
        counts = np.zeros(len(texts), np.int64)
        if not full:
            return np.empty(0, np.int32), counts
        x = points(" " + " ".join([texts[i] for i in full]))
        firsts = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in full])])[:-1]
        starts = unit_starts(x, firsts)
        ids, count, _ = self.solve(x, starts)
        counts[full] = np.add.reduceat(count, np.searchsorted(starts, firsts))
        return ids, counts

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@functools.cache
def model(path: str) -> Model:
    return Model(path)


# --- chunks of giant documents ----------------------------------------------------


def sweep(m: Model, text: str, end: int, states: int) -> np.ndarray:
    """Scores of all positions, a row each, for every state that a path may have entered in."""
    last = min(len(text), end + m.longest - 1)
    score = np.full((last + 1, states), NONE)
    for s in range(min(states, last + 1)):
        score[s, s] = 0.0
    known = m.known
    for i in range(end):
        here = score[i]
        for j in range(i + 1, last + 1):
            value = known.get(text[i:j], NONE)
            if value is not None:
                if value == NONE:
                    break
                np.maximum(score[j], here + value, out=score[j])
        if known.get(text[i]) is None:
            np.maximum(score[i + 1], here + m.unknown, out=score[i + 1])
    return score


def inner(text: str, size: int) -> np.ndarray:
    """Places in 1 .. size - 1 of a chunk where a unit starts."""
    return unit_starts(points(text[:size]), np.zeros(1, np.int64))[1:]


def middle(m: Model, text: str, starts: np.ndarray) -> tuple[np.ndarray, float]:
    """Ids and score of the units between the first and the last start."""
    if len(starts) < 2:
        return np.empty(0, np.int32), 0.0
    ids, _, score = m.solve(points(text[starts[0] : starts[-1]]), starts[:-1] - starts[0])
    return ids, float(score.sum())


def transfer(m: Model, text: str, size: int, states: int) -> np.ndarray:
    """T of a chunk: its own `size` code points and the `states` - 1 after it."""
    ends = min(states, len(text) - size + 1)
    t = np.full((states, states), NONE)
    starts = inner(text, size)
    if not len(starts):
        t[:, :ends] = sweep(m, text, size, states)[size : size + ends].T
        return t
    first, last = int(starts[0]), int(starts[-1])
    head = sweep(m, text[:first], first, states)[first]
    tail = np.array(m.forward(text[last:], size - last, [0.0])[0][size - last : size - last + ends])
    t[:, :ends] = head[:, None] + middle(m, text, starts)[1] + tail[None, :]
    return t


def entered(m: Model, text: str, size: int, states: int, scores: np.ndarray) -> bytes:
    """For each state that a chunk is left in, the one it was entered in, given the scores of those."""
    starts = inner(text, size)
    if len(starts):
        first = int(starts[0])
        _, back = m.forward(text[:first], first, scores.tolist())
        return bytes([m.along(text, back, first)[1]]) * states
    score, back = m.forward(text, size, scores.tolist())
    return bytes(m.along(text, back, size + e)[1] if size + e < len(score) and score[size + e] != NONE else 0 for e in range(states))


def trace_chunk(m: Model, text: str, size: int, scores: np.ndarray, leave: int) -> np.ndarray:
    """Ids of a chunk that is left in a state, given the scores of the states that it may be entered in."""
    starts = inner(text, size)
    if not len(starts):
        _, back = m.forward(text, size, scores.tolist())
        return np.array(m.along(text, back, size + leave)[0], np.int32)
    first, last = int(starts[0]), int(starts[-1])
    head = m.along(text, m.forward(text[:first], first, scores.tolist())[1], first)[0]
    tail = m.along(text[last:], m.forward(text[last:], size - last, [0.0])[1], size + leave - last)[0]
    return np.concatenate([np.array(head, np.int32), middle(m, text, starts)[0], np.array(tail, np.int32)])


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product, along the last axis of a and the first of b."""
    return (a[..., :, None] + b).max(axis=-2)


def before(ts: list[np.ndarray], start: np.ndarray) -> list[np.ndarray]:
    """Scores of the states before each matrix."""
    return list(itertools.accumulate(ts[:-1], combine, initial=start))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """id, ids (array of int), exact (decoding gives the text again). One row in, one row out."""
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("pieces")
        m = model(path)
        for batch, texts in text_batches(batches, "text", 1_000_000):
            ids, counts = m.encode_all(texts)
            ends = np.concatenate([[0], np.cumsum(counts)])
            exact = [m.decode(ids[a:b].tolist()) == t for a, b, t in zip(ends, ends[1:], texts, strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(exact, pa.bool_())], ["id", "ids", "exact"])

    schema = "id long, ids array<int>, exact boolean"
    small = kept.where(F.length("text") <= giant).mapInArrow(whole, schema)
    states = model(path).longest

    large = kept.where(F.length("text") > giant).withColumn("row", F.xxhash64("id", "text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, text in zip(pdf["row"], pdf["text"], strict=True):
                text = " " + text
                k = range(-(-len(text) // chunk))
                yield pd.DataFrame({"row": row, "k": k, "size": [min(chunk, len(text) - i * chunk) for i in k], "text": [text[i * chunk : (i + 1) * chunk + states - 1] for i in k]})

    # a row of its own for every chunk: its code points and those that a piece can reach over to
    chunks = large.select("row", "text").dropDuplicates(["row"]).mapInPandas(cut, "row long, k int, size int, text string")
    chunks = materialize(chunks.repartition("row", "k"), "chunks")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_cache("pieces")
        m = model(path)
        for pdf in batches:
            yield pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "t": [transfer(m, t, n, states).tobytes() for t, n in zip(pdf["text"], pdf["size"], strict=True)]})

    def read(t: bytes) -> np.ndarray:
        return np.frombuffer(t).reshape(states, states)

    start = np.full(states, NONE)
    start[0] = 0.0

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = map(read, pdf.sort_values("k")["t"])
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "segment": pdf["segment"].iloc[:1], "t": [functools.reduce(combine, ts).tobytes()]})

    def over_segments(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        return pd.DataFrame({"row": pdf["row"], "segment": pdf["segment"], "start": [f.tobytes() for f in before([read(t) for t in pdf["t"]], start)]})

    def over_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "scores": [f.tobytes() for f in before([read(t) for t in pdf["t"]], np.frombuffer(pdf["start"].iloc[0]))]})

    t = materialize(chunks.select("row", "k", "text", "size").mapInPandas(matrices, "row long, k int, t binary"), "matrices")
    t = t.withColumn("segment", F.expr(f"k div {SEGMENT}").cast("int"))
    products = t.groupBy("row", "segment").applyInPandas(product, "row long, segment int, t binary")
    # at most 2^31 code points in a text, so 2,048 products of 2 kB, and below 262,144 maps of 16 bytes, for one document
    starts = products.groupBy("row").applyInPandas(over_segments, "row long, segment int, start binary")
    scores = t.join(starts, ["row", "segment"]).groupBy("row", "segment").applyInPandas(over_chunks, "row long, k int, scores binary")
    scored = materialize(chunks.join(scores, ["row", "k"]), "scored-chunks")

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_cache("pieces")
        m = model(path)
        for pdf in batches:
            yield pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "map": [entered(m, t, n, states, np.frombuffer(f)) for t, n, f in zip(pdf["text"], pdf["size"], pdf["scores"], strict=True)]})

    def backwards(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ascending=False)
        # a chunk is left where the one after it is entered
        left = list(itertools.accumulate(pdf["map"].iloc[:-1], lambda leave, of: of[leave], initial=0))
        return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "leave": left})

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_cache("pieces")
        m = model(path)
        for pdf in batches:
            yield pd.DataFrame({
                "row": pdf["row"], "k": pdf["k"],
                "ids": [trace_chunk(m, t, n, np.frombuffer(f), e) for t, n, f, e in zip(pdf["text"], pdf["size"], pdf["scores"], pdf["leave"], strict=True)],
            })

    found = scored.select("row", "k", "text", "size", "scores").mapInPandas(maps, "row long, k int, map binary").groupBy("row").applyInPandas(backwards, "row long, k int, leave int")
    parts = scored.join(found, ["row", "k"]).select("row", "k", "text", "size", "scores", "leave").mapInPandas(traced, "row long, k int, ids array<int>")
    joined = parts.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("pieces")
        m = model(path)
        for batch in batches:
            exact = [m.decode(x) == t for x, t in zip(batch.column("ids").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array(exact, pa.bool_())], ["id", "ids", "exact"])

    large = large.join(joined, "row").select("id", "ids", "text").mapInArrow(checked, schema)
    return small.unionByName(large).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """df with the text of its ids; null for null ids."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        m = model(path)
        return ids.map(lambda x: None if x is None else m.decode(list(x)))

    return df.withColumn(to, text(F.col(ids_col)))

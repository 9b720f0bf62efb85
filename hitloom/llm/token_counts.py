"""Token counts of sections, by mapping offsets.

Each document is encoded once as a whole. The byte length of every token gives its
byte span, the lead bytes of the UTF-8 text turn that into code points, and the spans
are joined to the sections that they meet (both are in order, so the join is a binary
search). A token that crosses a boundary counts once, by a stated rule:

* "start": for the section that holds its first code point;
* "most": for the section that holds most of its code points, the earlier in a tie.

A token that starts inside a code point (byte-level pieces) belongs to that code point.
Sections are the lines of the text, each with its line feed, or the intervals of a
column; tokens outside all intervals are counted under section -1. A null text is
empty; an empty text has one empty section 0 (or the given ones) with no tokens.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import pieces

VOCABULARY = "byte_bpe_50k.tiktoken"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoder(path: str):
    """The encoding in a rank file and, by token id, the token's bytes."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last code point (end exclusive) of every token of a text."""
    encoding, lengths = encoder(path)
    ends = np.cumsum(lengths[np.asarray(encoding.encode_ordinary(text), np.int64)])
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    point = np.cumsum((raw & 0xC0) != 0x80) - 1
    if not len(ends):
        return ends, ends
    starts = np.concatenate([[0], ends[:-1]])
    return point[starts], point[ends - 1] + 1


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    after = np.flatnonzero(points == 10) + 1
    starts = np.concatenate([[0], after[after < len(points)]]).astype(np.int64)
    return starts, np.concatenate([starts[1:], [len(points)]]).astype(np.int64)


def attribute(t0: np.ndarray, t1: np.ndarray, s0: np.ndarray, s1: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section [s0, s1) (in order, disjoint), and of none."""
    if not len(s0) or not len(t0):
        return np.zeros(len(s0), np.int64), len(t0)
    first = np.searchsorted(s0, t0, "right") - 1
    at = np.where((first >= 0) & (t0 < s1[first]), first, -1)
    if rule == "most":
        last = np.searchsorted(s0, t1 - 1, "right") - 1
        most = np.where(at >= 0, np.minimum(t1, s1[first]) - t0, 0)
        for step in range(1, int((last - first).max()) + 1):  # sections that one token can meet
            k = np.minimum(first + step, len(s0) - 1)
            here = np.where(first + step <= last, np.minimum(t1, s1[k]) - np.maximum(t0, s0[k]), 0)
            at, most = np.where(here > most, k, at), np.maximum(here, most)
    return np.bincount(at[at >= 0], minlength=len(s0)).astype(np.int64), int((at < 0).sum())


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "start") -> DataFrame:
    """One row a section: the id, section, start, end (code points), n_tokens.

    sections_col: array of struct(start, end), disjoint and in order; None: lines.
    """
    if rule not in ("start", "most"):
        raise ValueError(f"rule {rule!r} is neither 'start' nor 'most'")
    # ids as text, which pandas keeps whole beside a null
    kept = df.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"), *([F.col(sections_col).alias("sections")] if sections_col else []))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, "text"):
            out = []
            for i, row in enumerate(pdf.itertuples(index=False)):
                text = row.text or ""
                t0, t1 = token_spans(text, path)
                if sections_col:
                    given = [(x["start"], x["end"]) for x in (row.sections if row.sections is not None else [])]
                    s0, s1 = np.array([x[0] for x in given], np.int64), np.array([x[1] for x in given], np.int64)
                else:
                    s0, s1 = lines_of(text)
                n, rest = attribute(t0, t1, s0, s1, rule)
                number = np.arange(len(s0))
                if rest:
                    number, s0, s1, n = (np.append(a, b) for a, b in ((number, -1), (s0, 0), (s1, len(text)), (n, rest)))
                out.append((np.full(len(n), i), number, s0, s1, n))
            at, number, s0, s1, n = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pd.DataFrame({"id": pdf["id"].to_numpy(dtype=object)[at], "section": number, "start": s0, "end": s1, "n_tokens": n})

    counted = kept.mapInPandas(count, "id string, section int, start long, end long, n_tokens long")
    return counted.select(F.col("id").cast("long").alias(id_col), *counted.columns[1:])

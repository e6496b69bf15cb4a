"""Splitting oversized texts at natural boundaries (problem 3).

Content-defined chunking: a rolling hash over the last 24 characters puts landmarks where the
text itself says, and each cut is the natural boundary nearest to a landmark within the
least and greatest piece length.  Since landmarks depend on nearby text only, an edit
moves the cuts beside it and leaves the others where they were.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN, MASK = 24, np.uint64((1 << 7) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def rolling_hash(cps: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2**64 of the up to SPAN code points that end at each position."""
    n = len(cps)
    with np.errstate(over="ignore"):
        v = (cps.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(29)
        inv = np.cumprod(np.full(n, _INVERSE, np.uint64))
        up = np.cumprod(np.full(n, _BASE, np.uint64))
        p = np.cumsum(v * inv)
        p[SPAN:] -= p[:-SPAN].copy()
        h = p * up
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def boundary_levels(cps: np.ndarray) -> np.ndarray:
    """Quality of a cut before each position: 4 paragraph, 3 line or sentence, 2 clause, 1 word, 0 none, -1 inside a character cluster."""
    n = len(cps)
    level = np.zeros(n + 1, np.int8)
    if n < 2:
        return level
    space = np.isin(cps, (32, 9, 10, 11, 12, 13, 0x85, 0xA0, 0x2028, 0x2029, 0x3000)) | ((cps >= 0x2000) & (cps <= 0x200A))
    prev, here = cps[:-1], cps[1:]
    after_space = space[:-1] & ~space[1:]
    level[1:n][after_space] = 1
    run = np.maximum.accumulate(np.where(~space, np.arange(n), -1))  # last position that isn't blank
    mark = np.where(run[:-1] >= 0, cps[np.maximum(run[:-1], 0)], 0)
    level[1:n][after_space & np.isin(mark, [ord(c) for c in ",;:)—–"])] = 2
    level[1:n][after_space & np.isin(mark, [ord(c) for c in ".!?…"])] = 3
    newlines = np.cumsum(cps == 10)
    since = newlines[:-1] - np.where(run[:-1] >= 0, newlines[np.maximum(run[:-1], 0)], 0)
    level[1:n][after_space & (since == 1)] = 3
    level[1:n][after_space & (since >= 2)] = 4
    level[1:n][np.isin(prev, [ord(c) for c in "。！？"]) & ~space[1:]] = 3
    high = np.flatnonzero(here > 0x2FF) + 1
    if len(high):
        joined = [i for i in high if unicodedata.combining(chr(cps[i])) or cps[i] in (0x200D, 0xFE0F) or cps[i - 1] == 0x200D]
        level[joined] = -1
    level[1:n][(prev == 13) & (here == 10)] = -1
    return level


def cut_points(text: str, *, limit: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of each piece of the text, in code points.

    A text of ``limit`` or fewer is one piece.  Otherwise no piece is longer than ``limit``,
    each starts up to ``overlap`` characters before the end of the one before it, and
    together they hold every character."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h, level = rolling_hash(cps), boundary_levels(cps)
    marks = np.flatnonzero((h & MASK) == 0) + 1
    good = [np.flatnonzero(level >= q) for q in (4, 3, 2, 1)]
    whole = np.flatnonzero(level >= 0)
    body = limit - overlap
    out, cut, start = [], 0, 0
    while n - start > limit:
        lo, hi = cut + least, cut + body
        inside = marks[np.searchsorted(marks, lo) : np.searchsorted(marks, hi, "right")]
        target = int(inside[np.argmin(h[inside - 1])]) if len(inside) else hi
        end = None
        for g in good:
            near = g[np.searchsorted(g, lo) : np.searchsorted(g, hi, "right")]
            if len(near):
                end = int(near[np.argmin(np.abs(near - target))])
                break
        if end is None:
            near = whole[np.searchsorted(whole, lo) : np.searchsorted(whole, target if len(inside) else hi, "right")]
            end = int(near[-1]) if len(near) else hi
        out.append((start, end))
        cut, start = end, end
        words = good[3][np.searchsorted(good[3], end - overlap) : np.searchsorted(good[3], end)]
        if len(words):
            start = int(words[0])
        else:
            near = whole[np.searchsorted(whole, end - overlap) : np.searchsorted(whole, end)]
            start = int(near[0]) if len(near) else end
        start = max(start, out[-1][0] + 1)
    out.append((start, n))
    return out


def split_texts(rows: DataFrame, *, keys: list[str], text: str, limit: int = 1500, overlap: int = 200, least: int = 500) -> DataFrame:
    """Pieces of each text: (keys, piece, start, length, text), each key's row once.

    ``piece`` counts from 0, ``start`` is the piece's place in the text in code points.  A text of
    up to ``limit`` characters comes out as one piece, an empty one as one empty piece, a null one not
    at all.  Whole texts are read whatever their length; repeated rows give repeated pieces unless
    ``keys`` tell them apart, so pass distinct rows.  Columns other than keys and text are ignored.
    """
    fields = [rows.select(*keys).schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("piece", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("text", T.StringType())])

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            values, got = [pdf[k].tolist() for k in keys], []
            for r, t in enumerate(pdf["_text"]):
                for i, (a, z) in enumerate(cut_points(t, limit=limit, overlap=overlap, least=least)):
                    got.append((*[v[r] for v in values], i, a, z - a, t[a:z]))
                if len(got) >= 4096:
                    yield pd.DataFrame(got, columns=schema.names)
                    got = []
            yield pd.DataFrame(got, columns=schema.names)

    return rows.filter(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text")).mapInPandas(cut, schema)

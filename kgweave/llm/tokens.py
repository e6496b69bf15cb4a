"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

Pre-tokenisation is vectorised and uses no regex: code points become class symbols, and an
eight-state automaton finds where pieces start.  Its run is an associative scan: blocks of
the text compose their transition functions side by side, the block functions are scanned,
and with each block's first state known all blocks run again side by side.  Pieces then go
through pair merging with a cache.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Symbols: letter, number, other, apostrophe that opens a contraction of 2 or 3, blank before a
# non-blank, other white space before a non-blank, white space before white space or the end, end of text.
L, N, O, A2, A3, BLANK, LAST, SPACE, END = range(9)
# States: nothing open, letters, numbers, others, blank that opens a piece, white space, 1 or 2 more of a contraction.
_OPEN, _L, _N, _O, _B, _S, _C1, _C2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by symbol and state."""
    step, start = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
    for s in range(8):
        for c in range(9):
            if c == END:
                to, new = _OPEN, False
            elif s == _C2:
                to, new = _C1, False
            elif s == _C1:
                to, new = _OPEN, False
            elif c in (L, N, O):
                to = (_L, _N, _O)[c]
                new = s not in (to, _B)
            elif c in (A2, A3):
                to, new = (_O, False) if s in (_O, _B) else ((_C1, _C2)[c - A2], True)
            elif c == BLANK:
                to, new = _B, True
            elif c == LAST:
                to, new = _OPEN, True
            else:
                to, new = _S, s != _S
            step[c, s], start[c, s] = to, new
    return step, start


STEP, STARTS = _automaton()
_CLASS: np.ndarray | None = None


def classes() -> np.ndarray:
    """L, N, O or SPACE of each code point."""
    global _CLASS
    if _CLASS is None:
        table = np.full(0x110000, O, np.uint8)
        cat = unicodedata.category
        for cp in range(0x110000):
            c = cat(chr(cp))[0]
            if c == "L":
                table[cp] = L
            elif c == "N":
                table[cp] = N
        table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _CLASS = table
    return _CLASS


def symbols(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points of texts laid end to end, each followed by a place marked in ``ends``."""
    c = classes()[np.where(ends, 0, cps)]
    c[ends] = END
    out = c.copy()
    following = np.append(c[1:], END)
    solid = (c == SPACE) & (following < SPACE)
    out[solid & (cps == 32)] = BLANK
    out[solid & (cps != 32)] = LAST
    at = np.flatnonzero((cps == 39) & ~ends)
    if len(at):
        padded = np.append(np.where(ends, 0, cps), [0, 0])
        a, b = padded[at + 1], padded[at + 2]
        out[at[np.isin(a, [ord(x) for x in "stmd"])]] = A2
        out[at[((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)]] = A3
    return out


def piece_starts(sym: np.ndarray, block: int = 128) -> np.ndarray:
    """Whether a piece starts at each symbol."""
    n = len(sym)
    rows = -(-n // block)
    s = np.full(rows * block, END, np.uint8)
    s[:n] = sym
    s = np.ascontiguousarray(s.reshape(rows, block).T)
    flat = STEP.ravel()
    f = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
    for t in range(block):
        f = flat[s[t][:, None].astype(np.uint16) * 8 + f]
    scan, k = f, 1  # prefix composition by doubling
    while k < rows:
        scan = np.concatenate([scan[:k], np.take_along_axis(scan[k:], scan[:-k].astype(np.intp), 1)])
        k *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = scan[:-1, 0]
    out = np.empty((block, rows), bool)
    first = STARTS.ravel()
    for t in range(block):
        at = s[t].astype(np.uint16) * 8 + state
        out[t] = first[at]
        state = flat[at]
    return out.T.ravel()[:n]


class Encoder:
    """Byte-level BPE with ranks read from ``vocabulary`` (lines of base64 token and rank)."""

    def __init__(self, vocabulary: str = VOCABULARY, *, cache: int = 400_000, part_chars: int = 1 << 20):
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cache_size, self.part_chars = cache, part_chars
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one piece: always the pair of the lowest rank, of equals the first, is merged; by a heap, in n log n."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\x01" * n)
        while heap:
            _, i, z = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != z or not alive[j]:
                continue
            end[i], alive[j], nxt[i] = z, 0, nxt[j]
            if nxt[i] < n:
                k = nxt[i]
                prev[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:z])) is not None:
                heapq.heappush(heap, (r, p, z))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return tuple(out)

    def pieces(self, texts: list[str]) -> Iterator[list[int]]:
        """Starts of the pieces of each text, in code points."""
        group: list[str] = []
        size = 0
        for t in [*texts, None]:
            if t is not None:
                group.append(t)
                size += len(t) + 1
            if group and (t is None or size >= self.part_chars):
                cps = np.frombuffer(("\0".join(group) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
                stops = np.cumsum([len(g) + 1 for g in group]) - 1
                ends = np.zeros(len(cps), bool)
                ends[stops] = True
                at = np.flatnonzero(piece_starts(symbols(cps, ends)))
                bounds = np.searchsorted(at, stops)
                a = base = 0
                for b, stop in zip(bounds.tolist(), stops.tolist(), strict=True):
                    yield (at[a:b] - base).tolist()
                    a, base = b, stop + 1
                group, size = [], 0

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text."""
        cache = self.cache
        for text, starts in zip(texts, self.pieces(texts), strict=True):
            ids: list[int] = []
            for a, z in zip(starts, [*starts, len(text)][1:], strict=True):
                piece = text[a:z]
                got = cache.get(piece)
                if got is None:
                    got = self.merge(piece.encode("utf-8", "surrogatepass"))
                    if len(cache) >= self.cache_size:
                        cache.clear()
                    if len(piece) <= 64:
                        cache[piece] = got
                ids.extend(got)
            yield ids

    def offsets(self, ids: list[int]) -> list[int]:
        """Where each token starts in the text's UTF-8 bytes."""
        self._by_id()
        return np.cumsum([0, *[len(self.tokens[i]) for i in ids[:-1]]]).tolist() if ids else []

    def decode(self, ids: list[int]) -> str:
        self._by_id()
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "surrogatepass")

    def _by_id(self) -> None:
        if not hasattr(self, "tokens"):
            self.tokens = {v: k for k, v in self.ranks.items()}


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each Python worker, so its cache lasts over batches."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def encode_texts(rows: DataFrame, *, key: str, text: str, vocabulary: str = VOCABULARY, with_offsets: bool = False) -> DataFrame:
    """(key, ids): each row's token ids, without special tokens; with_offsets adds each token's first byte.

    Null and empty texts have no tokens: an empty list.  Special tokens' strings are ordinary text.
    Every row comes out, repeated ones too; other columns are ignored."""
    fields = [rows.select(key).schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if with_offsets:
        fields.append(T.StructField("offsets", T.ArrayType(T.IntegerType())))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary)
        for pdf in parts:
            ids = [np.array(i, np.int32) for i in e.encode(pdf["_t"].tolist())]
            out = pd.DataFrame({key: pdf[key], "ids": ids})
            if with_offsets:
                out["offsets"] = [np.array(e.offsets(i.tolist()), np.int32) for i in ids]
            yield out

    return rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInPandas(run, T.StructType(fields))


def count_tokens(rows: DataFrame, *, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens): how many tokens each row's text has; 0 for null and empty ones."""
    schema = T.StructType([rows.select(key).schema[key], T.StructField("tokens", T.IntegerType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary)
        for pdf in parts:
            yield pd.DataFrame({key: pdf[key], "tokens": np.fromiter(map(len, e.encode(pdf["_t"].tolist())), np.int32, len(pdf))})

    return rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInPandas(run, schema)

"""Personal information inside free text (problem 10).

Spans come from the character tagger of :mod:`kgweave.llm.pii_model`.  An exact check follows
that only trims a span's edges, makes its words whole and drops one that can't be what it is said to be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pii_model import Tagger

PART_CHARS = 400_000
PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]"}
_TITLE = re.compile(r"^(?:(?:dr|prof|mr|mrs|ms|frau|herr|mme|sr|sra|dra)\b\.?\s+)+", re.I)

_TITLED = re.compile(r"\b(?:dr|prof|mr|mrs|ms|frau|herr|mme|m|sr|sra|dra)\.?\s+$", re.I)


def check_span(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span with blanks and stray marks trimmed off its edges and words made whole, or None if it lacks what its kind must have."""
    edge = {"name": ",;:<>()[]|\"", "email": ",;:.<>()|\"", "phone": ",;:.", "id_number": ",;:.#()", "address": ",;:()"}[kind]
    while a < b and (text[a].isspace() or text[a] in edge.replace("(", "" if kind == "phone" else "(")):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in edge):
        b -= 1
    if kind in ("name", "address") and a < b:  # never half a word
        while a and text[a].isalpha() and text[a - 1].isalpha():
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    if kind == "name":
        m = _TITLE.match(s)
        a += m.end() if m else 0
        s = text[a:b]
        if s.islower() and s.isalpha() and not _TITLED.search(text[max(0, a - 12) : a]):  # one small word is a name only after a title
            return None
        return (a, b) if sum(c.isalpha() for c in s) >= 3 and not digits else None
    if kind == "email":
        return (a, b) if len(s) >= 6 and ("@" in s or re.search(r"[\[(]\s*at\s*[\])]", s, re.I)) else None
    if kind == "phone":
        return (a, b) if 7 <= digits <= 16 else None
    if kind == "id_number":
        return (a, b) if digits >= 4 else None
    return (a, b) if digits and len(s) >= 6 else None


_TAGGER: list[Tagger] = []


def _tagger() -> Tagger:
    """One tagger for each Python worker."""
    if not _TAGGER:
        _TAGGER.append(Tagger())
    return _TAGGER[0]


def tag_texts(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Checked spans of each text, a bounded number of characters at a time."""
    tagger, group, size = _tagger(), [], 0
    for t in [*texts, None]:
        if t is not None:
            group.append(t)
            size += len(t)
        if group and (t is None or size >= PART_CHARS):
            for text, spans in zip(group, tagger.spans(group), strict=True):
                out: list[tuple[int, int, str]] = []
                for a, b, k in spans:
                    s = check_span(text, a, b, k)
                    if s and s[0] >= (out[-1][1] if out else 0):
                        out.append((*s, k))
                yield out
            group, size = [], 0


def find_pii(rows: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, kind, value): each value once for each key and kind, exactly as it stands in the text.

    Whole texts are read; null and empty ones hold nothing.  Repeated rows count once, other columns are ignored."""
    schema = T.StructType([rows.select(key).schema[key], T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = pdf["_t"].tolist()
            got = [(k, kind, t[a:b]) for k, t, spans in zip(pdf[key].tolist(), texts, tag_texts(texts), strict=True) for a, b, kind in spans]
            yield pd.DataFrame(got, columns=schema.names)

    return rows.filter(F.length(text) > 0).select(key, F.col(text).alias("_t")).mapInPandas(run, schema).distinct()


def redact(rows: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, text, found): texts with each span replaced by its kind's placeholder and the number of spans.

    All else in the text stays as it is; null stays null with 0 found.  Repeated rows come out repeated."""
    schema = T.StructType([rows.select(key).schema[key], T.StructField("text", T.StringType()), T.StructField("found", T.IntegerType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = [t if isinstance(t, str) else None for t in pdf["_t"]]
            out, counts = [], []
            for t, spans in zip(texts, tag_texts([t or "" for t in texts]), strict=True):
                bits, at = [], 0
                for a, b, kind in spans:
                    bits += [t[at:a], PLACEHOLDERS[kind]]
                    at = b
                out.append(t if t is None else "".join([*bits, t[at:]]))
                counts.append(len(spans))
            yield pd.DataFrame({key: pdf[key], "text": out, "found": pd.Series(counts, dtype="int32")})

    return rows.select(key, F.col(text).alias("_t")).mapInPandas(run, schema)

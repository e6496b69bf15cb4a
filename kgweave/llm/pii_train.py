"""Train the personal-information tagger: ``python -m kgweave.llm.pii_train DOCUMENTS_PARQUET [EPOCHS [LEFT_OUT_PARQUET]]``.

Bounded sample (documented parameters): of the texts of one documents table, at most ``MAX_WINDOWS`` windows with a labelled span, as
many whose spans are replaced by made-up ones, as many of made-up sentences among ordinary text, and as many without a span,
drawn by a seed.  Every tenth document, and every text of a second table if given, is left out of training; the
former are scored.  Weights go to ``pii_model.npz`` beside this file.
"""

from __future__ import annotations

import sys
import time

import numpy as np

from .pii_labels import KINDS, label
from .pii_model import MODEL_FILE, PAD, STEP, Tagger, encode, fit, tags_of
from .pii_synthetic import Maker

MAX_WINDOWS, LENGTH = 14_000, 128


def windows(texts: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    r, maker = np.random.default_rng(seed), Maker(seed)
    groups: list[list] = [[], [], [], []]  # as labelled, replaced, made up, without
    known: dict[str, list[str]] = {k: [] for k in KINDS}
    for text in texts:
        for a, b, k in label(text):
            known[k].append(text[a:b])
    for text in texts:
        spans = label(text)
        others = [maker.replaced(text, spans), maker.replaced(text, spans, of=known)] if spans else []
        for g, (t, s) in zip((0, 1, 1), [(text, spans), *others], strict=False):
            x, y = encode(t), tags_of(len(t), s)
            used = np.zeros(len(x), bool)
            for a, _, _ in s:
                start = max(0, min(a - int(r.integers(5, 60)), len(x) - LENGTH))
                groups[g].append((x, y, start))
                used[max(0, start - LENGTH // 2) : start + LENGTH] = True
            if g == 0:
                for start in range(0, max(1, len(x)), LENGTH):
                    if r.random() < 0.3 and not used[start : start + LENGTH].any():
                        groups[3].append((x, y, start))
        if len(text) > 40 and not spans:
            made, s = maker.sentence()
            cut = int(r.integers(0, min(len(text), 60)))
            t = text[:cut] + ". " * (r.random() < 0.7) + made + " " + text[cut : cut + 100]
            shift = t.index(made)
            groups[2].append((encode(t), tags_of(len(t), [(a + shift, b + shift, k) for a, b, k in s]), 0))
    while len(groups[2]) < MAX_WINDOWS:
        t, s = "", []
        while len(t) < LENGTH:
            made, more = maker.sentence()
            s += [(a + len(t), b + len(t), k) for a, b, k in more]
            t += made + " "
        groups[2].append((encode(t), tags_of(len(t), s), int(r.integers(0, 8))))
    parts = []
    for group in groups:
        parts += [group[i] for i in r.permutation(len(group))[:MAX_WINDOWS]]
    xs, ys = np.full((len(parts), LENGTH), PAD, np.int16), np.zeros((len(parts), LENGTH), np.int8)
    for k, (x, y, a) in enumerate(parts):
        n = min(LENGTH, len(x) - a)
        xs[k, :n], ys[k, :n] = x[a : a + n], y[a : a + n]
    return xs, ys


def score(tagger: Tagger, texts: list[str]) -> dict[str, tuple[float, float]]:
    """Precision and recall of exact spans by kind."""
    hit, said, true = ({k: 0 for k in KINDS} for _ in range(3))
    for text, got in zip(texts, tagger.spans(texts), strict=True):
        gold = set(label(text))
        for s in got:
            said[s[2]] += 1
            hit[s[2]] += s in gold
        for s in gold:
            true[s[2]] += 1
    return {k: (round(hit[k] / max(said[k], 1), 4), round(hit[k] / max(true[k], 1), 4)) for k in KINDS}


def main(path: str, epochs: int = 6, left_out: str | None = None) -> None:
    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist() if r["text"]]
    out = {r["text"] for r in pq.read_table(left_out, columns=["text"]).to_pylist()} if left_out else set()
    held = list({r["text"] for r in rows if r["doc_id"] % 10 == 0})
    train = sorted({r["text"] for r in rows} - set(held) - out)
    began = time.time()
    xs, ys = windows(train)
    print(f"{len(xs)} windows, {time.time() - began:.0f} s", flush=True)
    assert LENGTH % STEP == 0
    w = fit(xs, ys, epochs=epochs, say=lambda m: print(f"{m}, {time.time() - began:.0f} s", flush=True))
    np.savez_compressed(MODEL_FILE, **{k: v.astype(np.float16) for k, v in w.items()})
    print(score(Tagger(), held), flush=True)


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]), *sys.argv[3:4])

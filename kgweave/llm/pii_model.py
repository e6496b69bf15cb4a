"""Character-level bidirectional LSTM with CRF transitions, in numpy.

:func:`fit` trains it from labelled spans by full back-propagation and Adam;
:class:`Tagger` decodes texts: overlapping windows run through both directions, each
position takes its scores from the window in which it lies deepest, and a Viterbi pass
over the scores of the whole text reconciles them, so spans may cross windows.

Both directions read STEP characters at a time and give each of them scores of its own, to which
tables for a character and its neighbours add.  Every character of every text is decoded; nothing
decides beforehand where spans may be.  The Viterbi pass leaves out only positions whose scores
prove, whatever stands around them, that the best path is outside of spans there.
"""

from __future__ import annotations

import multiprocessing
import unicodedata
from pathlib import Path

import numpy as np

from .pii_labels import KINDS


def _one_thread() -> None:
    """Keep matrix products on the task's own thread: for small ones a pool of threads costs far more than it saves."""
    import ctypes
    import re

    try:
        with open("/proc/self/maps") as f:
            libs = {line.split()[-1] for line in f if re.search(r"(openblas|mkl_rt|libblis)[^/]*\.so", line)}
    except OSError:
        return
    for lib in libs:
        for name in ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_", "MKL_Set_Num_Threads", "bli_thread_set_num_threads"):
            call = getattr(ctypes.CDLL(lib), name, None)
            if call is not None:
                call(1)

TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
K = len(TAGS)
STEP = 4
#: Multiples of STEP, so that a character's place in its step depends on its text alone.
WINDOW, MARGIN = 320, 32
MODEL_FILE = Path(__file__).with_name("pii_model.npz")


def _char_table() -> tuple[np.ndarray, int]:
    """Class of each code point below 0x2100; ASCII by itself, other letters by their base letter."""
    table = np.empty(0x2100, np.int16)
    for cp in range(0x2100):
        c = chr(cp)
        if cp < 128:
            table[cp] = cp
            continue
        base = unicodedata.normalize("NFKD", c)[0]
        if base < "\x80" and base.isalpha():
            table[cp] = ord(base)
        else:
            cat = unicodedata.category(c)
            table[cp] = {"Lu": 128, "Ll": 129, "Nd": 130, "Zs": 32, "Cf": 131, "Mn": 132}.get(cat, 133 if cat[0] == "P" else 134)
    return table, 136


_TABLE, VOCAB = _char_table()
PAD = 135


def encode(text: str) -> np.ndarray:
    """Character classes of a text, one for each code point."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cps < len(_TABLE), _TABLE[np.minimum(cps, len(_TABLE) - 1)], 134).astype(np.int16)


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(n, np.int8)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        y[a:b] = k + 1
        y[a] = k
    return y


def init(hidden: int = 32, embed: int = 12, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {"E": r.normal(0, 0.3, (VOCAB, embed))}
    for d in "fb":
        w["X" + d] = r.normal(0, 1 / np.sqrt(STEP * embed), (STEP * embed, 4 * hidden))
        w["H" + d] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        w["b" + d] = np.zeros(4 * hidden)
        w["b" + d][hidden : 2 * hidden] = 1.0
    w["O"] = r.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, STEP * K))
    w["c"] = np.zeros(STEP * K)
    w["N"] = np.zeros((3, VOCAB, K))  # of the character before, this one, the next
    w["T"] = np.zeros((K, K))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(w: dict, d: str, z: np.ndarray, keep: bool):
    """z: input projections [T, B, 4H] in the order of time of this direction; gates i, f, o, g."""
    t_max, b, h4 = z.shape
    n = h4 // 4
    h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
    hs = np.empty((t_max, b, n), np.float32)
    memo = (np.empty((t_max, b, h4), np.float32), np.empty((t_max, b, n), np.float32), np.empty((t_max, b, n), np.float32)) if keep else None
    for t in range(t_max):
        a = h @ w["H" + d]
        a += z[t]
        s = _sigmoid(a[:, : 3 * n])
        g = np.tanh(a[:, 3 * n :])
        c = s[:, n : 2 * n] * c + s[:, :n] * g
        tc = np.tanh(c)
        h = s[:, 2 * n :] * tc
        hs[t] = h
        if keep:
            memo[0][t, :, : 3 * n], memo[0][t, :, 3 * n :], memo[1][t], memo[2][t] = s, g, c, tc
    return hs, memo


def _lstm_fast(h_w: np.ndarray, proj: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hidden states [T, B, H] for pairs of classes x [T, B, STEP / 2]; ``h_w`` and ``proj`` (a table for each pair) have the columns of i, f and o halved, so one tanh serves all gates."""
    t_max, b, _ = x.shape
    n = h_w.shape[0]
    hs = np.empty((t_max, b, n), np.float32)
    a, z = np.empty((b, 4 * n), np.float32), np.empty((b, 4 * n), np.float32)
    h, c, ig = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32), np.empty((b, n), np.float32)
    s, g = a[:, : 3 * n], a[:, 3 * n :]
    for t in range(t_max):
        np.matmul(h, h_w, out=a)
        for j in range(STEP // 2):
            a += np.take(proj[j], x[t, :, j], axis=0, out=z, mode="clip")
        np.tanh(a, out=a)
        s *= 0.5
        s += 0.5
        c *= s[:, n : 2 * n]
        np.multiply(s[:, :n], g, out=ig)
        c += ig
        h = hs[t]
        np.tanh(c, out=h)
        h *= s[:, 2 * n :]
    return hs


def _lstm_back(w: dict, d: str, dh_all: np.ndarray, hs: np.ndarray, memo):
    gates, cs, tcs = memo
    t_max, b, n = hs.shape
    dz = np.empty((t_max, b, 4 * n), np.float32)
    dh_next, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
    for t in range(t_max - 1, -1, -1):
        i, f, o, g = (gates[t, :, k * n : (k + 1) * n] for k in range(4))
        dh = dh_all[t] + dh_next
        dc = dc + dh * o * (1 - tcs[t] ** 2)
        prev = cs[t - 1] if t else 0.0
        dz[t, :, :n] = dc * g * i * (1 - i)
        dz[t, :, n : 2 * n] = dc * prev * f * (1 - f)
        dz[t, :, 2 * n : 3 * n] = dh * tcs[t] * o * (1 - o)
        dz[t, :, 3 * n :] = dc * i * (1 - g * g)
        dh_next = dz[t] @ w["H" + d].T
        dc = dc * f
    prev_h = np.concatenate([np.zeros((1, b, n), np.float32), hs[:-1]])
    return dz, np.einsum("tbi,tbj->ij", prev_h, dz, optimize=True)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


def _crf_grad(em: np.ndarray, y: np.ndarray, trans: np.ndarray):
    """Mean negative log-likelihood and gradients; em [T, B, K], y [T, B]."""
    t_max, b, _ = em.shape
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[0] = em[0]
    for t in range(1, t_max):
        alpha[t] = em[t] + _logsumexp(alpha[t - 1][:, :, None] + trans[None], 1)
    for t in range(t_max - 2, -1, -1):
        beta[t] = _logsumexp(trans[None] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = _logsumexp(alpha[-1], 1)
    prob = np.exp(alpha + beta - log_z[None, :, None])
    ti, bi = np.meshgrid(np.arange(t_max), np.arange(b), indexing="ij")
    gold = em[ti, bi, y].sum() + trans[y[:-1], y[1:]].sum()
    d_em = prob.copy()
    d_em[ti, bi, y] -= 1
    d_tr = np.zeros_like(trans)
    for t in range(t_max - 1):
        p = alpha[t][:, :, None] + trans[None] + (em[t + 1] + beta[t + 1])[:, None, :] - log_z[:, None, None]
        d_tr += np.exp(p).sum(0)
    np.add.at(d_tr, (y[:-1].ravel(), y[1:].ravel()), -1)
    return float(log_z.sum() - gold) / b, d_em / b, d_tr / b


def _around(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x [T, B] as the character before, the character itself and the next, PAD beyond the ends."""
    pad = np.full_like(x[:1], PAD)
    return np.concatenate([pad, x[:-1]]), x, np.concatenate([x[1:], pad])


def step(w: dict, x: np.ndarray, y: np.ndarray):
    """Loss and gradients of one batch; x, y: [B, T], T a multiple of STEP."""
    x, y = x.T.astype(np.int64), y.T.astype(np.int64)
    t_max, b = x.shape
    blocks = x.reshape(t_max // STEP, STEP, b).transpose(0, 2, 1)
    e = w["E"][blocks].reshape(t_max // STEP, b, -1)
    zf, zb = e @ w["Xf"] + w["bf"], e[::-1] @ w["Xb"] + w["bb"]
    hf, mf = _lstm(w, "f", zf, True)
    hb, mb = _lstm(w, "b", zb, True)
    hcat = np.concatenate([hf, hb[::-1]], axis=2)
    em = (hcat @ w["O"] + w["c"]).reshape(t_max // STEP, b, STEP, K).transpose(0, 2, 1, 3).reshape(t_max, b, K)
    near = _around(x)
    em = em + sum(w["N"][i][near[i]] for i in range(3))
    loss, d_em, d_tr = _crf_grad(em, y, w["T"])
    g = {"T": d_tr, "N": np.zeros_like(w["N"])}
    for i in range(3):
        np.add.at(g["N"][i], near[i].ravel(), d_em.reshape(-1, K))
    d_out = d_em.reshape(t_max // STEP, STEP, b, K).transpose(0, 2, 1, 3).reshape(t_max // STEP, b, STEP * K)
    g["c"] = d_out.sum((0, 1))
    g["O"] = np.einsum("tbi,tbk->ik", hcat, d_out, optimize=True)
    dh = d_out @ w["O"].T
    n = hf.shape[2]
    dzf, g["Hf"] = _lstm_back(w, "f", np.ascontiguousarray(dh[:, :, :n]), hf, mf)
    dzb, g["Hb"] = _lstm_back(w, "b", np.ascontiguousarray(dh[::-1, :, n:]), hb, mb)
    g["bf"], g["bb"] = dzf.sum((0, 1)), dzb.sum((0, 1))
    g["Xf"] = np.einsum("tbe,tbj->ej", e, dzf, optimize=True)
    g["Xb"] = np.einsum("tbe,tbj->ej", e[::-1], dzb, optimize=True)
    de = dzf @ w["Xf"].T + (dzb @ w["Xb"].T)[::-1]
    g["E"] = np.zeros_like(w["E"])
    np.add.at(g["E"], blocks.ravel(), de.reshape(-1, w["E"].shape[1]))
    return loss, g


def _shard(job):
    w, rows = job
    return len(rows), *step(w, _DATA[0][rows], _DATA[1][rows])


_DATA: tuple = ()


def fit(windows: np.ndarray, tags: np.ndarray, *, hidden: int = 32, epochs: int = 6, batch: int = 128, rate: float = 8e-3, seed: int = 7, workers: int = 8, say=None) -> dict:
    """Train on windows [N, T] of character classes and their tags; Adam with a decaying rate and clipped
    gradients.  Each batch is shared among worker processes whose gradients are averaged."""
    global _DATA
    _DATA = (windows, tags)
    with multiprocessing.get_context("fork").Pool(workers) as pool:
        return _fit(pool, len(windows), hidden, epochs, batch, rate, seed, workers, say)


def _fit(pool, rows_all: int, hidden: int, epochs: int, batch: int, rate: float, seed: int, workers: int, say) -> dict:
    w, r = init(hidden, seed=seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    total, n = epochs * -(-rows_all // batch), 0
    for epoch in range(epochs):
        order, losses = r.permutation(rows_all), []
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            parts = pool.map(_shard, [(w, p) for p in np.array_split(rows, min(workers, len(rows)))], chunksize=1)
            loss = sum(c * x for c, x, _ in parts) / len(rows)
            g = {q: sum(c * np.asarray(x[q], np.float32) for c, _, x in parts) / len(rows) for q in w}
            losses.append(loss)
            n += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            lr = rate * (0.03 + 0.97 * 0.5 * (1 + np.cos(np.pi * n / total)))
            for q, a in g.items():
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                m[q] = 0.9 * m[q] + 0.1 * a
                v[q] = 0.99 * v[q] + 0.01 * a * a
                w[q] -= (lr * (m[q] / (1 - 0.9**n)) / (np.sqrt(v[q] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        if say:
            say(f"epoch {epoch}: loss {np.mean(losses):.3f}")
    return w


class Tagger:
    """Decodes texts with trained weights; results don't depend on which texts share a call."""

    def __init__(self, w: dict | None = None, *, window: int = WINDOW, margin: int = MARGIN, batch: int = 256):
        if w is None:
            with np.load(MODEL_FILE) as z:
                w = {k: z[k].astype(np.float32) for k in z.files if k != "gate"}
        _one_thread()
        self.w, self.window, self.margin, self.batch = w, window, margin, batch
        half = np.ones(w["Hf"].shape[1], np.float32)
        half[: 3 * len(w["Hf"])] = 0.5
        parts = w["E"].shape[1]
        one = {d: [(w["E"] @ w["X" + d][j * parts : (j + 1) * parts] + (w["b" + d] if j == 0 else 0)) * half for j in range(STEP)] for d in "fb"}
        self.proj = {d: [(t[j][:, None] + t[j + 1][None]).reshape(VOCAB * VOCAB, -1).astype(np.float32) for j in range(0, STEP, 2)] for d, t in one.items()}
        self.rec = {d: w["H" + d] * half for d in "fb"}
        t = w["T"]
        # What transitions can add, at most, to a span's gain over O: by character, and once for its ends.
        self.each = float(t[1:, 1:].max() - t[0, 0])
        self.ends = float(max(t[0, 1:].max() - t[0, 0], 0) + max(t[1:, 0].max() - t[0, 0], 0)) - self.each + 1e-3

    def _emissions(self, x: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """x [B, T] padded on the right, T a multiple of STEP; the backward pass starts at each row's own last step."""
        b, t_max = x.shape
        pairs = x.reshape(b, t_max // STEP, STEP // 2, 2)
        blocks = (pairs[..., 0] * VOCAB + pairs[..., 1]).astype(np.int32)
        hf = _lstm_fast(self.rec["f"], self.proj["f"], np.ascontiguousarray(blocks.transpose(1, 0, 2)))
        at = steps[:, None] - 1 - np.arange(t_max // STEP)[None]
        rows = np.arange(b)[:, None]
        back = np.where((at >= 0)[:, :, None], blocks[rows, np.maximum(at, 0)], PAD * VOCAB + PAD)
        hb = _lstm_fast(self.rec["b"], self.proj["b"], np.ascontiguousarray(back.transpose(1, 0, 2)))
        n = hf.shape[2]
        ef = hf.reshape(-1, n) @ self.w["O"][:n] + self.w["c"]
        eb = (hb.reshape(-1, n) @ self.w["O"][n:]).reshape(t_max // STEP, b, STEP * K)
        em = ef.reshape(t_max // STEP, b, STEP * K).transpose(1, 0, 2) + eb.transpose(1, 0, 2)[rows, np.maximum(at, 0)]
        return em.reshape(b, t_max, K)

    def emissions(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """Tag scores [n, K] of each text."""
        plan = []
        stride = self.window - 2 * self.margin
        for i, c in enumerate(codes):
            n, a = len(c), 0
            while n:
                last = a + self.window >= n
                z = n if last else a + self.window
                plan.append((i, a, z, a if a == 0 else a + self.margin, z if last else z - self.margin))
                if last:
                    break
                a += stride
        out = [np.empty((len(c), K), np.float32) for c in codes]
        plan.sort(key=lambda p: p[2] - p[1])
        for k in range(0, len(plan), self.batch):
            part = plan[k : k + self.batch]
            steps = np.array([-(-(p[2] - p[1]) // STEP) for p in part])
            x = np.full((len(part), steps.max() * STEP), PAD, np.int64)
            for r, (i, a, z, _, _) in enumerate(part):
                x[r, : z - a] = codes[i][a:z]
            em = self._emissions(x, steps)
            for r, (i, a, _, p, q) in enumerate(part):
                out[i][p:q] = em[r, p - a : q - a]
        for o, c in zip(out, codes, strict=True):
            if len(c):
                o += self.w["N"][1][c]
                o[1:] += self.w["N"][0][c[:-1]]
                o[0] += self.w["N"][0][PAD]
                o[:-1] += self.w["N"][2][c[1:]]
                o[-1] += self.w["N"][2][PAD]
        return out

    def _tags(self, ems: list[np.ndarray], piece: int = 512) -> list[np.ndarray]:
        """Best tags of each text, long texts cut into pieces that are decoded side by side.

        A span on the best path gains over O: its characters' leads over O, with all that transitions could add, sum up to more than
        nothing.  Characters in no stretch of which that holds are O on the best path whatever stands around.  Texts are cut only at
        such characters, which both pieces hold as an O, so the result is that of decoding the text whole."""
        tags = [np.zeros(len(e), np.int8) for e in ems]
        runs, where = [], []
        for i, e in enumerate(ems):
            cuts = [0]
            if len(e) > piece:
                lead = e[:, 1].copy()
                for k in range(2, K):
                    np.maximum(lead, e[:, k], out=lead)
                lead -= e[:, 0]
                sums = np.cumsum(lead.astype(np.float64) + self.each)
                most = np.maximum.accumulate(sums[::-1])[::-1]
                least = np.minimum.accumulate(np.r_[0.0, sums[:-1]])
                sure = np.flatnonzero(most - least + self.ends <= 0)
                while cuts[-1] + piece < len(e):
                    at = np.searchsorted(sure, cuts[-1] + piece)
                    if at == len(sure):
                        break
                    cuts.append(int(sure[at]))
            for lo, hi in zip(cuts, [*cuts[1:], len(e) - 1], strict=True):
                run = e[lo : hi + 1]
                if lo or hi < len(e) - 1:
                    run = run.copy()
                    if lo:
                        run[0, 1:] = -1e4
                    if hi < len(e) - 1:
                        run[-1, 1:] = -1e4
                runs.append(run)
                where.append((i, lo, hi + 1))
        for (i, lo, hi), t in zip(where, self._viterbi(runs), strict=True):
            tags[i][lo:hi] = t
        return tags

    def _viterbi(self, ems: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each text; texts of like length are decoded side by side.  Only scores are kept on the
        way forward, the best predecessors are found again on the way back."""
        tr = self.w["T"]
        tags = [np.zeros(len(e), np.int8) for e in ems]
        order = [int(i) for i in np.argsort([len(e) for e in ems], kind="stable") if len(ems[i])]
        while order:
            t_max = len(ems[order[-1]])
            part = order[-max(1, min(512, (1 << 19) // t_max)) :]
            del order[-len(part) :]
            b = len(part)
            score = np.zeros((t_max, K, b), np.float32)
            score[:, 1:] = -1e4  # padding is O
            for r, i in enumerate(part):
                score[: len(ems[i]), :, r] = ems[i]
            best, s = np.empty((K, b), np.float32), np.empty((K, b), np.float32)
            for t in range(1, t_max):
                last = score[t - 1]
                np.add(last[0], tr[0][:, None], out=best)
                for j in range(1, K):
                    np.add(last[j], tr[j][:, None], out=s)
                    np.maximum(best, s, out=best)
                score[t] += best
            path = np.empty((t_max, b), np.int8)
            path[-1] = score[-1].argmax(0)
            for t in range(t_max - 1, 0, -1):
                path[t - 1] = (score[t - 1] + tr[:, path[t]]).argmax(0)
            for r, i in enumerate(part):
                tags[i] = path[: len(ems[i]), r].copy()
        return tags

    def stretches(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, start, end) of what is decoded: every text from its first to its last character."""
        return [(i, 0, len(t)) for i, t in enumerate(texts) if t]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) in code points of each text."""
        plan = self.stretches(texts)
        codes = [encode(texts[i][a:z]) for i, a, z in plan]
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for (i, a, _), tags in zip(plan, self._tags(self.emissions(codes)), strict=True):
            at = np.flatnonzero(tags)
            if len(at):
                kind = (tags[at] + 1) // 2
                new = np.r_[True, (np.diff(at) > 1) | (np.diff(kind) != 0) | (tags[at][1:] % 2 == 1)]
                starts = np.flatnonzero(new)
                for s, e in zip(starts, np.r_[starts[1:], len(at)], strict=True):
                    out[i].append((a + int(at[s]), a + int(at[e - 1]) + 1, KINDS[kind[s] - 1]))
        return out

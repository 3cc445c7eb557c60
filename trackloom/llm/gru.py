"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax.

A token's class comes first: each of the frequent words belongs to one of CLASSES classes and has a softmax within it;
other words belong to classes by how often they occur and get a fixed share of their class, which is not this model's
part. Documents lie end to end in lanes; a state is carried from window to window and reset where a document begins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    """words: frequent words, a multiple of classes; rest: classes of other words. Codes of words are 0 .. words-1, those
    of other classes follow."""

    words: int = 2048
    classes: int = 32
    rest: int = 32
    hidden: int = 16

    @property
    def within(self) -> int:
        return self.words // self.classes

    def classes_of(self, codes: np.ndarray) -> np.ndarray:
        """Words are dealt in turn, so that every class has frequent ones."""
        return np.where(codes < self.words, codes % self.classes, self.classes + codes - self.words)


def initial(shape: Shape, seed: int = 5) -> Weights:
    r, h = np.random.default_rng(seed), shape.hidden
    f = np.float32
    return {
        "input": r.normal(0, 0.1, (shape.words + shape.rest, 3 * h)).astype(f), "state": r.normal(0, h**-0.5, (h, 3 * h)).astype(f), "bias": np.zeros(3 * h, f),
        "class": r.normal(0, 0.1, (h, shape.classes + shape.rest)).astype(f), "class_bias": np.zeros(shape.classes + shape.rest, f),
        "word": r.normal(0, 0.1, (shape.classes, h, shape.within)).astype(f), "word_bias": np.zeros((shape.classes, shape.within), f),
    }


def with_counts(w: Weights, shape: Shape, words: np.ndarray, rest: np.ndarray) -> Weights:
    """Biases from the corpus's counts of the frequent words and of the other classes."""
    by = np.maximum(words.reshape(shape.within, shape.classes).T, 0.5).astype(np.float64)
    total = np.r_[by.sum(1), np.maximum(rest, 0.5)]
    return w | {"word_bias": (np.log(by) - np.log(by.mean(1, keepdims=True))).astype(np.float32), "class_bias": np.log(total / total.mean()).astype(np.float32)}


def _exp_logits(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x becomes its exponentials, in place; of each row: their sum, and the log probability of its target."""
    if x.size and x.max() > 60:
        x -= x.max(1, keepdims=True)
    logp = x[np.arange(len(x)), target]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    np.subtract(logp, np.log(total), out=logp)
    return total, logp


def lanes_of(lengths: np.ndarray, most: int) -> list[np.ndarray]:
    """Documents (by their numbers) dealt to at most `most` lanes of like length, the longest lane first."""
    n = max(1, min(most, len(lengths)))
    load, out = np.zeros(n, np.int64), [[] for _ in range(n)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        k = int(load.argmin())
        out[k].append(i)
        load[k] += lengths[i]
    return [np.array(out[k], int) for k in np.argsort(-load, kind="stable") if out[k]]


def laid(docs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, begins, document, lengths) by step and lane; lanes get shorter from left to right."""
    sizes = np.array([len(d) for d in docs])
    lanes = lanes_of(sizes, most)
    length = np.array([sizes[x].sum() for x in lanes])
    codes, begins, of = np.zeros((length[0], len(lanes)), np.int64), np.zeros((length[0], len(lanes)), bool), np.zeros((length[0], len(lanes)), np.int64)
    for k, x in enumerate(lanes):
        codes[: length[k], k] = np.concatenate([docs[i] for i in x])
        begins[np.r_[0, np.cumsum(sizes[x])[:-1]], k] = True
        of[: length[k], k] = np.repeat(x, sizes[x])
    return codes, begins, of, length


def pieces_of(docs: list[np.ndarray], lanes: int, window: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The documents, those longer than a mean lane in pieces, and how many codes at the beginning of each are read for
    their state alone: a later piece begins with the codes before it. Each other code is in one piece."""
    longest = max(-(-sum(map(len, docs)) // lanes), 32 * window)
    out, ahead = [], []
    for d in docs:
        for a in range(0, len(d), longest):
            begin = max(0, a - 2 * window)
            out.append(d[begin : a + longest])
            ahead.append(a - begin)
    return out, np.array(ahead)


def _steps(w: Weights, codes: np.ndarray, begins: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """The states before each token of a window (hidden, t, lanes), the one after it (hidden, lanes), and what gradients
    need: of each token the gates and the candidate, and the state's part of the candidate. h: (hidden, lanes)."""
    n, half = w["state"].shape[0], h.dtype.type(0.5)
    # the gates as (1 + tanh(x / 2)) / 2: halved here
    scale = np.repeat([half, h.dtype.type(1)], [2 * n, n])
    state = np.ascontiguousarray((w["state"] * scale).T)
    before = np.empty((n, *codes.shape), h.dtype)
    x = np.take(np.ascontiguousarray(((w["input"] + w["bias"]) * scale).T), codes, axis=1)  # (3 hidden, t, lanes)
    parts = np.empty_like(before) if keep else None
    fresh = begins.any(1).tolist()
    for t in range(len(codes)):
        if fresh[t]:
            h = h * ~begins[t]
        before[:, t] = h
        g = state @ h
        zr, c, gc = x[: 2 * n, t], x[2 * n :, t], g[2 * n :]
        zr += g[: 2 * n]
        np.tanh(zr, out=zr)
        zr *= half
        zr += half
        if keep:
            parts[:, t] = gc
        gc *= zr[n:]
        c += gc
        np.tanh(c, out=c)
        h = h - c
        h *= zr[:n]
        h += c
    return before, h, (x, parts) if keep else ()


def _by_class(shape: Shape, which: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The frequent tokens' places in the order of their classes, and (class, begin, end) of each class in that order."""
    order = np.flatnonzero(frequent)
    order = order[np.argsort(which[order].astype(np.uint16), kind="stable")]
    ends = np.searchsorted(which[order], np.arange(shape.classes + 1)).tolist()
    return order, [(k, ends[k], ends[k + 1]) for k in range(shape.classes) if ends[k + 1] > ends[k]]


def token_scores(w: Weights, shape: Shape, before: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Natural log probability of each token's class, and of the word within it for frequent words (n, hidden; n)."""
    which = shape.classes_of(codes)
    x = before @ w["class"]
    x += w["class_bias"]
    out = _exp_logits(x, which)[1].astype(np.float64)
    order, runs = _by_class(shape, which, codes < shape.words)
    states, targets = before[order], codes[order] // shape.classes
    inside = np.empty(len(order))
    for k, a, b in runs:
        x = states[a:b] @ w["word"][k]
        x += w["word_bias"][k]
        inside[a:b] = _exp_logits(x, targets[a:b])[1]
    out[order] += inside
    return out


def scores(w: Weights, shape: Shape, docs: list[np.ndarray], lanes: int = 256, window: int = 64) -> np.ndarray:
    """Natural log probability of each document's codes (not empty), the state carried through all of it. lanes and window
    change the time alone."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    codes, begins, of, length = laid(docs, lanes)
    h = np.zeros((shape.hidden, codes.shape[1]), np.float32)
    for t in range(0, len(codes), window):
        live = int((length > t).sum())
        c = codes[t : t + window, :live]
        before, h, _ = _steps(w, c, begins[t : t + window, :live], h[:, :live])
        real = (np.arange(t, t + len(c))[:, None] < length[:live]).reshape(-1)
        got = token_scores(w, shape, np.ascontiguousarray(before.reshape(shape.hidden, -1).T)[real], c.reshape(-1)[real])
        out += np.bincount(of[t : t + window, :live].reshape(-1)[real], got, len(docs))
    return out


def gradients(w: Weights, shape: Shape, codes: np.ndarray, begins: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[Weights, np.ndarray, float]:
    """Of the mean negative log probability of a window: its gradients, the state after it, and itself. Backpropagation
    ends at the window's beginning and at documents' beginnings."""
    n = shape.hidden
    before, last, (gates, gc) = _steps(w, codes, begins, h.T, True)
    flat, tokens, on = np.ascontiguousarray(before.reshape(n, -1).T), codes.reshape(-1), real.reshape(-1)
    which, total = shape.classes_of(tokens), max(1, int(on.sum()))
    part = on * flat.dtype.type(1 / total)
    d = flat @ w["class"]
    d += w["class_bias"]
    sums, logp = _exp_logits(d, which)
    loss = -float(logp[on].sum())
    d *= (part / sums)[:, None]
    d[np.arange(len(tokens)), which] -= part
    g = {k: np.zeros_like(v) for k, v in w.items() if k in ("word", "word_bias", "input")}
    g["class"], g["class_bias"] = flat.T @ d, d.sum(0)
    dh = d @ w["class"].T
    order, runs = _by_class(shape, which, on & (tokens < shape.words))
    states, targets, back = flat[order], tokens[order] // shape.classes, np.empty((len(order), n), flat.dtype)
    for k, a, b in runs:
        x, target = states[a:b], targets[a:b]
        e = x @ w["word"][k]
        e += w["word_bias"][k]
        sums, logp = _exp_logits(e, target)
        loss -= float(logp.sum())
        e *= (flat.dtype.type(1 / total) / sums)[:, None]
        e[np.arange(b - a), target] -= flat.dtype.type(1 / total)
        g["word"][k], g["word_bias"][k] = x.T @ e, e.sum(0)
        np.matmul(e, w["word"][k].T, out=back[a:b])
    dh[order] += back
    dh = np.ascontiguousarray(dh.T).reshape(before.shape)
    # what the gradient of the state after a token is multiplied by
    z, r, c = gates[:n], gates[n : 2 * n], gates[2 * n :]
    into_c, into_z, into_r = (1 - z) * (1 - c * c), (before - c) * z * (1 - z), gc * r * (1 - r)
    gs, dc = np.empty_like(gates), np.empty_like(before)
    carried, fresh = np.zeros_like(before[:, 0]), begins.any(1).tolist()
    for t in range(len(codes) - 1, -1, -1):
        own = np.multiply(carried, into_c[:, t], out=dc[:, t])
        np.multiply(carried, into_z[:, t], out=gs[:n, t])
        np.multiply(own, into_r[:, t], out=gs[n : 2 * n, t])
        np.multiply(own, r[:, t], out=gs[2 * n :, t])
        carried *= z[:, t]
        carried += w["state"] @ gs[:, t]
        carried += dh[:, t]
        if fresh[t]:
            carried *= ~begins[t]
    g["state"] = flat.T @ gs.reshape(3 * n, -1).T
    gs[2 * n :] = dc  # of the input: the candidate's part without the gate
    gs = gs.reshape(3 * n, -1)
    by = np.argsort(tokens.astype(np.uint16), kind="stable")
    sorted_tokens = tokens[by]
    first = np.flatnonzero(np.r_[True, sorted_tokens[1:] != sorted_tokens[:-1]])
    g["input"][sorted_tokens[first]] = np.add.reduceat(np.take(gs, by, axis=1), first, axis=1).T
    g["bias"] = gs.sum(1)
    return g, last.T, loss / total


def trained(w: Weights, shape: Shape, docs: list[np.ndarray], rate: float = 0.01, lanes: int = 256, window: int = 32, passes: int = 1) -> Weights:
    """The weights after Adam steps, one a window, over all of the documents' codes (not empty); a window of few codes makes
    a small step."""
    w = {k: v.copy() for k, v in w.items()}
    if not docs:
        return w
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    pieces, ahead = pieces_of(docs, lanes, window)
    codes, begins, of, length = laid(pieces, lanes)
    trains = np.arange(len(codes))[:, None] < length
    for t, k in np.argwhere(begins & (ahead[of] > 0)).tolist():
        trains[t : t + ahead[of[t, k]], k] = False
    step = 0
    for _ in range(passes):
        h = np.zeros((codes.shape[1], shape.hidden), np.float32)
        for t in range(0, len(codes), window):
            live = int((length > t).sum())
            c, real = codes[t : t + window, :live], trains[t : t + window, :live]
            g, h, _ = gradients(w, shape, c, begins[t : t + window, :live], real, h[:live])
            step += 1
            part = np.count_nonzero(real) / (codes.shape[1] * min(window, len(codes)))
            scale = np.float32(part * rate * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step))
            for k, x in g.items():
                m[k] += np.float32(0.1) * (x - m[k])
                v[k] += np.float32(0.01) * (x * x - v[k])
                w[k] -= scale * m[k] / (np.sqrt(v[k]) + np.float32(1e-6))
    return w


def to_bytes(w: Weights) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in sorted(w))


def from_bytes(data: bytes, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.frombuffer(data, "<f4", like[k].size, at).reshape(like[k].shape)
        at += 4 * like[k].size
    return out

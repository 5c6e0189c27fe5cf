"""A small gated recurrent language model in numpy, with a class-factored softmax.

Numbers of tokens are in the order of their frequency; classes are runs of them, so P(token) = P(class) P(token | class)
costs two small softmaxes. Weights start as the unigram model (biases are log shares) and learn what departs from it.
Streams run in lanes; the state is carried from window to window and set to zero where a document starts.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
STEPS = 16
LANES = 256  # in scoring
WEIGHTS_PER_LANE = 800
ROWS = 512  # softmaxes over classes at once
SPACE = 1 << 16  # logits in a class at once
AHEAD = 1024  # inputs at once
SLOW = 0.1  # biases of outputs start where they belong, as those of the unigram model


def classes_of(counts: np.ndarray, n: int) -> np.ndarray:
    """Where each class begins in tokens sorted by count, and the end: about equal sums of the roots of the counts."""
    root = np.cumsum(np.sqrt(counts + 1.0))
    cut = np.searchsorted(root, root[-1] * np.arange(1, n) / n) + 1
    return np.unique(np.concatenate([[0], np.minimum(cut, len(counts)), [len(counts)]]))


def how_many_classes(tokens: int) -> int:
    """About as many as make one softmax over classes and one over a class's tokens cheapest where frequencies follow Zipf's law."""
    return max(1, round(2 * (tokens / np.log(tokens + 2)) ** 0.5))


def new(counts: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Weights for tokens with these counts: those of the unigram model, with small random inner weights. Rows of wc (classes) and ww (tokens) end with a bias."""
    draw, share = np.random.default_rng(3), (counts + 1.0) / (counts + 1.0).sum()
    of_class = np.add.reduceat(share, at[:-1])
    small = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(np.float32)
    biased = lambda bias: np.column_stack([np.zeros((len(bias), HIDDEN)), bias]).astype(np.float32)
    return {
        "embed": small(len(counts), HIDDEN), "wx": small(HIDDEN, 3 * HIDDEN) * 3, "b": np.repeat(np.float32([0, 1, 0]), HIDDEN), "wh": small(HIDDEN, 3 * HIDDEN) * 3,
        "wc": biased(np.log(of_class)), "ww": biased(np.log(share / np.repeat(of_class, np.diff(at)))),
    }


def _turned(x: np.ndarray) -> np.ndarray:
    """Weights into gates and candidates with units first; those of gates are negative, as gates are 1 / (1 + exp(-x))."""
    out = x.T.copy()
    np.negative(out[: 2 * HIDDEN], out=out[: 2 * HIDDEN])
    return out


def _step(a: np.ndarray, g: np.ndarray, un: np.ndarray, h: np.ndarray, c: np.ndarray, out: np.ndarray) -> None:
    """One step of all lanes: g holds what states add to the gates and becomes the gates, candidates go into c, states into out. Lanes lie along the last axis, so each slice is contiguous."""
    g += a[: 2 * HIDDEN]
    np.exp(g, out=g)
    g += 1
    np.divide(1, g, out=g)
    np.multiply(g[:HIDDEN], un, out=c)
    c += a[2 * HIDDEN :]
    np.tanh(c, out=c)
    np.subtract(h, c, out=out)
    out *= g[HIDDEN:]
    out += c


def _rows(states: np.ndarray) -> np.ndarray:
    """States by step, unit and lane as steps x lanes rows of units."""
    return np.ascontiguousarray(states.transpose(0, 2, 1))


def _run(w: dict, tokens: np.ndarray, keep: np.ndarray, h: np.ndarray, all_: bool = True) -> tuple:
    """run() with units before lanes in all but x; only the last of its results without all_."""
    steps, lanes = tokens.shape
    wxt, bt, wht = _turned(w["wx"]), _turned(w["b"])[:, None], _turned(w["wh"])
    held = steps if all_ else 1
    x = np.empty((steps, lanes, HIDDEN), np.float32)
    before, u, n = (np.empty((held, k, lanes), np.float32) for k in (HIDDEN, 3 * HIDDEN, HIDDEN))
    gates, un = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
    after, last = np.empty((steps, HIDDEN, lanes), np.float32), h.T
    some = max(1, AHEAD // lanes)
    with np.errstate(over="ignore"):  # a gate that is shut: 1 / (1 + inf)
        for t in range(steps):
            i, k = t if all_ else 0, t % some
            if k == 0:  # what the inputs of some steps add
                np.take(w["embed"], tokens[t : t + some], axis=0, out=x[t : t + some], mode="clip")  # without a copy
                a = wxt @ x[t : t + some].reshape(-1, HIDDEN).T
                a += bt
                a = a.reshape(3 * HIDDEN, -1, lanes)
            np.multiply(last, keep[t], out=before[i])
            np.matmul(wht, before[i], out=u[i])
            _step(a[:, k], gates[i], un[i], before[i], n[i], after[t])
            last = after[t]
    return x, before, gates, un, n, after


def run(w: dict, tokens: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple:
    """States before each step's output; tokens and keep are steps x lanes, keep is 0 where a document starts."""
    x, *rest = _run(w, tokens, keep, h)
    return x, *map(_rows, rest)


def states(w: dict, tokens: np.ndarray, keep: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What run() gives last, without what training needs."""
    return _rows(_run(w, tokens, keep, h, all_=False)[-1])


def _exp(x: np.ndarray, ones: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """exp of logits, in place, and its sums by row. States lie in (-1, 1), so logits need no shift; bounds keep float32 finite and away from its slow smallest numbers, where weights are wide enough to need them."""
    if wide:
        np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    return x, x @ ones[: x.shape[1]]


def _softmax(own: np.ndarray, want: np.ndarray, w: np.ndarray, ones: np.ndarray, wide: bool, grad: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Probability of the wanted row of w for each state (ending in 1, for the bias); with grad, adds the gradient of w there and gives that of the states."""
    p, total = _exp(own @ w.T, ones, wide)
    place = np.arange(0, p.size, p.shape[1])
    place += want
    flat = p.reshape(-1)
    if grad is None:
        return flat[place] / total, None
    p *= (1 / total)[:, None]
    got = flat[place]
    flat[place] = got - 1
    grad += p.T @ own
    return got, p @ w[:, :-1]


def log_likelihood(w: dict, at: np.ndarray, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> np.ndarray:
    """Natural log probability of each target given its state; with grad, adds the gradients and puts the states' in grad["h"]."""
    # Rows go by class, so that each class works on a slice.
    kind = np.repeat(np.arange(len(at) - 1, dtype=np.int16 if len(at) < 1 << 15 else np.int64), np.diff(at))[target]
    order = np.argsort(kind, kind="stable")
    own, target, kind = np.empty((len(h), HIDDEN + 1), np.float32), target[order], kind[order]
    own[:, :HIDDEN], own[:, HIDDEN] = h[order], 1
    wc, ww, ones = w["wc"], w["ww"], np.ones(max(len(at), HIDDEN + 1, int(np.diff(at).max())), np.float32)
    wide = np.maximum.reduceat(np.abs(ww) @ ones[: HIDDEN + 1], at[:-1]) > 60
    wide_class = bool((np.abs(wc) @ ones[: HIDDEN + 1]).max() > 60)
    share, back = np.empty(len(h), np.float32), None if grad is None else np.empty((len(h), HIDDEN), np.float32)
    for i in range(0, len(h), ROWS):
        rows = slice(i, i + ROWS)
        share[rows], more = _softmax(own[rows], kind[rows], wc, ones, wide_class, grad and grad["wc"])
        if grad is not None:
            back[rows] = more
    edge = np.searchsorted(kind, np.arange(len(at)))
    for c in np.flatnonzero(np.diff(edge)).tolist():
        i, j = int(at[c]), int(at[c + 1])
        if j - i == 1:
            continue
        # Fewer rows at once in classes of many tokens.
        most = max(64, SPACE // (j - i))
        for first in range(int(edge[c]), int(edge[c + 1]), most):
            rows = slice(first, min(first + most, int(edge[c + 1])))
            part, more = _softmax(own[rows], target[rows] - i, ww[i:j], ones, wide[c], grad and grad["ww"][i:j])
            share[rows] *= part
            if grad is not None:
                back[rows] += more
    out = np.empty(len(order))
    out[order] = np.log(np.maximum(share, np.float32(1e-37)))
    if grad is not None:
        grad["h"] = np.empty_like(back)
        grad["h"][order] = back
    return out


def gradients(w: dict, at: np.ndarray, inputs: np.ndarray, targets: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of one window by backpropagation through its steps, that of embed as (rows, values); the last state; the log likelihood."""
    x, before, gates, un, n, after = _run(w, inputs, keep, h)
    steps, lanes = inputs.shape
    grad = {k: np.zeros_like(v) for k, v in w.items() if k != "embed"}
    total = float(log_likelihood(w, at, _rows(after).reshape(-1, HIDDEN), targets.ravel(), grad).sum())
    out = np.ascontiguousarray(grad.pop("h").reshape(steps, lanes, HIDDEN).transpose(0, 2, 1))
    # Of candidates, gates and again candidates: the first three quarters are the gradients of what inputs add, the last three those of what states add.
    d, dx = np.empty((4 * HIDDEN, lanes), np.float32), np.empty((steps, lanes, HIDDEN), np.float32)
    da, du = d[: 3 * HIDDEN], d[HIDDEN:]
    turned = np.roll(w["wx"], HIDDEN, axis=1).T.copy()  # candidates first, as in da
    wx, b, ones, dh, some = np.zeros_like(turned), np.zeros(3 * HIDDEN, np.float32), np.ones(lanes, np.float32), np.zeros((HIDDEN, lanes), np.float32), np.empty((HIDDEN, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        dh += out[t]
        r, z, c = gates[t, :HIDDEN], gates[t, HIDDEN:], n[t]
        dc, dr, dz, dn = (d[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        dh_z = dh * z
        np.subtract(dh, dh_z, out=some)  # dh (1 - z)
        np.multiply(c, c, out=dc)
        np.subtract(1, dc, out=dc)
        dc *= some
        np.multiply(dc, r, out=dn)
        np.subtract(1, r, out=dr)
        dr *= dn
        dr *= un[t]
        np.subtract(before[t], c, out=dz)
        dz *= some
        dz *= z
        grad["wh"] += before[t] @ du.T
        wx += da @ x[t]
        b += da @ ones
        np.matmul(da.T, turned, out=dx[t])
        np.matmul(w["wh"], du, out=dh)
        dh += dh_z
        dh *= keep[t]
    grad["wx"], grad["b"] = np.roll(wx.T, -HIDDEN, axis=1), np.roll(b, -HIDDEN)
    token, dx = inputs.ravel(), dx.reshape(-1, HIDDEN)
    order = np.argsort(token.astype(np.uint16) if len(w["embed"]) <= 1 << 16 else token, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
    grad["embed"] = token[order][first], np.add.reduceat(dx[order], first)
    return grad, after[-1].T, total


class Learner:
    """AdaGrad over windows of streams (arrays of tokens; 0 ends a document and precedes the next)."""

    def __init__(self, weights: dict, at: np.ndarray, rate: float):
        self.weights, self.at, self.rate, self.seen = {k: v.copy() for k, v in weights.items()}, at, rate, 0
        self.squares = {k: np.full_like(v, 1e-2) for k, v in weights.items()}
        # Larger models read more at once, so that their updates stay in proportion to what they read.
        self.lanes = int(np.clip(sum(v.size for v in weights.values()) // WEIGHTS_PER_LANE, 32, 4096))

    def learn(self, stream: np.ndarray) -> None:
        if len(stream) < 2:
            return
        lanes = max(1, min(self.lanes, len(stream) // STEPS))
        steps = -(-(len(stream) - 1) // lanes)
        # Each lane reads its part of the stream; where the parts don't come out even, lanes share a few tokens.
        at = np.linspace(0, len(stream) - 1 - steps, lanes).astype(np.int64) + np.arange(steps)[:, None]
        inputs, targets, h = stream[at], stream[at + 1], np.zeros((lanes, HIDDEN), np.float32)
        for k in range(0, steps, STEPS):
            i, o = inputs[k : k + STEPS], targets[k : k + STEPS]
            grad, h, _ = gradients(self.weights, self.at, i, o, (i != 0).astype(np.float32), h)
            rows, values = grad.pop("embed")
            grad["embed"] = values
            for name, g in grad.items():
                part = rows if name == "embed" else slice(None)
                g *= 16 / i.size
                np.clip(g, -1, 1, out=g)
                seen = self.squares[name][part]
                seen += g * g
                if name == "embed":
                    self.squares[name][part] = seen
                g /= np.sqrt(seen)
                g *= self.rate
                if name in ("wc", "ww"):
                    g[:, -1] *= SLOW
                self.weights[name][part] -= g
            self.seen += i.size


def score(w: dict, at: np.ndarray, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document (tokens without the end, which is added), its state carried from its first to its last token."""
    lanes, load = min(LANES * 2, len(documents)), []
    heap = [(0, k) for k in range(lanes)]
    held: list[list[int]] = [[] for _ in range(lanes)]
    for d in sorted(range(len(documents)), key=lambda d: -len(documents[d])):
        n, k = heapq.heappop(heap)
        held[k].append(d)
        heapq.heappush(heap, (n + len(documents[d]) + 1, k))
    load = np.array([sum(len(documents[d]) + 1 for d in ds) for ds in held])
    order = np.argsort(-load, kind="stable")
    load, longest = load[order], int(load.max())
    # Lanes lie one after another, whatever their lengths: memory follows the number of tokens.
    start = np.cumsum(load) - load
    target, of, first = np.zeros(load.sum(), np.int32), np.zeros(load.sum(), np.int32), np.zeros(load.sum(), bool)
    for t, k in zip(start.tolist(), order.tolist()):
        for d in held[k]:
            n = len(documents[d])
            target[t : t + n], of[t : t + n + 1], first[t] = documents[d], d, True
            t += n + 1
    inputs = np.zeros_like(target)
    inputs[1:] = np.where(first[1:], 0, target[:-1])
    out, h = np.zeros(len(documents)), np.zeros((lanes, HIDDEN), np.float32)
    wide = 4 * STEPS
    for k in range(0, longest, wide):
        # Lanes are in the order of their loads: those that still have tokens come first.
        n = int(np.searchsorted(-load, -k))
        last = min(k + wide, longest)
        place = np.minimum(np.arange(k, last)[:, None], load[None, :n] - 1) + start[None, :n]
        after = states(w, inputs[place], (~first[place]).astype(np.float32), h[:n])
        h = after[-1]
        live = (np.arange(k, last)[:, None] < load[None, :n]).ravel()
        place = place.ravel()[live]
        p = log_likelihood(w, at, after.reshape(-1, HIDDEN)[live], target[place])
        out += np.bincount(of[place], p, len(documents))
    return out

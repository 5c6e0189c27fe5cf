"""Regression trees on histograms, in numpy, for samples that fit into one task: the fits of model.all_cells().

Features are cut into at most 255 bins once per sample. A tree always splits the leaf that gains most, by histograms of
weights and weighted targets per feature and bin; a larger child's histogram is its parent's less its sibling's.
"""

from __future__ import annotations

import numpy as np

BINS = 255
AT_ONCE = 25  # trees of a forest that grow together


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    """For each feature, the thresholds between bins: middles between following values, or between quantiles where values are many."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Numbers of bins: how many thresholds lie below each value."""
    return np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], 1).astype(np.int64) if len(edges) else np.zeros((len(x), 0), np.int64)


class Trees:
    """Leaves or splits, a row per tree: rows whose bin of feature is at most bin go to left, the others to the node after it."""

    def __init__(self, trees: int, leaves: int) -> None:
        size = (trees, 2 * leaves - 1)
        self.feature, self.bin, self.left, self.value, self.nodes = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.ones(trees, np.int64)

    def predict_of(self, bins: np.ndarray, tree: np.ndarray) -> np.ndarray:
        """What its own tree says of each row of bins."""
        width = self.feature.shape[1]
        feature, cut, left, base = self.feature.ravel(), self.bin.ravel(), self.left.ravel(), tree * width
        at = base.copy()
        moving = np.flatnonzero(feature[at] >= 0)
        while len(moving):
            node = at[moving]
            at[moving] = base[moving] + left[node] + (bins[moving % len(bins), feature[node]] > cut[node])
            moving = moving[feature[at[moving]] >= 0]
        return self.value.ravel()[at]

    def predict_each(self, bins: np.ndarray) -> np.ndarray:
        """What every tree says of all rows of bins: a row per tree."""
        return self.predict_of(bins, np.repeat(np.arange(len(self.feature)), len(bins))).reshape(len(self.feature), len(bins))

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """What the first tree says."""
        return self.predict_each(bins)[0]


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, leaves: int, least_rows: int, least_weight: float) -> Trees:
    """A tree of so many leaves at most, each of so many rows and so much weight at least."""
    return grow_each(bins, y, w[None], leaves, least_rows, least_weight)[0]


def grow_each(bins: np.ndarray, y: np.ndarray, w: np.ndarray, leaves: int, least_rows: int, least_weight: float) -> tuple[Trees, np.ndarray]:
    """grow() for each row of weights, and what the trees say of their own rows (0 where a weight is).

    All trees split a leaf in each step, with the same few passes over arrays, so many trees cost less than one by one.
    """
    n_trees, n_features, out = len(w), bins.shape[1], Trees(len(w), leaves)
    sizes = bins.max(0, initial=0) + 1
    first = np.cumsum(sizes) - sizes
    feature_of, size = np.repeat(np.arange(n_features), sizes), int(sizes.sum())
    # Entries are the rows that a tree weighs, tree after tree; those of a leaf lie together in order.
    tree, row = np.nonzero(w > 0)
    weights = (w[tree, row] * y[row], w[tree, row])
    placed, order, width = bins + first, np.arange(len(row)), 2 * leaves - 1
    begin, end = np.zeros((n_trees, width), np.int64), np.zeros((n_trees, width), np.int64)
    gain, place, slot = np.full((n_trees, width), -np.inf), np.zeros((n_trees, width), np.int64), np.zeros((n_trees, width), np.int64)
    held = np.empty((n_trees, leaves, 3, size))  # weighted targets, weights and rows of every bin, feature after feature, of each leaf

    def spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places from each start on: which start, how far from it, where."""
        which = np.repeat(np.arange(len(n)), n)
        far = np.arange(len(which)) - (np.cumsum(n) - n)[which]
        return which, far, start[which] + far

    def histograms(which: np.ndarray, entries: np.ndarray, n: int) -> np.ndarray:
        at = (placed[row[entries]] + (which * size)[:, None]).ravel()
        made = [np.bincount(at, np.repeat(v[entries], n_features), n * size) for v in weights]
        return np.stack([*made, np.bincount(at, minlength=n * size)]).reshape(3, n, size).swapaxes(0, 1)

    def best(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest gain and its place among all bins, of each leaf; of equal ones the first."""
        if not size:
            return np.full(len(h), -np.inf), np.zeros(len(h), np.int64)
        low = h.cumsum(2)
        whole = low[:, :, sizes[0] - 1, None].copy()
        low[:, :, sizes[0] :] -= np.repeat(low[:, :, first[1:] - 1], sizes[1:], axis=2)
        high = whole - low
        fits = (low[:, 2] >= least_rows) & (high[:, 2] >= least_rows) & (low[:, 1] > least_weight) & (high[:, 1] > least_weight)
        with np.errstate(all="ignore"):
            gains = low[:, 0] ** 2 / low[:, 1] + high[:, 0] ** 2 / high[:, 1] - whole[:, 0] ** 2 / whole[:, 1]
        gains[~fits] = -np.inf
        at = gains.argmax(1)
        return gains[np.arange(len(h)), at], at

    def values(which: np.ndarray, entries: np.ndarray, n: int) -> np.ndarray:
        wy, weight = (np.bincount(which, v[entries], n) for v in weights)
        return np.divide(wy, weight, out=np.zeros(n), where=weight > 0)

    end[:, 0] = np.searchsorted(tree, np.arange(n_trees), side="right")
    begin[1:, 0] = end[:-1, 0]
    held[:, 0] = histograms(tree, order, n_trees)
    out.value[:, 0] = values(tree, order, n_trees)
    gain[:, 0], place[:, 0] = best(held[:, 0])
    for _ in range(leaves - 1):
        node = gain.argmax(1)
        of = np.flatnonzero(gain[np.arange(n_trees), node] > 1e-12)
        if not len(of):
            break
        node, new = node[of], out.nodes[of]
        feature = feature_of[place[of, node]]
        cut = place[of, node] - first[feature]
        start, n = begin[of, node], end[of, node] - begin[of, node]
        which, far, at = spread(start, n)
        entries = order[at]
        low = bins[row[entries], feature[which]] <= cut[which]
        lower = np.bincount(which[low], minlength=len(of))
        before = np.cumsum(low) - low
        before -= before[np.cumsum(n) - n][which]
        order[start[which] + np.where(low, before, lower[which] + far - before)] = entries
        out.feature[of, node], out.bin[of, node], out.left[of, node], gain[of, node] = feature, cut, new, -np.inf
        out.nodes[of] += 2
        out.value[of[:, None], new[:, None] + [0, 1]] = values(which * 2 + ~low, entries, 2 * len(of)).reshape(-1, 2)
        begin[of, new], end[of, new], begin[of, new + 1], end[of, new + 1] = start, start + lower, start + lower, start + n
        # The larger child's histogram is its parent's less its sibling's.
        left_small = 2 * lower <= n
        part, _, at = spread(np.where(left_small, start, start + lower), np.where(left_small, lower, n - lower))
        own = histograms(part, order[at], len(of))
        other = held[of, slot[of, node]] - own
        both = np.where(left_small[:, None, None], own, other), np.where(left_small[:, None, None], other, own)
        slot[of, new], slot[of, new + 1] = slot[of, node], new // 2 + 1
        held[of, slot[of, new]], held[of, slot[of, new + 1]] = both
        gains, places = best(np.concatenate(both))
        for k in (0, 1):
            gain[of, new + k], place[of, new + k] = gains[k * len(of) : (k + 1) * len(of)], places[k * len(of) : (k + 1) * len(of)]
    said, leaf = np.zeros(w.shape), np.nonzero((out.feature < 0) & (end > begin))
    sorted_ = np.argsort(begin[leaf], kind="stable")
    said[tree[order], row[order]] = np.repeat(out.value[leaf][sorted_], (end - begin)[leaf][sorted_])
    return out, said


def boosted(x: np.ndarray, y: np.ndarray, w: np.ndarray, asked: np.ndarray, seed: int, trees: int, rate: float = 0.1, leaves: int = 31, least_rows: int = 20) -> np.ndarray:
    """Predictions for asked: every tree fits what the ones before leave, and a share of it (rate) counts. Nothing is drawn, so the seed changes nothing."""
    return boosted_each([(x, y, w, asked)], [seed], trees, rate, leaves, least_rows)[0]


def boosted_each(samples: list[tuple], seeds: list[int], trees: int, rate: float = 0.1, leaves: int = 31, least_rows: int = 20) -> list[np.ndarray]:
    """boosted() for samples (x, y, w, asked), the trees of which grow together; each gets what it would get alone."""
    edges = [edges_of(x) for x, *_ in samples]
    own, other = (np.concatenate([binned(s[k], e) for s, e in zip(samples, edges)]) for k in (0, 3))
    of, asked = (np.repeat(np.arange(len(samples)), [len(s[k]) for s in samples]) for k in (0, 3))
    y, weight = np.concatenate([s[1] for s in samples]), np.zeros((len(samples), len(of)))
    weight[of, np.arange(len(of))] = np.concatenate([s[2] for s in samples])
    start = np.array([float((w * y).sum() / w.sum()) for _, y, w, _ in samples])
    done, out = start[of], start[asked]
    for _ in range(trees):
        grown, said = grow_each(own, y - done, weight, leaves, least_rows, 1e-3)
        split = grown.nodes > 1
        if not split.any():
            break
        weight[~split] = 0  # those are done
        done += rate * said.sum(0)
        out += np.where(split[asked], rate * grown.predict_of(other, asked), 0.0)
    return np.split(out, np.searchsorted(asked, np.arange(1, len(samples))))


def forest(x: np.ndarray, y: np.ndarray, w: np.ndarray, asked: np.ndarray, seed: int, trees: int, leaves: int = 64) -> np.ndarray:
    """Predictions for asked: the mean of trees, each grown on as many rows as there are, drawn with replacement."""
    edges = edges_of(x)
    own, other = binned(x, edges), binned(asked, edges)
    out = np.zeros(len(asked))
    for k in range(0, trees, AT_ONCE):
        drawn = [np.bincount(np.random.default_rng([seed, k]).integers(0, len(y), len(y)), minlength=len(y)) for k in range(k, min(k + AT_ONCE, trees))]
        for said in grow_each(own, y, w * np.stack(drawn), leaves, 1, 0.0)[0].predict_each(other):
            out += said
    return out / trees

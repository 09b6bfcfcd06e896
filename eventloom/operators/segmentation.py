"""Sequential segmentation of one run at a time, in NumPy inside grouped maps. A run's binned
series is the unit of work; runs are spread over the cluster."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_of(frame: pd.DataFrame, value: str = "x") -> tuple[np.ndarray, list]:
    """bins x clusters, both in order."""
    wide = frame.pivot(index="bin", columns="cluster", values=value).sort_index().sort_index(axis=1)
    return wide.to_numpy(float), list(wide.columns)


class SquaredCost:
    """Squared error of any stretch from prefix sums."""

    def __init__(self, y: np.ndarray):
        zero = np.zeros((1, y.shape[1]))
        self.s, self.q = np.vstack([zero, np.cumsum(y, 0)]), np.concatenate([[0.0], np.cumsum((y * y).sum(1))])

    def __call__(self, a, b):
        d = self.s[b] - self.s[a]
        return self.q[b] - self.q[a] - (d * d).sum(-1) / np.maximum(b - a, 1)


class AbsoluteCost:
    """Absolute distances of a stretch from its medians."""

    def __init__(self, y: np.ndarray):
        self.y = y

    def __call__(self, a, b):
        a, b = np.broadcast_arrays(a, b)
        part = [self.y[i:j] for i, j in zip(a.ravel(), b.ravel())]
        return np.array([np.abs(p - np.median(p, axis=0)).sum() for p in part]).reshape(a.shape)


class NormalCost:
    """Length times log determinant of a stretch's sample covariance, 1e-6 added to its diagonal."""

    def __init__(self, y: np.ndarray):
        y = y - y.mean(0)
        d = y.shape[1]
        self.s = np.vstack([np.zeros((1, d)), np.cumsum(y, 0)])
        self.q = np.concatenate([np.zeros((1, d, d)), np.cumsum(y[:, :, None] * y[:, None, :], 0)])

    def __call__(self, a, b):
        n = np.asarray(b - a, dtype=float)[..., None, None]
        s = self.s[b] - self.s[a]
        cov = (self.q[b] - self.q[a] - s[..., :, None] * s[..., None, :] / n) / np.maximum(n - 1, 1)
        return n[..., 0, 0] * np.linalg.slogdet(cov + 1e-6 * np.eye(s.shape[-1]))[1]


def pair_median(y: np.ndarray, rows: int = 512) -> float:
    """Median squared distance of all pairs of rows. Ranks are found 16 bits at a time over
    blocks of rows, so no array of all pairs is held."""
    n = len(y)
    pairs = n * (n - 1) // 2
    if not pairs:
        return 0.0

    def blocks():
        for a in range(0, n, rows):
            own = y[a : a + rows]
            d = np.zeros((len(own), n - a))
            for c in range(y.shape[1]):
                d += (own[:, c, None] - y[a:, c]) ** 2
            yield d[np.triu_indices(len(own), 1, n - a)].view(np.int64)

    def ranked(rank: int) -> float:
        high = 0
        for shift in (48, 32, 16, 0):
            count = np.zeros(1 << 16, np.int64)
            for bits in blocks():
                own = bits >> shift
                count += np.bincount((own[(own >> 16) == high] if shift < 48 else own) & 0xFFFF, minlength=1 << 16)
            digit = int(np.searchsorted(np.cumsum(count), rank, "right"))
            rank -= int(count[:digit].sum())
            high = high << 16 | digit
        return float(np.array([high], np.int64).view(float)[0])

    low = ranked((pairs - 1) // 2)
    return low if pairs % 2 else (low + ranked(pairs // 2)) / 2


class KernelCost:
    """Scatter of a stretch in the space of a Gaussian kernel, whose width is the median
    squared distance; scaled distances of different bins are kept in [0.01, 100]. The sums of
    all stretches up to one end are carried on to the next, so an array of bins is held, not of pairs."""

    def __init__(self, y: np.ndarray):
        self.y, self.gamma = y, 1 / (pair_median(y) or 1.0)
        self.total, self.at = np.zeros(len(y)), 0

    def kernel(self, part: np.ndarray, to: np.ndarray) -> np.ndarray:
        d = sum((part[:, c, None] - to[:, c]) ** 2 for c in range(part.shape[1])) * self.gamma
        return np.exp(-np.clip(d, 1e-2, 1e2))

    def whole(self, a: int, b: int) -> float:
        """Sum of the kernel over all pairs of a stretch; each bin with itself counts 1."""
        total = float(b - a) * (1 - math.exp(-1e-2))
        for i in range(a, b, 512):
            total += float(self.kernel(self.y[i : min(i + 512, b)], self.y[a:b]).sum())
        return total

    def __call__(self, a, b):
        a, b = np.broadcast_arrays(a, b)
        end = int(b.flat[0]) if b.size else 0
        if b.size > 1 and end >= self.at and (b == end).all():
            for t in range(self.at, end):
                self.total[t] = 1.0
                if t:
                    self.total[:t] += 1 + 2 * np.cumsum(self.kernel(self.y[t : t + 1], self.y[:t])[0][::-1])[::-1]
            self.at = end
            total = self.total[a]
        else:
            total = np.array([self.whole(i, j) for i, j in zip(a.ravel(), b.ravel())]).reshape(a.shape)
        return (b - a) - total / np.maximum(b - a, 1)


COSTS = {"l2": SquaredCost, "l1": AbsoluteCost, "normal": NormalCost, "rbf": KernelCost}


def total_cost(y: np.ndarray, ends: list[int], cost: str = "l2") -> float:
    """Cost of all segments together."""
    own = COSTS[cost](y)
    return float(sum(own(np.array(a), np.array(b)) for a, b in zip([0, *ends[:-1]], ends)))


def pelt(y: np.ndarray, penalty: float, least: int = 2, jump: int = 1, cost: str = "l2") -> list[int]:
    """Ends of the segments of least cost plus penalty each. Starts that can't be best any more
    are dropped as the end moves on."""
    n, cost = len(y), COSTS[cost](y)
    best, back = {0: -penalty}, {0: 0}
    alive = np.array([0])
    ends = [e for e in range(jump, n, jump) if e >= least] + [n]
    for end in ends:
        ok = alive[end - alive >= least]
        if not len(ok):
            continue
        total = np.array([best[a] for a in ok]) + cost(ok, np.full(len(ok), end)) + penalty
        k = int(np.argmin(total))
        best[end], back[end] = float(total[k]), int(ok[k])
        stay = np.concatenate([ok[total - penalty <= best[end]], alive[end - alive < least]])
        alive = np.append(np.sort(stay), end)
    out, at = [], n
    while at > 0:
        out.append(at)
        at = back.get(at, 0)
    return out[::-1]


def binary_segmentation(y: np.ndarray, penalty: float, least: int = 2) -> list[int]:
    """Splits at the greatest gain over penalty, again in both parts."""
    cost, out, todo = SquaredCost(y), [len(y)], [(0, len(y))]
    while todo:
        a, b = todo.pop()
        k = np.arange(a + least, b - least + 1)
        if len(k):
            gain = cost(np.array(a), np.array(b)) - cost(np.full(len(k), a), k) - cost(k, np.full(len(k), b))
            if gain.max() > penalty:
                c = int(k[gain.argmax()])
                out.append(c)
                todo += [(a, c), (c, b)]
    return sorted(out)


def moving_window(y: np.ndarray, width: int, penalty: float) -> list[int]:
    """Peaks of the gain of splitting a window of 2 * width in its middle."""
    n, cost = len(y), SquaredCost(y)
    k = np.arange(width, n - width + 1)
    if not len(k):
        return [n]
    gain = cost(k - width, k + width) - cost(k - width, k) - cost(k, k + width)
    peak = [int(c) for i, c in enumerate(k) if gain[i] > penalty and gain[i] == gain[max(0, i - width) : i + width + 1].max()]
    return sorted({*peak, n})


def refine(y: np.ndarray, ends: list[int], radius: int, least: int = 1) -> list[int]:
    """Each inner boundary, left to right, to the place within radius of least cost of its two sides."""
    cost, ends = SquaredCost(y), list(ends)
    for i in range(len(ends) - 1):
        left, right = ends[i - 1] if i else 0, ends[i + 1]
        k = np.arange(max(left + least, ends[i] - radius), min(right - least, ends[i] + radius) + 1)
        if len(k):
            ends[i] = int(k[np.argmin(cost(np.full(len(k), left), k) + cost(k, np.full(len(k), right)))])
    return ends


def merge_similar(y: np.ndarray, ends: list[int], distance: float, least: int) -> list[int]:
    """While a neighbouring pair is nearer than distance or has a side shorter than least,
    the nearest such pair is merged."""
    ends = list(ends)
    while len(ends) > 1:
        start = [0, *ends[:-1]]
        mean = np.array([y[a:b].mean(0) for a, b in zip(start, ends)])
        gap, size = np.sqrt(((mean[1:] - mean[:-1]) ** 2).sum(1)), np.subtract(ends, start)
        wrong = (gap < distance) | (size[1:] < least) | (size[:-1] < least)
        if not wrong.any():
            break
        ends.pop(int(np.argmin(np.where(wrong, gap, np.inf))))
    return ends


def remove_short(labels: np.ndarray, least: int, strategy: str = "previous", x: np.ndarray | None = None) -> np.ndarray:
    """The leftmost run shorter than least takes its left ('previous'), right ('next') or
    'nearest' (by mean of x) neighbour's label, until none is left; a single run stays."""
    out = labels.copy()
    while True:
        cut = np.flatnonzero(np.diff(out)) + 1
        start, stop = np.append(0, cut), np.append(cut, len(out))
        short = np.flatnonzero(stop - start < least)
        if len(start) < 2 or not len(short):
            return out
        i = int(short[0])
        left, right = (out[start[i - 1]] if i else None), (out[start[i + 1]] if i + 1 < len(start) else None)
        if strategy == "nearest" and x is not None and left is not None and right is not None:
            own = x[start[i] : stop[i]].mean(0)
            pick = left if np.linalg.norm(own - x[out == left].mean(0)) <= np.linalg.norm(own - x[out == right].mean(0)) else right
        else:
            first, second = (right, left) if strategy == "next" else (left, right)
            pick = first if first is not None else second
        out[start[i] : stop[i]] = pick


# ------------------------------------------------------------------- active sets


def set_costs(x: np.ndarray, p: dict, k_max: int, per_active: float = 0.0, per_choice: float = 0.0) -> np.ndarray:
    """segments x (k_max + 1): cost of the best set of each size."""
    q = x.shape[1]
    out = np.empty((len(x), k_max + 1))
    nll = lambda mu, var: 0.5 * ((x - mu) ** 2 / var + np.log(var))
    for k in range(k_max + 1):
        low, high = nll(p["mu0"][k], p["var0"][k]), nll(p["mu1"][k], p["var1"][k])
        gain = np.sort(high - low, axis=1)[:, :k].sum(1)
        out[:, k] = low.sum(1) + gain + per_active * k + per_choice * (math.lgamma(q + 1) - math.lgamma(k + 1) - math.lgamma(q - k + 1))
    return out


def set_parameters(x: np.ndarray, size: np.ndarray, masks: np.ndarray, k_max: int, floor: float) -> dict:
    """Weighted means and variances of members and others for each set size, those of all
    segments where a size has none."""
    w = np.repeat(size[:, None], x.shape[1], 1).astype(float)
    count = masks.sum(1)

    def fit(own):
        if not w[own].sum():
            return None
        m = float((w[own] * x[own]).sum() / w[own].sum())
        return m, max(floor, float((w[own] * (x[own] - m) ** 2).sum() / w[own].sum()))

    whole = [fit(~masks) or (float(x.min()), floor), fit(masks) or (float(x.max()), floor)]
    out = {n: np.zeros(k_max + 1) for n in ("mu0", "mu1", "var0", "var1")}
    for k in range(k_max + 1):
        rows = (count == k)[:, None] & np.ones_like(masks)
        for i in (0, 1):
            out[f"mu{i}"][k], out[f"var{i}"][k] = fit(rows & (masks == bool(i))) or whole[i]
    return out


def active_sets(x: np.ndarray, size: np.ndarray, k_max: int, rounds: int = 100, per_active: float = 0.0, per_choice: float = 0.0, floor: float = 1e-3) -> tuple[np.ndarray, dict, float]:
    """Members of each segment's active set by expectation-maximisation from a start at the
    middle of the quartiles and one at the widest gap; the lower objective wins."""
    best = None
    mid = (np.quantile(x, 0.25) + np.quantile(x, 0.75)) / 2
    order = np.argsort(-x, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    step = -np.diff(np.take_along_axis(x, order, 1), axis=1)[:, :k_max]
    for start in (x > mid) & (rank < k_max), rank < (step.argmax(1) + 1)[:, None] if step.size else np.zeros_like(x, bool):
        masks, last = start, np.inf
        for _ in range(rounds):
            p = set_parameters(x, size, masks, k_max, floor)
            cost = set_costs(x, p, k_max, per_active, per_choice)
            k = cost.argmin(1)
            gain = 0.5 * ((x - p["mu1"][k][:, None]) ** 2 / p["var1"][k][:, None] + np.log(p["var1"][k])[:, None] - (x - p["mu0"][k][:, None]) ** 2 / p["var0"][k][:, None] - np.log(p["var0"][k])[:, None])
            masks = np.argsort(np.argsort(gain, axis=1, kind="stable"), axis=1) < k[:, None]
            now = float((size * cost[np.arange(len(x)), k]).sum())
            if last - now < 1e-8 * max(1.0, abs(now)):
                break
            last = now
        if best is None or now < best[2]:
            best = masks, p, now
    return best


def smooth_sets(x: np.ndarray, size: np.ndarray, masks: np.ndarray, p: dict, k_max: int, switch: float, hamming: float) -> np.ndarray:
    """The cheapest sequence of sets with a price for each change and changed member, over
    each segment's own, neighbouring and empty sets and its best few."""
    q = x.shape[1]
    cost_of = lambda row, m: float(np.where(m, 0.5 * ((row - p["mu1"][m.sum()]) ** 2 / p["var1"][m.sum()] + np.log(p["var1"][m.sum()])), 0.5 * ((row - p["mu0"][m.sum()]) ** 2 / p["var0"][m.sum()] + np.log(p["var0"][m.sum()]))).sum())
    options, prices = [], []
    for i, row in enumerate(x):
        top = np.argsort(-row)[: k_max + 1]
        own = {tuple(masks[j]) for j in (i - 1, i, i + 1) if 0 <= j < len(x)} | {tuple([False] * q)}
        own |= {tuple(np.isin(np.arange(q), c)) for k in range(1, k_max + 1) for c in combinations(top, k)}
        options.append(np.array(sorted(own)))
        prices.append(np.array([size[i] * cost_of(row, m) for m in options[-1]]))
    total, back = prices[0], []
    for i in range(1, len(x)):
        d = (options[i - 1][:, None, :] != options[i][None, :, :]).sum(2)
        step = total[:, None] + np.where(d > 0, switch + hamming * d, 0)
        back.append(step.argmin(0))
        total = step.min(0) + prices[i]
    k = int(total.argmin())
    out = [options[-1][k]]
    for i in range(len(x) - 2, -1, -1):
        k = int(back[i][k])
        out.append(options[i][k])
    return np.array(out[::-1])


def absorb_flickers(masks: np.ndarray, size: np.ndarray, least: int, most_hamming: int) -> np.ndarray:
    """A short episode between two of one set, few members apart, takes that set."""
    out = masks.copy()
    changed = True
    while changed:
        changed = False
        cut = np.append(np.append(0, np.flatnonzero((out[1:] != out[:-1]).any(1)) + 1), len(out))
        for a, b, c, d in zip(cut[:-3], cut[1:-2], cut[2:-1], cut[3:]):
            if (out[a] == out[c]).all() and size[b:c].sum() < least and (out[b] != out[a]).sum() <= most_hamming:
                out[b:c] = out[a]
                changed = True
                break
    return out


# ------------------------------------------------------------------- mixtures over time


def hmm_gaussian(y: np.ndarray, k: int, rounds: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Viterbi states, posteriors and log likelihood of a Gaussian hidden Markov model."""
    rng = np.random.default_rng(seed)
    mu, var = y[rng.choice(len(y), k, replace=False)].astype(float), np.tile(y.var(0) + 1e-3, (k, 1))
    start, move, ll = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)), -np.inf
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    for _ in range(rounds):
        log_b = -0.5 * (((y[:, None, :] - mu) ** 2 / var) + np.log(2 * np.pi * var)).sum(2)
        top = log_b.max(1, keepdims=True)
        b = np.exp(log_b - top)
        a, scale = np.empty_like(b), np.empty(len(y))
        for t in range(len(y)):
            a[t] = (start if t == 0 else a[t - 1] @ move) * b[t]
            scale[t] = a[t].sum()
            a[t] /= scale[t]
        back = np.ones_like(b)
        xi = np.zeros((k, k))
        for t in range(len(y) - 2, -1, -1):
            nxt = b[t + 1] * back[t + 1] / scale[t + 1]
            xi += a[t][:, None] * move * nxt
            back[t] = move @ nxt
        g = a * back
        g /= g.sum(1, keepdims=True)
        now = float(np.log(scale).sum() + top.sum())
        start, move = g[0], (xi + 1e-9) / (xi + 1e-9).sum(1, keepdims=True)
        mu = (g.T @ y) / g.sum(0)[:, None]
        var = np.stack([(g[:, [j]] * (y - mu[j]) ** 2).sum(0) / g[:, j].sum() for j in range(k)]) + 1e-4
        if now - ll < 1e-6 * abs(now):
            ll = now
            break
        ll = now
    score, trace = np.log(start + 1e-300) + log_b[0], []
    for t in range(1, len(y)):
        step = score[:, None] + np.log(move)
        trace.append(step.argmax(0))
        score = step.max(0) + log_b[t]
    path = [int(score.argmax())]
    for s in reversed(trace):
        path.append(int(s[path[-1]]))
    return np.array(path[::-1]), g, ll


def lloyd(y: np.ndarray, k: int, starts: int = 5, seed: int = 0) -> tuple[np.ndarray, float]:
    """Labels and inertia of the best of several k-means++ starts."""
    best = None
    for s in range(starts):
        rng = np.random.default_rng([seed, s])
        c = y[[rng.integers(len(y))]].astype(float)
        while len(c) < k:
            d = ((y[:, None, :] - c) ** 2).sum(2).min(1)
            c = np.vstack([c, y[rng.choice(len(y), p=d / d.sum()) if d.sum() else rng.integers(len(y))]])
        for _ in range(100):
            d = ((y[:, None, :] - c) ** 2).sum(2)
            label = d.argmin(1)
            new = np.array([y[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        inertia = float(d.min(1).sum())
        if best is None or inertia < best[1]:
            best = label, inertia
    return best


# ------------------------------------------------------------------- grouped maps


def per_run(signal: DataFrame, label: Callable[[np.ndarray], np.ndarray], value: str = "x") -> DataFrame:
    """run_id, bin, label of a function of each run's bins x clusters array."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        y, _ = matrix_of(frame, value)
        return pd.DataFrame({"run_id": frame["run_id"].iloc[0], "bin": np.sort(frame["bin"].unique()), "label": np.asarray(label(y), dtype="int64")})

    return signal.select("run_id", "cluster", "bin", value).groupBy("run_id").applyInPandas(run, "run_id string, bin long, label long")


def expand(ends: list[int]) -> np.ndarray:
    return np.repeat(np.arange(len(ends)), np.diff([0, *ends]))


def changepoints(signal: DataFrame, penalty: float, least: int = 2, radius: int = 0, value: str = "x", cost: str = "l2") -> DataFrame:
    """Segment number of every bin."""

    def label(y):
        ends = pelt(y, penalty, least, cost=cost)
        return expand(refine(y, ends, radius, least) if radius else ends)

    return per_run(signal, label, value)


def penalty_grid(signal: DataFrame, penalties: list[float], value: str = "x", cost: str = "l2") -> DataFrame:
    """One task per run and penalty: number of segments and cost."""

    def run(frame):
        y, _ = matrix_of(frame, value)
        p = float(frame["penalty"].iloc[0])
        ends = pelt(y, p, cost=cost)
        return pd.DataFrame({"run_id": [frame["run_id"].iloc[0]], "penalty": [p], "segments": [len(ends)], "cost": [total_cost(y, ends, cost)], "ends": [ends]})

    grid = signal.withColumn("penalty", F.explode(F.array(*map(F.lit, penalties))))
    return grid.select("run_id", "cluster", "bin", value, "penalty").groupBy("run_id", "penalty").applyInPandas(run, "run_id string, penalty double, segments long, cost double, ends array<long>")


def segmentation_costs(signal: DataFrame, ends: list[int], costs: list[str], value: str = "x") -> DataFrame:
    """Cost of the segments that stop at ends, for each run and kind of cost; ends beyond a
    run's last bin are cut to it."""

    def run(frame):
        y, _ = matrix_of(frame, value)
        own = sorted({min(e, len(y)) for e in ends})
        kind = frame["kind"].iloc[0]
        return pd.DataFrame({"run_id": [frame["run_id"].iloc[0]], "kind": [kind], "cost": [total_cost(y, own, kind)]})

    each = signal.withColumn("kind", F.explode(F.array(*map(F.lit, costs))))
    return each.select("run_id", "cluster", "bin", value, "kind").groupBy("run_id", "kind").applyInPandas(run, "run_id string, kind string, cost double")


def active_set_states(signal: DataFrame, width: int, k_max: int, switch: float = 1.0, hamming: float = 0.5, value: str = "x") -> DataFrame:
    """Fixed segments of `width` bins, their active sets and names."""

    def run(frame):
        y, names = matrix_of(frame, value)
        start = np.arange(0, len(y), width)
        x = np.array([y[a : a + width].mean(0) for a in start])
        size = np.minimum(width, len(y) - start)
        spread = np.quantile(x, 0.95) - np.quantile(x, 0.05)
        x = (x - np.median(x)) / (spread if spread > 1e-9 else 1.0)
        masks, p, _ = active_sets(x, size, k_max)
        masks = absorb_flickers(smooth_sets(x, size, masks, p, k_max, switch, hamming), size, width, k_max)
        keys = ["+".join(str(n) for n, m in zip(names, row) if m) or "LOW" for row in masks]
        return pd.DataFrame({"run_id": frame["run_id"].iloc[0], "segment": np.arange(len(x)), "start_bin": start, "stop_bin": start + size, "state_key": keys, "members": masks.sum(1)})

    return signal.select("run_id", "cluster", "bin", value).groupBy("run_id").applyInPandas(run, "run_id string, segment long, start_bin long, stop_bin long, state_key string, members long")

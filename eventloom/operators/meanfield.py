"""Rate curves, fixed points and bifurcations of mean-field networks, one task per parameter
set, and networks of binary units as a source of trains."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def erf(x: np.ndarray) -> np.ndarray:
    """Error function of an array: its power series up to 3, its continued fraction beyond."""
    x = np.asarray(x, dtype=float)
    a = np.minimum(np.abs(x), 6.5)
    near = np.minimum(a, 3.0)
    term, total = near.copy(), near.copy()
    for n in range(1, 60):
        term = term * (2 * near * near) / (2 * n + 1)
        total = total + term
    series = 2 / math.sqrt(math.pi) * np.exp(-near * near) * total
    far, tail = np.maximum(a, 3.0), np.maximum(a, 3.0)
    for n in range(40, 0, -1):
        tail = far + n / 2 / tail
    beyond = 1 - np.exp(-far * far) / math.sqrt(math.pi) / tail
    return np.sign(x) * np.where(a < 3, series, beyond)


def gain(h: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Chance that a Gaussian input of mean h and deviation sd is over 0."""
    return 0.5 * (1 + erf(h / np.maximum(sd, 1e-9) / math.sqrt(2)))


def connectivity(q: int, j: float, kappa: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance arrays of q clusters: within-cluster weight j * kappa, others so that
    the row mean stays j."""
    within = kappa * j
    across = (q * j - within) / max(q - 1, 1)
    mean = np.full((q, q), across / q)
    np.fill_diagonal(mean, within / q)
    return mean, mean * mean * q


def solve(mean: np.ndarray, var: np.ndarray, bias: float, start: np.ndarray, fixed: float | None = None, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Rates r = gain(mean r + bias) by damped iteration, the first rate held where fixed; and
    the residual of the free ones."""
    r = start.copy()
    free = slice(1, None) if fixed is not None else slice(None)
    if fixed is not None:
        r[0] = fixed
    for _ in range(rounds):
        f = gain(mean @ r + bias, np.sqrt(var @ (r * (1 - r)) + 1e-4))
        new = r.copy()
        new[free] = 0.5 * r[free] + 0.5 * f[free]
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    f = gain(mean @ r + bias, np.sqrt(var @ (r * (1 - r)) + 1e-4))
    return r, float(np.abs((f - r)[free]).max(initial=0))


def response_curves(params: DataFrame, steps: int = 101) -> DataFrame:
    """param_id, x, y, solve of params(param_id, q, j, kappa, bias): the focus cluster's
    response y to its own rate x, the others relaxed from the point before."""

    def run(frames):
        for frame in frames:
            out = []
            for p in frame.itertuples():
                mean, var = connectivity(int(p.q), p.j, p.kappa)
                r = np.full(int(p.q), 0.1)
                for x in np.linspace(0, 1, steps):
                    r, _ = solve(mean, var, p.bias, r, x)
                    y = gain(mean[0] @ r + p.bias, np.sqrt(var[0] @ (r * (1 - r)) + 1e-4))
                    out.append((p.param_id, x, float(y), r.tolist()))
            yield pd.DataFrame(out, columns=["param_id", "x", "y", "solve"])

    return params.mapInPandas(run, "param_id string, x double, y double, solve array<double>")


def crossings(curve: DataFrame) -> DataFrame:
    """Where y - x changes sign along each curve, by linear interpolation, and whether the
    crossing is from above (stable)."""
    w = Window.partitionBy("param_id").orderBy("x")
    d = F.col("y") - F.col("x")
    c = curve.select("param_id", "x", d.alias("d"), F.lead("x").over(w).alias("x1"), F.lead(d).over(w).alias("d1"))
    c = c.where("(d > 0 and d1 <= 0) or (d < 0 and d1 >= 0) or (d = 0 and d1 <> 0)")
    at = F.col("x") + F.try_divide(F.col("d"), F.col("d") - F.col("d1")) * (F.col("x1") - F.col("x"))
    return c.select("param_id", at.alias("value"), F.when(F.col("d1") < F.col("d"), "stable").otherwise("unstable").alias("stability"))


def bifurcation_search(grid: DataFrame, low: float = 0.5, high: float = 8.0, rounds: int = 12) -> DataFrame:
    """Least kappa with more than one fixed point for each grid(param_id, q, j, bias)."""

    def count(q, j, bias, kappa):
        mean, var = connectivity(q, j, kappa)
        x = np.linspace(0, 1, 81)
        r, y = np.full(q, 0.1), []
        for v in x:
            r, _ = solve(mean, var, bias, r, v, 60)
            y.append(gain(mean[0] @ r + bias, np.sqrt(var[0] @ (r * (1 - r)) + 1e-4)))
        s = np.sign(np.array(y, float) - x)
        return int((s[1:] * s[:-1] < 0).sum())

    def run(frames):
        for frame in frames:
            out = []
            for p in frame.itertuples():
                a, b = low, high
                if count(int(p.q), p.j, p.bias, b) < 2:
                    out.append((p.param_id, None, "not_found"))
                    continue
                for _ in range(rounds):
                    m = (a + b) / 2
                    a, b = (a, m) if count(int(p.q), p.j, p.bias, m) > 1 else (m, b)
                out.append((p.param_id, b, "ok"))
            yield pd.DataFrame(out, columns=["param_id", "kappa", "status"])

    return grid.mapInPandas(run, "param_id string, kappa double, status string")


def branches(points: DataFrame, jump: float) -> DataFrame:
    """Branch of each point(param_id, x, value): sorted values of neighbouring x are matched in
    order of distance, within jump; an unmatched point begins a branch."""

    def run(frame):
        frame = frame.sort_values(["x", "value"]).reset_index(drop=True)
        label, fresh, last = [0] * len(frame), 0, []
        for _, part in frame.groupby("x"):
            pairs = sorted((abs(frame["value"][i] - v), i, k) for i in part.index for k, (v, _) in enumerate(last))
            taken, used = {}, set()
            for d, i, k in pairs:
                if d <= jump and i not in taken and k not in used:
                    taken[i] = last[k][1]
                    used.add(k)
            for i in part.index:
                if i not in taken:
                    taken[i], fresh = fresh, fresh + 1
                label[i] = taken[i]
            last = [(frame["value"][i], taken[i]) for i in part.index]
        return frame.assign(branch=label)[["param_id", "x", "value", "branch"]]

    return points.select("param_id", "x", "value").groupBy("param_id").applyInPandas(run, "param_id string, x double, value double, branch long")


def eigenvalues(networks: DataFrame) -> DataFrame:
    """param_id, re, im for params(param_id, q, j, kappa, seed): of one dense network each."""

    def run(frames):
        for frame in frames:
            out = []
            for p in frame.itertuples():
                mean, var = connectivity(int(p.q), p.j, p.kappa)
                w = mean + np.random.default_rng(int(p.seed)).standard_normal(mean.shape) * np.sqrt(var)
                out += [(p.param_id, float(e.real), float(e.imag)) for e in np.linalg.eigvals(w)]
            yield pd.DataFrame(out, columns=["param_id", "re", "im"])

    return networks.mapInPandas(run, "param_id string, re double, im double")


def binary_network(runs: DataFrame, clusters: int = 4, size: int = 10, steps: int = 4000) -> DataFrame:
    """Asynchronous threshold units: the diff log (run_id, step, unit, delta) of each of
    runs(run_id, seed, kappa). A run is sequential; runs are spread."""

    def run(frames):
        for frame in frames:
            out = []
            for p in frame.itertuples():
                rng, n = np.random.default_rng(int(p.seed)), clusters * size
                group = np.arange(n) // size
                w = rng.binomial(1, 0.3, (n, n)) * np.where(group[:, None] == group, p.kappa, 1.0)
                w = w / w.sum(1, keepdims=True).clip(1)
                s = (rng.random(n) < 0.3).astype(int)
                h = w @ s
                for step, unit in enumerate(rng.integers(0, n, steps).tolist()):
                    new = int(h[unit] + rng.normal(0, 0.15) > s.mean() + 0.02)
                    if new != s[unit]:
                        h += w[:, unit] * (new - s[unit])
                        out.append((p.run_id, step, unit, new - int(s[unit])))
                        s[unit] = new
            yield pd.DataFrame(out, columns=["run_id", "step", "unit", "delta"])

    return runs.mapInPandas(run, "run_id string, step long, unit long, delta int")


# ------------------------------------------------------------------- two kinds of clusters


def two_kinds(p) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and variance arrays (2 q x 2 q; E clusters, then I) and bias of a row with q, n_e,
    n_i, v_th, m_x, drive_e, drive_i and the blocks of network.cluster_parameters."""
    q = int(p.q)
    exc = np.arange(2 * q) < q
    cluster, size = np.arange(2 * q) % q, np.where(exc, p.n_e, p.n_i) / q
    inside = cluster[:, None] == cluster
    mean, var = np.zeros((2 * q, 2 * q)), np.zeros((2 * q, 2 * q))
    for b in p.blocks:
        part = (exc == (b["block"][0] == "E"))[:, None] & (exc == (b["block"][1] == "E"))
        for where, pr, j in ((part & inside, b["p_in"], b["j_in"]), (part & ~inside, b["p_out"], b["j_out"])):
            k = np.broadcast_to(size, mean.shape)[where] * pr
            mean[where], var[where] = k * j, k * j * j
    return mean, var, np.where(exc, p.drive_e, p.drive_i) * p.m_x - p.v_th


def residual(r: np.ndarray, mean: np.ndarray, var: np.ndarray, bias) -> np.ndarray:
    """gain - rate; the input's variance is that of independent binary sources, r (1 - r) each."""
    inside = np.clip(r, 0, 1)
    return gain(mean @ r + bias, np.sqrt(var @ (inside * (1 - inside)) + 1e-4)) - r


def jacobian(r: np.ndarray, mean: np.ndarray, var: np.ndarray, bias, step: float = 1e-6) -> np.ndarray:
    """Derivatives of residual() by central differences."""
    e = np.eye(len(r)) * step
    return np.stack([(residual(r + d, mean, var, bias) - residual(r - d, mean, var, bias)) / (2 * step) for d in e], axis=1)


def settled(start: np.ndarray, mean: np.ndarray, var: np.ndarray, bias, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Rates that solve the equations, by Newton steps halved until the residual falls; where none
    falls, or the Jacobian can't be solved, by damped iteration."""
    r = start.astype(float).copy()
    for _ in range(rounds):
        f = residual(r, mean, var, bias)
        size = np.abs(f).max()
        if size < 1e-12:
            break
        try:
            move = np.linalg.solve(jacobian(r, mean, var, bias), -f)
        except np.linalg.LinAlgError:
            move = 0.5 * f
        part = 1.0
        while part > 1e-4 and np.abs(residual(np.clip(r + part * move, 0, 1), mean, var, bias)).max() >= size:
            part /= 2
        r = np.clip(r + part * move, 0, 1) if part > 1e-4 else r + 0.5 * f
    return r, float(np.abs(residual(r, mean, var, bias)).max())


def solved_points(params: DataFrame, starts: list[float], same: float = 1e-6) -> DataFrame:
    """(run_id, value, rates, residual, growth, stability) of the distinct fixed points that are
    reached with the first E cluster at each of starts and the others low, for params of two_kinds()
    with run_id. growth: the greatest real part of the Jacobian's eigenvalues, stable below 0."""

    def run(frames):
        for frame in frames:
            out = []
            for p in frame.itertuples():
                mean, var, bias = two_kinds(p)
                found: list[np.ndarray] = []
                for x in starts:
                    start = np.full(len(mean), 0.05)
                    start[0] = x
                    r, left = settled(start, mean, var, bias)
                    if left < 1e-8 and not any(np.abs(r - f).max() < same for f in found):
                        found.append(r)
                        growth = float(np.linalg.eigvals(jacobian(r, mean, var, bias)).real.max())
                        out.append((p.run_id, float(r[0]), r.tolist(), left, growth, "stable" if growth < 0 else "unstable"))
            yield pd.DataFrame(out, columns=["run_id", "value", "rates", "residual", "growth", "stability"])

    return params.mapInPandas(run, "run_id string, value double, rates array<double>, residual double, growth double, stability string")

"""State inference as whole methods: from a signal to labels, one run per task, and sweeps,
comparisons and fan-outs over methods, parameters and runs."""

from __future__ import annotations

import math
import traceback
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.numeric import div
from eventloom.operators import binning, candidates, evaluation, features, results, segmentation, simulation, states
from eventloom.operators.segmentation import expand, matrix_of
from eventloom.sources import importers
from eventloom.sources.stored import stored

# ------------------------------------------------------------------- on one run's array


def segment_array(y: np.ndarray, ends: list[int]) -> np.ndarray:
    return np.array([y[a:b].mean(0) for a, b in zip([0, *ends[:-1]], ends)])


def templates_of(means: np.ndarray, mode: str = "relative", level: float = 0.8, fixed: float | None = None, at_least: int = 1) -> np.ndarray:
    """Which clusters are active in each segment; as results.segment_templates on one run."""
    if mode == "fixed":
        limit = np.full(means.shape[1], float(fixed))
    elif mode == "percentile":
        limit = np.quantile(means, level, axis=0)
    else:
        low, high = np.quantile(means, [0.2, 0.95], axis=0)
        limit = low + (0.35 if fixed is None else fixed) * np.maximum(high - low, 0)
    out = means >= limit
    for row, mean in zip(out, means):
        if row.sum() < at_least:
            row[np.argsort(mean, kind="stable")[-at_least:]] = True
    return out


def merge_templates(y: np.ndarray, ends: list[int], least: int = 1, **template) -> list[int]:
    """While neighbours have one template or a side shorter than least, the leftmost such pair
    is merged and the templates are found again."""
    ends = list(ends)
    while len(ends) > 1:
        own, size = templates_of(segment_array(y, ends), **template), np.diff([0, *ends])
        wrong = (own[1:] == own[:-1]).all(1) | (size[1:] < least) | (size[:-1] < least)
        if not wrong.any():
            break
        ends.pop(int(wrong.argmax()))
    return ends


def first_seen(rows: np.ndarray) -> np.ndarray:
    """Numbers of equal rows in the order of their first appearance."""
    _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[which.ravel()]


def mask_cost(row: np.ndarray, mask: np.ndarray, p: dict, per_active: float = 0.0, per_choice: float = 0.0) -> float:
    """Cost of one set for one segment's means."""
    k, q = int(mask.sum()), len(row)
    mu, var = np.where(mask, p["mu1"][k], p["mu0"][k]), np.where(mask, p["var1"][k], p["var0"][k])
    choice = math.lgamma(q + 1) - math.lgamma(k + 1) - math.lgamma(q - k + 1)
    return float(0.5 * ((row - mu) ** 2 / var + np.log(var)).sum() + per_active * k + per_choice * choice)


def boundary_evidence(x: np.ndarray, masks: np.ndarray, p: dict, **price) -> list[tuple[int, float, float, int]]:
    """(segment, left, right, members changed) at each change of set: what it would cost more to
    carry the other side's set over into the segment left, and right, of the boundary."""
    out = []
    for i in range(1, len(x)):
        a, b = masks[i - 1], masks[i]
        if (a != b).any():
            cost = lambda row, m: mask_cost(x[row], m, p, **price)
            out.append((i, cost(i - 1, b) - cost(i - 1, a), cost(i, a) - cost(i, b), int((a != b).sum())))
    return out


def merge_unsupported(x: np.ndarray, size: np.ndarray, masks: np.ndarray, p: dict, least: float, **price) -> np.ndarray:
    """While a boundary's weaker side has less evidence than least, the weakest boundary goes:
    the shorter episode beside it takes the other's set."""
    masks = masks.copy()
    while True:
        found = [(min(a, b), i) for i, a, b, _ in boundary_evidence(x, masks, p, **price)]
        if not found or min(found)[0] >= least:
            return masks
        i = min(found)[1]
        a, b = i - 1, i
        while a > 0 and (masks[a - 1] == masks[i - 1]).all():
            a -= 1
        while b + 1 < len(masks) and (masks[b + 1] == masks[i]).all():
            b += 1
        left, right = slice(a, i), slice(i, b + 1)
        if size[left].sum() < size[right].sum():
            masks[left] = masks[i]
        else:
            masks[right] = masks[i - 1]


# ------------------------------------------------------------------- hidden Markov models


def _emission(kind: str, y: np.ndarray, k: int, rng: np.random.Generator) -> tuple[dict, Callable, Callable]:
    """Starting parameters, log chances (bins x states) and the update from responsibilities."""
    some = y[rng.choice(len(y), k, replace=len(y) < k)].astype(float)
    mean = lambda g: (g.T @ y) / np.maximum(g.sum(0), 1e-12)[:, None]
    if kind == "gaussian":
        def update(g):
            m = mean(g)
            v = (g.T @ (y * y)) / np.maximum(g.sum(0), 1e-12)[:, None] - m * m
            return {"m": m, "v": np.maximum(v, 0) + 1e-4}

        chance = lambda p: -0.5 * (((y[:, None] - p["m"]) ** 2 / p["v"]) + np.log(2 * np.pi * p["v"])).sum(2)
        return {"m": some, "v": np.tile(y.var(0) + 1e-3, (k, 1))}, chance, update
    if kind == "poisson":
        kinds, which = np.unique(y, return_inverse=True)
        const = np.array([math.lgamma(v + 1) for v in kinds])[which].reshape(y.shape).sum(1, keepdims=True)
        return {"m": some + 0.1}, lambda p: y @ np.log(p["m"]).T - p["m"].sum(1) - const, lambda g: {"m": np.maximum(mean(g), 1e-6)}
    if kind == "bernoulli":
        start = 0.25 + 0.5 * some
        return {"m": start}, lambda p: y @ np.log(p["m"]).T + (1 - y) @ np.log(1 - p["m"]).T, lambda g: {"m": np.clip(mean(g), 1e-4, 1 - 1e-4)}
    raise ValueError(f"unknown emission: {kind}")


def hmm(y: np.ndarray, k: int, emission: str = "gaussian", seeds: int = 3, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Viterbi path, smoothed chances and log likelihood of the best of several starts."""
    best = None
    for seed in range(seeds):
        p, chance, update = _emission(emission, y, k, np.random.default_rng(seed))
        start, move, ll = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)), -np.inf
        np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
        for _ in range(rounds):
            log_b = chance(p)
            top = log_b.max(1, keepdims=True)
            b, n = np.exp(log_b - top), len(y)
            a, scale, back, xi = np.empty_like(b), np.empty(n), np.ones_like(b), np.zeros((k, k))
            for t in range(n):
                a[t] = (start if t == 0 else a[t - 1] @ move) * b[t]
                scale[t] = a[t].sum()
                a[t] /= scale[t]
            for t in range(n - 2, -1, -1):
                later = b[t + 1] * back[t + 1] / scale[t + 1]
                xi += a[t][:, None] * move * later
                back[t] = move @ later
            g = a * back
            g /= g.sum(1, keepdims=True)
            now = float(np.log(scale).sum() + top.sum())
            path_model = np.log(start + 1e-300), np.log(move + 1e-300), log_b
            if now - ll < 1e-6 * abs(now):
                ll = now
                break
            ll = now
            start, move = g[0], (xi + 1e-9) / (xi + 1e-9).sum(1, keepdims=True)
            p = update(g)
        if best is None or ll > best[0]:
            best = ll, g, path_model
    ll, g, (first, move, log_b) = best
    score, trace = first + log_b[0], []
    for t in range(1, len(y)):
        step = score[:, None] + move
        trace.append(step.argmax(0))
        score = step.max(0) + log_b[t]
    path = [int(score.argmax())]
    for s in reversed(trace):
        path.append(int(s[path[-1]]))
    return np.array(path[::-1]), g, ll


def parameter_count(emission: str, k: int, q: int) -> int:
    """Free numbers of a hidden Markov model: start, moves, and one or two per state and column."""
    return k - 1 + k * (k - 1) + (1 if emission in ("poisson", "bernoulli") else 2) * k * q


# ------------------------------------------------------------------- methods over runs


def threshold_states(signal: DataFrame, level: float = 0.5, gap: int = 0, least_on: int = 1, least_off: int = 1) -> DataFrame:
    """Thresholded, cleaned activity; a state is a pattern of active clusters."""
    on = states.clean(binning.binarized(signal, "percentile", "x", level), gap, least_on, least_off)
    return states.pattern_labels(on).select("run_id", "bin", F.col("label").cast("long").alias("label"))


def kmeans_states(signal: DataFrame, k: int, kind: str = "zscore_rates", least: int = 1) -> DataFrame:
    """k-means of bins, short runs taken by the run before."""
    x = features.features(signal, kind).withColumnRenamed("f", "x")
    return segmentation.per_run(x, lambda y: segmentation.remove_short(segmentation.lloyd(y, k)[0], least))


def changepoint_states(signal: DataFrame, penalty: float, search: str = "pelt", least: int = 2, radius: int = 0, distance: float | None = None, merge: bool = True, k: int | None = None, **template) -> DataFrame:
    """Segments by 'pelt', 'binary' or 'window' search, boundaries refined, neighbours nearer
    than distance or of one template merged; states are templates, or k-means of segment means."""

    def label(y):
        if search == "pelt":
            ends = segmentation.pelt(y, penalty, least)
        elif search == "binary":
            ends = segmentation.binary_segmentation(y, penalty, least)
        else:
            ends = segmentation.moving_window(y, max(2, least), penalty)
        if radius:
            ends = segmentation.refine(y, ends, radius, least)
        if distance is not None:
            ends = segmentation.merge_similar(y, ends, distance, least)
        if merge:
            ends = merge_templates(y, ends, least, **template)
        means = segment_array(y, ends)
        own = first_seen(templates_of(means, **template)) if k is None else segmentation.lloyd(means, min(k, len(means)))[0]
        return own[expand(ends)]

    scaled = binning.run_scaled(signal).select("run_id", "cluster", "bin", F.col("y").alias("x"))
    return segmentation.per_run(scaled, label)


def hmm_states(signal: DataFrame, k: int, emission: str = "gaussian", seeds: int = 3) -> DataFrame:
    kind = {"gaussian": "zscore_rates", "poisson": "counts", "bernoulli": "binary"}[emission]
    x = features.features(signal, kind).withColumnRenamed("f", "x")
    return segmentation.per_run(x, lambda y: hmm(y, k, emission, seeds)[0])


def active_set_labels(signal: DataFrame, width: int, k_max: int) -> DataFrame:
    """Bins by the active set of their segment, numbered in the order of state keys."""
    found = segmentation.active_set_states(signal, width, k_max)
    kinds = found.select("run_id", "members", "state_key").distinct()
    kinds = kinds.withColumn("label", (F.row_number().over(Window.partitionBy("run_id").orderBy("members", "state_key")) - 1).cast("long"))
    return found.join(kinds, ["run_id", "members", "state_key"]).select("run_id", F.explode(F.sequence("start_bin", F.col("stop_bin") - 1)).alias("bin"), "label")


METHODS = {"threshold": threshold_states, "kmeans": kmeans_states, "changepoint": changepoint_states, "hmm": hmm_states, "active_set": active_set_labels}


def analyzed(signal: DataFrame, wanted: dict[str, dict]) -> DataFrame:
    """run_id, method, bin, label of every wanted method with its settings. A setting `method`
    names the method where one is run more than once."""
    out = []
    for name, settings in wanted.items():
        own = {k: v for k, v in settings.items() if k != "method"}
        out.append(METHODS[settings.get("method", name)](signal, **own).withColumn("method", F.lit(name)))
    return reduce(DataFrame.unionByName, out).select("run_id", "method", "bin", "label")


def evaluated(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """Per run and method: agreement with the truth and accuracy under the best matching."""
    keys = ["run_id", "method"]
    both = labels.join(truth.select("run_id", "bin", F.col("label").alias("true")), ["run_id", "bin"])
    table = evaluation.contingency(both, "true", "label", keys)
    return evaluation.agreement(table, keys).join(evaluation.matched_accuracy(table, keys), keys)


# ------------------------------------------------------------------- sweeps and fan-outs


def _silhouette(y: np.ndarray, label: np.ndarray) -> float | None:
    kinds = np.unique(label)
    if len(kinds) < 2 or len(kinds) >= len(y):
        return None
    d = np.sqrt(np.maximum((y * y).sum(1)[:, None] + (y * y).sum(1) - 2 * y @ y.T, 0))
    np.fill_diagonal(d, 0)
    sums = np.stack([d[:, label == j].sum(1) for j in kinds], 1)
    size = np.array([(label == j).sum() for j in kinds])
    own = np.searchsorted(kinds, label)
    at = np.arange(len(y))
    a = sums[at, own] / np.maximum(size[own] - 1, 1)
    other = sums / size
    other[at, own] = np.inf
    b = other.min(1)
    s = np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return float(s.mean())


def state_count_sweep(signal: DataFrame, counts: list[int], sigmas: list[float], emission: str = "gaussian", seeds: int = 2, value: str = "x") -> DataFrame:
    """One task per run, method ('kmeans', 'hmm'), smoothing and number of states: states and
    segments found, largest share of bins, silhouette, inertia, log likelihood, BIC and AIC."""

    def run(frame):
        y, _ = matrix_of(frame, value)
        method, sigma, k = frame["method"].iloc[0], float(frame["sigma"].iloc[0]), int(frame["k"].iloc[0])
        if sigma > 0:
            at = np.arange(-math.ceil(4 * sigma), math.ceil(4 * sigma) + 1)
            w = np.exp(-0.5 * (at / sigma) ** 2)
            rows = np.clip(np.arange(len(y))[:, None] + at, 0, len(y) - 1)
            y = np.einsum("tkc,k->tc", y[rows], w / w.sum())
        sd = y.std(0)
        y = (y - y.mean(0)) / np.where(sd == 0, 1, sd)
        inertia = ll = bic = aic = None
        if method == "kmeans":
            label, inertia = segmentation.lloyd(y, k)
        else:
            label, _, ll = hmm(y, k, emission, seeds)
            free = parameter_count(emission, len(np.unique(label)), y.shape[1])
            bic, aic = math.log(max(len(y), 2)) * free - 2 * ll, 2.0 * free - 2 * ll
        share = np.bincount(label).max() / len(label)
        row = (frame["run_id"].iloc[0], method, sigma, k, len(np.unique(label)), 1 + int((np.diff(label) != 0).sum()), float(share), _silhouette(y, label), inertia, ll, bic, aic)
        return pd.DataFrame([row], columns=["run_id", "method", "sigma", "k", "found", "segments", "dominant", "silhouette", "inertia", "log_likelihood", "bic", "aic"])

    grid = signal.select("run_id", "cluster", "bin", value)
    for name, options in (("method", ["kmeans", "hmm"]), ("sigma", sigmas), ("k", counts)):
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    kinds = "run_id string, method string, sigma double, k int, found int, segments int, dominant double, silhouette double, inertia double, log_likelihood double, bic double, aic double"
    return grid.groupBy("run_id", "method", "sigma", "k").applyInPandas(run, kinds)


def fanned_out(tasks: DataFrame, keys: list[str], work: Callable[[dict], dict], kinds: str) -> DataFrame:
    """work on each row of tasks, spread over the cluster: its result's columns, or the error
    that it ended with; one failing task stops no other."""
    names = [c for c in tasks.columns]
    schema = ", ".join(f"{n} {t}" for n, t in tasks.select(*keys).dtypes) + f", {kinds}, error string"
    fields = [part.strip().split(" ")[0] for part in kinds.split(",")]

    def run(frames):
        for frame in frames:
            out = []
            for row in frame[names].to_dict("records"):
                try:
                    found, error = work(row), None
                except Exception:  # noqa: BLE001 - the error is the row's result
                    found, error = {}, traceback.format_exc(limit=1).strip().split("\n")[-1]
                out.append([*(row[k] for k in keys), *(found.get(f) for f in fields), error])
            yield pd.DataFrame(out, columns=[*keys, *fields, "error"])

    return tasks.mapInPandas(run, schema)


def dealt(tasks: DataFrame, conditions: list[str], order: str) -> DataFrame:
    """tasks with the conditions dealt to them in turn."""
    nth = F.col(order) % len(conditions)
    return tasks.withColumn("condition", F.element_at(F.array(*map(F.lit, conditions)), (nth + 1).cast("int")))


def crops_choice(rows: DataFrame, how: str = "elbow", target: int | None = None, least_gain: float = 0.0, least_penalty: float = 0.0, least_distance: float = 0.0) -> DataFrame:
    """One of each run's candidates(run_id, penalty, segments, cost, distance). Candidates that
    lower the single segment's cost by too small a share, or have too small a penalty or distance
    of neighbours go, but a filter that would leave none is passed over. Then the one nearest to
    target, with the 'most' or 'fewest' segments, or farthest from the chord ('elbow')."""
    w = Window.partitionBy("run_id")
    worst = F.max("cost").over(w)
    rules = [1 - div(F.col("cost"), F.col("worst")) >= least_gain, F.col("penalty") >= least_penalty, F.col("distance") >= least_distance]
    x = rows.withColumn("worst", worst)
    for rule in rules:
        x = x.withColumn("ok", F.coalesce(rule, F.lit(False))).withColumn("some", F.max("ok").over(w)).where("ok or not some").drop("ok", "some")
    ends = x.groupBy("run_id").agg(F.min("segments").alias("s0"), F.max("segments").alias("s1"), F.max_by("cost", F.struct(-F.col("segments"), -F.col("cost"))).alias("c0"), F.max_by("cost", F.struct("segments", -F.col("cost"))).alias("c1"))
    chord = F.abs((F.col("segments") - F.col("s0")) * (F.col("c1") - F.col("c0")) - (F.col("cost") - F.col("c0")) * (F.col("s1") - F.col("s0")))
    first: Column = {"target": F.abs(F.col("segments") - F.lit(target or 0)), "most": -F.col("segments"), "fewest": F.col("segments"), "elbow": -F.round(chord, 9)}[how]
    return x.join(ends, "run_id").groupBy("run_id").agg(F.min_by(F.struct("penalty", "segments"), F.struct(first.alias("a"), F.col("segments"), F.col("penalty"))).alias("r")).select("run_id", "r.*")


def segment_costs(signal: DataFrame, labels: DataFrame, value: str = "x") -> DataFrame:
    """Squared error of each run's segments, by sums alone."""
    segs = states.segments(labels)
    bins = segs.select("run_id", "start_bin", F.explode(F.sequence("start_bin", F.col("stop_bin") - 1)).alias("bin"))
    x = signal.join(bins, ["run_id", "bin"])
    per = x.groupBy("run_id", "start_bin", "cluster").agg((F.count(F.lit(1)) * F.var_pop(value)).alias("sse"))
    return per.groupBy("run_id").agg(F.sum("sse").alias("cost"), F.countDistinct("start_bin").alias("segments"))


def distinct_solutions(rows: DataFrame) -> DataFrame:
    """One of the candidates(run_id, penalty, segments, cost, ends) for each list of boundaries,
    that of the least penalty."""
    return rows.groupBy("run_id", "ends").agg(F.min(F.struct("penalty", "segments", "cost")).alias("r")).select("run_id", "ends", "r.*")


def analyze_source(spark, source: str, run_id: str, wanted: dict[str, dict], bin_ms: float, units_per_cluster: int, folder: str | None = None) -> dict[str, DataFrame]:
    """Labels and the finished tables of every wanted method for a recording in a folder or an
    archive; written as tables of the run if a folder is given."""
    read = importers.read_run(spark, source, run_id)
    if read["kind"] == "snn":
        events = read["frame"].withColumn("cluster", F.floor(F.col("unit") / units_per_cluster)).withColumn("value", F.lit(1.0))
        last = events.agg(F.max("t")).first()[0] or 0.0
        signal = binning.cluster_signal(events, events.select("run_id", "cluster").distinct(), 0.0, int(last // bin_ms) + 1, bin_ms)
    else:
        signal = read["frame"].withColumn("n", F.col("x"))
    labels = analyzed(signal, wanted)
    out = {"labels": labels}
    for name in wanted:
        done = results.finalized(labels.where(F.col("method") == name).select("run_id", "bin", "label"), signal, bin_ms)
        out |= {f"{name}_{part}": done[part] for part in ("segments", "occupancy", "templates")}
    if folder:
        importers.save_run(out, folder, run_id)
    return out


def episodes_of(signal: DataFrame, names: DataFrame, width: int, most: int, dt: float = 1.0, z: float = 0.5, similarity: float = 0.6, floor: float = 0.05) -> dict[str, DataFrame]:
    """Stretches of `width` bins, their templates and canonical states: keys, labels, inventory
    and emissions of every run. names: (cluster, name)."""
    means = signal.withColumn("start_bin", F.col("bin") - F.col("bin") % width).groupBy("run_id", "start_bin", "cluster").agg(F.avg("x").alias("mean"))
    last = signal.groupBy("run_id").agg((F.max("bin") + 1).alias("bins"))
    rates = results.segment_templates(means).join(names, "cluster").select("run_id", F.col("start_bin").alias("episode"), "cluster", "name", F.col("mean").alias("rate"), "active")
    keys = stored(results.canonical_keys(stored(rates, "rates"), most, z, similarity, floor), "keys")
    episodes = keys.join(last, "run_id").select("run_id", "episode", F.col("episode").alias("start_bin"), F.least(F.col("episode") + width, F.col("bins")).alias("stop_bin"))
    labels = results.canonical_labels(episodes, keys)
    return {"keys": keys, "labels": labels, "inventory": results.inventory(labels, results.canonical_states(keys), dt), "emissions": results.emissions(labels, signal)}


def shard(runs: DataFrame, stride: int, steps: int, width: int, most: int) -> dict[str, DataFrame]:
    """Simulated runs (see simulation) and the episodes of their excitatory clusters' rates."""
    rates = simulation.recorded_rates(simulation.change_log(runs), simulation.members(runs), stride, steps).where("pop LIKE 'E%'")
    signal = rates.select("run_id", F.col("pop").alias("cluster"), (F.col("step") / stride).cast("long").alias("bin"), F.col("rate").alias("x"))
    signal = stored(signal, "signal")  # the runs are simulated once
    names = simulation.members(runs).select(F.col("pop").alias("cluster"), F.col("pop").alias("name")).distinct()
    return {"signal": signal} | episodes_of(signal, names, width, most)


def planted_sets(spark, segments: int, clusters: int, noise: float, seed: int, share: float = 0.4) -> DataFrame:
    """(segment, cluster, length, member, x): drawn active sets, lengths and noisy means."""
    cell = spark.range(segments * clusters).select(F.floor(F.col("id") / clusters).alias("segment"), (F.col("id") % clusters).alias("cluster"))
    u = lambda *what: candidates.drawn(F.lit(seed), *what)
    member = (u(F.col("segment"), F.col("cluster")) < share).cast("int")
    x = member + noise * (2 * u(F.lit("x"), F.col("segment"), F.col("cluster")) - 1)
    return cell.select("segment", "cluster", (F.floor(u(F.lit("n"), F.col("segment")) * 8) + 3).alias("length"), member.alias("member"), x.alias("x"))

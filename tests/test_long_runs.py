"""Runs of any length: stretches joined again equal the whole run in one array."""

import numpy as np
import pytest

from eventloom.plans import long_queries
from eventloom.operators import long_hmm, long_kmeans, long_segments, methods, segmentation


def framed(spark, runs, counts=False):
    rows = [(run, f"c{j}", 5 + i, float(v)) for run, y in runs.items() for i, row in enumerate(y) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "run_id string, cluster string, bin long, x double").repartition(3)


def steps(rng, n, q, every=25, noise=1.0):
    return np.repeat(rng.normal(size=(n // every + 1, q)) * 2, every, 0)[:n] + noise * rng.normal(size=(n, q))


def by_run(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["run_id"], []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


# ------------------------------------------------------------------- segments


def least_cost(y, penalty, least, cost):
    price, n = segmentation.COSTS[cost](y), len(y)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    for t in range(1, n + 1):
        k = np.array([a for a in range(0, t - least + 1) if np.isfinite(best[a])], dtype=int)
        if len(k):
            best[t] = (best[k] + price(k, np.full(len(k), t))).min() + penalty
    return best[n]


@pytest.mark.parametrize("cost,least", [("l2", 1), ("l2", 3), ("l1", 2)])
def test_searches_and_proved_windows(cost, least):
    rng = np.random.default_rng(7)
    for trial in range(12):
        y, penalty = steps(rng, int(rng.integers(40, 160)), int(rng.integers(1, 4)), 12), float(rng.choice([0.5, 2.0, 6.0]))
        costs, back = long_segments.searched(y, np.array([0]), penalty, least, cost)
        assert costs[0, -1] == pytest.approx(least_cost(y, penalty, least, cost))
        many, _ = long_segments.searched(y, np.arange(4), penalty, least, cost)
        for s in range(4):
            assert many[s, -1] <= least_cost(y[s:], penalty, least, cost) + 1e-9
        border = int(rng.integers(5, len(y) // 2))
        last = long_segments.window_of(y[border:], penalty, least, cost)
        if last is not None:
            ends, at = [], len(y)
            while at:
                ends.append(at)
                at = int(back[0, at])
            assert any(border < e <= border + last for e in ends)


@pytest.mark.parametrize("cost,stretch,fan", [("l2", 80, 64), ("l2", 40, 2), ("l1", 60, 3)])
def test_stretches_give_the_whole_runs_segments(spark, cost, stretch, fan):
    rng = np.random.default_rng(1)
    runs = {"a": steps(rng, 640, 2), "b": steps(rng, 97, 2, 9), "flat": np.full((200, 2), 3.0), "one": np.zeros((1, 2)), "late": np.vstack([np.zeros((150, 2)), steps(rng, 100, 2, 10)])}
    got = by_run(long_segments.long_changepoints(framed(spark, runs), 4.0, 2, cost=cost, stretch=stretch, fan=fan), "start_bin", "stop_bin")
    for run, y in runs.items():
        want = [0, *segmentation.pelt(y, 4.0, 2, cost=cost)]
        ends = [a - 5 for a, _ in got[run]] + [got[run][-1][1] - 5]
        assert [a for a, _ in got[run][1:]] == [b for _, b in got[run][:-1]] and ends[0] == 0 and ends[-1] == len(y)
        total = lambda e: segmentation.total_cost(y, e[1:], cost) + 4.0 * (len(e) - 1)
        assert total(ends) == pytest.approx(min(total(want), least_cost(y, 4.0, 2, cost) if len(y) > 1 else np.inf))
    assert len(got["flat"]) == len(got["one"]) == 1
    cut = long_segments.vectors(framed(spark, {"a": runs["a"]})).selectExpr("*", f"at div {stretch} AS stretch")
    assert long_segments.blocks(cut, 4.0, 2, cost, stretch).select("block").distinct().count() >= 0.6 * 640 / stretch


def test_long_penalty_grid_and_what_cannot_be_proved(spark):
    rng = np.random.default_rng(2)
    y = steps(rng, 300, 2)
    got = {r["penalty"]: r for r in long_segments.long_penalty_grid(framed(spark, {"a": y}), [1.0, 8.0], stretch=50).collect()}
    absolute = long_segments.long_penalty_grid(framed(spark, {"a": y}), [4.0], cost="l1", stretch=50).first()
    ends = segmentation.pelt(y, 4.0, 2, cost="l1")
    assert absolute["cost"] + 4 * absolute["segments"] == pytest.approx(segmentation.total_cost(y, ends, "l1") + 4 * len(ends))
    for p in (1.0, 8.0):
        ends = segmentation.pelt(y, p, 2)
        assert got[p]["cost"] + p * got[p]["segments"] == pytest.approx(segmentation.total_cost(y, ends) + p * len(ends))
    with pytest.raises(ValueError, match="normal"):
        long_segments.long_changepoints(framed(spark, {"a": y}), 1.0, cost="normal")


# ------------------------------------------------------------------- hidden Markov models


@pytest.mark.parametrize("emission", ["gaussian", "poisson", "bernoulli"])
def test_scans_equal_the_whole_runs_model(spark, emission):
    rng = np.random.default_rng(3)
    state = np.repeat(rng.integers(0, 3, 60), 8)
    mean = rng.permuted(np.tile(np.array([1.0, 4.0, 9.0]), (6, 1)), axis=1).T  # states x clusters; binary rows of six seldom repeat
    one = {"gaussian": lambda s: mean[s] + rng.normal(size=(len(s), 6)), "poisson": lambda s: rng.poisson(mean[s]).astype(float), "bernoulli": lambda s: (rng.random((len(s), 6)) < mean[s] / 10).astype(float)}[emission]
    runs = {"a": one(state), "b": one(state[:50]), "c": one(state[:7])}
    paths, fits = long_hmm.long_hmm(framed(spark, runs), 3, emission, 2, 12, stretch=61)
    got, ll = by_run(paths, "bin", "label"), {r["run_id"]: r["log_likelihood"] for r in fits.collect()}
    for run, y in runs.items():
        path, _, best = methods.hmm(y, 3, emission, 2, 12)
        assert ll[run] == pytest.approx(best, rel=1e-9)
        assert [s for _, s in got[run]] == path.tolist() and [b for b, _ in got[run]] == list(range(5, 5 + len(y)))


# ------------------------------------------------------------------- k-means


def test_partition_sums_reach_the_whole_runs_inertia(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(5, 3)) * 6
    runs = {"a": centre[rng.integers(0, 5, 900)] + rng.normal(size=(900, 3)), "few": np.zeros((3, 3)), "same": np.ones((40, 3)), "large": 1e8 + centre[rng.integers(0, 5, 200)]}
    labels, fits = long_kmeans.long_kmeans(framed(spark, runs), 5, 3)
    got, found = by_run(labels, "bin", "label"), {r["run_id"]: r for r in fits.collect()}
    for run, y in runs.items():
        label = np.array([s for _, s in got[run]])
        assert len(label) == len(y) and len(found[run]["centres"]) == 5
        c = np.array(found[run]["centres"])
        assert ((y - c[label]) ** 2).sum() == pytest.approx(found[run]["inertia"], rel=1e-9, abs=1e-6)
        assert found[run]["inertia"] <= 1.01 * segmentation.lloyd(y, 5)[1] + 1e-6


# ------------------------------------------------------------------- whole tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(spark):
    """bins x (gap, value) of all events in order, from the table itself."""
    e = spark.read.parquet(f"{DATA}/events.parquet").toPandas().sort_values("ts")
    gap = e["ts"].diff().dt.total_seconds().fillna(0).to_numpy() / 3600
    return np.stack([gap / gap.std(), e["value"].to_numpy() / e["value"].std(ddof=0)], 1)


def test_long_queries_over_the_whole_table(spark, series):
    segs = sorted((r["start_bin"], r["stop_bin"]) for r in long_queries.QUERIES["long_changepoints"](spark, DATA).collect())
    ends = [b for _, b in segs]
    assert [a for a, _ in segs] == [0, *ends[:-1]] and ends[-1] == len(series)
    price = lambda ends, p: segmentation.total_cost(series, ends) + p * len(ends)
    assert price(ends, 6.0) == pytest.approx(least_cost(series, 6.0, 3, "l2"))
    for r in long_queries.QUERIES["long_penalty_sweep"](spark, DATA).collect():
        assert r["cost"] + r["penalty"] * r["segments"] == pytest.approx(least_cost(series, r["penalty"], 3, "l2"), abs=1e-5)
    path, _, _ = methods.hmm(series, 2, "gaussian", 2, 4)
    got = sorted((r["bin"], r["label"]) for r in long_queries.QUERIES["long_hmm_states"](spark, DATA).collect())
    assert [s for _, s in got] == path.tolist()
    fit = long_queries.QUERIES["long_kmeans_inertia"](spark, DATA).first()
    assert fit["inertia"] <= 1.01 * segmentation.lloyd(series, 4)[1] and fit["centres"] == 4

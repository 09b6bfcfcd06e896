"""Queries that SQL can't express, over their whole tables, against plain loops."""

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.operators import binning, candidates, evaluation, segmentation
from eventloom.plans import config, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    """bins x clusters of the signal of the events table, from the events themselves."""
    e = spark.read.parquet(f"{DATA}/events.parquet").toPandas()
    step = (e["ts"] - pd.Timestamp("2024-01-01")) // pd.Timedelta(hours=6)
    names = sorted(e["event_type"].unique())
    out = np.zeros((120, len(names)))
    for b, c, v in zip(step, e["event_type"], e["value"]):
        if 0 <= b < 120:
            out[b, names.index(c)] += v
    return out


@pytest.fixture(scope="module")
def scaled(spark, raw):
    frame = binning.run_scaled(queries.signal(spark, DATA)).toPandas().pivot(index="bin", columns="cluster", values="y")
    own = frame.sort_index().sort_index(axis=1).to_numpy(float)
    low = np.corrcoef(own.ravel(), raw.ravel())[0, 1]  # one affine map of the whole run
    assert low == pytest.approx(1.0)
    return own


def plain_costs(y, kind):
    """n + 1 x n + 1 array of each stretch's cost, from its definition."""
    n = len(y)
    if kind == "rbf":
        d = ((y[:, None] - y) ** 2).sum(2)
        gram = np.exp(-np.clip(d / (np.median(d[np.triu_indices(n, 1)]) or 1.0), 0.01, 100))
        np.fill_diagonal(gram, 1.0)
    out = np.full((n + 1, n + 1), np.inf)
    for a, b in itertools.combinations(range(n + 1), 2):
        p = y[a:b]
        if kind == "l2":
            out[a, b] = ((p - p.mean(0)) ** 2).sum()
        elif kind == "l1":
            out[a, b] = np.abs(p - np.median(p, axis=0)).sum()
        elif kind == "rbf":
            out[a, b] = b - a - gram[a:b, a:b].sum() / (b - a)
        else:
            cov = np.cov(p.T) if b - a > 1 else np.zeros((y.shape[1],) * 2)
            out[a, b] = (b - a) * np.linalg.slogdet(cov + 1e-6 * np.eye(y.shape[1]))[1]
    return out


def best_ends(cost, penalty, least):
    n = len(cost) - 1
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for b in range(1, n + 1):
        for a in range(0, b - least + 1):
            if best[a] + cost[a, b] + penalty < best[b]:
                best[b], back[b] = best[a] + cost[a, b] + penalty, a
    ends, at = [], n
    while at:
        ends.append(at)
        at = back[at]
    return best[n], ends[::-1]


@pytest.mark.parametrize("kind", ["l2", "l1", "rbf", "normal"])
def test_costs_equal_their_definitions(kind):
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.normal(m, 0.4, (9, 2)) for m in (0, 2, -1)])
    want, own = plain_costs(y, kind), segmentation.COSTS[kind](y)
    for b in range(2, len(y) + 1):  # as a search asks: all starts for one end, ends rising
        a = np.arange(0, b - 1)
        assert own(a, np.full(len(a), b)) == pytest.approx(want[a, b], abs=1e-7)
    for a, b in ((0, 1), (3, 17), (5, 27)):
        assert float(own(np.array(a), np.array(b))) == pytest.approx(want[a, b], abs=1e-7)
    assert segmentation.total_cost(y, [9, 18, 27], kind) == pytest.approx(want[0, 9] + want[9, 18] + want[18, 27])
    if kind != "normal":
        for penalty in (0.5, 2.0, 9.0):
            assert segmentation.pelt(y, penalty, 2, cost=kind) == best_ends(want, penalty, 2)[1]


def test_median_of_pairs():
    rng = np.random.default_rng(1)
    for n in (2, 3, 40, 41):
        y = np.round(rng.normal(0, 1, (n, 3)), 1 if n == 40 else 9)
        assert segmentation.pair_median(y, 16) == pytest.approx(np.median([((a - b) ** 2).sum() for a, b in itertools.combinations(y, 2)]), rel=1e-12)
    y = rng.normal(0, 1, (700, 3))
    d = ((y[:, None] - y) ** 2).sum(2)[np.triu_indices(700, 1)]
    assert segmentation.pair_median(y) == pytest.approx(np.median(d), rel=1e-12)
    assert segmentation.pair_median(y[:1]) == 0.0 and segmentation.pair_median(np.ones((5, 2))) == 0.0


@pytest.mark.parametrize("name, kind, least", [("penalty_sweep", "l2", 2), ("kernel_changepoints", "rbf", 2)])
def test_penalties_are_met_at_least_cost(spark, scaled, name, kind, least):
    cost = plain_costs(scaled, kind)
    for r in queries.QUERIES[name](spark, DATA).collect():
        assert r["cost"] + r["penalty"] * r["segments"] == pytest.approx(best_ends(cost, r["penalty"], least)[0], abs=1e-4)


def test_changepoints_are_the_best_ones_refined(spark, scaled):
    cost = plain_costs(scaled, "l2")
    ends = best_ends(cost, 1.0, 3)[1]
    for i in range(len(ends) - 1):
        left, right = ends[i - 1] if i else 0, ends[i + 1]
        around = range(max(left + 3, ends[i] - 2), min(right - 3, ends[i] + 2) + 1)
        ends[i] = min(around, key=lambda k: cost[left, k] + cost[k, right]) if len(around) else ends[i]
    want = [sum(b >= e for e in ends) for b in range(len(scaled))]
    got = sorted((r["bin"], r["label"]) for r in queries.QUERIES["changepoints"](spark, DATA).collect())
    assert got == list(enumerate(want))


def test_short_runs_go_from_the_left(spark):
    before = [r["label"] for r in queries.patterns(spark, DATA).orderBy("bin").collect()]
    while True:
        runs = [(k, len(list(g))) for k, g in itertools.groupby(before)]
        short = next((i for i, (_, n) in enumerate(runs) if n < 3), None)
        if short is None or len(runs) == 1:
            break
        runs[short] = (runs[short - 1] if short else runs[1])[0], runs[short][1]
        before = [k for k, n in runs for _ in range(n)]
    got = [r["label"] for r in queries.QUERIES["short_segments_removed"](spark, DATA).orderBy("bin").collect()]
    assert got == before


def test_states_by_means_are_settled(spark):
    z = binning.zscored(queries.signal(spark, DATA)).toPandas().pivot(index="bin", columns="cluster", values="z").sort_index().to_numpy(float)
    label = np.array([r["label"] for r in queries.QUERIES["kmeans_states"](spark, DATA).orderBy("bin").collect()])
    centre = np.array([z[label == k].mean(0) for k in range(4)])
    d = ((z[:, None] - centre) ** 2).sum(2)
    assert set(label) == set(range(4)) and (d.argmin(1) == label).all()
    rng = np.random.default_rng(0)
    for _ in range(20):  # no plain run from random rows ends up clearly better
        c = z[rng.choice(len(z), 4, replace=False)]
        for _ in range(100):
            own = ((z[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([z[own == k].mean(0) if (own == k).any() else c[k] for k in range(4)])
        assert d.min(1).sum() <= 1.1 * ((z[:, None] - c) ** 2).sum(2).min(1).sum()


def test_silhouette_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v, label = rng.normal(0, 1, (300, 3)) + np.arange(300)[:, None] % 3, np.arange(300) % 3
    rows = spark.createDataFrame([(i, int(k), x.tolist()) for i, (k, x) in enumerate(zip(label, v))], "id long, label int, v array<double>")
    d = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    a = np.array([d[i, label == label[i]].sum() / 99 for i in range(300)])
    b = np.array([min(d[i, label == k].mean() for k in range(3) if k != label[i]) for i in range(300)])
    want = pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-7)
    assert evaluation.silhouette(rows).first()["silhouette"] == want
    monkeypatch.setattr(evaluation, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(evaluation, "PIECE", 1000)
    assert evaluation.silhouette(rows).first()["silhouette"] == want
    assert evaluation.silhouette(rows.limit(0)).first()["silhouette"] is None


def test_reports_name_every_reason(spark):
    values = [0.0, 0.1, 0.1004, 0.1008, 0.3, 0.5, 0.9]
    rows = [(5.0, 1, v, "stable" if v in (0.1004, 0.5) else None, None if v == 0.3 else v, [v, v]) for v in values]
    c = spark.createDataFrame(rows, "rep double, focus_count int, value double, stability string, residual double, rates array<double>")
    got = {r["value"]: r["filter_reason"] for r in candidates.sweep_report(c).collect()}
    assert got == {0.0: "trivial_zero", 0.1: "duplicate_threshold", 0.1004: None, 0.1008: "duplicate_threshold", 0.3: "max_fixpoints", 0.5: None, 0.9: None}
    assert candidates.sweep_report(c.limit(0)).count() == 0
    assert {r["included"] for r in candidates.sweep_report(c, most=9).where("value in (0.3, 0.9)").collect()} == {True}


def test_sweeps_solve_what_is_missing(spark, tmp_path):
    at, asked = str(tmp_path / "curves"), []

    def solve(todo):
        asked.append(sorted(r["k"] for r in todo.collect()))
        point = todo.withColumn("x", F.explode(F.array(F.lit(0.0), F.lit(1.0))))
        return point.withColumn("y", F.when((F.col("k") == 3.0) & (F.col("x") == 1.0), F.lit(float("nan"))).otherwise(F.col("k") * F.col("x")))

    tasks = lambda *k: spark.createDataFrame([(float(v),) for v in k], "k double")
    have = lambda df: Counter(r["k"] for r in df.collect())
    assert have(config.swept(tasks(1, 3), solve, at, ["k"])) == {1.0: 2}
    assert have(config.swept(tasks(1, 2, 3), solve, at, ["k"])) == {1.0: 2, 2.0: 2}
    assert have(config.swept(tasks(2), solve, at, ["k"], overwrite=True)) == {2.0: 2}
    assert asked == [[1.0, 3.0], [2.0, 3.0], [2.0]]

"""Values over runs in stretches, panes, blocks and digits against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions.quantiles import exact_quantiles
from eventloom.operators import edges, intervals, kernels, segmentation, sequence, states, statistics


def labels_of(rng, n, kinds=3, stay=0.6):
    out = [rng.randrange(kinds)]
    while len(out) < n:
        out.append(out[-1] if rng.random() < stay else rng.randrange(kinds))
    return out


def frame(spark, runs, schema="run_id string, bin long, label long"):
    return spark.createDataFrame([(r, b, v) for r, own in runs.items() for b, v in own], schema).repartition(3)


def told(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["run_id"], []).append(tuple(r[c] for c in columns))
    return {k: sorted(v, key=lambda t: t[0]) for k, v in out.items()}


@pytest.fixture(scope="module")
def series():
    rng = random.Random(1)
    runs = {"a": list(enumerate(labels_of(rng, 60))), "same": [(b, 1) for b in range(40)], "null": [(b, None if b % 7 < 4 else 1) for b in range(25)], "one": [(5, 2)]}
    runs["gaps"] = [(b * b, v) for b, v in enumerate(labels_of(rng, 20))] + [(10**12, 0)]  # an outlier is a stretch of its own
    return runs


@pytest.mark.parametrize("width", [1, 3, 7, 4096])
def test_run_lengths_join_over_stretches(spark, series, width):
    got = told(sequence.run_lengths(frame(spark, series), "label", ["run_id"], width=width), "first", "last", "state")
    for run, own in series.items():
        want = [(g[0][0], g[-1][0], v) for v, g in ((v, list(g)) for v, g in itertools.groupby(own, key=lambda x: x[1]))]
        assert got[run] == want


@pytest.mark.parametrize("width", [1, 4, 4096])
def test_neighbours_and_running_values(spark, series, width):
    df = frame(spark, series)
    before = told(sequence.neighbour(df, "bin", "label", "v", width=width), "bin", "v")
    after = told(sequence.neighbour(df, "bin", "label", "v", ahead=True, width=width), "bin", "v")
    known = told(sequence.last_known(df, "bin", F.col("label"), "v", width=width), "bin", "v")
    total = told(sequence.total_so_far(df, "bin", F.coalesce("label", F.lit(0)), "v", width=width), "bin", "v")
    for run, own in series.items():
        values = [v for _, v in own]
        assert [v for _, v in before[run]] == [None, *values[:-1]] and [v for _, v in after[run]] == [*values[1:], None]
        assert [v for _, v in known[run]] == [next((u for u in reversed(values[: k + 1]) if u is not None), None) for k in range(len(values))]
        assert [v for _, v in total[run]] == [sum(u or 0 for u in values[: k + 1]) for k in range(len(values))]


def test_short_runs_go_as_in_the_whole_run(spark):
    rng = random.Random(2)
    runs = {f"r{k}": list(enumerate(labels_of(rng, rng.randint(1, 40), 4, rng.choice([0.2, 0.6, 0.9])))) for k in range(40)}
    df = frame(spark, runs)
    for strategy, least in (("previous", 3), ("next", 3), ("next", 2)):
        got = told(states.short_removed(df, least, strategy), "bin", "label")
        for run, own in runs.items():
            want = segmentation.remove_short(np.array([v for _, v in own]), least, strategy).tolist()
            assert [v for _, v in got[run]] == want, (strategy, own)


def test_median_filter_and_lags_over_halos(spark, monkeypatch):
    monkeypatch.setattr(sequence, "WIDTH", 4)
    rng = random.Random(3)
    runs = {f"r{k}": list(enumerate(labels_of(rng, n, 5, 0.3))) for k, n in enumerate((1, 2, 5, 50))}
    for width in (3, 4, 9):
        half = width // 2
        got = told(states.median_filter(frame(spark, runs), width), "bin", "label")
        for run, own in runs.items():
            v = np.pad([x for _, x in own], half, mode="edge")
            assert [x for _, x in got[run]] == [int(np.median(v[k : k + 2 * half + 1])) for k in range(len(own))]
    signal = frame(spark, runs, "run_id string, bin long, x long").withColumn("cluster", F.lit("c"))
    got = told(kernels.lag_features(signal, 2), "bin", "window")
    for run, own in runs.items():
        v = np.pad([x for _, x in own], 2, mode="edge")
        assert [w for _, w in got[run]] == [v[k : k + 5].tolist() for k in range(len(own))]


@pytest.mark.parametrize("edge", ["zero", "nearest"])
def test_convolution_by_blocks(spark, edge):
    rng = np.random.default_rng(4)
    kernel = [0.1, 0.5, 1.0, 0.25, 0.05]
    runs = {f"r{n}": [(b - 7, float(v)) for b, v in enumerate(rng.normal(size=n))] for n in (1, 3, 50)}
    got = told(kernels.convolved(frame(spark, runs, "run_id string, bin long, x double"), "x", kernel, ["run_id"], edge, width=9), "bin", "smooth")
    for run, own in runs.items():
        x = np.pad([v for _, v in own], 2, mode="constant" if edge == "zero" else "edge")
        want = np.convolve(x, kernel, "valid")
        assert [b for b, _ in got[run]] == [b for b, _ in own]
        assert [v for _, v in got[run]] == pytest.approx(want.tolist())


@pytest.mark.parametrize("width,step", [(5.0, 1.0), (4.0, 6.0), (7.5, 2.5), (3.0, 2.0), (200.0, 1.0)])
def test_windows_from_panes(spark, width, step):
    rng = random.Random(5)
    events = [("r", rng.randrange(4), round(rng.uniform(0, 60) * 4) / 4) for _ in range(150)] + [("q", 1, 59.0)]
    spikes = spark.createDataFrame(events, "run_id string, unit long, t double")
    got = {(r["run_id"], r["k"]): (r["n"], r["n_units"], r["time"]) for r in intervals.time_resolved_counts(spikes, 2.0, 60.0, width, step).collect()}
    want = {(r["run_id"], r["k"]): (r["n"], r["u"], r["time"]) for r in intervals.time_resolved(spikes, 2.0, 60.0, width, step, [F.count(F.lit(1)).alias("n"), F.countDistinct("unit").alias("u")]).collect()}
    assert got == want


def test_quantiles_by_digits(spark):
    rng = random.Random(6)
    groups = {"many": [rng.gauss(0, 1) * 10 ** rng.randint(-300, 300) for _ in range(999)], "ties": [float(rng.randrange(3)) for _ in range(200)], "few": [-0.0, 0.0, None, -1.5, math.inf, -math.inf], "none": [None, None], "one": [4.25]}
    rows = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own], "g string, x double").repartition(5)
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.951, "e": 1.0}
    got = {r["g"]: [r[n] for n in shares] for r in exact_quantiles(rows, ["g"], "x", shares).collect()}
    want = {r["g"]: list(r["q"] or [None] * 5) for r in rows.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares.values()))).alias("q")).collect()}
    assert got == want and got["none"] == [None] * 5


def test_pairs_by_blocks(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 11)) + 100
    x[:, 3] = 0.1  # constant
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 9] = np.nan
    rows = [("r", t, u, None if np.isnan(x[t, u]) else float(x[t, u])) for t in range(40) for u in range(11)]
    got = {(r["a"], r["b"]): (r["r"], r["cov"]) for r in statistics.all_pair_correlations(spark.createDataFrame(rows, "run_id string, t long, unit long, value double"), 4, 16).collect()}
    for a, b in itertools.combinations(range(11), 2):
        both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        if not both.any():
            assert (a, b) not in got
            continue
        p, q = x[both, a], x[both, b]
        assert got[a, b][1] == pytest.approx(np.cov(p, q, ddof=0)[0, 1], abs=1e-9)
        assert got[a, b][0] is None if 3 in (a, b) else got[a, b][0] == pytest.approx(np.corrcoef(p, q)[0, 1])


def test_fields_by_blocks(spark):
    rng = random.Random(8)
    e = [(rng.randrange(30), 5 if rng.random() < 0.4 else rng.randrange(25), rng.choice([1.0, -1.0, 0.5])) for _ in range(300)]  # a hub
    a = [(rng.randrange(20), rng.randrange(25)) for _ in range(60)]
    want: dict = {}
    for post, pre, w in e:
        for t, unit in a:
            if unit == pre:
                want[t, post] = want.get((t, post), 0.0) + w
    got = edges.fields(spark.createDataFrame(e, "post long, pre long, w double"), spark.createDataFrame(a, "t long, unit long"), 7, 6)
    assert {(r["t"], r["post"]): r["h"] for r in got.collect()} == pytest.approx(want)
    assert edges.fields(spark.createDataFrame(e, "post long, pre long, w double"), spark.createDataFrame([], "t long, unit long")).count() == 0


def test_knots_sent_or_merged(spark, monkeypatch):
    rng = random.Random(9)
    knots = [(r, float(x), float(rng.randrange(9))) for r in "ab" for x in sorted(rng.sample(range(40), 12))]
    events = [(rng.choice("abc"), k, rng.choice([float(rng.randrange(40)), rng.uniform(-3, 43)])) for k in range(300)]
    e = spark.createDataFrame(events, "run_id string, n long, t double")
    k = spark.createDataFrame(knots, "run_id string, x double, y double")
    sent = {r["n"]: r["y"] for r in intervals.as_of_map(e, k).collect()}
    for run, n, t in events:
        x, y = ([v for r, *v in knots if r == run] and np.array([v for r, *v in knots if r == run]).T) if run != "c" else ([], [])
        want = None if not len(x) or t < x[0] or t > x[-1] else float(np.interp(t, x, y))
        assert sent[n] == (want if want is None else pytest.approx(want))
    monkeypatch.setattr(intervals, "KNOTS", 1)
    assert {r["n"]: r["y"] for r in intervals.as_of_map(e, k).collect()} == pytest.approx(sent)


def test_values_far_from_the_others_leave_them_spread(spark):
    rng = random.Random(10)
    rows = [("r", rng.uniform(0, 1)) for _ in range(2000)] + [("r", 1e9), ("r", -1e15)] + [("same", 3.0)] * 50 + [("two", v) for v in (1.0, 2.0)]
    df = spark.createDataFrame(rows, "run_id string, t double")
    cut = sequence.in_pieces(df, "t", pieces=32, refine=2)  # two scales
    sizes = {r["run_id"]: r["most"] for r in cut.groupBy("run_id", "piece").count().groupBy("run_id").agg(F.max("count").alias("most")).collect()}
    assert sizes["r"] < 4 * 2002 / 32 + 200 and sizes["same"] == 50 and sizes["two"] == 1
    own = sorted((r["t"], r["piece"]) for r in cut.where("run_id = 'r'").collect())
    assert all(p <= q for (_, p), (_, q) in zip(own, own[1:]))
    got = sequence.numbered(df, ["t"], pieces=32).where("run_id = 'r'").collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["t"])] == list(range(2002))

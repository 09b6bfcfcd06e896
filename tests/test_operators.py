"""Small fixtures with results worked out by hand."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import numeric
from eventloom.operators import binning, edges, evaluation, intervals, kernels, meanfield, segmentation, states, statistics
from eventloom.plans import config
from eventloom.sources import tables
from eventloom.streaming import counts as streaming


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def labels(spark, values, name="label"):
    return frame(spark, [("r", k, v) for k, v in enumerate(values)], f"run_id string, bin long, {name} int")


def active(spark, values):
    return frame(spark, [("r", 1, k, v) for k, v in enumerate(values)], "run_id string, cluster int, bin long, active int")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_fine_grid_drops_last_half_bin(spark):
    s = frame(spark, [("r", 0, t) for t in (2.4, 2.5, 2.6, 2.99)], "run_id string, unit long, t double")
    out = binning.binned(s, s.select("run_id", "unit").distinct(), 0.0, 3.0, 1.0)
    assert column(out, "n", "bin") == [0, 0, 2]


def test_silent_units_count_as_zero(spark):
    s = frame(spark, [("r", 0, 1.0), ("r", 0, 2.0), ("r", 2, 1.5)], "run_id string, unit long, t double")
    u = frame(spark, [("r", k) for k in range(3)], "run_id string, unit long")
    assert intervals.fano(s, u, 0, 3).first()["ff"] == pytest.approx((2 / 3) / 1.0)
    assert [r["unit"] for r in binning.missing_units(s, u).collect()] == [1]
    assert column(binning.trains(s, u), "times", "unit") == [[1.0, 2.0], [], [1.5]]


def test_hysteresis(spark):
    x = frame(spark, [("r", 1, k, float(v)) for k, v in enumerate((0, 5, 9, 6, 4, 3, 9))], "run_id string, cluster int, bin long, x double")
    assert column(binning.hysteresis(x, 4.0, 8.0), "active", "bin") == [0, 0, 1, 1, 1, 0, 1]


def test_runs_and_dwell(spark):
    segs = states.segments(labels(spark, (0, 0, 1, 1, 1, 0, 2, 2)), dt=2.0)
    assert {r["state"]: r["dwells"] for r in states.dwell_times(segs).collect()} == {0: [4.0, 2.0], 1: [6.0], 2: [4.0]}
    p = {(r["src"], r["dst"]): r["p"] for r in states.transitions(segs).collect()}
    assert p[0, 1] == 0.5 and p[0, 2] == 0.5 and p[1, 0] == 1.0 and p[2, 0] == 0.0 and len(p) == 9


def test_gap_filling_and_cleaning(spark):
    assert column(states.fill_gaps(active(spark, (1, 0, 1, 1, 0, 0, 0, 1, 0)), 2), "active", "bin") == [1, 1, 1, 1, 0, 0, 0, 1, 0]
    assert column(states.drop_short(active(spark, (1, 0, 0, 1, 1, 0)), 1, 2), "active", "bin") == [0, 0, 0, 1, 1, 0]


def test_median_filter_repeats_ends(spark):
    values = [3, 1, 1, 5, 2, 2, 9]
    padded = [values[0]] * 2 + values + [values[-1]] * 2
    want = [int(np.median(padded[k : k + 5])) for k in range(len(values))]
    assert column(states.median_filter(labels(spark, values), 5), "label", "bin") == want


def test_short_segments_stop_at_a_single_run():
    assert segmentation.remove_short(np.array([1, 1]), 3).tolist() == [1, 1]
    assert segmentation.remove_short(np.array([0, 0, 0, 1, 2, 2, 2]), 2).tolist() == [0, 0, 0, 0, 2, 2, 2]
    assert segmentation.remove_short(np.array([0, 0, 0, 1, 2, 2, 2]), 2, "next").tolist() == [0, 0, 0, 2, 2, 2, 2]
    x = np.array([0, 0, 0, 4.8, 5, 5, 5])[:, None]
    assert segmentation.remove_short(np.array([0, 0, 0, 1, 2, 2, 2]), 2, "nearest", x).tolist() == [0, 0, 0, 2, 2, 2, 2]


def brute_segments(y, penalty, least):
    best = {0: (-penalty, [])}
    cost = segmentation.SquaredCost(y)
    for e in range(1, len(y) + 1):
        own = [(best[a][0] + float(cost(np.array(a), np.array(e))) + penalty, best[a][1] + [e]) for a in best if e - a >= least]
        if own:
            best[e] = min(own)
    return best[len(y)]


@pytest.mark.parametrize("seed", range(5))
def test_pelt_is_exact(seed):
    rng = np.random.default_rng(seed)
    y = np.repeat(rng.normal(0, 3, 6), rng.integers(3, 9, 6))[:, None] + rng.normal(0, 0.5, 1)
    y = y + rng.normal(0, 0.4, y.shape)
    for least in (1, 2, 3):
        ends, c = segmentation.pelt(y, 2.0, least), segmentation.SquaredCost(y)
        total = sum(float(c(np.array(a), np.array(b))) + 2.0 for a, b in zip([0, *ends[:-1]], ends)) - 2.0
        assert total == pytest.approx(brute_segments(y, 2.0, least)[0])


def test_refine_moves_the_boundary():
    y = np.array([0.0] * 13 + [1.0] * 17)[:, None]
    assert segmentation.refine(y, [10, 30], 5) == [13, 30]
    assert segmentation.binary_segmentation(y, 0.5) == [13, 30]
    assert 13 in segmentation.moving_window(y, 5, 0.5)
    assert segmentation.merge_similar(y, [5, 13, 30], 0.5, 2) == [13, 30]


def test_active_sets_are_recovered():
    rng = np.random.default_rng(3)
    masks = np.zeros((300, 10), bool)
    for row, k in zip(masks, rng.choice(4, 300, p=(0.2, 0.4, 0.3, 0.1))):
        row[rng.choice(10, k, replace=False)] = True
    x = np.where(masks, 0.8, 0.1) + rng.normal(0, 0.03, masks.shape)
    found, p, _ = segmentation.active_sets(x, np.ones(300), 3)
    assert (found == masks).mean() > 0.99
    smooth = segmentation.smooth_sets(x[:40], np.ones(40), found[:40], p, 3, 0.0, 0.0)
    assert (smooth == masks[:40]).mean() > 0.98


def test_mixtures_recover_blocks():
    rng = np.random.default_rng(0)
    truth = np.repeat([0, 1, 0, 1], 40)
    y = truth[:, None] * 4.0 + rng.normal(0, 0.5, (160, 2))
    for found in (segmentation.hmm_gaussian(y, 2)[0], segmentation.lloyd(y, 2)[0]):
        assert max((found == truth).mean(), (found != truth).mean()) > 0.97


@pytest.mark.parametrize("seed", range(6))
def test_assignment_is_optimal(seed):
    gain = np.random.default_rng(seed).integers(0, 30, (4, 4 if seed % 2 else 5))
    got = sum(gain[i, j] for i, j in evaluation.assignment(gain))
    assert got == max(sum(gain[i, p[i]] for i in range(4)) for p in permutations(range(gain.shape[1]), 4))


def test_matched_accuracy(spark):
    x = frame(spark, [("r", t, p) for t, p in ((0, 1), (0, 1), (1, 0), (1, 1), (2, 2))], "run_id string, t int, p int")
    assert [tuple(r) for r in evaluation.matched_accuracy(evaluation.contingency(x, "t", "p")).collect()] == [("r", 0.8)]


@pytest.mark.parametrize("tolerance, want", [(0, (0, 0, 0)), (1, (0.5, 0.5, 0.5)), (2, (0.5, 0.5, 0.5))])
def test_boundaries(spark, tolerance, want):
    b = lambda v: frame(spark, [("r", x) for x in v], "run_id string, bin long")
    r = evaluation.boundary_scores(b((5, 10)), b((6, 20)), tolerance).first()
    assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(want)


def test_variance_parts(spark):
    x = frame(spark, [("r", u, t, float(v)) for t, row in enumerate(((1, 3), (3, 5))) for u, v in enumerate(row)], "run_id string, unit long, t long, value double")
    r = statistics.variance_parts(x, ["run_id"]).first()
    assert (r["mean"], r["temporal"], r["quenched"], r["total"]) == (3.0, 1.0, 1.0, 2.0)


def test_constant_traces_have_no_correlation(spark):
    x = frame(spark, [("r", t, u, float(v)) for u, row in enumerate(((1, 2, 3), (5, 5, 5), (2, 4, 6))) for t, v in enumerate(row)], "run_id string, t long, unit long, value double")
    p = frame(spark, [("s", 0, 1), ("s", 0, 2)], "scope string, a long, b long")
    assert {r["b"]: r["r"] for r in statistics.pair_correlations(x, p).collect()} == {1: None, 2: pytest.approx(1.0)}


def test_replay(spark):
    init = frame(spark, [("r", 0, 0), ("r", 1, 0)], "run_id string, unit long, s int")
    log = frame(spark, [("r", 0, 0, 1), ("r", 1, 1, 1), ("r", 2, 0, -1)], "run_id string, step long, unit long, delta int")
    out = {(r["unit"], r["step"]): r["s"] for r in states.replayed(init, log, 1, 3).collect()}
    assert out == {(0, 0): 1, (0, 1): 1, (0, 2): 0, (1, 0): 0, (1, 1): 1, (1, 2): 1}


def test_multapses_count_twice(spark):
    e = frame(spark, [(0, 2, 1.0), (0, 3, 2.0), (1, 3, 1.0)], "post long, pre long, w double")
    u = lambda ids, p: frame(spark, [(i, p) for i in ids], "unit long, pop long")
    r = edges.block_statistics(e, u((0, 1), 0), u((2, 3), 1)).first()
    assert (r["synapses"], r["indegree_mean"], r["occupied_mean"], r["entry_mean"], r["density"]) == (4.0, 2.0, 1.5, 1.0, 0.75)


def test_same_time_events_keep_guards(spark):
    s = frame(spark, [("r", 0, 1.0)] * 3, "run_id string, unit long, t double")
    r = intervals.variability(s, min_pairs=1).first()
    assert r["cv2"] is None and r["cv_two"] is None and r["n_isi"] == 2


def test_windows_follow_their_conventions(spark):
    s = frame(spark, [("r", 0, float(t)) for t in range(11)], "run_id string, unit long, t double")
    left = {r["k"]: r["n"] for r in intervals.windowed(s, 0, 10, 4, 2).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    right = {r["k"]: r["n"] for r in intervals.windowed(s, 0, 10, 4, 2, "right").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert left == {0: 4, 1: 4, 2: 4, 3: 4} and right == {0: 4, 1: 4, 2: 4}


def test_as_of_map_is_null_outside(spark):
    e = frame(spark, [("r", t) for t in (-1.0, 0.0, 0.5, 2.0, 3.0)], "run_id string, t double")
    k = frame(spark, [("r", 0.0, 0.0), ("r", 1.0, 10.0), ("r", 2.0, 30.0)], "run_id string, x double, y double")
    assert column(intervals.as_of_map(e, k), "y", "t") == [None, 0.0, 5.0, 30.0, None]


def test_gamma_trains_are_regular(spark):
    u = frame(spark, [("g", 0), ("g", 1)], "run_id string, unit long")
    r = intervals.pooled_cv2(intervals.gamma_trains(u, 50.0, 4.0, 60_000.0, 1)).first()
    assert r["cv2"] == pytest.approx(0.25, abs=0.03)


def test_kernels_have_unit_area():
    assert sum(kernels.gaussian(2.0, 0.5)) * 0.5 == pytest.approx(1) and sum(kernels.triangular(2.0, 1.0)) == pytest.approx(1)
    with pytest.raises(ValueError):
        kernels.gaussian(0, 1)


def test_fixed_points_solve_the_equations(spark):
    p = config.sweep(spark, {"kappa": [4.0]}).withColumns({"param_id": F.lit("a"), "q": F.lit(3), "j": F.lit(2.0), "bias": F.lit(-1.0)})
    points = meanfield.crossings(meanfield.response_curves(p, 201)).collect()
    assert points
    mean, var = meanfield.connectivity(3, 2.0, 4.0)
    for r in points:
        assert 0 <= r["value"] <= 1
        full, residual = meanfield.solve(mean, var, -1.0, np.full(3, 0.1), r["value"])
        assert residual < 5e-4


def test_branches_keep_apart(spark):
    rows = [("p", float(x), v) for x in range(4) for v in (0.1 * x, 1.0 - 0.1 * x)]
    out = meanfield.branches(frame(spark, rows, "param_id string, x double, value double"), 0.3)
    assert out.select("branch").distinct().count() == 2


def test_config():
    assert config.values("0:1:0.25,3,3") == [0, 0.25, 0.5, 0.75, 1.0, 3.0]
    tree = config.merged({"a": {"b": 1, "c": 2}}, config.overrides(["a.b=5", "x=name"]))
    assert tree == {"a": {"b": 5, "c": 2}, "x": "name"}
    assert config.tag({"a": 1, "b": 2}) == config.tag({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        config.values("0:1:-1")


def test_npz_sources(spark, tmp_path):
    np.savez(tmp_path / "a.npz", spiketimes=np.array([[1.0, np.nan, 2.0], [0, 1, 1]]), rates=np.ones((2, 2)))
    kind, s = tables.npz_trace(spark, str(tmp_path / "a.npz"), "r")
    assert kind == "snn" and s.count() == 2
    e = tables.csr_edges(spark, [1.0, 2.0, 3.0], [0, 2, 1], [0, 2, 2, 3])
    assert sorted(map(tuple, e.collect())) == [(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.0)]
    tables.save_result({"edges": e}, str(tmp_path / "out"), "m")
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == 3


def test_labels_from_breaks(spark):
    b = frame(spark, [("r", "2; 4,x,99")], "run_id string, breaks string")
    assert column(binning.segmentation_labels(b, 6), "label", "bin") == [0, 0, 1, 1, 2, 2]


def test_numeric_guards(spark):
    r = spark.range(1).select(numeric.div(F.lit(1.0), F.lit(0.0)).alias("a"), numeric.known(F.lit(float("nan"))).alias("b"), numeric.fisher_z(F.lit(1.0)).alias("c")).first()
    assert r["a"] is None and r["b"] is None and r["c"] == pytest.approx(np.arctanh(1 - 1e-6))
    assert numeric.log_comb(5, 2) == pytest.approx(np.log(10))


def test_streaming_counts(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = streaming.with_event_time(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    for name, out, mode in (("tumble", streaming.tumbling(stream, "1 day", ["event_type"]), "complete"), ("bursts", streaming.bursts(stream, "2 hours", ["user_id"]), "append"), ("onsets", streaming.onsets(stream, 100.0, 20.0), "append")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() > 0
    assert spark.table("tumble").agg(F.sum("n")).first()[0] == 1000


def test_streams_with_state_equal_whole_tables(spark, tmp_path):
    data = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    days = data.select(F.date_trunc("day", "ts").alias("d")).distinct().orderBy("d").collect()
    middle = days[len(days) // 2]["d"]
    for k, part in enumerate((data.where(F.col("ts") < middle), data.where(F.col("ts") >= middle))):  # two batches, so states carry over
        part.coalesce(1).write.parquet(str(tmp_path / "parts" / str(k)))
    (tmp_path / "in").mkdir()
    for k in range(2):
        next((tmp_path / "parts" / str(k)).glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
    forever = 10**11
    stream = lambda: streaming.with_event_time(spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late="60 days")
    for name, out in (("onset", streaming.onsets(stream(), 100.0, 20.0, forever)), ("state", streaming.hysteresis(stream(), 100.0, 20.0, forever)), ("isi", streaming.interval_statistics(stream(), forever))):
        q = out.writeStream.format("memory").queryName(f"s_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    rows = sorted((r["user_id"], r["ts"], r["value"]) for r in data.withColumn("ts", F.col("ts").cast("timestamp")).collect())
    onset, state, isi, on, times = [], [], [], {}, {}
    for unit, ts, v in rows:
        before = on.get(unit, False)
        on[unit] = v >= 100.0 or (before and not v < 20.0)
        state.append((unit, ts, int(on[unit])))
        onset += [(unit, ts)] if on[unit] and not before else []
        times.setdefault(unit, []).append(ts.timestamp())
        step = [b - a for a, b in zip(times[unit], times[unit][1:])]
        if len(step) >= 2 and sum(step):
            mean = sum(step) / len(step)
            isi.append((unit, ts, len(step), pytest.approx(mean), pytest.approx(sum((s - mean) ** 2 for s in step) / len(step) / mean**2, abs=1e-6)))
    got = lambda name: sorted(tuple(r) for r in spark.table(f"s_{name}").collect())
    assert got("state") == state and got("onset") == onset and got("isi") == isi


def test_sampled_pairs_are_all_pairs_or_most(spark):
    sizes = {0: 1, 1: 2, 2: 7, 3: 40, 4: 1}
    group = [g for g, n in sizes.items() for _ in range(n)] + [None, None]
    units = spark.createDataFrame(list(enumerate(group)), "unit long, group_id int")
    want = {"within": set(), "across": set()}
    for a in range(len(group)):
        for b in range(a + 1, len(group)):
            want["within" if group[a] is not None and group[a] == group[b] else "across"].add((a, b))
    for most in (5, 100, 10_000):
        got = [(r["scope"], r["a"], r["b"]) for r in statistics.sampled_pairs(units, most).collect()]
        assert len(got) == len(set(got))
        for scope, all_pairs in want.items():
            own = {(a, b) for s, a, b in got if s == scope}
            assert own <= all_pairs and len(own) == min(most, len(all_pairs))
    pairs = spark.range(2000).select(F.col("id").alias("unit"), F.expr("id div 2").alias("group_id"))
    assert statistics.sampled_pairs(pairs, 300).where("scope = 'within' and b = a + 1").count() == 300

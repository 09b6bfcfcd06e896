"""Queries whose rows once grew beyond their tables: results against plain loops, and what their plans make."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.operators import binning, long_hmm, long_segments, sequence, statistics


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def quantile(values, q):
    values, at = sorted(values), q * (len(values) - 1)
    low = math.floor(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def test_bootstrap_makes_no_draws_and_equals_them(spark):
    """Groups that share divisors with the samples' steps, unknown values (ranked last) and equal ones."""
    sizes = {"a": 30, "b": 7, "c": 104730 // 15, "d": 1, "half": 40, "none": 3}
    rows = [(k, None if k == "none" or k == "half" and i % 2 else float((i * 37) % 101 * 3 + i % 5)) for k, n in sizes.items() for i in range(n)]
    out = statistics.bootstrap(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", 50)
    assert "sequence(0" not in plan(out)  # a row per draw, whose size Spark doesn't see, was sent to every task
    got = {r["k"]: r for r in out.collect()}
    assert got.keys() == sizes.keys()
    for k, n in sizes.items():
        own = sorted(v for key, v in rows if key == k and v is not None)
        if not own:
            assert (got[k]["n"], got[k]["mean"], got[k]["low"], got[k]["high"]) == (n, None, None, None)
            continue
        ranked, means = np.array(own + [np.nan] * (n - len(own))), []
        for s in range(1, 51):
            drawn = ranked[(s * 7919 + np.arange(n) * (104729 + s)) % n]
            if not np.isnan(drawn).all():
                means.append(float(np.nanmean(drawn)))
        assert got[k]["n"] == n and got[k]["mean"] == pytest.approx(np.mean(own))
        assert (got[k]["low"], got[k]["high"]) == (pytest.approx(quantile(means, 0.025)), pytest.approx(quantile(means, 0.975)))


@pytest.mark.parametrize("cost", ["l2", "l1"])
def test_penalty_grid_makes_no_row_per_bin(spark, cost):
    rng = np.random.default_rng(5)
    y = np.repeat(rng.normal(size=(8, 2)) * 4, 25, axis=0) + rng.normal(size=(200, 2)) + 1e6
    signal = spark.createDataFrame([("a", c, b + 3, float(y[b, c])) for b in range(200) for c in range(2)], "run_id string, cluster int, bin long, x double")
    out = long_segments.long_penalty_grid(signal, [40.0], cost=cost, stretch=100)
    assert "sequence(" not in plan(out)  # bins of the segments, whose number Spark doesn't see, were sent to every task
    for r in out.collect():
        segs = [(s["start_bin"] - 3, s["stop_bin"] - 3) for s in long_segments.long_changepoints(signal, r["penalty"], cost=cost, stretch=100).collect()]
        middle = np.mean if cost == "l2" else np.median
        off = sum((np.abs(y[a:b] - middle(y[a:b], axis=0)) ** (2 if cost == "l2" else 1)).sum() for a, b in segs)
        assert r["segments"] == len(segs) and r["cost"] == pytest.approx(off, abs=1e-6)


def test_totals_of_bins_are_the_sums_over_units(spark):
    """Events of unknown units and outside of the limits don't count, repeated units do twice."""
    spikes = spark.createDataFrame([("r", u, t) for u, t in [(1, 0.0), (1, 0.4), (1, 2.5), (2, 2.5), (2, 7.0), (9, 1.0), (3, -1.0), (4, 2.5)]] + [("q", 1, 1.0)], "run_id string, unit long, t double")
    units = spark.createDataFrame([("r", u) for u in (1, 2, 3, 4, 4, 5)] + [("q", 1), ("silent", 1)], "run_id string, unit long")
    for t1, dt in ((4.0, 1.0), (8.0, 0.5), (9.0, 3.0)):
        want = {}
        for r in binning.binned(spikes, units, 0.0, t1, dt).collect():
            key = (r["run_id"], r["bin"], r["time"])
            want[key] = (want.get(key, (0, 0))[0] + r["n"], want.get(key, (0, 0))[1] + 1)
        got = {(r["run_id"], r["bin"], r["time"]): (r["n"], r["units"]) for r in binning.binned_totals(spikes, units, 0.0, t1, dt).collect()}
        assert got == want


def test_fine_grid_makes_no_row_per_unit_and_bin(spark):
    from eventloom.plans import queries

    df = queries.QUERIES["fine_grid_counts"](spark, "/root/testdata/sf0.001")
    df.collect()
    tree, most = [df._jdf.queryExecution().executedPlan()], 0
    while tree:
        node = tree.pop()
        node = node.finalPhysicalPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else node
        if node.nodeName() == "Generate":
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        tree += [children.apply(i) for i in range(children.size())] + ([node.plan()] if node.nodeName().endswith("QueryStage") else [])
    days = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr("datediff(max(o_orderdate), min(o_orderdate)) + 1 AS n").first()["n"]
    assert most == days


def test_hmm_steps_through_stretches_side_by_side(spark):
    """300 stretches of one length and a shorter one, of two runs: two series of steps, with each stretch's own sums and ends."""
    rng, starts, k, q = np.random.default_rng(8), 2, 3, 2
    shape, blobs = long_hmm.Model(starts, k, q), {}
    for run in "ab":
        chances = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s) + 0.1)
        p = {"done": np.zeros(starts), "ll": np.zeros(starts), "start": chances(starts, k), "move": chances(starts, k, k), "m": rng.normal(size=(starts, k, q)), "v": rng.random((starts, k, q)) + 0.5}
        blobs[run] = shape.write(p | {f"used_{n}": p[n] for n in ("start", "move", "m", "v")})
    rows = [("ab"[i % 2], i // 2, 9 if i < 300 else 4) for i in range(301)]
    frame = pd.DataFrame([(r, s, n, q, rng.normal(size=(n, q)).tobytes(), blobs[r]) for r, s, n in rows], columns=["run_id", "stretch", "n", "q", "y", "model"])
    parts = list(long_hmm.side_by_side(frame, starts, k))
    assert len(parts) == 2 and sum(len(some) for some, *_ in parts) == 301
    for some, y, p, head in parts:
        b, top = long_hmm.scaled_chances("gaussian", y, p)
        ones, before = np.ones((len(y), starts, k)), p["start"]
        sums, ends = long_hmm.stretch_sums(y, b, top, p, before, ones, head), long_hmm.stretch_matrices(b, p["move"], head)
        for i in {0, len(y) // 2, len(y) - 1}:
            own = shape.read(some["model"].iloc[i])
            for s in range(starts):
                a, total, ll = own["start"][s], np.eye(k), 0.0
                for t in range(y.shape[1]):
                    if t or not head[i]:
                        a, total = a @ own["move"][s], total @ own["move"][s]
                    chance = np.exp(-0.5 * ((y[i, t] - own["m"][s]) ** 2 / own["v"][s] + np.log(2 * np.pi * own["v"][s])).sum(1))
                    a, total = a * chance, total * chance
                    ll, a = ll + np.log(a.sum()), a / a.sum()
                assert sums[i, s, 0] == pytest.approx(ll) and ends[i, s] == pytest.approx(total / total.sum())
                assert sums[i, s, 1 + k + k * k :][:k].sum() == pytest.approx(y.shape[1])


def test_stretches_of_alike_values_are_dealt_over_tasks(spark):
    """They take few bytes, for which all of them came to one task, and so did every round."""
    signal = spark.range(4000).selectExpr("'a' AS run_id", "id AS bin", "explode(array('x', 'y')) AS cluster").withColumn("x", F.lit(1.0))
    pack = long_hmm.packed(signal, "x", 50)
    held = pack.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert sum(r["count"] for r in held) == 80 and len(held) == 4
    first = pack.orderBy("stretch").first()
    assert (first["first"], first["n"], first["q"]) == (0, 50, 2) and np.frombuffer(first["y"]).tolist() == [1.0] * 100
    with pytest.raises(Exception, match="differ in their number of clusters"):
        long_hmm.packed(signal.where("bin <> 7 OR cluster = 'x'"), "x", 50).collect()


def test_rows_that_compress_well_are_not_broadcast(spark):
    """Their file is smaller than what Spark expects of one row per run, so all rows were sent to every task."""
    rows = spark.range(60000).selectExpr("'a' AS run_id", "double(id div 60) AS t", "double(id % 7) AS value")
    out = sequence.numbered(sequence.lagged(rows, "t", "before"), ["t"])
    assert "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.selectExpr("min(i)", "max(i)", "count(distinct i)", "min(n)").first() == (0, 59999, 60000, 60000)
    assert out.where("before IS NULL AND t > 0 OR before NOT IN (t, t - 1)").count() == 0

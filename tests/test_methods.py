"""Whole methods, importers and pieces against plain loops."""

import itertools
import json
import math
import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.operators import candidates, evaluation, intervals, meanfield, methods, results, segmentation, sequence, simulation, states
from eventloom.plans.method_queries import network_runs
from eventloom.sources import importers


def paths_brute(y, k, emission, start, move, chance):
    """log likelihood and best path by enumerating all state sequences."""
    best, total = None, []
    for path in itertools.product(range(k), repeat=len(y)):
        score = math.log(start[path[0]]) + chance[0, path[0]]
        score += sum(math.log(move[a, b]) + chance[t + 1, b] for t, (a, b) in enumerate(zip(path, path[1:])))
        total.append(score)
        if best is None or score > best[0]:
            best = score, path
    return np.logaddexp.reduce(total), best[1]


@pytest.mark.parametrize("emission", ["gaussian", "poisson", "bernoulli"])
def test_hidden_states_equal_enumeration(emission):
    rng = np.random.default_rng(3)
    level = np.array([0, 0, 0, 1, 1, 1, 0, 0])[:, None]
    y = {"gaussian": level * 3 + rng.normal(0, 0.3, (8, 2)), "poisson": rng.poisson(1 + 6 * level, (8, 2)), "bernoulli": (rng.random((8, 2)) < 0.1 + 0.8 * level).astype(int)}[emission].astype(float)
    # one round: the likelihood and the path are those of the starting parameters
    path, g, ll = methods.hmm(y, 2, emission, seeds=1, rounds=1)
    p, chance, _ = methods._emission(emission, y, 2, np.random.default_rng(0))
    want, best = paths_brute(y, 2, emission, np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), chance(p))
    assert ll == pytest.approx(want) and tuple(path) == best and np.allclose(g.sum(1), 1)
    more = methods.hmm(y, 2, emission, seeds=4, rounds=30)[2]
    assert more >= ll


def test_emissions_are_densities():
    y = np.arange(0, 60.0)[:, None]
    p, chance, _ = methods._emission("poisson", y, 1, np.random.default_rng(0))
    p["m"][:] = 4.0
    assert np.exp(chance(p)).sum() == pytest.approx(1)
    y = np.array([[0.0], [1.0]])
    p, chance, _ = methods._emission("bernoulli", y, 1, np.random.default_rng(0))
    assert np.exp(chance(p)).sum() == pytest.approx(1)


def test_parameter_counts():
    assert methods.parameter_count("gaussian", 3, 5) == 2 + 6 + 30 and methods.parameter_count("poisson", 3, 5) == 2 + 6 + 15


def test_templates_merge_from_the_left():
    y = np.array([[0.0, 1.0]] * 4 + [[0.1, 1.0]] * 4 + [[1.0, 0.0]] * 4 + [[0.0, 0.0]] + [[1.0, 0.1]] * 4)
    ends = [4, 8, 12, 13, 17]
    assert methods.merge_templates(y, ends, 1, mode="fixed", fixed=0.5, at_least=0) == [8, 12, 13, 17]
    assert methods.merge_templates(y, ends, 2, mode="fixed", fixed=0.5, at_least=0) == [8, 17]
    assert methods.first_seen(np.array([[1, 0], [0, 1], [1, 0], [1, 1]])).tolist() == [0, 1, 0, 2]


def test_boundary_evidence_and_unsupported_boundaries():
    rng = np.random.default_rng(1)
    x = np.array([[2.0, 0, 0]] * 3 + [[1.1, 0, 0]] + [[0, 2.0, 0]] * 3) + rng.normal(0, 0.05, (7, 3))
    masks = np.array([[1, 0, 0]] * 3 + [[0, 0, 0]] + [[0, 1, 0]] * 3, bool)
    p = {"mu0": np.zeros(4), "mu1": np.full(4, 2.0), "var0": np.full(4, 0.3), "var1": np.full(4, 0.3)}
    plain = lambda row, m: sum(0.5 * ((v - (2.0 if on else 0.0)) ** 2 / 0.3 + math.log(0.3)) for v, on in zip(row, m))
    found = methods.boundary_evidence(x, masks, p)
    assert [f[0] for f in found] == [3, 4] and [f[3] for f in found] == [1, 1]
    for i, left, right, _ in found:
        assert left == pytest.approx(plain(x[i - 1], masks[i]) - plain(x[i - 1], masks[i - 1]))
        assert right == pytest.approx(plain(x[i], masks[i - 1]) - plain(x[i], masks[i]))
    size = np.array([4, 4, 4, 1, 4, 4, 4])
    merged = methods.merge_unsupported(x, size, masks, p, 1.0)
    assert (merged[3] == merged[2]).all() and (merged[4:] == masks[4:]).all()
    assert (methods.merge_unsupported(x, size, masks, p, -1e9) == masks).all()


def test_sweep_equals_plain_measures(spark):
    rng = np.random.default_rng(5)
    y = np.repeat(rng.normal(0, 3, (6, 3)), 10, 0) + rng.normal(0, 0.3, (60, 3))
    data = pd.DataFrame([("r", c, t, float(y[t, c])) for t in range(60) for c in range(3)], columns=["run_id", "cluster", "bin", "x"])
    got = {(r["method"], r["k"]): r for r in methods.state_count_sweep(spark.createDataFrame(data), [2, 3], [0.0]).collect()}
    z = (y - y.mean(0)) / y.std(0)
    label, inertia = segmentation.lloyd(z, 3)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    s = []
    for i in range(60):
        own = [d[i, j] for j in range(60) if j != i and label[j] == label[i]]
        other = min(np.mean([d[i, j] for j in range(60) if label[j] == c]) for c in set(label) - {label[i]})
        s.append((other - np.mean(own)) / max(other, np.mean(own)) if own else 0)
    r = got["kmeans", 3]
    assert r["silhouette"] == pytest.approx(np.mean(s)) and r["inertia"] == pytest.approx(inertia) and r["found"] == 3
    h = got["hmm", 2]
    free = methods.parameter_count("gaussian", h["found"], 3)
    assert h["bic"] == pytest.approx(math.log(60) * free - 2 * h["log_likelihood"]) and h["aic"] == pytest.approx(2 * free - 2 * h["log_likelihood"])


def test_methods_find_planted_states(spark):
    rng = np.random.default_rng(2)
    truth = np.repeat([0, 1, 2, 0, 1], 24)
    level = np.array([[5, 0, 0], [0, 5, 0], [0, 0, 5]])[truth]
    counts = rng.poisson(level + 0.2)
    data = pd.DataFrame([("r", c, t, int(counts[t, c]), float(counts[t, c])) for t in range(120) for c in range(3)], columns=["run_id", "cluster", "bin", "n", "x"])
    signal = spark.createDataFrame(data)
    true = spark.createDataFrame(pd.DataFrame({"run_id": "r", "bin": range(120), "label": truth}))
    wanted = {"kmeans": {"k": 3, "least": 3}, "changepoint": {"penalty": 1.0, "radius": 2}, "hmm": {"k": 3}, "poisson": {"method": "hmm", "k": 3, "emission": "poisson"}, "active_set": {"width": 6, "k_max": 2}}
    scores = {r["method"]: r for r in methods.evaluated(methods.analyzed(signal, wanted), true).collect()}
    assert set(scores) == set(wanted) and all(scores[m]["accuracy"] > 0.9 for m in wanted), scores


def test_diverse_choice_equals_a_greedy_loop(spark):
    rng = np.random.default_rng(7)
    data = [(float(g), 1, float(rng.normal()), str(rng.choice(["stable", "unstable"])), float(rng.random())) for g in range(3) for _ in range(12)] + [(9.0, 1, 0.5, "stable", None)]
    got = candidates.diverse(spark.createDataFrame(data, "rep double, focus_count int, value double, stability string, residual double"), 4).collect()
    for g in {r[0] for r in data}:
        pool = [r for r in data if r[0] == g]
        rank = lambda r: (r[3] != "stable", math.inf if r[4] is None else r[4], -abs(r[2]), -r[2])
        taken = [min(pool, key=rank)]
        while len(taken) < min(4, len(pool)):
            rest = [r for r in pool if r not in taken]
            taken.append(min(rest, key=lambda r: (-min(abs(r[2] - t[2]) for t in taken), rank(r))))
        assert [r["value"] for r in sorted((r for r in got if r["rep"] == g), key=lambda r: r["nth"])] == [t[2] for t in taken]


def test_pieces_equal_whole_windows(spark):
    rng = np.random.default_rng(0)
    for scale in (1.0, 0.0):
        t = np.round(rng.random(300) * 50 * scale, 1)
        v = [None if rng.random() < 0.6 else float(k) for k in range(300)]
        df = spark.createDataFrame([("r", float(a), k, b) for k, (a, b) in enumerate(zip(t, v))] + [("one", 3.0, 0, 1.0)], "run_id string, t double, k int, v double").repartition(5)
        rows = {r["k"]: r for r in sequence.numbered(df, ["t", "k"], pieces=7).where("run_id = 'r'").collect()}
        order = sorted(range(300), key=lambda k: (t[k], k))
        assert [rows[k]["i"] for k in order] == list(range(300)) and rows[0]["n"] == 300
        lag = {r["k"]: r["before"] for r in sequence.lagged(df, "t", "before", pieces=7).where("run_id = 'r'").collect()}
        assert sorted((lag[k] is not None, lag[k] or 0) for k in order) == sorted([(False, 0), *((True, t[k]) for k in order[:-1])])
        around = {r["k"]: r for r in sequence.around(df, "t", "v", pieces=7).where("run_id = 'r'").collect()}
        for k in range(300):
            below = [t[j] for j in range(300) if v[j] is not None and t[j] <= t[k]]
            above = [t[j] for j in range(300) if v[j] is not None and t[j] >= t[k]]
            p, q = around[k]["p"], around[k]["q"]
            assert (p is None) == (not below) and (p is None or t[int(p)] == max(below))
            assert (q is None) == (not above) and (q is None or t[int(q)] == min(above))


def test_error_function():
    x = np.linspace(-8, 8, 4001)
    assert np.abs(meanfield.erf(x) - np.vectorize(math.erf)(x)).max() < 1e-13


def test_eigenvalues_of_one_network(spark):
    p = spark.createDataFrame([("a", 6, 2.0, 3.0, 4)], "param_id string, q int, j double, kappa double, seed int")
    got = sorted((round(r["re"], 9), round(r["im"], 9)) for r in meanfield.eigenvalues(p).collect())
    mean, var = meanfield.connectivity(6, 2.0, 3.0)
    w = mean + np.random.default_rng(4).standard_normal((6, 6)) * np.sqrt(var)
    for re, im in got:  # each makes the matrix singular
        assert abs(np.linalg.det(w - complex(re, im) * np.eye(6))) < 1e-6
    assert sum(r for r, _ in got) == pytest.approx(np.trace(w))


def test_fixed_points_solve_their_equations(spark):
    p = spark.createDataFrame([("a", 5, 2.0, 4.0, -1.0)], "param_id string, q int, j double, kappa double, bias double")
    curve = meanfield.response_curves(p, 41).collect()
    mean, var = meanfield.connectivity(5, 2.0, 4.0)
    for r in curve:
        s = np.array(r["solve"])
        f = meanfield.gain(mean @ s - 1.0, np.sqrt(var @ (s * (1 - s)) + 1e-4))
        assert s[0] == pytest.approx(r["x"]) and np.abs(f - s)[1:].max() < 1e-6 and f[0] == pytest.approx(r["y"], abs=1e-9)


def test_networks_replay_their_logs(spark):
    runs = spark.createDataFrame([("a", 1, 3.0), ("b", 2, 1.0)], "run_id string, seed int, kappa double")
    log = meanfield.binary_network(runs, 2, 5, 800).toPandas()
    again = meanfield.binary_network(runs, 2, 5, 800).toPandas()
    assert log.equals(again) and set(log["delta"]) <= {-1, 1}
    for _, part in log.groupby(["run_id", "unit"]):  # a unit's changes alternate
        assert (part.sort_values("step")["delta"].diff().dropna() != 0).all()


def test_gamma_trains_have_their_rate_and_spread(spark):
    u = spark.range(40).selectExpr("'g' AS run_id", "id AS unit")
    t = intervals.gamma_trains(u, 20.0, 4.0, 30_000.0, 5).toPandas()
    isi = t.sort_values(["unit", "t"]).groupby("unit")["t"].diff().dropna()
    assert len(t) == pytest.approx(40 * 600, rel=0.03) and isi.var() / isi.mean() ** 2 == pytest.approx(0.25, rel=0.05) and t["t"].between(0, 30_000).all()


def test_penalties_equal_an_exhaustive_search(spark):
    rng = np.random.default_rng(8)
    y = np.concatenate([rng.normal(m, 0.2, (5, 2)) for m in (0, 2, -1)])
    cost = segmentation.SquaredCost(y)
    data = pd.DataFrame([("r", c, t, float(y[t, c])) for t in range(15) for c in range(2)], columns=["run_id", "cluster", "bin", "x"])
    for r in segmentation.penalty_grid(spark.createDataFrame(data), [0.3, 1.0, 5.0]).collect():
        best = min(sum(cost(a, b) for a, b in zip((0, *cut), (*cut, 15))) + r["penalty"] * (len(cut) + 1) for n in range(4) for cut in itertools.combinations(range(2, 14), n) if all(b - a >= 2 for a, b in zip((0, *cut), (*cut, 15))))
        assert r["cost"] + r["penalty"] * r["segments"] == pytest.approx(best)


def test_short_runs_are_removed(spark):
    labels = [0, 0, 1, 2, 2, 2, 0, 1, 1, 1]
    df = spark.createDataFrame([("r", k, v) for k, v in enumerate(labels)], "run_id string, bin long, label long")
    got = lambda s: [r["label"] for r in sorted(states.short_removed(df, 2, s).collect(), key=lambda r: r["bin"])]
    assert got("previous") == [0, 0, 0, 2, 2, 2, 2, 1, 1, 1] and got("next") == [0, 0, 2, 2, 2, 2, 1, 1, 1, 1]


def test_sampled_pairs_and_edges_are_valid(spark):
    from eventloom.operators import edges

    e = edges.fixed_indegree_edges(spark, 30, 40, 7, 1.0, 3).toPandas()
    assert (e.groupby("post").size() == 7).all() and e["pre"].between(0, 39).all()
    b = edges.bernoulli_edges(spark, 300, 400, 0.1, 1.0, 3).toPandas()
    assert not b.duplicated(["post", "pre"]).any() and b["pre"].between(0, 399).all() and len(b) == pytest.approx(12_000, rel=0.05)


# ------------------------------------------------------------------- results and importers


def test_report_order_and_points(spark):
    df = spark.createDataFrame([(2, 1.0, "b"), (1, 2.0, "a"), (1, 1.0, "c")], "seed int, kappa double, x string")
    assert [r["x"] for r in results.report_order(df, ["r_j", "kappa", "seed"]).collect()] == ["c", "b", "a"]
    c = spark.createDataFrame([(1.0, 1, 0.0, "stable", [0.0, 0.0]), (1.0, 1, 0.3, "stable", [0.1]), (1.0, 2, 0.0, "stable", [])], "rep double, focus_count int, value double, stability string, rates array<double>")
    assert candidates.points(c).count() == 2
    with pytest.raises(Exception, match="populations"):
        candidates.chosen(c, 1.0, populations=3).collect()


def test_matching_is_the_best_of_all(spark):
    rng = np.random.default_rng(6)
    m = rng.integers(0, 20, (4, 4))
    x = spark.createDataFrame([("r", i, j, int(m[i, j])) for i in range(4) for j in range(4)], "run_id string, t int, p int, n int")
    best = max(sum(m[i, p[i]] for i in range(4)) for p in itertools.permutations(range(4)))
    assert evaluation.matched_accuracy(x).first()["accuracy"] == pytest.approx(best / m.sum())


def test_folders(spark, tmp_path):
    np.savez(tmp_path / "b_trace.npz", spiketimes=np.array([[1.0, 2.0, np.nan], [0, 1, 2]]))
    np.savez(tmp_path / "a_summary.npz", x=1)
    (tmp_path / "params.json").write_text(json.dumps({"parameter": {"Q": 2}}))
    run = importers.read_run(spark, str(tmp_path), "r")
    assert run["kind"] == "snn" and run["frame"].count() == 2 and run["names"] == ["E1", "E2", "I1", "I2"] and run["parameters"] == {"Q": 2}
    assert importers.sibling(str(tmp_path / "b_trace.npz")) is None
    (tmp_path / "b_trace_weights.npz").write_bytes(b"")
    assert importers.sibling(str(tmp_path / "b_trace.npz")).endswith("b_trace_weights.npz")
    with pytest.raises(ValueError):
        importers.only([], "weights")
    frame = spark.createDataFrame([("r", 1, 2.0)], "run_id string, a int, b double")
    importers.save_run({"segments": frame}, f"file://{tmp_path}/store", "r")
    importers.save_run({"segments": frame.withColumn("a", F.lit(5))}, f"file://{tmp_path}/store", "r")
    assert [tuple(r) for r in importers.load_run(spark, f"file://{tmp_path}/store", "segments").select("run_id", "a").collect()] == [("r", 5)]
    assert importers.output_folder("base/", {"connection": "dense", "r_j": 0.75}, "t") == "base/connection=dense/r_j=0.75/t"


def test_plain_data_only(tmp_path):
    assert importers.plain_pickle(pickle.dumps({"kappa": [0.1, 2]})) == {"kappa": [0.1, 2]}
    with pytest.raises(pickle.UnpicklingError):
        importers.plain_pickle(pickle.dumps(math.sqrt))
    importers.write_json({"a": float("nan"), "b": [1.23456789, {"c": float("inf")}]}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": None, "b": [1.234568, {"c": None}]}
    assert importers.focus_counts([3, "1,2", [[2], 0]]) == [1, 2, 3] and importers.focus_counts(None) == []
    assert importers.settled({"steps": 7, "sample": None}) == {"warmup": 5000, "steps": 7, "sample": 10, "batch": 200, "seed": 0, "weights": "sparse"}
    with pytest.raises(ValueError):
        importers.settled({"steps": 0})


def test_ids_without_a_convention_fail(spark):
    events = spark.createDataFrame([(1, 0), (1, 99)], "parent int, source int")
    parents = spark.createDataFrame([(1, 0, 10)], "parent int, offset long, size int")
    with pytest.raises(Exception, match="no convention"):
        importers.parent_indices(events, parents).collect()


# ------------------------------------------------------------------- networks


def test_networks_follow_their_rule(spark):
    """Every logged and every unlogged update against inputs summed anew, and what is derived
    from the log against the replayed states."""
    runs = network_runs(spark).withColumn("steps", F.lit(300))
    log = simulation.change_log(runs).toPandas()
    edges = simulation.edges(runs).toPandas()
    rates = simulation.recorded_rates(simulation.change_log(runs), simulation.members(runs), 100, 300).toPandas()
    fields = simulation.recorded_fields(simulation.recorded(simulation.change_log(runs), simulation.members(runs), 100, 300), simulation.edges(runs)).toPandas()
    assert not (edges["post"] == edges["pre"]).any() and set(log["delta"]) <= {-1, 1}
    for p in runs.toPandas().itertuples():
        own, w = log[log["run_id"] == p.run_id], np.zeros((100, 100))
        e = edges[edges["run_id"] == p.run_id]
        w[e["post"], e["pre"]] = e["w"]
        assert (w[:, :80] >= 0).all() and (w[:, 80:] <= 0).all()
        s = np.zeros(100, int)
        s[own[own["step"] < 0]["unit"]] = 1
        drive = np.where(np.arange(100) < 80, p.drive_e, p.drive_i) * p.m_x
        changes = {r.step: r for r in own[own["step"] >= 0].itertuples()}
        for step in range(300):
            if step in changes:
                c = changes[step]
                assert (sum(w[c.unit, j] for j in range(100) if s[j]) + drive[c.unit] > p.v_th) == (c.delta == 1) and s[c.unit] == (c.delta < 0)
                s[c.unit] += c.delta
            if step % 100 == 0:
                at = rates[(rates["run_id"] == p.run_id) & (rates["step"] == step)].set_index("pop")["rate"]
                for k in range(5):
                    assert at[f"E{k + 1}"] == pytest.approx(s[16 * k : 16 * k + 16].mean()) and at[f"I{k + 1}"] == pytest.approx(s[80 + 4 * k : 84 + 4 * k].mean())
                h = fields[(fields["run_id"] == p.run_id) & (fields["step"] == step)].sort_values("unit")["h"].to_numpy()
                assert np.allclose(h, w @ s)


def test_a_source_is_analyzed_and_stored(spark, tmp_path):
    rng = np.random.default_rng(3)
    on = rng.random((4000, 1)) * 8000
    unit = np.where((on[:, 0] // 1000).astype(int) % 2 == 0, rng.integers(0, 10, 4000), rng.integers(10, 20, 4000))
    np.savez(tmp_path / "trace.npz", spike_times=on[:, 0], spike_ids=unit)
    out = methods.analyze_source(spark, str(tmp_path / "trace.npz"), "r", {"kmeans": {"k": 2}}, 100.0, 10, f"file://{tmp_path}/store")
    segs = importers.load_run(spark, f"file://{tmp_path}/store", "kmeans_segments")
    assert out["labels"].count() == 80 and segs.count() == 8 and {r["duration_time"] for r in segs.collect()} == {1000.0}


def test_fixed_points_of_two_kinds_are_solved_and_told_stable(spark):
    """Each point solves its equations; a small push away from it fades if it is called stable and
    grows if not, by the plain flow of rates."""
    runs = network_runs(spark)
    found = meanfield.solved_points(runs, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).collect()
    params = {p.run_id: p for p in runs.toPandas().itertuples()}
    assert {r["run_id"] for r in found} and {r["stability"] for r in found} <= {"stable", "unstable"}
    for r in found:
        mean, var, bias = meanfield.two_kinds(params[r["run_id"]])
        at = np.array(r["rates"])
        assert np.abs(meanfield.residual(at, mean, var, bias)).max() < 1e-8
        own = mean @ at + bias
        sd = np.sqrt(var @ (at * (1 - at)) + 1e-4)
        assert at == pytest.approx([0.5 * math.erfc(-h / s / math.sqrt(2)) for h, s in zip(own, sd)], abs=1e-7)
        values, vectors = np.linalg.eig(meanfield.jacobian(at, mean, var, bias))
        push = vectors[:, values.real.argmax()].real
        state = at + 1e-4 * push / np.linalg.norm(push)
        for _ in range(400):
            state = state + 0.01 * meanfield.residual(state, mean, var, bias)
        if abs(r["growth"]) > 0.2 and abs(values[values.real.argmax()].imag) < 1e-9:
            assert (np.linalg.norm(state - at) < 1e-4) == (r["stability"] == "stable")


def test_shards_cover_their_runs(spark):
    out = methods.shard(network_runs(spark).withColumn("steps", F.lit(1200)), 50, 1200, 4, 2)
    signal, inventory = out["signal"].toPandas(), out["inventory"].toPandas()
    assert set(signal["cluster"]) == {f"E{k}" for k in range(1, 6)} and signal.groupby("run_id")["bin"].nunique().eq(24).all()
    assert np.allclose(inventory.groupby("run_id")["share"].sum(), 1) and np.allclose(inventory.groupby("run_id")["occupied"].sum(), 24)
    assert (inventory["members"] <= 2).all() and inventory.loc[inventory["state_key"] == "LOW", "state"].eq(0).all()

"""Networks of binary units with clusters of excitatory and inhibitory ones: their weights, the
log of their state changes, and sampled states, rates and fields from both.

runs(run_id, seed, steps, q, n_e, n_i, v_th, m_x, tau_e, tau_i, start, drive_e, drive_i, blocks):
one row per run; blocks comes from network.cluster_parameters. A run is sequential, so a run
is a task; what is derived from its log is worked out by joins and windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import network, states


def prepared(params: DataFrame) -> DataFrame:
    """params of network.cluster_parameters with run_id, seed, steps, m_x, tau_e, tau_i, start."""
    blocks = network.cluster_parameters(params.withColumnRenamed("run_id", "param_id")).groupBy(F.col("param_id").alias("run_id"))
    blocks = blocks.agg(F.collect_list(F.struct("block", "p_in", "p_out", "j_in", "j_out")).alias("blocks"))  # four rows
    drive = network.external_drive(params.withColumnRenamed("run_id", "param_id")).withColumnRenamed("param_id", "run_id")
    return params.join(blocks, "run_id").join(drive, "run_id")


def clusters_of(p) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and whether excitatory of each unit: E first, both cut into q equal stretches."""
    n_e, n_i, q = int(p.n_e), int(p.n_i), int(p.q)
    return np.concatenate([np.arange(n_e) * q // n_e, np.arange(n_i) * q // n_i]), np.arange(n_e + n_i) < n_e


def weights_of(p) -> np.ndarray:
    """Dense weights (target, source) of one run, drawn by its seed; no unit reaches itself."""
    rng = np.random.default_rng([int(p.seed), 1])
    cluster, exc = clusters_of(p)
    inside, u = cluster[:, None] == cluster, rng.random((len(exc), len(exc)))
    w = np.zeros_like(u)
    for b in p.blocks:
        part = (exc == (b["block"][0] == "E"))[:, None] & (exc == (b["block"][1] == "E"))
        w[part & inside & (u < b["p_in"])] = b["j_in"]
        w[part & ~inside & (u < b["p_out"])] = b["j_out"]
    np.fill_diagonal(w, 0)
    return w


def _changes(p) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Starting states and the changes (step, unit, delta). At a step one unit, of a kind drawn by
    its number of units over its time constant, takes the state that its input has."""
    rng, (_, exc), w = np.random.default_rng([int(p.seed), 2]), clusters_of(p), weights_of(p)
    n_e, n = int(p.n_e), len(exc)
    s = (rng.random(n) < p.start).astype(np.int64)
    first, h = s.copy(), w @ s + np.where(exc, p.drive_e, p.drive_i) * p.m_x
    share = (p.n_e / p.tau_e) / (p.n_e / p.tau_e + p.n_i / p.tau_i)
    kind = rng.random(int(p.steps)) < share
    unit = np.where(kind, rng.integers(0, n_e, int(p.steps)), rng.integers(n_e, n, int(p.steps)))
    out = []
    for step, i in enumerate(unit.tolist()):
        new = int(h[i] > p.v_th)
        if new != s[i]:
            h += w[:, i] * (new - s[i])
            out.append((step, i, new - int(s[i])))
            s[i] = new
    return first, out


def _per_run(runs: DataFrame, make, kinds: str) -> DataFrame:
    names = [k.split(" ")[0] for k in kinds.split(", ")]

    def run(frames):
        for frame in frames:
            for p in frame.itertuples():
                yield pd.DataFrame(make(p), columns=names)

    return runs.repartition("run_id").mapInPandas(run, kinds)


def change_log(runs: DataFrame) -> DataFrame:
    """(run_id, step, unit, delta): starting states of 1 as changes at step -1, then all changes."""

    def make(p):
        first, log = _changes(p)
        return [(p.run_id, -1, int(u), 1) for u in np.flatnonzero(first)] + [(p.run_id, *c) for c in log]

    return _per_run(runs, make, "run_id string, step long, unit long, delta int")


def edges(runs: DataFrame) -> DataFrame:
    """(run_id, post, pre, w) of the weights that aren't zero."""

    def make(p):
        w = weights_of(p)
        post, pre = np.nonzero(w)
        return {"run_id": p.run_id, "post": post, "pre": pre, "w": w[post, pre]}

    return _per_run(runs, make, "run_id string, post long, pre long, w double")


def members(runs: DataFrame) -> DataFrame:
    """(run_id, unit, pop): E1 .. Eq, I1 .. Iq."""
    unit = runs.select("run_id", "q", "n_e", "n_i", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n_e") + F.col("n_i") - 1).cast("long"))).alias("unit"))
    exc = F.col("unit") < F.col("n_e")
    k = F.when(exc, F.floor(F.col("unit") * F.col("q") / F.col("n_e"))).otherwise(F.floor((F.col("unit") - F.col("n_e")) * F.col("q") / F.col("n_i")))
    return unit.select("run_id", "unit", F.concat(F.when(exc, "E").otherwise("I"), (k + 1).cast("string")).alias("pop"))


def recorded(log: DataFrame, units: DataFrame, stride: int, steps: int) -> DataFrame:
    """States of every unit at steps 0, stride, ... from a change log."""
    first = units.join(log.where("step < 0").select("run_id", "unit", F.lit(1).alias("s")), ["run_id", "unit"], "left").fillna(0, ["s"])
    return states.replayed(first.select("run_id", "unit", "s"), log.where("step >= 0"), stride, steps)


def recorded_rates(log: DataFrame, pops: DataFrame, stride: int, steps: int) -> DataFrame:
    """Mean state of every population at those steps."""
    first = pops.select("run_id", "unit").join(log.where("step < 0").select("run_id", "unit", F.lit(1).alias("s")), ["run_id", "unit"], "left").fillna(0, ["s"])
    return states.population_rates(first, log.where("step >= 0"), pops, stride, steps)


def recorded_fields(sampled: DataFrame, weights: DataFrame) -> DataFrame:
    """Input of every unit at the sampled steps, 0 where it has none: sums over active sources."""
    own = sampled.where("s = 1").select("run_id", "step", F.col("unit").alias("pre")).join(weights, ["run_id", "pre"]).groupBy("run_id", "step", F.col("post").alias("unit")).agg(F.sum("w").alias("h"))
    return sampled.select("run_id", "step", "unit").join(own, ["run_id", "step", "unit"], "left").fillna(0.0, ["h"])

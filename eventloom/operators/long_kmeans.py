"""k-means of runs of any length over partitions.

Rows never leave their partition: a round sends, per task and run, the sums and counts of each
centre's rows, and gets the new centres back. Seeds are drawn by oversampling: in each of a few
rounds every task keeps the rows with the smallest keys -log(u) / distance (u is a hash of run,
place and round, so a lost task draws the same ones), and the 2k smallest of a run join its
candidates; these are weighted by the rows nearest to them and only they are clustered in one task,
several times, into starting centres."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.long_segments import vectors
from eventloom.sources.stored import removed, stored

ROUNDS, OVER = 4, 2
CENTRES = "run_id string, q int, centres binary, resting boolean, inertia double"


def squared(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """rows x centres, by differences: products of large values would cancel."""
    return np.stack([((y - row) ** 2).sum(1) for row in c], 1)


def _runs(frame: pd.DataFrame):
    for run, own in frame.groupby("run_id", sort=False):
        yield run, own, np.stack(own["y"].to_numpy()).astype(float)


def _drawn(rows: DataFrame, candidates: DataFrame | None, take: int, nth: int) -> DataFrame:
    """Candidates with the `take` rows of a run whose keys are smallest."""
    chance = (F.shiftrightunsigned(F.xxhash64("run_id", "at", F.lit(nth)), 11) + 0.5) / float(1 << 53)
    keyed = rows.withColumn("u", chance)
    keyed = keyed.join(candidates.select("run_id", "q", "centres"), "run_id") if candidates is not None else keyed.withColumn("q", F.size("y")).withColumn("centres", F.lit(None).cast("binary"))

    def smallest(frames):
        best: dict[str, list] = {}
        for frame in frames:
            for run, own, y in _runs(frame):
                blob = own["centres"].iloc[0]
                d = np.ones(len(y)) if blob is None else squared(y, np.frombuffer(blob).reshape(-1, y.shape[1])).min(1)
                with np.errstate(divide="ignore"):
                    key = -np.log(own["u"].to_numpy()) / d
                near = np.argsort(key, kind="stable")[:take]
                best[run] = sorted(best.get(run, []) + [(float(key[i]), y[i].tobytes()) for i in near if np.isfinite(key[i])])[:take]
        out = [(run, *row) for run, own in best.items() for row in own]
        yield pd.DataFrame(out, columns=["run_id", "key", "y"])

    told = keyed.mapInPandas(smallest, "run_id string, key double, y binary")

    def gather(key, new, old):
        blobs = new.sort_values(["key", "y"])["y"].to_list()[:take]
        before = old["centres"].to_list() if len(old) else []
        q = int(old["q"].iloc[0]) if len(old) else len(blobs[0]) // 8
        return pd.DataFrame({"run_id": [key[0]], "q": [q], "centres": [b"".join(before + blobs)], "resting": [False], "inertia": [np.inf]})

    before = candidates if candidates is not None else rows.sparkSession.createDataFrame([], CENTRES)
    return told.groupBy("run_id").cogroup(before.groupBy("run_id")).applyInPandas(gather, CENTRES)


def _sums(rows: DataFrame, centres: DataFrame, starts: int) -> DataFrame:
    """Per task and run: for every start and centre the count, the sum and the squared distances of its rows."""

    def add(frames):
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            for run, own, y in _runs(frame):
                c = np.frombuffer(own["centres"].iloc[0]).reshape(starts, -1, y.shape[1])
                part = np.zeros((starts, c.shape[1], y.shape[1] + 2))
                for s in range(starts):
                    d = squared(y, c[s])
                    label = d.argmin(1)
                    part[s, :, 0] = np.bincount(label, minlength=c.shape[1])
                    part[s, :, 1] = np.bincount(label, d[np.arange(len(y)), label], minlength=c.shape[1])
                    for j in range(y.shape[1]):
                        part[s, :, 2 + j] = np.bincount(label, y[:, j], minlength=c.shape[1])
                total[run] = total[run] + part if run in total else part
        yield pd.DataFrame([(run, p.tobytes()) for run, p in total.items()], columns=["run_id", "sums"])

    return rows.join(centres.select("run_id", "centres"), "run_id").mapInPandas(add, "run_id string, sums binary")


def _weighted(y: np.ndarray, w: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, float]:
    """Centres of weighted rows from one k-means++ start."""
    rng = np.random.default_rng(seed)
    c = y[[rng.choice(len(y), p=w / w.sum())]]
    while len(c) < k:
        p = w * squared(y, c).min(1)
        c = np.vstack([c, y[rng.choice(len(y), p=p / p.sum()) if p.sum() else rng.integers(len(y))]])
    for _ in range(100):
        d = squared(y, c)
        label = d.argmin(1)
        new = np.array([np.average(y[label == j], axis=0, weights=w[label == j]) if w[label == j].sum() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c, float((w * d.min(1)).sum())


def seeded(rows: DataFrame, k: int, starts: int) -> DataFrame:
    """`starts` times k starting centres of every run."""
    found = None
    for nth in range(ROUNDS):
        new = stored(_drawn(rows, found, OVER * k if nth else 1, nth), "candidates")
        if found is not None:
            removed(found)
        found = new

    def reduce(key, sums, own):
        q = int(own["q"].iloc[0])
        y = np.frombuffer(own["centres"].iloc[0]).reshape(-1, q)
        w = sum(np.frombuffer(s).reshape(1, len(y), q + 2)[0, :, 0] for s in sums["sums"])
        tried = sorted((_weighted(y, w, k, seed) for seed in range(4 * starts)), key=lambda t: t[1])[:starts]
        return pd.DataFrame({"run_id": [key[0]], "q": [q], "centres": [np.stack([c for c, _ in tried]).tobytes()], "resting": [False], "inertia": [np.inf]})

    out = stored(_sums(rows, found, 1).groupBy("run_id").cogroup(found.groupBy("run_id")).applyInPandas(reduce, CENTRES), "centres")
    removed(found)
    return out


def long_kmeans(signal: DataFrame, k: int, starts: int = 5, rounds: int = 100, value: str = "x") -> tuple[DataFrame, DataFrame]:
    """(run_id, bin, label) and (run_id, inertia, centres array<array<double>>) of the best of
    several starts. A centre without rows stays where it is."""
    rows = stored(vectors(signal, value), "vectors")
    centres = seeded(rows, k, starts)

    def move(key, sums, own):
        q = int(own["q"].iloc[0])
        total = sum(np.frombuffer(s) for s in sums["sums"]).reshape(starts, k, q + 2)
        c, n = np.frombuffer(own["centres"].iloc[0]).reshape(starts, k, q), total[:, :, :1]
        new = np.where(n > 0, total[:, :, 2:] / np.maximum(n, 1), c)
        inertia, still = total[:, :, 1].sum(1), bool(np.allclose(new, c))
        best = int(inertia.argmin())
        kept = c[[best]] if still else new[np.argsort(inertia, kind="stable")]  # the best start first
        return pd.DataFrame({"run_id": [key[0]], "q": [q], "centres": [kept.tobytes()], "resting": [still], "inertia": [float(inertia[best])]})

    for nth in range(rounds):
        moving = centres.where("not resting")
        if not moving.limit(1).count():
            break
        moved = _sums(rows, moving, starts).groupBy("run_id").cogroup(moving.groupBy("run_id")).applyInPandas(move, CENTRES)
        new = stored(centres.where("resting").unionByName(moved), "centres")
        removed(centres)
        centres = new

    def first(frames):
        for frame in frames:
            yield pd.DataFrame({"run_id": frame["run_id"], "inertia": frame["inertia"], "centres": [np.frombuffer(c)[: k * q].reshape(k, q).tolist() for c, q in zip(frame["centres"], frame["q"])]})

    told = stored(centres.mapInPandas(first, "run_id string, inertia double, centres array<array<double>>"), "centres")
    return nearest(rows, told), told


def nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """run_id, bin, label: rows(run_id, bin, y) with the number of the nearest of their run's
    centres(run_id, centres), the first of equally near ones. Built-in functions only."""
    far = F.transform("centres", lambda c: F.aggregate(F.zip_with("y", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return rows.join(centres.select("run_id", "centres"), "run_id").withColumn("far", far).select("run_id", "bin", (F.array_position("far", F.array_min("far")) - 1).alias("label"))

"""Penalised segmentation of runs of any length, in stretches that no single task joins.

The segmentation of least cost is found exactly, at two levels. A run is cut at provisional
borders. A border holds where its own stretch proves that no segment of a best segmentation
spans it: from `least` bins after the border up to some bin t, splitting costs less than one
segment by more than a penalty; then whatever segment came over the border and went on beyond
t would gain by ending before t. So every best segmentation has an end in the window between
border and t. Blocks between the borders that hold return the costs from every place in their
first window to every place in their last (a PELT search with all those starts at once), and the
(min, +) product of these small matrices joins them, 64 neighbours at a time, level by level.
Going down the levels again tells each block its first and last place, and the block its segments.

The proof needs costs that fall when a stretch is cut, as 'l2' and 'l1' do. A border that isn't
proved joins two stretches; in a run that never changes none is, and there PELT itself prunes
nothing and takes quadratic time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.operators.segmentation import COSTS
from eventloom.sources.stored import stored

#: Bins between provisional borders, and neighbours that one (min, +) product joins.
STRETCH, FAN = 2048, 64
ADDITIVE = ("l2", "l1")


def vectors(signal: DataFrame, value: str = "x") -> DataFrame:
    """run_id, at (bins from the run's first), bin, y: the values of the bin's clusters in order."""
    rows = signal.groupBy("run_id", "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("y"))
    first = rows.groupBy("run_id").agg(F.min("bin").alias("first"))
    return rows.join(first, "run_id").select("run_id", (F.col("bin") - F.col("first")).alias("at"), "bin", "y")


def searched(y: np.ndarray, starts: np.ndarray, penalty: float, least: int, cost: str = "l2", until=None) -> tuple[np.ndarray, np.ndarray]:
    """PELT from several starts at once: the least costs (starts x ends) of segmenting the bins
    from each start to each end, every segment with its penalty, and the last segment's first bin.
    A start that is beaten at an end goes once the end itself can serve, `least` bins later, so
    nothing is lost by `least`. until(costs, end, price) may end the search."""
    price, n = COSTS[cost](y), len(y)
    costs, back = np.full((len(starts), n + 1), np.inf), np.full((len(starts), n + 1), -1, dtype=np.int64)
    costs[np.arange(len(starts)), starts] = 0.0
    low = int(starts.min())
    alive, leaves = np.array([low]), np.full(n + 1, n + 2)
    for end in range(low + 1, n + 1):
        alive = alive[leaves[alive] > end]
        ok = alive[end - alive >= least]
        if len(ok):
            reach = costs[:, ok] + price(ok, np.full(len(ok), end))
            k = reach.argmin(1)
            best = reach[np.arange(len(starts)), k] + penalty
            better = best < costs[:, end]
            costs[better, end], back[better, end] = best[better], ok[k[better]]
            beaten = ok[~(reach <= costs[:, [end]]).any(0)]
            leaves[beaten] = np.minimum(leaves[beaten], end + least)
        if np.isfinite(costs[:, end]).any():
            alive = np.append(alive, end)
        if until is not None and until(costs, end, price):
            break
    return costs, back


def window_of(y: np.ndarray, penalty: float, least: int, cost: str = "l2") -> int | None:
    """The last place of the window after a border at 0 in which every best segmentation has an
    end, or None where the stretch doesn't prove one."""
    found = []

    def proved(costs, end, price):
        if end - least >= 2 * least and price(np.array(least), np.array(end)) > penalty + costs[0, end] + 1e-9:
            found.append(end + least - 1)
        return bool(found)

    if len(y) >= 4 * least:
        searched(y, np.array([least]), penalty, least, cost, proved)
    return found[0] if found and found[0] < len(y) else None


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product."""
    return np.stack([(row[:, None] + b).min(0) for row in a])


def through(parts: list[np.ndarray], i: int, j: int) -> list[int]:
    """The places at the inner borders of the cheapest way through the matrices from i to j."""
    reach, trace = parts[0][i], []
    for m in parts[1:]:
        step = reach[:, None] + m
        trace.append(step.argmin(0))
        reach = step.min(0)
    out = [j]
    for back in reversed(trace):
        out.append(int(back[out[-1]]))
    return out[::-1]


# ------------------------------------------------------------------- levels


def _array(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame.sort_values("at")["y"].to_numpy()).astype(float)


def blocks(cut: DataFrame, penalty: float, least: int, cost: str, stretch: int) -> DataFrame:
    """Rows of vectors() by block: a row in a window is in the blocks on both of its sides. With
    base (the block's border), open (its last place of entry, 0 for the run's first block) and exits (the
    border behind and the last place of exit; null in the run's last block)."""

    def find(frame):
        last = window_of(_array(frame), penalty, least, cost) if frame["stretch"].iloc[0] else 0
        return pd.DataFrame({"run_id": [frame["run_id"].iloc[0]], "stretch": [frame["stretch"].iloc[0]], "last": pd.array([last], "Int64")})

    found = cut.groupBy("run_id", "stretch").applyInPandas(find, "run_id string, stretch long, last long")
    # a row per stretch of a run, not per bin
    w = Window.partitionBy("run_id").orderBy("stretch")
    sides = found.withColumn("block", F.count("last").over(w) - 1)
    heads = sides.where("last is not null").select("run_id", "block", (F.col("stretch") * stretch).alias("base"), F.col("last").alias("open"), (F.lead("stretch").over(w) * stretch).alias("next"), F.lead("last").over(w).alias("shut"))
    placed = cut.join(sides, ["run_id", "stretch"])
    inside = (F.col("block") > 0) & F.col("last").isNotNull() & (F.col("at") - F.col("stretch") * stretch < F.col("last"))
    shared = placed.withColumn("block", F.explode(F.when(inside, F.array("block", F.col("block") - 1)).otherwise(F.array("block"))))
    return shared.select("run_id", "block", "at", "y").join(heads, ["run_id", "block"])


def _places(frame: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of entry and of exit, counted from the block's border."""
    base, last, behind, shut = (frame[c].iloc[0] for c in ("base", "open", "next", "shut"))
    starts = np.arange(1, int(last) + 1) if last else np.array([0])
    return starts, np.array([n]) if pd.isna(behind) else int(behind - base) + np.arange(1, int(shut) + 1)


def long_changepoints(signal: DataFrame, penalty: float, least: int = 2, value: str = "x", cost: str = "l2", stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """run_id, start_bin, stop_bin of the segments of least cost plus penalty each. Of equally
    good segmentations any one comes out. A run shorter than 2 * least bins is one segment."""
    return segmented(stored(vectors(signal, value), "vectors"), penalty, least, cost, stretch, fan).drop("off")


def off(y: np.ndarray, cost: str) -> float:
    """The cost of one segment: squared distances from the means, or absolute ones from the medians."""
    return float(((y - y.mean(0)) ** 2).sum() if cost == "l2" else np.abs(y - np.median(y, axis=0)).sum())


def segmented(rows: DataFrame, penalty: float, least: int, cost: str, stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """long_changepoints() of the written rows of vectors(), with each segment's cost `off`."""
    if cost not in ADDITIVE:
        raise ValueError(f"stretches can't be proved apart with the cost {cost}")
    cut = rows.withColumn("stretch", F.expr(f"at div {stretch}"))
    own = stored(blocks(cut.select("run_id", "at", "y", "stretch"), penalty, least, cost, stretch), "blocks")

    def price(frame):
        y = _array(frame)
        starts, stops = _places(frame, len(y))
        costs, _ = searched(y, starts, penalty, least, cost)
        return pd.DataFrame({"run_id": [frame["run_id"].iloc[0]], "block": [frame["block"].iloc[0]], "entries": [len(starts)], "costs": [costs[:, stops].tobytes()]})

    level = stored(own.groupBy("run_id", "block").applyInPandas(price, MATRIX), "costs")
    levels = [level]
    while level.groupBy("run_id").count().where("count > 1").limit(1).count():
        level = level.withColumn("group", F.expr(f"block div {fan}")).groupBy("run_id", "group").applyInPandas(_joined, MATRIX)
        level = stored(level, "costs")
        levels.append(level)
    chosen = levels.pop().select("run_id", "block", F.lit(0).alias("i"), F.lit(0).alias("j"))
    for level in reversed(levels):
        above = chosen.select("run_id", F.col("block").alias("group"), "i", "j")
        chosen = level.withColumn("group", F.expr(f"block div {fan}")).join(above, ["run_id", "group"]).groupBy("run_id", "group").applyInPandas(_chosen, "run_id string, block long, i int, j int")

    def cut_up(frame):
        y = _array(frame)
        starts, stops = _places(frame, len(y))
        start, at = int(starts[frame["i"].iloc[0]]), int(stops[frame["j"].iloc[0]])
        _, back = searched(y[:at], np.array([start]), penalty, least, cost)
        out = []
        while at > start:
            before = int(back[0, at]) if back[0, at] >= 0 else start
            out.append((frame["run_id"].iloc[0], int(frame["base"].iloc[0]) + before, int(frame["base"].iloc[0]) + at, off(y[before:at], cost)))
            at = before
        return pd.DataFrame(out, columns=["run_id", "start", "stop", "off"])

    ends = own.join(chosen, ["run_id", "block"]).groupBy("run_id", "block").applyInPandas(cut_up, "run_id string, start long, stop long, off double")
    first = rows.groupBy("run_id").agg((F.min("bin") - F.min("at")).alias("first"))
    return ends.join(first, "run_id").select("run_id", (F.col("start") + F.col("first")).alias("start_bin"), (F.col("stop") + F.col("first")).alias("stop_bin"), "off")


MATRIX = "run_id string, block long, entries int, costs binary"


def _matrices(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(c).reshape(n, -1) for n, c in zip(frame["entries"], frame["costs"])]


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("block")
    total, *rest = _matrices(frame)
    for m in rest:
        total = product(total, m)
    return pd.DataFrame({"run_id": [frame["run_id"].iloc[0]], "block": [frame["group"].iloc[0]], "entries": [len(total)], "costs": [total.tobytes()]})


def _chosen(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("block")
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    stops = through(_matrices(frame), i, j)
    return pd.DataFrame({"run_id": frame["run_id"], "block": frame["block"], "i": np.array([i, *stops[:-1]], "int32"), "j": np.array(stops, "int32")})


def labelled(segs: DataFrame) -> DataFrame:
    """run_id, bin, start_bin: every bin with the first bin of its segment."""
    return segs.select("run_id", "start_bin", F.explode(F.sequence("start_bin", F.col("stop_bin") - 1)).alias("bin"))


def long_penalty_grid(signal: DataFrame, penalties: list[float], least: int = 2, value: str = "x", cost: str = "l2", stretch: int = STRETCH) -> DataFrame:
    """run_id, penalty, segments, cost: the cost of a segment is told by the task that finds it."""
    rows, out = stored(vectors(signal, value), "vectors"), None
    for p in penalties:
        segs = segmented(rows, p, least, cost, stretch).withColumn("penalty", F.lit(float(p)))
        out = segs if out is None else out.unionByName(segs)
    return out.groupBy("run_id", "penalty").agg(F.count(F.lit(1)).alias("segments"), F.sum("off").alias("cost"))

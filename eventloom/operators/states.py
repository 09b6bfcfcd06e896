"""Runs, segments, dwell times, transitions, templates and cleaning of label series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.numeric import div
from eventloom.operators import sequence
from eventloom.sources.stored import stored

RUN = ["run_id"]


def segments(labels: DataFrame, by: list[str] = RUN, dt: float = 1.0, value: str = "label") -> DataFrame:
    """Maximal runs of one value: start_bin, stop_bin (exclusive), state, times, durations."""
    out = sequence.run_lengths(labels, value, by).withColumnRenamed("first", "start_bin").withColumn("stop_bin", F.col("last") + 1)
    length = F.col("stop_bin") - F.col("start_bin")
    return out.select(*by, "start_bin", "stop_bin", "state", (F.col("start_bin") * dt).alias("start_time"), (F.col("stop_bin") * dt).alias("stop_time"), length.alias("duration_bins"), (length * dt).alias("duration_time"))


def dwell_times(segs: DataFrame, by: list[str] = RUN) -> DataFrame:
    """Durations of each state in order of time."""
    return segs.groupBy(*by, "state").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_bin", "duration_time"))), lambda s: s["duration_time"]).alias("dwells"))


def dwell_summary(segs: DataFrame, by: list[str] = RUN, exclude_edges: bool = False) -> DataFrame:
    """n, mean, std (sample; 0 for one) and median of durations per state."""
    if exclude_edges:
        segs = segs.join(segs.groupBy(*by).agg(F.min("start_bin").alias("low"), F.max("start_bin").alias("high")), by).where("start_bin > low and start_bin < high")
    return segs.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_time").alias("mean"), F.coalesce(F.stddev_samp("duration_time"), F.lit(0.0)).alias("std"), F.percentile("duration_time", F.lit(0.5)).alias("median"))


def transitions(segs: DataFrame, by: list[str] = RUN) -> DataFrame:
    """Shares of the states that follow each state's segments, zeros included."""
    moves = sequence.neighbour(segs, "start_bin", "state", "dst", by, ahead=True).where("dst is not null").groupBy(*by, F.col("state").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))
    states = segs.select(*by, "state").distinct()
    full = states.withColumnRenamed("state", "src").join(states.withColumnRenamed("state", "dst"), by)
    total = F.sum("n").over(Window.partitionBy(*by, "src"))
    return full.join(moves, [*by, "src", "dst"], "left").select(*by, "src", "dst", F.coalesce(div(F.coalesce("n", F.lit(0)), total), F.lit(0.0)).alias("p"))


def occupancy(segs: DataFrame, by: list[str] = RUN) -> DataFrame:
    own = segs.groupBy(*by, "state").agg(F.sum("duration_time").alias("d"))
    return own.select(*by, "state", div(F.col("d"), F.sum("d").over(Window.partitionBy(*by))).alias("share"))


def survival(segs: DataFrame, by: list[str] = RUN) -> DataFrame:
    """1 - rank / n of every dwell of a state."""
    w = Window.partitionBy(*by, "state")
    return segs.select(*by, "state", "start_bin", "duration_time", (1 - F.row_number().over(w.orderBy("duration_time", "start_bin")) / F.count(F.lit(1)).over(w)).alias("survival"))


def fill_gaps(active: DataFrame, most: int, by: list[str] = ["run_id", "cluster"]) -> DataFrame:
    """Inner runs of zeros of up to `most` bins become ones."""
    return _flip(active, by, lambda s: (F.col("state") == 0) & (F.col("duration_bins") <= most) & F.col("inner"), inner=True)


def drop_short(active: DataFrame, value: int, least: int, by: list[str] = ["run_id", "cluster"]) -> DataFrame:
    """Runs of `value` shorter than `least` bins are flipped, at the ends too."""
    return _flip(active, by, lambda s: (F.col("state") == value) & (F.col("duration_bins") < least))


def clean(active: DataFrame, gap: int, least_on: int, least_off: int) -> DataFrame:
    """Gaps, then short runs of ones, then short runs of zeros."""
    filled = stored(fill_gaps(active, gap), "filled")
    return drop_short(stored(drop_short(filled, 1, least_on), "cleaned"), 0, least_off)


def _flip(active: DataFrame, by: list[str], rule, inner: bool = False) -> DataFrame:
    segs = segments(active, by, value="active")
    if inner:
        ends = active.groupBy(*by).agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
        segs = segs.join(ends, by).withColumn("inner", (F.col("start_bin") > F.col("low")) & (F.col("stop_bin") <= F.col("high")))
    segs = segs.withColumn("active", F.when(rule(segs), 1 - F.col("state")).otherwise(F.col("state")))
    return segs.select(*by, "active", F.explode(F.sequence("start_bin", F.col("stop_bin") - 1)).alias("bin"))


def short_removed(labels: DataFrame, least: int, strategy: str = "previous", by: list[str] = RUN) -> DataFrame:
    """by, bin, label: the leftmost run shorter than least takes its left ('previous') or right
    ('next') neighbour's label, again and again, until none is left or one run remains.

    Runs of at least that length keep their label, so a series falls apart there. To the left:
    each short run ends up with the label of the last kept run before it, a running value; the
    series' first kept run is the one whose end is `least` bins from the start. To the right: what
    stands between two kept runs is an island of its own, cleaned run by run in one task."""
    segs = segments(labels, by, value="label").select(*by, "start_bin", "stop_bin", "state", "duration_bins")
    whole = labels.groupBy(*by).agg(F.min("bin").alias("low"), F.max_by("label", "bin").alias("final"))
    segs = segs.join(whole, by)
    if strategy == "previous":
        reach = F.col("stop_bin") - F.col("low") >= least
        first = segs.where(reach).groupBy(*by).agg(F.min("stop_bin").alias("begun"), F.min_by("state", "stop_bin").alias("start_label"))
        told = segs.join(first, by, "left").withColumn("kept", reach & ((F.col("duration_bins") >= least) | (F.col("stop_bin") == F.col("begun"))))
        told = sequence.last_known(told, "start_bin", F.when(F.col("kept"), F.col("state")), "label", by)
        told = told.withColumn("label", F.coalesce("label", "start_label", "final"))
        return told.select(*by, "label", F.explode(F.sequence("start_bin", F.col("stop_bin") - 1)).alias("bin")).select(*by, "bin", "label")
    long = F.col("duration_bins") >= least
    told = sequence.last_known(segs, "start_bin", F.when(long, F.col("start_bin")), "island", by)
    # an island: a kept run, the short ones behind it and, as their last neighbour, the next kept run
    told = told.withColumn("island", F.coalesce("island", F.col("low") - 1))
    told = sequence.neighbour(told, "start_bin", "island", "before", by)
    edge = long & F.col("before").isNotNull()
    told = told.select(*by, "start_bin", "stop_bin", "state", F.explode(F.when(edge, F.array(F.struct(F.col("island").alias("i"), F.lit(True).alias("own")), F.struct(F.col("before").alias("i"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("island").alias("i"), F.lit(True).alias("own"))))).alias("p")).select(*by, "start_bin", "stop_bin", "state", "p.i", "p.own")

    def clean_island(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start_bin")
        runs = [[a, b, v] for a, b, v in zip(frame["start_bin"], frame["stop_bin"], frame["state"])]
        ends = {a: (b, own) for a, b, own in zip(frame["start_bin"], frame["stop_bin"], frame["own"])}
        done: list[list] = []
        for run in runs:  # a short run waits for what comes; the last one goes back
            if done and (done[-1][1] - done[-1][0] < least or done[-1][2] == run[2]):
                done[-1][1], done[-1][2] = run[1], run[2]
            else:
                done.append(list(run))
            if len(done) > 1 and done[-1][2] == done[-2][2]:
                stop = done.pop()[1]
                done[-1][1] = stop
        if len(done) > 1 and done[-1][1] - done[-1][0] < least:
            stop = done.pop()[1]
            done[-1][1] = stop
        out = [(a, b, next(v for c, d, v in done if c <= a < d)) for a, (b, own) in ends.items() if own]
        keys = {c: pd.Series([frame[c].iloc[0]] * len(out), dtype=object) for c in by}
        return pd.DataFrame(keys | {"start_bin": [o[0] for o in out], "stop_bin": [o[1] for o in out], "label": [o[2] for o in out]})

    schema = segs.select(*by, "start_bin", "stop_bin", F.col("state").alias("label")).schema
    found = told.groupBy(*by, "i").applyInPandas(clean_island, schema)
    return found.select(*by, "label", F.explode(F.sequence("start_bin", F.col("stop_bin") - 1)).alias("bin")).select(*by, "bin", "label")


def median_filter(labels: DataFrame, width: int, by: list[str] = RUN) -> DataFrame:
    """Centred running median of a label per bin, even widths made odd, ends repeated. Stretches of
    bins get the bins that their windows reach, so no run is one window."""
    if width <= 1:
        return labels.select(*by, "bin", "label")
    half = (width + 1 - width % 2 if width % 2 == 0 else width) // 2
    ends = labels.groupBy(*by).agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.min_by("label", "bin").alias("f"), F.max_by("label", "bin").alias("l"))
    cut = sequence.with_halo(labels.select(*by, "bin", "label"), "bin", half, half, max(sequence.WIDTH, 4 * half))
    near = F.collect_list("label").over(Window.partitionBy(*by, "stretch").orderBy("bin").rangeBetween(-half, half))
    out = cut.withColumn("near", near).where("own").join(ends, by)
    pad = lambda v, k: F.array_repeat(v, F.greatest(k, F.lit(0)).cast("int"))
    every = F.array_sort(F.concat("near", pad(F.col("f"), F.col("low") + half - F.col("bin")), pad(F.col("l"), F.col("bin") + half - F.col("high"))))
    return out.select(*by, "bin", every[half].alias("label"))


def pattern_labels(active: DataFrame) -> DataFrame:
    """Per bin: the array of its clusters' states and its number in the order of arrays."""
    rows = active.groupBy("run_id", "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "active"))), lambda s: s["active"]).alias("pattern"))
    kinds = rows.select("run_id", "pattern").distinct().withColumn("label", F.dense_rank().over(Window.partitionBy("run_id").orderBy("pattern")) - 1)
    return rows.join(kinds, ["run_id", "pattern"]).select("run_id", "bin", "pattern", "label")


def state_means(signal: DataFrame, labels: DataFrame, value: str = "x") -> DataFrame:
    """Mean of each cluster in each state, 0 for a state without bins."""
    own = signal.join(labels.select("run_id", "bin", "label"), ["run_id", "bin"]).groupBy("run_id", F.col("label").alias("state"), "cluster").agg(F.avg(value).alias("mean"))
    full = own.select("run_id", "state").distinct().join(own.select("run_id", "cluster").distinct(), "run_id")
    return full.join(own, ["run_id", "state", "cluster"], "left").select("run_id", "state", "cluster", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def templates(means: DataFrame, threshold: float = 0.5) -> DataFrame:
    return means.withColumn("active", (F.col("mean") >= threshold).cast("int"))


def by_activity(means: DataFrame) -> DataFrame:
    """state to its rank by falling total mean."""
    total = means.groupBy("run_id", "state").agg(F.sum("mean").alias("total"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("total"), "state")) - 1)


def state_quality(signal: DataFrame, labels: DataFrame, value: str = "x") -> DataFrame:
    """Explained share of variance and number of states under 1 % of bins."""
    x = signal.join(labels.select("run_id", "bin", "label"), ["run_id", "bin"])
    m = state_means(signal, labels, value).withColumnRenamed("state", "label")
    g = x.groupBy("run_id", "cluster").agg(F.avg(value).alias("grand"))
    sums = x.join(m, ["run_id", "label", "cluster"]).join(g, ["run_id", "cluster"]).groupBy("run_id").agg(F.sum((F.col(value) - F.col("mean")) ** 2).alias("res"), F.sum((F.col(value) - F.col("grand")) ** 2).alias("tot"))
    few = labels.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("run_id"))).groupBy("run_id").agg(F.count_if(F.col("n") < 0.01 * F.col("all")).alias("degenerate"))
    return sums.join(few, "run_id").select("run_id", (1 - div(F.col("res"), F.col("tot"))).alias("explained"), "degenerate")


def segment_means(signal: DataFrame, segs: DataFrame, value: str = "x") -> DataFrame:
    """Mean per segment and cluster: the segments' bins meet the signal's by equality."""
    bins = segs.select("run_id", "start_bin", F.col("duration_bins"), F.explode(F.sequence("start_bin", F.col("stop_bin") - 1)).alias("bin"))
    return signal.join(bins, ["run_id", "bin"]).groupBy("run_id", "start_bin", "duration_bins", "cluster").agg(F.avg(value).alias("mean"), F.max(value).alias("max"), (F.max_by(value, "bin") - F.min_by(value, "bin")).alias("change"))


def adjacent_distances(means: DataFrame) -> DataFrame:
    """Least and median Euclidean distance of neighbouring segments' means."""
    told = sequence.neighbour(means, "start_bin", "mean", "before", ["run_id", "cluster"])
    d = told.withColumn("d", F.col("mean") - F.col("before")).groupBy("run_id", "start_bin").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("d"))
    return d.groupBy("run_id").agg(F.coalesce(F.min("d"), F.lit(float("inf"))).alias("least"), F.percentile("d", F.lit(0.5)).alias("median"))


def cluster_classes(active: DataFrame, segs: DataFrame, low: float = 0.05, high: float = 0.95, least: int = 2) -> DataFrame:
    """Occupancy and transitions of each cluster over segments, and its class."""
    told = sequence.neighbour(active, "start_bin", "active", "before", ["run_id", "cluster"])
    x = told.withColumn("move", F.coalesce((F.col("active") != F.col("before")).cast("int"), F.lit(0)))
    out = x.groupBy("run_id", "cluster").agg(div(F.sum(F.col("duration_bins") * F.col("active")), F.sum("duration_bins")).alias("occupancy"), F.sum("move").alias("moves"))
    kind = F.when(F.col("occupancy") <= low, "pinned_low").when(F.col("occupancy") >= high, "pinned_high").when(F.col("moves") < least, "ambiguous").otherwise("dynamic")
    return out.withColumn("kind", kind)


def onsets(states: DataFrame, by: list[str] = ["run_id", "unit"]) -> DataFrame:
    """Steps at which a 0/1 state turns 1; the first step never is one."""
    return sequence.neighbour(states, "step", "s", "before", by).where("before = 0 and s = 1").select(*by, "step")


def replayed(initial: DataFrame, log: DataFrame, stride: int, steps: int) -> DataFrame:
    """States at steps 0, stride, ... of initial(run_id, unit, s) under log(run_id, step,
    unit, delta), each after its own step's change, kept in {0, 1}."""
    at = (F.ceil(F.col("step") / stride) * stride).cast("long")
    change = log.groupBy("run_id", "unit", at.alias("step")).agg(F.sum("delta").alias("delta"))
    grid = initial.select("run_id", "unit", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((steps - 1) // stride * stride).cast("long"), F.lit(stride).cast("long"))).alias("step"))
    summed = sequence.total_so_far(grid.join(change, ["run_id", "unit", "step"], "left"), "step", F.coalesce("delta", F.lit(0)), "total", ["run_id", "unit"])
    return summed.select("run_id", "unit", "step", F.greatest(F.lit(0), F.least(F.lit(1), F.col("s") + F.col("total"))).cast("int").alias("s"))


def population_rates(initial: DataFrame, log: DataFrame, members: DataFrame, stride: int, steps: int) -> DataFrame:
    """Mean state per population(run_id, unit, pop) at sampled steps: sums of changes per
    population and sample, then one running sum of those."""
    m = members
    base = initial.join(m, ["run_id", "unit"]).groupBy("run_id", "pop").agg(F.sum("s").alias("base"), F.count(F.lit(1)).alias("size"))
    at = (F.ceil(F.col("step") / stride) * stride).cast("long")
    change = log.join(m, ["run_id", "unit"]).groupBy("run_id", "pop", at.alias("step")).agg(F.sum("delta").alias("delta"))
    grid = base.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((steps - 1) // stride * stride).cast("long"), F.lit(stride).cast("long"))).alias("step"))
    summed = sequence.total_so_far(grid.join(change, ["run_id", "pop", "step"], "left"), "step", F.coalesce("delta", F.lit(0)), "total", ["run_id", "pop"])
    return summed.select("run_id", "pop", "step", div(F.col("base") + F.col("total"), F.col("size")).alias("rate"))

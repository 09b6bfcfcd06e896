"""Binning, selection and reshaping of event trains and signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.operators import sequence
from eventloom.functions.quantiles import quantiles


def grid(t0: float, t1: float, dt: float) -> tuple[float, int]:
    """First edge and number of bins: edges t0, t0 + dt, ... up to t1; fine grids (dt <= 1)
    are moved back by half a bin."""
    edges = math.ceil((t1 + dt - t0) / dt)
    return (t0 - dt / 2 if dt <= 1 else t0), edges - 1


def spine(units: DataFrame, bins: int) -> DataFrame:
    """Every unit with every bin."""
    return units.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))


def _in_bins(spikes: DataFrame, t0: float, t1: float, dt: float) -> DataFrame:
    """Events in [t0, t1) with their bin."""
    e0, bins = grid(t0, t1, dt)
    at = F.floor((F.col("t") - e0) / dt)
    at = F.when(F.col("t") == e0 + bins * dt, bins - 1).otherwise(at)  # the last bin is closed
    return spikes.where((F.col("t") >= t0) & (F.col("t") < t1)).withColumn("bin", at.cast("long")).where(F.col("bin").between(0, bins - 1))


def binned(spikes: DataFrame, units: DataFrame, t0: float, t1: float, dt: float) -> DataFrame:
    """run_id, unit, bin, time, n: counts of every unit in every bin, zeros included."""
    e0, bins = grid(t0, t1, dt)
    counts = _in_bins(spikes, t0, t1, dt).groupBy("run_id", "unit", "bin").agg(F.count(F.lit(1)).alias("n"))
    full = spine(units.select("run_id", "unit"), bins).join(counts, ["run_id", "unit", "bin"], "left")
    return full.select("run_id", "unit", "bin", (F.lit(e0) + F.col("bin") * dt).alias("time"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def binned_totals(spikes: DataFrame, units: DataFrame, t0: float, t1: float, dt: float) -> DataFrame:
    """run_id, bin, time, n, units: the sums of binned() over the units of each run. Only events
    and units meet, by equality; a run's bins are made once and not for every unit."""
    e0, bins = grid(t0, t1, dt)
    own = units.select("run_id", "unit")
    counts = _in_bins(spikes, t0, t1, dt).select("run_id", "unit", "bin").join(own, ["run_id", "unit"]).groupBy("run_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    full = spine(own.groupBy("run_id").agg(F.count(F.lit(1)).alias("units")), bins).join(counts, ["run_id", "bin"], "left")
    return full.select("run_id", "bin", (F.lit(e0) + F.col("bin") * dt).alias("time"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "units")


def cluster_signal(events: DataFrame, clusters: DataFrame, t0: float, bins: int, dt: float) -> DataFrame:
    """run_id, cluster, bin, n, x: counts and summed values by left-edged bins from t0."""
    at = F.floor((F.col("t") - t0) / dt)
    kept = events.withColumn("bin", at).where(F.col("bin").between(0, bins - 1))
    sums = kept.groupBy("run_id", "cluster", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("x"))
    full = spine(clusters.select("run_id", "cluster"), bins).join(sums, ["run_id", "cluster", "bin"], "left")
    return full.select("run_id", "cluster", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("x", F.lit(0.0)).alias("x"))


def time_limits(spikes: DataFrame) -> DataFrame:
    """[min, max + 1) per run, [0, 1) for runs without times."""
    return spikes.groupBy("run_id").agg(F.coalesce(F.min("t"), F.lit(0.0)).alias("t0"), F.coalesce(F.max("t") + 1, F.lit(1.0)).alias("t1"))


def cut(spikes: DataFrame, t0: float, t1: float) -> DataFrame:
    """Events in [t0, t1); units live on in their dimension."""
    return spikes.where((F.col("t") >= t0) & (F.col("t") < t1))


def to_events(counts: DataFrame) -> DataFrame:
    """Counts back to events at the bins' times, as many as counted."""
    return counts.where("n > 0").select("run_id", "unit", F.explode(F.array_repeat("time", F.col("n").cast("int"))).alias("t"))


def trains(spikes: DataFrame, units: DataFrame) -> DataFrame:
    """Sorted times of every unit; none is an empty array."""
    have = spikes.groupBy("run_id", "unit").agg(F.array_sort(F.collect_list("t")).alias("times"))
    return units.select("run_id", "unit").join(have, ["run_id", "unit"], "left").select("run_id", "unit", F.coalesce("times", F.array().cast("array<double>")).alias("times"))


def rates(counts: DataFrame, dt: float, sizes: DataFrame | None = None) -> DataFrame:
    """Counts per unit of time, and per member where sizes (cluster, size) are given."""
    if sizes is None:
        return counts.withColumn("rate", F.col("n") / F.lit(float(dt)))
    joined = counts.join(sizes, "cluster", "left")
    return joined.withColumn("rate", F.col("n") / F.lit(float(dt)) / F.greatest(F.coalesce("size", F.lit(1)), F.lit(1))).drop("size")


def transformed(x: Column, how: str, unit: Column | None = None) -> Column:
    """'identity', 'sqrt' of the non-negative part, or 'asinh' of x / unit."""
    if how == "sqrt":
        return F.sqrt(F.greatest(x, F.lit(0.0)))
    if how == "asinh":
        return F.asinh(x / unit)
    return x


def asinh_activity(signal: DataFrame, value: str = "x", most: int | None = None) -> DataFrame:
    """asinh(x / r0) with r0 the run's median of positive values (1 without any)."""
    r0 = quantiles(signal, ["run_id"], F.when(F.col(value) > 0, F.col(value)), {"r0": 0.5}, most).select("run_id", F.coalesce("r0", F.lit(1.0)).alias("r0"))
    return signal.join(r0, "run_id").withColumn("y", F.asinh(F.col(value) / F.col("r0")))


def zscored(signal: DataFrame, value: str = "x") -> DataFrame:
    """Per cluster; a constant cluster is only centred."""
    s = signal.groupBy("run_id", "cluster").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return signal.join(s, ["run_id", "cluster"]).withColumn("z", (F.col(value) - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).drop("m", "s")


def run_scaled(signal: DataFrame, value: str = "x", eps: float = 1e-9, most: int | None = None) -> DataFrame:
    """(x - median) / (q95 - q05) over all clusters of a run; a flat run is only centred. most:
    as in quantiles(), values of a run."""
    q = quantiles(signal, ["run_id"], value, {"q05": 0.05, "q50": 0.5, "q95": 0.95}, most)
    width = F.col("q95") - F.col("q05")
    return signal.join(q, "run_id").withColumn("y", (F.col(value) - F.col("q50")) / F.when(width < eps, 1.0).otherwise(width)).drop("q05", "q50", "q95")


def thresholds(signal: DataFrame, mode: str, value: str = "x", level: float = 0.5, factor: float = 1.0, most: int | None = None) -> DataFrame:
    """run_id, cluster, threshold by 'fixed', 'percentile' (level in [0, 1]) or 'std'. most: as
    in quantiles(), values of a cluster."""
    if mode == "percentile":
        return quantiles(signal, ["run_id", "cluster"], value, {"threshold": level}, most)
    how = {"fixed": F.max(F.lit(level)), "std": F.avg(value) + factor * F.stddev_pop(value)}[mode]
    return signal.groupBy("run_id", "cluster").agg(how.alias("threshold"))


def binarized(signal: DataFrame, mode: str = "percentile", value: str = "x", level: float = 0.5, factor: float = 1.0, most: int | None = None) -> DataFrame:
    """signal with active = value at or above the cluster's threshold."""
    limit = thresholds(signal, mode, value, level, factor, most)
    return signal.join(limit, ["run_id", "cluster"]).withColumn("active", (F.col(value) >= F.col("threshold")).cast("int"))


def hysteresis(signal: DataFrame, low: float, high: float, value: str = "x") -> DataFrame:
    """On from a value of high, off from one under low, else as before; off at the start."""
    event = F.when(F.col(value) >= high, 1).when(F.col(value) < low, 0)
    return sequence.last_known(signal, "bin", event, "active", ["run_id", "cluster"]).withColumn("active", F.coalesce("active", F.lit(0)))


def select_clusters(signal: DataFrame, clusters: DataFrame, mode: str = "all", names: list[str] | None = None, groups: list[int] | None = None) -> DataFrame:
    """Rows of the chosen clusters(cluster, name, cell_type, group_id)."""
    kind = F.upper(F.coalesce("cell_type", "name"))
    rule = {"all": F.lit(True), "excitatory": kind.like("E%"), "inhibitory": kind.like("I%"), "names": F.col("name").isin(*(names or [])), "group_ids": F.col("group_id").isin(*(groups or []))}[mode]
    return signal.join(clusters.where(rule).select("cluster"), "cluster", "left_semi")


def raster(spikes: DataFrame, t0: float, t1: float, stride: int = 1, reference: float = 0.0) -> DataFrame:
    """Events in [t0, t1] (both ends) of every stride-th unit, relative to a reference."""
    return spikes.where(F.col("t").between(t0, t1) & (F.pmod("unit", F.lit(stride)) == 0)).withColumn("t", F.col("t") - reference)


def thinned(spikes: DataFrame, most: int) -> DataFrame:
    """At most `most` events per run, evenly spaced in (t, unit) order."""
    ranked = sequence.numbered(spikes, ["t", "unit"])
    slot = F.floor(F.col("i") * (most - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    before = F.floor((F.col("i") - 1) * (most - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    return ranked.where((F.col("n") <= most) | (F.col("i") == 0) | (slot > before)).drop("i", "n")


def segmentation_labels(breaks: DataFrame, bins: int) -> DataFrame:
    """run_id, breaks 'a;b,c' to one label per bin."""
    cuts = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("breaks", "[;,]"), lambda s: F.least(F.greatest(F.trim(s).try_cast("long"), F.lit(0)), F.lit(bins)).cast("long")), lambda b: b.isNotNull() & (b > 0) & (b < bins))))
    return breaks.withColumn("cuts", cuts).select("run_id", "cuts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin")).select("run_id", "bin", F.size(F.filter("cuts", lambda b: b <= F.col("bin"))).cast("long").alias("label"))


def cluster_units(spikes: DataFrame, excitatory: int, size: int) -> DataFrame:
    """Events of the first `excitatory` units with their cluster of `size` units."""
    return spikes.where((F.col("unit") >= 0) & (F.col("unit") < excitatory)).withColumn("cluster", F.floor(F.col("unit") / size))


def missing_units(spikes: DataFrame, units: DataFrame) -> DataFrame:
    """Units without events."""
    return units.select("run_id", "unit").join(spikes.select("run_id", "unit"), ["run_id", "unit"], "left_anti")


def population_ranges(populations: DataFrame) -> DataFrame:
    """start and end ids of populations(run_id, pop, size), laid out one after another."""
    order = Window.partitionBy("run_id").orderBy("pop")
    end = F.sum("size").over(order)
    return populations.withColumn("end_id", end).withColumn("start_id", F.col("end_id") - F.col("size"))


def infer_dt(times: DataFrame) -> DataFrame:
    """Median positive step of the distinct times of each run, 1 without one."""
    steps = sequence.lagged(times.select("run_id", "t").distinct(), "t", "before").withColumn("step", F.col("t") - F.col("before"))
    return steps.groupBy("run_id").agg(F.coalesce(F.percentile(F.when(F.col("step") > 0, F.col("step")), F.lit(0.5)), F.lit(1.0)).alias("dt"))

"""Interval statistics, Fano factors, synchrony and sliding or warped windows of event trains."""

from __future__ import annotations

import math
from fractions import Fraction
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.numeric import div
from eventloom.operators import sequence
from eventloom.operators.binning import binned

UNIT = ["run_id", "unit"]
#: Knots that are sent to every task, at most.
KNOTS = 100_000


def interval_pairs(spikes: DataFrame, by: list[str] = UNIT) -> DataFrame:
    """Events with the interval before and the one after (a, b); NULL at the ends."""
    w = Window.partitionBy(*by).orderBy("t")
    return spikes.withColumn("a", F.col("t") - F.lag("t").over(w)).withColumn("b", F.lead("t").over(w) - F.col("t"))


def variability(spikes: DataFrame, by: list[str] = UNIT, min_pairs: int = 20, ddof: int = 0) -> DataFrame:
    """Per group: n_isi, cv2 = var / mean^2 of intervals (of groups with more than two
    events), cv_two = mean of 2|a-b|/(a+b) and lv = mean of 3(a-b)^2/(a+b)^2 over neighbouring
    intervals, both NULL under min_pairs pairs. One sort of the trains serves all."""
    pairs = interval_pairs(spikes, by)
    total = F.col("a") + F.col("b")
    var = F.var_samp("a") if ddof else F.var_pop("a")
    own = pairs.groupBy(*by).agg(
        F.count("a").alias("n_isi"), F.count(total).alias("n_pairs"), var.alias("v"), F.avg("a").alias("m"),
        F.avg(div(2 * F.abs(F.col("a") - F.col("b")), total)).alias("two"),
        F.avg(div(3 * (F.col("a") - F.col("b")) ** 2, total * total)).alias("l"),
    )
    return own.select(
        *by, "n_isi", F.when(F.col("n_isi") >= 2, div(F.col("v"), F.col("m") * F.col("m"))).alias("cv2"),
        F.when(F.col("n_pairs") >= min_pairs, F.col("two")).alias("cv_two"),
        F.when(F.col("n_pairs") >= min_pairs, F.col("l")).alias("lv"),
    )


def pooled_cv2(spikes: DataFrame, by: list[str] = ["run_id"]) -> DataFrame:
    """CV2 of all intervals of a run's units together."""
    return interval_pairs(spikes).groupBy(*by).agg(div(F.var_pop("a"), F.avg("a") ** 2).alias("cv2"))


def fano(spikes: DataFrame, units: DataFrame, t0: float, t1: float, min_trials: int = 1) -> DataFrame:
    """var / mean of the counts of all units in [t0, t1); units without events count 0."""
    n = spikes.where((F.col("t") >= t0) & (F.col("t") < t1)).groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"))
    full = units.select(*UNIT).join(n, UNIT, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    out = full.groupBy("run_id").agg(F.var_pop("n").alias("v"), F.avg("n").alias("m"), F.count(F.lit(1)).alias("k"))
    return out.select("run_id", F.when(F.col("k") >= min_trials, div(F.col("v"), F.col("m"))).alias("ff"))


def synchrony(counts: DataFrame, ignore_silent: bool = False) -> DataFrame:
    """sqrt(var over bins of the unit mean / mean over units of their variance)."""
    per_unit = counts.groupBy(*UNIT).agg(F.var_pop("n").alias("v"), F.sum("n").alias("total"))
    if ignore_silent:
        per_unit = per_unit.where("total > 0")
        counts = counts.join(per_unit.select(*UNIT), UNIT, "left_semi")
    top = counts.groupBy("run_id", "bin").agg(F.avg("n").alias("m")).groupBy("run_id").agg(F.var_pop("m").alias("top"))
    low = per_unit.groupBy("run_id").agg(F.avg("v").alias("low"))
    return top.join(low, "run_id").select("run_id", F.sqrt(div(F.col("top"), F.col("low"))).alias("chi"))


def sliding_counts(counts: DataFrame, width: int) -> DataFrame:
    """Counts of `width` bins from each bin on, whole windows only."""
    cut = sequence.with_halo(counts, "bin", width - 1, 0, max(sequence.WIDTH, 4 * width))
    w = Window.partitionBy(*UNIT, "stretch").orderBy("bin").rowsBetween(0, width - 1)
    return cut.withColumn("total", F.sum("n").over(w)).withColumn("k", F.count(F.lit(1)).over(w)).where((F.col("k") == width) & F.col("own")).select(*UNIT, "bin", "total")


def kernel_fano(counts: DataFrame, width: int) -> DataFrame:
    """Fano factor across units of the sliding counts at each bin."""
    out = sliding_counts(counts, width).groupBy("run_id", "bin").agg(F.var_pop("total").alias("v"), F.avg("total").alias("m"))
    return out.select("run_id", "bin", F.col("v").alias("var"), F.col("m").alias("mean"), div(F.col("v"), F.col("m")).alias("ff"))


def windowed(spikes: DataFrame, t0: float, t1: float, width: float, step: float, closed: str = "left") -> DataFrame:
    """Each event once per window that holds it, with the window's number k (start t0 + k *
    step). closed 'left': [a, a + width) while a + width <= t1; 'right': (a, a + width] while
    a + width < t1."""
    n = int((t1 - t0 - width) // step) if t1 - t0 >= width else -1
    if closed == "right" and n >= 0 and t0 + n * step + width >= t1:
        n -= 1
    if n < 0:
        return spikes.where("false").withColumn("k", F.lit(0).cast("long"))
    past = (F.col("t") - t0) / step
    if closed == "left":
        last, first = F.floor(past), F.floor((F.col("t") - t0 - width) / step) + 1
    else:
        last, first = F.ceil(past) - 1, F.ceil((F.col("t") - t0 - width) / step)
    first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(n))
    return spikes.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("k", F.explode(F.sequence("first", "last"))).drop("first", "last")


def time_resolved(spikes: DataFrame, t0: float, t1: float, width: float, step: float, aggs: list[Column]) -> DataFrame:
    """Built-in aggregates in each window, at its centre."""
    out = windowed(spikes, t0, t1, width, step).groupBy("run_id", "k").agg(*aggs)
    return out.withColumn("time", F.lit(t0) + F.col("k") * step + (width - step) / 2)


def time_resolved_counts(spikes: DataFrame, t0: float, t1: float, width: float, step: float) -> DataFrame:
    """run_id, k, time, n and n_units (distinct) of the windows of time_resolved() that hold events,
    from panes: an event is counted once, in its pane of the common measure of width and step.
    A pane's events enter the windows that begin up to a width before it, and a unit those
    among them that hold no earlier pane of its own, so both are running sums over panes of what
    enters and leaves; rows don't grow with width / step."""
    a, b = Fraction(width), Fraction(step)
    measure = Fraction(math.gcd(a.numerator * b.denominator, b.numerator * a.denominator), a.denominator * b.denominator)
    pane, across, every = float(measure), int(a / measure), int(b / measure)
    windows = int((t1 - t0 - width) // step) + 1 if t1 - t0 >= width else 0
    own = spikes.where((F.col("t") >= t0) & (F.col("t") < t1)).groupBy(*UNIT, F.floor((F.col("t") - t0) / pane).alias("pane")).agg(F.count(F.lit(1)).alias("n"))
    own = sequence.neighbour(own, "pane", "pane", "before", UNIT)
    change = lambda at, n, units: F.struct(at.alias("at"), n.alias("n"), units.alias("n_units"))
    enters, leaves, none = F.col("pane") - across + 1, F.col("pane") + 1, F.lit(0).cast("long")
    first = F.greatest(enters, F.coalesce(F.col("before") + 1, enters))
    moves = own.select("run_id", F.explode(F.array(change(enters, F.col("n"), none), change(first, none, none + 1), change(leaves, -F.col("n"), none - 1))).alias("m")).select("run_id", "m.*")
    grid = spikes.select("run_id").distinct().select("run_id", F.explode(F.sequence(none, F.lit((windows - 1) * every).cast("long"), F.lit(every).cast("long"))).alias("at"), none.alias("n"), none.alias("n_units")) if windows else moves.where("false")
    steps = moves.unionByName(grid).groupBy("run_id", "at").agg(F.sum("n").alias("dn"), F.sum("n_units").alias("du"))
    full = sequence.total_so_far(sequence.total_so_far(steps, "at", F.col("dn"), "n"), "at", F.col("du"), "n_units")
    out = full.where((F.col("at") >= 0) & (F.col("at") <= (windows - 1) * every) & (F.col("at") % every == 0) & (F.col("n") > 0)).withColumn("k", F.expr(f"at div {every}"))
    return out.select("run_id", "k", "n", "n_units", (F.lit(t0) + F.col("k") * step + (width - step) / 2).alias("time"))


def time_resolved_grid(spikes: DataFrame, t0: float, t1: float, width: float, step: float, aggs: list[Column]) -> DataFrame:
    """time_resolved() on times and window bounds cut down to whole units of time, at the middle
    of each window."""
    whole = spikes.withColumn("t", F.floor("t").cast("double"))
    out = windowed(whole, math.floor(t0), math.floor(t1), math.floor(width), math.floor(step)).groupBy("run_id", "k").agg(*aggs)
    return out.withColumn("time", F.lit(float(math.floor(t0))) + F.col("k") * math.floor(step) + math.floor(width) / 2)


def auto_window(spikes: DataFrame, ot: float = 5.0) -> DataFrame:
    """Per run: ot times the mean over units of their mean intervals."""
    per = interval_pairs(spikes, UNIT).groupBy(*UNIT).agg(F.avg("a").alias("isi"))
    return per.groupBy("run_id").agg((F.avg("isi") * ot).alias("width"))


def warp_knots(spikes: DataFrame, units: DataFrame, t0: float, t1: float, dt: float) -> DataFrame:
    """(run_id, x, y): real times and the cumulative mean rate up to them, from (t0, 0) on."""
    per_bin = binned(spikes, units, t0, t1, dt).groupBy("run_id", "bin", "time").agg(F.avg("n").alias("m"))
    total = F.sum("m").over(Window.partitionBy("run_id").orderBy("bin"))
    start = units.select("run_id").distinct().select("run_id", F.lit(float(t0)).alias("x"), F.lit(0.0).alias("y"))
    return per_bin.select("run_id", (F.col("time") + dt).alias("x"), total.alias("y")).unionByName(start)


def warped_back(rows: DataFrame, knots: DataFrame, time: str) -> DataFrame:
    """rows whose `time` is on the warped axis, with real_time beside it."""
    back = knots.groupBy("run_id", F.col("y").alias("x")).agg(F.min("x").alias("y"))
    return as_of_map(rows.withColumn("t", F.col(time)), back).withColumnRenamed("y", "real_time").drop("t")


def time_warped(spikes: DataFrame, units: DataFrame, t0: float, t1: float, dt: float, width: float, step: float, func: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """Windows of even rate: events are moved to the axis of cumulative rate, func(events, end)
    gives (run_id, k, time, ...) there, and times are mapped back. end: the axis's last value."""
    knots = warp_knots(spikes, units, t0, t1, dt)
    warped = as_of_map(spikes, knots).where("y is not null").select(*UNIT, F.col("y").alias("t"))
    end = knots.agg(F.max("y")).first()[0] or 0.0
    return warped_back(func(warped, end), knots, "time")


def time_warped_cv2(spikes: DataFrame, units: DataFrame, t0: float, t1: float, dt: float, width: float, step: float) -> DataFrame:
    """CV2 in windows of the warped axis, at their middles in real time."""
    return time_warped(spikes, units, t0, t1, dt, width, step, lambda x, end: time_resolved_cv2(x, 0.0, end, width, step))


def time_resolved_call(spikes: DataFrame, t0: float, t1: float, width: float, step: float, func: Callable) -> DataFrame:
    """A Python callable on the (unit, t) frame of each window, in order of time."""
    import pandas as pd

    def run(key, frame):
        return pd.DataFrame({"run_id": [key[0]], "k": [key[1]], "value": [float(func(frame[["unit", "t"]].sort_values(["t", "unit"])))]})

    return windowed(spikes, t0, t1, width, step).groupBy("run_id", "k").applyInPandas(run, "run_id string, k long, value double")


def time_resolved_cv2(spikes: DataFrame, t0: float, t1: float, width: float, step: float) -> DataFrame:
    """CV2 in windows (a, a + width], pooled over units."""
    own = interval_pairs(windowed(spikes, t0, t1, width, step, "right"), [*UNIT, "k"])
    out = own.groupBy("run_id", "k").agg(div(F.var_pop("a"), F.avg("a") ** 2).alias("cv2"), F.count("a").alias("n"))
    return out.select("run_id", "k", (F.lit(t0) + F.col("k") * step + width / 2).alias("time"), F.when(F.col("n") >= 2, F.col("cv2")).alias("cv2"))


def time_resolved_cv_two(spikes: DataFrame, t0: float, t1: float, width: float, step: float, min_pairs: int = 20) -> DataFrame:
    """Mean of 2|a-b|/(a+b) over neighbouring intervals in windows [a, a + width)."""
    return variability_pooled(interval_pairs(windowed(spikes, t0, t1, width, step), [*UNIT, "k"]), ["run_id", "k"], min_pairs)


def variability_pooled(pairs: DataFrame, by: list[str], min_pairs: int) -> DataFrame:
    total = F.col("a") + F.col("b")
    out = pairs.groupBy(*by).agg(F.count(total).alias("n_pairs"), F.avg(div(2 * F.abs(F.col("a") - F.col("b")), total)).alias("two"))
    return out.select(*by, F.when(F.col("n_pairs") >= min_pairs, F.col("two")).alias("cv_two"))


def _between(knots: list, keys: int) -> Callable:
    """A function of the keys and t that interpolates between a bounded number of knots."""
    table: dict = {}
    for row in sorted(knots, key=lambda r: (r[keys], r[keys + 1])):
        table.setdefault(tuple(row[:keys]), ([], []))
        for values, v in zip(table[tuple(row[:keys])], row[keys:]):
            values.append(v)
    arrays = {k: (np.array(x), np.array(y, dtype=float)) for k, (x, y) in table.items()}

    def run(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for *own, t in columns:
            out = pd.Series(np.full(len(t), np.nan))
            for key, rows in pd.DataFrame(dict(enumerate(own))).groupby(list(range(keys)), dropna=False).indices.items():
                found = arrays.get(key if isinstance(key, tuple) else (key,))
                if found is not None:
                    x, y = found
                    at = t.to_numpy(dtype=float)[rows]
                    p, q = np.searchsorted(x, at, "right") - 1, np.searchsorted(x, at, "left")
                    ok = (p >= 0) & (q < len(x)) & ~np.isnan(at)
                    p, q = p[ok], q[ok]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        out.iloc[rows[ok]] = np.where(x[p] == x[q], y[p], y[p] + (at[ok] - x[p]) * ((y[q] - y[p]) / (x[q] - x[p])))
            yield out.where(out.notna(), None).astype("float64")

    told = F.pandas_udf(run, "double")
    return lambda *columns: F.nanvl(told(*columns), F.lit(None).cast("double"))


def as_of_map(events: DataFrame, knots: DataFrame, by: list[str] = ["run_id"]) -> DataFrame:
    """events(t) with y interpolated between knots(x, y); NULL outside. Up to KNOTS knots, which
    are counted, are looked up by binary search where events are read. More are merged with the
    events in one order, and those around an event are running values over pieces of the run."""
    few = knots.select(*by, F.col("x").cast("double"), F.col("y").cast("double")).where("x is not null").limit(KNOTS + 1).collect()
    if len(few) <= KNOTS:
        return events.withColumn("y", _between(few, len(by))(*by, F.col("t").cast("double")))
    none = F.lit(None).cast("struct<x:double,v:double>")
    own = knots.select(*by, F.col("x").alias("t"), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("v")).alias("knot"))
    both = events.withColumn("knot", none).withColumn("_event", F.lit(True)).unionByName(own, allowMissingColumns=True)
    seen = sequence.around(both, "t", "knot", by).where("_event")
    at = F.when(F.col("p.x") == F.col("q.x"), F.col("p.v")).otherwise(F.col("p.v") + (F.col("t") - F.col("p.x")) * div(F.col("q.v") - F.col("p.v"), F.col("q.x") - F.col("p.x")))
    return seen.withColumn("y", F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), at)).drop("knot", "_event", "p", "q")


def time_stretch(spikes: DataFrame, markers: DataFrame) -> DataFrame:
    """Map each unit's [start, stop] of markers(run_id, unit, start, stop) to the run's mean stop."""
    end = markers.groupBy("run_id").agg(F.avg("stop").alias("end"))
    m = markers.join(end, "run_id")
    return spikes.join(m, UNIT).withColumn("t", F.col("start") + (F.col("t") - F.col("start")) * div(F.col("end") - F.col("start"), F.col("stop") - F.col("start"))).drop("start", "stop", "end")


def rate_warped(spikes: DataFrame, units: DataFrame, t0: float, t1: float, dt: float) -> DataFrame:
    """Events on the axis of the cumulative mean rate of the run, where their rate is even."""
    return as_of_map(spikes, warp_knots(spikes, units, t0, t1, dt))


def gamma_trains(units: DataFrame, rate_hz: float, order: float, t1: float, seed: int) -> DataFrame:
    """Gamma renewal trains of every unit, order 1 being Poisson; each unit has its own stream."""
    import numpy as np
    import pandas as pd

    def run(frame):
        out = []
        for run_id, unit in zip(frame["run_id"], frame["unit"]):
            rng, parts, last = np.random.default_rng([seed, int(unit)]), [], 0.0
            while last < t1:
                step = rng.gamma(order, 1000 / (rate_hz * order), max(16, int(t1 * rate_hz / 1000)))
                parts.append(last + np.cumsum(step))
                last = parts[-1][-1]
            t = np.concatenate(parts)
            out.append(pd.DataFrame({"run_id": run_id, "unit": unit, "t": t[t < t1]}))
        return pd.concat(out) if out else pd.DataFrame({"run_id": [], "unit": [], "t": []})

    return units.select("run_id", "unit").mapInPandas(lambda it: (run(f) for f in it), "run_id string, unit long, t double")

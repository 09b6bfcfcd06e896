"""Choosing and checking the inputs of an analysis: feature matrices, id masks, group bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.operators import binning, kernels

#: Spellings of feature kinds: where values come from, and what is done to them.
KINDS = {
    "counts": ("n", ()), "raw_counts": ("n", ()), "sqrt_counts": ("n", ("sqrt",)), "zscore_counts": ("n", ("z",)), "counts_zscore": ("n", ("z",)),
    "sqrt_zscore": ("n", ("sqrt", "z")), "sqrt_counts_zscore": ("n", ("sqrt", "z")), "rates": ("x", ()), "raw_rates": ("x", ()),
    "zscore_rates": ("x", ("z",)), "rates_zscore": ("x", ("z",)), "smoothed_rates": ("x", ("smooth",)), "binary": ("x", ("binary",)), "temporal_window": ("x", ("lags",)),
}


def source(columns: list[str], wanted: str) -> str:
    """The column that a kind reads: rates (x) stand in for counts (n) and counts for rates."""
    for c in {"n": ("n", "x"), "x": ("x", "n"), "auto": ("x", "n", "active"), "binary": ("active",)}[wanted]:
        if c in columns:
            return c
    raise ValueError(f"there is no column for {wanted}")


def features(signal: DataFrame, kind: str, sigma: float = 1.0, level: float = 0.8, lags: int = 0) -> DataFrame:
    """run_id, cluster, bin, f of one of KINDS; a binary column is used as it is; with lags (or
    the kind temporal_window) also offset, one row for each neighbouring bin."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of features: {kind}")
    wanted, steps = KINDS[kind]
    if kind == "binary" and "active" in signal.columns:
        out = signal.withColumn("f", F.col("active").cast("double"))
    else:
        out = signal.withColumn("f", F.col(source(signal.columns, wanted)).cast("double"))
    for step in steps:
        if step == "sqrt":
            out = out.withColumn("f", binning.transformed(F.col("f"), "sqrt"))
        elif step == "z":
            out = binning.zscored(out, "f").withColumn("f", F.col("z"))
        elif step == "smooth" and sigma > 0:
            out = kernels.smoothed(out, sigma, "f").withColumn("f", F.col("smooth"))
        elif step == "binary" and "active" not in signal.columns:
            out = binning.binarized(out.drop("active", "threshold"), "percentile", "f", level).withColumn("f", F.col("active").cast("double"))
    out = out.select("run_id", "cluster", "bin", "f")
    if not lags:
        return out
    w = Window.partitionBy("run_id", "cluster").orderBy("bin")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = lambda k: F.coalesce(F.lead("f", k).over(w), F.last("f").over(whole)) if k > 0 else F.coalesce(F.lag("f", -k).over(w), F.first("f").over(whole)) if k else F.col("f")
    wide = out.select("run_id", "cluster", "bin", *(moved(k).alias(f"f{k}") for k in range(-lags, lags + 1)))
    near = F.array(*(F.struct(F.lit(k).alias("offset"), F.col(f"f{k}").alias("f")) for k in range(-lags, lags + 1)))
    return wide.select("run_id", "cluster", "bin", F.explode(near).alias("v")).select("run_id", "cluster", "bin", "v.*")


def reference(signal: DataFrame) -> Column:
    """The column that stands for activity: rates, else counts, else the binary state, chosen
    once for the whole table."""
    return F.col(source(signal.columns, "auto")).cast("double")


def binary_for(signal: DataFrame, again: bool = False, level: float = 0.8) -> DataFrame:
    """signal with active: the one it has, unless it is to be thresholded again."""
    if "active" in signal.columns and not again:
        return signal
    return binning.binarized(signal.drop("active", "threshold"), "percentile", source(signal.columns, "auto"), level).drop("threshold")


def problems(signal: DataFrame, clusters: DataFrame) -> DataFrame:
    """(run_id, problem, n) for each rule that a signal breaks: a row per cluster and bin,
    nothing unknown, counts not negative, bins from 0 without holes, clusters that are known."""
    cells = signal.groupBy("run_id", "cluster", "bin").agg(F.count(F.lit(1)).alias("k"))
    repeated = cells.where("k > 1").groupBy("run_id").agg(F.lit("repeated").alias("problem"), F.count(F.lit(1)).alias("n"))
    rule = lambda cond, name: signal.where(cond).groupBy("run_id").agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
    per = cells.groupBy("run_id", "cluster").agg(F.count(F.lit(1)).alias("bins"))
    last = signal.groupBy("run_id").agg((F.max("bin") + 1).alias("want"))
    holes = per.join(last, "run_id").where("bins <> want").groupBy("run_id").agg(F.lit("holes").alias("problem"), F.count(F.lit(1)).alias("n"))
    strange = signal.join(clusters.select("cluster"), "cluster", "left_anti").groupBy("run_id").agg(F.lit("unknown cluster").alias("problem"), F.countDistinct("cluster").alias("n"))
    out = rule("x IS NULL OR isnan(x)", "unknown value").unionByName(rule("n < 0", "negative count")).unionByName(repeated)
    return out.unionByName(holes).unionByName(strange)


def id_mask(spec, column: Column) -> Column:
    """A condition on ids from a slice or range (with its step), a list, or a function of the
    column."""
    if callable(spec):
        return spec(column)
    if isinstance(spec, slice):
        spec = range(spec.start or 0, spec.stop if spec.stop is not None else (1 << 62), spec.step or 1)
    if isinstance(spec, range):
        return (column >= spec.start) & (column < spec.stop) & ((column - spec.start) % spec.step == 0)
    return column.isin(*spec)


def group_bounds(units: DataFrame, groups: dict[str, object]) -> DataFrame:
    """(grp, low, high) of the ids that each group's spec names."""
    out = None
    for name, spec in groups.items():
        own = units.where(id_mask(spec, F.col("unit"))).agg(F.min("unit").alias("low"), F.max("unit").alias("high")).withColumn("grp", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out.where("low is not null").select("grp", "low", "high")


def step_bounds(values: DataFrame, value: str = "v") -> DataFrame:
    """Edges halfway between neighbouring distinct values, and as far beyond the ends."""
    w = Window.orderBy("v")  # a row per distinct value of a palette
    v = values.select(F.col(value).cast("double").alias("v")).distinct()
    x = v.withColumn("before", F.lag("v").over(w)).withColumn("after", F.lead("v").over(w))
    lower = F.coalesce((F.col("v") + F.col("before")) / 2, F.col("v") - (F.col("after") - F.col("v")) / 2, F.col("v") - 0.5)
    upper = F.coalesce((F.col("v") + F.col("after")) / 2, F.col("v") + (F.col("v") - F.col("before")) / 2, F.col("v") + 0.5)
    return x.select("v", lower.alias("low"), upper.alias("high"))

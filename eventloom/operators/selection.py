"""Choices and lookups on result tables: histograms, strides, tolerances, ranks, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.numeric import div


def dwell_histogram(segs: DataFrame) -> DataFrame:
    """Counts of positive dwells in min(50, max(5, floor(sqrt n))) equal bins between a
    state's least and greatest, and the state's mean."""
    s = segs.where("duration_time > 0").groupBy("run_id", "state").agg(F.min("duration_time").alias("low"), F.max("duration_time").alias("high"), F.count(F.lit(1)).alias("n"), F.avg("duration_time").alias("mean"))
    s = s.withColumn("bins", F.least(F.lit(50), F.greatest(F.lit(5), F.floor(F.sqrt("n")))))
    at = F.least(F.col("bins") - 1, F.floor(F.coalesce(div((F.col("duration_time") - F.col("low")) * F.col("bins"), F.col("high") - F.col("low")), F.lit(0.0))))
    return segs.where("duration_time > 0").join(s, ["run_id", "state"]).groupBy("run_id", "state", at.alias("bucket")).agg(F.count(F.lit(1)).alias("count"), F.first("mean").alias("mean"))


def every(rows: DataFrame, by: list[str], order: str, stride: int, keep_last: bool = False) -> DataFrame:
    """Every stride-th row of each group, and its last if wanted."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    keep = F.col("_i") % stride == 0
    return ranked.where(keep | (F.col("_i") == F.col("_n") - 1) if keep_last else keep).drop("_i", "_n")


def tolerant_lookup(rows: DataFrame, value: str, wanted: DataFrame, tolerance: float) -> DataFrame:
    """rows with the first (least position) of wanted(position, target) within tolerance;
    values without one go. Both sides meet in buckets as wide as the tolerance."""
    bucket = lambda c: F.floor(c / tolerance)
    near = wanted.select("position", "target", F.explode(F.array(*(bucket(F.col("target")) + k for k in (-1, 0, 1)))).alias("_k"))
    met = rows.withColumn("_k", bucket(F.col(value))).join(near, "_k").where(F.abs(F.col(value) - F.col("target")) <= tolerance)
    return met.groupBy(*rows.columns).agg(F.min_by("target", "position").alias("target"))


def upper_branch_onset(points: DataFrame) -> DataFrame:
    """Of each parameter set the branch that reaches highest, then begins first."""
    b = points.groupBy("param_id", "branch").agg(F.max("value").alias("top"), F.min("x").alias("onset"))
    return b.groupBy("param_id").agg(F.max_by(F.struct("branch", "onset"), F.struct("top", -F.col("onset"), -F.col("branch"))).alias("r")).select("param_id", "r.*")


def candidate_order(value: str = "value") -> list[Column]:
    """Finite values first, rising."""
    return [F.isnan(value).asc(), F.col(value).asc()]


def elbow(candidates: DataFrame) -> DataFrame:
    """Of candidates(run_id, segments, cost) the one farthest from the chord between the fewest
    and the most segments."""
    from eventloom.operators.statistics import knee

    best = candidates.groupBy("run_id", F.col("segments").cast("double").alias("x")).agg(F.min("cost").alias("y"))
    return knee(best).select("run_id", F.col("knee").cast("long").alias("segments"))


def filtered_or_all(rows: DataFrame, by: list[str], rule: Column) -> DataFrame:
    """Rows that meet a rule, but all of a group in which none does."""
    ok = F.max(rule.cast("int")).over(Window.partitionBy(*by))
    return rows.withColumn("_any", ok).where((F.col("_any") == 0) | rule).drop("_any")


def pass_rate(rows: DataFrame, by: list[str], criteria: list[Column], good: float = 0.8) -> DataFrame:
    """Mean share of criteria met, and the verdict."""
    share = sum(F.coalesce(c, F.lit(False)).cast("double") for c in criteria) / len(criteria)
    return rows.groupBy(*by).agg(F.avg(share).alias("share")).withColumn("verdict", F.when(F.col("share") >= good, "good").when(F.col("share") >= 0.5, "mixed").otherwise("poor"))


def firing_rates(spikes: DataFrame, excitatory: int, inhibitory: int, seconds: float) -> DataFrame:
    """Mean rates in Hz of the first `excitatory` units and of the rest."""
    e = F.count_if(F.col("unit") < excitatory)
    return spikes.groupBy("run_id").agg((e / F.lit(excitatory * seconds)).alias("rate_e"), ((F.count(F.lit(1)) - e) / F.lit(inhibitory * seconds)).alias("rate_i"))


def mean_connectivity(blocks: DataFrame) -> DataFrame:
    """Mean chance over blocks(n_post, n_pre, p) by their sizes."""
    area = F.col("n_post") * F.col("n_pre")
    return blocks.agg(div(F.sum(area * F.col("p")), F.sum(area)).alias("p"))


def key_value(key: Column) -> Column:
    """The number before '_focus' in a key, NULL where there is none."""
    return F.regexp_replace(F.split(key, "_focus")[0], "^R", "").try_cast("double")


def status_report(rows: DataFrame) -> DataFrame:
    """Counts by status, distinct digests, and greatest and last-minus-first of a measure."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("digest").alias("digests"), F.max("measure").alias("top"), (F.max_by("measure", "at") - F.min_by("measure", "at")).alias("drift"))


def spread(rows: DataFrame, by: list[str], value: str, missing: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of finite values per group."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def extrapolated(x: DataFrame, grid: DataFrame) -> DataFrame:
    """y at grid(run_id, t) on the line through the neighbours among x(run_id, x, y), the outer
    pairs' lines going on beyond the ends."""
    w = Window.partitionBy("run_id").orderBy("x")
    own = x.groupBy("run_id", "x").agg(F.first("y").alias("y"))
    piece = own.select("run_id", "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.row_number().over(w).alias("i")).where("x1 is not null")
    last = piece.groupBy("run_id").agg(F.max("i").alias("last"))
    piece = piece.join(last, "run_id").withColumn("low", F.when(F.col("i") == 1, F.lit(float("-inf"))).otherwise(F.col("x")))
    both = grid.select("run_id", "t", F.lit(1).alias("q"), F.lit(None).cast("struct<x:double,y:double,x1:double,y1:double>").alias("p")).unionByName(piece.select("run_id", F.col("low").alias("t"), F.lit(0).alias("q"), F.struct("x", "y", "x1", "y1").alias("p")))
    at = F.last("p", True).over(Window.partitionBy("run_id").orderBy("t", "q"))
    return both.withColumn("at", at).where("q = 1").select("run_id", "t", (F.col("at.y") + (F.col("t") - F.col("at.x")) * (F.col("at.y1") - F.col("at.y")) / (F.col("at.x1") - F.col("at.x"))).alias("y"))

"""Finished results: canonical labels and states, episode tables, summaries over runs, sweeps
of thresholds, and the orders in which states and reports are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.numeric import div, fisher_z
from eventloom.operators import states, statistics
from eventloom.sources.stored import stored

EPISODE = ["run_id", "episode"]


def compact(labels: DataFrame) -> DataFrame:
    """Labels 0, 1, ... without holes, in the order of the labels."""
    kinds = labels.select("run_id", "label").distinct()
    kinds = kinds.withColumn("new", F.dense_rank().over(Window.partitionBy("run_id").orderBy("label")) - 1)
    return labels.join(kinds, ["run_id", "label"]).select("run_id", "bin", F.col("new").cast("long").alias("label"))


def finalized(labels: DataFrame, signal: DataFrame, dt: float = 1.0, threshold: float | None = None, value: str = "x") -> dict[str, DataFrame]:
    """Tables of a result from run_id, bin, label: labels renamed by falling activity, means,
    segments, dwell times, transitions, templates (means at or over threshold; by default over
    each cluster's mean of states) and occupancy."""
    base = compact(labels)
    rank = states.by_activity(states.state_means(signal, base, value)).select("run_id", F.col("state").alias("label"), "rank")
    renamed = stored(base.join(rank, ["run_id", "label"]).select("run_id", "bin", F.col("rank").cast("long").alias("label")), "labels")  # every table reads it
    means, segs = states.state_means(signal, renamed, value), states.segments(renamed, dt=dt)
    limit = F.avg("mean").over(Window.partitionBy("run_id", "cluster")) if threshold is None else F.lit(threshold)
    return {
        "labels": renamed, "means": means, "segments": segs, "dwell_times": states.dwell_times(segs), "transitions": states.transitions(segs),
        "templates": means.withColumn("active", (F.col("mean") >= limit).cast("int")), "occupancy": states.occupancy(segs),
    }


# ------------------------------------------------------------------- templates of segments


def segment_templates(means: DataFrame, mode: str = "relative", level: float = 0.8, fixed: float | None = None, least: int = 1) -> DataFrame:
    """means(run_id, start_bin, cluster, mean) with active: at or over the cluster's threshold
    over all segments ('fixed'; 'percentile' at level; 'relative': the 20th percentile and a
    share of the way to the 95th). A segment with fewer than `least` gets its strongest ones."""
    q = lambda p: F.percentile("mean", F.lit(p))
    width = F.greatest(q(0.95) - q(0.2), F.lit(0.0))
    how = {"fixed": F.max(F.lit(fixed)), "percentile": q(level), "relative": q(0.2) + (0.35 if fixed is None else fixed) * width}[mode]
    limits = means.groupBy("run_id", "cluster").agg(how.alias("threshold"))
    w = Window.partitionBy("run_id", "start_bin")
    marked = means.join(limits, ["run_id", "cluster"]).withColumn("own", (F.col("mean") >= F.col("threshold")).cast("int"))
    marked = marked.withColumn("k", F.row_number().over(w.orderBy(F.desc("mean"), F.desc("cluster")))).withColumn("n", F.sum("own").over(w))
    return marked.select("run_id", "start_bin", "cluster", "mean", "threshold", F.when((F.col("n") < least) & (F.col("k") <= least), 1).otherwise(F.col("own")).alias("active"))


def template_states(templates: DataFrame) -> DataFrame:
    """(run_id, start_bin, template, state): states are numbered by their first segment."""
    rows = templates.groupBy("run_id", "start_bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "active"))), lambda x: x["active"]).alias("template"))
    first = rows.groupBy("run_id", "template").agg(F.min("start_bin").alias("first"))
    numbers = first.withColumn("state", F.dense_rank().over(Window.partitionBy("run_id").orderBy("first")) - 1)
    return rows.join(numbers, ["run_id", "template"]).select("run_id", "start_bin", "template", "state")


# ------------------------------------------------------------------- canonical states


def canonical_keys(rates: DataFrame, most: int, z: float, similarity: float, floor: float) -> DataFrame:
    """(run_id, episode, state_key, members, pruned, truncated) of rates(run_id, episode,
    cluster, name, rate, active). Active clusters stay that stand z robust deviations over the
    inactive ones' median (all clusters' without inactive ones) and, but for the strongest,
    reach `similarity` of it; of more than `most`, the strongest."""
    rest = F.when(F.col("active") == 0, F.col("rate"))
    middle = rates.groupBy(*EPISODE).agg(F.coalesce(F.percentile(rest, F.lit(0.5)), F.percentile("rate", F.lit(0.5))).alias("base"), F.min("active").alias("full"))
    x = rates.join(middle, EPISODE)
    off = F.when((F.col("active") == 0) | (F.col("full") == 1), F.abs(F.col("rate") - F.col("base")))
    spread = x.groupBy(*EPISODE).agg(F.greatest(1.4826 * F.percentile(off, F.lit(0.5)), F.lit(max(floor, 1e-12))).alias("sigma"), F.max(F.when(F.col("active") == 1, F.col("rate"))).alias("top"), F.sum("active").alias("proposed"))
    x = x.join(spread, EPISODE)
    w = Window.partitionBy(*EPISODE)
    first = F.row_number().over(w.orderBy(F.desc("active"), F.desc("rate"), "cluster")) == 1
    stays = (F.col("active") == 1) & (F.col("rate") >= F.col("base") + z * F.col("sigma")) & (first | (F.col("rate") >= similarity * F.col("top")))
    x = x.withColumn("stays", stays.cast("int")).withColumn("k", F.row_number().over(w.orderBy(F.desc("stays"), F.desc("rate"), "cluster")))
    kept = F.when((F.col("stays") == 1) & (F.col("k") <= most), F.struct("cluster", "name"))
    out = x.groupBy(*EPISODE).agg(F.array_sort(F.collect_list(kept)).alias("kept"), F.sum("stays").alias("retained"), F.first("proposed").alias("proposed"))
    return out.select(*EPISODE, F.when(F.size("kept") == 0, "LOW").otherwise(F.array_join("kept.name", "+")).alias("state_key"), F.size("kept").alias("members"), (F.col("retained") != F.col("proposed")).alias("pruned"), (F.col("retained") > most).alias("truncated"))


def canonical_states(keys: DataFrame) -> DataFrame:
    """(run_id, state_key, members, state): LOW first, then by number of members, then by name."""
    kinds = keys.select("run_id", "state_key", "members").distinct()
    order = [F.col("state_key") != "LOW", F.col("members"), F.col("state_key")]
    return kinds.withColumn("state", (F.row_number().over(Window.partitionBy("run_id").orderBy(*order)) - 1).cast("long"))


def canonical_labels(episodes: DataFrame, keys: DataFrame) -> DataFrame:
    """run_id, bin, label of episodes(run_id, episode, start_bin, stop_bin) by canonical state."""
    named = episodes.join(keys, EPISODE).join(canonical_states(keys), ["run_id", "state_key", "members"])
    return named.select("run_id", F.explode(F.sequence("start_bin", F.col("stop_bin") - 1)).alias("bin"), F.col("state").alias("label"))


def inventory(labels: DataFrame, kinds: DataFrame, dt: float = 1.0) -> DataFrame:
    """Visits, occupied time and share, dwell mean, deviation (0 for one), median and first
    time of each canonical state."""
    segs = states.segments(labels, dt=dt)
    d = F.col("duration_time")
    own = segs.groupBy("run_id", "state").agg(F.count(F.lit(1)).alias("visits"), F.sum(d).alias("occupied"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std"), F.percentile(d, F.lit(0.5)).alias("median"), F.min("start_time").alias("first"))
    whole = own.withColumn("share", div(F.col("occupied"), F.sum("occupied").over(Window.partitionBy("run_id"))))
    return kinds.join(whole, ["run_id", "state"])


def emissions(labels: DataFrame, signal: DataFrame, value: str = "x") -> DataFrame:
    """Mean of every cluster, also of those that the states weren't found from, in each state."""
    return states.state_means(signal, labels, value)


def member_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """How many states of an inventory have no, one and more members."""
    m = F.col("members")
    return rows.groupBy(*by).agg(F.count_if(m == 0).alias("none"), F.count_if(m == 1).alias("one"), F.count_if(m > 1).alias("more"))


def state_order(label: str = "label") -> Column:
    """Quiet states first, then by the number of clusters that a label names (E1, E2, ... or
    any numbers), their numbers, and the label; labels without numbers last."""
    text = F.col(label)
    numbers = lambda rule: F.array_sort(F.regexp_extract_all(text, F.lit(rule), F.lit(1)).cast("array<long>"))
    own = F.when(F.size(numbers("E(\\d+)")) > 0, numbers("E(\\d+)")).otherwise(numbers("(\\d+)"))
    quiet = F.upper(text).isin("LOW", "SILENT", "QUIET", "BACKGROUND")
    n = F.when(quiet, 0).when(F.size(own) > 0, F.size(own)).otherwise(99)
    return F.struct(n.alias("n"), F.when(quiet, F.array().cast("array<long>")).otherwise(own).alias("numbers"), text.alias("text"))


def report_order(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows in the order of those of the wanted columns that there are."""
    return df.orderBy(*(c for c in wanted if c in df.columns))


def named(clusters: DataFrame) -> DataFrame:
    """clusters(cluster, name) with C1, C2, ... where any name is missing."""
    whole = F.count("name").over(Window.partitionBy()) == F.count(F.lit(1)).over(Window.partitionBy())  # a row per cluster
    return clusters.withColumn("name", F.when(whole, F.col("name")).otherwise(F.concat(F.lit("C"), (F.col("cluster") + 1).cast("string"))))


def wide_rates(means: DataFrame, clusters: list) -> DataFrame:
    """A row per state, a column per cluster."""
    return means.groupBy("run_id", "state").pivot("cluster", clusters).agg(F.first("mean"))


def every_state(true: DataFrame, pred: DataFrame) -> DataFrame:
    """States of two label series, and how many bins each has in both."""
    count = lambda x, c: x.groupBy("run_id", F.col("label").alias("state")).agg(F.count(F.lit(1)).alias(c))
    return count(true, "n_true").join(count(pred, "n_pred"), ["run_id", "state"], "full").fillna(0, ["n_true", "n_pred"])


# ------------------------------------------------------------------- summaries over runs


def init_summary(rows: DataFrame, by: list[str], value: str = "r") -> DataFrame:
    """Fisher means of successful rows' correlations per init, measure and category."""
    z = F.avg(fisher_z(value))
    return rows.where("ok").groupBy(*by, "measure", "category").agg(F.tanh(z).alias("mean"), F.count(value).alias("n"))


def network_summary(rows: DataFrame, networks: DataFrame, by: list[str], value: str = "r") -> DataFrame:
    """Means over inits of init_summary() for every network, measure and category; NULL where
    a network has none."""
    per = init_summary(rows, [*by, "init"], value).groupBy(*by, "measure", "category").agg(F.avg("mean").alias("mean"))
    kinds = rows.select("measure", "category").distinct()
    return networks.select(*by).distinct().join(kinds).join(per, [*by, "measure", "category"], "left")


def collected(rows: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """Mean and deviation (population) of vectors' places over successful tasks; NaN is none."""
    known = F.when(~F.isnan(value), F.col(value))
    return rows.where("ok").groupBy(*by, position).agg(F.avg(known).alias("mean"), F.stddev_pop(known).alias("std"), F.count(known).alias("n"))


def episode_statistics(x: DataFrame, pairs: DataFrame, units: DataFrame, active: Column) -> DataFrame:
    """One row per run: Fisher means and numbers of pair correlations within and across groups,
    and the variance parts of the active groups and of the others. x(run_id, unit, t, value),
    pairs(scope, a, b), units(unit, group_id)."""
    r = statistics.pair_correlations(x, pairs)
    z = statistics.fisher_summary(r, ["run_id", "scope"]).groupBy("run_id").pivot("scope", ["within", "across"]).agg(F.first("mean_r").alias("r"), F.first("n").alias("n"))
    own = statistics.variance_parts(x.join(units, "unit"), ["run_id", "group_id"]).withColumn("active", active)
    part = lambda c, on: F.avg(F.when(F.col("active") == on, F.col(c))).alias(f"{c}_{'active' if on else 'inactive'}")
    parts = own.groupBy("run_id").agg(*(part(c, on) for c in ("mean", "temporal", "quenched", "total") for on in (True, False)))
    return z.join(parts, "run_id")


# ------------------------------------------------------------------- sweeps of thresholds


def fits(n: Column, label: Column) -> tuple[Column, Column]:
    """Whether a number of changepoints is the one that a label tells (NULL for labels that
    only tell a bound), and whether it agrees with the label."""
    exact = F.when(label.isin("0", "1", "2"), n == label.try_cast("int"))
    bound = F.when(label.isin("gt1", ">1", ">1_hard"), n > 1).when(label.isin("gt5", ">5"), n > 5).when(label.isin("gt10", ">10"), n > 10)
    return exact, F.coalesce(exact, bound, F.lit(False))


def threshold_scores(rows: DataFrame) -> DataFrame:
    """Per threshold of rows(threshold, label, n_cps, n_states, explained): shares of fits and
    means, ordered from the best by `place`."""
    exact, agrees = fits(F.col("n_cps"), F.trim("label"))
    out = rows.groupBy("threshold").agg(
        F.avg(exact.cast("double")).alias("exact_known"), F.avg(agrees.cast("double")).alias("agrees"), F.avg("n_cps").alias("mean_cps"),
        F.percentile("n_cps", F.lit(0.5)).alias("median_cps"), F.avg("n_states").alias("mean_states"), F.avg("explained").alias("mean_explained"),
    )
    w = Window.orderBy(F.desc("agrees"), F.desc_nulls_last("exact_known"), F.desc("mean_explained"), "threshold")  # a row per threshold
    return out.withColumn("place", F.row_number().over(w))


def best_threshold(rows: DataFrame) -> DataFrame:
    """The rows of the best threshold."""
    return rows.join(threshold_scores(rows).where("place = 1").select("threshold"), "threshold", "left_semi")

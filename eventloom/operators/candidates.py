"""Fixed-point candidates: choosing, ranking, spreading out and drawing them.

candidates(rep, focus_count, value, stability, residual, rates): one row per fixed point of a
sweep value `rep` with focus_count clusters in focus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Two sweep values nearer than this are one.
SAME = 1e-9
GROUP = ["rep", "focus_count"]


def drawn(*parts: Column) -> Column:
    """A number in [0, 1) made from the parts by MD5, so that every engine draws the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def chosen(c: DataFrame, rep: float, allowed: list[int] | None = None, stability: str = "stable", populations: int | None = None, ties: list[str] = []) -> DataFrame:
    """Candidates of one sweep value with their place idx by value in the whole group, equal values
    by the columns ties. stability: 'stable', 'unstable' (all others) or 'any'. Rates of another
    length than populations fail."""
    w = Window.partitionBy(*GROUP).orderBy("value", *ties)
    kind = F.coalesce(F.lower("stability"), F.lit("unknown"))
    c = c.where(F.abs(F.col("rep") - rep) <= SAME).withColumn("idx", (F.row_number().over(w) - 1).cast("long")).withColumn("stability", kind).where("rates is not null")
    if populations is not None:
        wrong = F.raise_error(F.format_string("a fixed point lists %d populations", F.size("rates")))
        c = c.withColumn("rates", F.when(F.size("rates") == populations, F.col("rates")).otherwise(wrong.cast("array<double>")))
    if allowed:
        c = c.where(F.col("focus_count").isin(*allowed))
    rule = {"stable": F.col("stability") == "stable", "unstable": F.col("stability") != "stable", "any": F.lit(True)}[stability]
    return c.where(rule)


def peak_rate(rates: Column, excitatory: int) -> Column:
    """Largest known rate of the first `excitatory` populations; NULL where there are fewer."""
    own = F.filter(F.slice(rates, 1, excitatory), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(rates) >= excitatory, F.array_max(own))


def trivial(value: Column, rates: Column, threshold: float = 1e-6) -> Column:
    """Whether the point and all its rates are zero; points without rates aren't trivial."""
    return (F.size(F.coalesce(rates, F.array().cast("array<double>"))) > 0) & (F.abs(value) <= threshold) & F.coalesce(F.forall(rates, lambda x: F.abs(x) <= threshold), F.lit(False))


def residual_score(residual: Column) -> Column:
    return F.when(residual.isNull() | F.isnan(residual) | (F.abs(residual) == float("inf")), F.lit(float("inf"))).otherwise(residual)


def rank_key() -> Column:
    """Stable ones first, then the least residual, then the greatest magnitude, then value."""
    return F.struct((F.coalesce(F.col("stability"), F.lit("unknown")) != "stable").cast("int").alias("a"), residual_score(F.col("residual")).alias("b"), (-F.abs(F.col("value"))).alias("c"), (-F.col("value")).alias("d"))


def diverse(c: DataFrame, most: int, by: list[str] = GROUP) -> DataFrame:
    """Up to `most` of each group: the best, then each time the one furthest from those chosen
    (of equal ones the better). Every round is one aggregate over the group and a join of its
    one pick, so groups of any size are spread."""
    pick = F.min(F.struct((-F.col("far")).alias("far"), F.col("rank"), F.col("value"))).alias("pick")
    rows = c.withColumn("rank", rank_key()).withColumn("far", F.lit(float("inf")))
    picks = []
    for nth in range(most):
        best = rows.where("far > 0").groupBy(*by).agg(pick).select(*by, F.col("pick.value").alias("taken"))
        picks.append(best.withColumn("nth", F.lit(nth)))
        rows = rows.join(best, by, "left").withColumn("far", F.when(F.col("taken").isNull(), F.lit(0.0)).otherwise(F.least("far", F.abs(F.col("value") - F.col("taken"))))).drop("taken")
    return reduce(DataFrame.unionByName, picks).withColumnRenamed("taken", "value")


def sweep_report(c: DataFrame, threshold: float = 1e-3, most: int = 3) -> DataFrame:
    """All candidates with included and, where they aren't, filter_reason: 'trivial_zero';
    'duplicate_threshold' for all but the best of a chain of values whose neighbours are within
    threshold; 'max_fixpoints' for those beyond the `most` spread-out ones of their group."""
    kind = trivial(F.col("value"), F.col("rates"))
    order = Window.partitionBy(*GROUP, "_trivial").orderBy("value", "_rank")
    rows = c.withColumn("_trivial", kind).withColumn("_rank", rank_key())
    rows = rows.withColumn("_new", F.coalesce((F.col("value") - F.lag("value").over(order) > threshold).cast("int"), F.lit(1)))
    rows = rows.withColumn("_chain", F.sum("_new").over(order))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*GROUP, "_trivial", "_chain").orderBy("_rank")))
    rows = rows.withColumn("_best", ~F.col("_trivial") & (F.col("_place") == 1))
    taken = diverse(rows.where("_best").select(*GROUP, "value", "stability", "residual"), most).select(*GROUP, "value", F.lit(True).alias("_best"), F.lit(True).alias("_taken"))
    told = rows.join(taken, [*GROUP, "value", "_best"], "left")
    reason = F.when(F.col("_trivial"), "trivial_zero").when(~F.col("_best"), "duplicate_threshold").when(F.col("_taken").isNull(), "max_fixpoints")
    return told.withColumn("filter_reason", reason).withColumn("included", F.col("filter_reason").isNull()).select(*c.columns, "included", "filter_reason")


def seeded_choice(c: DataFrame, seeds: DataFrame, order: list[str]) -> DataFrame:
    """For each row of seeds(seed, draw), with replacement, one of the candidates in order. The
    candidates' number is one row, which is sent to every seed."""
    w = Window.orderBy(*order)  # candidates of one bundle: as many as the sweep has fixed points
    numbered = c.withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    n = c.agg(F.count(F.lit(1)).alias("n"))
    picked = seeds.crossJoin(F.broadcast(n)).withColumn("i", F.floor(drawn(F.col("seed"), F.col("draw")) * F.col("n")))
    return picked.join(numbered, "i").drop("i", "n")


def first_match(c: DataFrame, rep: float, ties: list[str] = []) -> DataFrame:
    """Per focus count, the points of its least sweep value within SAME of rep, by value and then
    by the columns ties."""
    near = c.where(F.abs(F.col("rep") - rep) <= SAME)
    first = near.groupBy("focus_count").agg(F.min("rep").alias("rep"))
    own = near.join(first, ["focus_count", "rep"])
    return own.withColumn("idx", (F.row_number().over(Window.partitionBy("focus_count").orderBy("value", *ties)) - 1).cast("long"))


def focus_markers(c: DataFrame, excitatory: int) -> DataFrame:
    """Largest finite peak rate of each focus count among stable and among other points."""
    peak = peak_rate(F.col("rates"), excitatory)
    finite = c.withColumn("peak", peak).where(F.col("peak").isNotNull() & (F.abs("peak") < float("inf")))
    return finite.groupBy("focus_count", (F.col("stability") == "stable").alias("stable")).agg(F.max("peak").alias("peak"))


def points(c: DataFrame, focus_count: int | None = None) -> DataFrame:
    """(rep, value, stability) of points that aren't trivial, for one focus count or all."""
    own = c if focus_count is None else c.where(F.col("focus_count") == focus_count)
    return own.where(~trivial(F.col("value"), F.col("rates"))).select("rep", "value", "stability")


def rep_grid(c: DataFrame) -> DataFrame:
    """The sweep values of each focus count, in order."""
    return c.groupBy("focus_count").agg(F.array_sort(F.collect_set(F.round("rep", 9))).alias("reps"))


def upserted(cache: DataFrame, fresh: DataFrame, keys: list[str], decimals: int = 6) -> DataFrame:
    """The cache with fresh rows in place of those whose keys agree after rounding."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    for k in keys:
        both = both.withColumn(k, F.round(k, decimals))
    rest = [c for c in cache.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("r")).select(*keys, "r.*")


def start_rates(params: DataFrame, populations: int, spread: float = 0.2) -> DataFrame:
    """params(param_id, value) with rates drawn within spread of value, kept in [0, 1]."""
    each = params.select("param_id", "value", F.explode(F.sequence(F.lit(0), F.lit(populations - 1))).alias("pop"))
    rate = F.col("value") + (drawn(F.col("param_id"), F.col("pop")) * 2 - 1) * spread
    return each.select("param_id", "pop", F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)).alias("rate"))

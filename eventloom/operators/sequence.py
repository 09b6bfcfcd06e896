"""Running values over whole runs that no single task has to hold.

A run's rows are cut into stretches: of equally many numbers where their order is an integer, of its
range of values otherwise, heavy ones again. Windows work inside a stretch; what earlier stretches
end with is summed up in one row per stretch, accumulated over those few rows, and joined back.
A run of any length is so spread over its stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.sources.stored import stored

PIECES = 256
#: Values of an integer order (bins, steps, numbers) in one stretch.
WIDTH = 4096


# ------------------------------------------------------------------- integer orders
#
# A stretch is `order div width`: it has at most `width` rows of a group, wherever the group's
# values lie, and outliers are stretches of their own. One row per stretch is carried on.


def _stretches(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn("_stretch", F.expr(f"`{order}` div {width}"))


def neighbour(rows: DataFrame, order: str, value: str | Column, name: str, by: list[str] = ["run_id"], ahead: bool = False, width: int = WIDTH) -> DataFrame:
    """rows with the value of the row before (or after) theirs, whose order is unique in a group;
    NULL at a group's end."""
    own = F.struct((F.col(value) if isinstance(value, str) else value).alias("v"))  # a NULL value isn't a missing row
    cut = _stretches(rows, order, width)
    inside = Window.partitionBy(*by, "_stretch").orderBy(order)
    near = F.lead(own).over(inside) if ahead else F.lag(own).over(inside)
    ends = cut.groupBy(*by, "_stretch").agg((F.min_by if ahead else F.max_by)(own, order).alias("_end"))
    line = Window.partitionBy(*by).orderBy("_stretch")
    far = ends.select(*by, "_stretch", (F.lead if ahead else F.lag)("_end").over(line).alias("_far"))
    return cut.withColumn("_near", near).join(far, [*by, "_stretch"]).withColumn(name, F.coalesce("_near", "_far")["v"]).drop("_near", "_far", "_stretch")


def last_known(rows: DataFrame, order: str, value: Column, name: str, by: list[str] = ["run_id"], width: int = WIDTH) -> DataFrame:
    """rows with the last non-null value at or before theirs."""
    cut = _stretches(rows, order, width).withColumn("_v", value)
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy(*by, "_stretch").orderBy(order))
    ends = cut.groupBy(*by, "_stretch").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_end"))
    line = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_stretch", F.last("_end", ignorenulls=True).over(line).alias("_far"))
    return cut.withColumn("_near", inside).join(carried, [*by, "_stretch"]).withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", "_v", "_stretch")


def total_so_far(rows: DataFrame, order: str, value: Column, name: str, by: list[str] = ["run_id"], width: int = WIDTH) -> DataFrame:
    """rows with the sum of value over rows up to and with theirs; order is unique in a group."""
    cut = _stretches(rows, order, width).withColumn("_v", value)
    inside = F.sum("_v").over(Window.partitionBy(*by, "_stretch").orderBy(order))
    sums = cut.groupBy(*by, "_stretch").agg(F.sum("_v").alias("_s"))
    line = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*by, "_stretch", F.coalesce(F.sum("_s").over(line), F.lit(0)).alias("_far"))
    return cut.withColumn("_near", inside).join(carried, [*by, "_stretch"]).withColumn(name, F.col("_near") + F.col("_far")).drop("_near", "_far", "_v", "_stretch")


def run_lengths(rows: DataFrame, value: str, by: list[str], order: str = "bin", width: int = WIDTH) -> DataFrame:
    """Maximal runs of one value over rows in order: by, state, first, last. Each stretch
    encodes its own rows; its first run goes on an earlier one if the stretch before ends with its
    value, and a run over whole stretches is told by the start that is open at their ends. So
    stretches join as (first run, last run, whole ones between), in any number of tasks."""
    cut = _stretches(rows.select(*by, F.col(order).alias("_at"), F.struct(F.col(value).alias("state")).alias("_state")), "_at", width)
    inside = Window.partitionBy(*by, "_stretch").orderBy("_at")
    before = F.lag("_state").over(inside)
    own = cut.withColumn("_new", (before.isNull() | ~before.eqNullSafe(F.col("_state"))).cast("int")).withColumn("_island", F.sum("_new").over(inside))
    local = own.groupBy(*by, "_stretch", "_island", "_state").agg(F.min("_at").alias("first"), F.max("_at").alias("last"))
    ends = local.groupBy(*by, "_stretch").agg(F.max("_island").alias("_n"), F.max_by("_state", "_island").alias("_end"), F.max_by("first", "_island").alias("_opened"))
    line = Window.partitionBy(*by).orderBy("_stretch")
    ends = ends.withColumn("_before", F.lag("_end").over(line))
    goes_on = F.col("_before").isNotNull() & F.col("_before").eqNullSafe(F.col("_end"))
    ends = ends.withColumn("_open", F.when((F.col("_n") > 1) | ~goes_on, F.col("_opened")))
    carried = ends.select(*by, "_stretch", "_before", F.last("_open", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    joined = (F.col("_island") == 1) & F.col("_before").isNotNull() & F.col("_before").eqNullSafe(F.col("_state"))
    full = local.join(carried, [*by, "_stretch"]).withColumn("first", F.when(joined, F.col("_carry")).otherwise(F.col("first")))
    return full.groupBy(*by, "first", "_state").agg(F.max("last").alias("last")).select(*by, "_state.state", "first", "last")


def with_halo(rows: DataFrame, order: str, back: int, ahead: int, width: int) -> DataFrame:
    """rows by `stretch`, each also in the stretches that reach it: `back` places before their
    first and `ahead` places after their last. `own` tells a stretch's own rows."""
    own = F.floor(F.col(order) / width)
    low, high = F.floor((F.col(order) - ahead) / width), F.floor((F.col(order) + back) / width)
    return rows.withColumn("stretch", F.explode(F.sequence(low, high))).withColumn("own", F.col("stretch") == own)


# ------------------------------------------------------------------- orders of any kind


def in_pieces(rows: DataFrame, order: str, by: list[str] = ["run_id"], pieces: int = PIECES, refine: int = 1) -> DataFrame:
    """rows, written once, with `piece`, which rises with order. A run's range is cut into equal stretches; one
    with more than four times its share of the run's rows is cut again, over the range of its own
    rows: values far from all others leave the rest spread over many pieces. refine: how often,
    one more for each scale of such values. Rows of one order value are in one piece."""
    out, key = stored(rows, "rows").withColumn("piece", F.lit(0).cast("long")), [*by, "piece"]
    for level in range(refine + 1):
        ends = out.groupBy(*key).agg(F.min(order).alias("_low"), F.max(order).alias("_high"), F.count(F.lit(1)).alias("_c"))
        if level:  # a row per piece
            share = F.sum("_c").over(Window.partitionBy(*by)) / F.lit(float(pieces))
            ends = ends.withColumn("_heavy", F.col("_c") > 4 * share)
        ends = stored(ends, "ranges")  # of known size, so that no join sends the rows to every task in their place
        width = (F.col("_high") - F.col("_low")).cast("double") / pieces
        at = F.floor(F.try_divide(F.col(order) - F.col("_low"), width))
        own = F.least(F.greatest(F.coalesce(at, F.lit(0)), F.lit(0)), F.lit(pieces - 1))
        own = F.when(F.col("_heavy"), own).otherwise(F.lit(0)) if level else own
        out = out.join(ends, key).withColumn("piece", F.col("piece") * pieces + own).drop("_low", "_high", "_c", "_heavy")
    return out


def _before(sums: DataFrame, value: Column, name: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "piece", value.over(w).alias(name))


def numbered(rows: DataFrame, order: list[str], by: list[str] = ["run_id"], pieces: int = PIECES) -> DataFrame:
    """rows with i, their number from 0 in order (the first column of order is numeric), and n,
    the number of rows of their run."""
    cut = in_pieces(rows, order[0], by, pieces)
    sums = cut.groupBy(*by, "piece").agg(F.count(F.lit(1)).alias("_n"))
    base = _before(sums, F.sum("_n"), "_base", by)
    total = sums.groupBy(*by).agg(F.sum("_n").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*by, "piece").orderBy(*order))
    return cut.withColumn("_k", nth).join(base, [*by, "piece"]).join(total, by).withColumn("i", F.coalesce("_base", F.lit(0)) + F.col("_k") - 1).drop("_k", "_base", "piece")


def running_sum(rows: DataFrame, order: str, value: str, name: str, by: list[str] = ["run_id"], pieces: int = PIECES) -> DataFrame:
    """rows with the sum of value over rows up to and with theirs; order is unique in a run."""
    cut = in_pieces(rows, order, by, pieces)
    sums = cut.groupBy(*by, "piece").agg(F.sum(value).alias("_s"))
    inside = F.sum(value).over(Window.partitionBy(*by, "piece").orderBy(order))
    return cut.withColumn("_in", inside).join(_before(sums, F.sum("_s"), "_base", by), [*by, "piece"]).withColumn(name, F.coalesce("_base", F.lit(0)) + F.col("_in")).drop("_in", "_base", "piece")


def lagged(rows: DataFrame, order: str, name: str, by: list[str] = ["run_id"], pieces: int = PIECES) -> DataFrame:
    """rows with the order value of the row before; NULL for a run's first."""
    cut = in_pieces(rows, order, by, pieces)
    ends = _before(cut.groupBy(*by, "piece").agg(F.max(order).alias("_s")), F.max("_s"), "_base", by)
    inside = F.lag(order).over(Window.partitionBy(*by, "piece").orderBy(order))
    return cut.withColumn("_in", inside).join(ends, [*by, "piece"]).withColumn(name, F.coalesce("_in", "_base")).drop("_in", "_base", "piece")


def around(rows: DataFrame, order: str, value: str, by: list[str] = ["run_id"], pieces: int = PIECES) -> DataFrame:
    """rows with p and q: the last non-null value at or before, and the first at or after, each
    row. Rows with a value come before those without one at the same order."""
    cut = in_pieces(rows, order, by, pieces)
    has = F.col(value).isNotNull()
    ends = cut.where(has).groupBy(*by, "piece").agg(F.max_by(value, order).alias("_last"), F.min_by(value, order).alias("_first"))
    ends = cut.select(*by, "piece").distinct().join(ends, [*by, "piece"], "left")
    w = Window.partitionBy(*by).orderBy("piece")
    carried = ends.select(*by, "piece", F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_p"), F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_q"))
    own = Window.partitionBy(*by, "piece")
    ahead, back = own.orderBy(order, F.asc(~has)), own.orderBy(F.desc(order), F.asc(~has))
    seen = cut.withColumn("_in_p", F.last(value, ignorenulls=True).over(ahead)).withColumn("_in_q", F.last(value, ignorenulls=True).over(back))
    return seen.join(carried, [*by, "piece"]).withColumn("p", F.coalesce("_in_p", "_p")).withColumn("q", F.coalesce("_in_q", "_q")).drop("_in_p", "_in_q", "_p", "_q", "piece")

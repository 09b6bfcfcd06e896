"""Exact quantiles of groups of any size by radix selection.

A double's 64 bits, its sign's put first, rise with its value. The first pass counts a group's
rows by their leading 16 bits, which tells the digit that holds a wanted rank; the next pass
counts the rows with that digit by their next 16 bits, and after four passes the value is known.
Counts are combined before they are shuffled, and a pass holds at most 65,536 counts for each
group and wanted rank, whatever the number of rows or of distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIGN = -(1 << 63)


def rising(x: Column) -> Column:
    """A long whose order, taken without sign, is that of x. Both zeros are one; NULL stays."""
    x = x.cast("double")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(x, F.lit(0.0)) + F.lit(0.0)).cast("long")
    return F.when(x.isNull(), None).when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(SIGN)))


def fallen(key: Column) -> Column:
    """The double of rising()."""
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(SIGN))).otherwise(F.bitwise_not(key))  # keys are never NULL here
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


#: Values of a group that one buffer may hold.
BUFFER = 1 << 16


def quantiles(rows: DataFrame, by: list[str], value: str | Column, shares: dict[str, float], most: int | None = None) -> DataFrame:
    """exact_quantiles(); where the caller knows that no group has more than `most` values and
    a buffer can hold those, in one aggregate with the same result."""
    if most is None or most > BUFFER:
        return exact_quantiles(rows, by, value, shares)
    x = F.col(value) if isinstance(value, str) else value
    return rows.groupBy(*by).agg(*(F.percentile(x, F.lit(share)).alias(name) for name, share in shares.items()))


def exact_quantiles(rows: DataFrame, by: list[str], value: str | Column, shares: dict[str, float]) -> DataFrame:
    """by and, for each name, the quantile of its share of the group's values, linear between
    neighbours as F.percentile; null where a group has no value. NULLs are left out."""
    x = F.col(value) if isinstance(value, str) else value
    keyed = rows.select(*by, rising(x).alias("_key"))
    given = keyed.where("_key is not null")
    counts = keyed.groupBy(*by).agg(F.count("_key").alias("_n"))
    places = {name: share * (F.col("_n") - 1) for name, share in shares.items()}
    sides = [F.struct(F.lit(f"{name} {side.__name__}").alias("_want"), side(at).cast("long").alias("_rank")) for name, at in places.items() for side in (F.floor, F.ceil)]
    wanted = counts.where("_n > 0").select(*by, F.explode(F.array(*sides)).alias("_w")).select(*by, "_w._want", "_w._rank", F.lit(0).cast("long").alias("_top"))
    for shift in (48, 32, 16, 0):
        top = F.lit(0).cast("long") if shift == 48 else F.shiftrightunsigned("_key", shift + 16)
        digits = given.select(*by, top.alias("_top"), F.shiftrightunsigned("_key", shift).bitwiseAND(F.lit(0xFFFF)).alias("_digit"))
        if shift < 48:
            digits = digits.join(wanted.select(*by, "_top").distinct(), [*by, "_top"])
        held = digits.groupBy(*by, "_top", "_digit").agg(F.count(F.lit(1)).alias("_own"))
        last = F.sum("_own").over(Window.partitionBy(*by, "_top").orderBy("_digit"))
        found = held.withColumn("_last", last).join(wanted, [*by, "_top"]).where((F.col("_rank") < F.col("_last")) & (F.col("_rank") >= F.col("_last") - F.col("_own")))
        wanted = found.select(*by, "_want", (F.col("_rank") - F.col("_last") + F.col("_own")).alias("_rank"), F.shiftleft("_top", 16).bitwiseOR(F.col("_digit")).alias("_top"))
    found = wanted.select(*by, "_want", fallen(F.col("_top")).alias("_v")).groupBy(*by).agg(*(F.max(F.when(F.col("_want") == f"{name} {side.__name__}", F.col("_v"))).alias(f"_{name}_{side.__name__}") for name in shares for side in (F.floor, F.ceil)))
    out = counts.join(found, by, "left")

    def between(name: str) -> Column:
        at, low, high = places[name], F.col(f"_{name}_floor"), F.col(f"_{name}_ceil")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return out.select(*by, *(between(name).alias(name) for name in shares))

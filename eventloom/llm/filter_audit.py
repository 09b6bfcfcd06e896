"""Filter interaction audit by direct relational replay.

Every document gets five flags, one for each filter that it fails. The flags are crossed with
a broadcast table of the 120 orders of the filters, the five steps of each are exploded, and
the place of the first failing filter tells what happens at a step: before it the document is
kept, at it it is removed, and a later filter that it fails too is redundant. All counts are
conditional sums by (part, order, step), combined on the map side, so what is shuffled is
600 rows per part and task, whatever the number of documents. An order is five small numbers
and the steps are columns, so nothing of the replay leaves generated code.

The filters: A under 200 words; B 100 x distinct words < 50 x words; C 100 x capital letters
A-Z > 3 x code points; D any of # $ % & * |; E the text of any row of a smaller id. E needs
the smallest id of each text: one row per SHA-256 and task is shuffled, and rows get it from
groups of more than one row only, those of the hot ones by a broadcast.

Defined results: null and empty texts are the empty text (they fail A, and E after the first
id); a null language is the part ''; rows that repeat id and text don't fail E by each other; a row
with a null id fails no E, and makes none fail it, and has no labels; a document is good
(toxic) if any of its label rows says so; repeated rows are replayed each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import BROADCAST_KEYS, looked_up, written

FILTERS = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_flags(text) -> dict:
    """Whether a text fails A, B, C and D by itself."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, fails (bit k for the k-th filter), good, toxic of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((F.when(v, 1 << FILTERS.index(k)).otherwise(0) for k, v in own_flags(text).items()), F.lit(0))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    own = written(docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), bits.alias("own"), F.unhex(F.sha2(text, 256)).alias("digest")), "flags")
    first = own.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = F.when(F.col("first") < F.col("id"), 1 << FILTERS.index("E")).otherwise(0)
    full = looked_up(own, first, ["digest"], "n").select("id", "part", (F.col("own") + again).alias("fails"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    said = said.where("id is not null and (good or toxic)")
    small = said.count() <= BROADCAST_KEYS
    known = full.where("id is not null").join(F.broadcast(said) if small else said, "id", "left")
    return known.unionByName(full.where("id is null"), allowMissingColumns=True).select("id", "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark) -> DataFrame:
    """The 120 orders: their number, their letters, and the bit of each step's filter."""
    rows = [(k, "".join(p), *(1 << FILTERS.index(c) for c in p)) for k, p in enumerate(permutations(FILTERS))]
    return spark.createDataFrame(rows, "nth int, filter_order string, bit1 int, bit2 int, bit3 int, bit4 int, bit5 int")


def replay(flagged: DataFrame) -> DataFrame:
    """Counts by part, order and step over rows of flags()."""
    every = orders(flagged.sparkSession)
    crossed = flagged.select("part", "fails", "good", "toxic").crossJoin(F.broadcast(every.drop("filter_order")))
    first = F.lit(6)  # past the last step when no filter fails
    for step in (5, 4, 3, 2, 1):
        first = F.when(F.col("fails").bitwiseAND(F.col(f"bit{step}")) != 0, step).otherwise(first)
    placed = crossed.withColumn("first", first)
    steps = placed.select("part", "nth", "fails", "good", "toxic", "first", F.stack(F.lit(5), *(x for s in range(1, 6) for x in (F.lit(s), F.col(f"bit{s}")))).alias("step", "bit"))
    removed = F.col("first") == F.col("step")
    fails = F.col("fails").bitwiseAND(F.col("bit")) != 0
    conditions = (F.col("first") > F.col("step"), removed, fails & (F.col("first") < F.col("step")), F.col("fails") == F.col("bit"), removed & F.col("good"), removed & F.col("toxic"))
    counts = steps.groupBy("part", "nth", "step").agg(*(F.sum(F.when(c, 1).otherwise(0).cast("long")).alias(name) for name, c in zip(COUNTS, conditions)))
    named = counts.join(F.broadcast(every.select("nth", "filter_order")), "nth")
    letter = F.expr("substring(filter_order, step, 1)")
    return named.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter))).select("part", "filter_order", F.col("step").cast("int").alias("step"), *COUNTS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    return replay(written(flags(docs, labels), "flagged"))

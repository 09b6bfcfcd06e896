"""Exact dedup by progressive refinement.

Rows are compared on ever dearer keys: length of the normalised text, then length and a hash
of its first PREFIX characters, then its full SHA-256; a row leaves as soon as its key is
unique, so only rows of surviving groups reach the next key. The first scan sends nothing
but pre-aggregated (length, prefix hash) counts; the second adds the digest. With
digest_all=False the digest is worked out for surviving rows only; with True (the query's
contract names the digest of every row) it is worked out in the same scan for all rows, and
only survivors are grouped by it. No text is ever shuffled. A group that holds a third of all
rows is one pre-aggregated row, and its rows get that row by a broadcast of the few large groups.

Defined results: null counts as the empty text, and empty texts equal each other; of equal
texts the one with the most code points stays, then the smallest id, then one row of those
that repeat it; a null id sorts last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import BROADCAST_KEYS, free_names, having, looked_up, written

PREFIX = 64
WHITE_CHARS = " \t\n\x0b\x0c\r"


def normalised(text):
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_CHARS, "")


def row_key(id_col: str, text_col: str):
    """Two 64-bit hashes that name a row by its id and whole text."""
    number = F.col(id_col).cast("long")
    return F.xxhash64(number, F.col(text_col)), F.xxhash64(F.lit("second"), F.col(text_col), number)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """id, keep_id, group_size, kept, digest and the two halves of row_key() for every row.
    digest is null on rows that a cheaper key told apart, unless digest_all."""
    text = F.col(text_col)
    first, second = row_key(id_col, text_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), first.alias("key"), second.alias("key2"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), normalised(text).alias("norm"))
    base = base.select("id", "key", "key2", "chars", "norm", F.length("norm").alias("size"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"))

    by_prefix = written(base.groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("rows")), "prefixes")
    by_size = by_prefix.groupBy("size").agg(F.sum("rows").alias("of_size")).where("of_size > 1").select("size")
    alive = by_prefix.where("rows > 1").join(by_size, "size", "left_semi").select("size", "prefix", F.col("rows").alias("weight"), F.lit(True).alias("alive"))

    digest = F.sha2("norm", 256)
    if digest_all or alive.count() > BROADCAST_KEYS:  # too many to mark them where texts are read
        rows = looked_up(base.select("id", "key", "key2", "chars", "size", "prefix", digest.alias("digest")), alive, ["size", "prefix"], "weight")
        rows = rows if digest_all else rows.withColumn("digest", F.when(F.col("alive"), F.col("digest")))
    else:
        rows = base.join(F.broadcast(alive), ["size", "prefix"], "left").withColumn("digest", F.when(F.col("alive"), digest))
    rows = written(rows.select("id", "key", "key2", "chars", "size", "digest", "alive", F.monotonically_increasing_id().alias("row")), "rows")

    best = F.min(F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id").alias("keep_id"), F.col("row").alias("keep_row"))).alias("best")
    groups = rows.where("alive").groupBy("size", "digest").agg(best, F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = groups.select("size", "digest", F.col("best.keep_id").alias("keep_id"), F.col("best.keep_row").alias("keep_row"), "group_size")
    full = looked_up(rows, groups, ["size", "digest"], "group_size")
    one = F.col("group_size").isNull()
    return full.select("id", F.when(one, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (one | (F.col("row") == F.col("keep_row"))).alias("kept"), "digest", "key", "key2")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay. Rows are known by 128 bits of id and
    text. Those that go are taken out where texts are read when their counted number allows,
    else by a join; rows that repeat id and text leave one."""
    out = exact_dedup(docs, id_col, text_col)
    keys = out.groupBy("key", "key2").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    names = free_names(docs.columns, ["key", "key2"])
    keys = written(keys.select(F.col("key").alias(names[0]), F.col("key2").alias(names[1]), "kept"), "gone")
    left = having(docs.withColumns(dict(zip(names, row_key(id_col, text_col)))), keys.where("not kept").select(*names), names, anti=True)
    twins = keys.where("kept").select(*names)
    if not twins.limit(1).count():
        return left.select(*docs.columns)
    one = having(left, twins, names).dropDuplicates(names)
    return having(left, twins, names, anti=True).unionByName(one).select(*docs.columns)


def per_document(docs: DataFrame) -> DataFrame:
    out = exact_dedup(docs, digest_all=True)
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))

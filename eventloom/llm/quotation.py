"""Chat formatting by quotation linking.

Each message is parsed into lines with their quote level (the number of leading '>').
Level 0 is the message's own text. Runs of quoted lines are passages; each passage and each
of its lines is normalised (case, white space) and hashed, like every message's own text and
its lines. A quote replies to the latest earlier message of its conversation that has the
hash: that is a running value over (conversation, hash) in turn order, so a line that many
messages share never multiplies rows. Of several matches the lowest level counts, then the
longest passage. Without a match, the parent is the message before.

A conversation in reply order is sorted by parent, then turn: parents come before their
replies and replies to one message stand together. Running values and places are worked out
in sorted ranges of rows with a carry from range to range, so no conversation, and no line of
one, is one task's work; conversations() writes them out in chunks of a bounded number of messages.

Defined results: null text is empty, null roles are 'unknown'; rows with a null conversation
or turn are formatted but have no parent and the place 0, and move no other row's place;
repeated rows each keep a place; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import earlier_max, slices, splits, written

LEVEL = re.compile(r"^\s*((?:>\s?)+)")
WHITE = re.compile(r"\s+")


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text, and (level, passage) of each run of lines of one quote level."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        mark = LEVEL.match(line)
        level = mark.group(1).count(">") if mark else 0
        if level == 0:
            own.append(line)
        elif level == last:
            passages[-1][1].append(line[mark.end() :])
        else:
            passages.append((level, [line[mark.end() :]]))
        last = level
    return "\n".join(own).strip(), [(n, "\n".join(lines)) for n, lines in passages]


def normalised(text: str) -> str:
    return WHITE.sub(" ", text).strip().lower()


def units(text: str) -> set[str]:
    """The normalised text and its normalised lines, without empty ones."""
    return {u for u in (normalised(text), *map(normalised, text.split("\n"))) if u}


def _parse(batches):
    schema = pa.schema([("own", pa.string()), ("has", pa.list_(pa.string())), ("level", pa.list_(pa.int32())), ("quote", pa.list_(pa.string()))])
    for whole in batches:
        for batch in slices(whole):
            own, has, level, quote = [], [], [], []
            for text in batch.column("text").to_pylist():
                body, passages = parse(text)
                found = sorted({(n, u) for n, p in passages for u in units(p)})
                own.append(body)
                has.append(sorted(units(body)))
                level.append([n for n, _ in found])
                quote.append([u for _, u in found])
            cols = [pa.array(c, f.type) for c, f in zip((own, has, level, quote), schema)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "conv_id", "turn", "role")] + cols, names=["row", "conv_id", "turn", "role", *schema.names])


def link(messages: DataFrame) -> DataFrame:
    """row, conv_id, turn, role, own, parent_turn, quoted (whether by a quote)."""
    base = written(messages.select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("unknown")).alias("role"), "text"), "messages")
    parsed = written(base.mapInArrow(_parse, "row long, conv_id long, turn long, role string, own string, has array<string>, level array<int>, quote array<string>"), "parsed")
    placed = parsed.where("conv_id is not null and turn is not null")
    quotes = placed.select("row", "conv_id", "turn", F.explode(F.arrays_zip("level", "quote")).alias("q")).select("row", "conv_id", "turn", F.col("q.level").alias("level"), F.length("q.quote").alias("size"), F.sha2("q.quote", 256).alias("hash"))
    hashes = quotes.select("conv_id", "hash").distinct()
    has = placed.select("conv_id", "turn", F.explode("has").alias("u")).select("conv_id", "turn", F.sha2("u", 256).alias("hash")).join(hashes, ["conv_id", "hash"], "left_semi")
    none = F.lit(None)
    both = quotes.withColumn("said", none.cast("long")).unionByName(has.distinct().select("conv_id", "turn", "hash", F.col("turn").alias("said")), allowMissingColumns=True)
    found = earlier_max(both, ["conv_id", "hash"], "turn", "said", "source").where("row is not null and source is not null")
    best = found.groupBy("row").agg(F.min_by("source", F.struct("level", -F.col("size"), -F.col("source"))).alias("source"))
    turns = placed.select("conv_id", "turn").distinct().withColumn("own", F.col("turn"))
    before = earlier_max(turns, ["conv_id"], "turn", "own", "before").select("conv_id", "turn", "before")
    full = parsed.join(best, "row", "left").join(before, ["conv_id", "turn"], "left")
    return full.select("row", "conv_id", "turn", "role", "own", F.coalesce("source", "before").alias("parent_turn"), F.col("source").isNotNull().alias("quoted"))


def reply_order(linked: DataFrame) -> DataFrame:
    """linked with `place`: rank in the conversation by parent, then turn, then row."""
    keys = ["conv_id", "parent_turn", "turn", "row"]
    linked = written(linked, "linked")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    ranged = written(linked.where(placed).repartitionByRange(splits(linked.sparkSession), *keys).withColumn("_range", F.spark_partition_id()), "ranged")
    inside = F.row_number().over(Window.partitionBy("_range", "conv_id").orderBy(*keys[1:]))
    counts = ranged.groupBy("_range", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_range", "conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = ranged.withColumn("nth", inside).join(base, ["_range", "conv_id"]).withColumn("place", F.col("base") + F.col("nth") - 1)
    return ranked.select(*linked.columns, "place").unionByName(linked.where(~placed).withColumn("place", F.lit(0).cast("long")))


def conversations(ordered: DataFrame, most: int = 256) -> DataFrame:
    """(conv_id, chunk, messages, chat): the conversations of format_chat() in reply order, in
    chunks of at most `most` messages, so a conversation of any length is written out."""
    rows = ordered.where("conv_id is not null and turn is not null").withColumn("chunk", F.floor(F.col("place") / most))
    parts = F.sort_array(F.collect_list(F.struct("place", "chat")))
    return rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("messages"), F.array_join(F.transform(parts, lambda p: p["chat"]), "").alias("chat"))


def format_chat(messages: DataFrame) -> DataFrame:
    """One row per message: conversation, turn, role, parent, place in reply order, and the
    text without quotes as a chat turn."""
    out = reply_order(link(messages))
    chat = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("own"), F.lit("\n"))
    return out.select("conv_id", "turn", "role", "parent_turn", "quoted", "place", chat.alias("chat"))

"""Best-fit packing by minimum bin slack.

Only the histogram of piece lengths decides how full the bins can be, so the plan is made
from at most CAPACITY counts: for the longest length left, a bitset dynamic programme over
the lengths that remain (with their numbers) finds the fullest sequence that holds it; that
combination is taken out as often as the counts allow, and the next is searched. The plan is
a list of combinations whose length doesn't depend on the number of documents. Rows find
their places by their rank within their length: ranks are local to a task, tasks' counts are
summed per length, and the plan's table of rank ranges gives sequence and offset.

Defined results: a null or empty text has the end mark alone; a document of more than
CAPACITY tokens is cut into full pieces behind a shorter first one; an empty table gives no
rows; repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import released, shown_bytes, slices, written

CAPACITY = 1024


# --------------------------------------------------------------------------- tokens


class ByteTokens:
    """Token ids (little-endian, 32 bits each) of whole texts for a byte-level BPE file of the
    tokenizers library. The file's own vocabulary is given as ranks to tiktoken's encoder, which
    splits by the same pattern and merges by the same order in a fifth of the time; special
    strings become their ids as in the library. A text whose white space is too long a run for
    that encoder's pattern goes to the library."""

    #: Fixed value: the pattern of byte-level pre-tokens.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.path, self.library = path, None
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        code = {c: b for b, c in shown_bytes().items()}
        vocab = {t: i for t, i in file["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes([code[c] for c in t]): i for t, i in vocab.items()}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in file["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"the ids of {path} don't rise with its merges")
        self.names = set(self.special)
        self.encode = tiktoken.Encoding(path, pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)._core_bpe.encode_to_tiktoken_buffer

    def by_library(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        try:
            return bytes(self.encode(text, self.names)) if text else b""
        except ValueError:
            return self.by_library(text)


_MADE: dict[str, ByteTokens] = {}


def tokens(path: str) -> ByteTokens:
    """The worker's encoder of that file; its size doesn't grow with the texts."""
    if path not in _MADE:
        _MADE[path] = ByteTokens(path)
    return _MADE[path]


def pieces(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with the task that made it and
    its rank among that task's pieces of that length."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        enc, task, seen = tokens(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = enc.ids(text or "") + tail
                    total, at, k = len(ids) // 4, 0, 0
                    while at < total:
                        n = total - at if total <= capacity else capacity if at or total % capacity == 0 else total % capacity
                        rows.append((doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), task, int(seen[n])))
                        seen[n] += 1
                        at, k = at + n, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


# --------------------------------------------------------------------------- the plan


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum is as near to room as the counts allow. Bit s of the
    set says that sum s can be reached; each length adds its multiples by doubled shifts."""
    limit, reach, trail = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        trail.append((n, reach))
        times, step = min(counts[n], room // n), 1
        while times:
            take = min(step, times)
            reach |= (reach << (n * take)) & limit
            times, step = times - take, step * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for n, before in reversed(trail):
        used = 0
        while not before >> total & 1:
            total, used = total - n, used + 1
        if used:
            out.append((n, used))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, uses)]) combinations that use up the histogram."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        lengths = sorted((n for n in counts if counts[n]), reverse=True)
        found = dict(fullest(counts, lengths, capacity - seed))
        counts[seed] += 1
        found[seed] = found.get(seed, 0) + 1
        times = min(counts[n] // k for n, k in found.items())
        for n, k in found.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
        out.append((times, sorted(found.items(), reverse=True)))
    return out


def places(combinations: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, list[np.ndarray]]:
    """Per length: first ranks, and for each range its first sequence, uses and offset."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, parts in combinations:
        offset = 0
        for n, uses in parts:
            table.setdefault(n, []).append((ranks.get(n, 0), sequence, uses, offset))
            ranks[n] = ranks.get(n, 0) + times * uses
            offset += n * uses
        sequence += times
    return {n: [np.array(c, dtype=np.int64) for c in zip(*rows)] for n, rows in table.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the written rows of pieces()."""
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = written(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    histogram = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(histogram, capacity))
    spark = cut.sparkSession
    shared = spark.sparkContext.broadcast(where)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, sequence, uses, offset = shared.value[n]
                k = np.searchsorted(first, rank[at], "right") - 1
                nth = rank[at] - first[k]
                seq[at], off[at] = sequence[k] + nth // uses[k], offset[k] + n * (nth % uses[k])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(seq), pa.array(off)], schema=schema)

    ranked = cut.join(base.select("length", "task", "base"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document, with its sequence and the offset there."""
    return pack(written(pieces(docs, path, end, capacity), "pieces"), capacity)

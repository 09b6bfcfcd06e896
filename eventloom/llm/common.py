"""Shared pieces of the corpus operators: durable intermediate tables, checked
broadcasts, and byte-level text kernels that work on a whole Arrow batch."""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Broadcasts stay below this many rows of one or two 64-bit ids (about 100 MB as a hash relation).
BROADCAST_KEYS = 1_000_000
#: Text bytes that a kernel handles at once.
SLICE_BYTES = 2 << 20

U64 = np.uint64
MASK64 = (1 << 64) - 1
_SEED = np.random.Generator(np.random.PCG64(0x5EED))
BYTE_CODES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
STEP = 0x9E3779B97F4A7C15 | 1
STEP_INV = pow(STEP, -1, 1 << 64)
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


# --------------------------------------------------------------------------- tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. A session of one machine without the setting gets a
    folder of its own; on a cluster the setting has to be there."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file:///tmp/eventloom-{spark.sparkContext.applicationId}"
    return at.rstrip("/")


#: The tables that the innermost own_tables() block of this context has written.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def own_tables():
    """A list that gets the paths of the tables written in the block, by this context only."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)
        outer = _MADE.get()
        if outer is not None:
            outer += made


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forgotten(spark: SparkSession) -> None:
    """Let the driver collect what no frame refers to any more: Spark removes the shuffle files of
    finished joins then, which else stay beside those of the next stage."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there and
    a lost executor costs no recomputation. The result's `path` names the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def having(df: DataFrame, ids: DataFrame, keys: str | list[str], anti: bool = False) -> DataFrame:
    """Rows of df whose keys are (or aren't) in the frame ids of those columns. The ids are
    broadcast when their counted number is under BROADCAST_KEYS, else both sides shuffle."""
    small = ids.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(ids) if small else ids, keys, "left_anti" if anti else "left_semi")


def free_names(taken: list[str], wanted: list[str]) -> list[str]:
    """The wanted column names, with marks before them until none is taken."""
    mark = "_"
    while any(f"{mark}{w}" in taken for w in wanted):
        mark += "_"
    return [f"{mark}{w}" for w in wanted]


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows left-joined to table, whose keys are unique and whose `weight` is the number of
    rows that each key has. Keys with a thousandth of the rows, at most 1,000, are broadcast, so
    no hot key is dealt to one task; the rest shuffle. Rows with null keys match nothing."""
    table = written(table, "table")
    heavy = max(1000, -(-(table.agg(F.sum(weight)).first()[0] or 0) // 1000))
    hot, cold = table.where(F.col(weight) >= heavy), table.where(F.col(weight) < heavy)
    given = F.lit(True)
    for k in keys:
        given = given & F.col(k).isNotNull()
    whole = rows.where(given)
    near = whole.join(F.broadcast(hot), keys)
    far = whole.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return near.unionByName(far).unionByName(rows.where(~given), allowMissingColumns=True)


def earlier_max(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """df with the maximum of value over rows of the same `by` whose (integer) order is smaller.
    Rows are ranged by (by, order), equal ones together; each range works on its own rows, and
    what earlier ranges end with is carried over, so no group is one task's work."""
    ranged = written(df.repartitionByRange(splits(df.sparkSession), *by, order).withColumn("_range", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("_range", *by).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_inside", F.max(value).over(own))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("_range", *by).agg(F.max(value).alias("_end"))  # a row per group and range that holds it
    carried = ends.withColumn("_carried", F.max("_end").over(before)).where("_carried is not null").drop("_end")
    full = inside.join(carried, ["_range", *by], "left")
    return full.withColumn(name, F.greatest("_inside", "_carried")).drop("_range", "_inside", "_carried")


def splits(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def released(run):
    """A function over batches whose worker gives memory back when its task ends: idle workers
    stay beside those of later stages. Arrow allocates from the C library there, whose free
    pages go back to the system; its own pool would keep them."""

    def go(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        _POWERS.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return go


# --------------------------------------------------------------------------- text kernels


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Parts of a batch with at most `most` bytes of text each (one row at least)."""
    text = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
    if not len(size):
        return
    total, start = np.cumsum(size), 0
    while start < len(size):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and each row's bounds in them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 4096), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:stop] for each span, from one running sum."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(STEP, len(values)), out=sums[1:])
    return mix((sums[stop] - sums[start]) * powers(STEP_INV, len(values) + 1)[start])


def shown_bytes() -> dict[int, str]:
    """The printable characters that stand for bytes in vocabulary files."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shown = {b: chr(b) for b in keep}
    for b in range(256):
        shown.setdefault(b, chr(256 + len(shown) - len(keep)))
    return shown


class Words:
    """Words of each row: byte bounds, 64-bit hashes, and the rows' bounds in them."""

    def __init__(self, column: pa.Array, fold: np.ndarray = LOWER, apart: np.ndarray = WHITE, hashed: bool = True):
        raw, bounds = text_bytes(column)
        inside = ~apart[raw]
        before = np.zeros(len(raw) + 1, dtype=bool)
        before[1:] = inside
        before[bounds] = False
        after = np.zeros(len(raw) + 1, dtype=bool)
        after[:-1] = inside
        after[bounds] = False
        self.raw = raw
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.stop = np.flatnonzero(inside & ~after[1:]) + 1
        self.rows = np.searchsorted(self.start, bounds)
        if hashed:
            self.hash = span_hashes(BYTE_CODES[fold[raw]], self.start, self.stop) if len(raw) else np.zeros(0, np.uint64)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the `size` words from each word on, and whether they are of one row."""
        n = len(self.hash)
        at = np.arange(max(0, n - size + 1))
        found = span_hashes(self.hash, at, at + size)
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))
        return found, row[: len(at)] == row[size - 1 :] if len(at) else np.zeros(0, bool)


def shingle_sets(words: Words, size: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of `size` consecutive words; a row with fewer
    words has the whole sequence as its only one, a row without words has none."""
    found, whole = words.windows(size)
    out = []
    for first, last in zip(words.rows[:-1].tolist(), words.rows[1:].tolist()):
        if last - first >= size:
            own = np.sort(found[first : last - size + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own if keep.all() else own[keep])
        elif last > first:
            out.append(mix(span_hashes(words.hash, np.array([first]), np.array([last])) + U64(last - first)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# --------------------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): one row (node, component) for every node, the
    component named by its smallest node. Each round takes the smallest label next door and
    then follows labels to their own labels, so chains shrink by halves; a hub's rows are
    combined before they are shuffled."""
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("mid"))
        target = label.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = written(step.join(target, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")), "labels")
        moved = new.where("component <> old").limit(1).count()
        dropped(spark, [label.path])
        label = new.select("node", "component")
        label.path = new.path
        if not moved:
            dropped(spark, [both.path])
            return label


# --------------------------------------------------------------------------- sums and forests


def tree_sum(blobs: DataFrame, most: int = 16) -> np.ndarray:
    """The sum of equally long float64 vectors in the binary column `value`, one per task that
    made them (see added()); at most `most` tasks add those, and only their sums come to the
    driver."""

    def add(batches):
        total = None
        for batch in batches:
            for v in batch.column(0).to_pylist():
                own = np.frombuffer(v, dtype=np.float64)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["value"])

    rows = blobs.select("value").repartition(most).mapInArrow(add, "value binary").collect()
    return np.sum([np.frombuffer(r["value"], dtype=np.float64) for r in rows], axis=0) if rows else np.zeros(0)


def added(value):
    """A function over batches that yields the sum of value(batch) over a task's batches."""

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                own = np.asarray(value(batch), dtype=np.float64)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["value"])

    return released(run)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) that connect what the edges do."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]

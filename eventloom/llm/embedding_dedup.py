"""Embedding near-dedup by an epsilon grid order join.

Vectors are scaled to length one, where a cosine of at least c is a distance of at most
eps = sqrt(2 - 2c). They are projected on the LEADING principal dimensions (from covariance
sums over all vectors) and sorted by their grid cells of side eps in those dimensions. The
sequence is cut into intervals of a bounded number of bytes. Pairs of intervals are found by
descending a hierarchy of FAN intervals a node from its root: children of a pair of nodes meet
if their boxes come within eps of each other. A pair of intervals goes to one task, which
halves the two sequences recursively, skips parts whose boxes are further than eps apart
(projection never lengthens a distance, so what is skipped is provably apart) and multiplies
leaves in double precision. An interval is sent once for each interval that it may link with;
links leave the task as sums per vector and a spanning forest, never as pairs.

Vectors of each length have axes, a sequence and a join of their own; their links are united.
Equal vectors (128 bits of hash) are one class before the join, so a vector that a third of
all rows hold costs one row; rows get their class's result back by its hash, and the at most
1,000 classes that hold a thousandth of the rows each by a broadcast.

Defined results: a vector that is null, zero, or holds null or non-finite components links
with nothing, and vectors of different lengths don't link with each other; a row with a null
id links like any other and gets a null component; -0.0 equals 0.0; repeated rows link with
each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import added, components, forest, looked_up, released, tree_sum, written

LEADING = 8
#: Rows of a stored block and of a leaf of the recursion.
BLOCK, LEAF = 1024, 512
#: Bytes of vectors in an interval; small tables are cut into SMALLEST_CUT for parallel work.
INTERVAL_BYTES, SMALLEST_CUT = 32 << 20, 6
FAN = 8
#: Widens boxes against rounding in the projection.
SLACK = 1e-9


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, k1, k2, with null keys where the vector links with nothing), and classes of
    equal usable vectors (cid, least, members, k1, k2, v)."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.select("id", F.when(fine, F.xxhash64("v")).alias("k1"), F.when(fine, F.xxhash64(F.lit(1), "v")).alias("k2"), F.when(fine, v).alias("v"))
    own = rows.where("v is not null").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members"), F.first("v").alias("v"))
    own = written(own.select(F.monotonically_increasing_id().alias("cid"), "least", "members", "k1", "k2", "v"), "classes")
    return written(rows.select("id", "k1", "k2"), "vectors"), own


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column as vectors of length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(own: DataFrame, leading: int) -> np.ndarray:
    """Principal directions of all class vectors, the widest first."""

    def sums(batch):
        x = _unit(batch.column(0))
        x = np.hstack([x, np.ones((len(x), 1))])
        return (x.T @ x).ravel()

    total = tree_sum(own.select("v").mapInArrow(added(sums), "value binary"))
    d = math.isqrt(len(total)) if len(total) else 1
    total = total.reshape(d, d) if len(total) else np.zeros((1, 1))
    mean = total[-1, :-1] / max(total[-1, -1], 1)
    cov = total[:-1, :-1] / max(total[-1, -1], 1) - np.outer(mean, mean)
    return np.linalg.eigh(cov)[1][:, ::-1][:, :leading] if d > 1 else np.zeros((0, 0))


def sequence(own: DataFrame, direction: np.ndarray, eps: float, parts: int) -> DataFrame:
    """Blocks of the sequence in epsilon grid order: interval, place in it, ids, members, unit
    vectors, and the bounds of the block's box. Equal cells are ordered by the vectors' hash,
    so a crowded cell is cut as well."""

    def place(batches):
        for batch in batches:
            if len(batch):
                x = _unit(batch.column("v"))
                cells = pa.array(np.floor(x @ direction / eps).astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "members", "k1")), pa.array([r.tobytes() for r in x], pa.binary()), cells], names=["cid", "members", "k1", "x", "cell"])

    def cut(batches):
        from pyspark import TaskContext

        interval, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                part = batch.slice(k, BLOCK)
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.float64)
                p = x.reshape(len(part), -1) @ direction
                cols = [interval, nth, *(part.column(c).to_numpy().tobytes() for c in ("cid", "members")), x.tobytes(), (p.min(axis=0) - SLACK).tolist(), (p.max(axis=0) + SLACK).tolist()]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([c], y) for c, y in zip(cols, kinds)], names=["interval", "nth", "cid", "members", "x", "low", "high"])
                nth += 1

    placed = written(own.select("cid", "members", "k1", "v").mapInArrow(released(place), "cid long, members long, k1 long, x binary, cell array<int>"), "cells")
    order = [*(F.col("cell")[d] for d in range(direction.shape[1])), F.col("k1")]
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("cid", "members", "x")
    return written(ranged.mapInArrow(released(cut), "interval int, nth int, cid binary, members binary, x binary, low array<double>, high array<double>"), "blocks")


def interval_pairs(blocks: DataFrame, dims: int, parts: int, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of intervals whose boxes come within eps, by descending the
    hierarchy of intervals."""
    edge = lambda f, c: F.array(*(f(F.col(c)[d]) for d in range(dims))).alias(c)
    boxes = written(blocks.groupBy(F.col("interval").alias("node")).agg(edge(F.min, "low"), edge(F.max, "high")), "boxes")
    levels, width = [boxes], 1
    while width < parts:
        width *= FAN
        levels.append(levels[-1].groupBy((F.col("node") / FAN).cast("int").alias("node")).agg(edge(F.min, "low"), edge(F.max, "high")))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    child = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1)).alias(c)
    side = lambda of, s: of.select(F.col("node").alias(s), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"))
    gap = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda t, x: t + x * x)
    for of in reversed(levels[:-1]):
        pairs = pairs.select(child("a"), "b").select("a", child("b")).where("a <= b")
        pairs = written(pairs.join(side(of, "a"), "a").join(side(of, "b"), "b").where(apart <= eps * eps).select("a", "b"), "pairs")
    return pairs


class Part:
    """An interval in a task: its vectors in sequence, and boxes of its halves, quarters, ..."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, x: np.ndarray, direction: np.ndarray):
        self.ids, self.weight, self.x, self.p = ids, weight, x, x @ direction
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, at: tuple[int, int]):
        if at not in self.boxes:
            p = self.p[at[0] : at[1]]
            self.boxes[at] = p.min(axis=0) - SLACK, p.max(axis=0) + SLACK
        return self.boxes[at]


def halves(at: tuple[int, int]) -> list[tuple[int, int]]:
    middle = (at[0] + at[1]) // 2
    return [(at[0], middle), (middle, at[1])] if at[1] - at[0] > LEAF else [at]


def join_parts(a: Part, b: Part, own: bool, cosine: float, eps: float):
    """Index pairs (i, j) of a and b that link, leaf by leaf; own: a is b, then i < j."""
    pending = [((0, len(a.ids)), (0, len(b.ids)))]
    while pending:
        s, t = pending.pop()
        if own and s[0] > t[0]:
            continue
        (low_s, high_s), (low_t, high_t) = a.box(s), b.box(t)
        gap = np.maximum(0, np.maximum(low_s - high_t, low_t - high_s))
        if gap @ gap > eps * eps:
            continue
        if s[1] - s[0] <= LEAF and t[1] - t[0] <= LEAF:
            i, j = np.nonzero(a.x[s[0] : s[1]] @ b.x[t[0] : t[1]].T >= cosine)
            i, j = i + s[0], j + t[0]
            yield (i[i < j], j[i < j]) if own else (i, j)
        else:
            pending += [(u, v) for u in halves(s) for v in halves(t)]


def _join(direction: np.ndarray, cosine: float, eps: float):
    """Over blocks sorted by pair: (cid, links, to) of each pair of intervals."""
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    def part(blocks) -> Part:
        ids, weight = (np.concatenate([np.frombuffer(r[c], np.int64) for r in blocks]) for c in ("cid", "members"))
        return Part(ids, weight, np.concatenate([np.frombuffer(r["x"], np.float64) for r in blocks]).reshape(len(ids), -1), direction)

    def met(a: int, b: int, blocks):
        x = part([r for r in blocks if r["interval"] == a])
        y = x if a == b else part([r for r in blocks if r["interval"] == b])
        n, own = len(x.ids), a == b
        ids = x.ids if own else np.concatenate([x.ids, y.ids])
        weight = x.weight if own else np.concatenate([x.weight, y.weight])
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in join_parts(x, y, own, cosine, eps):
            j = j if own else j + n
            links += np.bincount(i, weight[j], len(ids)).astype(np.int64) + np.bincount(j, weight[i], len(ids)).astype(np.int64)
            if len(i):
                old = np.flatnonzero(root != np.arange(len(ids)))
                node, to = forest(np.concatenate([i, old]), np.concatenate([j, root[old]]), len(ids))
                root = np.arange(len(ids))
                root[node] = to
        keep = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (ids, links, ids[root])], schema=schema)

    def run(batches):
        held, now = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["a"], r["b"]) != now and held:
                    yield from met(*now, held)
                    held = []
                now = r["a"], r["b"]
                held.append(r)
        if held:
            yield from met(*now, held)

    return run


def met(own: DataFrame, n: int, length: int, cosine: float) -> DataFrame:
    """(cid, links, to) of n classes whose vectors have one length: sums of links per class
    and pair of intervals, and forest edges to another class."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    direction = axes(own, LEADING)
    parts = max(-(-n * length * 8 // INTERVAL_BYTES), min(SMALLEST_CUT, -(-n // BLOCK)))
    blocks = sequence(own, direction, eps, parts)
    pairs = interval_pairs(blocks, direction.shape[1], parts, eps)
    to_a = pairs.join(blocks, F.col("a") == F.col("interval"))
    to_b = pairs.where("a < b").join(blocks, F.col("b") == F.col("interval"))
    tasks = min(parts * (parts + 1) // 2, 100_000)
    dealt = to_a.unionByName(to_b).select("a", "b", "interval", "nth", "cid", "members", "x").repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "interval", "nth")
    return dealt.mapInArrow(released(_join(direction, cosine, eps)), "cid long, links long, to long")


def embedding_dedup(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n_links, component, kept of every row."""
    rows, own = classes(vectors, id_col, vec_col)
    counts = own.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    found = own.sparkSession.createDataFrame([], "cid long, links long, to long")
    for length, n in counts:
        if n > 1:
            found = found.union(written(met(own.where(F.size("v") == length), n, length, cosine), "met"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    label = components(found.where("cid <> to").select(F.col("cid").alias("a"), F.col("to").alias("b")))
    told = own.join(links, "cid", "left").join(label.withColumnRenamed("node", "cid"), "cid", "left")
    told = written(told.select("k1", "k2", "least", "members", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "cid").alias("label")), "told")
    smallest = told.groupBy("label").agg(F.min("least").alias("component"))
    told = told.join(smallest, "label").select("k1", "k2", "members", "n_links", "component")
    full = looked_up(rows, told, ["k1", "k2"], "members")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return full.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def per_vector(vectors: DataFrame) -> DataFrame:
    return embedding_dedup(vectors).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")

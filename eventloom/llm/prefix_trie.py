"""Conversation prefix trie by an LCP-aware external mergesort.

A rebuilt conversation is a path of 128-bit names of its turns. Tasks sort bounded runs of
paths and write them with the number of turns that each path shares with the one before it
(its LCP). Runs are cut at common ranges of paths, so that each range fits a task's memory,
and a task merges its parts of all runs with a loser tree: players are told apart by their
LCPs with the last winner, and turns are looked at only from equal LCPs on, never again. The
merged stream keeps the open path on a stack; a node that leaves the path is finished, with
its conversations, children, leaves, tokens and the ids that end there.

Some nodes lie on the first or last path of a range, and may go on in the next. They (and
the conversations' root) come out as parts, are added up by name, and their subtree sums are
completed by doubling: each round adds what stands 1, 2, 4, ... nodes below. Equal paths are
ranged by conversation, so a conversation that a third of all repeat is many tasks' work.

A conversation of any length is one path in pieces of PIECE turns. Each piece is sorted under
the name of the node that it hangs from, the nodes of pieces that go on are parts as well, and
no piece, run or range grows with a conversation. Places of turns are ranks in sorted ranges
with carries. Only the last hash of a node's ids, which is sequential by its nature, reads all of
them in one task: as a stream of joined pieces in order, or nothing at all where one range has them.

Defined results: a null role or text is empty; rows without a conversation id belong to none;
turns are ordered with null first, equal ones by the SHA-256 of length of role, ':', role and
text; repeated rows are turns each; a conversation without turns after the exchange is a member
of the root; c % 5 has the sign of c; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import looked_up, released, splits, written

#: Bytes of a turn's name.
NAME = 16
#: Turns of a piece of a conversation.
PIECE = 1024
#: Bytes of paths and sizes in a sorted run, and in a range of paths.
RUN_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: A conversation takes at most this many turns from another one.
MOST_TAKEN = 8
ROOT = bytes(NAME)


# --------------------------------------------------------------------------- paths


def ranked(messages: DataFrame) -> DataFrame:
    """conv_id, pos (from 0 in its conversation), name, size of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * NAME))
    turns = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name.alias("name"), F.octet_length(text).cast("long").alias("size"))
    turns = written(turns.where("conv_id is not null").withColumn("row", F.monotonically_increasing_id()), "turns")
    keys = ["turn", "name", "row"]
    ranged = written(turns.repartitionByRange(splits(messages.sparkSession), "conv_id", *keys).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_range", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_range", "conv_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("_range", "conv_id").orderBy(*keys))
    return ranged.withColumn("nth", nth).join(base, ["_range", "conv_id"]).select("conv_id", (F.col("base") + F.col("nth") - 1).alias("pos"), "name", "size")


def taken(conv_id):
    """The number of turns that a conversation takes from another one."""
    return F.crc32(conv_id.cast("string")) % (MOST_TAKEN + 1)


def paths(messages: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, piece, path (names of its turns), sizes, ends, long of every rebuilt conversation."""
    turns = written(ranked(messages), "ranked")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("takes", taken(F.col("conv_id"))).withColumn("donor", F.col("conv_id") - F.col("conv_id") % 5)
    given = counts.select(F.col("conv_id").alias("donor"), F.col("n").alias("has"))
    convs = counts.join(given, "donor", "left").withColumn("given", F.least("takes", F.coalesce("has", F.lit(0))))
    convs = written(convs.select("conv_id", "donor", "takes", "given", "n", (F.col("given") + F.greatest(F.col("n") - F.col("takes"), F.lit(0))).alias("length")), "convs")
    heads = turns.where(F.col("pos") < MOST_TAKEN).withColumnRenamed("conv_id", "donor").join(convs.select("conv_id", "donor", "takes", "length"), "donor").where("pos < takes")
    own = looked_up(turns.where(F.col("pos") >= taken(F.col("conv_id"))), convs.select("conv_id", "takes", "given", "length", "n"), ["conv_id"], "n")
    placed = heads.select("conv_id", F.col("pos").alias("place"), "name", "size", "length").unionByName(own.select("conv_id", (F.col("given") + F.col("pos") - F.col("takes")).alias("place"), "name", "size", "length"))
    parts = placed.groupBy("conv_id", F.expr(f"place div {piece}").alias("piece")).agg(F.sort_array(F.collect_list(F.struct("place", F.hex("name").alias("name"), "size"))).alias("turns"), F.max("length").alias("length"))
    full = parts.select("conv_id", "piece", F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), "")).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"), "length")
    bare = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("piece"), F.unhex(F.lit("")).alias("path"), F.array().cast("array<long>").alias("sizes"), "length")
    last = F.greatest(F.expr(f"(length - 1) div {piece}"), F.lit(0))
    return full.unionByName(bare).select("conv_id", "piece", "path", "sizes", (F.col("piece") == last).alias("ends"), (F.col("length") > piece).alias("long"))


def below(name: bytes, more: bytes) -> bytes:
    return hashlib.sha256(name + more).digest()[:NAME]


def hung(found: DataFrame) -> DataFrame:
    """paths() with `key`: the name of the node that a piece hangs from, then its path. Only
    conversations of several pieces are joined, with one short row per piece."""
    several = found.where("long")
    root = F.lit(bytearray(ROOT))
    if not several.limit(1).count():
        return found.withColumn("key", F.concat(root, F.col("path"))).drop("long")

    def run(batches):
        conv, name = None, ROOT
        for batch in batches:
            names = []
            for c, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist()):
                if c != conv:
                    conv, name = c, ROOT
                names.append(name)
                name = below(name, digest)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), pa.array(names, pa.binary())], names=["conv_id", "piece", "hangs"])

    digests = several.select("conv_id", "piece", F.unhex(F.substring(F.sha2("path", 256), 1, 2 * NAME)).alias("digest"))
    names = digests.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, "conv_id long, piece long, hangs binary")
    whole = several.join(names, ["conv_id", "piece"]).withColumn("key", F.concat("hangs", "path")).drop("hangs")
    return found.where("not long").withColumn("key", F.concat(root, F.col("path"))).unionByName(whole).drop("long")


# --------------------------------------------------------------------------- runs


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """The number of names that two keys have in common, which is `start` at least."""
    most = min(len(a), len(b)) // NAME
    if a[start * NAME : most * NAME] == b[start * NAME : most * NAME]:
        return most
    while a[start * NAME : (start + 1) * NAME] == b[start * NAME : (start + 1) * NAME]:
        start += 1
    return start


def sorted_runs(found: DataFrame, most: int = RUN_BYTES) -> DataFrame:
    """Sorted runs of keys: run, nth, lcp (names shared with the key before), key, conv_id, piece, sizes, ends."""
    schema = pa.schema([("run", pa.int64()), ("nth", pa.int64()), ("lcp", pa.int32()), ("key", pa.binary()), ("conv_id", pa.int64()), ("piece", pa.int64()), ("sizes", pa.list_(pa.int64())), ("ends", pa.bool_())])

    def tell(rows, run):
        rows.sort(key=lambda r: r[:2])
        before, out = b"", []
        for nth, r in enumerate(rows):
            out.append((run, nth, shared(before, r[0]), *r))
            before = r[0]
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 10_000]), schema)], schema=schema)

    def run(batches):
        number, rows, held = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "piece", "sizes", "ends"))):
                rows.append(r)
                held += 64 + 2 * len(r[0])
                if held >= most:
                    yield from tell(rows, number)
                    number, rows, held = number + 1, [], 0
        if rows:
            yield from tell(rows, number)

    return found.mapInArrow(released(run), "run long, nth long, lcp int, key binary, conv_id long, piece long, sizes array<long>, ends boolean")


def merged(runs: list[list[tuple]]):
    """(lcp, row) of all rows (lcp, key, conv_id, ...) of sorted runs in order, lcp being that
    with the row before. A loser tree: every inner node keeps the loser of its match with its
    LCP with the winner, and only the last winner's matches are played again."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    at, lcp, loser = [0] * k, [0] * k, [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; lcp of the loser becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        both = shared(x[1], y[1], lcp[a])
        rest = x[1][both * NAME : (both + 1) * NAME], x[2]
        first = rest <= (y[1][both * NAME : (both + 1) * NAME], y[2])
        won, lost = (a, b) if first else (b, a)
        lcp[lost] = both
        return won, lost

    best = list(range(k))
    level, width = best, k
    while width > 1:  # the first round of matches, from the leaves up
        won = []
        for j in range(0, width, 2):
            w, lost = match(level[j], level[j + 1])
            loser[(width + j) // 2] = lost
            won.append(w)
        level, width = won, width // 2
    winner = level[0]
    while heads[winner] is not None:
        yield lcp[winner], heads[winner]
        at[winner] += 1
        own = runs[winner]
        if at[winner] < len(own):
            heads[winner] = own[at[winner]]
            lcp[winner] = heads[winner][0]
        else:
            heads[winner] = None
        node = (k + winner) // 2
        while node:
            winner, loser[node] = match(winner, loser[node])
            node //= 2


# --------------------------------------------------------------------------- nodes

#: Kinds of rows that the merge tells: a finished node, one whose parent is a part, a part, ended ids.
WHOLE, UNDER, PART, ENDED = range(4)
NODE = [("kind", "int"), ("key", "binary"), ("parent", "binary"), ("conv_id", "long"), ("depth", "long"), ("parent_conv_id", "long"), ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"), ("saved", "long"), ("size", "long"), ("ended", "string")]


class Open:
    """A node of the open path."""

    __slots__ = ("name", "size", "convs", "least", "children", "leaves", "saved", "ids", "part", "waiting")

    def __init__(self, name: bytes, size: int, part: bool = False):
        self.name, self.size, self.part = name, size, part
        self.convs, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ids: list[int] = []
        self.waiting: list[tuple] = []


def nodes(stream, piece: int = PIECE):
    """Rows of NODE from the merged rows (lcp, (_, key, conv_id, piece, sizes, ends)) of one range."""
    path: list[Open] = []
    depth0 = 0

    def closed():
        node = path.pop()
        depth, up = depth0 + len(path), path[-1] if path else None
        ids = ",".join(map(str, node.ids))
        top = up is None and depth0 > 0  # it is counted in the piece above
        if up is not None:
            up.convs += node.convs
            up.least = node.least if up.least is None else min(up.least, node.least)
        if node.part:
            if up is not None:
                up.part = True
            for w in node.waiting:
                yield (UNDER, w[0], node.name, w[1], depth + 1, None, *w[2:])
            yield (PART, node.name, up.name if up is not None else None, None if top else node.least, depth, None, 0 if top else node.convs, node.children, node.leaves, node.saved, None if top else node.size, None)
            if node.ids:
                yield (ENDED, node.name, None, node.ids[0], None, None, None, None, None, None, None, ids)
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.convs - 1) * node.size
        for w in node.waiting:
            yield (WHOLE, w[0], node.name, w[1], depth + 1, node.least, *w[2:])
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        up.waiting.append((node.name, node.least, node.convs, node.children, leaves, saved, node.size, hashlib.sha256(ids.encode()).hexdigest()))

    first = True
    for lcp, (_, key, conv, number, sizes, ends) in stream:
        while len(path) > lcp:
            yield from closed()
        if not path:
            depth0 = number * piece
            path.append(Open(key[:NAME], 0, True))
        for k in range(len(path), len(key) // NAME):
            name = below(key[:NAME], hashlib.sha256(key[NAME:]).digest()[:NAME]) if k == piece else below(path[-1].name, key[k * NAME : (k + 1) * NAME])
            path.append(Open(name, sizes[k - 1]))
        last = path[-1]
        last.convs += 1
        last.least = conv if last.least is None else min(last.least, conv)
        if ends:
            last.ids.append(conv)
        if first or not ends:
            last.part, first = True, False
    if path:
        path[-1].part = True
    while path:
        yield from closed()


def merged_nodes(runs: DataFrame, ranges: int, piece: int = PIECE) -> DataFrame:
    """nodes() of every range of the written runs."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in NODE])

    def run(batches):
        own: dict[int, list] = {}
        for batch in batches:
            for number, *row in zip(*(batch.column(c).to_pylist() for c in ("run", "lcp", "key", "conv_id", "piece", "sizes", "ends"))):
                own.setdefault(number, []).append(tuple(row))
        for rows in own.values():
            rows[0] = (0, *rows[0][1:])  # the key before it is in another range
        out = []
        for node in nodes(merged(list(own.values())), piece):
            out.append(node)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ranged = runs.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("run", "nth")
    return ranged.mapInArrow(released(run), ", ".join(f"{n} {t}" for n, t in NODE))


def hashed(pieces: DataFrame) -> DataFrame:
    """key, ended: the hash of all ids that end at a node, from its pieces (key, conv_id, ended) in order."""

    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("ended").to_pylist()):
                if k == key:
                    state.update(b"," + text.encode())
                    continue
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out])], names=["key", "ended"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ended"])

    return pieces.select("key", "conv_id", "ended").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ended string")


def completed(parts: DataFrame) -> DataFrame:
    """Parts of nodes added up, with whole subtrees: key, parent, conv_id, depth, n_convs, n_children, n_leaves, saved."""
    sums = parts.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.max("size").alias("size"))
    sums = written(sums, "parts")
    more = sums.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    full = sums.join(more, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    full = full.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("size"))
    full = written(full.select("key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", F.col("parent").alias("above")), "parts")
    deepest, step = full.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:  # `above` stands `step` nodes higher; sums hold what stands less than that below
        add = full.where("above is not null").groupBy(F.col("above").alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        higher = full.where("above is not null").select(F.col("key").alias("above"), F.col("above").alias("next"))
        full = full.join(add, "key", "left").join(higher, "above", "left")
        full = written(full.select("key", "parent", "conv_id", "depth", "n_convs", "n_children", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.col("next").alias("above")), "parts")
        step *= 2
    return full.drop("above")


def prefix_trie(messages: DataFrame, piece: int = PIECE, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """key, parent (names of nodes), conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved, ended of every node."""
    runs = written(sorted_runs(hung(written(paths(messages, piece), "paths")), run_bytes), "runs")
    held = runs.agg(F.sum(64 + 2 * F.length("key"))).first()[0] or 0
    found = written(merged_nodes(runs, max(splits(messages.sparkSession), -(-held // range_bytes)), piece), "nodes")
    parts = written(completed(found.where(F.col("kind") == PART)), "completed")
    columns = ["key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ended"]
    nobody = hashlib.sha256(b"").hexdigest()
    over = parts.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    open_nodes = parts.join(over, "parent", "left").join(hashed(found.where(F.col("kind") == ENDED)), "key", "left").withColumn("ended", F.coalesce("ended", F.lit(nobody)))
    named = over.join(parts.select(F.col("key").alias("parent"), F.greatest("n_children", F.lit(1)).alias("n")), "parent")
    under = looked_up(found.where(F.col("kind") == UNDER).drop("parent_conv_id"), named, ["parent"], "n")
    return found.where(F.col("kind") == WHOLE).select(*columns).unionByName(under.select(*columns)).unionByName(open_nodes.select(*columns))


def per_node(messages: DataFrame) -> DataFrame:
    out = prefix_trie(messages)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ended").alias("ends_sha256"))

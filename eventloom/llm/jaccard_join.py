"""N-gram Jaccard join by count-vector R-trees.

Every text becomes the set of hashes of its runs of five words. Hashing the set into
GROUPS groups gives a point of counts, and the overlap of two sets is at most the sum of
the coordinate minima of their points. Texts that share one of their SKETCH smallest hashes
meet in a run; a run is joined by an R-tree over its points, whose boxes discard pairs of
subtrees by that bound and by size. The pairs that it leaves must pass the same bound over
FINE groups, and those that survive are verified on the whole sets.

Routing: of two sets with similarity J, the smallest hashes of the union are common ones
with probability J each, independently for practical purposes. A linked pair (J >= 0.75)
shares fewer than 3 of the 32 smallest with probability below 1e-15, which is under the
chance of a collision of 64-bit hashes, so no size, frequency or partner limit is needed.

Work on large groups of near copies is kept near linear by components: in ROUNDS rounds every
set is verified against up to SIDES pivots of its runs, chosen anew each round; then only
sets of runs that still hold different components meet in the R-trees, and pairs within one
component are skipped there. A pair is proposed by one run only, that of its first common
hash, and only if it shares SHARED hashes. The R-trees are joined twice: first each set is
verified against the NEAREST sets that share most hashes with it, which joins what the pivots
left of a family to it; then every pair is verified that components still hold apart.

Equal sets are one class, named by two 64-bit hashes of its elements; texts are fetched by a
class's row, which is named by two hashes of id and text. Rows get their class's component by
its hashes, large classes by a broadcast.

Defined results: null or blank texts give an empty set, which links with nothing; a row with a
null id links others and has a null component; repeated rows and equal sets share a component;
an id may repeat with different texts; a component without any id has a null one; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import BROADCAST_KEYS, Words, components, dropped, forgotten, free_names, having, looked_up, mix, own_tables, released, shingle_sets, slices, written
from eventloom.llm.exact_dedup import row_key

GROUPS = 128
#: A multiple of GROUPS: points are kept over so many groups and folded for the trees.
FINE = 512
SKETCH = 32
SHARED = 3
ROUNDS = 2
SIDES = 4
NEAREST = 4
LEAF = 16
FAN = 8
#: Runs up to this many sets are compared pair by pair; longer ones by trees.
SMALL_RUN = 24
#: A run longer than this is dealt to several tasks as pairs of blocks.
BLOCK = 4096
#: Counts in a point are exact below this; pairs of points that both reach it skip the bound.
MOST = 255
#: Fills sketches of small sets; no hash of a set is it but by chance of one in 2**64.
NONE = -(1 << 63)


@dataclass
class JaccardJoin:
    sets: DataFrame  # id, key, key2 (of the row), n, h1, h2 (of its set; null if empty)
    links: DataFrame  # a, b (set numbers), overlap: enough verified links to connect components
    members: DataFrame  # h1, h2, copies, component (smallest id), key, key2 (the row that stands for it)


def _measure(words: int):
    """(id, key, key2, text) to each row's set: size, name, point and sketch."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("point", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(Words(part.column("text")), words)
                points = [np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % FINE, minlength=FINE), MOST).astype(np.uint8).tobytes() for s in sets]
                h1, h2 = set_names(sets)
                some = np.array([len(s) == 0 for s in sets], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("id", "key", "key2")), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, mask=some), pa.array(h2, mask=some), pa.array(points, pa.binary()), pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    schema=schema,
                )

    return run


def set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, which depend on its elements only."""
    out = np.zeros((2, len(sets)), np.uint64)
    for k, s in enumerate(sets):
        one = mix(s)
        out[0, k] = one.sum(dtype=np.uint64) ^ np.uint64(len(s))
        out[1, k] = mix(one ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return mix(out[0]).view(np.int64), mix(out[1]).view(np.int64)


# --------------------------------------------------------------------------- R-tree


class CountTree:
    """Bulk-loaded R-tree over points of counts. levels[0] are the points; each level above
    has a box corner (the coordinate maxima) and the least and greatest set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = np.argsort(-points.var(axis=0), kind="stable")[:3]
        keys = [points[:, d] for d in spread[::-1]] + [np.log2(sizes) // 0.2]
        self.order = np.lexsort(keys)
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(top, low, high)]
        width = LEAF
        while len(top) > 1:
            at = np.arange(0, len(top), width)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))
            width = FAN


def may_link(top_a, low_a, high_a, top_b, low_b, high_b, pct: int) -> np.ndarray:
    """Whether boxes (or points) a and b can hold a pair of similarity pct / 100."""
    fit = (100 * high_a >= pct * low_b) & (100 * high_b >= pct * low_a)
    bound = np.minimum(top_a, top_b).sum(axis=1, dtype=np.int64)
    if max(top_a.max(initial=0), top_b.max(initial=0)) < MOST:
        return fit & ((100 + pct) * bound >= pct * (low_a + low_b))
    return fit & (((100 + pct) * bound >= pct * (low_a + low_b)) | ((top_a.max(axis=1) >= MOST) & (top_b.max(axis=1) >= MOST)))


def tree_join(a: CountTree, b: CountTree, comp_a: np.ndarray, comp_b: np.ndarray, pct: int, own: bool):
    """Pairs of points that may link and aren't of one component, as index arrays. own: a is
    b; then each unordered pair comes once."""
    while len(a.levels) != len(b.levels):
        short = a if len(a.levels) < len(b.levels) else b
        top, low, high = short.levels[-1]
        short.levels.append((top, low, high))
    comps = []
    for tree, comp in ((a, comp_a), (b, comp_b)):
        own_comp = comp[tree.order]
        stack = [(own_comp, own_comp)]
        for k in range(1, len(tree.levels)):
            at = np.arange(0, len(stack[-1][0]), LEAF if k == 1 else FAN)
            stack.append((np.minimum.reduceat(stack[-1][0], at), np.maximum.reduceat(stack[-1][1], at)))
        comps.append(stack)
    depth = len(a.levels) - 1
    roots = len(a.levels[depth][0]), len(b.levels[depth][0])
    pending = [(depth, np.repeat(np.arange(roots[0]), roots[1]), np.tile(np.arange(roots[1]), roots[0]))]
    while pending:
        level, i, j = pending.pop()
        if len(i) > 20_000:
            half = len(i) // 2
            pending += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
            continue
        (ta, la, ha), (tb, lb, hb) = a.levels[level], b.levels[level]
        (ca, da), (cb, db) = comps[0][level], comps[1][level]
        keep = ~((ca[i] == da[i]) & (cb[j] == db[j]) & (ca[i] == cb[j]))
        if own:
            keep &= (i < j) if level == 0 else (i <= j)
        i, j = i[keep], j[keep]
        keep = may_link(ta[i], la[i], ha[i], tb[j], lb[j], hb[j], pct)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            yield a.order[i], b.order[j]
            continue
        width = LEAF if level == 1 else FAN
        na, nb = len(a.levels[level - 1][0]), len(b.levels[level - 1][0])
        ka = (i[:, None] * width + np.arange(width))[:, :, None] + np.zeros(width, np.int64)
        kb = (j[:, None] * width + np.arange(width))[:, None, :] + np.zeros((width, 1), np.int64)
        ka, kb = ka.ravel(), kb.ravel()
        inside = (ka < na) & (kb < nb)
        pending.append((level - 1, ka[inside], kb[inside]))


def proposed(key: np.ndarray, a: np.ndarray, b: np.ndarray, sketch: np.ndarray, sizes: np.ndarray, fine: np.ndarray, pct: int) -> np.ndarray:
    """How many sketch hashes pairs (a, b) of rows share; 0 unless they are SHARED or more, the
    first of them is key and the bound over FINE groups lets the pair link."""
    count = np.zeros(len(a), dtype=np.int64)
    for k in range(0, len(a), 4096):
        i, j = a[k : k + 4096], b[k : k + 4096]
        may = np.flatnonzero(may_link(fine[i], sizes[i], sizes[i], fine[j], sizes[j], sizes[j], pct))
        x, y = sketch[i[may]], sketch[j[may]]
        shared = (x[:, :, None] == y[:, None, :]).any(axis=2) & (x != NONE)
        first = x[np.arange(len(x)), shared.argmax(axis=1)]
        own = shared.sum(axis=1)
        count[k + may] = np.where((own >= SHARED) & (first == key[i[may]]), own, 0)
    return count


def folded(fine: np.ndarray) -> np.ndarray:
    """Points over GROUPS groups from points over FINE groups."""
    return np.minimum(fine.reshape(len(fine), -1, GROUPS).sum(axis=1, dtype=np.int64), MOST).astype(np.uint8)


def run_pairs(rows: slice, comp, sizes, points, side, pct: int):
    """Row pairs of one long run. side: 0 and 1 for two different blocks, 2 for one block with itself."""
    base, side = rows.start, side[rows]
    if side[0] == 2:
        tree = CountTree(points[rows], sizes[rows])
        yield from ((base + i, base + j) for i, j in tree_join(tree, tree, comp[rows], comp[rows], pct, True))
    else:
        p, q = base + np.flatnonzero(side == 0), base + np.flatnonzero(side == 1)
        if len(p) and len(q):
            yield from ((p[i], q[j]) for i, j in tree_join(CountTree(points[p], sizes[p]), CountTree(points[q], sizes[q]), comp[p], comp[q], pct, False))


def short_pairs(rows: np.ndarray, run: np.ndarray, comp, sizes, points, pct: int):
    """Row pairs within many short runs at once; run: their sorted run numbers."""
    first = np.searchsorted(run, run, "left")
    nth = np.arange(len(run)) - first
    j = np.repeat(np.arange(len(run)), nth)
    i = np.arange(len(j)) - np.repeat(np.cumsum(nth) - nth, nth) + first[j]
    for k in range(0, len(i), 50_000):
        a, b = rows[i[k : k + 50_000]], rows[j[k : k + 50_000]]
        keep = comp[a] != comp[b]
        a, b = a[keep], b[keep]
        keep = may_link(points[a], sizes[a], sizes[a], points[b], sizes[b], sizes[b], pct)
        yield a[keep], b[keep]


def _join_runs(pct: int, nearest: bool):
    """Over rows sorted by (key, block): candidate pairs (a, b), a < b; or, if nearest, for each
    row a (in each piece of its run's work) only the b that shares most hashes with it."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64())])

    def handle(t: pa.Table):
        key, block, side, sid, comp, n = (t.column(c).to_numpy() for c in ("key", "block", "side", "sid", "comp", "n"))
        fine = np.frombuffer(b"".join(t.column("point").to_pylist()), dtype=np.uint8).reshape(-1, FINE)
        points = folded(fine)
        listed = t.column("sketch").combine_chunks()
        length = pc.list_value_length(listed).to_numpy()
        sketch = np.full((len(t), SKETCH), NONE, dtype=np.int64)
        sketch[np.arange(SKETCH) < length[:, None]] = listed.flatten().to_numpy()
        new = np.flatnonzero((np.diff(key, prepend=key[0] - 1) != 0) | (np.diff(block, prepend=-1) != 0))
        length = np.diff(np.append(new, len(t)))
        run = np.repeat(np.arange(len(new)), length)
        short = (length[run] <= SMALL_RUN) & (side == 2)
        rows = np.flatnonzero(short)

        def found():
            yield from short_pairs(rows, run[rows], comp, n, points, pct)
            for r in np.unique(run[~short]):
                yield from run_pairs(slice(new[r], new[r] + length[r]), comp, n, points, side, pct)

        for a, b in found():
            shared = proposed(key, a, b, sketch, n, fine, pct)
            keep = np.flatnonzero(shared)
            a, b, shared = a[keep], b[keep], shared[keep]
            if nearest:
                a, b, shared = np.append(a, b), np.append(b, a), np.append(shared, shared)
                order = np.lexsort((-shared, a))
                best = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
                a, b, shared = sid[a[best]], sid[b[best]], shared[best]
            else:
                a, b = np.minimum(sid[a], sid[b]), np.maximum(sid[a], sid[b])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shared)], schema=schema)

    def go(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key, block = held.column("key").to_numpy(), held.column("block").to_numpy()
            whole = np.flatnonzero((key != key[-1]) | (block != block[-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield from handle(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from handle(held)

    return go


# --------------------------------------------------------------------------- verification


def _check(words: int, pct: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])

    def run(batches):
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text_b"):
                ids_a, ids_b = part.column(0).to_numpy(), part.column(1).to_numpy()
                fresh = [k for k, x in enumerate(ids_a.tolist()) if x not in last and (k == 0 or ids_a[k] != ids_a[k - 1])]
                sets_a = shingle_sets(Words(part.column(2).take(pa.array(fresh, pa.int64()))), words) if fresh else []
                known = last | dict(zip(ids_a[fresh].tolist(), sets_a))
                sets_b = shingle_sets(Words(part.column(3)), words)
                both = np.array([len(np.intersect1d(known[x], y, assume_unique=True)) for x, y in zip(ids_a.tolist(), sets_b)], dtype=np.int64)
                size = np.array([len(known[x]) + len(y) for x, y in zip(ids_a.tolist(), sets_b)], dtype=np.int64)
                keep = 100 * both >= pct * (size - both)
                last = {int(ids_a[-1]): known[int(ids_a[-1])]} if len(ids_a) else last
                yield pa.RecordBatch.from_arrays([pa.array(ids_a[keep]), pa.array(ids_b[keep]), pa.array(both[keep])], schema=schema)

    return run


def verify(pairs: DataFrame, texts: DataFrame, words: int, pct: int) -> DataFrame:
    """The pairs (a, b) that link, with their overlap. texts: sid, text."""
    left = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")
    full = left.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(released(_check(words, pct)), "a long, b long, overlap long")


# --------------------------------------------------------------------------- operator


def pivots(place: DataFrame, turn: int, pct: int) -> DataFrame:
    """Pairs (pivot, set) of different components, whose sizes let them link, to verify first:
    in each run the pivot is the least by a hash that changes with the round and the run's side,
    so sets of one family agree on few pivots and meet up to SIDES of them."""
    side = F.pmod("key", F.lit(SIDES))
    least = F.min(F.struct(F.xxhash64("sid", side, F.lit(turn)), F.col("sid").alias("pivot"), F.col("comp").alias("pivot_comp"), F.col("n").alias("pivot_n"))).alias("least")
    chosen = place.groupBy("key").agg(least).select("key", "least.pivot", "least.pivot_comp", "least.pivot_n")
    fit = 100 * F.least("n", "pivot_n") >= pct * F.greatest("n", "pivot_n")
    met = place.join(chosen, "key").where("comp <> pivot_comp").where(fit).select("pivot", "sid", side.alias("side"))
    strong = met.groupBy("sid", "side", "pivot").agg(F.count(F.lit(1)).alias("shared")).where("shared > 1")
    best = strong.groupBy("sid", "side").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("pivot"))
    return best.select(F.least("pivot", "sid").alias("a"), F.greatest("pivot", "sid").alias("b")).distinct()


def placed(met: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of runs that hold several components of the links, with their components."""
    label = components(links)
    place = met.join(label.select(F.col("node").alias("sid"), "component"), "sid", "left").select("key", "sid", "n", F.coalesce("component", "sid").alias("comp"))
    mixed = place.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("length")).where("low < high").select("key", "length")
    return written(place.join(mixed, "key"), "placed")


def run_join(place: DataFrame, classes: DataFrame, pct: int, nearest: bool = False) -> DataFrame:
    """Pairs (a, b, shared) that the R-trees of all runs leave; see _join_runs."""
    parts = F.ceil(F.col("length") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("sid"), parts).cast("int")
    dealt = (
        place.withColumn("parts", parts).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", "sid", "comp", (F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")).alias("block"), F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
        .join(classes.select("sid", "n", "point", "sketch"), "sid")
        .repartition("key", "block").sortWithinPartitions("key", "block")
    )
    return dealt.mapInArrow(released(_join_runs(pct, nearest)), "a long, b long, shared long")


def nearest_pairs(found: DataFrame) -> DataFrame:
    """Of pairs (a, b, shared) the NEAREST of each a, as pairs a < b."""
    by_share = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    best = found.withColumn("nth", F.row_number().over(by_share)).where(F.col("nth") <= NEAREST)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, key2, text: rows named by 128 bits of id and text."""
    first, second = row_key(id_col, text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), first.alias("key"), second.alias("key2"), F.col(text_col).alias("text"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, pct: int = 75) -> JaccardJoin:
    """The components of all links between texts whose shingle sets have
    100 * intersection >= pct * union."""
    with own_tables() as made:
        found = _joined(keyed(docs, id_col, text_col), words, pct)
        dropped(docs.sparkSession, [p for p in made if p not in (found.sets.path, found.links.path, found.members.path)])
    forgotten(docs.sparkSession)
    return found


def _joined(docs: DataFrame, words: int, pct: int) -> JaccardJoin:
    sets = written(docs.mapInArrow(released(_measure(words)), "id long, key long, key2 long, n long, h1 long, h2 long, point binary, sketch array<long>"), "sets")
    own = sets.where("n > 0").groupBy("h1", "h2").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "key2")).alias("least"), F.count(F.lit(1)).alias("copies"),
        F.first("n").alias("n"), F.first("point").alias("point"), F.first("sketch").alias("sketch"),
    )
    classes = written(own.select(F.monotonically_increasing_id().alias("sid"), "*"), "classes")
    keys = classes.select("sid", "n", F.explode("sketch").alias("key"))
    runs = keys.groupBy("key").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    met = keys.join(runs, "key")
    enough = met.groupBy("sid").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= SHARED).select("sid")
    met = written(met.join(enough, "sid", "left_semi"), "met")

    holders = written(classes.join(met.select("sid").distinct(), "sid", "left_semi").select("sid", "least.key", "least.key2"), "holders")
    texts = docs.join(F.broadcast(holders) if holders.count() <= BROADCAST_KEYS else holders, ["key", "key2"])
    texts = written(texts.select("sid", "text").dropDuplicates(["sid"]), "texts")

    links, place = None, met.select("key", "sid", "n", F.col("sid").alias("comp"))
    for turn in range(ROUNDS):
        found = written(verify(pivots(place, turn, pct), texts, words, pct), "links")
        links = found if links is None else links.union(found)
        place = placed(met, links)
    near = written(verify(nearest_pairs(run_join(place, classes, pct, nearest=True)), texts, words, pct), "links")
    links = links.union(near)
    pairs = run_join(placed(met, links), classes, pct).select("a", "b").distinct()
    links = written(links.union(verify(pairs, texts, words, pct)), "links")

    label = components(links)
    named = classes.join(label.select(F.col("node").alias("sid"), "component"), "sid", "left").select("h1", "h2", "copies", "least", F.coalesce("component", "sid").alias("label"))
    smallest = named.groupBy("label").agg(F.min("least").alias("first"))
    members = named.join(smallest, "label").select("h1", "h2", "copies", F.col("first.id").alias("component"), F.col("first.key").alias("key"), F.col("first.key2").alias("key2"))
    sets = sets.select("id", "key", "key2", "n", "h1", "h2")
    return JaccardJoin(written(sets, "sets"), links, written(members, "members"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without those that belong to a component that
    another row stands for: the one with the smallest id (a null id last). Rows are judged by
    themselves, also where an id repeats or is null; empty texts stay."""
    with own_tables() as made:
        found = ngram_jaccard_join(docs, id_col, text_col)
        told = looked_up(found.sets.select("h1", "h2", F.col("key").alias("own"), F.col("key2").alias("own2")), found.members, ["h1", "h2"], "copies")
        names = free_names(docs.columns, ["key", "key2"])
        gone = told.where("key <> own or key2 <> own2").select(F.col("own").alias(names[0]), F.col("own2").alias(names[1])).distinct()
        gone = written(gone, "gone")
        dropped(docs.sparkSession, [p for p in made if p != gone.path])
    return having(docs.withColumns(dict(zip(names, row_key(id_col, text_col)))), gone, names, anti=True).select(*docs.columns)


def per_document(found: JaccardJoin) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    full = looked_up(found.sets.select("id", "n", "h1", "h2"), found.members.select("h1", "h2", "copies", "component"), ["h1", "h2"], "copies")
    return full.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))

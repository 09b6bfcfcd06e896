"""Substring dedup by prefix-partitioned suffix trees.

The suffix from each word on is put into the group of its variable-length prefix: the words
up to the end of the smallest-hashed ANCHOR-gram that starts in the suffix's first
window - ANCHOR + 1 words. Equal suffix heads have equal prefixes, so a group is one subtree
of the corpus's suffix tree, cut off at the depth of the window, and neighbouring suffixes
mostly share their anchor: about one record per 15 words is sent, which carries the anchor's
hash once and a 64-bit path hash for each of its suffixes. Groups are dealt to memory-sized
partitions by that hash; they are weighed first, and those that a frequent anchor makes too
heavy are split by the path hash too. In a subtree, sorting the path hashes brings the leaves below each
node of window depth together; a node with two leaves or more is deep and internal, so its
window occurs again. Adjoining windows merge into maximal repeats.

Before anything is shuffled, a task builds the trees of its own slice of texts: windows that
repeat inside it are marked there and sent once for all, so a passage that a third of all
rows hold costs one record per slice. Windows are equal if 64 bits of path
and 64 of anchor are; rows are named by 96 bits.

Only words of maximal repeats travel back, as ranges per document; texts are then read again,
and those that have ranges are joined to them.

Defined results: null and blank texts have no words; texts shorter than a window lose none;
repeated rows are documents of their own (all words of such copies of window length or more
are removed from each); a null id is treated like any other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import BROADCAST_KEYS, SAME, Words, forgotten, mix, released, slices, written
from eventloom.llm.exact_dedup import row_key

ANCHOR = 8
#: Bytes of suffix records that a group of subtrees should have.
GROUP_BYTES = 12 << 20
#: Groups at most (200 TB of text fill them); a weighing task holds four bytes for each.
MOST_GROUPS = 1 << 24
#: Tasks that groups are dealt to at most; each works group after group.
MOST_TASKS = 1 << 16
#: Neighbouring suffixes of one anchor: at most a window's number of them. A row's name is doc and doc2.
RECORD = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("doc2", "<u4"), ("start", "<i4"), ("count", "<i2")])
NONE = np.zeros(0, np.int64)
SPAN = np.dtype([("doc", "<i8"), ("doc2", "<u4"), ("start", "<i4"), ("stop", "<i4")])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Where in values the leftmost smallest of each `width` neighbours stands."""
    best, at, span = values.copy(), np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        take = best[step:] < best[:-step]
        at = np.where(take, at[step:], at[:-step])
        best = np.where(take, best[step:], best[:-step])
        span += step
    return at


def suffixes(words: Words, window: int):
    """Of all suffixes with a whole window in their row: word place, path hash, and the place
    and hash of the anchor."""
    path, whole = words.windows(window)
    grams, _ = words.windows(ANCHOR)
    if not len(path):
        return None
    anchor = lowest(grams, window - ANCHOR + 1)[: len(path)]
    at = np.flatnonzero(whole)
    return at, path[at], anchor[at], grams[anchor[at]]


def marked(path: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a suffix's window occurs again among these, and whether it is the first of them."""
    key = mix(anchor) + path
    order = np.argsort(key, kind="stable")
    own, at = key[order], anchor[order]
    if ((own[1:] == own[:-1]) & (at[1:] != at[:-1])).any():  # one sum of different parts
        order = np.lexsort((anchor, key))
        own, at = key[order], anchor[order]
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = (own[1:] == own[:-1]) & (at[1:] == at[:-1])
    again, first = np.empty(len(key), bool), np.empty(len(key), bool)
    again[order] = same[1:] | same[:-1]
    first[order] = ~same[:-1]
    return again, first


def ranges(doc: np.ndarray, start: np.ndarray, window: int, doc2: np.ndarray | None = None):
    """Maximal runs of covered words from window starts: doc, doc2, start, stop."""
    doc2 = np.zeros(len(doc), np.int64) if doc2 is None else doc2
    if not len(doc):
        return doc, doc2, start, start
    order = np.lexsort((start, doc2, doc))
    doc, doc2, start = doc[order], doc2[order], start[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (doc2[1:] != doc2[:-1]) | (start[1:] > start[:-1] + window)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], doc2[first], start[first], start[last] + window


def _group(anchor: np.ndarray, groups: int) -> np.ndarray:
    return (mix(anchor) >> np.uint64(33)).astype(np.int64) % groups


def _weigh(window: int, groups: int, share: float):
    """Texts to (group, n): the suffixes that a group would be sent, from each task only for
    groups that take more than this share of the task's suffixes."""

    def run(batches):
        total = np.zeros(groups, np.int32)
        for batch in batches:
            for part in slices(batch):
                found = suffixes(Words(part.column("text"), SAME), window)
                if found is not None and len(found[0]):
                    _, first = marked(found[1], found[3])
                    at, n = np.unique(_group(found[3][first], groups), return_counts=True)
                    total[at] += n.astype(np.int32)
        at = np.flatnonzero(total > share * total.sum(dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["group", "n"])

    return run


def pieces(docs: DataFrame, window: int, groups: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The heavy groups, ascending, and into how many pieces each is split; a suffix of a split
    group is its own record. size bytes hold at most size / 2 words, so what tasks leave out of
    a group's weight is less than the weight that makes it heavy, and only heavy groups, at
    most one per GROUP_BYTES of text, come to the driver."""
    heavy = GROUP_BYTES // 2  # suffixes, whose paths take 4 * GROUP_BYTES
    share = 2 * heavy / max(size, 1)
    if share >= 1:
        return NONE, NONE
    weighed = docs.mapInArrow(released(_weigh(window, groups, share)), "group int, n long")
    found = weighed.groupBy("group").agg(F.sum("n").alias("n")).where(F.col("n") > heavy).orderBy("group").collect()
    n = np.array([r["n"] for r in found], np.int64)
    return np.array([r["group"] for r in found], np.int64), -(-n * (8 + RECORD.itemsize) // GROUP_BYTES)


def _send(window: int, groups: int, heavy: np.ndarray = NONE, split: np.ndarray = NONE):
    """Texts to (group, records, paths); group -1 holds ranges that are sure already. The
    pieces that heavy groups are split into are groups of their own, numbered from groups on."""
    schema = pa.schema([("group", pa.int32()), ("records", pa.binary()), ("paths", pa.binary())])
    before = np.cumsum(split) - split

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids, ids2 = part.column("key").to_numpy(), part.column("key2").to_numpy()
                words = Words(part.column("text"), SAME)
                found = suffixes(words, window)
                if found is None or not len(found[0]):
                    continue
                at, path, place, anchor = found
                row = np.searchsorted(words.rows, at, "right") - 1
                start = (at - words.rows[row]).astype(np.int64)
                again, first = marked(path, anchor)
                d, _, s, e = ranges(row[again], start[again], window)
                sure = np.empty(len(d), SPAN)
                sure["doc"], sure["doc2"], sure["start"], sure["stop"] = ids[d], ids2[d], s, e
                out = [(-1, sure.tobytes(), b"")]
                at, path, place, anchor, row, start, again = (x[first] for x in (at, path, place, anchor, row, start, again))
                group = _group(anchor, groups)
                if len(heavy):
                    k = np.minimum(np.searchsorted(heavy, group), len(heavy) - 1)
                    piece = (mix(path) >> np.uint64(33)).astype(np.int64) % split[k]
                    group = np.where(heavy[k] == group, groups + before[k] + piece, group)
                new = np.ones(len(at), bool)
                new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (again[1:] != again[:-1]) | (group[1:] != group[:-1])
                head = np.flatnonzero(new)
                count = np.diff(np.append(head, len(at)))
                rec = np.empty(len(head), RECORD)
                rec["anchor"], rec["doc"], rec["doc2"], rec["start"] = anchor[head], ids[row[head]], ids2[row[head]], start[head]
                rec["count"] = np.where(again[head], -count, count)  # negative: marked here already
                group = group[head]
                order = np.argsort(group, kind="stable")
                source = np.repeat(head[order] - np.append(0, np.cumsum(count[order])[:-1]), count[order]) + np.arange(len(at))
                path, rec, group, length = path[source].astype("<u8"), rec[order], group[order], count[order]
                cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                ends = np.cumsum(length)
                for a, b in zip(cut, np.append(cut[1:], len(group))):
                    lo = ends[a - 1] if a else 0
                    out.append((int(group[a]), rec[a:b].tobytes(), path[lo : ends[b - 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def _subtrees(window: int):
    """Records of whole groups to ranges (doc, doc2, start, stop) of maximal repeats."""
    schema = pa.schema([("doc", pa.int64()), ("doc2", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def emit(*columns):
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], schema=schema)

    def build(records: list[bytes], paths: list[bytes]):
        rec = np.frombuffer(b"".join(records), RECORD)
        path = np.frombuffer(b"".join(paths), "<u8")
        count = np.abs(rec["count"].astype(np.int64))
        anchor = np.repeat(rec["anchor"], count)
        again, _ = marked(path, anchor)
        again &= ~np.repeat(rec["count"] < 0, count)
        start = np.repeat(rec["start"] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(len(anchor))
        yield from emit(*ranges(np.repeat(rec["doc"], count)[again], start[again], window, np.repeat(rec["doc2"], count)[again]))

    def run(batches):
        group, records, paths = None, [], []
        for batch in batches:
            for g, r, p in zip(*(batch.column(c).to_pylist() for c in ("group", "records", "paths"))):
                if g == -1:
                    yield from emit(*(np.frombuffer(r, SPAN)[c] for c in SPAN.names))
                    continue
                if g != group and records:
                    yield from build(records, paths)
                    records, paths = [], []
                group = g
                records.append(r)
                paths.append(p)
        if records:
            yield from build(records, paths)

    return run


def covered(docs: DataFrame, window: int, size: int) -> DataFrame:
    """(doc, doc2, spans) of words covered by repeated windows. docs: key, key2, text; size:
    bytes of text, which only decides the number of groups."""
    forgotten(docs.sparkSession)
    groups = min(max(8, int(size * 2 / GROUP_BYTES)), MOST_GROUPS)
    heavy, split = pieces(docs, window, groups, size)
    sent = docs.mapInArrow(released(_send(window, groups, heavy, split)), "group int, records binary, paths binary")
    groups += int(split.sum())
    spread = F.when(F.col("group") == -1, F.pmod(F.xxhash64("records"), F.lit(groups)).cast("int")).otherwise(F.col("group"))
    dealt = sent.repartition(min(groups, MOST_TASKS), spread).sortWithinPartitions("group")
    found = dealt.mapInArrow(released(_subtrees(window)), "doc long, doc2 long, start long, stop long")
    return found.groupBy("doc", "doc2").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def _remove(digests: bool):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(1), SAME, hashed=False)
                raw, kept_text, n, gone = words.raw.tobytes(), [], [], []
                spans = part.column(2).to_pylist()
                for first, last, cover in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), spans):
                    begin, end = words.start[first:last].tolist(), words.stop[first:last].tolist()
                    keep = np.ones(last - first, dtype=bool)
                    for s in cover or ():
                        keep[s["start"] : s["stop"]] = False
                    stay = np.flatnonzero(keep).tolist() if cover else range(last - first)
                    text = b" ".join([raw[begin[k] : end[k]] for k in stay])
                    n.append(last - first)
                    gone.append(last - first - len(stay))
                    kept_text.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_text, pa.string())], schema=schema)

    return run


def names(id_col: str, text_col: str) -> list:
    """96 bits that name a row by its id and whole text, as columns key and key2."""
    first, second = row_key(id_col, text_col)
    return [first.alias("key"), second.bitwiseAND(F.lit(0xFFFFFFFF)).alias("key2")]


def met(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows with the spans of their names. Where the counted number of names allows, they are
    broadcast, and only rows that have spans are shuffled to meet them."""
    told = spans.select(F.col("doc").alias("key"), F.col("doc2").alias("key2"), "spans")
    keys = told.select("key", "key2")
    if keys.count() > BROADCAST_KEYS:
        return rows.join(told, ["key", "key2"], "left")
    few = F.broadcast(keys)
    whole = rows.join(few, ["key", "key2"], "left_anti").withColumn("spans", F.lit(None).cast(told.schema["spans"].dataType))
    return whole.unionByName(rows.join(few, ["key", "key2"], "left_semi").join(told, ["key", "key2"]))


def text_size(docs: DataFrame, text_col: str) -> int:
    return docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, digests: bool = False) -> DataFrame:
    """id, n_words, n_removed and the kept words joined by spaces (with digests: their
    SHA-256) of every row. Rows are told apart by a hash of id and text, so ids may repeat."""
    key = names(id_col, text_col)
    spans = written(covered(docs.select(*key, F.col(text_col).alias("text")), window, text_size(docs, text_col)), "spans")
    full = met(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *key), spans).select("id", "text", "spans")
    return full.mapInArrow(released(_remove(digests)), "id long, n_words long, n_removed long, kept string")


def cleaned_rows(docs: DataFrame, window: int = 35) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) without repeated passages. A text that loses
    words becomes its kept words joined by spaces and n_chars their number of characters; one
    that loses nothing stays untouched, one that loses all goes."""
    key = names("doc_id", "text")
    spans = written(covered(docs.select(*key, "text"), window, text_size(docs, "text")), "spans")
    schema = docs.select("doc_id", "text", "lang", "source", "n_chars").schema
    columns = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(1), SAME, hashed=False)
                raw, new, lost = words.raw.tobytes(), [], []
                for text, cover, first, last in zip(part.column(1).to_pylist(), part.column("spans").to_pylist(), words.rows[:-1].tolist(), words.rows[1:].tolist()):
                    keep = np.ones(last - first, dtype=bool)
                    for s in cover or ():
                        keep[s["start"] : s["stop"]] = False
                    begin, end = words.start[first:last], words.stop[first:last]
                    new.append(b" ".join([raw[begin[k] : end[k]] for k in np.flatnonzero(keep).tolist()]).decode() if cover else text)
                    lost.append(bool(cover))
                text, lost = pa.array(new, pa.string()), pa.array(lost)
                chars = pc.if_else(lost, pc.utf8_length(text).cast(part.column("n_chars").type), part.column("n_chars"))
                out = [part.column(0), text, *(part.column(c) for c in columns[2:4]), chars]
                gone = pc.and_(lost, pc.equal(pc.fill_null(pc.binary_length(text), 0), 0))
                yield pa.RecordBatch.from_arrays(out, names=columns).filter(pc.invert(gone))

    return met(docs.select(*columns, *key), spans).select(*columns, "spans").mapInArrow(released(run), schema)


def per_document(docs: DataFrame, window: int = 35) -> DataFrame:
    out = substring_dedup(docs, window=window, digests=True)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))

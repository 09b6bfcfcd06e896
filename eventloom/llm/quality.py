"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a row of document statistics worked out on its bytes. The statistics are
standardised by the sums of the labelled training rows; cosines of FEATURES random projections
approximate a Gaussian kernel over them. Partitions add up normal equations by fold (a hash of
the statistics, so copies share one) for each of WIDTHS; from these sums alone each of WIDTHS
and RIDGES is solved without each fold and judged by its squared error there, and the best is
solved on all folds. Pooled adjacent violators over BINS equal steps of the score turn scores
into chances; they are fitted on scores of each fold by the model without it. Every sum covers
all labelled training rows; nothing of a label, language, source or id is an input, and
held-out rows choose nothing.

Defined results: null and blank texts get the score of all-zero statistics; with no usable
labels every score is 0.5; a null or other label than 0 and 1 is no label; rows that repeat
an id are scored each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import SAME, Words, added, released, slices, tree_sum, written

FEATURES, BINS, SEED = 256, 1000, 11
#: What the folds choose from: kernel widths and ridge weights a row.
WIDTHS, RIDGES, FOLDS = (3.0, 6.0, 12.0), (1e-5, 1e-4, 1e-3, 1e-2), 4
THRESHOLD = 0.7

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[128:192] = 5  # goes on a character
_CLASS[192:] = 6  # begins a character beyond ASCII
_MARKS = [ord(c) for c in "!?.,|#$%&*<>/\"'-_"]
N_STATS = 12 + 1 + len(_MARKS)


def statistics(column: pa.Array) -> np.ndarray:
    """N_STATS numbers for each text."""
    words = Words(column, SAME)
    raw, rows = words.raw, words.rows
    n = len(rows) - 1
    bounds = np.zeros(n + 1, dtype=np.int64)
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    np.cumsum(lengths, out=bounds[1:])
    row = np.repeat(np.arange(n), lengths)
    by_class = np.bincount(row * 8 + _CLASS[raw], minlength=8 * n).reshape(n, 8).astype(float)
    size = np.maximum(lengths, 1).astype(float)
    chars = np.maximum(lengths - by_class[:, 5], 1)
    number = np.diff(rows).astype(float)
    some = np.maximum(number, 1)
    long = words.stop - words.start
    word_row = np.repeat(np.arange(n), np.diff(rows))
    upper = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(_CLASS[raw] == 3, out=upper[1:])
    small = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(_CLASS[raw] == 4, out=small[1:])
    shout = (upper[words.stop] - upper[words.start] > 0) & (small[words.stop] == small[words.start])
    same = np.zeros(len(long), dtype=bool)
    if len(long) > 1:
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (word_row[1:] == word_row[:-1])
    distinct = np.zeros(n)
    if len(long):
        order = np.lexsort((words.hash, word_row))
        h, w = words.hash[order], word_row[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        distinct = np.bincount(w[new], minlength=n).astype(float)
    mean = np.bincount(word_row, weights=long, minlength=n) / some
    lines = np.bincount(row[raw == 10], minlength=n) + 1.0
    out = [
        np.log1p(number), by_class[:, 2] / chars, by_class[:, 3] / chars, by_class[:, 4] / chars, by_class[:, 1] / size, by_class[:, 6] / chars,
        np.bincount(word_row, weights=shout, minlength=n) / some, np.bincount(word_row, weights=same, minlength=n) / some, distinct / some,
        np.minimum(mean, 30) / 10, np.log1p(some / lines), np.sqrt(np.maximum(0, np.bincount(word_row, weights=long * long, minlength=n) / some - mean**2)) / 10,
        np.log1p(number) * distinct / some,
    ]
    marks = np.full(256, len(_MARKS), dtype=np.int64)
    marks[_MARKS] = np.arange(len(_MARKS))
    by_mark = np.bincount(row * (len(_MARKS) + 1) + marks[raw], minlength=n * (len(_MARKS) + 1)).reshape(n, -1)[:, :-1]
    return np.column_stack([*out, np.sqrt(by_mark / size[:, None])]) if n else np.zeros((0, N_STATS))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    wave: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None
    steps: np.ndarray  # calibrated chance of each bin of the raw score
    low: float
    high: float

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -4, 4)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.wave + self.phase), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        at = (self.raw(stats) - self.low) / max(self.high - self.low, 1e-12) * BINS - 0.5
        return np.interp(at, np.arange(BINS), self.steps)


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rising chance per bin by pooling adjacent violators; empty bins are filled between."""
    at = np.flatnonzero(total > 0)
    pools: list[list[float]] = []
    for k in at:
        pools.append([positive[k], total[k], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], p)]
    values = np.concatenate([np.full(int(n), (p + 0.5) / (t + 1)) for p, t, n in pools])
    return np.interp(np.arange(len(total)), at, np.maximum.accumulate(values))


def _sum(rows: DataFrame, value) -> np.ndarray:
    """tree_sum of value(stats, label, fold) over batches of such rows."""

    def own(batch):
        stats = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, N_STATS)
        return value(stats, batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy())

    return tree_sum(rows.select("stats", "label", "fold").mapInArrow(added(own), "value binary"), 4)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("stats", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in statistics(part.column(1))], pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), "id long, stats binary")


def solved(gram: np.ndarray, right: np.ndarray, n: float, ridge: float) -> np.ndarray:
    """Ridge weights; the last feature is the constant, which isn't drawn to zero."""
    return np.linalg.lstsq(gram + ridge * n * np.diag([*np.ones(FEATURES), 0.0]), right, rcond=None)[0]


def fit(rows: DataFrame) -> Model:
    """The model of (stats, label, fold) rows."""
    first = _sum(rows, lambda x, y, k: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    rng = np.random.default_rng(SEED)
    wave = rng.standard_normal((N_STATS, FEATURES)) / np.sqrt(N_STATS / 8)
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    if not len(first) or not first[0]:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), wave, phase, None, np.full(BINS, 0.5), 0.0, 1.0)
    s, q = first[1 : 1 + N_STATS] / first[0], first[1 + N_STATS :] / first[0]
    scale = np.maximum(np.sqrt(np.maximum(q - s**2, 0)), 1e-3)
    models = [Model(s, scale, wave / w, phase, None, np.full(BINS, 0.5), -0.5, 1.5) for w in WIDTHS]
    d = FEATURES + 1

    def normal(x, y, fold):
        """Per width and fold: Gram matrix, right side, squares of labels, rows."""
        out = np.zeros((len(WIDTHS), FOLDS, d * d + d + 2))
        for m, model in enumerate(models):
            f = model.features(x)
            for k in range(FOLDS):
                own = fold == k
                g, t = f[own], y[own]
                out[m, k] = np.concatenate([(g.T @ g).ravel(), g.T @ t, [t @ t, len(t)]])
        return out.ravel()

    sums = _sum(rows, normal).reshape(len(WIDTHS), FOLDS, -1)
    parts = lambda v: (v[: d * d].reshape(d, d), v[d * d : -2], v[-2], v[-1])
    best = None
    for m, of_width in enumerate(sums):
        whole = of_width.sum(axis=0)
        for ridge in RIDGES:
            error, without = 0.0, []
            for own in of_width:
                gram, right, squares, _ = parts(own)
                rest = parts(whole - own)
                w = solved(rest[0], rest[1], rest[3], ridge)
                without.append(w)
                error += squares - 2 * w @ right + w @ gram @ w
            if best is None or error < best[0]:
                best = error, m, ridge, np.array(without)
    _, m, ridge, without = best
    model, (gram, right, _, n) = models[m], parts(sums[m].sum(axis=0))

    def steps(x, y, fold):
        raw = (model.features(x) * without[fold]).sum(axis=1)
        at = np.clip((raw - model.low) / (model.high - model.low) * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, weights=y, minlength=BINS), np.bincount(at, minlength=BINS)])

    counts = _sum(rows, steps)
    model.weights = solved(gram, right, n, ridge)
    model.steps = isotonic(counts[:BINS], counts[BINS:])
    return model


def score_with(model: Model, rows: DataFrame) -> DataFrame:
    """rows (id, stats) with a score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            stats = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(shared.value.score(stats), 0, 1))], schema=schema)

    return rows.select("id", "stats").mapInArrow(run, "id long, score double")


def training(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(stats, label, fold) of labelled rows that aren't held out; an id with both labels has none."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("label")).where("label in (0, 1)")
    marked = marked.groupBy("id").agg(F.max("label").alias("label"), F.min("label").alias("other")).where("label = other").select("id", "label")
    return written(rows.join(marked, "id").where(~held_out(F.col("id"))).select("stats", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).alias("fold")), "training")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score THRESHOLD or more. They are scored
    where they are read; no text is shuffled. Without usable labels nothing can be told apart, and
    every row stays."""
    model = fit(training(measured(docs, id_col, text_col), labels))
    if model.weights is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                if len(part):
                    good = shared.value.score(statistics(part.column(part.schema.get_field_index(text_col)))) >= THRESHOLD
                    yield part.filter(pa.array(good))

    return docs.mapInArrow(released(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score of every row; labels: doc_id, quality."""
    rows = written(measured(docs, id_col, text_col), "stats")
    train = training(rows, labels)
    return score_with(fit(train), rows).select("id", held_out(F.col("id")).alias("held_out"), "score")


def per_document(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = classify(docs, labels)
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

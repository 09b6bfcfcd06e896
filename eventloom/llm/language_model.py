"""LM scoring by a gated recurrent network, beside smoothed unigram scores.

Counts of all training tokens come from all texts: tasks add up their own, and hashed groups
of words are summed in partitions. The VOCABULARY most frequent words are the network's
symbols, in classes of equal size by frequency; every other word is the symbol "rare" times
its share of the unigram mass of such words, so the model is a distribution over all words.

The network is a GRU with a class-factored softmax: chance of the class, times chance of the
word in it. Splits train copies of it side by side by backpropagation truncated to WINDOW
tokens, with the state carried from window to window, and the weighted mean of the copies
starts the next of ROUNDS. A split cuts each batch of its training texts into LANES stretches
that cover it. Slices of text take turns among the rounds, so over all rounds the network
learns from each token once. In scoring, texts of a batch run side by side, longest first;
states are carried over all windows of the whole text.

Words among the at most FREQUENT commonest (and the end) are looked up in a broadcast table;
occurrences of all others are joined to the full counts.

Defined results: a null or blank text is the end token alone; a null id is learned from and
not held out; repeated rows are scored each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Words, mix, released, slices, splits, tree_sum, written

VOCABULARY, CLASSES = 2048, 32
EMBED = HIDDEN = 24
WINDOW, LANES, ROUNDS, RATE, SEED = 16, 256, 2, 0.08, 3
LIMIT = 60.0
FREQUENT = 1 << 20
END_HASH = np.uint64(0x9D3C5A1E77B2460F)
#: Symbols 0 and 1; words follow by frequency.
RARE, END = 0, 1
PER_CLASS = VOCABULARY // CLASSES
#: Bytes of text that are counted, trained on or scored side by side.
TOGETHER = 24 << 20
COUNT = np.dtype([("hash", "<u8"), ("n", "<u4")])


def together(batches):
    """Batches of at most TOGETHER bytes of text."""
    for batch in batches:
        yield from slices(batch, "text", TOGETHER)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))


# --------------------------------------------------------------------------- counts


def _merge(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    h, n = hashes[order], n[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
    return h[at], np.add.reduceat(n, at) if len(h) else n


def token_counts(train: DataFrame, parts: int) -> DataFrame:
    """(hash, c) of every token of the texts, the end token included."""

    def count(batches):
        for batch in together(batches):
            hashes, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for part in slices(batch):
                h = np.sort(Words(part.column(part.schema.get_field_index("text"))).hash)
                at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
                hashes.append(h[at])
                n.append(np.diff(np.append(at, len(h))))
            hashes.append(np.array([END_HASH]))
            n.append(np.array([len(batch)]))
            h, c = _merge(np.concatenate(hashes), np.concatenate(n))
            rec = np.empty(len(h), COUNT)
            rec["hash"], rec["n"] = h, c
            group = (mix(h) >> np.uint64(33)).astype(np.int64) % parts
            order = np.argsort(group, kind="stable")
            rec, group = rec[order], group[order]
            cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            ends = np.append(cut[1:], len(group))
            yield pa.RecordBatch.from_arrays([pa.array(group[cut], pa.int32()), pa.array([rec[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], names=["group", "counts"])

    def add(batches):
        hashes, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            rec = np.frombuffer(b"".join(batch.column(1).to_pylist()), COUNT)
            hashes.append(rec["hash"])
            n.append(rec["n"].astype(np.int64))
        h, c = _merge(np.concatenate(hashes), np.concatenate(n))
        for k in range(0, len(h), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 500_000].view(np.int64)), pa.array(c[k : k + 500_000])], names=["hash", "c"])

    sent = train.select("text").mapInArrow(released(count), "group int, counts binary")
    return written(sent.repartition(parts, "group").mapInArrow(released(add), "hash long, c long"), "counts")


@dataclass
class Lexicon:
    hashes: np.ndarray  # sorted
    logp: np.ndarray  # log10 of the unigram chance
    symbol: np.ndarray
    total: int  # N
    kinds: int  # V
    unseen: float  # log10 chance of a token that training lacks
    rare: float  # log10 of the unigram mass of "rare"
    start: np.ndarray  # natural log chances of the symbols
    whole: bool  # whether every word of the training texts is in the table

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table and whether it is there, for sorted or unsorted hashes."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        return at, (self.hashes[at] == h) if len(self.hashes) else np.zeros(len(h), bool)


def lexicon(counts: DataFrame) -> Lexicon:
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = sums["n"], sums["v"]
    by_count = counts.groupBy("c").agg(F.count(F.lit(1)).alias("words"))
    ranked = sorted(((r["c"], r["words"]) for r in by_count.collect()), reverse=True)  # distinct counts: about the square root of N
    least, have = None, 0
    for c, words in ranked:
        if have + words > FREQUENT:
            break
        least, have = c, have + words
    end = F.col("hash") == int(END_HASH.view(np.int64))  # always in the table
    top = counts.where(end if least is None else end | (F.col("c") >= least)).toArrow()
    h, c = top.column("hash").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    below = np.log10(total + 0.5 * (kinds + 1))
    logp = np.log10(c + 0.5) - below
    symbol = np.zeros(len(h), np.int16)
    best = [k for k in np.lexsort((h, -c))[: VOCABULARY - 1].tolist() if h[k] != END_HASH][: VOCABULARY - 2]
    symbol[best] = np.arange(2, 2 + len(best))
    symbol[h == END_HASH] = END
    mass = np.full(VOCABULARY, 1e-12)
    known = symbol != RARE
    mass[symbol[known]] = 10.0 ** logp[known]
    mass[RARE] = max(1 - mass[1:].sum(), 1e-12)
    return Lexicon(h, logp, symbol, int(total), int(kinds), float(np.log10(0.5) - below), float(np.log10(mass[RARE])), np.log(mass), have == kinds)


# --------------------------------------------------------------------------- network

SHAPES = {"emb": (VOCABULARY, EMBED), "wx": (EMBED, 3 * HIDDEN), "b": (3 * HIDDEN,), "wh": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "ww": (CLASSES, HIDDEN, PER_CLASS), "bw": (CLASSES, PER_CLASS)}


def initial(start: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights whose softmaxes begin as the unigram chances of the symbols."""
    rng = np.random.default_rng(SEED)
    p = {k: (rng.standard_normal(s) * (0.3 if k == "emb" else 1 / np.sqrt(HIDDEN))).astype(np.float32) for k, s in SHAPES.items()}
    p["wc"] *= 0.05
    p["ww"] *= 0.05
    p["b"][:] = 0
    by_class = start.reshape(CLASSES, PER_CLASS)
    p["bc"] = np.log(np.exp(by_class).sum(1)).astype(np.float32)
    p["bw"] = (by_class - p["bc"][:, None]).astype(np.float32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel().astype(np.float64) for k in SHAPES])


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(table: np.ndarray, wh: np.ndarray, token: np.ndarray, h: np.ndarray):
    """One GRU step; table: input part of the gates for each symbol."""
    x, u = table[token], h @ wh
    zr = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
    return n + z * (h - n), (z, r, n, u[:, 2 * HIDDEN :])


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits, in place, and its sums by row. Logits are held within LIMIT, which is
    part of the model and saves looking for the largest of each row."""
    np.clip(logits, -LIMIT, LIMIT, out=logits)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], logits.dtype)


def _log_chance(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    own = np.clip(logits[np.arange(len(logits)), target], -LIMIT, LIMIT)
    return own - np.log(_exp(logits)[1])


def _chances(logits: np.ndarray) -> np.ndarray:
    """Softmax in place."""
    e, total = _exp(logits)
    e /= total[:, None]
    return e


def output(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log chance of each target symbol after the state in its row."""
    cls, slot = target // PER_CLASS, target % PER_CLASS
    logp = _log_chance(h @ p["wc"] + p["bc"], cls)
    order = np.argsort(cls.astype(np.int16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(bounds)):
        at = order[bounds[c] : bounds[c + 1]]
        logp[at] += _log_chance(h[at] @ p["ww"][c] + p["bw"][c], slot[at])
    return logp


def train_window(p, g2, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One truncated window (steps x lanes) of backpropagation and an Adagrad update; returns
    the last state. A lane's state is cleared before an end token's input, which starts a text."""
    steps, lanes = inputs.shape
    table = p["emb"] @ p["wx"] + p["b"]
    begins = (inputs != END).astype(np.float32)[:, :, None]
    states = np.empty((steps, lanes, HIDDEN), np.float32)
    z, r, n, un = np.empty((4, steps, lanes, HIDDEN), np.float32)
    for t in range(steps):
        h = states[t] = h * begins[t]
        h, (z[t], r[t], n[t], un[t]) = step(table, p["wh"], inputs[t], h)
    out = (n + z * (states - n)).reshape(-1, HIDDEN)
    target = targets.ravel()
    cls, slot = target // PER_CLASS, target % PER_CLASS
    grad = {"ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"])}
    chance = _chances(out @ p["wc"] + p["bc"])
    chance[np.arange(len(cls)), cls] -= 1
    chance /= lanes
    grad["wc"], grad["bc"] = out.T @ chance, chance.sum(0)
    dout = chance @ p["wc"].T
    order = np.argsort(cls.astype(np.int16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    by_class, slot, dclass, row = out[order], slot[order], np.empty_like(out), np.arange(len(cls))
    for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if a == b:
            continue
        q = _chances(by_class[a:b] @ p["ww"][c] + p["bw"][c])
        q[row[: b - a], slot[a:b]] -= 1
        q /= lanes
        np.matmul(by_class[a:b].T, q, out=grad["ww"][c])
        q.sum(0, out=grad["bw"][c])
        np.matmul(q, p["ww"][c].T, out=dclass[a:b])
    dout[order] += dclass
    # what a step's error becomes at its gates: z, r, n
    dn = (1 - z) * (1 - n * n)
    gates = np.stack([(states - n) * z * (1 - z), dn * un * r * (1 - r), dn], axis=2)
    hidden = gates.copy()
    hidden[:, :, 2] *= r
    errors, wht = dout.reshape(steps, lanes, HIDDEN), p["wh"].T
    dh = np.zeros_like(h)
    for t in range(steps - 1, -1, -1):
        d = errors[t]
        d += dh
        hidden[t] *= d[:, None, :]
        dh = (d * z[t] + hidden[t].reshape(lanes, -1) @ wht) * begins[t]
    gates *= errors[:, :, None, :]
    dgates, dhidden = gates.reshape(steps * lanes, -1), hidden.reshape(steps * lanes, -1)
    grad["wh"] = states.reshape(-1, HIDDEN).T @ dhidden
    token = inputs.ravel()
    order = np.argsort(token.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.diff(token[order], prepend=-1))
    dtable = np.zeros_like(table)
    dtable[token[order[first]]] = np.add.reduceat(dgates[order], first, axis=0)
    grad["emb"], grad["wx"], grad["b"] = dtable @ p["wx"].T, p["emb"].T @ dtable, dtable.sum(0)
    norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
    for k, g in grad.items():
        g *= min(1.0, 5.0 / (norm + 1e-9))
        g2[k] += g * g
        root = np.sqrt(g2[k])
        root += 1e-4
        g *= RATE
        g /= root
        p[k] -= g
    return h


def symbols(lex: Lexicon, column: pa.Array):
    """Words of a slice, the distinct hashes' table places, and each word's distinct hash."""
    words = Words(column)
    kinds, which = np.unique(words.hash, return_inverse=True)
    at, there = lex.look_up(kinds)
    return words, kinds, which, at, there


def _train(lex, weights, nth: int):
    """Round `nth`: every ROUNDS-th slice of the texts; each slice has its turn in one round."""

    def run(batches):
        from pyspark import TaskContext

        p = unflat(weights.value)
        g2 = {k: np.full_like(v, 1e-3) for k, v in p.items()}
        trained, turn = 0, TaskContext.get().partitionId() if TaskContext.get() else 0
        for batch in together(batches):
            streams = []
            for part in slices(batch):
                turn += 1
                if turn % ROUNDS != nth:
                    continue
                words, _, which, at, there = symbols(lex.value, part.column(part.schema.get_field_index("text")))
                sym = np.where(there, lex.value.symbol[at] if len(lex.value.hashes) else 0, RARE)[which] if len(words.hash) else np.zeros(0, np.int64)
                streams.append(np.insert(sym, words.rows[1:], END))
            if not streams:
                continue
            stream = np.concatenate([np.array([END]), *streams]).astype(np.int64)
            lanes = max(1, min(LANES, len(stream) // (32 * WINDOW)))  # a short batch still makes some updates
            length, longer = divmod(len(stream) - 1, lanes)  # the first stretches have one token more
            begin = np.arange(lanes) * length + np.minimum(np.arange(lanes), longer)
            h = np.zeros((lanes, HIDDEN), np.float32)
            for t in range(0, length, WINDOW):
                at = begin[None, :] + t + np.arange(min(WINDOW, length - t) + 1)[:, None]
                h = train_window(p, g2, stream[at[:-1]], stream[at[1:]], h)
            if longer:
                at = begin[None, :longer] + length
                train_window(p, g2, stream[at], stream[at + 1], h[:longer])
            trained += len(stream) - 1
        if trained:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(flat(p) * trained, trained).tobytes()], pa.binary())], names=["value"])

    return run


def fit(train: DataFrame, lex: Lexicon) -> np.ndarray:
    """Weights after ROUNDS of training in splits and averaging."""
    sc = train.sparkSession.sparkContext
    shared, weights = sc.broadcast(lex), flat(initial(lex.start))
    for nth in range(ROUNDS):
        total = tree_sum(train.select("text").mapInArrow(released(_train(shared, sc.broadcast(weights), nth)), "value binary"))
        if len(total):
            weights = total[:-1] / total[-1]
    return weights


def score_texts(p: dict[str, np.ndarray], stream: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log chance of each text's symbols; its last symbol is the end token."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    first, sorted_len = bounds[:-1][order], lengths[order]
    active = len(order) - np.searchsorted(sorted_len[::-1], np.arange(sorted_len[0] + 1), "right") if len(order) else []
    table = p["emb"] @ p["wx"] + p["b"]
    h = np.zeros((len(order), HIDDEN), np.float32)
    token = np.full(len(order), END)
    score = np.zeros(len(order))
    held, lanes, n = [], [], 0

    def flush():
        nonlocal held, lanes, n
        if held:
            a = np.concatenate([x for x, _ in held])
            lane = np.concatenate(lanes)
            score[:] += np.bincount(lane, weights=output(p, a, np.concatenate([y for _, y in held])), minlength=len(score))
            held, lanes, n = [], [], 0

    for t in range(int(sorted_len[0]) if len(order) else 0):
        a = active[t]
        h, _ = step(table, p["wh"], token[:a], h[:a])
        token = stream[first[:a] + t]
        held.append((h, token))
        lanes.append(np.arange(a))
        n += a
        if n >= 16_384:
            flush()
    flush()
    out = np.empty(len(order))
    out[order] = score
    return out


def _score(lex, weights):
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(batches):
        from pyspark import TaskContext

        p, x, nth = unflat(weights.value), lex.value, 0
        end_at, end_there = x.look_up(np.array([END_HASH]))
        end_base = float(x.logp[end_at[0]]) if end_there[0] else x.unseen
        for batch in together(batches):
            streams, sizes, rows = [], [], []
            for part in slices(batch):
                words, kinds, which, at, there = symbols(x, part.column(part.schema.get_field_index("text")))
                n = np.diff(words.rows)
                row = np.repeat(np.arange(len(n)), n)
                if len(x.hashes):
                    sym, logp = np.where(there, x.symbol[at], RARE), np.where(there, x.logp[at], x.unseen if x.whole else 0.0)
                else:
                    sym, logp = np.zeros(len(kinds), np.int64), np.full(len(kinds), x.unseen)
                known = np.bincount(row, weights=there[which], minlength=len(n))
                base = np.bincount(row, weights=logp[which], minlength=len(n))
                own = np.bincount(row, weights=np.where(sym == RARE, logp - x.rare, 0.0)[which], minlength=len(n))
                tails, times = [[]] * len(n), [[]] * len(n)
                if not x.whole:
                    out = np.flatnonzero(~there[which])
                    key = row[out] * len(kinds) + which[out]
                    key, c = np.unique(key, return_counts=True)
                    r, k = key // max(len(kinds), 1), key % max(len(kinds), 1)
                    cut = np.searchsorted(r, np.arange(len(n) + 1))
                    h = kinds.view(np.int64)[k]
                    tails = [h[a:b] for a, b in zip(cut[:-1], cut[1:])]
                    times = [c[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
                streams.append(np.insert(sym[which] if len(which) else np.zeros(0, np.int64), words.rows[1:], END))
                sizes.append(n + 1)
                rows.append((part.column(0), n + 1, known + bool(end_there[0]), base + end_base, own, tails, times))
            if not rows:
                continue
            stream, size = np.concatenate(streams).astype(np.int64), np.concatenate(sizes)
            likely = score_texts(p, stream, np.append(0, np.cumsum(size))) / np.log(10)
            at = 0
            for ids, n, known, base, own, tails, times in rows:
                k = len(n)
                name = (TaskContext.get().partitionId() << 40) + nth + np.arange(k)
                nth += k
                cols = [name, ids, n, known.astype(np.int64), base, likely[at : at + k] + own, tails, times]
                at += k
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base, score of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    train = docs.where(~held_out(F.col("id")))
    counts = token_counts(train, splits(docs.sparkSession))
    lex = lexicon(counts)
    weights = fit(train, lex)
    sc = docs.sparkSession.sparkContext
    kind = "row long, id long, n_tokens long, n_known long, base double, score double, tail array<long>, times array<int>"
    rows = docs.mapInArrow(released(_score(sc.broadcast(lex), sc.broadcast(weights))), kind)
    if lex.whole:
        return rows.select("id", "n_tokens", "n_known", F.lit(lex.total).cast("long").alias("train_tokens"), "base", "score")
    rows = written(rows, "scores")
    below = float(np.log10(lex.total + 0.5 * (lex.kinds + 1)))
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("hash"), F.col("x.times").alias("times"))
    found = tail.join(counts, "hash", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 0.5) - F.lit(below))).alias("more"),
        F.sum("times").alias("all"),
    )
    full = rows.drop("tail", "times").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return full.select("id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base"), (F.col("score") + more).alias("score"))


def per_document(docs: DataFrame) -> DataFrame:
    out = score_corpus(docs)
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.col("base").alias("base_score"), "score")

"""Hidden Markov models of runs of any length, as associative scans over stretches of bins.

What a stretch does to the chances of the states is one k x k matrix: the product of its bins'
moves and emissions, scaled. An expectation step multiplies those within each stretch (a task
has as many stretches as it gets, of any run, and steps through those of one length side by
side), scans the few matrices of a run forwards and
backwards, and gives each stretch the chances that reach it from both sides; the stretch then
works out its own posteriors and returns sums only, added up per task. The best path is the
same scan with (max, +): the states at the ends of stretches first, then each stretch's inside.

Starts, updates, stopping rule and the choice among several starts are those of methods.hmm."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.long_segments import through
from eventloom.sources.stored import removed, stored

STRETCH = 2048
#: Bytes of a task's arrays for the stretches that it steps through side by side.
SIDE_BY_SIDE = 32 << 20
#: Bytes of the chances at the borders of all stretches up to which they are broadcast.
BORDERS = 32 << 20


def packed(signal: DataFrame, value: str = "x", stretch: int = STRETCH) -> DataFrame:
    """run_id, stretch, first (its first bin), n, q, y: the bins of a stretch as one array. Every
    bin of a stretch must have as many clusters as the others."""
    first = stored(signal.groupBy("run_id").agg(F.min("bin").alias("_first")), "firsts")  # of known size, as in sequence.in_pieces
    cut = signal.join(first, "run_id").withColumn("stretch", F.expr(f"(bin - _first) div {stretch}"))
    cells = F.sort_array(F.collect_list(F.struct("bin", "cluster", F.col(value).cast("double").alias("v"))))
    rows = cut.groupBy("run_id", "stretch").agg(cells.alias("cells")).select("run_id", "stretch", F.col("cells.bin").alias("bins"), F.col("cells.v").alias("v"))

    def pack(frames):
        for frame in frames:
            out = []
            for run, nth, bins, v in zip(frame["run_id"], frame["stretch"], frame["bins"], frame["v"]):
                n = 1 + np.count_nonzero(np.diff(bins))
                if len(v) % n or np.diff(bins.reshape(n, -1)).any():
                    raise ValueError(f"bins of stretch {nth} of run {run} differ in their number of clusters")
                out.append((run, nth, bins[0], n, len(v) // n, np.asarray(v, float).tobytes()))
            yield pd.DataFrame(out, columns=["run_id", "stretch", "first", "n", "q", "y"])

    parts = int(signal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "run_id", "stretch")  # a given number, or values that compress well end in one file and every round in one task
    return dealt.mapInPandas(pack, "run_id string, stretch long, first long, n long, q int, y binary")


class Model:
    """Parameters of all starts of a run, in one vector of numbers."""

    def __init__(self, starts: int, k: int, q: int):
        self.shapes = {"done": (starts,), "ll": (starts,), "start": (starts, k), "move": (starts, k, k), "m": (starts, k, q), "v": (starts, k, q), "used_start": (starts, k), "used_move": (starts, k, k), "used_m": (starts, k, q), "used_v": (starts, k, q)}

    def read(self, blob: bytes) -> dict:
        flat, out, at = np.frombuffer(blob), {}, 0
        for name, shape in self.shapes.items():
            size = math.prod(shape)
            out[name] = flat[at : at + size].reshape(shape).copy()
            at += size
        return out

    def write(self, p: dict) -> bytes:
        return np.concatenate([np.asarray(p[n], float).ravel() for n in self.shapes]).tobytes()


def log_chances(kind: str, y: np.ndarray, m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """stretches x starts x bins x states."""
    y, m, v = y[:, None], m[:, :, None], v[:, :, None]
    if kind == "gaussian":
        return -0.5 * ((y[..., None, :] - m) ** 2 / v + np.log(2 * np.pi * v)).sum(4)
    by_state = m[:, :, 0].swapaxes(2, 3)
    if kind == "poisson":
        kinds, which = np.unique(y, return_inverse=True)
        const = np.array([math.lgamma(u + 1) for u in kinds])[which].reshape(y.shape).sum(3)
        return y @ np.log(by_state) - m.sum(4) - const[..., None]
    return y @ np.log(by_state) + (1 - y) @ np.log(1 - by_state)


def scaled_chances(kind: str, y: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Chances of the bins over the largest, bins first, and the logarithms of the largest."""
    log_b = np.ascontiguousarray(log_chances(kind, y, p["m"], p["v"]).transpose(2, 0, 1, 3))
    top = log_b.max(3)
    return np.exp(log_b - top[..., None]), top


def stretch_matrices(b: np.ndarray, move: np.ndarray, head: np.ndarray) -> np.ndarray:
    """stretches x starts x k x k: chances of the states at a stretch's end from those before it;
    a run's first bin has no move before it."""
    total = np.where(head[:, None, None, None], np.eye(move.shape[2]), move)
    for t in range(len(b)):
        total = (total @ move if t else total) * b[t][..., None, :]
        total /= total.sum((2, 3), keepdims=True)
    return total


def stretch_sums(y: np.ndarray, b: np.ndarray, top: np.ndarray, p: dict, before: np.ndarray, after: np.ndarray, head: np.ndarray) -> np.ndarray:
    """stretches x starts x numbers: log likelihood, first posterior, moves, and posteriors times 1, y, y * y."""
    n, move, tail = len(b), p["move"], head[:, None, None]
    a, scale, back = np.empty_like(b), np.empty(b.shape[:3]), np.empty_like(b)
    for t in range(n):
        last = before if t == 0 else a[t - 1]
        reach = (last[..., None, :] @ move)[..., 0, :]
        a[t] = (reach if t else np.where(tail, before, reach)) * b[t]
        scale[t] = a[t].sum(2)
        a[t] /= scale[t][..., None]
    back[n - 1] = after / (a[n - 1] * after).sum(2, keepdims=True)
    xi = np.zeros_like(move)
    for t in range(n - 1, -1, -1):
        later = b[t] * back[t] / scale[t][..., None]
        came = a[t - 1] if t else np.where(tail, 0.0, before)
        xi += came[..., None] * move * later[..., None, :]
        if t:
            back[t - 1] = (move @ later[..., None])[..., 0]
    g = a * back
    g /= g.sum(3, keepdims=True)
    ll = (np.log(scale) + top).sum(0)
    own, y = g.transpose(1, 2, 3, 0), y[:, None]
    first = np.where(tail, g[0], 0.0)
    flat = (*ll.shape, -1)
    return np.concatenate([ll[..., None], first, xi.reshape(flat), own.sum(3), (own @ y).reshape(flat), (own @ (y * y)).reshape(flat)], 2)


def updated(kind: str, p: dict, sums: np.ndarray, k: int, q: int) -> dict:
    """The next parameters; those of a start that has come to rest stay."""
    ll, first, xi, g, gy, gyy = np.split(sums, np.cumsum([1, k, k * k, k, k * q]), axis=1)
    ll, xi, gy, gyy = ll[:, 0], xi.reshape(-1, k, k), gy.reshape(-1, k, q), gyy.reshape(-1, k, q)
    rest = p["done"] > 0
    now = {"start": first, "move": (xi + 1e-9) / (xi + 1e-9).sum(2, keepdims=True)}
    mean = gy / np.maximum(g, 1e-12)[..., None]
    if kind == "gaussian":
        now |= {"m": mean, "v": np.maximum(gyy / np.maximum(g, 1e-12)[..., None] - mean * mean, 0) + 1e-4}
    else:
        now |= {"m": np.maximum(mean, 1e-6) if kind == "poisson" else np.clip(mean, 1e-4, 1 - 1e-4), "v": p["v"]}
    stops = rest | (ll - p["ll"] < 1e-6 * np.abs(ll))
    out = {"done": stops.astype(float), "ll": np.where(rest, p["ll"], ll)}
    for name in ("start", "move", "m", "v"):
        hold = stops.reshape(-1, *[1] * (p[name].ndim - 1))
        out[name] = np.where(hold, p[name], now[name])
        out[f"used_{name}"] = p[name]
    return out


# ------------------------------------------------------------------- over stretches


def side_by_side(frame: pd.DataFrame, starts: int, k: int):
    """Rows of packed() with a model, as many of one length at a time as SIDE_BY_SIDE holds: the
    rows, y (stretches x bins x values), the models' numbers by stretch, and whether it is a run's first."""
    for (n, q), rows in frame.groupby(["n", "q"], sort=False):
        most = max(1, SIDE_BY_SIDE // (8 * n * starts * k * (3 * q + 6)))
        for at in range(0, len(rows), most):
            some = rows.iloc[at : at + most]
            which, blobs = pd.factorize(some["model"])
            models = [Model(starts, k, q).read(x) for x in blobs]
            p = {name: np.stack([x[name] for x in models])[which] for name in models[0]}
            yield some, np.stack([np.frombuffer(x) for x in some["y"]]).reshape(-1, n, q), p, some["stretch"].to_numpy() == 0


def _begun(pack: DataFrame, kind: str, k: int, starts: int, stretch: int) -> DataFrame:
    """run_id, q, model: the starts that methods.hmm draws."""

    def sizes(frames):
        for frame in frames:
            out = []
            for run, n, q, blob in zip(frame["run_id"], frame["n"], frame["q"], frame["y"]):
                y = np.frombuffer(blob).reshape(n, q)
                out.append((run, n, q, y.mean(0).tobytes(), ((y - y.mean(0)) ** 2).sum(0).tobytes()))
            yield pd.DataFrame(out, columns=["run_id", "n", "q", "mean", "ss"])

    def draw(frame):
        n, q = frame["n"].to_numpy(), int(frame["q"].iloc[0])
        mean, ss = (np.stack([np.frombuffer(x) for x in frame[c]]) for c in ("mean", "ss"))
        whole = (mean * n[:, None]).sum(0) / n.sum()
        var = (ss.sum(0) + (n[:, None] * (mean - whole) ** 2).sum(0)) / n.sum()
        rows = []
        for seed in range(starts):
            drawn = np.random.default_rng(seed).choice(int(n.sum()), k, replace=bool(n.sum() < k))
            rows += [(frame["run_id"].iloc[0], seed, j, int(at) // stretch, int(at) % stretch, q, var.tobytes()) for j, at in enumerate(drawn)]
        return pd.DataFrame(rows, columns=["run_id", "seed", "state", "stretch", "nth", "q", "var"])

    drawn = pack.select("run_id", "n", "q", "y").mapInPandas(sizes, "run_id string, n long, q int, mean binary, ss binary").groupBy("run_id").applyInPandas(draw, "run_id string, seed int, state int, stretch long, nth long, q int, var binary")

    def pick(frames):
        for frame in frames:
            own = [np.frombuffer(b).reshape(n, q)[i].tobytes() for b, n, q, i in zip(frame["y"], frame["n"], frame["q"], frame["nth"])]
            yield frame[["run_id", "seed", "state", "q", "var"]].assign(y=own)

    chosen = pack.select("run_id", "stretch", "n", "y").join(drawn, ["run_id", "stretch"]).mapInPandas(pick, "run_id string, seed int, state int, q int, var binary, y binary")

    def begin(frame):
        frame = frame.sort_values(["seed", "state"])
        q = int(frame["q"].iloc[0])
        some = np.stack([np.frombuffer(b) for b in frame["y"]]).reshape(starts, k, q)
        move = np.full((k, k), 0.1 / max(k - 1, 1))
        np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
        m = {"gaussian": some, "poisson": some + 0.1, "bernoulli": 0.25 + 0.5 * some}[kind]
        p = {"done": np.zeros(starts), "ll": np.full(starts, -np.inf), "start": np.full((starts, k), 1 / k), "move": np.tile(move, (starts, 1, 1)), "m": m, "v": np.tile(np.frombuffer(frame["var"].iloc[0]) + 1e-3, (starts, k, 1))}
        p |= {f"used_{n}": p[n] for n in ("start", "move", "m", "v")}
        return pd.DataFrame({"run_id": [frame["run_id"].iloc[0]], "model": [Model(starts, k, q).write(p)], "resting": [False]})

    return chosen.groupBy("run_id").applyInPandas(begin, "run_id string, model binary, resting boolean")


def at_borders(rows: DataFrame, told: DataFrame, stretches: int, size: int) -> DataFrame:
    """rows of stretches with what is told of their borders, `size` bytes for each of counted stretches."""
    return rows.join(F.broadcast(told) if stretches * (size + 100) <= BORDERS else told, ["run_id", "stretch"])


def _round(pack: DataFrame, models: DataFrame, kind: str, k: int, starts: int, stretches: int) -> DataFrame:
    """models after one expectation and maximisation over all stretches, which are counted."""

    def multiply(frames):
        for frame in frames:
            for some, y, p, head in side_by_side(frame, starts, k):
                found = stretch_matrices(scaled_chances(kind, y, p)[0], p["move"], head)
                yield pd.DataFrame({"run_id": some["run_id"], "stretch": some["stretch"], "matrix": [x.tobytes() for x in found], "start": [x.tobytes() for x in p["start"]]})

    def scan(frame):
        frame = frame.sort_values("stretch")
        parts = [np.frombuffer(m).reshape(starts, k, k) for m in frame["matrix"]]
        before, after = [np.frombuffer(frame["start"].iloc[0]).reshape(starts, k)], [np.ones((starts, k))]
        for m in parts[:-1]:
            reach = (before[-1][:, None] @ m)[:, 0]
            before.append(reach / reach.sum(1, keepdims=True))
        for m in reversed(parts[1:]):
            reach = (m @ after[-1][..., None])[..., 0]
            after.append(reach / reach.sum(1, keepdims=True))
        return pd.DataFrame({"run_id": frame["run_id"], "stretch": frame["stretch"], "before": [x.tobytes() for x in before], "after": [x.tobytes() for x in reversed(after)]})

    def add(frames):
        sums: dict[str, list] = {}
        for frame in frames:
            for some, y, p, head in side_by_side(frame, starts, k):
                sides = (np.stack([np.frombuffer(x) for x in some[c]]).reshape(-1, starts, k) for c in ("before", "after"))
                for run, own in zip(some["run_id"], stretch_sums(y, *scaled_chances(kind, y, p), p, *sides, head)):
                    if run in sums:
                        sums[run][1] += own
                    else:
                        sums[run] = [y.shape[2], own]
            if len(sums) > 1000:  # many short runs
                yield pd.DataFrame([(r, q, s.tobytes()) for r, (q, s) in sums.items()], columns=["run_id", "q", "sums"])
                sums = {}
        yield pd.DataFrame([(r, q, s.tobytes()) for r, (q, s) in sums.items()], columns=["run_id", "q", "sums"])

    def maximise(key, sums, model):
        q = int(sums["q"].iloc[0])
        total = sum(np.frombuffer(s) for s in sums["sums"]).reshape(starts, -1)
        shape = Model(starts, k, q)
        p = updated(kind, shape.read(model["model"].iloc[0]), total, k, q)
        return pd.DataFrame({"run_id": [key[0]], "model": [shape.write(p)], "resting": [bool(p["done"].all())]})

    rows = pack.join(models.where("not resting"), "run_id")
    scanned = rows.mapInPandas(multiply, "run_id string, stretch long, matrix binary, start binary").groupBy("run_id").applyInPandas(scan, "run_id string, stretch long, before binary, after binary")
    sums = at_borders(rows, scanned, stretches, 16 * starts * k).mapInPandas(add, "run_id string, q int, sums binary")
    moved = sums.groupBy("run_id").cogroup(models.where("not resting").groupBy("run_id")).applyInPandas(maximise, "run_id string, model binary, resting boolean")
    return models.where("resting").unionByName(moved)


def fitted(pack: DataFrame, k: int, emission: str = "gaussian", starts: int = 3, rounds: int = 50, stretch: int = STRETCH) -> DataFrame:
    """run_id, model, resting of every run of packed()."""
    models, stretches = stored(_begun(pack, emission, k, starts, stretch), "models"), pack.count()
    for _ in range(rounds):
        if not models.where("not resting").limit(1).count():
            break
        new = stored(_round(pack, models, emission, k, starts, stretches), "models")
        removed(models)
        models = new
    return models


def best_paths(pack: DataFrame, models: DataFrame, k: int, emission: str, starts: int) -> DataFrame:
    """run_id, bin, label of the likeliest path under each run's best start."""

    def parts(frame):
        for some, y, p, head in side_by_side(frame, starts, k):
            at = np.arange(len(some)), p["ll"].argmax(1)
            start, move, m, v = (p[f"used_{name}"][at] for name in ("start", "move", "m", "v"))
            log_b = np.ascontiguousarray(log_chances(emission, y, m[:, None], v[:, None])[:, 0].swapaxes(0, 1))
            yield some, np.log(start + 1e-300), np.log(move + 1e-300), log_b, head

    def multiply(frames):
        for frame in frames:
            for some, start, move, log_b, head in parts(frame):
                total = np.where(head[:, None, None], start[:, None], move) + log_b[0][:, None]
                for row in log_b[1:]:
                    total = (total[..., None] + move[:, None]).max(2) + row[:, None]
                ends = [(x[:1] if h else x).tobytes() for x, h in zip(total, head)]
                yield pd.DataFrame({"run_id": some["run_id"], "stretch": some["stretch"], "matrix": ends})

    def scan(frame):
        frame = frame.sort_values("stretch")
        costs = [-np.frombuffer(m).reshape(-1, k) for m in frame["matrix"]]
        reach = costs[0][0]
        for m in costs[1:]:
            reach = (reach[:, None] + m).min(0)
        stops = through(costs, 0, int(reach.argmin()))
        return pd.DataFrame({"run_id": frame["run_id"], "stretch": frame["stretch"], "i": np.array([0, *stops[:-1]], "int32"), "j": np.array(stops, "int32")})

    def inside(frames):
        for frame in frames:
            for some, start, move, log_b, head in parts(frame):
                n, at = len(log_b), np.arange(len(some))
                score, trace = np.where(head[:, None], start, move[at, some["i"]]) + log_b[0], np.empty((n - 1, len(some), k), "int32")
                for t in range(1, n):
                    step = score[..., None] + move
                    trace[t - 1] = step.argmax(1)
                    score = step.max(1) + log_b[t]
                path = np.empty((n, len(some)), "int64")
                path[-1] = some["j"]
                for t in range(n - 1, 0, -1):
                    path[t - 1] = trace[t - 1][at, path[t]]
                yield pd.DataFrame({"run_id": some["run_id"].repeat(n), "bin": (some["first"].to_numpy()[:, None] + np.arange(n)).ravel(), "label": path.T.ravel()})

    rows = pack.join(models, "run_id")
    ends = rows.mapInPandas(multiply, "run_id string, stretch long, matrix binary").groupBy("run_id").applyInPandas(scan, "run_id string, stretch long, i int, j int")
    return at_borders(rows, ends, pack.count(), 8).mapInPandas(inside, "run_id string, bin long, label long")


def long_hmm(signal: DataFrame, k: int, emission: str = "gaussian", starts: int = 3, rounds: int = 50, value: str = "x", stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(run_id, bin, label) of the likeliest paths, and (run_id, log_likelihood) of the best starts."""
    pack = stored(packed(signal, value, stretch), "stretches")
    models = fitted(pack, k, emission, starts, rounds, stretch)

    def told(frames):
        for frame in frames:
            yield pd.DataFrame({"run_id": frame["run_id"], "log_likelihood": [float(np.frombuffer(m)[starts : 2 * starts].max()) for m in frame["model"]]})

    return best_paths(pack, models, k, emission, starts), models.mapInPandas(told, "run_id string, log_likelihood double")

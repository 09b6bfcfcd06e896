"""Agreement of labelings, boundaries and distributions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.numeric import choose2, div
from eventloom.operators import sequence


def contingency(rows: DataFrame, true: str, pred: str, by: list[str] = ["run_id"]) -> DataFrame:
    return rows.groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def agreement(table: DataFrame, by: list[str] = ["run_id"]) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of a
    contingency table, which is small beside the rows."""
    t, p, a = Window.partitionBy(*by, "t"), Window.partitionBy(*by, "p"), Window.partitionBy(*by)
    x = table.withColumn("a", F.sum("n").over(t)).withColumn("b", F.sum("n").over(p)).withColumn("all", F.sum("n").over(a))
    x = x.withColumn("ka", F.count(F.lit(1)).over(t)).withColumn("kb", F.count(F.lit(1)).over(p))
    part = lambda c, k: F.sum(c / F.col(k))
    n, N = F.col("n") * 1.0, F.col("all") * 1.0
    out = x.groupBy(*by).agg(
        F.sum(choose2("n")).alias("s"), part(choose2("a"), "ka").alias("sa"), part(choose2("b"), "kb").alias("sb"), F.first(choose2("all")).alias("pairs"),
        F.sum(n / N * F.log(n * N / (F.col("a") * F.col("b")))).alias("mi"),
        part(-(F.col("a") / N) * F.log(F.col("a") / N), "ka").alias("ha"), part(-(F.col("b") / N) * F.log(F.col("b") / N), "kb").alias("hb"),
    )
    chance = div(F.col("sa") * F.col("sb"), F.col("pairs"))
    ari = F.coalesce(div(F.col("s") - chance, (F.col("sa") + F.col("sb")) / 2 - chance), F.lit(1.0))
    return out.select(*by, ari.alias("ari"), F.coalesce(div(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), F.lit(1.0)).alias("nmi"))


def compare_methods(labels: DataFrame) -> DataFrame:
    """agreement of each two methods of labels(run_id, method, bin, label)."""
    a = labels.select("run_id", "bin", F.col("method").alias("method_a"), F.col("label").alias("la"))
    b = labels.select("run_id", "bin", F.col("method").alias("method_b"), F.col("label").alias("lb"))
    keys = ["run_id", "method_a", "method_b"]
    return agreement(contingency(a.join(b, ["run_id", "bin"]).where("method_a < method_b"), "la", "lb", keys), keys)


def boundaries(labels: DataFrame, value: str = "label") -> DataFrame:
    """Bins at which the label changes."""
    w = Window.partitionBy("run_id").orderBy("bin")
    return labels.withColumn("before", F.lag(value).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(value))).select("run_id", "bin")


def boundary_scores(true: DataFrame, pred: DataFrame, tolerance: int, runs: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 of boundaries within tolerance; buckets of its width make the
    range join an equality join. Both sides empty score 1 (for runs that `runs` names), one
    side empty 0."""
    width = max(1, tolerance)
    bucket = F.floor(F.col("bin") / width)

    def hits(x, y):
        near = y.select("run_id", F.col("bin").alias("other"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k"))
        found = x.withColumn("k", bucket).join(near, ["run_id", "k"]).where(F.abs(F.col("bin") - F.col("other")) <= tolerance)
        return found.select("run_id", "bin").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("h"))

    named = true.select("run_id").union(pred.select("run_id"))
    runs = (named if runs is None else named.union(runs.select("run_id"))).distinct()
    count = lambda x, c: x.groupBy("run_id").agg(F.count(F.lit(1)).alias(c))
    out = runs.join(count(true, "nt"), "run_id", "left").join(count(pred, "np"), "run_id", "left")
    out = out.join(hits(pred, true).withColumnRenamed("h", "hp"), "run_id", "left").join(hits(true, pred).withColumnRenamed("h", "ht"), "run_id", "left").fillna(0)
    none = (F.col("nt") == 0) & (F.col("np") == 0)
    p = F.when(none, 1.0).otherwise(F.coalesce(div(F.col("hp"), F.col("np")), F.lit(0.0)))
    r = F.when(none, 1.0).otherwise(F.coalesce(div(F.col("ht"), F.col("nt")), F.lit(0.0)))
    return out.select("run_id", p.alias("precision"), r.alias("recall"), F.coalesce(div(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def ks_distance(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Greatest distance of the two groups' (0 and 1) distribution functions."""
    per = rows.groupBy("run_id", F.col(value).alias("v")).agg(F.count_if(F.col(group) == 0).alias("a"), F.count_if(F.col(group) == 1).alias("b"))
    whole = per.groupBy("run_id").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    x = sequence.running_sum(sequence.running_sum(per, "v", "a", "sa"), "v", "b", "sb").join(whole, "run_id")
    return x.withColumn("d", F.abs(div(F.col("sa"), F.col("na")) - div(F.col("sb"), F.col("nb")))).groupBy("run_id").agg(F.max("d").alias("ks"))


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the greatest total gain, by shortest augmenting paths on a
    square array padded with zeros; for label tables, whose size is the number of states."""
    n = max(gain.shape)
    cost = np.zeros((n, n))
    cost[: gain.shape[0], : gain.shape[1]] = gain.max() - gain if gain.size else 0
    row_of, u, v = np.full(n, -1), np.zeros(n), np.zeros(n)
    for start in range(n):
        reach, prev, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, shift, free = start, 0.0, -1
        while free < 0:
            slack = cost[row] - u[row] - v + shift
            better = ~done & (slack < reach)
            reach[better], prev[better] = slack[better], row
            col = int(np.argmin(np.where(done, np.inf, reach)))
            shift, done[col] = reach[col], True
            if row_of[col] < 0:
                free = col
            else:
                row = row_of[col]
        u[start] += shift
        for col in np.flatnonzero(done):
            if col != free:
                u[row_of[col]] += shift - reach[col]
                v[col] -= shift - reach[col]
        col = free
        while col >= 0:
            r = prev[col]
            nxt = -1 if r == start else int(np.flatnonzero(row_of == r)[0])
            row_of[col] = r
            col = nxt
    return [(int(r), c) for c, r in enumerate(row_of) if r < gain.shape[0] and c < gain.shape[1]]


def matched_accuracy(table: DataFrame, by: list[str] = ["run_id"]) -> DataFrame:
    """Share of rows that agree under the best matching of labels, per group, one task each. A
    contingency table has a row per pair of states."""

    def run(key, part):
        import pandas as pd

        m = part.pivot_table(index="t", columns="p", values="n", aggfunc="sum", fill_value=0).to_numpy()
        return pd.DataFrame([[*key, float(sum(m[i, j] for i, j in assignment(m)) / m.sum())]], columns=[*by, "accuracy"])

    kinds = ", ".join(f"{n} {t}" for n, t in table.select(*by).dtypes)
    return table.groupBy(*by).applyInPandas(run, f"{kinds}, accuracy double")


def dwell_errors(true: DataFrame, pred: DataFrame) -> DataFrame:
    """Mean dwell of each state in both segment tables, and the absolute difference."""
    mean = lambda x, c: x.groupBy("run_id", "state").agg(F.avg("duration_time").alias(c))
    both = mean(true, "true").join(mean(pred, "pred"), ["run_id", "state"], "full")
    return both.withColumn("error", F.abs(F.col("true") - F.col("pred")))


def transition_errors(true: DataFrame, pred: DataFrame) -> DataFrame:
    """Frobenius norm and mean absolute difference of two transition tables(run_id, src, dst, p);
    moves that one lacks count as 0."""
    both = true.join(pred.withColumnRenamed("p", "q"), ["run_id", "src", "dst"], "full")
    d = F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))
    return both.groupBy("run_id").agg(F.sqrt(F.sum(d * d)).alias("frobenius"), F.avg(F.abs(d)).alias("mean_error"))


#: Bytes of vectors in a block of rows, and numbers in one piece of distances.
BLOCK_BYTES = 32 << 20
PIECE = 1 << 22


def silhouette(rows: DataFrame) -> DataFrame:
    """Mean Euclidean silhouette of rows(id, label, v). Exact, so each row is measured against
    all: blocks of BLOCK_BYTES meet every other block, which sends a row once per block and not
    per row, and only sums per (row, label) come out."""
    import pandas as pd

    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    tasks = math.isqrt(rows.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-size["numbers"] * 8 // BLOCK_BYTES), min(tasks, size["n"] // 1000))
    dealt = rows.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = dealt.select(F.col("k").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k"), "label", "v", "id")

    def sums(_, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "label": [], "to": [], "d": [], "n": []})
        x, y = np.stack(a["v"]).astype(float), np.stack(b["v"]).astype(float)
        ids, others, yy = a["id"].to_numpy(), b["id"].to_numpy(), (y * y).sum(1)
        kinds, member = np.unique(b["label"].to_numpy(), return_inverse=True)
        member = np.eye(len(kinds))[member]
        total, step = np.empty((len(x), len(kinds))), max(1, PIECE // len(y))
        for i in range(0, len(x), step):
            own = x[i : i + step]
            d = np.sqrt(np.maximum((own * own).sum(1)[:, None] + yy - 2 * own @ y.T, 0))
            d[ids[i : i + step, None] == others] = 0
            total[i : i + step] = d @ member
        n = member.sum(0).astype(int)
        return pd.concat([pd.DataFrame({"id": a["id"], "label": a["label"], "to": to, "d": total[:, j], "n": n[j]}) for j, to in enumerate(kinds)])

    part = left.groupBy("k", "other").cogroup(right.groupBy("k", "other")).applyInPandas(lambda k, a, b: sums(k, a, b), "id long, label int, to int, d double, n long")
    per = part.groupBy("id", "label", "to").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.when(F.col("to") == F.col("label"), div(F.col("d"), F.col("n") - 1))
    other = F.when(F.col("to") != F.col("label"), div(F.col("d"), F.col("n")))
    s = per.groupBy("id", "label").agg(F.max(own).alias("a"), F.min(other).alias("b"))
    return s.agg(F.avg(F.coalesce(div(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))

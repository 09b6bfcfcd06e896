"""Block statistics of sparse weighted edges, fields, and generated connectivity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.numeric import div
from eventloom.operators.candidates import drawn


def placed(edges: DataFrame, posts: DataFrame, pres: DataFrame) -> DataFrame:
    """edges with the populations of both ends; posts and pres are (unit, pop)."""
    return edges.join(posts.select(F.col("unit").alias("post"), F.col("pop").alias("post_pop")), "post").join(pres.select(F.col("unit").alias("pre"), F.col("pop").alias("pre_pop")), "pre")


def ranges_to_units(populations: DataFrame) -> DataFrame:
    """(unit, pop) of half-open id ranges."""
    return populations.where("end_id > start_id").select("pop", F.explode(F.sequence("start_id", F.col("end_id") - 1)).alias("unit"))


def weight_quantum(edges: DataFrame, by: list[str]) -> DataFrame:
    """The negative weight nearest zero, else the least positive, else 0."""
    w = F.col("w")
    return edges.groupBy(*by).agg(F.coalesce(F.max(F.when(w < 0, w)), F.min(F.when(w > 0, w)), F.lit(0.0)).alias("quantum"))


def block_statistics(edges: DataFrame, posts: DataFrame, pres: DataFrame) -> DataFrame:
    """Per (post_pop, pre_pop): numbers of entries and synapses, in-degrees (with the
    multiplicity of weights and by occupied entries) over all posts, weights per entry with
    and without zeros. Parallel edges are one entry; zeros are added by size, never made."""
    entry = placed(edges.groupBy("post", "pre").agg(F.sum("w").alias("w")), posts, pres).where("w <> 0")
    keys = ["post_pop", "pre_pop"]
    q = weight_quantum(entry, keys)
    x = entry.join(q, keys).withColumn("many", F.round(F.col("w") / F.col("quantum")))
    row = x.groupBy(*keys, "post").agg(F.sum("many").alias("deg"), F.count(F.lit(1)).alias("occ"))
    deg = row.groupBy(*keys).agg(*(F.sum(e).alias(n) for e, n in ((F.col("deg"), "d1"), (F.col("deg") ** 2, "d2"), (F.col("occ"), "o1"), (F.col("occ") ** 2, "o2"))))
    ent = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.sum("many").alias("synapses"), F.sum("w").alias("w1"), F.sum(F.col("w") ** 2).alias("w2"), F.first("quantum").alias("quantum"))
    size = lambda u, p, n: u.groupBy(F.col("pop").alias(p)).agg(F.count(F.lit(1)).alias(n))
    out = ent.join(deg, keys).join(size(posts, "post_pop", "n_post"), "post_pop").join(size(pres, "pre_pop", "n_pre"), "pre_pop")
    area = F.col("n_post") * F.col("n_pre")
    mean = lambda s, n: div(F.col(s), n)
    var = lambda s, q, n: F.greatest(F.lit(0.0), div(F.col(q), n) - div(F.col(s), n) ** 2)
    return out.select(
        *keys, "n_post", "n_pre", "entries", "synapses", "quantum",
        mean("d1", F.col("n_post")).alias("indegree_mean"), var("d1", "d2", F.col("n_post")).alias("indegree_var"),
        mean("o1", F.col("n_post")).alias("occupied_mean"), var("o1", "o2", F.col("n_post")).alias("occupied_var"),
        mean("w1", F.col("entries")).alias("nonzero_mean"), var("w1", "w2", F.col("entries")).alias("nonzero_var"),
        mean("w1", area).alias("entry_mean"), var("w1", "w2", area).alias("entry_var"), div(F.col("w1"), F.col("synapses")).alias("per_synapse"),
        div(F.col("entries"), area).alias("density"),
    )


def block_means(edges: DataFrame, n: int, k: int, one: str = "post", two: str = "pre") -> DataFrame:
    """k x k means of an n x n array (ids from 1), zeros included."""
    cell = lambda c: F.floor((F.col(c) - 1) * k / n)
    sums = edges.groupBy(cell(one).alias("i"), cell(two).alias("j")).agg(F.sum("w").alias("s"))
    grid = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    spark = edges.sparkSession
    full = spark.range(1).select(grid.alias("i")).select("i", grid.alias("j")).join(sums, ["i", "j"], "left")
    width = lambda c: F.ceil((F.col(c) + 1) * n / k) - F.ceil(F.col(c) * n / k)
    return full.select("i", "j", (F.coalesce("s", F.lit(0.0)) / (width("i") * width("j"))).alias("mean"))


def homogenized(edges: DataFrame, posts: DataFrame, pres: DataFrame) -> DataFrame:
    """The mean entry of each block, zeros included, instead of its entries."""
    return block_statistics(edges, posts, pres).select("post_pop", "pre_pop", F.col("entry_mean").alias("w"))


def fields(edges: DataFrame, active: DataFrame, units: int = 4096, times: int = 1024) -> DataFrame:
    """Sum of weights from active(t, unit) to each post and time that has any. A product of two
    sparse matrices in blocks: edges by (post, pre) blocks and activity by (pre, time) blocks. A block
    of edges is sent once per time block and one of activity once per post block, a hub's edges
    stand in all of its blocks, and a block pair returns one sum per post and time."""
    block = lambda c, n: F.floor(F.col(c) / n)
    own = edges.select("post", "pre", F.col("w").cast("double").alias("w")).withColumn("i", block("post", units)).withColumn("j", block("pre", units))
    on = active.select(F.col("t").cast("long").alias("t"), F.col("unit").alias("pre")).withColumn("j", block("pre", units)).withColumn("k", block("t", times))
    reach = on.select("j", "k").distinct()
    meets = own.select("i", "j").distinct().join(reach, "j")
    sent = own.join(reach, "j").select("post", "pre", "w", F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("k").alias("bk"))
    lit = on.join(meets, ["j", "k"]).select("pre", "t", F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("k").alias("ak"))

    def add(e: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(a):
            return pd.DataFrame(columns=["post", "t", "h"])
        i, j, k = (int(e[c].iloc[0]) for c in ("bi", "bj", "bk"))
        w, hit, times_on = np.zeros((units, times)), np.zeros((units, times), bool), np.zeros((units, times))
        count = a.groupby(["pre", "t"]).size()
        pre, t = (count.index.get_level_values(n).to_numpy() for n in ("pre", "t"))
        times_on[pre - j * units, t - k * times] = count.to_numpy()
        on = times_on > 0
        post, source, weight = (e[c].to_numpy() for c in ("post", "pre", "w"))
        order = np.argsort(post, kind="stable")
        post, source, weight = post[order], source[order] - j * units, weight[order]
        first = np.flatnonzero(np.append(True, np.diff(post) > 0))
        for a0, b0 in zip(first, np.append(first[1:], len(post))):  # one post's edges at a time
            rows = source[a0:b0]
            w[post[a0] - i * units] = weight[a0:b0] @ times_on[rows]
            hit[post[a0] - i * units] = on[rows].any(0)
        p, q = np.nonzero(hit)
        return pd.DataFrame({"post": p + i * units, "t": q + k * times, "h": w[p, q]})

    parts = sent.groupBy("bi", "bj", "bk").cogroup(lit.groupBy("ai", "aj", "ak")).applyInPandas(add, "post long, t long, h double")
    kind = active.schema["t"].dataType
    return parts.groupBy("t", "post").agg(F.sum("h").alias("h")).select(F.col("t").cast(kind).alias("t"), "post", "h")


def compressed(values: DataFrame, value: str) -> DataFrame:
    return values.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def fingerprint(edges: DataFrame, by: str) -> DataFrame:
    """An order-free digest of each group's edges: sums of two parts of each row's hash, so no
    group is collected."""
    h = F.sha2(F.concat_ws("|", "post", "pre", F.format_number("w", 6)), 256)
    part = lambda a: F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(20,0)")
    return edges.groupBy(by).agg(F.sum(part(1)).alias("s1"), F.sum(part(13)).alias("s2"), F.count(F.lit(1)).alias("n")).select(by, "n", F.sha2(F.concat_ws("|", "s1", "s2", "n"), 256).alias("digest"))


def bernoulli_edges(spark, n_post: int, n_pre: int, p: float, w: float, seed: int) -> DataFrame:
    """Independent edges of chance p: for each post the gaps between its pres are drawn
    (geometric), so no pairs but the edges are made. There are more gaps than are needed, but for
    a chance below 1e-30."""
    most = math.ceil(n_pre * p + 12 * math.sqrt(n_pre * p) + 20)
    gap = F.floor(F.log(1 - drawn(F.lit(seed), F.col("post"), F.col("d"))) / math.log(1 - p)) + 1
    draws = spark.range(n_post).select(F.col("id").alias("post"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("d"))
    at = F.sum(gap).over(Window.partitionBy("post").orderBy("d")) - 1
    return draws.withColumn("pre", at.cast("long")).where(F.col("pre") < n_pre).select("post", "pre", F.lit(w).alias("w"))


def fixed_indegree_edges(spark, n_post: int, n_pre: int, k: int, w: float, seed: int) -> DataFrame:
    """k draws with replacement for each post."""
    draws = spark.range(n_post).select(F.col("id").alias("post"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("d"))
    return draws.select("post", F.floor(drawn(F.lit(seed), F.col("post"), F.col("d")) * n_pre).cast("long").alias("pre"), F.lit(w).alias("w"))


def hardware_weights(edges: DataFrame, most: int = 63) -> DataFrame:
    """Weights scaled to +-most and rounded half to even."""
    top = edges.agg(F.max(F.abs("w")).alias("top"))
    return edges.join(F.broadcast(top)).select("post", "pre", F.bround(F.coalesce(div(F.col("w") * most, F.col("top")), F.lit(0.0))).cast("int").alias("w"))

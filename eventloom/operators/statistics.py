"""Correlations, variance decomposition, nested summaries, bootstrap, ranking and filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.numeric import corr_pop, div, fisher_z
from eventloom.functions.quantiles import quantiles
from eventloom.operators import sequence


def pair_correlations(x: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pearson r and covariance over time of pairs(scope, a, b) of x(run_id, t, unit, value);
    r is NULL where a side is constant. Only rows of paired units are shuffled."""
    a = x.select("run_id", "t", F.col("unit").alias("a"), F.col("value").alias("va"))
    b = x.select("run_id", "t", F.col("unit").alias("b"), F.col("value").alias("vb"))
    return pairs.join(a, "a").join(b, ["run_id", "t", "b"]).groupBy("run_id", "scope", "a", "b").agg(corr_pop("va", "vb").alias("r"), F.covar_pop("va", "vb").alias("cov"))


def all_pair_correlations(x: DataFrame, units: int = 256, times: int = 4096) -> DataFrame:
    """Pearson r and covariance over time of every pair a < b of units of x(run_id, t, unit,
    value), over the times that both have. Units and times are cut into blocks; a pair of unit
    blocks meets once per time block, as arrays, and its products are added up per task, so a
    value is sent once per unit block and not once per unit. r is NULL where a side is constant."""
    low = x.groupBy("run_id", "unit").agg(F.min("value").alias("_low"))  # a constant unit is exactly zero then
    rows = x.join(low, ["run_id", "unit"]).select("run_id", F.expr(f"unit div {units}").alias("ub"), F.expr(f"t div {times}").alias("tb"), "unit", "t", (F.col("value") - F.col("_low")).cast("double").alias("v"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=["v"])
        dense = np.full((units, times), np.nan)
        dense[frame["unit"].to_numpy() % units, frame["t"].to_numpy() % times] = frame["v"]
        return pd.DataFrame({"run_id": [frame["run_id"].iloc[0]], "ub": [frame["ub"].iloc[0]], "tb": [frame["tb"].iloc[0]], "block": [dense.tobytes()]}) if len(frame) else pd.DataFrame(columns=["run_id", "ub", "tb", "block"])

    packed = rows.where("v is not null").groupBy("run_id", "ub", "tb").applyInPandas(pack, "run_id string, ub long, tb long, block binary")
    sides = packed.select("run_id", "tb", F.col("ub").alias("i"), F.col("block").alias("x")).join(packed.select("run_id", "tb", F.col("ub").alias("j"), F.col("block").alias("y")), ["run_id", "tb"]).where("i <= j")

    def multiply(frames):
        total: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for run, i, j, x, y in zip(frame["run_id"], frame["i"], frame["j"], frame["x"], frame["y"]):
                p, q = np.frombuffer(x).reshape(units, times), np.frombuffer(y).reshape(units, times)
                m, n = ~np.isnan(p), ~np.isnan(q)
                p, q = np.where(m, p, 0.0), np.where(n, q, 0.0)
                m, n = m.astype(float), n.astype(float)
                own = np.stack([m @ n.T, p @ n.T, m @ q.T, p @ q.T, (p * p) @ n.T, m @ (q * q).T])
                total[run, i, j] = total[run, i, j] + own if (run, i, j) in total else own
            if len(total) >= 16:
                yield pd.DataFrame([(*k, v.tobytes()) for k, v in total.items()], columns=["run_id", "i", "j", "sums"])
                total = {}
        yield pd.DataFrame([(*k, v.tobytes()) for k, v in total.items()], columns=["run_id", "i", "j", "sums"])

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        n, a, b, ab, aa, bb = sum(np.frombuffer(s).reshape(6, units, units) for s in frame["sums"])
        with np.errstate(divide="ignore", invalid="ignore"):
            cov, va, vb = ab / n - a * b / n**2, aa / n - (a / n) ** 2, bb / n - (b / n) ** 2
            r = np.where((va > 1e-14 * aa / n) & (vb > 1e-14 * bb / n), cov / np.sqrt(va * vb), np.nan)
        first, second = frame["i"].iloc[0] * units + np.arange(units), frame["j"].iloc[0] * units + np.arange(units)
        k, l = np.nonzero((n > 0) & (first[:, None] < second))
        return pd.DataFrame({"run_id": frame["run_id"].iloc[0], "a": first[k], "b": second[l], "r": r[k, l], "cov": cov[k, l]})

    sums = sides.mapInPandas(multiply, "run_id string, i long, j long, sums binary")
    found = sums.groupBy("run_id", "i", "j").applyInPandas(finish, "run_id string, a long, b long, r double, cov double")
    return found.select("run_id", "a", "b", F.when(~F.isnan("r"), F.col("r")).alias("r"), "cov")


def sampled_pairs(units: DataFrame, most: int, chunks: int = 64) -> DataFrame:
    """Pairs a < b within and across groups(unit, group_id): all of a scope, or `most` of them
    where it has more. Units get places, group after group; a scope's pairs are numbered by
    arithmetic on group sizes, and one number is drawn by hash from each of `most` equal
    stretches of numbers, so no pairs but those drawn are made. Groups are dealt to chunks and
    large groups to salts, so nothing is sorted as a whole. A null group has one unit."""
    key = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("u"), F.col("unit").cast("string")))
    own = units.select("unit", key.alias("key"), F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(chunks)).alias("salt"))
    before = lambda by, order: Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c, by, order: F.coalesce(F.sum(c).over(before(by, order)), F.lit(0))
    cells = own.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("key").agg(F.sum("n").alias("s")).withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)))

    def numbered(groups: DataFrame, count: str, name: str):
        """groups with the running sum of `count` as `name`; its total, and where chunks begin."""
        at, starts = 0, []
        for chunk, n in groups.groupBy("chunk").agg(F.sum(count)).orderBy("chunk").collect():
            if n:
                starts.append((chunk, at))
                at += n
        base = F.lit(0).cast("long")
        for chunk, start in starts:
            base = F.when(F.col("chunk") == chunk, F.lit(start).cast("long")).otherwise(base)
        return groups.withColumn(name, base + running(count, "chunk", "key")), at, starts

    groups, total, _ = numbered(groups, "s", "o")
    later = F.lit(total) - F.col("o") - F.col("s")
    groups = groups.withColumn("within", F.expr("s * (s - 1) div 2")).withColumn("across", F.col("s") * later)
    place = F.col("o") + F.col("first") + F.row_number().over(Window.partitionBy("key", "salt").orderBy(F.xxhash64("unit"), "unit")) - 1
    cells = cells.select("key", "salt", running("n", "key", "salt").alias("first"))
    placed = own.join(cells, ["key", "salt"]).join(groups.select("key", "o"), "key").select("unit", place.alias("place"))

    def drawn(scope: str) -> DataFrame:
        own, pairs, starts = numbered(groups, scope, "start")
        k, n = F.col("id"), min(most, pairs)
        if not n:
            return units.sparkSession.createDataFrame([], "scope string, i long, j long")
        low = lambda k: k * (pairs // n) + F.least(k, F.lit(pairs % n))
        number = low(k) + F.pmod(F.xxhash64(k), low(k + 1) - low(k))
        nth = F.size(F.filter(F.array(*(F.lit(x).cast("long") for _, x in starts)), lambda x: x <= F.col("start")))
        picks = units.sparkSession.range(n).select(number.alias("start")).withColumn("chunk", F.element_at(F.array(*(F.lit(c).cast("long") for c, _ in starts)), nth))
        held = own.where(F.col(scope) > 0).select("start", "chunk", F.struct("s", "o", "start").alias("g"), F.lit(0).alias("pick"))
        both = held.unionByName(picks.withColumn("pick", F.lit(1)), allowMissingColumns=True)
        found = both.withColumn("g", F.last("g", True).over(Window.partitionBy("chunk").orderBy("start", "pick"))).where("pick = 1")
        found = found.select("g.s", "g.o", (F.col("start") - F.col("g.start")).alias("q"))
        if scope == "within":  # the unit d places further in the ring of its group
            i, j = F.expr("o + q % s"), F.expr("o + (q % s + q div s + 1) % s")
        else:
            i, j = F.expr(f"o + q div ({total} - o - s)"), F.expr(f"o + s + q % ({total} - o - s)")
        return found.select(F.lit(scope).alias("scope"), i.alias("i"), j.alias("j"))

    side = lambda c: placed.select(F.col("place").alias(c), F.col("unit").alias(f"u{c}"))
    out = drawn("within").unionByName(drawn("across")).join(side("i"), "i").join(side("j"), "j")
    return out.select("scope", F.least("ui", "uj").alias("a"), F.greatest("ui", "uj").alias("b"))


def cluster_pair_stats(r: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean and median r of each pair of groups, both ways round."""
    g = groups
    ga, gb = g.select(F.col("unit").alias("a"), F.col("group_id").alias("ga")), g.select(F.col("unit").alias("b"), F.col("group_id").alias("gb"))
    own = r.where("r is not null").join(ga, "a").join(gb, "b").select("r", F.least("ga", "gb").alias("g1"), F.greatest("ga", "gb").alias("g2"))
    s = own.groupBy("g1", "g2").agg(F.avg("r").alias("mean"), F.percentile("r", F.lit(0.5)).alias("median"))
    return s.unionByName(s.where("g1 <> g2").select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), "mean", "median"))


def fisher_summary(r: DataFrame, by: list[str], value: str = "r") -> DataFrame:
    z = F.avg(fisher_z(value))
    return r.groupBy(*by).agg(z.alias("z"), F.tanh(z).alias("mean_r"), F.count(value).alias("n"))


def variance_parts(x: DataFrame, by: list[str]) -> DataFrame:
    """Mean, temporal (mean over units of variances in time), quenched (variance of units'
    means) and total of x(by..., unit, t, value)."""
    unit = x.groupBy(*by, "unit").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    out = unit.groupBy(*by).agg(F.avg("m").alias("mean"), F.avg("v").alias("temporal"), F.var_pop("m").alias("quenched"))
    return out.withColumn("total", F.col("temporal") + F.col("quenched"))


def nested_means(rows: DataFrame, levels: list[list[str]], values: list[str]) -> DataFrame:
    """Means of means: each level's keys average the rows of the level before."""
    for keys in levels:
        rows = rows.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))
    return rows


def complete(rows: DataFrame, by: list[str], expected: int) -> DataFrame:
    """Conditions whose number of rows isn't the expected one."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)


def common_divisor(a: Column, b: Column) -> Column:
    """Greatest common divisor of a, under 2**31, and b: 48 of Euclid's steps, more than such an a needs."""
    step = lambda p, _: F.struct(F.when(p["b"] == 0, p["a"]).otherwise(p["b"]).alias("a"), F.when(p["b"] == 0, p["b"]).otherwise(p["a"] % p["b"]).alias("b"))
    start = F.struct(b.cast("long").alias("a"), a.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step, lambda p: p["a"])


def bootstrap(rows: DataFrame, by: list[str], value: str, samples: int) -> DataFrame:
    """Mean and 95 % percentile interval. Draw j of sample s is the row of rank
    (s * 7919 + j * 104729 + s * j) mod n in order of value (unknown ones last), so that every
    engine draws the same. With g the common divisor of n and 104729 + s, these n draws are the
    ranks that leave s * 7919 modulo g, g times each; so a sample's mean is that of a residue class, no
    draw is made, and tasks add up their own rows of each class."""
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    ranked = sequence.numbered(known, ["v"], by).select(*by, "v", "i")
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    drawn = n.select(*by, "n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(samples).cast("long"))).alias("s"))
    drawn = drawn.withColumn("g", common_divisor(F.col("s") + 104729, F.col("n"))).select(*by, "s", "g", (F.col("s") * 7919 % F.col("g")).alias("c"))
    classes = drawn.groupBy(*by).agg(F.collect_set(F.struct("g", "c")).alias("classes"))
    each = ranked.join(classes, by).select(*by, "v", "i", F.explode("classes").alias("_class")).where("i % _class.g = _class.c")
    means = each.groupBy(*by, F.col("_class.g").alias("g"), F.col("_class.c").alias("c")).agg(F.avg("v").alias("m")).join(drawn, [*by, "g", "c"])
    q = means.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return n.join(q, by, "left").select(*by, "mean", "low", "high", "n")


#: The distribution function of Poisson's law of mean 1 at 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402, 1.0)


def hashed_bootstrap(rows: DataFrame, by: list[str], value: str, row_id: str, samples: int) -> DataFrame:
    """Mean and 95 % percentile interval of Poisson bootstrap means. A row's weight in a sample
    is drawn by a hash of its number and the sample's, so no draw is joined: each task adds up
    weights and weighted values per group and sample, and samples x groups rows are shuffled."""
    s, i = F.col("s"), F.col(row_id) % 1000003
    chance = (i * (s * 7919 + 104729) + s * s) % 1000003 / F.lit(1000003.0)
    weight = F.lit(len(POISSON) - 1)
    for k in range(len(POISSON) - 2, -1, -1):
        weight = F.when(F.col("u") < POISSON[k], k).otherwise(weight)
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), row_id)
    drawn = own.withColumn("s", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(samples).cast("long")))).withColumn("u", chance).withColumn("w", weight)
    means = drawn.groupBy(*by, "s").agg(div(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("m"))
    q = means.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return own.groupBy(*by).agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")).join(q, by).select(*by, "mean", "low", "high", "n")


def network_mask(signal: DataFrame, level: float = 0.5, value: str = "x", most: int | None = None) -> DataFrame:
    """run_id, bin, net (mean over clusters) and whether it is at or over the run's percentile."""
    net = signal.groupBy("run_id", "bin").agg(F.avg(value).alias("net"))
    q = quantiles(net, ["run_id"], "net", {"q": level}, most)
    return net.join(q, "run_id").select("run_id", "bin", "net", (F.col("net") >= F.col("q")).cast("int").alias("high"))


def two_means(net: DataFrame, value: str = "net") -> DataFrame:
    """The exact split of values into two groups of least squared error, by prefix sums over
    the distinct values of a run; threshold: least value of the upper group."""
    kinds = net.groupBy("run_id", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    parts = kinds.select("run_id", "v", "k", (F.col("v") * F.col("k")).alias("s1"), (F.col("v") * F.col("v") * F.col("k")).alias("q1"))
    whole = parts.groupBy("run_id").agg(F.sum("k").alias("n"), F.sum("s1").alias("s"), F.sum("q1").alias("q"))
    x = parts
    for own, name in (("k", "n0"), ("s1", "s0"), ("q1", "q0")):
        x = sequence.running_sum(x, "v", own, name).withColumn(name, F.col(name) - F.col(own))
    x = x.join(whole, "run_id").where("n0 > 0")
    sse = F.col("q") - F.col("s0") ** 2 / F.col("n0") - (F.col("s") - F.col("s0")) ** 2 / (F.col("n") - F.col("n0"))
    return x.groupBy("run_id").agg(F.min_by("v", F.struct(F.round(sse, 9), "v")).alias("threshold"), F.min(sse).alias("sse"))


def switching(signal: DataFrame, mask: DataFrame, value: str = "x") -> DataFrame:
    """Per cluster: means in low and high network states, their difference, effect size
    (infinite for a difference without spread), and correlation with the network."""
    x = signal.join(mask, ["run_id", "bin"])
    on, off = F.col("high") == 1, F.col("high") == 0
    v = F.col(value)
    out = x.groupBy("run_id", "cluster").agg(
        F.avg(F.when(off, v)).alias("low"), F.avg(F.when(on, v)).alias("high"),
        F.var_pop(F.when(off, v)).alias("v0"), F.var_pop(F.when(on, v)).alias("v1"), corr_pop(value, "net").alias("r"),
    )
    delta, sd = F.col("high") - F.col("low"), F.sqrt((F.col("v0") + F.col("v1")) / 2)
    effect = F.when(sd > 0, div(delta, sd)).when(delta > 0, F.lit(float("inf"))).when(delta < 0, F.lit(float("-inf"))).otherwise(0.0)
    return out.select("run_id", "cluster", "low", "high", delta.alias("delta"), effect.alias("effect"), "r", div(delta, F.abs(F.col("high")) + F.abs(F.col("low"))).alias("modulation"))


def top_clusters(stats: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy(F.desc(F.col("delta") > 0), F.desc("effect"), F.desc("delta"), F.desc("r"), "cluster")
    return stats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def robust_baseline(signal: DataFrame, floor: float, value: str = "x", most: int | None = None) -> DataFrame:
    """Median and 1.4826 * MAD (at least floor) of each cluster."""
    mid = quantiles(signal, ["run_id", "cluster"], value, {"median": 0.5}, most)
    off = quantiles(signal.join(mid, ["run_id", "cluster"]), ["run_id", "cluster"], F.abs(F.col(value) - F.col("median")), {"mad": 0.5}, most)
    return mid.join(off, ["run_id", "cluster"]).select("run_id", "cluster", "median", F.greatest(F.lit(floor), 1.4826 * F.col("mad")).alias("noise"))


def state_keys(rates: DataFrame, most: int) -> DataFrame:
    """'LOW' or the sorted names of the up to `most` strongest active clusters, joined by '+';
    rates(run_id, state, name, rate, active)."""
    w = Window.partitionBy("run_id", "state").orderBy(F.desc("active"), F.desc("rate"), "name")
    kept = F.when((F.col("active") == 1) & (F.col("k") <= most), F.col("name"))
    own = rates.withColumn("k", F.row_number().over(w)).groupBy("run_id", "state").agg(F.array_sort(F.collect_list(kept)).alias("names"))
    return own.select("run_id", "state", F.size("names").alias("members"), F.when(F.size("names") == 0, "LOW").otherwise(F.array_join("names", "+")).alias("state_key"))


def chained(values: DataFrame, gap: float) -> DataFrame:
    """Groups of sorted values whose neighbours are within gap; the best of each by residual,
    then nearness to zero."""
    told = sequence.lagged(values, "value", "before")
    g = sequence.running_sum(told.withColumn("new", F.coalesce((F.col("value") - F.col("before") > gap).cast("int"), F.lit(1))), "value", "new", "chain")
    return g.groupBy("run_id", "chain").agg(F.min_by("value", F.struct("residual", F.abs("value"), "value")).alias("best"), F.count(F.lit(1)).alias("n"))


def knee(curve: DataFrame) -> DataFrame:
    """x of the greatest distance from the chord between a curve's ends, both axes scaled."""
    s = curve.groupBy("run_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min_by("y", "x").alias("a"), F.max_by("y", "x").alias("b"))
    sx, sy = div(F.col("x") - F.col("x0"), F.col("x1") - F.col("x0")), div(F.col("y") - F.col("y0"), F.col("y1") - F.col("y0"))
    a, b = div(F.col("a") - F.col("y0"), F.col("y1") - F.col("y0")), div(F.col("b") - F.col("y0"), F.col("y1") - F.col("y0"))
    d = F.abs(sy - (a + (b - a) * sx))
    return curve.join(s, "run_id").groupBy("run_id").agg(F.max_by("x", F.struct(F.round(d, 9), -F.col("x"))).alias("knee"))


def best_candidates(rows: DataFrame, focus: str, rate: str, order: str) -> DataFrame:
    """Of each focus the row of the highest rate, the first on ties, NaN left out."""
    return rows.where(~F.isnan(rate) & F.col(rate).isNotNull()).groupBy(focus).agg(F.max_by(F.struct(order, rate), F.struct(F.col(rate), -F.col(order))).alias("r")).select(focus, "r.*")


def nearest(points: DataFrame, stored: DataFrame) -> DataFrame:
    """Of stored(y, idx) the idx nearest to each x, the lower y on ties and the least idx of equal
    y: the neighbours below and above are running values of one sort."""
    stored = stored.groupBy("run_id", "y").agg(F.min("idx").alias("idx"))
    none = F.lit(None).cast("struct<y:double,idx:bigint>")
    own = stored.select("run_id", F.col("y").alias("v"), F.struct(F.col("y").cast("double").alias("y"), F.col("idx").cast("bigint").alias("idx")).alias("s"), F.lit(False).alias("asked"))
    both = points.select("run_id", F.col("x").alias("v"), none.alias("s"), F.lit(True).alias("asked")).unionByName(own)
    x = sequence.around(both, "v", "s").where("asked").withColumnsRenamed({"p": "a", "q": "b"})
    pick = F.when(F.col("b").isNull() | (F.col("a").isNotNull() & (F.col("v") - F.col("a.y") <= F.col("b.y") - F.col("v"))), F.col("a.idx")).otherwise(F.col("b.idx"))
    return x.select("run_id", F.col("v").alias("x"), pick.alias("idx"))


def weighted(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean and variance, 0 without weight."""
    w, x = F.col(weight), F.col(value)
    out = rows.groupBy(*by).agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sq"))
    m = F.coalesce(div(F.col("sx"), F.col("sw")), F.lit(0.0))
    return out.select(*by, m.alias("mean"), F.coalesce(F.greatest(div(F.col("sq"), F.col("sw")) - m * m, F.lit(0.0)), F.lit(0.0)).alias("var"))

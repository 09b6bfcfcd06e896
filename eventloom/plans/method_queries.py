"""Registered queries of whole methods, warped windows, importers and generated edges, with SQL
where SQL can express them; the others are held against plain loops in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import edges, evaluation, intervals, kernels, meanfield, methods, simulation
from eventloom.plans import config
from eventloom.plans.queries import COUNTS, DAY, EDGES, END, ORACLES, PATTERN, SIGNAL, SPIKES, WINDOWS, part_units, patterns, query, rounded, signal, supplier_units, units
from eventloom.plans.result_queries import DRAW
from eventloom.sources import importers
from eventloom.sources import tables as T

# ------------------------------------------------------------------- methods


def truth(spark, d):
    return patterns(spark, d).select("run_id", "bin", F.col("label").cast("long").alias("label"))


@query("threshold_states", f"WITH {PATTERN} SELECT run_id, bin, label::BIGINT AS label FROM pl")
def threshold_states(spark, d):
    return methods.threshold_states(signal(spark, d), 0.5, 0, 1, 1)


@query("method_states")
def method_states(spark, d):
    wanted = {"kmeans": {"k": 3}, "changepoint": {"penalty": 0.5, "radius": 2}, "hmm": {"k": 3}, "active_set": {"width": 4, "k_max": 3}, "window": {"method": "changepoint", "search": "window", "penalty": 0.5}}
    return methods.analyzed(signal(spark, d), wanted)


@query("method_scores")
def method_scores(spark, d):
    x = signal(spark, d)
    found = methods.analyzed(x, {"threshold": {}, "poisson": {"method": "hmm", "k": 3, "emission": "poisson"}, "bernoulli": {"method": "hmm", "k": 3, "emission": "bernoulli"}})
    return rounded(methods.evaluated(found, truth(spark, d)))


@query("state_count_sweep")
def state_count_sweep(spark, d):
    return rounded(methods.state_count_sweep(signal(spark, d), [2, 3, 4], [0.0, 1.0]))


@query("merged_changepoints")
def merged_changepoints(spark, d):
    return methods.changepoint_states(signal(spark, d), 0.3, distance=0.2, merge=False, k=3)


MATCHED = """
WITH x AS (SELECT doc_id%2 AS run_id, (quality+toxic*(1-quality)*2)%3 AS t, (quality*2+toxic+doc_id%3)%3 AS p FROM labels),
c AS (SELECT run_id, t, p, count(*) AS n FROM x GROUP BY ALL),
a AS (SELECT unnest([[0,1,2],[0,2,1],[1,0,2],[1,2,0],[2,0,1],[2,1,0]]) AS m),
s AS (SELECT run_id, m, sum(n) AS hit FROM c, a WHERE m[t+1]=p GROUP BY ALL)
SELECT run_id, round(max(hit)/(SELECT sum(n) FROM c WHERE c.run_id=s.run_id),6) AS accuracy FROM s GROUP BY run_id
"""


@query("matched_accuracy", MATCHED)
def matched_accuracy(spark, d):
    q, t, k = F.col("quality"), F.col("toxic"), F.col("doc_id")
    x = T.table(spark, d, "labels").select((k % 2).alias("run_id"), ((q + t * (1 - q) * 2) % 3).alias("t"), ((q * 2 + t + k % 3) % 3).alias("p"))
    return rounded(evaluation.matched_accuracy(evaluation.contingency(x, "t", "p")))


DWELLS = """
WITH s AS (SELECT s_suppkey%3 AS run_id, s_nationkey%4 AS state, (s_suppkey%7+1)::DOUBLE AS d, s_acctbal>5000 AS tr FROM supplier),
m AS (SELECT run_id, state, avg(d) FILTER (tr) AS t, avg(d) FILTER (NOT tr) AS p FROM s GROUP BY ALL)
SELECT run_id, state, round(t,6) AS "true", round(p,6) AS pred, round(abs(t-p),6) AS error FROM m
"""


@query("dwell_errors", DWELLS)
def dwell_errors(spark, d):
    s = T.table(spark, d, "supplier").select((F.col("s_suppkey") % 3).alias("run_id"), (F.col("s_nationkey") % 4).alias("state"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("duration_time"), (F.col("s_acctbal") > 5000).alias("tr"))
    return rounded(evaluation.dwell_errors(s.where("tr"), s.where("not tr")))


@query("transition_errors", "WITH m AS (SELECT p_size%2 AS run_id, p_size AS src, p_partkey%5 AS dst, avg(CASE WHEN p_partkey%2=0 THEN p_retailprice/2000 END) AS p, avg(CASE WHEN p_partkey%3=0 THEN p_retailprice/2100 END) AS q FROM part GROUP BY ALL), x AS (SELECT run_id, coalesce(p,0)-coalesce(q,0) AS d FROM m WHERE p IS NOT NULL OR q IS NOT NULL) SELECT run_id, round(sqrt(sum(d*d)),6) AS frobenius, round(avg(abs(d)),6) AS mean_error FROM x GROUP BY ALL")
def transition_errors(spark, d):
    x = T.table(spark, d, "part").select((F.col("p_size") % 2).alias("run_id"), F.col("p_size").alias("src"), (F.col("p_partkey") % 5).alias("dst"), "p_partkey", "p_retailprice")
    mean = lambda k, c: x.where(F.col("p_partkey") % k == 0).groupBy("run_id", "src", "dst").agg(F.avg(F.col("p_retailprice") / c).alias("p"))
    return rounded(evaluation.transition_errors(mean(2, 2000), mean(3, 2100)))


CROPS = """
WITH c AS (SELECT o_custkey%20 AS run_id, (o_orderkey%50)/10.0 AS penalty, 1+o_orderkey%12 AS segments, round(o_totalprice/(1+o_orderkey%12),2) AS cost, (o_orderkey%9)/10.0 AS distance, o_orderkey FROM orders),
c1 AS (SELECT * EXCLUDE(rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, penalty, segments ORDER BY cost, o_orderkey) AS rn FROM c) WHERE rn=1),
f1 AS (SELECT *, 1-cost/max(cost) OVER (PARTITION BY run_id)>=0.5 AS ok FROM c1), g1 AS (SELECT * EXCLUDE(ok) FROM (SELECT *, max(ok) OVER (PARTITION BY run_id) AS s FROM f1) WHERE ok OR NOT s),
f2 AS (SELECT * EXCLUDE(s), penalty>=1.0 AS ok FROM g1), g2 AS (SELECT * EXCLUDE(ok) FROM (SELECT *, max(ok) OVER (PARTITION BY run_id) AS s FROM f2) WHERE ok OR NOT s),
f3 AS (SELECT * EXCLUDE(s), distance>=0.7 AS ok FROM g2), g3 AS (SELECT * EXCLUDE(ok) FROM (SELECT *, max(ok) OVER (PARTITION BY run_id) AS s FROM f3) WHERE ok OR NOT s)
SELECT run_id, arg_min(penalty, abs(segments-5)*1e6+segments*1e3+penalty)::DOUBLE AS penalty, arg_min(segments, abs(segments-5)*1e6+segments*1e3+penalty) AS segments FROM g3 GROUP BY run_id
"""


@query("crops_choice", CROPS)
def crops_choice(spark, d):
    k = F.col("o_orderkey")
    c = T.table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("run_id"), (k % 50 / 10.0).alias("penalty"), (k % 12 + 1).alias("segments"), F.round(F.col("o_totalprice") / (k % 12 + 1), 2).alias("cost"), (k % 9 / 10.0).alias("distance"), k)
    c = c.groupBy("run_id", "penalty", "segments").agg(F.min(F.struct("cost", "o_orderkey", "distance")).alias("r")).select("run_id", "penalty", "segments", "r.cost", "r.distance")
    return methods.crops_choice(c, "target", 5, 0.5, 1.0, 0.7)


@query("segment_costs", f"WITH {SIGNAL}, g AS (SELECT bin//10 AS k, cluster, count(*)*var_pop(x) AS sse FROM sig GROUP BY ALL) SELECT 'events' AS run_id, round(sum(sse),4) AS cost, count(DISTINCT k) AS segments FROM g")
def segment_costs(spark, d):
    x = signal(spark, d)
    labels = x.select("run_id", "bin").distinct().withColumn("label", F.floor(F.col("bin") / 10))
    return methods.segment_costs(x, labels).withColumn("cost", F.round("cost", 4))


@query("task_results", "SELECT s_suppkey AS task, CASE WHEN s_suppkey%3<>1 THEN s_suppkey*2.5 END::DOUBLE AS value, CASE WHEN s_suppkey%3=1 THEN 'ValueError: task '||s_suppkey END AS error, ['low','high'][1+s_suppkey%2] AS condition FROM supplier")
def task_results(spark, d):
    def work(row):
        if row["task"] % 3 == 1:
            raise ValueError(f"task {row['task']}")
        return {"value": row["task"] * 2.5}

    tasks = methods.dealt(T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("task")), ["low", "high"], "task")
    return methods.fanned_out(tasks, ["task", "condition"], work, "value double")


# ------------------------------------------------------------------- windows

ORACLES["time_resolved_callable"] = f"WITH {SPIKES}, w AS ({WINDOWS.format(n=6, lo='>=', hi='<', step='432000000.0', width='432000000.0')}), x AS (SELECT k, abs(t-lag(t) OVER (PARTITION BY k ORDER BY t, unit)) AS a FROM w) SELECT 'events' AS run_id, k, round(avg(a),6) AS value FROM x GROUP BY k"


@query("time_resolved_grid", f"WITH {SPIKES}, w AS ({WINDOWS.format(n=26, lo='>=', hi='<', step='86400000.0', width='432000000.0')}) SELECT run_id, k, count(*) AS n, (k*86400000.0+216000000.0)::DOUBLE AS time FROM (SELECT run_id, k FROM (SELECT run_id, floor(t) AS t FROM s) s2 JOIN (SELECT range AS k FROM range(26)) k ON s2.t>=k*86400000.0 AND s2.t<k*86400000.0+432000000.0) GROUP BY ALL")
def time_resolved_grid(spark, d):
    return intervals.time_resolved_grid(T.spikes(spark, d), 0.4, END, 5 * DAY, DAY, [F.count(F.lit(1)).alias("n")])


@query("auto_window", f"WITH {SPIKES}, i AS (SELECT unit, t-lag(t) OVER (PARTITION BY unit ORDER BY t) AS a FROM s) SELECT 'events' AS run_id, round(avg(m)*5.0,3) AS width FROM (SELECT unit, avg(a) AS m FROM i GROUP BY unit)")
def auto_window(spark, d):
    return intervals.auto_window(T.spikes(spark, d)).withColumn("width", F.round("width", 3))


WARPED = f"""
WITH {COUNTS}, m AS (SELECT bin, avg(n) AS m FROM b GROUP BY bin), c AS (SELECT bin, m, sum(m) OVER (ORDER BY bin) AS y1 FROM m), e AS (SELECT max(y1) AS e FROM c),
y AS (SELECT s.unit, y1-m+(t-bin*86400000.0)/86400000.0*m AS y FROM s JOIN c ON floor(s.t/86400000.0)=c.bin),
w AS (SELECT unit, y, k FROM y, (SELECT range AS k FROM range(2000)), e WHERE k*0.5+1.0<e AND y>k*0.5 AND y<=k*0.5+1.0),
i AS (SELECT k, y-lag(y) OVER (PARTITION BY k, unit ORDER BY y) AS a FROM w),
r AS (SELECT k, CASE WHEN count(a)>=2 THEN var_pop(a)/(avg(a)*avg(a)) END AS cv2, k*0.5+0.5 AS mid FROM i GROUP BY k)
SELECT 'events' AS run_id, k, round(cv2,5) AS cv2, round(86400000.0*(bin+(mid-(y1-m))/m),0) AS real_time FROM r JOIN c ON mid>y1-m AND mid<=y1
"""


@query("time_warped_cv2", WARPED)
def time_warped_cv2(spark, d):
    out = intervals.time_warped_cv2(T.spikes(spark, d), units(spark, d), 0.0, END, DAY, 1.0, 0.5)
    return out.select("run_id", "k", F.round("cv2", 5).alias("cv2"), F.round("real_time", 0).alias("real_time"))


@query("cutoff_frequencies", "SELECT p_partkey AS k, CASE WHEN p_size%7=0 THEN 'inf'::DOUBLE ELSE round(sqrt(ln(2))/(2*pi()*(p_size%7)*0.01),6) END AS hz FROM part")
def cutoff_frequencies(spark, d):
    """Widths from the sizes of parts, in hundredths of a second."""
    return rounded(T.table(spark, d, "part").select(F.col("p_partkey").alias("k"), kernels.cutoff_hz(F.col("p_size") % 7 * 0.01).alias("hz")))


# ------------------------------------------------------------------- importers

SHARDS = "SELECT s_nationkey AS seed, coalesce(CASE WHEN s_suppkey%4=0 THEN NULL ELSE s_suppkey/10.0 END, s_nationkey/10.0)::DOUBLE AS kappa, s_suppkey AS episode, round(s_acctbal,2)::DOUBLE AS dwell FROM supplier"


@query("shard_episodes", SHARDS)
def shard_episodes(spark, d):
    episode = F.struct(F.col("s_suppkey").alias("episode"), F.round("s_acctbal", 2).alias("dwell"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") / 10.0).alias("kappa"))
    meta = F.struct(F.col("s_nationkey").alias("seed"), (F.col("s_nationkey") / 10.0).alias("kappa"))
    texts = T.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(episode).alias("episodes"))
    texts = texts.select(F.to_json(F.struct(meta.alias("meta"), "episodes")).alias("value")).unionByName(spark.createDataFrame([("{broken",)], "value string"))
    return importers.shards(texts, "seed: int, kappa: double", "episode: bigint, dwell: double, kappa: double")


@query("parent_indices", "SELECT c_nationkey AS parent, c_custkey AS source, CASE WHEN c_nationkey%3=0 THEN c_custkey%40 ELSE c_custkey%40 END::BIGINT AS idx, CASE c_nationkey%4 WHEN 0 THEN 'local from one' WHEN 1 THEN 'global from one' WHEN 2 THEN 'global from zero' ELSE 'local from zero' END AS convention FROM customer")
def parent_indices(spark, d):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    offset = F.when((n % 4 == 1) | (n % 4 == 2), n * 1000 + 5000).otherwise(0)
    told = F.when(n % 4 == 0, 1).when(n % 4 == 1, offset + 1).when(n % 4 == 2, offset).otherwise(0)
    c = T.table(spark, d, "customer")
    events = c.select(n.alias("parent"), (k % 40 + told).alias("source"), k.alias("custkey"))
    # every parent's ids span its whole range, so that one convention fits
    ends = c.select(n.alias("parent")).distinct().withColumn("n", F.col("parent"))
    told_n = F.when(F.col("n") % 4 == 0, 1).when(F.col("n") % 4 == 1, F.col("n") * 1000 + 5001).when(F.col("n") % 4 == 2, F.col("n") * 1000 + 5000).otherwise(0)
    ends = ends.select("parent", F.explode(F.array(told_n, told_n + 39)).alias("source"), F.lit(-1).alias("custkey"))
    parents = c.select(n.alias("parent"), offset.cast("long").alias("offset"), F.lit(40).alias("size")).distinct()
    out = importers.parent_indices(events.unionByName(ends), parents).where("custkey >= 0")
    return out.select("parent", F.col("custkey").alias("source"), "idx", "convention")


@query("recorded_units", "SELECT c_nationkey*1000+o_orderkey%50 AS unit, (o_orderdate::DATE - DATE '1996-01-01')::DOUBLE AS t FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_orderdate::DATE >= DATE '1996-01-01'")
def recorded_units(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    o = T.table(spark, d, "orders").join(T.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    events = o.select(F.col("c_nationkey").alias("pop"), (F.col("o_orderkey") % 50).alias("local"), day.alias("t"))
    return importers.by_offset(events, events.select("pop", (F.col("pop") * 1000).alias("offset")).distinct(), 1461.0)


@query("relabelled_units", f"WITH {SPIKES} SELECT (s.unit%10)*1000+s.unit//10 AS unit, t-86400000.0 AS t FROM s WHERE t>=86400000.0 AND unit%7<>0")
def relabelled_units(spark, d):
    s = T.spikes(spark, d).select(F.col("unit").alias("source"), "t")
    id_map = s.select("source").distinct().where("source % 7 <> 0").withColumn("unit", (F.col("source") % 10) * 1000 + F.floor(F.col("source") / 10))
    return importers.relabelled(s, id_map, DAY)


@query("summary_round_trip", "SELECT n_nationkey, CASE WHEN n_nationkey%4<>0 THEN n_regionkey/3.0 END AS value FROM nation")
def summary_round_trip(spark, d):
    x = T.table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey") / 3.0).otherwise(F.lit(float("nan"))).alias("value"))
    return importers.summary_rows(importers.summary_json(x), "n_nationkey int, value double")


@query("trace_parts", "SELECT p_brand AS run_id, p_partkey AS sample_step, NULL::VARCHAR AS names, round(p_retailprice/1000,6)::DOUBLE AS rate, true AS no_fields FROM part")
def trace_parts(spark, d):
    x = T.table(spark, d, "part").select(F.col("p_brand").alias("run_id"), F.col("p_partkey").alias("sample_step"), F.array(F.col("p_retailprice") / 1000).alias("rates"))
    out = importers.trace_rows(x)
    return out.select("run_id", "sample_step", F.array_join("names", ",").alias("names"), F.round(F.col("rates")[0], 6).alias("rate"), F.col("fields").isNull().alias("no_fields"))


# ------------------------------------------------------------------- generated edges and curves

_U = DRAW.format(parts="'1:'||post||':'||d")
_V = DRAW.format(parts="'2:'||post||':'||d")
GENERATED = f"""
WITH g AS (SELECT a.range AS post, b.range+1 AS d FROM range((SELECT count(*) FROM supplier)) a, range(136) b),
b AS (SELECT post, (sum(floor(ln(1-{_U})/ln(0.8))+1) OVER (PARTITION BY post ORDER BY d)-1)::BIGINT AS pre FROM g)
SELECT 'bernoulli' AS kind, post, pre FROM b WHERE pre<200 UNION ALL SELECT 'indegree', post, floor({_V}*200)::BIGINT FROM g WHERE d<=40
"""
ORACLES["generated_edges"] = GENERATED
ORACLES["edge_fingerprints"] = """
WITH h AS (SELECT l_suppkey%10 AS pop, sha256(l_suppkey||'|'||l_partkey||'|'||printf('%.6f',l_quantity)) AS h FROM lineitem),
s AS (SELECT pop, count(*) AS n, sum(('0x'||substr(h,1,12))::BIGINT::HUGEINT) AS s1, sum(('0x'||substr(h,13,12))::BIGINT::HUGEINT) AS s2 FROM h GROUP BY pop)
SELECT pop, n, sha256(s1||'|'||s2||'|'||n) AS digest FROM s
"""


@query("csr_rows", "SELECT s_suppkey-(SELECT min(s_suppkey) FROM supplier) AS post, s_nationkey AS pre, s_acctbal::DOUBLE AS w FROM supplier")
def csr_rows(spark, d):
    """One row of a CSR matrix for each supplier, with one entry."""
    s = T.table(spark, d, "supplier")
    s = s.join(F.broadcast(s.agg(F.min("s_suppkey").alias("low"))), how="cross").withColumn("post", F.col("s_suppkey") - F.col("low"))  # one row
    return T.csr_cells(s.select("post", F.col("post").alias("a"), (F.col("post") + 1).alias("b")), s.select(F.col("post").alias("k"), F.col("s_nationkey").alias("pre"), F.col("s_acctbal").cast("double").alias("w")))


@query("fixed_point_branches")
def fixed_point_branches(spark, d):
    grid = T.table(spark, d, "nation").groupBy((F.col("n_regionkey") + 1.0).alias("kappa")).agg(F.lit(2.0).alias("j")).withColumn("param_id", F.format_string("%.1f", "kappa")).withColumn("q", F.lit(5)).withColumn("bias", F.lit(-1.0))
    points = meanfield.crossings(meanfield.response_curves(grid, 41))
    return rounded(meanfield.branches(points.select(F.lit("all").alias("param_id"), F.col("param_id").cast("double").alias("x"), "value"), 0.3))


BLOCKS = f"""
WITH {EDGES}, x AS (SELECT post_pop, pre_pop, sum(w) AS w1 FROM e JOIN po USING (post) JOIN pr USING (pre) WHERE w<>0 GROUP BY ALL),
np AS (SELECT post_pop, count(*) AS n_post FROM po GROUP BY ALL), nq AS (SELECT pre_pop, count(*) AS n_pre FROM pr GROUP BY ALL)
SELECT post_pop, pre_pop, round(w1/(n_post*n_pre),6) AS w FROM x JOIN np USING (post_pop) JOIN nq USING (pre_pop)
"""


@query("homogenized_blocks", BLOCKS)
def homogenized_blocks(spark, d):
    return rounded(edges.homogenized(T.edges(spark, d), supplier_units(spark, d), part_units(spark, d)))


def network_runs(spark, d="/root/testdata/sf0.001"):
    """A run per region, with its strength of clustering and its seed from the region's key."""
    k = F.col("r_regionkey")
    grid = T.table(spark, d, "region").select((k % 2 * 0.5).alias("kappa"), (F.floor(k / 2) * 2.5 + 1.0).alias("r_e")).withColumn("run_id", F.format_string("%.1f/%.1f", "kappa", "r_e"))
    fixed = {"q": 5.0, "n_e": 80.0, "n_i": 20.0, "v_th": 1.0, "g": 1.2, "p_ee": 0.2, "p_ie": 0.5, "p_ei": 0.5, "p_ii": 0.5, "r_j": 0.75, "m_x": 0.2, "tau_e": 10.0, "tau_i": 5.0, "start": 0.2}
    return simulation.prepared(grid.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn("seed", F.lit(7)).withColumn("steps", F.lit(4000)))


@query("clustered_network_rates")
def clustered_network_rates(spark, d):
    runs = network_runs(spark, d)
    return rounded(simulation.recorded_rates(simulation.change_log(runs), simulation.members(runs), 400, 4001))


@query("clustered_network_fields")
def clustered_network_fields(spark, d):
    runs = network_runs(spark, d)
    sampled = simulation.recorded(simulation.change_log(runs), simulation.members(runs), 1000, 4001)
    return rounded(simulation.recorded_fields(sampled, simulation.edges(runs)))


@query("distinct_solutions", "WITH c AS (SELECT s_nationkey AS run_id, [s_suppkey%4, 9] AS ends, s_suppkey/10.0 AS penalty, s_suppkey%3 AS segments, round(s_acctbal,2)::DOUBLE AS cost FROM supplier) SELECT run_id, ends[1] AS first_end, min(penalty)::DOUBLE AS penalty, arg_min(segments,penalty) AS segments, arg_min(cost,penalty) AS cost FROM c GROUP BY ALL")
def distinct_solutions(spark, d):
    k = F.col("s_suppkey")
    c = T.table(spark, d, "supplier").select(F.col("s_nationkey").alias("run_id"), F.array((k % 4).cast("long"), F.lit(9).cast("long")).alias("ends"), (k / 10.0).alias("penalty"), (k % 3).alias("segments"), F.round("s_acctbal", 2).alias("cost"))
    return methods.distinct_solutions(c).select("run_id", F.col("ends")[0].alias("first_end"), "penalty", "segments", "cost")


@query("solved_fixed_points")
def solved_fixed_points(spark, d):
    return rounded(meanfield.solved_points(network_runs(spark, d), [0.0, 0.25, 0.5, 0.75, 1.0]).drop("rates", "residual"))


@query("shard_inventory")
def shard_inventory(spark, d):
    return rounded(methods.shard(network_runs(spark, d), 100, 4001, 4, 2)["inventory"])


_MEMBER, _NOISE, _LENGTH = (DRAW.format(parts=f"'5:{kind}'||{cell}") for kind, cell in (("", "s.range||':'||c.range"), ("x:", "s.range||':'||c.range"), ("n:", "s.range")))


@query("planted_sets", f"SELECT s.range AS segment, c.range AS cluster, (floor({_LENGTH}*8)+3)::BIGINT AS length, ({_MEMBER}<0.4)::INT AS member, round(({_MEMBER}<0.4)::INT+0.3*(2*{_NOISE}-1),6) AS x FROM range((SELECT count(*) FROM supplier)) s, range(6) c")
def planted_sets(spark, d):
    """As many segments as there are suppliers."""
    return rounded(methods.planted_sets(spark, T.table(spark, d, "supplier").count(), 6, 0.3, 5))

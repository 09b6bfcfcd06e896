"""Further registered queries: choices, lookups and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.operators import binning, segmentation, selection, statistics
from eventloom.plans.queries import ACTIVE, SEQ, SPIKES, active, query, rounded, signal, user_segments
from eventloom.sources import tables as T


@query("dwell_histogram", f"WITH {SEQ}, ds AS (SELECT state, min(2.0*d)::DOUBLE AS lo, max(2.0*d)::DOUBLE AS hi, least(50,greatest(5,floor(sqrt(count(*)))))::BIGINT AS bins, avg(2.0*d) AS mean FROM seg GROUP BY state) SELECT run_id, state, least(bins-1, floor(coalesce((2.0*d-lo)*bins/nullif(hi-lo,0),0)))::BIGINT AS bucket, count(*) AS count, round(any_value(mean),6) AS mean FROM seg JOIN ds USING (state) GROUP BY ALL")
def dwell_histogram(spark, d):
    return rounded(selection.dwell_histogram(user_segments(spark, d)))


@query("sampled_states", f"WITH {ACTIVE} SELECT run_id, cluster, bin, active FROM act WHERE bin%7=0 OR bin=119")
def sampled_states(spark, d):
    return selection.every(active(spark, d), ["run_id", "cluster"], "bin", 7, True).select("run_id", "cluster", "bin", "active")


@query("tolerant_lookup", "SELECT s_suppkey, (SELECT t FROM (SELECT unnest([0.0,2500.0,2600.0,5000.0]::DOUBLE[]) AS t, unnest([0,1,2,3]) AS k) WHERE abs(s_acctbal-t)<=300 ORDER BY k LIMIT 1) AS target FROM supplier WHERE target IS NOT NULL")
def tolerant_lookup(spark, d):
    want = spark.createDataFrame([(0, 0.0), (1, 2500.0), (2, 2600.0), (3, 5000.0)], "position int, target double")
    s = T.table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return selection.tolerant_lookup(s, "s_acctbal", want, 300.0).select("s_suppkey", "target")


@query("upper_branch_onset", "WITH b AS (SELECT o_orderpriority AS param_id, o_orderstatus AS branch, max(o_totalprice) AS top, min(o_custkey)::DOUBLE AS onset FROM orders GROUP BY ALL) SELECT param_id, ascii(arg_max(branch, top)) AS branch, arg_max(onset, top) AS onset FROM b GROUP BY param_id")
def upper_branch_onset(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderpriority").alias("param_id"), F.ascii("o_orderstatus").alias("branch"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("value"))
    return selection.upper_branch_onset(o)


@query("filtered_or_all", "SELECT c_custkey, c_nationkey FROM (SELECT *, max((c_acctbal>9000)::INT) OVER (PARTITION BY c_nationkey, c_mktsegment) AS a FROM customer) WHERE a=0 OR c_acctbal>9000")
def filtered_or_all(spark, d):
    return selection.filtered_or_all(T.table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], F.col("c_acctbal") > 9000).select("c_custkey", "c_nationkey")


@query("pass_rate", "WITH x AS (SELECT l_returnflag AS flag, ((l_discount<0.08)::INT+(l_tax<0.07)::INT+(l_quantity<45)::INT+(l_extendedprice<60000)::INT)/4.0 AS s FROM lineitem) SELECT flag, round(avg(s),6) AS share, CASE WHEN avg(s)>=0.8 THEN 'good' WHEN avg(s)>=0.5 THEN 'mixed' ELSE 'poor' END AS verdict FROM x GROUP BY flag")
def pass_rate(spark, d):
    x = T.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return rounded(selection.pass_rate(x, ["flag"], [F.col("l_discount") < 0.08, F.col("l_tax") < 0.07, F.col("l_quantity") < 45, F.col("l_extendedprice") < 60000]))


@query("firing_rates", f"WITH {SPIKES} SELECT run_id, round(count(*) FILTER (unit<100)/(100*2592000.0),9) AS rate_e, round(count(*) FILTER (unit>=100)/(50*2592000.0),9) AS rate_i FROM s GROUP BY run_id")
def firing_rates(spark, d):
    r = selection.firing_rates(T.spikes(spark, d), 100, 50, 2592000.0)
    return r.select("run_id", F.round("rate_e", 9).alias("rate_e"), F.round("rate_i", 9).alias("rate_i"))


@query("mean_connectivity", "SELECT round(sum(p_size*p_partkey*(p_retailprice/2000.0))/sum(p_size*p_partkey),6) AS p FROM part")
def mean_connectivity(spark, d):
    return rounded(selection.mean_connectivity(T.table(spark, d, "part").select(F.col("p_size").alias("n_post"), F.col("p_partkey").alias("n_pre"), (F.col("p_retailprice") / 2000.0).alias("p"))))


@query("key_values", "SELECT s_suppkey, CASE WHEN s_suppkey%3=0 THEN NULL ELSE s_acctbal END AS value FROM supplier")
def key_values(spark, d):
    s = T.table(spark, d, "supplier")
    key = F.when(F.col("s_suppkey") % 3 == 0, F.lit("Rnone_focus2")).otherwise(F.concat(F.lit("R"), F.col("s_acctbal").cast("string"), F.lit("_focus2")))
    return s.select("s_suppkey", selection.key_value(key).alias("value"))


@query("status_report", "SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_orderpriority) AS digests, max(o_totalprice) AS top, round(arg_max(o_totalprice,o_orderkey)-arg_min(o_totalprice,o_orderkey),6) AS drift FROM orders GROUP BY ALL")
def status_report(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("digest"), F.col("o_totalprice").alias("measure"), F.col("o_orderkey").alias("at"))
    return rounded(selection.status_report(o))


@query("group_spread", "SELECT c_mktsegment AS segment, round(avg(c_acctbal),6) AS mean, round(stddev_pop(c_acctbal),6) AS std, count(c_acctbal) AS n FROM customer GROUP BY ALL")
def group_spread(spark, d):
    return rounded(selection.spread(T.table(spark, d, "customer").withColumnRenamed("c_mktsegment", "segment"), ["segment"], "c_acctbal"))


@query("segmentation_labels", "WITH b AS (SELECT DISTINCT s_nationkey AS n, s_suppkey%23 AS cut FROM supplier WHERE s_suppkey%23 BETWEEN 1 AND 19), r AS (SELECT DISTINCT s_nationkey AS n FROM supplier) SELECT 'n' || r.n AS run_id, k.range AS bin, count(b.cut)::BIGINT AS label FROM r CROSS JOIN range(20) k LEFT JOIN b ON b.n=r.n AND b.cut<=k.range GROUP BY r.n, k.range")
def segmentation_labels(spark, d):
    """Boundaries of each nation from its suppliers' keys, as text."""
    s = T.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list((F.col("s_suppkey") % 23).cast("string")), "; ").alias("breaks"))
    return binning.segmentation_labels(s.select(F.format_string("n%d", "s_nationkey").alias("run_id"), "breaks"), 20)



@query("extrapolated_curve", "WITH k AS (SELECT n_nationkey*10.0::DOUBLE AS x, sum(c_acctbal) AS y FROM nation JOIN customer ON c_nationkey=n_nationkey GROUP BY ALL), g AS (SELECT (range*7.0-21)::DOUBLE AS t FROM range(44)), p AS (SELECT t, greatest(0,least(23,floor(t/10)))*10.0 AS a FROM g) SELECT 'n' AS run_id, t, round(k.y+(t-k.x)*(q.y-k.y)/10,4) AS y FROM p JOIN k ON k.x=a JOIN k q ON q.x=a+10")
def extrapolated_curve(spark, d):
    c = T.table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("y"))
    k = c.select(F.lit("n").alias("run_id"), (F.col("c_nationkey") * 10.0).alias("x"), "y")
    g = spark.range(44).select(F.lit("n").alias("run_id"), (F.col("id") * 7.0 - 21).alias("t"))
    return selection.extrapolated(k, g).select("run_id", "t", F.round("y", 4).alias("y"))


@query("sampled_pairs")
def sampled_pairs(spark, d):
    u = T.customers(spark, d).select("unit", "group_id")
    return statistics.sampled_pairs(u, 200)


@query("changepoint_elbow")
def changepoint_elbow(spark, d):
    s = binning.run_scaled(signal(spark, d), most=5 * T.BINS).select("run_id", "cluster", "bin", F.col("y").alias("x"))
    return selection.elbow(segmentation.penalty_grid(s, [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]))


@query("candidate_order", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)::INT AS idx FROM supplier")
def candidate_order(spark, d):
    s = T.table(spark, d, "supplier").withColumn("value", F.col("s_acctbal"))
    w = Window.partitionBy("s_nationkey").orderBy(*selection.candidate_order(), "s_suppkey")
    return s.select("s_suppkey", F.row_number().over(w).alias("idx"))

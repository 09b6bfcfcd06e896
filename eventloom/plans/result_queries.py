"""Registered queries of results, features, candidates and network parameters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.operators import candidates, features, methods, network, results
from eventloom.plans import config
from eventloom.plans.queries import ACTIVE, COUNTS, PATTERN, SIGNAL, active, daily, patterns, query, rounded, signal
from eventloom.sources import tables as T

# ------------------------------------------------------------------- finished results

FINAL = f"""
WITH {PATTERN},
m AS (SELECT label, sum(mean) AS total FROM (SELECT label, cluster, avg(act.x) AS mean FROM act JOIN pl USING (run_id, bin) GROUP BY ALL) GROUP BY label),
rk AS (SELECT label, row_number() OVER (ORDER BY total DESC, label)-1 AS state FROM m),
lb AS (SELECT run_id, bin, state FROM pl JOIN rk USING (label)),
isl AS (SELECT *, sum(CASE WHEN p IS NULL OR p<>state THEN 1 ELSE 0 END) OVER (ORDER BY bin) AS island FROM (SELECT *, lag(state) OVER (ORDER BY bin) AS p FROM lb))
"""


@query("finalized_segments", FINAL + "SELECT run_id, min(bin) AS start_bin, max(bin)+1 AS stop_bin, state, (count(*)*2.0)::DOUBLE AS duration_time FROM isl GROUP BY run_id, island, state")
def finalized_segments(spark, d):
    out = results.finalized(patterns(spark, d).select("run_id", "bin", F.col("label").cast("long").alias("label")), signal(spark, d), 2.0)
    return out["segments"].select("run_id", "start_bin", "stop_bin", "state", "duration_time")


@query("finalized_occupancy", FINAL + "SELECT run_id, state, round(count(*)/120.0,6) AS share FROM isl GROUP BY ALL")
def finalized_occupancy(spark, d):
    out = results.finalized(patterns(spark, d).select("run_id", "bin", F.col("label").cast("long").alias("label")), signal(spark, d))
    return rounded(out["occupancy"])


@query("finalized_templates", FINAL + ", mm AS (SELECT lb.run_id, state, cluster, avg(x) AS mean FROM sig JOIN lb USING (run_id, bin) GROUP BY ALL) SELECT run_id, state, cluster, (mean >= avg(mean) OVER (PARTITION BY cluster))::INT AS active FROM mm")
def finalized_templates(spark, d):
    out = results.finalized(patterns(spark, d).select("run_id", "bin", F.col("label").cast("long").alias("label")), signal(spark, d))
    return out["templates"].select("run_id", "state", "cluster", "active")


SEGMENTS = f"""
WITH {SIGNAL},
sm AS (SELECT run_id, bin-bin%6 AS start_bin, cluster, avg(x) AS mean FROM sig GROUP BY ALL),
th AS (SELECT run_id, cluster, quantile_cont(mean,0.2)+0.35*greatest(quantile_cont(mean,0.95)-quantile_cont(mean,0.2),0.0) AS threshold FROM sm GROUP BY ALL),
mk AS (SELECT *, (mean>=threshold)::INT AS own FROM sm JOIN th USING (run_id, cluster)),
kk AS (SELECT *, row_number() OVER (PARTITION BY start_bin ORDER BY mean DESC, cluster DESC) AS k, sum(own) OVER (PARTITION BY start_bin) AS nn FROM mk),
tpl AS (SELECT run_id, start_bin, cluster, mean, CASE WHEN nn<1 AND k<=1 THEN 1 ELSE own END AS active FROM kk)
"""


def segment_means(spark, d):
    s = signal(spark, d).withColumn("start_bin", F.col("bin") - F.col("bin") % 6)
    return s.groupBy("run_id", "start_bin", "cluster").agg(F.avg("x").alias("mean"))


@query("segment_templates", SEGMENTS + "SELECT run_id, start_bin, cluster, active FROM tpl")
def segment_templates(spark, d):
    return results.segment_templates(segment_means(spark, d)).select("run_id", "start_bin", "cluster", "active")


@query("template_states", SEGMENTS + ", r AS (SELECT run_id, start_bin, list(active ORDER BY cluster) AS template FROM tpl GROUP BY ALL), f AS (SELECT template, min(start_bin) AS first FROM r GROUP BY ALL), nn AS (SELECT template, dense_rank() OVER (ORDER BY first)-1 AS state FROM f) SELECT run_id, start_bin, state::INT AS state FROM r JOIN nn USING (template)")
def template_states(spark, d):
    return results.template_states(results.segment_templates(segment_means(spark, d))).select("run_id", "start_bin", F.col("state").cast("int").alias("state"))


CANONICAL = SEGMENTS + """,
b AS (SELECT start_bin, coalesce(quantile_cont(mean,0.5) FILTER (active=0), quantile_cont(mean,0.5)) AS base, min(active) AS whole FROM tpl GROUP BY start_bin),
x AS (SELECT tpl.*, base, CASE WHEN active=0 OR whole=1 THEN abs(mean-base) END AS off FROM tpl JOIN b USING (start_bin)),
sp AS (SELECT start_bin, greatest(1.4826*quantile_cont(off,0.5),0.05) AS sigma, max(mean) FILTER (active=1) AS top, sum(active) AS proposed FROM x GROUP BY start_bin),
st AS (SELECT x.*, sigma, proposed, (active=1 AND mean>=base+0.5*sigma AND (row_number() OVER (PARTITION BY start_bin ORDER BY active DESC, mean DESC, cluster)=1 OR mean>=0.6*top))::INT AS stays FROM x JOIN sp USING (start_bin)),
kt AS (SELECT *, row_number() OVER (PARTITION BY start_bin ORDER BY stays DESC, mean DESC, cluster) AS k2 FROM st),
ky AS (SELECT run_id, start_bin, coalesce(string_agg(cluster,'+' ORDER BY cluster) FILTER (stays=1 AND k2<=2),'LOW') AS state_key, count(*) FILTER (stays=1 AND k2<=2) AS members, sum(stays)<>any_value(proposed) AS pruned, sum(stays)>2 AS truncated FROM kt GROUP BY ALL),
cs AS (SELECT state_key, members, row_number() OVER (ORDER BY state_key<>'LOW', members, state_key)-1 AS state FROM (SELECT DISTINCT state_key, members FROM ky))
"""


def canonical(spark, d):
    rates = results.segment_templates(segment_means(spark, d)).select("run_id", F.col("start_bin").alias("episode"), "cluster", F.col("cluster").alias("name"), F.col("mean").alias("rate"), "active")
    return results.canonical_keys(rates, 2, 0.5, 0.6, 0.05)


@query("canonical_keys", CANONICAL + "SELECT run_id, start_bin AS episode, state_key, members::INT AS members, pruned, truncated, state FROM ky JOIN cs USING (state_key, members)")
def canonical_keys(spark, d):
    k = canonical(spark, d)
    return k.join(results.canonical_states(k), ["run_id", "state_key", "members"]).select("run_id", "episode", "state_key", "members", "pruned", "truncated", "state")


@query(
    "canonical_inventory",
    CANONICAL + """, lb AS (SELECT start_bin, state, state_key, sum(CASE WHEN p IS NULL OR p<>state THEN 1 ELSE 0 END) OVER (ORDER BY start_bin) AS isl FROM (SELECT start_bin, state, state_key, lag(state) OVER (ORDER BY start_bin) AS p FROM ky JOIN cs USING (state_key, members))),
sg AS (SELECT state, state_key, isl, min(start_bin)*0.5 AS t0, count(*)*3.0 AS dw FROM lb GROUP BY ALL)
SELECT 'events' AS run_id, state, state_key, count(*) AS visits, round(sum(dw),6)::DOUBLE AS occupied, round(avg(dw),6)::DOUBLE AS mean, round(coalesce(stddev_samp(dw),0),6)::DOUBLE AS std, round(quantile_cont(dw,0.5),6)::DOUBLE AS median, round(min(t0),6)::DOUBLE AS first, round(sum(dw)/sum(sum(dw)) OVER (),6)::DOUBLE AS share FROM sg GROUP BY state, state_key""",
)
def canonical_inventory(spark, d):
    x = signal(spark, d)
    out = methods.episodes_of(x, x.select("cluster").distinct().withColumn("name", F.col("cluster")), 6, 2, 0.5)
    return rounded(out["inventory"].drop("members"))


@query("canonical_emissions", CANONICAL + "SELECT sig.run_id, state, sig.cluster, round(avg(x),6) AS mean FROM sig JOIN ky ON ky.start_bin=sig.bin-sig.bin%6 JOIN cs USING (state_key, members) GROUP BY ALL")
def canonical_emissions(spark, d):
    x = signal(spark, d)
    out = methods.episodes_of(x, x.select("cluster").distinct().withColumn("name", F.col("cluster")), 6, 2, 0.5)
    return rounded(out["emissions"])


LABELS = "CASE WHEN n_nationkey%6=0 THEN 'low' WHEN n_nationkey%5=0 THEN 'state ' || (n_nationkey*7)%11 ELSE 'E' || n_nationkey || '+E' || n_regionkey END"


@query(
    "state_order",
    f"""WITH l AS (SELECT n_nationkey, {LABELS} AS label FROM nation),
x AS (SELECT *, list_sort(list_transform(regexp_extract_all(label,'E(\\d+)',1), lambda v: v::BIGINT)) AS e, list_sort(list_transform(regexp_extract_all(label,'(\\d+)',1), lambda v: v::BIGINT)) AS a, upper(label)='LOW' AS quiet FROM l),
y AS (SELECT n_nationkey, label, CASE WHEN quiet THEN 0 WHEN len(e)>0 THEN len(e) WHEN len(a)>0 THEN len(a) ELSE 99 END AS n, CASE WHEN quiet THEN [] WHEN len(e)>0 THEN e ELSE a END AS nums FROM x)
SELECT n_nationkey, label, row_number() OVER (ORDER BY n, nums, label, n_nationkey) AS place FROM y""",
)
def state_order(spark, d):
    n = F.col("n_nationkey")
    label = F.when(n % 6 == 0, F.lit("low")).when(n % 5 == 0, F.concat(F.lit("state "), (n * 7 % 11).cast("string"))).otherwise(F.concat(F.lit("E"), n.cast("string"), F.lit("+E"), F.col("n_regionkey").cast("string")))
    x = T.table(spark, d, "nation").select("n_nationkey", label.alias("label"))
    return x.withColumn("place", F.row_number().over(Window.orderBy(results.state_order(), "n_nationkey")))


@query("member_counts", "SELECT s_nationkey, count(*) FILTER (s_suppkey%4=0) AS none, count(*) FILTER (s_suppkey%4=1) AS one, count(*) FILTER (s_suppkey%4>1) AS more FROM supplier GROUP BY ALL")
def member_counts(spark, d):
    return results.member_counts(T.table(spark, d, "supplier").withColumn("members", F.col("s_suppkey") % 4), ["s_nationkey"])


@query("cluster_names", "SELECT n_nationkey AS cluster, 'C' || (n_nationkey+1) AS name FROM nation")
def cluster_names(spark, d):
    name = F.when(F.col("n_nationkey") != 3, F.col("n_name"))
    return results.named(T.table(spark, d, "nation").select(F.col("n_nationkey").alias("cluster"), name.alias("name")))


@query("wide_rates", f"WITH {PATTERN}, m AS (SELECT pl.run_id, label AS state, cluster, avg(act.x) AS mean FROM act JOIN pl USING (run_id, bin) GROUP BY ALL) SELECT run_id, state, round(max(mean) FILTER (cluster='click'),6) AS click, round(max(mean) FILTER (cluster='view'),6) AS view FROM m GROUP BY ALL")
def wide_rates(spark, d):
    labels = patterns(spark, d).select("run_id", "bin", F.col("label").cast("long").alias("label"))
    return rounded(results.wide_rates(results.states.state_means(signal(spark, d), labels), ["click", "view"]))


@query("every_state", "WITH t AS (SELECT quality+toxic AS state, count(*) AS n_true FROM labels GROUP BY ALL), p AS (SELECT doc_id%4 AS state, count(*) AS n_pred FROM labels GROUP BY ALL) SELECT 'l' AS run_id, state::BIGINT AS state, coalesce(n_true,0) AS n_true, coalesce(n_pred,0) AS n_pred FROM t FULL JOIN p USING (state)")
def every_state(spark, d):
    x = T.table(spark, d, "labels").withColumn("run_id", F.lit("l"))
    return results.every_state(x.withColumn("label", (F.col("quality") + F.col("toxic")).cast("long")), x.withColumn("label", F.col("doc_id") % 4))


def correlations(spark, d):
    """Line items as correlations of networks (suppliers) and inits (line numbers)."""
    x = T.table(spark, d, "lineitem")
    return x.select((F.col("l_suppkey") % 3).alias("network"), F.col("l_linenumber").alias("init"), F.col("l_returnflag").alias("measure"), F.col("l_linestatus").alias("category"), (F.col("l_discount") * 8).alias("r"), (F.col("l_tax") < 0.07).alias("ok"))


CORR = "WITH c AS (SELECT l_suppkey%3 AS network, l_linenumber AS init, l_returnflag AS measure, l_linestatus AS category, l_discount*8 AS r, l_tax<0.07 AS ok FROM lineitem)"


@query("init_summary", CORR + " SELECT network, init, measure, category, round(tanh(avg(atanh(r))),6) AS mean, count(r) AS n FROM c WHERE ok GROUP BY ALL")
def init_summary(spark, d):
    return rounded(results.init_summary(correlations(spark, d), ["network", "init"]))


@query("network_summary", CORR + ", p AS (SELECT network, init, measure, category, tanh(avg(atanh(r))) AS mean FROM c WHERE ok GROUP BY ALL), g AS (SELECT * FROM (SELECT unnest([0,1,2,9]) AS network) CROSS JOIN (SELECT DISTINCT measure, category FROM c)) SELECT g.network, g.measure, g.category, round(avg(mean),6) AS mean FROM g LEFT JOIN p USING (network, measure, category) GROUP BY ALL")
def network_summary(spark, d):
    return rounded(results.network_summary(correlations(spark, d), spark.createDataFrame([(0,), (1,), (2,), (9,)], "network int"), ["network"]))


@query("collected_results", "SELECT l_returnflag AS key, l_linenumber AS idx, round(avg(l_quantity),6) AS mean, round(stddev_pop(l_quantity),6) AS std, count(*) AS n FROM lineitem WHERE l_tax<0.07 GROUP BY ALL")
def collected_results(spark, d):
    x = T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("v"), (F.col("l_tax") < 0.07).alias("ok"))
    return rounded(results.collected(x, ["key"], "idx", "v"))


SWEEP = """
WITH s AS (SELECT (o_custkey%5)/10.0 AS threshold, CASE o_orderkey%5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '>1' ELSE 'gt5' END AS label, o_custkey%8 AS n_cps, o_custkey%3 AS n_states, o_totalprice/1e6 AS explained, o_orderkey FROM orders),
e AS (SELECT *, CASE WHEN label IN ('0','1','2') THEN n_cps=label::INT END AS exact, CASE WHEN label IN ('0','1','2') THEN n_cps=label::INT WHEN label='>1' THEN n_cps>1 ELSE n_cps>5 END AS agrees FROM s),
g AS (SELECT threshold, avg(exact::INT) AS exact_known, avg(agrees::INT) AS agrees, avg(n_cps) AS mean_cps, quantile_cont(n_cps,0.5) AS median_cps, avg(n_states) AS mean_states, avg(explained) AS mean_explained FROM e GROUP BY threshold),
sc AS (SELECT *, row_number() OVER (ORDER BY agrees DESC, exact_known DESC NULLS LAST, mean_explained DESC, threshold)::INT AS place FROM g)
"""


def sweep_rows(spark, d):
    o, k = T.table(spark, d, "orders"), F.col("o_orderkey") % 5
    label = F.when(k == 0, "0").when(k == 1, "1").when(k == 2, "2").when(k == 3, ">1").otherwise("gt5")
    return o.select((F.col("o_custkey") % 5 / 10.0).alias("threshold"), label.alias("label"), (F.col("o_custkey") % 8).alias("n_cps"), (F.col("o_custkey") % 3).alias("n_states"), (F.col("o_totalprice") / 1e6).alias("explained"), "o_orderkey")


@query("threshold_scores", SWEEP + "SELECT round(threshold,6)::DOUBLE AS threshold, round(exact_known,6) AS exact_known, round(agrees,6) AS agrees, round(mean_cps,6) AS mean_cps, round(median_cps,6)::DOUBLE AS median_cps, round(mean_states,6) AS mean_states, round(mean_explained,6) AS mean_explained, place FROM sc")
def threshold_scores(spark, d):
    return rounded(results.threshold_scores(sweep_rows(spark, d)))


@query("best_threshold", SWEEP + "SELECT o_orderkey, n_cps FROM s WHERE threshold=(SELECT threshold FROM sc WHERE place=1)")
def best_threshold(spark, d):
    return results.best_threshold(sweep_rows(spark, d)).select("o_orderkey", "n_cps")


@query(
    "episode_statistics",
    f"""WITH {COUNTS}, pr AS (SELECT 'within' AS scope, unit AS a, unit+5 AS b FROM u UNION ALL SELECT 'across', unit, unit+1 FROM u),
r AS (SELECT scope, a, b, corr(x.n,y.n) AS r FROM pr JOIN b x ON x.unit=a JOIN b y ON y.unit=pr.b AND y.bin=x.bin GROUP BY ALL),
z AS (SELECT scope, tanh(avg(atanh(least(greatest(r,-0.999999),0.999999)))) AS mr, count(r) AS n FROM r WHERE NOT isnan(r) GROUP BY scope),
un AS (SELECT unit%5 AS g, unit, avg(n) AS m, var_pop(n) AS v FROM b GROUP BY ALL),
vp AS (SELECT g, avg(m) AS mean, avg(v) AS temporal, var_pop(m) AS quenched FROM un GROUP BY g)
SELECT 'events' AS run_id, round((SELECT mr FROM z WHERE scope='within'),6) AS within_r, (SELECT n FROM z WHERE scope='within') AS within_n, round((SELECT mr FROM z WHERE scope='across'),6) AS across_r, (SELECT n FROM z WHERE scope='across') AS across_n,
round(avg(mean) FILTER (g<2),6) AS mean_active, round(avg(mean) FILTER (g>=2),6) AS mean_inactive, round(avg(temporal) FILTER (g<2),6) AS temporal_active, round(avg(temporal) FILTER (g>=2),6) AS temporal_inactive,
round(avg(quenched) FILTER (g<2),6) AS quenched_active, round(avg(quenched) FILTER (g>=2),6) AS quenched_inactive, round(avg(temporal+quenched) FILTER (g<2),6) AS total_active, round(avg(temporal+quenched) FILTER (g>=2),6) AS total_inactive FROM vp""",
)
def episode_statistics(spark, d):
    x = daily(spark, d).select("run_id", "unit", F.col("bin").alias("t"), F.col("n").cast("double").alias("value"))
    u = x.select("unit").distinct()
    pairs = u.select(F.lit("within").alias("scope"), F.col("unit").alias("a"), (F.col("unit") + 5).alias("b")).unionByName(u.select(F.lit("across").alias("scope"), F.col("unit").alias("a"), (F.col("unit") + 1).alias("b")))
    return rounded(results.episode_statistics(x, pairs, u.withColumn("group_id", F.col("unit") % 5), F.col("group_id") < 2))


# ------------------------------------------------------------------- features and masks


def _z(x: str) -> str:
    return f"({x}-avg({x}) OVER c)/CASE WHEN stddev_pop({x}) OVER c=0 THEN 1 ELSE stddev_pop({x}) OVER c END"


_KINDS = {"counts": "n::DOUBLE", "sqrt_counts": "sqrt(greatest(n,0))", "zscore_counts": _z("n"), "sqrt_zscore": _z("sqrt(greatest(n,0))"), "zscore_rates": _z("x"), "binary": "(x>=quantile_cont(x,0.8) OVER c)::INT::DOUBLE"}


@query("feature_kinds", f"WITH {SIGNAL} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, run_id, cluster, bin, round({e},6) AS f FROM sig WINDOW c AS (PARTITION BY cluster)" for k, e in _KINDS.items()))
def feature_kinds(spark, d):
    s, out = signal(spark, d), None
    for kind in _KINDS:
        own = features.features(s, kind).withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return rounded(out)


@query("feature_lags", f"WITH {SIGNAL}, o AS (SELECT unnest([-1,0,1]) AS off) SELECT a.run_id, a.cluster, a.bin, off AS \"offset\", round(b.x,6) AS f FROM sig a CROSS JOIN o JOIN sig b ON b.cluster=a.cluster AND b.bin=least(greatest(a.bin+off,0),119)")
def feature_lags(spark, d):
    return rounded(features.features(signal(spark, d), "temporal_window", lags=1))


@query("binary_source", f"WITH {SIGNAL}, q AS (SELECT cluster, quantile_cont(x,0.8) AS th FROM sig GROUP BY ALL), p AS (SELECT cluster, quantile_cont(x,0.5) AS md FROM sig GROUP BY ALL) SELECT run_id, cluster, bin, (x>=md)::INT AS own, (x>=th)::INT AS again FROM sig JOIN q USING (cluster) JOIN p USING (cluster)")
def binary_source(spark, d):
    a = active(spark, d)
    own = features.binary_for(a).select("run_id", "cluster", "bin", F.col("active").alias("own"))
    return own.join(features.binary_for(a, again=True).select("run_id", "cluster", "bin", F.col("active").alias("again")), ["run_id", "cluster", "bin"])


@query(
    "signal_problems",
    f"""WITH {SIGNAL}, bad AS (SELECT run_id, cluster, bin, CASE WHEN bin%50=7 THEN -1 ELSE n END AS n, CASE WHEN bin%40=3 THEN NULL ELSE x END AS x FROM sig WHERE NOT (cluster='click' AND bin=60) UNION ALL SELECT run_id, cluster, bin, n, x FROM sig WHERE bin=5)
SELECT run_id, 'unknown value' AS problem, count(*) AS n FROM bad WHERE x IS NULL GROUP BY ALL UNION ALL SELECT run_id, 'negative count', count(*) FROM bad WHERE n<0 GROUP BY ALL
UNION ALL SELECT run_id, 'repeated', count(*) FROM (SELECT run_id FROM bad GROUP BY run_id, cluster, bin HAVING count(*)>1) GROUP BY ALL
UNION ALL SELECT run_id, 'holes', count(*) FROM (SELECT run_id, cluster FROM bad GROUP BY ALL HAVING count(DISTINCT bin)<>120) GROUP BY ALL
UNION ALL SELECT run_id, 'unknown cluster', count(DISTINCT cluster) FROM bad WHERE cluster='view' GROUP BY ALL""",
)
def signal_problems(spark, d):
    s = signal(spark, d)
    bad = s.where("NOT (cluster = 'click' AND bin = 60)").withColumn("n", F.when(F.col("bin") % 50 == 7, -1).otherwise(F.col("n"))).withColumn("x", F.when(F.col("bin") % 40 != 3, F.col("x"))).unionByName(s.where("bin = 5"))
    return features.problems(bad, s.select("cluster").distinct().where("cluster <> 'view'"))


@query("id_masks", "SELECT c_custkey, (c_custkey>=10 AND (c_custkey-10)%7=0) AS stepped, c_custkey IN (3,5,8) AS listed, c_custkey%9=4 AS called FROM customer")
def id_masks(spark, d):
    k = F.col("c_custkey")
    return T.table(spark, d, "customer").select("c_custkey", features.id_mask(slice(10, None, 7), k).alias("stepped"), features.id_mask([3, 5, 8], k).alias("listed"), features.id_mask(lambda c: c % 9 == 4, k).alias("called"))


@query("group_bounds", "SELECT 'first' AS grp, min(c_custkey) AS low, max(c_custkey) AS high FROM customer WHERE c_custkey BETWEEN 2 AND 39 AND c_custkey%2=0 UNION ALL SELECT 'rest', min(c_custkey), max(c_custkey) FROM customer WHERE c_custkey>=40")
def group_bounds(spark, d):
    return features.group_bounds(T.customers(spark, d), {"first": range(2, 40, 2), "rest": slice(40, None), "none": [-1]})


@query("step_bounds", "WITH v AS (SELECT DISTINCT (n_regionkey*n_regionkey)::DOUBLE AS v FROM nation), x AS (SELECT v, lag(v) OVER (ORDER BY v) AS a, lead(v) OVER (ORDER BY v) AS b FROM v) SELECT v, coalesce((v+a)/2, v-(b-v)/2, v-0.5) AS low, coalesce((v+b)/2, v+(v-a)/2, v+0.5) AS high FROM x")
def step_bounds(spark, d):
    return features.step_bounds(T.table(spark, d, "nation").withColumn("v", F.col("n_regionkey") * F.col("n_regionkey")))


# ------------------------------------------------------------------- candidates

FIX = """
WITH f AS (SELECT s_suppkey, 5.0+(s_suppkey%3) AS rep, (s_nationkey%4+1)::INT AS focus_count, s_acctbal/10000.0 AS value, CASE s_suppkey%4 WHEN 0 THEN 'unstable' WHEN 1 THEN NULL ELSE 'stable' END AS stability,
CASE WHEN s_suppkey%5<>0 THEN (s_suppkey%7)/1000.0 END AS residual, [s_acctbal/10000.0, s_acctbal/20000.0, abs(s_acctbal)/40000.0]::DOUBLE[] AS rates FROM supplier)
"""


def fixed_points(spark, d):
    k, v = F.col("s_suppkey"), F.col("s_acctbal") / 10000.0
    return T.table(spark, d, "supplier").select(
        "s_suppkey", (F.lit(5.0) + k % 3).alias("rep"), (F.col("s_nationkey") % 4 + 1).cast("int").alias("focus_count"), v.alias("value"),
        F.when(k % 4 == 0, "unstable").when(k % 4 != 1, "stable").alias("stability"), F.when(k % 5 != 0, k % 7 / 1000.0).alias("residual"),
        F.array(v, F.col("s_acctbal") / 20000.0, F.abs("s_acctbal") / 40000.0).alias("rates"),
    )


@query("fixpoint_candidates", FIX + ", n AS (SELECT *, row_number() OVER (PARTITION BY rep, focus_count ORDER BY value)-1 AS idx FROM f WHERE abs(rep-6.0)<=1e-9) SELECT s_suppkey, idx, coalesce(stability,'unknown') AS stability FROM n WHERE focus_count IN (1,3) AND coalesce(stability,'unknown')<>'stable'")
def fixpoint_candidates(spark, d):
    return candidates.chosen(fixed_points(spark, d), 6.0, [1, 3], "unstable", 3, ["s_suppkey"]).select("s_suppkey", "idx", "stability")


ORDERED = "ra, rb, -abs(value), -value"
REPORT = FIX + f""", z AS (SELECT s_suppkey, rep, focus_count, CASE WHEN s_suppkey%11=0 THEN 0.0 ELSE value END AS value, stability, residual, CASE WHEN s_suppkey%11=0 THEN [0.0,0.0,0.0] ELSE rates END AS rates FROM f),
r AS (SELECT z.*, abs(value)<=1e-6 AND abs(rates[1])<=1e-6 AND abs(rates[2])<=1e-6 AND abs(rates[3])<=1e-6 AS triv, CASE WHEN stability='stable' THEN 0 ELSE 1 END AS ra, coalesce(residual,'inf'::DOUBLE) AS rb FROM z),
n AS (SELECT *, CASE WHEN value-lag(value) OVER (PARTITION BY rep, focus_count, triv ORDER BY value, {ORDERED})<=0.02 THEN 0 ELSE 1 END AS new FROM r),
c AS (SELECT *, sum(new) OVER (PARTITION BY rep, focus_count, triv ORDER BY value, {ORDERED}) AS chain FROM n),
p AS (SELECT *, NOT triv AND row_number() OVER (PARTITION BY rep, focus_count, triv, chain ORDER BY {ORDERED})=1 AS best FROM c),
b AS (SELECT * FROM p WHERE best),
k1 AS (SELECT rep, focus_count, value AS v1 FROM b QUALIFY row_number() OVER (PARTITION BY rep, focus_count ORDER BY {ORDERED})=1),
k2 AS (SELECT rep, focus_count, v1, value AS v2 FROM b JOIN k1 USING (rep, focus_count) WHERE value<>v1 QUALIFY row_number() OVER (PARTITION BY rep, focus_count ORDER BY abs(value-v1) DESC, {ORDERED})=1),
k3 AS (SELECT rep, focus_count, value AS v3 FROM b JOIN k2 USING (rep, focus_count) WHERE value<>v1 AND value<>v2 QUALIFY row_number() OVER (PARTITION BY rep, focus_count ORDER BY least(abs(value-v1),abs(value-v2)) DESC, {ORDERED})=1),
t AS (SELECT rep, focus_count, v1 AS value FROM k1 UNION SELECT rep, focus_count, v2 FROM k2 UNION SELECT rep, focus_count, v3 FROM k3),
w AS (SELECT p.*, CASE WHEN triv THEN 'trivial_zero' WHEN NOT best THEN 'duplicate_threshold' WHEN t.value IS NULL THEN 'max_fixpoints' END AS filter_reason FROM p LEFT JOIN t ON best AND p.rep=t.rep AND p.focus_count=t.focus_count AND p.value=t.value)
SELECT s_suppkey, rep::DOUBLE AS rep, focus_count, filter_reason IS NULL AS included, filter_reason FROM w
"""


@query("sweep_report", REPORT)
def sweep_report(spark, d):
    zero = F.col("s_suppkey") % 11 == 0
    c = fixed_points(spark, d).withColumn("value", F.when(zero, 0.0).otherwise(F.col("value")))
    c = c.withColumn("rates", F.when(zero, F.array(*[F.lit(0.0)] * 3)).otherwise(F.col("rates")))
    return candidates.sweep_report(c, 0.02).select("s_suppkey", "rep", "focus_count", "included", "filter_reason")


@query("peak_rates", FIX + "SELECT s_suppkey, round(greatest(rates[1],rates[2]),6)::DOUBLE AS peak FROM f")
def peak_rates(spark, d):
    return rounded(fixed_points(spark, d).select("s_suppkey", candidates.peak_rate(F.col("rates"), 2).alias("peak")))


RANK = "ORDER BY far DESC, (coalesce(stability,'unknown')<>'stable')::INT, coalesce(residual,'inf'::DOUBLE), -abs(value), -value"
_PICK = "p{k} AS (SELECT rep, focus_count, value AS v{k} FROM (SELECT *, row_number() OVER (PARTITION BY rep, focus_count {rank}) AS r FROM (SELECT f.*, {far} AS far FROM f {joins}) WHERE far>0) WHERE r=1)"
DIVERSE = (
    FIX + ", " + _PICK.format(k=0, rank=RANK, far="'inf'::DOUBLE", joins="")
    + ", " + _PICK.format(k=1, rank=RANK, far="abs(value-v0)", joins="JOIN p0 USING (rep, focus_count)")
    + ", " + _PICK.format(k=2, rank=RANK, far="least(abs(value-v0),abs(value-v1))", joins="JOIN p0 USING (rep, focus_count) JOIN p1 USING (rep, focus_count)")
)


@query("diverse_fixpoints", DIVERSE + " SELECT rep::DOUBLE AS rep, focus_count, round(v0,6)::DOUBLE AS value, 0 AS nth FROM p0 UNION ALL SELECT rep, focus_count, round(v1,6), 1 FROM p1 UNION ALL SELECT rep, focus_count, round(v2,6), 2 FROM p2")
def diverse_fixpoints(spark, d):
    return rounded(candidates.diverse(fixed_points(spark, d), 3))


DRAW = "(('0x' || substr(md5({parts}),1,8))::BIGINT/4294967296.0)"


@query("seeded_choices", FIX + f", k AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey)-1 AS i FROM f), s AS (SELECT a.range AS seed, b.range::INT AS draw FROM range(5) a, range(4) b) SELECT seed, draw, s_suppkey FROM s JOIN k ON k.i=floor({DRAW.format(parts=chr(39) * 2 + '||seed||' + chr(39) + ':' + chr(39) + '||draw')}*(SELECT count(*) FROM f))")
def seeded_choices(spark, d):
    seeds = spark.range(5).withColumnRenamed("id", "seed").select("seed", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("draw"))
    return candidates.seeded_choice(fixed_points(spark, d), seeds, ["s_suppkey"]).select("seed", "draw", "s_suppkey")


@query("fixpoints_of_rep", FIX + "SELECT focus_count, s_suppkey, row_number() OVER (PARTITION BY focus_count ORDER BY value)-1 AS idx FROM f WHERE abs(rep-7.0)<=1e-9")
def fixpoints_of_rep(spark, d):
    return candidates.first_match(fixed_points(spark, d), 7.0, ["s_suppkey"]).select("focus_count", "s_suppkey", "idx")


@query("focus_markers", FIX + "SELECT focus_count, stability='stable' AS stable, round(max(greatest(rates[1],rates[2])),6)::DOUBLE AS peak FROM f GROUP BY ALL")
def focus_markers(spark, d):
    return rounded(candidates.focus_markers(fixed_points(spark, d), 2))


@query("fixpoint_points", FIX + "SELECT rep::DOUBLE AS rep, round(value,6)::DOUBLE AS value, stability FROM f WHERE focus_count=2 AND NOT (abs(value)<=0.2 AND list_max(list_transform(rates, lambda r: abs(r)))<=0.2)")
def fixpoint_points(spark, d):
    f = fixed_points(spark, d).where("focus_count = 2")
    return rounded(f.where(~candidates.trivial(F.col("value"), F.col("rates"), 0.2)).select("rep", "value", "stability"))


@query("rep_grid", FIX + "SELECT focus_count, list_sort(list(DISTINCT rep::DOUBLE))::VARCHAR AS reps FROM f GROUP BY ALL")
def rep_grid(spark, d):
    return candidates.rep_grid(fixed_points(spark, d)).select("focus_count", F.concat(F.lit("["), F.array_join(F.transform("reps", lambda r: r.cast("string")), ", "), F.lit("]")).alias("reps"))


@query("cached_results", "WITH o AS (SELECT round(l_discount,2) AS kappa, round(l_tax,2) AS r_j, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT kappa, r_j, round(CASE WHEN kappa>=0.05 THEN 2*v ELSE v END,6) AS v FROM o WHERE kappa<0.08 OR r_j<0.04")
def cached_results(spark, d):
    old = T.table(spark, d, "lineitem").groupBy(F.round("l_discount", 2).alias("kappa"), F.round("l_tax", 2).alias("r_j")).agg(F.avg("l_quantity").alias("v")).where("kappa < 0.08 OR r_j < 0.04")
    fresh = old.where("kappa >= 0.05").select((F.col("kappa") + 1e-9).alias("kappa"), "r_j", (F.col("v") * 2).alias("v"))
    return rounded(candidates.upserted(old, fresh, ["kappa", "r_j"]))


@query("start_rates", f"SELECT n_name AS param_id, p.range::INT AS pop, round(greatest(0,least(1,n_regionkey/4.0+({DRAW.format(parts='n_name||' + chr(39) + ':' + chr(39) + '||p.range')}*2-1)*0.2)),6) AS rate FROM nation CROSS JOIN range(4) p")
def start_rates(spark, d):
    p = T.table(spark, d, "nation").select(F.col("n_name").alias("param_id"), (F.col("n_regionkey") / 4.0).alias("value"))
    return rounded(candidates.start_rates(p, 4))


# ------------------------------------------------------------------- network parameters

PARAMS = "pa AS (SELECT k.kappa, r.r_e, 20.0 AS q, 4000.0 AS n_e, 1000.0 AS n_i, 1.0 AS v_th, 1.2 AS g, 0.2 AS p_ee, 0.5 AS p_ie, 0.5 AS p_ei, 0.5 AS p_ii, 0.75 AS r_j FROM (SELECT unnest([0.0,0.5,1.0]::DOUBLE[]) AS kappa) k, (SELECT DISTINCT 1+p_size/8.0 AS r_e FROM part) r)"


def network_params(spark, d):
    """Three exponents for every size of parts, which is the strength of clustering."""
    sizes = T.table(spark, d, "part").select((F.col("p_size") / 8.0 + 1).alias("r_e")).distinct()
    grid = sizes.withColumn("kappa", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    fixed = {"q": 20.0, "n_e": 4000.0, "n_i": 1000.0, "v_th": 1.0, "g": 1.2, "p_ee": 0.2, "p_ie": 0.5, "p_ei": 0.5, "p_ii": 0.5, "r_j": 0.75}
    return grid.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn("param_id", F.format_string("%.1f/%.3f", "kappa", "r_e"))


@query(
    "cluster_parameters",
    f"""WITH {PARAMS}, b AS (SELECT *, 1+r_j*(r_e-1) AS r_i, n_e/(n_e+n_i) AS se, n_i/(n_e+n_i) AS si FROM pa),
j AS (SELECT *, v_th/sqrt(p_ee*se) AS jee, v_th/sqrt(p_ie*se) AS jie FROM b),
x AS (SELECT kappa, r_e, q, n_e+n_i AS n, unnest([{{'b':'EE','p':p_ee,'j':jee,'r':r_e}},{{'b':'IE','p':p_ie,'j':jie,'r':r_i}},{{'b':'EI','p':p_ei,'j':-g*jee*p_ee*se/(p_ei*si),'r':r_i}},{{'b':'II','p':p_ii,'j':-jie*p_ie*se/(p_ii*si),'r':r_i}}]) AS v FROM j)
SELECT printf('%.1f/%.3f',kappa,r_e) AS param_id, v.b AS block, round(v.p*pow(v.r,1-kappa),6) AS p_in, round(v.p*pow((q-v.r)/(q-1),1-kappa),6) AS p_out, round(v.j/sqrt(n)*pow(v.r,kappa),6) AS j_in, round(v.j/sqrt(n)*pow((q-v.r)/(q-1),kappa),6) AS j_out FROM x""",
)
def cluster_parameters(spark, d):
    return rounded(network.cluster_parameters(network_params(spark, d)))


@query("external_drive", f"WITH {PARAMS} SELECT printf('%.1f/%.3f',kappa,r_e) AS param_id, round(sqrt(p_ee*n_e),6) AS drive_e, round(0.8*sqrt(p_ee*n_e),6) AS drive_i FROM pa")
def external_drive(spark, d):
    return rounded(network.external_drive(network_params(spark, d)))


@query("target_connectivity", "SELECT s_suppkey, round(least(1,greatest(0,a*t/((a+b)/2))),6) AS a, round(least(1,greatest(0,b*t/((a+b)/2))),6) AS b FROM (SELECT s_suppkey, (s_suppkey%10+1)/20.0 AS a, (s_nationkey+1)/30.0 AS b, 0.6 AS t FROM supplier)")
def target_connectivity(spark, d):
    p = T.table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 10 + 1) / 20.0).alias("a"), ((F.col("s_nationkey") + 1) / 30.0).alias("b"))
    return rounded(network.to_connectivity(p, ["a", "b"], F.lit(0.6)))


@query("time_scale", "WITH x AS (SELECT n_nationkey, CASE WHEN n_nationkey%7=0 THEN NULL ELSE n_nationkey*1.0 END AS te, (n_regionkey*3)::DOUBLE AS ti, 4000.0 AS ne, 1000.0 AS ni FROM nation) SELECT n_nationkey, round(CASE WHEN te IS NOT NULL AND least(te,ti)>0 THEN (CASE WHEN te>=ti THEN ne+te/ti*ni ELSE ni+ti/te*ne END)/(greatest(te,ti)/1000) ELSE 1 END,6) AS scale FROM x")
def time_scale(spark, d):
    n = F.col("n_nationkey")
    x = T.table(spark, d, "nation").select("n_nationkey", F.when(n % 7 != 0, n * 1.0).alias("te"), (F.col("n_regionkey") * 3).cast("double").alias("ti"))
    return rounded(x.select("n_nationkey", network.updates_per_second(F.col("te"), F.col("ti"), F.lit(4000.0), F.lit(1000.0)).alias("scale")))


@query("contrast_curves", "WITH r AS (SELECT DISTINCT p_size, 1+p_size/10.0 AS r FROM part) SELECT 'r' || p_size AS param_id, round(k.range/20.0,6) AS kappa, round(pow(r,1-k.range/20.0)*19/(20-pow(r,1-k.range/20.0)),6) AS density, round(pow(r,k.range/20.0)*19/(20-pow(r,k.range/20.0)),6) AS weight FROM r, range(21) k")
def contrast_curves(spark, d):
    """Curves for every size of parts."""
    p = T.table(spark, d, "part").select("p_size").distinct().select(F.format_string("r%d", "p_size").alias("param_id"), F.lit(20.0).alias("q"), (F.col("p_size") / 10.0 + 1).alias("ratio"))
    return rounded(network.contrast(p, 21))


_PEAK = "(-({m}*{s}/({s}-{m}))*exp(-(ln({s}/{m})/(1/{m}-1/{s}))/{m})+({m}*{s}/({s}-{m}))*exp(-(ln({s}/{m})/(1/{m}-1/{s}))/{s}))"
_EE, _EI, _IE, _II = (_PEAK.format(m=m, s=s) for m, s in (("te", "3.0"), ("te", "2.0"), ("10.0", "3.0"), ("10.0", "2.0")))


@query(
    "balanced_weights",
    f"""WITH x AS (SELECT 't' || n_nationkey AS param_id, 15.0+n_nationkey AS te FROM nation), w AS (SELECT param_id, te, 15.0*sqrt(5000.0)/sqrt(4000*0.2)/{_EE} AS ee, 1.1*15.0*sqrt(5000.0)/sqrt(4000*0.2)/{_IE} AS ie FROM x)
SELECT param_id, round(ee,6) AS j_ee, round(-1.2*ee*4.0*{_EE}/{_EI},6) AS j_ei, round(ie,6) AS j_ie, round(-1.3*ie*4.0*{_IE}/{_II},6) AS j_ii, round(15.0*1.0/te,6) AS rheobase FROM w""",
)
def balanced_weights(spark, d):
    p = T.table(spark, d, "nation").select(F.format_string("t%d", "n_nationkey").alias("param_id"), (F.col("n_nationkey") + 15.0).alias("tau_e"))
    fixed = {"n_e": 4000.0, "n_i": 1000.0, "e_l": 0.0, "v_e": 15.0, "v_i": 15.0, "tau_i": 10.0, "syn_e": 3.0, "syn_i": 2.0, "g_ei": 1.2, "g_ie": 1.1, "g_ii": 1.3, "p": 0.2}
    p = p.withColumns({k: F.lit(v) for k, v in fixed.items()})
    heo = p.select("param_id", network.rheobase(F.col("tau_e"), F.col("e_l"), F.col("v_e"), F.lit(1.0)).alias("rheobase"))
    return rounded(network.balanced_weights(p).join(heo, "param_id"))


@query("assembled_weights", "SELECT post, pre, sum(w) AS w FROM (SELECT l_suppkey AS post, l_partkey%100+1 AS pre, CASE WHEN l_linenumber%2=0 THEN -l_quantity ELSE l_quantity END AS w FROM lineitem) WHERE post<>pre GROUP BY ALL HAVING sum(w)<>0")
def assembled_weights(spark, d):
    w = F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return network.assembled(T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("post"), (F.col("l_partkey") % 100 + 1).alias("pre"), w.alias("w")))


@query("population_problems", "WITH c AS (SELECT 'n' AS run_id, n_nationkey AS pop, n_nationkey*10+(n_nationkey%5=2)::INT AS start_id, n_nationkey*10+10+(n_nationkey%7=3)::INT-10*(n_nationkey=8)::INT AS end_id FROM nation), x AS (SELECT *, lag(end_id) OVER (ORDER BY start_id, end_id) AS b FROM c) SELECT run_id, pop, start_id::INT AS start_id, end_id::INT AS end_id, CASE WHEN end_id<=start_id THEN 'empty' WHEN coalesce(b,0)<start_id THEN 'gap' WHEN b>start_id THEN 'overlap' END AS problem FROM x")
def population_problems(spark, d):
    k = F.col("n_nationkey")
    c = T.table(spark, d, "nation").select(F.lit("n").alias("run_id"), k.alias("pop"), (k * 10 + (k % 5 == 2).cast("int")).cast("int").alias("start_id"), (k * 10 + 10 + (k % 7 == 3).cast("int") - 10 * (k == 8).cast("int")).cast("int").alias("end_id"))
    return network.population_bounds(c)


@query("membership_problems", "WITH m AS (SELECT c_custkey AS unit FROM customer WHERE c_custkey%10<>0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey%15=1) SELECT c.c_custkey AS unit, count(m.unit) AS times FROM customer c LEFT JOIN m ON m.unit=c.c_custkey GROUP BY ALL HAVING count(m.unit)<>1")
def membership_problems(spark, d):
    u = T.customers(spark, d)
    m = u.where("unit % 10 <> 0").select("unit", F.lit(1).alias("pop")).unionByName(u.where("unit % 15 = 1").select("unit", F.lit(2).alias("pop")))
    return network.membership(m, u)


@query("expected_synapses", "SELECT p_size AS run_id, round(sum(p_partkey*2*(p_retailprice/5000.0)),3) AS expected, sum(p_partkey*2*(p_retailprice/5000.0))<=20000 AS fits FROM part GROUP BY ALL")
def expected_synapses(spark, d):
    b = T.table(spark, d, "part").select(F.col("p_size").alias("run_id"), F.col("p_partkey").alias("n_post"), F.lit(2).alias("n_pre"), (F.col("p_retailprice") / 5000.0).alias("p"))
    return network.expected_synapses(b, 20000.0).withColumn("expected", F.round("expected", 3))


@query("focus_groups", "WITH p AS (SELECT 'q' || s_suppkey AS param_id, s_suppkey%6 AS f, unnest(range(5)) AS k FROM supplier) SELECT param_id, CASE WHEN k<f THEN 'focus' ELSE 'rest' END AS grp, 'E' || (k+1) AS pop FROM p UNION ALL SELECT param_id, 'I', 'I' || (k+1) FROM p")
def focus_groups(spark, d):
    p = T.table(spark, d, "supplier").select(F.format_string("q%d", "s_suppkey").alias("param_id"), F.lit(5).alias("q"), (F.col("s_suppkey") % 6).alias("focus"))
    return network.focus_groups(p)


@query("start_activity", "SELECT n_nationkey AS pop, CASE WHEN n_regionkey<2 THEN 'E' ELSE 'I' END AS kind, CASE WHEN n_nationkey%8=3 THEN 0.9 WHEN n_regionkey<2 THEN 0.3 ELSE 0.1 END::DOUBLE AS rate FROM nation")
def start_activity(spark, d):
    p = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("pop"), F.when(F.col("n_regionkey") < 2, "E").otherwise("I").alias("kind"))
    return network.start_activity(p, 0.1, spark.createDataFrame([("E", 0.3)], "kind string, rate double"), p.where("pop % 8 = 3").select("pop", F.lit(0.9).alias("rate")))


@query("start_states", f"WITH u AS (SELECT c_nationkey AS pop, c_custkey AS unit, (c_nationkey%5)/5.0 AS rate, {DRAW.format(parts=chr(39) + '7:' + chr(39) + '||c_nationkey||' + chr(39) + ':' + chr(39) + '||c_custkey')} AS u FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY pop ORDER BY u, unit) AS k, count(*) OVER (PARTITION BY pop) AS n FROM u) SELECT unit, (u<rate)::INT AS drawn, (k<=floor(rate*n+0.5))::INT AS counted FROM k")
def start_states(spark, d):
    u = T.customers(spark, d).select(F.col("group_id").alias("pop"), "unit", (F.col("group_id") % 5 / 5.0).alias("rate"))
    a = network.start_states(u, 7).select("unit", F.col("s").alias("drawn"))
    return a.join(network.start_states(u, 7, True).select("unit", F.col("s").alias("counted")), "unit")


@query(
    "update_sequence",
    f"""WITH p AS (SELECT n_regionkey AS pop, n_regionkey*100 AS start_id, n_regionkey*10+5 AS size, sum((n_regionkey+1.0)) OVER (ORDER BY n_regionkey)/15.0 AS high FROM (SELECT DISTINCT n_regionkey FROM nation)),
s AS (SELECT range AS step, {DRAW.format(parts=chr(39) + '3:' + chr(39) + '||range||' + chr(39) + ':pop' + chr(39))} AS u, {DRAW.format(parts=chr(39) + '3:' + chr(39) + '||range||' + chr(39) + ':unit' + chr(39))} AS v FROM range(500))
SELECT step, pop, (start_id+floor(v*size))::BIGINT AS unit FROM (SELECT step, v, p.*, row_number() OVER (PARTITION BY step ORDER BY high) AS k FROM s JOIN p ON u<high) WHERE k=1""",
)
def update_sequence(spark, d):
    p = T.table(spark, d, "nation").select(F.col("n_regionkey").alias("pop")).distinct().select("pop", (F.col("pop") * 100).alias("start_id"), (F.col("pop") * 10 + 5).alias("size"), (F.col("pop") + 1.0).alias("weight"))
    return network.update_sequence(p, spark.range(500).withColumnRenamed("id", "step"), 3)


@query("seed_list", f"SELECT range AS network, floor({DRAW.format(parts=chr(39) + '11:' + chr(39) + '||range')}*2147483648)::BIGINT AS seed FROM range((SELECT count(*) FROM supplier))")
def seed_list(spark, d):
    """A seed for each supplier."""
    return network.seed_list(spark, 11, T.table(spark, d, "supplier").count())

"""Queries whose table is one run that no task holds: events in order are the bins, their
values and the hours since the event before are its two clusters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eventloom.operators import long_hmm, long_kmeans, long_segments, sequence
from eventloom.plans.queries import ORACLES, QUERIES, query, rounded
from eventloom.sources import archives, stored
from eventloom.sources import tables as T

__all__ = ["ORACLES", "QUERIES"]


def event_series(spark, d):
    """run_id, cluster, bin, x: each event's value over its spread, and the gap before it in hours."""
    marked = T.marked(spark, d).select("run_id", "t", "value")
    rows = sequence.numbered(sequence.lagged(marked, "t", "before"), ["t"]).select("run_id", F.col("i").cast("long").alias("bin"), "value", F.coalesce((F.col("t") - F.col("before")) / T.HOUR, F.lit(0.0)).alias("gap"))
    rows = stored.stored(rows, "series")  # read for the spread, for the first bin and for the bins themselves
    spread = rows.groupBy("run_id").agg(F.stddev_pop("value").alias("v"), F.stddev_pop("gap").alias("g"))
    both = F.explode(F.array(F.struct(F.lit("gap").alias("cluster"), (F.col("gap") / F.col("g")).alias("x")), F.struct(F.lit("value").alias("cluster"), (F.col("value") / F.col("v")).alias("x"))))
    return rows.join(F.broadcast(spread), "run_id").select("run_id", "bin", both.alias("c")).select("run_id", "c.cluster", "bin", "c.x")


@query("long_changepoints")
def long_changepoints(spark, d):
    """Segments of the whole event series; stretches prove their borders."""
    return long_segments.long_changepoints(event_series(spark, d), 6.0, 3, stretch=512)


@query("long_penalty_sweep")
def long_penalty_sweep(spark, d):
    return rounded(long_segments.long_penalty_grid(event_series(spark, d), [4.0, 8.0], 3, stretch=512))


@query("long_hmm_states")
def long_hmm_states(spark, d):
    """Two Gaussian states of the whole event series, four rounds from two starts."""
    return long_hmm.long_hmm(event_series(spark, d), 2, "gaussian", 2, 4, stretch=512)[0]


@query("long_kmeans_inertia")
def long_kmeans_inertia(spark, d):
    _, fits = long_kmeans.long_kmeans(event_series(spark, d), 4, 2)
    return rounded(fits.select("run_id", "inertia", F.size("centres").alias("centres")))


NEAREST = """
WITH v AS (SELECT vec_id AS bin, label, embedding::DOUBLE[] AS y FROM embeddings),
m AS (SELECT label, i, avg(y[i]) AS c FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
c AS (SELECT label, list(c ORDER BY i) AS c, row_number() OVER (ORDER BY label) - 1 AS k FROM m GROUP BY label),
f AS (SELECT bin, k, list_sum(list_transform(range(1, 65), lambda i: (y[i] - c[i]) * (y[i] - c[i]))) AS far FROM v, c)
SELECT 'embeddings' AS run_id, bin, arg_min(k, far)::BIGINT AS label FROM f GROUP BY bin
"""


@query("nearest_centres", NEAREST)
def nearest_centres(spark, d):
    """The last step of k-means from the class means as centres."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.lit("embeddings").alias("run_id"), F.col("vec_id").alias("bin"), "label", F.col("embedding").cast("array<double>").alias("y"))
    each = v.select("label", F.posexplode("y").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    centres = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "c"))), lambda s: s["c"]).alias("centres")).withColumn("run_id", F.lit("embeddings"))
    return long_kmeans.nearest(v.select("run_id", "bin", "y"), centres)


@query("archived_events", "SELECT event_type AS run_id, user_id AS unit, count(*) AS n, round(min((epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01 00:00:00'))/1000.0::DOUBLE), 3) AS first_t, round(max((epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01 00:00:00'))/1000.0::DOUBLE), 3) AS last_t FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type, user_id")
def archived_events(spark, d):
    """Events written by tasks as archives of runs (event types), and two of the runs read back by the cluster."""
    path = f"{stored.shared_folder(spark)}/recordings-{uuid.uuid4().hex}"
    rows = T.marked(spark, d).select(F.col("cluster").alias("run_id"), "unit", "t")
    archives.write_recordings(rows, path, 20_000)
    back = archives.read_recordings(spark, path, 5_000).where(F.col("run_id").isin("click", "view"))
    return back.groupBy("run_id", "unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("t"), 3).alias("first_t"), F.round(F.max("t"), 3).alias("last_t"))

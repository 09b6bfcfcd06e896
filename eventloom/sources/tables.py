"""The canonical frames and their readers.

spikes(run_id, unit, t): event trains, t in ms. units(run_id, unit): every unit, with or
without events. signal(run_id, cluster, bin, n, x): counts and summed values per cluster and
bin, zeros included. edges(post, pre, w): weighted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.numeric import epoch_ms, known

HOUR = 3_600_000.0
BIN_MS, BINS = 6 * HOUR, 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trains: a user is a unit."""
    return table(spark, sf_dir, "events").select(F.lit("events").alias("run_id"), F.col("user_id").alias("unit"), epoch_ms("ts").alias("t"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spikes with their cluster (the event type) and value."""
    return table(spark, sf_dir, "events").select(F.lit("events").alias("run_id"), F.col("user_id").alias("unit"), epoch_ms("ts").alias("t"), F.col("event_type").alias("cluster"), known(F.col("value")).alias("value"))


def order_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trains in days; customers without orders exist in units() only."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select(F.lit("orders").alias("run_id"), F.col("o_custkey").alias("unit"), day.alias("t"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.lit("orders").alias("run_id"), F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("group_id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("post"), F.col("l_partkey").alias("pre"), F.col("l_quantity").alias("w"))


def warmed(spikes: DataFrame, warmup: float, id_shift: int = 0) -> DataFrame:
    """Recorder events after the warm-up, with time and ids moved to start at zero."""
    return spikes.where(F.col("t") >= warmup).withColumn("t", F.col("t") - warmup).withColumn("unit", F.col("unit") - id_shift)


def npz_trace(spark: SparkSession, path: str, run_id: str) -> tuple[str, DataFrame]:
    """An NPZ trace as (kind, frame). Event keys win over rates: 'snn' gives spikes, 'binary'
    a signal of rates. Needs a path that the driver can open."""
    import numpy as np
    import pandas as pd

    with np.load(path, allow_pickle=False) as z:
        if "spiketimes" in z:
            t, unit = z["spiketimes"]
        elif "spike_times" in z and "spike_ids" in z:
            t, unit = z["spike_times"], z["spike_ids"]
        elif "rates" in z:
            rates = np.asarray(z["rates"], dtype=float)
            bins, clusters = np.meshgrid(np.arange(rates.shape[0]), np.arange(rates.shape[1]), indexing="ij")
            return "binary", spark.createDataFrame(pd.DataFrame({"run_id": run_id, "cluster": clusters.ravel(), "bin": bins.ravel(), "x": rates.ravel()}))
        else:
            raise ValueError("neither events nor rates in the archive")
    keep = np.isfinite(t)
    return "snn", spark.createDataFrame(pd.DataFrame({"run_id": run_id, "unit": np.asarray(unit)[keep].astype("int64"), "t": np.asarray(t, dtype=float)[keep]}))


def csr_edges(spark: SparkSession, data, indices, indptr) -> DataFrame:
    """A CSR matrix (row = post) as edges, expanded by the engine."""
    import numpy as np
    import pandas as pd

    ptr = np.asarray(indptr, dtype="int64")
    rows = spark.createDataFrame(pd.DataFrame({"post": np.arange(len(ptr) - 1), "a": ptr[:-1], "b": ptr[1:]})).where("b > a")
    cells = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(data)), "pre": np.asarray(indices, "int64"), "w": np.asarray(data, float)}))
    return rows.select("post", F.explode(F.sequence("a", F.col("b") - 1)).alias("k")).join(cells, "k").select("post", "pre", "w")


def csr_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Edges of a CSR matrix held in tables: rows(post, a, b) with their bounds in cells(k, pre, w).
    Each row's cells are told by their numbers and met by equality."""
    return rows.where("b > a").select("post", F.explode(F.sequence("a", F.col("b") - 1)).alias("k")).join(cells, "k").select("post", "pre", "w")


def save_result(frames: dict[str, DataFrame], folder: str, method: str) -> None:
    """One Parquet table per part of a result, partitioned by method."""
    for name, frame in frames.items():
        frame.withColumn("method", F.lit(method)).write.mode("append").partitionBy("method").parquet(f"{folder}/{name}")


def last_written(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows appended under one key, the latest."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), order).alias("r")).select(*key, "r.*")


def as_json(frame: DataFrame) -> DataFrame:
    return frame.select(F.to_json(F.struct(*frame.columns)).alias("json"))

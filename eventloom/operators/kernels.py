"""Smoothing kernels, convolution, lag features and curve interpolation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.quantiles import quantiles
from eventloom.operators import sequence


def gaussian(sigma: float, dt: float, widths: float = 3) -> list[float]:
    """exp(-(t / sigma)^2) on +-widths * sigma, of unit area."""
    if min(sigma, dt, widths) <= 0:
        raise ValueError("sigma, dt and widths must be positive")
    half = math.ceil(widths * sigma / dt)
    w = [math.exp(-((k * dt / sigma) ** 2)) for k in range(-half, half + 1)]
    return [x / (sum(w) * dt) for x in w]


def triangular(sigma: float, dt: float) -> list[float]:
    """A linear ramp with half base round(sigma * sqrt 6), of unit area."""
    half = round(sigma * math.sqrt(6))
    n = max(1, round(half / dt))
    w = [1 - abs(k) / n for k in range(-n + 1, n)]
    return [x / (sum(w) * dt) for x in w]


def convolved(series: DataFrame, value: str, kernel: list[float], by: list[str], edge: str = "zero", width: int = 4096) -> DataFrame:
    """Centred convolution along `bin`, a missing bin counting as 0; edge 'zero' pads, 'nearest'
    repeats end values. Stretches of bins get the bins that the kernel reaches beyond them (halos),
    and each is one vectorised convolution: what is shuffled grows with bins, not with taps."""
    half, w = len(kernel) // 2, np.array(kernel)
    width = max(width, 4 * half)
    limits = series.groupBy(*by).agg(F.min("bin").alias("_low"), F.max("bin").alias("_high"), F.min_by(value, "bin").alias("_first"), F.max_by(value, "bin").alias("_last"))
    cut = sequence.with_halo(series.select(*by, "bin", F.col(value).cast("double").alias("_x")), "bin", half, half, width).drop("own")
    schema = cut.select(*by, "bin", F.col("_x").alias("smooth")).schema

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first = int(frame["stretch"].iloc[0]) * width
        low, high = int(frame["_low"].iloc[0]), int(frame["_high"].iloc[0])
        at = np.arange(first - half, first + width + half)
        x = np.zeros(len(at))
        x[frame["bin"].to_numpy() - at[0]] = frame["_x"].fillna(0.0).to_numpy()
        if edge == "nearest":
            x[at < low], x[at > high] = frame["_first"].iloc[0], frame["_last"].iloc[0]
        smooth = np.convolve(x, w, "valid")
        own = frame[(frame["bin"] >= first) & (frame["bin"] < first + width)] if edge == "nearest" else None
        bins = own["bin"].to_numpy() if own is not None else np.arange(max(first, low), min(first + width, high + 1))
        out = {c: pd.Series([frame[c].iloc[0]] * len(bins), dtype=object) for c in by}
        return pd.DataFrame(out | {"bin": bins, "smooth": smooth[bins - first]})

    return cut.join(limits, by).groupBy(*by, "stretch").applyInPandas(run, schema)


def kernel_rate(counts: DataFrame, kernel: list[float]) -> DataFrame:
    """Mean count over units, convolved and trimmed by half the kernel at both ends, in Hz for
    times in ms."""
    half = len(kernel) // 2
    pooled = counts.groupBy("run_id", "bin").agg(F.avg("n").alias("n"))
    limits = pooled.groupBy("run_id").agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    out = convolved(pooled, "n", kernel, ["run_id"]).join(limits, "run_id")
    return out.where((F.col("bin") >= F.col("low") + half) & (F.col("bin") <= F.col("high") - half)).select("run_id", "bin", (F.col("smooth") * 1000).alias("rate"))


def rate_integral(rate: DataFrame, dt: float) -> DataFrame:
    return sequence.total_so_far(rate, "bin", F.col("rate") / 1000, "integral").withColumn("integral", F.col("integral") * dt)


def smooth_weights(sigma_bins: float) -> list[float]:
    """exp(-x^2 / 2 sigma^2) to 4 sigma, of sum one."""
    half = int(4 * sigma_bins + 0.5)
    w = [math.exp(-0.5 * (k / sigma_bins) ** 2) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def smoothed(signal: DataFrame, sigma_bins: float, value: str = "x") -> DataFrame:
    if sigma_bins <= 0:
        return signal.select("run_id", "cluster", "bin", F.col(value).alias("smooth"))
    return convolved(signal, value, smooth_weights(sigma_bins), ["run_id", "cluster"], "nearest")


def moving_average(signal: DataFrame, width: int, value: str = "x") -> DataFrame:
    """'same' moving average with zeros beyond the ends."""
    return convolved(signal, value, [1.0 / width] * width, ["run_id", "cluster"], "zero")


def reliability(signal: DataFrame, value: str = "x", eps: float = 1e-9, most: int | None = None) -> DataFrame:
    """Weight of each cluster: its range over the noise of its steps, squared shares. most: as
    in quantiles(), values of a cluster."""
    by = ["run_id", "cluster"]
    d = sequence.neighbour(signal, "bin", value, "before", by).withColumn("d", F.col(value) - F.col("before"))
    mid = quantiles(d, by, value, {"low": 0.05, "high": 0.95}, most).join(quantiles(d, by, "d", {"mid": 0.5}, most), by)
    mad = mid.join(quantiles(d.join(mid, by), by, F.abs(F.col("d") - F.col("mid")), {"mad": 0.5}, most), by).withColumn("range", F.col("high") - F.col("low"))
    noise = 1.4826 * F.coalesce("mad", F.lit(0.0)) / math.sqrt(2)
    s = F.greatest(F.col("range") - 2 * noise, F.lit(0.0))
    return mad.select("run_id", "cluster", "range", noise.alias("noise"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s * s / (s * s + noise * noise + eps))).alias("weight"))


def lag_features(signal: DataFrame, reach: int, value: str = "x") -> DataFrame:
    """value at bins -reach .. reach of each row as an array, ends repeated."""
    by = ["run_id", "cluster"]
    ends = signal.groupBy(*by).agg(F.min_by(value, "bin").alias("_first"), F.max_by(value, "bin").alias("_last"))
    cut = sequence.with_halo(signal, "bin", reach, reach, max(sequence.WIDTH, 4 * reach)).join(ends, by)
    w = Window.partitionBy(*by, "stretch").orderBy("bin")
    at = [F.coalesce(F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w), F.col("_first") if k > 0 else F.col("_last")) for k in range(reach, -reach - 1, -1)]
    return cut.withColumn("window", F.array(*at)).where("own").drop("own", "stretch", "_first", "_last")


def cutoff_hz(sigma_seconds: Column) -> Column:
    """Half-power frequency of a Gaussian of that width; infinite without smoothing."""
    return F.when(sigma_seconds <= 0, F.lit(math.inf)).otherwise(math.sqrt(math.log(2)) / (2 * math.pi * sigma_seconds))

"""Run settings: nested updates, dotted overrides, value ranges, tags and sweep grids."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(base: dict, more: dict) -> dict:
    """base with nested values of more."""
    out = dict(base)
    for k, v in more.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def overrides(pairs: list[str]) -> dict:
    """['a.b=1'] as a tree; values are JSON where they parse."""
    out: dict = {}
    for pair in pairs:
        name, eq, text = pair.partition("=")
        if not eq or not name:
            raise ValueError(f"not name=value: {pair}")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        tree = value
        for part in reversed(name.split(".")):
            tree = {part: tree}
        out = merged(out, tree)
    return out


def values(text: str) -> list[float]:
    """'0:1:0.25,3': ranges with their ends, in order, each value once."""
    out: list[float] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        if ":" in part:
            a, b, s = map(float, part.split(":"))
            if s == 0 or (b - a) / s < 0:
                raise ValueError(f"the step leads away from the end: {part}")
            out += [round(a + k * s, 12) for k in range(int((b - a) / s + 1e-9) + 1)]
        else:
            out.append(round(float(part), 12))
    return list(dict.fromkeys(out))


def tag(tree: dict) -> str:
    """A short name that equal settings share."""
    return hashlib.sha1(json.dumps(tree, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def sweep(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """One row per combination of the axes."""
    grid = spark.range(1).select()
    for name, options in axes.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, options))).alias(name))
    return grid


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a result; float keys are compared after rounding to 9 places."""
    key = lambda df: df.withColumns({f"_{k}": F.round(F.col(k).cast("double"), 9) if dict(df.dtypes)[k] in ("double", "float") else F.col(k) for k in keys})
    return key(tasks).join(key(done).select(*(f"_{k}" for k in keys)), [f"_{k}" for k in keys], "left_anti").select(*tasks.columns)


def swept(tasks: DataFrame, solve: Callable[[DataFrame], DataFrame], path: str, keys: list[str], value: str = "y", overwrite: bool = False) -> DataFrame:
    """The curves stored at path, after those of tasks that it lacks (with overwrite: of all
    tasks) are solved and stored. A curve with a point whose value is NULL or NaN isn't whole
    and is left out, so its task is tried again the next time."""
    spark, todo = tasks.sparkSession, tasks
    if not overwrite:
        try:
            todo = remaining(tasks, spark.read.parquet(path).select(*keys).distinct(), keys)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    broken = F.max((F.col(value).isNull() | F.isnan(value)).cast("int")).over(Window.partitionBy(*keys))  # of one curve
    whole = solve(todo).withColumn("_broken", broken).where("_broken = 0").drop("_broken")
    whole.write.mode("overwrite" if overwrite else "append").parquet(path)
    return spark.read.parquet(path)

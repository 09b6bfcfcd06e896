"""Importers and exporters of runs: folders, traces, shards of JSON, recordings with their own
ids, weights with their populations. Tables of a run are Parquet, partitioned by run."""

from __future__ import annotations

import io
import json
import math
import os
import pickle

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.tables import npz_trace

#: Words in the names of files that hold results and not recordings.
RESULTS = ("analysis", "summary", "pooled")


# ------------------------------------------------------------------- folders


def discover(folder: str) -> str:
    """The first archive of a folder by name that holds no results."""
    names = sorted(n for n in os.listdir(folder) if n.endswith(".npz") and not any(w in n.lower() for w in RESULTS))
    if not names:
        raise FileNotFoundError(f"no recording in {folder}")
    return os.path.join(folder, names[0])


def parameters(folder: str) -> dict:
    """params.json of a folder, its nested `parameter` tree if it has one; {} without a file."""
    path = os.path.join(folder, "params.json")
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        tree = json.load(f)
    return tree["parameter"] if isinstance(tree.get("parameter"), dict) else tree


def read_run(spark: SparkSession, source: str, run_id: str) -> dict:
    """kind, frame, parameters and cluster names of a folder or an archive. A trace's arrays
    are read on the driver, as one recording; stored runs are Parquet and read by the cluster."""
    folder = source if os.path.isdir(source) else os.path.dirname(source)
    kind, frame = npz_trace(spark, discover(source) if os.path.isdir(source) else source, run_id)
    given = parameters(folder)
    return {"kind": kind, "frame": frame, "parameters": given, "names": default_names(int(given.get("Q", 0)))}


def default_names(q: int) -> list[str]:
    return [f"E{k + 1}" for k in range(q)] + [f"I{k + 1}" for k in range(q)]


def sibling(path: str, suffix: str = "_weights.npz") -> str | None:
    """The file beside a trace that has its stem and a suffix, if there is one."""
    at = path.removesuffix(".npz") + suffix
    return at if os.path.exists(at) else None


def only(paths: list[str], what: str) -> str:
    if len(paths) != 1:
        raise ValueError(f"one {what} is wanted, there are {len(paths)}")
    return paths[0]


class _Plain(pickle.Unpickler):
    """Reads containers, numbers and strings; nothing that could run code."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} isn't plain data")


def plain_pickle(data: bytes):
    return _Plain(io.BytesIO(data)).load()


# ------------------------------------------------------------------- traces and shards

#: Parts of a trace: column and type; a trace that lacks one has NULL there.
TRACE = {"sample_step": "long", "states": "array<int>", "fields": "array<double>", "rates": "array<double>", "names": "array<string>"}


def trace_rows(rows: DataFrame) -> DataFrame:
    """rows with every part of a trace, typed; absent ones are NULL."""
    have = set(rows.columns)
    return rows.select("run_id", *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in TRACE.items()))


def shards(rows: DataFrame, meta: str, episode: str) -> DataFrame:
    """One row per episode of shards' JSON texts (column value): {"meta": {...}, "episodes":
    [...]}. Both are given as DDL; an episode's value wins over the shard's of that name. Texts
    that don't parse give no rows."""
    tree = F.from_json("value", f"struct<meta: struct<{meta}>, episodes: array<struct<{episode}>>>")
    own = rows.select(tree.alias("t")).where("t.episodes is not null").select(F.col("t.meta").alias("meta"), F.explode("t.episodes").alias("e"))
    name = lambda ddl: [p.strip().split(":")[0].strip() for p in ddl.split(",")]
    m, e = name(meta), name(episode)
    both = [F.coalesce(F.col(f"e.{c}"), F.col(f"meta.{c}")).alias(c) for c in e if c in m]
    return own.select(*(F.col(f"meta.{c}").alias(c) for c in m if c not in e), *both, *(F.col(f"e.{c}").alias(c) for c in e if c not in m))


# ------------------------------------------------------------------- recordings


def by_offset(events: DataFrame, populations: DataFrame, warmup: float) -> DataFrame:
    """Events(pop, local, t) of populations(pop, offset) as global units, after the warm-up."""
    own = events.join(populations.select("pop", "offset"), "pop").where(F.col("t") >= warmup)
    return own.select((F.col("offset") + F.col("local")).alias("unit"), (F.col("t") - warmup).alias("t"))


def parent_indices(events: DataFrame, parents: DataFrame) -> DataFrame:
    """events(parent, source) with idx in parents(parent, offset, size), and the convention that
    they follow: of global and local ids from one and from zero, the first into whose range all
    ids of a parent fit; events of a parent without one fail."""
    ends = events.groupBy("parent").agg(F.min("source").alias("low"), F.max("source").alias("high")).join(parents, "parent")
    shift = {"global from one": F.col("offset") + 1, "global from zero": F.col("offset"), "local from one": F.lit(1), "local from zero": F.lit(0)}
    rule: Column | None = None
    for name, by in shift.items():
        fits = (F.col("low") - by >= 0) & (F.col("high") - by < F.col("size"))
        if name.startswith("global"):
            fits = fits & (F.col("offset") > 0)
        own = F.struct(F.lit(name).alias("convention"), by.cast("long").alias("by"))
        rule = F.when(fits, own) if rule is None else rule.when(fits, own)
    wrong = F.raise_error(F.format_string("ids %d to %d fit no convention of parent %s", "low", "high", F.col("parent").cast("string")))
    told = ends.select("parent", F.coalesce(rule, wrong.cast("struct<convention:string,by:bigint>")).alias("c"))
    return events.join(told, "parent").select(*events.columns, (F.col("source") - F.col("c.by")).alias("idx"), F.col("c.convention").alias("convention"))


def relabelled(events: DataFrame, id_map: DataFrame, warmup: float) -> DataFrame:
    """events(source, t) by the unit that id_map(source, unit) gives them, after the warm-up;
    sources that it lacks go."""
    return events.join(id_map, "source").where(F.col("t") >= warmup).select("unit", (F.col("t") - warmup).alias("t"))


# ------------------------------------------------------------------- writing


def save_run(tables: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """The tables of one run (segments, states, emissions, edges, ...), replacing those that it
    has: one folder per table, partitioned by run."""
    for name, df in tables.items():
        own = df.drop("run_id") if "run_id" in df.columns else df
        own.write.mode("overwrite").parquet(f"{folder}/{name}/run_id={run_id}")


def load_run(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def weights_export(edges: DataFrame, populations: DataFrame) -> dict[str, DataFrame]:
    """Edges, and the catalogue of populations with their ranges of ids."""
    return {"edges": edges.select("post", "pre", "w"), "populations": populations.select("pop", "start_id", "end_id")}


def output_folder(base: str, settings: dict, tag: str | None = None) -> str:
    """base/connection/rj/tag of the settings that are there."""
    parts = [f"{k}={settings[k]}" for k in ("connection", "r_j") if settings.get(k) is not None]
    return "/".join([base.rstrip("/"), *parts, *([tag] if tag else [])])


def plain(value, digits: int = 6):
    """A tree for JSON: numbers rounded, NaN and infinities as null."""
    if isinstance(value, dict):
        return {str(k): plain(v, digits) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v, digits) for v in value]
    if isinstance(value, float):
        return round(value, digits) if math.isfinite(value) else None
    return value


def write_json(tree: dict, path: str, digits: int = 6) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(plain(tree, digits), f, indent=2, sort_keys=True, ensure_ascii=False)


def summary_json(frame: DataFrame) -> DataFrame:
    """Rows as JSON texts with null for what is unknown, and summary_rows() reads them back."""
    known = [F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes]
    return frame.select(*known).select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("value"))


def summary_rows(texts: DataFrame, ddl: str) -> DataFrame:
    return texts.select(F.from_json("value", ddl).alias("r")).select("r.*")


def focus_counts(given) -> list[int]:
    """Distinct counts of at least one, in order, of nested lists, numbers and texts like '1,3'."""
    if given is None:
        return []
    if isinstance(given, str):
        found = {int(float(p)) for p in given.replace(";", ",").split(",") if p.strip()}
    elif isinstance(given, (list, tuple, set)):
        found = {c for part in given for c in focus_counts(part)}
    else:
        found = {int(given)}
    return sorted(c for c in found if c >= 1)


def settled(settings: dict) -> dict:
    """Settings of a simulated run with defaults filled in; weights are always sparse rows."""
    out = {"warmup": 5000, "steps": 20000, "sample": 10, "batch": 200, "seed": 0} | {k: v for k, v in settings.items() if v is not None}
    if min(out["steps"], out["sample"], out["batch"]) < 1 or out["warmup"] < 0:
        raise ValueError("steps, sample and batch are at least 1, warmup at least 0")
    return out | {"weights": "sparse"}

"""Recording archives (NPZ) as a Spark data source, `recordings`.

The driver lists archives and reads a few bytes of each: the names, types and shapes of its
arrays. A partition is a range of an archive's rows, which a task reads by seeking to it, so
neither the driver nor a task holds an archive; filters on run_id leave whole archives out.
Tasks write archives of at most `chunk` rows of a run, as many as its rows need; the commit gives
them their names. An archive's run is its name up to '__' or its end."""

from __future__ import annotations

import re
import struct
import uuid
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from eventloom.sources.importers import RESULTS

EVENTS, RATES = "run_id string, unit long, t double", "run_id string, cluster long, bin long, x double"
CHUNK = 1_000_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


def archives(path: str) -> list[tuple[str, str]]:
    """(run, path in the file system) of a folder's archives without results, or of one archive."""
    store, at = opened(path)
    info = store.get_file_info(at)
    files = store.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    names = sorted(f.path for f in files if f.path.endswith(".npz") and not any(w in f.base_name.lower() for w in RESULTS))
    if not names:
        raise FileNotFoundError(f"no recording in {path}")
    return [(re.split("__|_trace", f.rsplit("/", 1)[-1].removesuffix(".npz"))[0], f) for f in names]


class Member:
    """An array of an archive: type, shape, and rows by range."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self.archive, self.name = archive, f"{name}.npy"
        with archive.open(self.name) as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            self.shape, fortran, self.dtype = read(f)
            self.head = f.tell()
        if fortran and len(self.shape) > 1 or self.dtype.hasobject:
            raise ValueError(f"{name} isn't an array of numbers in rows")

    def flat(self, start: int, stop: int) -> np.ndarray:
        """Entries start..stop in the order of rows. Stored members are read from there on,
        packed ones are unpacked up to it, a buffer at a time."""
        info, size = self.archive.getinfo(self.name), self.dtype.itemsize
        with self.archive.open(self.name) as f:
            if info.compress_type == zipfile.ZIP_STORED:
                raw = self.archive.fp
                raw.seek(info.header_offset + 26)
                names = sum(struct.unpack("<HH", raw.read(4)))
                raw.seek(info.header_offset + 30 + names + self.head + start * size)
                data = raw.read((stop - start) * size)
            else:
                f.seek(self.head + start * size)
                data = f.read((stop - start) * size)
        return np.frombuffer(data, self.dtype)


def layout(z: zipfile.ZipFile) -> tuple[str, dict[str, Member], int]:
    """'events' or 'rates', the arrays that hold them, and the number of rows. Events win."""
    have = {n.removesuffix(".npy") for n in z.namelist()}
    for kind, names in (("events", ("spiketimes",)), ("events", ("spike_times", "spike_ids")), ("rates", ("rates",))):
        if have.issuperset(names):
            members = {n: Member(z, n) for n in names}
            shape = next(iter(members.values())).shape
            return kind, members, shape[1] if names == ("spiketimes",) else shape[0]
    raise ValueError("neither events nor rates in the archive")


@dataclass
class Rows(InputPartition):
    run: str
    path: str
    start: int
    stop: int


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, chunk: int):
        self.path, self.kind, self.chunk, self.runs = path, kind, chunk, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("run_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.runs = wanted if self.runs is None else self.runs & wanted
            else:
                yield f

    def partitions(self):
        store, _ = opened(self.path)
        out = []
        for run, path in archives(self.path):
            if self.runs is None or run in self.runs:
                with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    n = layout(z)[2]
                out += [Rows(run, path, a, min(a + self.chunk, n)) for a in range(0, n, self.chunk)]
        return out or [Rows("", "", 0, 0)]

    def read(self, part):
        if part.stop == part.start:
            return
        store, _ = opened(self.path)
        with store.open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
            kind, members, n = layout(z)
            if kind != self.kind:
                raise ValueError(f"{part.path} holds {kind}, not {self.kind}")
            for a in range(part.start, part.stop, 65_536):
                b = min(a + 65_536, part.stop)
                if kind == "rates":
                    q = members["rates"].shape[1]
                    x = members["rates"].flat(a * q, b * q).astype(float)
                    columns = [np.tile(np.arange(q), b - a), np.repeat(np.arange(a, b), q), x]
                else:
                    if "spiketimes" in members:
                        t, unit = members["spiketimes"].flat(a, b), members["spiketimes"].flat(n + a, n + b)
                    else:
                        t, unit = members["spike_times"].flat(a, b), members["spike_ids"].flat(a, b)
                    keep = np.isfinite(t.astype(float)) & np.isfinite(unit.astype(float))
                    columns = [unit[keep].astype("int64"), t[keep].astype(float)]
                names = ["unit", "t"] if kind == "events" else ["cluster", "bin", "x"]
                yield pa.RecordBatch.from_arrays([pa.array([part.run] * len(columns[0]), pa.string()), *map(pa.array, columns)], names=["run_id", *names])


@dataclass
class Written(WriterCommitMessage):
    paths: list


class Writer(DataSourceArrowWriter):
    """Events in archives of at most `chunk` rows of a run; rows need not come by run."""

    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk

    def write(self, batches):
        store, at = opened(self.path)
        store.create_dir(at)
        held: dict[str, list] = {}
        done: list[str] = []

        def put(run):
            t, unit = (np.concatenate(x) for x in zip(*held.pop(run)))
            name = f"{at}/{run}__{uuid.uuid4().hex}"
            with store.open_output_stream(f"{name}.part") as f:
                np.savez(f, spike_times=t, spike_ids=unit)
            done.append(name)

        for batch in batches:
            runs = batch.column("run_id").dictionary_encode()
            for k, run in enumerate(runs.dictionary.to_pylist()):
                own = batch.filter(pa.array(np.asarray(runs.indices) == k))
                held.setdefault(run, []).append((own.column("t").to_numpy(), own.column("unit").to_numpy()))
                if sum(len(t) for t, _ in held[run]) >= self.chunk:
                    put(run)
            if sum(len(t) for own in held.values() for t, _ in own) >= 4 * self.chunk:  # many runs at once
                for run in list(held):
                    put(run)
        for run in list(held):
            put(run)
        return Written(done)

    def commit(self, messages):
        store, _ = opened(self.path)
        for m in messages:
            for name in m.paths if m else ():
                store.move(f"{name}.part", f"{name}.npz")

    def abort(self, messages):
        store, _ = opened(self.path)
        for m in messages:
            for name in m.paths if m else ():
                store.delete_file(f"{name}.part")


class Recordings(DataSource):
    """Options: path; chunk, rows of a partition or written archive."""

    @classmethod
    def name(cls):
        return "recordings"

    def _sniffed(self) -> str:
        store, _ = opened(self.options["path"])
        with store.open_input_file(archives(self.options["path"])[0][1]) as f, zipfile.ZipFile(f) as z:
            return layout(z)[0]

    def schema(self):
        return EVENTS if self._sniffed() == "events" else RATES

    def reader(self, schema):
        return Reader(self.options["path"], "events" if "unit" in schema.fieldNames() else "rates", int(self.options.get("chunk", CHUNK)))

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], int(self.options.get("chunk", CHUNK)))


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source known and its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)
    return spark


def read_recordings(spark: SparkSession, path: str, chunk: int = CHUNK):
    return registered(spark).read.format("recordings").option("chunk", chunk).load(path)


def write_recordings(events, path: str, chunk: int = CHUNK) -> None:
    """events(run_id, unit, t) as archives in a folder that all machines see."""
    registered(events.sparkSession)
    events.select("run_id", "unit", "t").write.format("recordings").option("chunk", chunk).mode("append").save(path)

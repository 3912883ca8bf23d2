"""A sink that counts what it writes: the data source ``committed``.

    df.write.format("committed").mode("append").option("path", out).option("run", run).save()
    spark.read.format("committed").option("path", out).load()

Each task writes one Parquet file as a stream and reports its name, rows, bytes, SHA-256
and how many rows had which ``status``; the commit writes these reports as the run's
manifest, in one step.  Only files of manifests are read, so what a task that was killed
or a run that was broken off has left is never seen; ``vacuum`` removes it.  A run that is
written again takes the place of what it was.  Counters come from manifests, without a
scan; ``verify`` compares the files with them.  ``fold`` puts the manifests of many runs
into one.

Manifests name files, a line for each task of each run.  Files are written and read by
Python: at paths that executors can open, or in a store that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

MANIFEST = "run string, file string, rows long, bytes long, sha256 string, statuses map<string, long>, schema string"


def store_of(path: str):
    """The store of a path, and the path within it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path)


class _Hashed(io.RawIOBase):
    """A stream that passes bytes on and keeps their number and hash."""

    def __init__(self, out):
        self.out, self.size, self.sha = out, 0, hashlib.sha256()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(memoryview(data))
        return len(memoryview(data))


@dataclass
class Written(WriterCommitMessage):
    """What a task has written; ``file`` is None if it had no rows."""

    file: str | None
    rows: int = 0
    bytes: int = 0
    sha256: str | None = None
    statuses: dict | None = None


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str, schema: StructType, overwrite: bool, sequential: bool = False):
        self.path, self.run, self.schema, self.overwrite, self.sequential = path.rstrip("/"), run, schema, overwrite, sequential

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        store, root = store_of(self.path)
        store.create_dir(f"{root}/data", recursive=True)
        name = f"{self.run}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        part, out, statuses, n = f"{root}/data/.{name}.part", None, Counter(), 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    raw = store.open_output_stream(part)
                    hashed = _Hashed(raw)
                    out = pq.ParquetWriter(pa.PythonFile(hashed, "w"), batch.schema)
                out.write_batch(batch)
                n += batch.num_rows
                if "status" in batch.schema.names:
                    statuses.update(str(s) for s in batch.column("status").to_pylist())
            if out is None:
                return Written(None)
            out.close()
            raw.close()
            store.move(part, f"{root}/data/{name}")
        except BaseException:
            if out is not None:
                raw.close()
                store.delete_file(part)
            raise
        return Written(name, n, hashed.size, hashed.sha.hexdigest(), dict(statuses))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        store.create_dir(f"{root}/manifest", recursive=True)
        before = _manifests(store, root)
        told = [asdict(m) for m in messages if m is not None and m.file] or [asdict(Written(None))]
        if self.sequential:
            free = (i for i in count(1) if f"data_{i}.parquet" not in taken)
            taken = set(_listed(store, f"{root}/data"))
            for t in told:
                if t["file"]:
                    name = f"data_{next(free)}.parquet"
                    store.move(f"{root}/data/{t['file']}", f"{root}/data/{name}")
                    t["file"] = name
        lines = [json.dumps({"run": self.run, **t, "schema": self.schema.json()}) for t in told]
        _replace(store, f"{root}/manifest/{self.run}.json", "\n".join(lines) + "\n")
        new = {t["file"] for t in told}
        gone = {run: files for run, files in before.items() if run == self.run or self.overwrite}
        for run, files in gone.items():
            if run != self.run:
                _forget(store, root, run, before)
            for f in files:
                if f["file"] and f["file"] not in new:
                    _remove(store, f"{root}/data/{f['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        for m in messages:
            if m is not None and m.file:
                _remove(store, f"{root}/data/{m.file}")


def _replace(store, path: str, text: str) -> None:
    """Write a file in one step."""
    part = path.rpartition("/")[0] + f"/.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(text.encode())
    store.move(part, path)


def _remove(store, path: str) -> None:
    from pyarrow import fs

    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)


def _listed(store, folder: str) -> list[str]:
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith("."))


def _read(store, path: str) -> list[dict]:
    with store.open_input_stream(path) as f:
        return [json.loads(line) for line in f.read().decode().splitlines() if line]


def _manifests(store, root: str) -> dict[str, list[dict]]:
    """The files of each run."""
    out: dict[str, list[dict]] = {}
    for name in _listed(store, f"{root}/manifest"):
        for f in _read(store, f"{root}/manifest/{name}"):
            # A run of its own takes the place of what an older, folded manifest says of it.
            out.setdefault(f["run"], []).append(f | {"_own": name == f"{f['run']}.json"})
    return {run: [f for f in files if f["_own"] or not any(g["_own"] for g in files)] for run, files in out.items()}


def _forget(store, root: str, run: str, known: dict[str, list[dict]]) -> None:
    """Take a run out of the manifests."""
    if any(f["_own"] for f in known[run]):
        _remove(store, f"{root}/manifest/{run}.json")
    for name in _listed(store, f"{root}/manifest"):
        lines = _read(store, f"{root}/manifest/{name}")
        if any(f["run"] == run for f in lines):
            _replace(store, f"{root}/manifest/{name}", "".join(json.dumps(f) + "\n" for f in lines if f["run"] != run))


class _Part(InputPartition):
    def __init__(self, file: str):
        self.file = file


class CommittedReader(DataSourceReader):
    """The committed files, a partition each."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path.rstrip("/"), schema

    def partitions(self) -> list[InputPartition]:
        store, root = store_of(self.path)
        return [_Part(f["file"]) for files in _manifests(store, root).values() for f in files if f["file"]]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        store, root = store_of(self.path)
        kinds = to_arrow_schema(self.schema)
        with store.open_input_file(f"{root}/data/{partition.file}") as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=256):
                # A run may lack columns that others have.
                has = set(batch.schema.names)
                columns = [batch.column(k.name) if k.name in has else pa.nulls(batch.num_rows, k.type) for k in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=kinds.names)


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self) -> StructType:
        store, root = store_of(self.options["path"].rstrip("/"))
        told = {f["schema"] for files in _manifests(store, root).values() for f in files}
        if not told:
            raise ValueError(f"no run has ended in {self.options['path']}")
        fields: dict[str, StructField] = {}
        for schema in sorted(told):
            for f in StructType.fromJson(json.loads(schema)):
                if fields.setdefault(f.name, f).dataType != f.dataType:
                    raise ValueError(f"runs differ in the type of {f.name}")
        return StructType([StructField(f.name, f.dataType) for f in fields.values()])

    def reader(self, schema: StructType) -> CommittedReader:
        return CommittedReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        run = self.options.get("run") or uuid.uuid4().hex
        if "/" in run or run.startswith("."):
            raise ValueError(f"not a name for a run: {run}")
        return CommittedWriter(self.options["path"], run, schema, overwrite, self.options.get("names", "unique") == "sequential")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Committed)


def write(rows: DataFrame, out: str, run: str, overwrite: bool = False, names: str = "unique") -> None:
    """Write a run; by ``names`` "sequential" its files get the first free of data_1, data_2 and so on."""
    register(rows.sparkSession)
    rows.write.format("committed").mode("overwrite" if overwrite else "append").option("path", out).option("run", run).option("names", names).save()


def read(spark: SparkSession, out: str) -> DataFrame:
    register(spark)
    return spark.read.format("committed").option("path", out).load()


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """What has been committed, a row for each file: run, file, rows, bytes, sha256, statuses."""
    store, root = store_of(out.rstrip("/"))
    files = [{k: v for k, v in f.items() if k != "_own"} for fs in _manifests(store, root).values() for f in fs]
    return spark.createDataFrame(files, MANIFEST).drop("schema")


def counters(spark: SparkSession, out: str) -> DataFrame:
    """One row of runs, files, bytes, windows and dropped, from the manifests alone."""
    m = manifest(spark, out)
    ok = F.coalesce(F.try_element_at("statuses", F.lit("ok")), F.lit(0))
    return m.agg(F.countDistinct("run").alias("runs"), F.count("file").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(ok), F.lit(0)).alias("windows"), F.coalesce(F.sum(F.col("rows") - ok), F.lit(0)).alias("dropped"))


def verify(spark: SparkSession, out: str) -> DataFrame:
    """The files that aren't as their manifest says: run, file and what is wrong."""
    root = out.rstrip("/")

    def check(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                store, at = store_of(root)
                try:
                    sha, size = hashlib.sha256(), 0
                    with store.open_input_stream(f"{at}/data/{r['file']}") as f:
                        while data := f.read(8 << 20):
                            sha.update(data)
                            size += len(data)
                    if size != r["bytes"]:
                        rows.append((r["run"], r["file"], f"{size} bytes instead of {r['bytes']}"))
                    elif sha.hexdigest() != r["sha256"]:
                        rows.append((r["run"], r["file"], "another checksum"))
                except FileNotFoundError:
                    rows.append((r["run"], r["file"], "missing"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["run", "file", "fault"])

    files = manifest(spark, out).where("file is not null").select("run", "file", "bytes", "sha256")
    return files.repartition("file").mapInArrow(check, "run string, file string, fault string")


def fold(out: str) -> None:
    """Put the manifests of all runs into one; what they say stays the same."""
    store, root = store_of(out.rstrip("/"))
    old = _listed(store, f"{root}/manifest")
    files = [{k: v for k, v in f.items() if k != "_own"} for fs in _manifests(store, root).values() for f in fs]
    if files:
        _replace(store, f"{root}/manifest/folded-{uuid.uuid4().hex}.json", "".join(json.dumps(f) + "\n" for f in files))
        for name in old:
            _remove(store, f"{root}/manifest/{name}")


def vacuum(out: str) -> list[str]:
    """Remove files that no manifest names; not to be called while a run writes."""
    from pyarrow import fs

    store, root = store_of(out.rstrip("/"))
    known = {f["file"] for files in _manifests(store, root).values() for f in files}
    left = [f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if f.type == fs.FileType.File and f.base_name not in known]
    for name in left:
        store.delete_file(f"{root}/data/{name}")
    return left

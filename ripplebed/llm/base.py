"""What the operators share: staging tables, numbering, and worker helpers."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplebed.operators.tables import file_system, new_path, remove, shared_dir, write_table

__all__ = ["file_system", "new_path", "remove", "shared_dir", "write_table"]
T = TypeVar("T")
#: Bytes of an Arrow batch from the JVM to a Python worker.
ARROW_BYTES = 8 << 20
#: Bytes of text after which a worker gives back what it freed.
TRIM_BYTES = 4 << 20
#: The lists of paths that are kept at the moment, in this thread.
_COLLECTED: ContextVar[tuple[list[str], ...]] = ContextVar("collected", default=())


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that are staged inside."""
    paths: list[str] = []
    before = _COLLECTED.set((*_COLLECTED.get(), paths))
    try:
        yield paths
    finally:
        _COLLECTED.reset(before)


def staged(df: DataFrame, name: str, rows: int | None = None, width: int = 16) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: later jobs read files that outlive any executor
    instead of computing ``df`` again.  Where at most ``rows`` rows of ``width``
    bytes come, they go into as few files as they need.
    """
    path = new_path(df.sparkSession, name)
    for paths in _COLLECTED.get():
        paths.append(path)
    return write_table(df, path, rows, width)


def reads(df: DataFrame, paths: list[str]) -> list[str]:
    """Those of the tables that ``df`` reads files from."""
    # Each table has a folder of its own name.
    folders = {f.split("/")[-2] for f in df.inputFiles()}
    return [p for p in paths if p.rpartition("/")[2] in folders]


def numbered_rows(docs: DataFrame, name: str) -> DataFrame:
    """``row``, a number of its own for each row, and all columns as ``doc``; written, so that the numbers stay."""
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), name)


def bounded_batches(docs: DataFrame) -> DataFrame:
    """The same rows, in a session whose Arrow batches to Python are bounded by ``ARROW_BYTES`` as well as by rows: texts may be long."""
    conf = docs.sparkSession.conf
    most = conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if most is None or not 0 < _bytes(most) <= ARROW_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return docs


def _bytes(size: str) -> int:
    """A number of bytes as Spark writes it."""
    digits = size.lower().rstrip("bkmgi")
    return int(digits) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[size.lower().removeprefix(digits)[:1]]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just ``doc_id`` (long) and ``text`` (null as empty); other columns can't clash."""
    return bounded_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written in decimal."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def with_offsets(df: DataFrame, group: list[str], bucket: str, weight: str, out: str) -> DataFrame:
    """For each (group, bucket) row, the sum of ``weight`` in the group's earlier buckets.

    ``df`` has one row per group and bucket, so it stays small; no row data
    passes through this window.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(weight).over(w), F.lit(0).cast("long")))


# --- on the workers --------------------------------------------------------


def worker_state(name: str, make: Callable[[], T]) -> T:
    """A value kept in a Python worker across its tasks.

    A worker holds one: a task that asks for another gets room for it first, so
    that what the operators remember does not add up over a session.
    """
    home = sys.modules.setdefault("_ripplebed_worker", types.ModuleType("_ripplebed_worker"))
    if getattr(home, "name", None) != name:
        home.value, home.name = None, None
        return_memory()
        home.value, home.name = make(), name
        return_memory()
    return home.value


def return_memory(collect: bool = True) -> None:
    """Give what was freed back to the system, where its C library can."""
    import ctypes

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class Remembered:
    """Values by key, within a bound in bytes: when the younger half is full it becomes the older one, which is forgotten."""

    #: Bytes of an entry beside the key's and the value's own.
    ENTRY = 200

    def __init__(self, most_bytes: int):
        self.half, self.size = most_bytes // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def get(self, keys: list) -> list:
        """The values of keys, None where there is none."""
        out = list(map(self.young.get, keys))
        if None in out:
            found = [(i, x) for i, had in enumerate(out) if had is None and (x := self.old.get(keys[i])) is not None]
            for i, x in found:
                out[i] = x
            self.add([(keys[i], x) for i, x in found])
        return out

    def add(self, entries: list[tuple]) -> None:
        for key, value in entries:
            if self.size > self.half:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[key] = value
            self.size += len(key) + len(value) + self.ENTRY


def broadcast(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives the value on the workers, which need no copy of this package."""
    from pyspark import cloudpickle

    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> object:
        import pickle

        return pickle.loads(held.value)

    return get


def text_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column as bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def text_of(batch: pa.RecordBatch, column: int) -> pa.Array:
    """A column, or its field ``text`` if it holds whole rows; nulls are empty."""
    import pyarrow.compute as pc

    texts = batch.column(column)
    if pa.types.is_struct(texts.type):
        texts = pc.struct_field(texts, "text")
        if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
            texts = texts.cast(pa.string())
    return pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")


def small_batches(batches: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20, column: int = 1, trim_bytes: int = TRIM_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts in each come to about ``most_bytes``; a longer text stands alone.

    What a batch took beside its results goes back to the system after ``trim_bytes`` of text.
    """
    done = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        import pyarrow.compute as pc

        ends = np.cumsum(pc.binary_length(text_of(batch, column)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            if ends[-1] - before <= most_bytes + most_bytes // 4:  # no small rest
                to = batch.num_rows
            yield batch.slice(at, to - at)
            done += int(ends[to - 1] - before)
            if done >= trim_bytes:
                return_memory(collect=False)
                done = 0
            at = to

"""Long EDF recordings as chunks: ranges of data records, each read on its own.

Files are listed by Spark, their heads are read in tasks, and a plan of (path, chunk,
first record, records) comes from the heads by column expressions.  A task then reads
the byte ranges of its chunks and nothing else, so neither a file nor a row has to
hold a whole recording.  Ranges are read by Python: from paths that executors can open,
or from a store that pyarrow knows by the path's scheme.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplebed.operators.chunks import CHUNK, chunk_batch
from ripplebed.operators.layout import stem
from ripplebed.sources.edf import SIGNAL, _listing, channels_of, parse_header, parsed

HEAD = "path string, sfreq double, n_times long, ch_names array<string>, duration double, records long, record_s double, per_record long, status string, error string"
#: Bytes of recordings that a task reads.
TASK_BYTES = 256 << 20
NOTES = ("onset", "duration", "description")


def opened(path: str):
    """A file to read from: a path of this machine, with or without ``file:``, or one of a store."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return open(path, "rb")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def read_head(file) -> dict:
    """The head of a recording, and the bytes of a record as ``size``."""
    raw = file.read(256)
    if len(raw) == 256 and raw[252:256].strip().isdigit():
        raw += file.read(256 * int(raw[252:256]))
    head = parse_header(raw)
    return head | {"size": 2 * sum(head["samples"])}


def heads(files: DataFrame) -> DataFrame:
    """One row for each of ``files`` (path, length): what its head says; of the file only that is read."""
    names = [f.split()[0] for f in HEAD.split(", ")]

    def one(path: str, length: int) -> tuple:
        try:
            with opened(path) as f:
                h = read_head(f)
            from ripplebed.sources.edf import ANNOTATIONS

            channels = [i for i, x in enumerate(h["label"]) if x != ANNOTATIONS]
            per = max((h["samples"][i] for i in channels), default=0)
            records = h["records"] if h["records"] >= 0 else (length - h["bytes"]) // h["size"]
            if length < h["bytes"] + records * h["size"]:
                raise ValueError("the data are cut off")
            rate = per / h["record_s"] if h["record_s"] else float("nan")
            return path, rate, per * records, [h["label"][i] for i in channels], records * h["record_s"], records, h["record_s"], per, "ok", None
        except Exception as e:  # noqa: BLE001  one bad file must not end the others
            return (path, *[None] * 7, "error", f"{type(e).__name__}: {e}")

    def run(batches):
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            if batch.num_rows:
                rows = list(map(one, batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "length").mapInArrow(run, HEAD)


def ranges(found: DataFrame, chunk_s: float) -> DataFrame:
    """The chunks of recordings of at least ``chunk_s`` seconds, but for the last: chunk, first_record and n_records; a recording without records, or in error, keeps a row."""
    per = F.greatest(F.lit(1), F.ceil(F.lit(chunk_s) / F.col("record_s"))).cast("long")
    many = F.when((F.col("status") == "ok") & (F.col("records") > 0), F.sequence(F.lit(0).cast("long"), F.floor((F.col("records") - 1) / per).cast("long")))
    out = found.withColumn("per", per).select("*", F.explode_outer(many).alias("chunk"))
    first = F.col("chunk") * F.col("per")
    return out.select(
        *found.columns, "chunk", first.alias("first_record"), F.least(F.col("per"), F.col("records") - first).alias("n_records"), (F.col("per") * F.col("per_record")).alias("length")
    )


def read_ranges(planned: DataFrame) -> DataFrame:
    """The chunks of a plan by ``ranges``, as rows of ``CHUNK``."""
    told = planned.agg(F.sum(F.col("n_records") * F.col("per_record") * F.size("ch_names") * 2)).first()[0] or 0
    tasks = max(1, -(-int(told) // TASK_BYTES))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                meta = {"path": r["path"], "chunk": r["chunk"], "n_times": r["n_times"], "sfreq": r["sfreq"], "ch_names": r["ch_names"], "length": r["length"]}
                if r["chunk"] is None:
                    yield chunk_batch(meta | {"status": r["status"] if r["status"] != "ok" else "empty", "error": r["error"]}, None)
                    continue
                try:
                    with opened(r["path"]) as f:
                        h = read_head(f)
                        f.seek(h["bytes"] + r["first_record"] * h["size"])
                        raw = f.read(r["n_records"] * h["size"])
                    if len(raw) < r["n_records"] * h["size"]:
                        raise ValueError("the data are cut off")
                    data, notes = channels_of(h, np.frombuffer(raw, "<i2").reshape(r["n_records"], -1))
                    notes = [dict(zip(NOTES, n, strict=True)) for n in notes]
                    yield chunk_batch(meta | {"start_sample": r["first_record"] * r["per_record"], "annotations": notes, "status": "ok", "error": None}, np.array(data))
                except Exception as e:  # noqa: BLE001
                    yield chunk_batch(meta | {"status": "error", "error": f"{type(e).__name__}: {e}"}, None)

    # Rows of the plan are short and what they read is long, so tasks are dealt by number.
    return planned.repartition(tasks, "path", "chunk").mapInArrow(run, CHUNK)


def read_chunks(spark: SparkSession, source: str | list[str], chunk_s: float = 60.0) -> DataFrame:
    """The recordings below a folder, or of a list of paths, in chunks of about ``chunk_s`` seconds."""
    files = _listing(spark, source, not isinstance(source, list)).select("path", "length")
    return read_ranges(ranges(heads(files), chunk_s))


def read_paths(paths: DataFrame) -> DataFrame:
    """One row for each of ``paths`` (path), as ``read_listed`` gives it, but that tasks open the files: no name passes the driver, and nothing is listed."""

    def one(path: str | None) -> dict:
        raw, why = b"", "blank path"
        try:
            if path:
                with opened(path) as f:
                    raw, why = f.read(), None
        except FileNotFoundError:
            why = "no such file"
        except Exception as e:  # noqa: BLE001  one bad file must not end the others
            why = f"{type(e).__name__}: {e}"
        row = parsed(path, raw)
        return row | {"error": why} if why else row

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path in pdf["path"]:
                yield pd.DataFrame([one(path)])

    return paths.select("path").distinct().mapInPandas(run, SIGNAL).withColumn("stem", stem(F.col("path")))

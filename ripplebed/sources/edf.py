"""EDF and EDF+ recordings: parsing, writing, and reading as DataFrames.

``read_recordings`` lets Spark's own binary reader fetch the files, from any store
it knows, so a task parses one file at a time.  The Python data source ``edf`` does
the same for paths that executors can open; with mode "header" it reads only the
head of each file.  A file that can't be parsed gives a row with status "error".
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import StructType

from ripplebed.operators.layout import stem
from ripplebed.operators.tables import file_system

HEADER = "path string, sfreq double, n_times long, ch_names array<string>, ch_types array<string>, duration double, status string, error string"
SIGNAL = HEADER + ", data array<array<double>>, annotations array<struct<onset: double, duration: double, description: string>>"
#: The fields of a signal's header and their widths.
FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("reserved", 32))
UNITS = {"uv": 1e-6, "µv": 1e-6, "mv": 1e-3, "v": 1.0, "nv": 1e-9}
ANNOTATIONS = "EDF Annotations"


def parse_header(raw: bytes) -> dict:
    if len(raw) < 256:
        raise ValueError("the header is cut off")
    text = lambda a, n: raw[a : a + n].decode("latin-1").strip()
    head = {"bytes": int(text(184, 8)), "records": int(text(236, 8)), "record_s": float(text(244, 8)), "signals": int(text(252, 4))}
    n, at = head["signals"], 256
    if n < 1 or head["bytes"] != 256 * (n + 1):
        raise ValueError("not the head of a recording")
    if len(raw) < 256 * (n + 1):
        raise ValueError("the signals' header is cut off")
    for name, width in FIELDS:
        head[name] = [text(at + i * width, width) for i in range(n)]
        at += n * width
    head["samples"] = [int(x) for x in head["samples"]]
    return head


def _annotations(raw: bytes) -> list[tuple[float, float, str]]:
    out = []
    for tal in raw.split(b"\x00"):
        parts = tal.split(b"\x14")
        if len(parts) < 2 or not parts[0][:1] in (b"+", b"-"):
            continue
        onset, _, length = parts[0].partition(b"\x15")
        out += [(float(onset), float(length or 0), p.decode("utf-8", "replace")) for p in parts[1:] if p]
    return out


def parse(path: str, raw: bytes, signals: bool = True) -> dict:
    """A recording's row; channels that are sampled slower than the fastest are brought to its rate by repetition."""
    h = parse_header(raw)
    channels = [i for i, x in enumerate(h["label"]) if x != ANNOTATIONS]
    per = max((h["samples"][i] for i in channels), default=0)
    size = 2 * sum(h["samples"])
    records = h["records"] if h["records"] >= 0 else (len(raw) - h["bytes"]) // size
    row = {
        "path": path, "sfreq": per / h["record_s"] if h["record_s"] else math.nan, "n_times": per * records, "ch_names": [h["label"][i] for i in channels],
        "ch_types": ["eeg"] * len(channels), "duration": records * h["record_s"], "status": "ok", "error": None,
    }
    if not signals:
        return row
    if len(raw) < h["bytes"] + records * size:
        raise ValueError("the data are cut off")
    data, notes = channels_of(h, np.frombuffer(raw, "<i2", records * size // 2, h["bytes"]).reshape(records, -1))
    return row | {"data": data, "annotations": notes}


def channels_of(h: dict, block: np.ndarray) -> tuple[list[np.ndarray], list[tuple[float, float, str]]]:
    """The channels in volts and the annotations of some data records."""
    starts = np.cumsum([0, *h["samples"]])
    per = max((n for n, x in zip(h["samples"], h["label"], strict=True) if x != ANNOTATIONS), default=0)
    data, notes = [], []
    for i, label in enumerate(h["label"]):
        part = block[:, starts[i] : starts[i + 1]]
        if label == ANNOTATIONS:
            notes += _annotations(part.tobytes())
            continue
        lo, hi, a, b = (float(h[k][i]) for k in ("dmin", "dmax", "pmin", "pmax"))
        x = ((part.reshape(-1) - lo) * ((b - a) / (hi - lo)) + a) * UNITS.get(h["unit"][i].lower(), 1.0)
        data.append(np.repeat(x, per // h["samples"][i]) if h["samples"][i] != per else x)
    return data, notes


def parsed(path: str, raw: bytes, signals: bool = True) -> dict:
    try:
        return parse(path, raw, signals)
    except Exception as e:  # noqa: BLE001  one bad file must not end the others
        empty = {"path": path, "sfreq": None, "n_times": None, "ch_names": None, "ch_types": None, "duration": None, "status": "error", "error": f"{type(e).__name__}: {e}"}
        return empty | ({"data": None, "annotations": None} if signals else {})


def write(path: str, data: np.ndarray, names: list[str], sfreq: int, annotations: list[tuple[float, float, str]] = (), repeat: int = 1) -> None:
    """An EDF+ file with records of one second; ``data`` in volts, written ``repeat`` times one behind the other."""
    records = data.shape[1] // sfreq
    notes = b"".join(b"+%g\x15%g\x14%s\x14\x00" % (o, d, t.encode()) for o, d, t in annotations)
    room = -(-max(16, len(notes) + 16) // 2)
    n = len(names) + 1
    peak = max(1.0, float(np.abs(data).max()) * 1e6)
    signal = {"label": [*names, ANNOTATIONS], "transducer": [""] * n, "unit": ["uV"] * (n - 1) + [""], "pmin": [f"{-peak:.6g}"[:8]] * (n - 1) + ["-1"], "pmax": [f"{peak:.6g}"[:8]] * (n - 1) + ["1"],
              "dmin": ["-32768"] * n, "dmax": ["32767"] * n, "filter": [""] * n, "samples": [str(sfreq)] * (n - 1) + [str(room)], "reserved": [""] * n}
    head = b"0".ljust(8) + b"X".ljust(80) * 2 + b"01.01.0100.00.00" + str(256 * (n + 1)).encode().ljust(8) + b"EDF+C".ljust(44) + str(records * repeat).encode().ljust(8) + b"1".ljust(8) + str(n).encode().ljust(4)
    for name, width in FIELDS:
        head += b"".join(x.encode("latin-1")[:width].ljust(width) for x in signal[name])
    lo, hi = float(signal["pmin"][0]), float(signal["pmax"][0])
    digital = np.clip(np.round((data * 1e6 - lo) / (hi - lo) * 65535 - 32768), -32768, 32767).astype("<i2")
    with open(path, "wb") as f:
        f.write(head)
        for k in range(records * repeat):
            r = k % records
            f.write(digital[:, r * sfreq : (r + 1) * sfreq].tobytes())
            f.write((b"+%d\x14\x14\x00" % k + (notes if k == 0 else b"")).ljust(2 * room, b"\x00"))


def list_files(spark: SparkSession, source: str) -> DataFrame:
    """path and stem of the .edf files below a folder, or of the paths in a .txt list, whatever their ending.

    Listed paths are written as Spark's readers write them.  A blank line is a path
    too: like that of a file which isn't there it gives an error row when read.
    """
    fs, at = file_system(spark, source)
    there = fs.exists(at)
    if there and fs.getFileStatus(at).isDirectory():
        paths = _listing(spark, [source], True).select("path")
    elif there and source.endswith(".txt"):
        lines = spark.read.text(source).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
        split = lines.select("line", F.regexp_extract("line", "^(.*/)?[^/]*$", 1).alias("folder"), F.regexp_extract("line", "([^/]*)$", 1).alias("name"))
        folders = [(r["folder"], _qualified(spark, r["folder"] or ".")) for r in split.select("folder").distinct().collect()]  # one for each folder
        known = spark.createDataFrame(folders, "folder string, at string")
        paths = split.join(F.broadcast(known), "folder").select(F.when(F.col("line") == "", "").otherwise(F.concat("at", F.lit("/"), "name")).alias("path"))
    else:
        raise ValueError(f"neither a folder nor a .txt list: {source}")
    return paths.withColumn("stem", stem(F.col("path")))


def _listing(spark: SparkSession, folders: list[str], below: bool) -> DataFrame:
    files = spark.read.format("binaryFile")
    return (files.option("recursiveFileLookup", True).option("pathGlobFilter", "*.edf") if below else files).load(folders)


def _qualified(spark: SparkSession, folder: str) -> str:
    return file_system(spark, folder)[1].toString().rstrip("/")


def read_listed(spark: SparkSession, paths: DataFrame, signals: bool = True) -> DataFrame:
    """One row for each of ``paths`` (as ``list_files`` gives them); what isn't there gives a row with status "error".

    The contents of these files alone are fetched.  Spark's reader takes the names
    of the files it shall read as a list, and keeps such a list on the driver for
    any folder too: names, not contents.
    """
    folders = [r["f"] for r in paths.where("path <> ''").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("f")).distinct().collect()]
    folders = [f for f in folders if (found := file_system(spark, f))[0].exists(found[1])]
    schema = SIGNAL if signals else HEADER
    there = spark.createDataFrame([], "path string")
    if folders:
        there = _listing(spark, folders, False).select("path")
    names = [r["path"] for r in paths.select("path").distinct().join(there, "path", "left_semi").toLocalIterator()]
    absent = paths.select("path").distinct().join(there, "path", "left_anti")
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    told = {"path": F.col("path"), "status": F.lit("error"), "error": F.when(F.col("path") == "", "blank path").otherwise("no such file")}
    absent = absent.select(*[told[c].alias(c) if (c := f.name) in told else n for f, n in zip(StructType.fromDDL(schema), nulls, strict=True)]).withColumn("stem", stem(F.col("path")))
    return parse_files(spark.read.format("binaryFile").load(names), signals).unionByName(absent) if names else absent


def parse_files(files: DataFrame, signals: bool = True) -> DataFrame:
    """One row for each row of path and content."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([parsed(path, raw, signals)])

    return files.select("path", "content").mapInPandas(run, SIGNAL if signals else HEADER).withColumn("stem", stem(F.col("path")))


def read_recordings(spark: SparkSession, source: str | list[str], signals: bool = True) -> DataFrame:
    """One row for each .edf file below a folder or of a list of paths."""
    return parse_files(_listing(spark, source, True), signals)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


#: How a filter of each kind judges a value that isn't null.
JUDGED = {
    EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v, IsNotNull: lambda v, _: True,
}
#: Columns that the path or the head of a file tells.
HEADED = ("path", "sfreq", "n_times", "duration", "status")


class EdfReader(DataSourceReader):
    """A partition for each file; filters that it was given are judged before the samples are read."""

    def __init__(self, paths: list[str], signals: bool):
        self.paths, self.signals, self.filters = paths, signals, []

    def _fits(self, row: dict, columns: tuple[str, ...]) -> bool:
        asked = [f for f in self.filters if f.attribute[0] in columns]
        return all((v := row[f.attribute[0]]) is not None and JUDGED[type(f)](v, getattr(f, "value", None)) for f in asked)

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths if self._fits({"path": p}, ("path",))]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            raw = f.read(256)
            if len(raw) == 256 and raw[252:256].strip().isdigit():
                raw += f.read(256 * int(raw[252:256]))
            head = parsed(partition.path, raw, signals=False)
            # The number of records may be told by the file's length alone, and data that are cut off by the data.
            sure = head["status"] == "ok" and raw[236:244].strip() != b"-1"
            if self.filters and sure and not self._fits(head, tuple(c for c in HEADED if c != "status")):
                return
            if self.signals or not sure:
                raw += f.read()
        row = parsed(partition.path, raw, self.signals)
        if not self._fits(row, HEADED):
            return
        if self.signals and row["data"] is not None:
            row["data"] = [x.tolist() for x in row["data"]]
        yield tuple(row.values())


class FilteringEdfReader(EdfReader):
    """Filters on the path leave out files, those on what a head tells are judged on the head alone; all others go back to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in JUDGED and len(f.attribute) == 1 and f.attribute[0] in HEADED:
                self.filters.append(f)
            else:
                yield f


class EdfDataSource(DataSource):
    """spark.read.format("edf").option("mode", "header" or "signal").load(folder or file)

    With option "pushdown" "true" it takes filters, for which Spark asks that
    spark.sql.python.filterPushdown.enabled is on.
    """

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return HEADER if self.options.get("mode", "signal") == "header" else SIGNAL

    def reader(self, schema) -> EdfReader:
        import glob
        import os

        path = self.options["path"]
        paths = sorted(glob.glob(os.path.join(path, "**", "*.edf"), recursive=True)) if os.path.isdir(path) else [path]
        kind = FilteringEdfReader if self.options.get("pushdown", "false").lower() == "true" else EdfReader
        return kind(paths, self.options.get("mode", "signal") == "signal")

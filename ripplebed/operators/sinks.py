"""Writing windows with their lineage, compaction, and random access.

A dataset folder holds ``windows`` and ``manifest`` (the files that were attempted),
each with a folder for every run.  A run counts once its manifest is there: what one
that broke off has left is never read, and a run that is written again replaces what
it wrote.  Rows without data tell of files and windows that were dropped, so the log
is a view of the same table.  A compacted dataset holds ``data`` in their place; its
manifest stays, so later runs still skip what is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ripplebed.operators import layout as L
from ripplebed.operators.tables import file_system, remove


def _there(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def _runs(spark: SparkSession, folder: str) -> list[str]:
    """The runs that have ended in a folder of runs."""
    fs, at = file_system(spark, folder)
    found = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(p.getName().removeprefix("run=") for p in found if fs.exists(file_system(spark, f"{p}/_SUCCESS")[1]))


def append(windows: DataFrame, attempted: DataFrame, out: str, run: str, mode: str = "append") -> None:
    """Write a run's windows, dropped ones too, then its files (path, stem); by "overwrite" it takes the place of all others."""
    spark = windows.sparkSession
    others = [r for r in _runs(spark, f"{out}/manifest") if r != run]
    windows.write.mode("overwrite").parquet(f"{out}/windows/run={run}")
    attempted.select("path", "stem").distinct().write.mode("overwrite").parquet(f"{out}/manifest/run={run}")
    if mode == "overwrite":
        for old in others:
            remove(spark, f"{out}/manifest/run={old}")
            remove(spark, f"{out}/windows/run={old}")
        remove(spark, f"{out}/data")


def all_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all runs that have ended, and of compacted data."""
    runs = [r for r in _runs(spark, f"{out}/manifest") if _there(spark, f"{out}/windows/run={r}")]
    parts = [spark.read.option("mergeSchema", True).parquet(*(f"{out}/windows/run={r}" for r in runs))] if runs else []
    if _there(spark, f"{out}/data"):
        parts.append(spark.read.parquet(f"{out}/data"))
    if not parts:
        raise ValueError(f"no run has ended in {out}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def windows(spark: SparkSession, out: str) -> DataFrame:
    return all_rows(spark, out).where("status = 'ok'")


def log(spark: SparkSession, out: str) -> DataFrame:
    """One line for each window, and for each file from which none came: what was done, or why it was dropped."""
    rows = all_rows(spark, out)
    told = ["bad_chs", "missing_chs", "extra_chs", "dropped_chs", "ica_excluded", "ica_labels", "notes"]
    proba = [F.transform("ica_proba", lambda p: F.bround(p, 2)).alias("ica_proba")] if "ica_proba" in rows.columns else []
    return rows.select("path", "stem", F.bround("t_start", 1).alias("t_start"), F.bround("t_end", 1).alias("t_end"), "status", "drop_reason", *[c for c in told if c in rows.columns], *proba)


def counters(spark: SparkSession, out: str, batch_size: int = 10) -> DataFrame:
    """Files that were attempted, batches of them, windows by status."""
    files = manifest(spark, out).agg(F.count("*").alias("files"), F.ceil(F.count("*") / batch_size).alias("batches"))
    rows = all_rows(spark, out).agg(F.count_if(F.col("status") == "ok").alias("windows"), F.count_if(F.col("status") != "ok").alias("dropped"))
    return files.crossJoin(rows)  # one row each


def manifest(spark: SparkSession, out: str) -> DataFrame:
    runs = _runs(spark, f"{out}/manifest")
    return spark.read.parquet(*(f"{out}/manifest/run={r}" for r in runs)).distinct() if runs else spark.createDataFrame([], "path string, stem string")


def pending(spark: SparkSession, paths: DataFrame, out: str, key: str = "stem", retry_failed: bool = False) -> DataFrame:
    """Paths whose key isn't in the manifest; with ``retry_failed`` those without windows count as pending."""
    done = manifest(spark, out)
    if retry_failed and not done.isEmpty():
        done = done.join(windows(spark, out).select("path").distinct(), "path", "left_semi")
    return L.unprocessed(paths, done.select(key).distinct(), key)


def shape(data: DataFrame) -> tuple[int, int]:
    """Channels and samples of the windows, which must all be alike."""
    found = data.select(F.size("data").alias("c"), F.array_min(F.transform("data", lambda x: F.size(x))).alias("lo"), F.array_max(F.transform("data", lambda x: F.size(x))).alias("hi"))
    r = found.agg(F.min("c"), F.max("c"), F.min("lo"), F.max("hi")).first()
    if r[0] != r[1] or r[2] != r[3]:
        raise ValueError(f"windows of different shapes: {r[0]} to {r[1]} channels, {r[2]} to {r[3]} samples")
    return r[0] or 0, r[2] or 0


def fitted(data: DataFrame, channels: int, samples: int) -> DataFrame:
    """Windows of one shape: zeros are added at the end, or channels and samples cut off there; ``fitted`` tells the shape before, null where it was right."""
    c, n = F.size("data"), F.coalesce(F.array_max(F.transform("data", lambda x: F.size(x))), F.lit(0))
    even = F.forall("data", lambda x: F.size(x) == samples)
    zeros = lambda k: F.array_repeat(F.lit(0.0).cast("float"), k)
    row = lambda x: F.slice(F.concat(x.cast("array<float>"), zeros(F.greatest(F.lit(samples) - F.size(x), F.lit(0)))), 1, samples)
    rows = F.slice(F.concat(F.transform("data", row), F.array_repeat(zeros(F.lit(samples)), F.greatest(F.lit(channels) - c, F.lit(0)))), 1, channels)
    right = (c == channels) & even
    return data.withColumns({"fitted": F.when(~right, F.concat_ws("x", c, n)), "data": F.when(right, F.col("data").cast("array<array<float>>")).otherwise(rows)})


def compact(spark: SparkSession, src: str, out: str, max_mb: float, order: list[str], delete_source: bool = False, swap: bool = False, fit: tuple[int, int] | None = None) -> DataFrame:
    """Write sources' windows into files of at most ``max_mb`` by next fit, each with gapless file and global numbers.

    An existing target is refused.  The source stays, unless ``delete_source`` is
    asked for; by ``swap`` the target then takes its place.  Windows must be of one
    shape, or are brought to ``fit`` (channels, samples), each with a note of what was
    done to it.
    """
    if _there(spark, f"{out}/data"):
        raise ValueError(f"{out} holds compacted data already")
    data = windows(spark, src)
    data = fitted(data, *fit) if fit else data
    of_one = fit or shape(data)
    size = F.lit(4 * of_one[0] * of_one[1]).cast("long")
    files = data.groupBy("path").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    counted = L.numbered(files, ["path"], "file_ord")
    packed = L.next_fit(counted, "file_ord", "bytes", max_mb * 1e6).join(counted, "file_ord")
    packed = L.cumulative(L.renumbered(packed, "out_file", "file_ord"), ["file_ord"], "n")
    packed = packed.select("path", "out_file", F.concat(F.lit("combined_"), F.lpad(F.col("out_file").cast("string"), 5, "0")).alias("out_name"), "file_idx", "first")
    place = F.row_number().over(Window.partitionBy("path").orderBy(*order)) - 1
    rows = data.withColumn("_place", place).join(packed, "path").withColumn("global_idx", F.col("first") + F.col("_place")).drop("_place", "first")
    rows = rows.repartitionByRange("out_file").sortWithinPartitions("out_file", "global_idx")
    # A source above the cap has an output of its own, in as many files as it takes.
    rows.write.mode("errorifexists").option("maxRecordsPerFile", max(1, L.capacity(max_mb, of_one))).partitionBy("out_name").parquet(f"{out}/data")
    manifest(spark, src).write.mode("errorifexists").parquet(f"{out}/manifest/run=compacted")
    made = spark.read.parquet(f"{out}/data")
    # One row for each output file.
    file_starts(made).coalesce(1).write.parquet(f"{out}/index")
    if made.count() != data.count():
        raise ValueError("compaction lost windows")
    if delete_source:
        remove(spark, src)
        if swap:
            fs, at = file_system(spark, out)
            fs.rename(at, file_system(spark, src)[1])
            made = spark.read.parquet(f"{src}/data")
    return made


def file_starts(data: DataFrame) -> DataFrame:
    """Each output file's first number and how many windows it has; of the data only the numbers are read."""
    return data.groupBy("out_name").agg(F.min("global_idx").alias("first"), F.count("*").alias("n")).orderBy("first")


class WindowDataset:
    """Windows of a compacted dataset by number, in order, or in another order each epoch.

    The driver holds the names of output files and the numbers that they begin with
    (a few dozen bytes for each file of up to some GB); which files hold what is asked
    for is found there by binary search, and no other file is opened.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(f"{path}/data")
        index = spark.read.parquet(f"{path}/index") if _there(spark, f"{path}/index") else file_starts(self.rows)
        found = index.orderBy("first").toArrow()
        self.names, self.first = found["out_name"].to_pylist(), found["first"].to_numpy()
        self.length = int(found["n"].to_numpy().sum())

    def __len__(self) -> int:
        return self.length

    def files_of(self, numbers: list[int]) -> list[str]:
        """The output files that hold these numbers."""
        return [self.names[i] for i in np.unique(np.searchsorted(self.first, numbers, side="right") - 1).tolist()]

    def _asked(self, numbers: list[int]) -> DataFrame:
        return self.rows.where(F.col("out_name").isin(self.files_of(numbers)) & F.col("global_idx").isin(list(numbers)))

    def take(self, numbers: list[int]) -> list[Row]:
        """The windows of these numbers, in their order; one job for all of them."""
        if bad := [i for i in numbers if i < 0 or i >= self.length]:
            raise IndexError(bad[0])
        found = {r["global_idx"]: r for r in self._asked(numbers).collect()} if numbers else {}
        return [found[i] for i in numbers]

    def __getitem__(self, i: int) -> Row:
        return self.take([i])[0]

    def __iter__(self) -> Iterator[Row]:
        yield from self.rows.orderBy("global_idx").toLocalIterator()

    def epoch(self, seed: int) -> DataFrame:
        """All windows in an order of this seed's own, as ``place`` tells."""
        return L.shuffled(self.rows, "global_idx", self.length, seed)

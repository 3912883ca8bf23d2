"""Batches, output files and global positions of a catalogue of files.

What depends on the order of all rows is worked out by range partitions: each gives
a few totals, these are put in order on their own, and every partition then goes on
from where the one before ended.  No task sees the whole catalogue.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplebed.operators.tables import staged


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def unprocessed(paths: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return paths.join(done, key, "left_anti")


def running(df: DataFrame, order: list[str], weight: Column, out: str) -> DataFrame:
    """``out``: the sum of ``weight`` over the rows before each one; ``order`` tells rows apart."""
    dealt = staged(df.withColumn("_w", weight.cast("long")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    # One row for each partition.
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.sum("_w").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    within = F.sum("_w").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    return dealt.join(F.broadcast(parts), "_part").withColumn(out, F.col("_before") + within).drop("_w", "_part", "_before")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``out``: the number of each row in order, from 0."""
    return running(df, order, F.lit(1), out)


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """batch and place: ``size`` rows each, in order."""
    return numbered(df, order, "_n").withColumns({"batch": F.floor(F.col("_n") / size), "place": F.col("_n") % size}).drop("_n")


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The rows of both tables side by side, first with first and so on; what has no partner is left out."""
    return numbered(left, left_order, "_n").join(numbered(right, right_order, "_n"), "_n").drop("_n")


def free_names(spark: SparkSession, n: int, taken: DataFrame, prefix: str, first: int = 1) -> DataFrame:
    """idx and name of the first ``n`` numbers from ``first`` on that ``taken`` (idx, distinct) doesn't have."""
    free = spark.range(first, first + n + taken.count()).select(F.col("id").alias("idx")).join(taken, "idx", "left_anti")
    return numbered(free, ["idx"], "_n").where(F.col("_n") < n).select("idx", F.concat(F.lit(prefix), F.col("idx").cast("string")).alias("name"))


class _NextFit:
    """A partition's sources in order: where a new file begins, whatever the one before left."""

    def __init__(self, sizes: np.ndarray, cap: float):
        self.cap, self.n = cap, len(sizes)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        # After a file that begins with source i the next one begins with source follow[i] (n: none does).
        self.follow = self._next(self.begins, np.arange(self.n))

    def _next(self, base: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first source that no longer fits a file which is empty before ``base``; an empty file takes any source."""
        found = np.maximum(np.searchsorted(self.ends, self.cap + base, side="right"), at + 1)
        found = np.minimum(found, self.n)
        empty = (found < self.n) & (self.ends[np.maximum(found - 1, 0)] <= base)
        return np.minimum(found + empty, self.n)

    def start(self, used: float) -> int:
        """The first source that begins a file, if ``used`` of the last one is taken."""
        if used > 0:
            return int(np.searchsorted(self.ends, self.cap - used, side="right"))
        first = int(np.searchsorted(self.ends, self.cap, side="right"))
        return min(first + (first < self.n and (self.ends[first - 1] if first else 0) <= 0), self.n)

    def table(self) -> list[tuple[float, float, int, float, float]]:
        """lo, hi, files, add, used: from lo < used <= hi (hi 0 for an empty file) on, how many files begin here, and what is used at the end (added to what was, if none begins)."""
        files, used = np.zeros(self.n + 1, np.int64), np.zeros(self.n + 1)
        total = float(self.ends[-1])
        for i in range(self.n - 1, -1, -1):
            j = self.follow[i]
            files[i], used[i] = (1, total - self.begins[i]) if j == self.n else (1 + files[j], used[j])
        i = self.start(0.0)
        out = [(-1.0, 0.0, int(files[i]), 0.0, float(used[i])) if i < self.n else (-1.0, 0.0, 0, total, 0.0)]
        hi = np.inf
        for i in range(self.n):
            lo = max(0.0, self.cap - self.ends[i])
            if lo < hi:
                out.append((lo, hi, int(files[i]), 0.0, float(used[i])))
                hi = lo
            if hi <= 0:
                break
        if hi > 0:
            out.append((0.0, hi, 0, total, 0.0))
        return out

    def files(self, used: float, file: int) -> np.ndarray:
        """The file of each source."""
        begins = np.zeros(self.n, np.int64)
        at = self.start(used)
        while at < self.n:
            begins[at] = 1
            at = int(self.follow[at])
        return file + np.cumsum(begins)


def next_fit(df: DataFrame, key: str, size: str, cap: float) -> DataFrame:
    """key, out_file: sources in order of their key; a new file begins when the running size would exceed the cap.

    A source larger than the cap gets a file of its own, and no file is empty.  A
    step depends on the one before only by how full the last file is, so every
    range partition first tells what it makes of any such fill: a table with a row
    for each source of the first file at most.  These are followed in order, and the
    partitions then place their sources on their own.
    """
    import pyarrow as pa

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(size).cast("double").alias("s"))
    dealt = staged(rows.repartitionByRange("k").withColumn("part", F.spark_partition_id()), "next-fit")

    def ordered(t: pa.Table) -> tuple[np.ndarray, _NextFit]:
        t = t.sort_by([("k", "ascending")])
        return t["k"].to_numpy(), _NextFit(t["s"].to_numpy(), cap)

    def told(t: pa.Table) -> pa.Table:
        lo, hi, files, add, used = zip(*ordered(t)[1].table(), strict=True)
        return pa.table({"part": pa.array([t["part"][0].as_py()] * len(lo), pa.int32()), "lo": lo, "hi": hi, "files": pa.array(files, pa.int64()), "add": add, "used": used})

    steps: dict[int, list] = {}
    for r in dealt.groupBy("part").applyInArrow(told, "part int, lo double, hi double, files long, add double, used double").collect():
        steps.setdefault(r["part"], []).append(r)
    file, used, begin = 0, 0.0, {}
    for part in sorted(steps):
        begin[part] = (used, file)
        r = next(r for r in steps[part] if r["lo"] < used <= r["hi"])
        used, file = (used + r["add"]) if r["files"] == 0 else r["used"], file + r["files"]

    def placed(t: pa.Table) -> pa.Table:
        keys, fit = ordered(t)
        return pa.table({"k": pa.array(keys, pa.int64()), "f": pa.array(fit.files(*begin[t["part"][0].as_py()]), pa.int64())})

    out = dealt.groupBy("part").applyInArrow(placed, "k long, f long")
    return out.select(F.col("k").alias(key), F.col("f").alias("out_file"))


def renumbered(df: DataFrame, file: str, source: str) -> DataFrame:
    """file_idx: the used sources of each output file, numbered without gaps in order."""
    return df.withColumn("file_idx", F.dense_rank().over(Window.partitionBy(file).orderBy(source)) - 1)


def cumulative(df: DataFrame, order: list[str], length: str) -> DataFrame:
    """first: how many windows come before those of each file."""
    return running(df, order, F.col(length), "first")


def capacity(max_mb: float, shape: tuple[int, ...]) -> int:
    """Windows of a shape that fit a file of ``max_mb``, at four bytes a value."""
    n = 4
    for s in shape:
        n *= s
    return int(max_mb * 1e6 / n)


# --- order by chance ---------------------------------------------------------

ROUNDS, WALKS = 6, 16


def permuted(number: Column, n: int, seed: int) -> Column:
    """Another order of the numbers from 0 to ``n`` - 1, told for each number on its own: no sort, no table.

    A Feistel network over a grid of a * b >= n places: each round shifts one coordinate
    by a hash of the other.  What falls beyond ``n``, less than a row of the grid, goes
    through again.
    """
    a = max(1, int(np.ceil(np.sqrt(n))))
    b = max(1, -(-n // a))
    whole = F.lit(n).cast("long")

    def turn(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), (x % b).cast("long")
        at = F.struct(left.alias("l"), right.alias("r"))
        for k in range(ROUNDS):
            if k % 2:
                step = lambda p, k=k: F.struct(p["l"].alias("l"), F.pmod(p["r"] + F.pmod(F.xxhash64(p["l"], F.lit(seed), F.lit(k)), F.lit(b)), F.lit(b)).cast("long").alias("r"))
            else:
                step = lambda p, k=k: F.struct(F.pmod(p["l"] + F.pmod(F.xxhash64(p["r"], F.lit(seed), F.lit(k)), F.lit(a)), F.lit(a)).cast("long").alias("l"), p["r"].alias("r"))
            at = F.transform(F.array(at), step)[0]
        return F.transform(F.array(at), lambda p: p["l"] * b + p["r"])[0]

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), turn(number.cast("long")), lambda x, _: F.when(x < whole, x).otherwise(turn(x)))
    return F.transform(F.array(walked), lambda x: F.when(x < whole, x).otherwise(F.raise_error(F.lit("a number found no place")).cast("long")))[0]


def shuffled(df: DataFrame, number: str, n: int, seed: int, out: str = "place") -> DataFrame:
    """The rows in another order, which ``out`` tells, in range partitions; ``number`` counts them from 0."""
    return df.withColumn(out, permuted(F.col(number), n, seed)).repartitionByRange(out).sortWithinPartitions(out)

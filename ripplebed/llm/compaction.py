"""Bin-packed compaction of a folder of Parquet files, planned in pure Spark SQL.

Rows are dealt to files by day, lot and piece.  The plan collects a day's small files as
sorted structs, folds them by ``aggregate()`` into an array of groups, where each file
joins the first group that has room, and explodes the groups into one row for each file.
Groups of several files are rewritten, file behind file in the order of joining; others
are never touched.

A day's files are few, however many rows they hold: it has at most 1 + 150 lots of four
pieces.  Everything that has a row for each table row is dealt by (day, lot, piece) or
by (day, group), and a file is written and read by one task as a sorted stream.  The
plan, a few rows a day, is written down before anything is rewritten; names of files
that are to go pass the driver one at a time.  Until the last of them is gone, the folder
also holds rewritten rows, as it must without a table format: the plan, which lies beside
the folder, tells the two apart.

Defined results: rows without arrived_at make a day of their own, null; a null click_id
counts as empty text for its checksum and in lists of ids, and sorts first; a null value
and one that isn't a finite number count 0 cents; repeated rows and rows alike in time
and id stay, and keep within a rewritten file the order that they had; texts may be of
any length; further columns go along, whatever their names; an empty table makes an
empty folder and no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ripplebed.llm.base import file_system, new_path, staged

#: One part in so many of the table's rows: a lot, a small file (below), a group (at most).
LOTS, SMALL, FULL = 150, 600, 400
KEYS = ("day", "lot", "piece")


@dataclass(frozen=True)
class Folder:
    """A folder of files by day, lot and piece."""

    path: str
    schema: StructType
    keys: tuple[str, str, str]
    rows: int

    def part(self, parts: int) -> int:
        """A size: one part in so many of the rows, and one row more."""
        return 1 + self.rows // parts

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows with the three keys, named as in the folder."""
        kinds = (LongType(), LongType(), IntegerType())
        return spark.read.schema(StructType([*self.schema.fields, *(StructField(k, t) for k, t in zip(self.keys, kinds, strict=True))])).parquet(self.path)

    def files(self, spark: SparkSession) -> DataFrame:
        """day, lot, piece, path and n of each file, from the files' footers."""
        df = self.read(spark)
        path = df.metadataColumn("_metadata")["file_path"]
        named = df.select(*(F.col(_quoted(k)).alias(n) for k, n in zip(self.keys, KEYS, strict=True)), path.alias("path"))
        return named.groupBy(*KEYS, "path").agg(F.count(F.lit(1)).alias("n"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _free(names: list[str], columns: list[str]) -> tuple[str, ...]:
    """The names, with as many marks before them as keep them apart from the columns."""
    taken, mark = {c.lower() for c in columns}, ""
    while any(mark + n in taken for n in names):
        mark += "x"
    return tuple(mark + n for n in names)


def deal(rows: DataFrame, lots: int = LOTS) -> tuple[DataFrame, tuple[str, ...], int]:
    """The rows with day, lot and piece, these columns' names, and the number of rows."""
    keys = _free([*KEYS, "h", "in_day", "of_day"], rows.columns)
    day, lot, piece, h, in_day, of_day = keys
    dated = rows.withColumn(day, F.unix_date(F.col("arrived_at").cast("date")).cast("long"))
    counts = dated.groupBy(F.col(day).alias(of_day)).agg(F.count(F.lit(1)).alias(in_day))
    counts = staged(counts, "days")
    n = counts.agg(F.sum(in_day)).first()[0] or 0
    dealt = dated.join(counts, F.col(day).eqNullSafe(F.col(of_day))).withColumn(h, F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")))
    lot_ = F.shiftright(h, 4) % (1 + F.floor(F.col(in_day) / (1 + n // lots)))
    piece_ = F.least(F.col(h) % 4, F.shiftright(h, 2) % 4).cast("int")
    return dealt.withColumn(lot, lot_).withColumn(piece, piece_).drop(h, in_day, of_day), keys[:3], n


def write_dealt(rows: DataFrame, path: str) -> Folder:
    """Write one file for each (day, lot, piece), sorted by arrived_at and click_id, into a new folder."""
    dealt, keys, n = deal(rows)
    order = [*map(_quoted, keys), *(F.col(c).asc_nulls_first() for c in ("arrived_at", "click_id"))]
    dealt.repartition(*map(_quoted, keys)).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).partitionBy(*keys).parquet(path)
    return Folder(path, rows.schema, keys, n)


def first_fit(files: Column, full: int) -> Column:
    """Groups (structs of ``n`` and ``files``) of structs with a size ``n``, each in the earliest group that holds at most ``full`` with it."""

    def put(groups: Column, file: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: g["n"] + file["n"] <= full), True)
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.struct((g["n"] + file["n"]).alias("n"), F.concat(g["files"], F.array(file)).alias("files"))).otherwise(g))
        return F.when(at > 0, joined).otherwise(F.concat(groups, F.array(F.struct(file["n"].alias("n"), F.array(file).alias("files")))))

    return F.aggregate(files, F.lit([]).cast("array<struct<n: bigint, files: array<struct<taken: bigint, lot: bigint, piece: int, n: bigint, path: string>>>>"), put)


def plan(files: DataFrame, small: int, full: int) -> DataFrame:
    """Each file that is to go into another: day, lot, piece, path, n, its group and place there, and all of the group's ``sources``, first to last."""
    file = F.struct((-F.col("n")).alias("taken"), "lot", "piece", "n", "path")
    days = files.where(F.col("n") < small).groupBy("day").agg(F.sort_array(F.collect_list(file)).alias("files"))
    groups = days.select("day", F.posexplode(first_fit(F.col("files"), full)).alias("group", "made")).where(F.size("made.files") > 1)
    written = F.array_join(F.transform("made.files", lambda f: F.concat_ws("-", f["lot"], f["piece"])), ",")
    placed = groups.select("day", "group", written.alias("sources"), F.col("made.files")[0].alias("first"), F.posexplode("made.files").alias("place", "file"))
    return placed.select("day", "file.lot", "file.piece", "file.path", "file.n", "group", "place", "sources", F.col("first.lot").alias("to_lot"), F.col("first.piece").alias("to_piece"))


def rewrite(spark: SparkSession, folder: Folder, planned: DataFrame) -> None:
    """Write each group's files behind one another as one file, in the place of its first, and remove them."""
    day, lot, piece = folder.keys
    names = _free(["row_index", "group", "place", "to_lot", "to_piece", "of_day", "of_lot", "of_piece"], [*folder.schema.names, *folder.keys])
    index, group, place, to_lot, to_piece, *of = names
    rows = folder.read(spark)
    rows = rows.withColumn(index, rows.metadataColumn("_metadata")["row_index"])
    moves = planned.select(*(F.col(c).alias(n) for c, n in zip(("group", "place", "to_lot", "to_piece", *KEYS), names[1:], strict=True)))
    same = [F.col(_quoted(k)).eqNullSafe(F.col(o)) for k, o in zip(folder.keys, of, strict=True)]
    moved = rows.join(moves, same).select(
        *map(_quoted, folder.schema.names), _quoted(day), F.col(to_lot).alias(lot), F.col(to_piece).alias(piece), place, index
    )
    keys = list(map(_quoted, folder.keys))
    ordered = moved.repartition(*keys).sortWithinPartitions(*keys, place, index).drop(place, index)
    ordered.write.mode("append").option("maxRecordsPerFile", 0).partitionBy(*folder.keys).parquet(folder.path)
    fs, _ = file_system(spark, folder.path)
    for row in planned.select("path").toLocalIterator():
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(row["path"])), False)


def compact(spark: SparkSession, folder: Folder, small: int, full: int) -> DataFrame:
    """Compact a folder in place; returns the plan, which lies beside it."""
    planned = staged(plan(folder.files(spark), small, full), "compaction-plan")
    rewrite(spark, folder, planned)
    return planned


def digests(spark: SparkSession, folder: Folder, planned: DataFrame) -> DataFrame:
    """One row for each file of the folder, from its rows as they lie there."""
    df = folder.read(spark)
    meta = df.metadataColumn("_metadata")
    value = F.col("value").cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 1e15)
    cents = F.when(finite, F.floor(F.lit(100) * value + F.lit(0.5))).otherwise(0)
    short = df.select(
        *(F.col(_quoted(k)).alias(n) for k, n in zip(folder.keys, KEYS, strict=True)), meta["row_index"].alias("at"), F.when(meta["row_index"] == 0, meta["file_path"]).alias("path"),
        F.col("click_id").cast("long").alias("click_id"), cents.cast("long").alias("cents"),
    )
    # Each folder of a day, lot and piece has one file by now.
    rows = short.repartition(*KEYS).sortWithinPartitions(*KEYS, "at")
    per_file = rows.mapInArrow(_digest_files, f"day long, lot long, piece int, path string, n_rows long, min_click_id long, max_click_id long, cents long, ids_sha256 string")
    merged = planned.where(F.col("place") == 0).select(F.col("day").alias("of_day"), F.col("lot").alias("of_lot"), F.col("piece").alias("of_piece"), F.col("sources").alias("joined"))
    same = F.col("day").eqNullSafe(F.col("of_day")) & (F.col("lot") == F.col("of_lot")) & (F.col("piece") == F.col("of_piece"))
    out = per_file.join(merged, same, "left")
    return out.select(
        "day", "lot", F.col("piece").cast("long").alias("piece"), "n_rows", "min_click_id", "max_click_id", "cents", F.coalesce("joined", F.concat_ws("-", "lot", "piece")).alias("sources"), "ids_sha256",
        F.lit(",".join(folder.schema.names)).alias("columns"), "path", F.col("joined").isNotNull().alias("rewritten"),
    )


def _digest_files(batches):
    """Rows of whole files, in order, to one row for each file."""
    import pyarrow.compute as pc

    head, n, low, high, cents, digest = None, 0, None, None, 0, None

    def made():
        values = (*head, n, low, high, cents, digest.hexdigest())
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["day", "lot", "piece", "path", "n_rows", "min_click_id", "max_click_id", "cents", "ids_sha256"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    for batch in batches:
        firsts = [i for i, at in enumerate(pc.equal(batch.column("at"), 0).to_pylist()) if at]
        for a, b in zip([0, *firsts], [*firsts, batch.num_rows], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if part.column("at")[0].as_py() == 0:
                if head is not None:
                    yield made()
                head = tuple(part.column(c)[0].as_py() for c in ("day", "lot", "piece", "path"))
                n, low, high, cents, digest = 0, None, None, 0, hashlib.sha256()
            ids = part.column("click_id")
            written = pc.binary_join(pa.ListArray.from_arrays([0, len(ids)], pc.fill_null(ids.cast(pa.string()), "")), ",")[0].as_py()
            digest.update(("," * (n > 0) + written).encode())
            least, most = pc.min(ids).as_py(), pc.max(ids).as_py()
            low = least if low is None or least is not None and least < low else low
            high = most if high is None or most is not None and most > high else high
            cents += pc.sum(part.column("cents")).as_py() or 0
            n += len(ids)
    if head is not None:
        yield made()


def op12_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_dealt(spark.read.parquet(f"{sf_dir}/clicks.parquet"), new_path(spark, "clicks"))
    planned = compact(spark, folder, folder.part(SMALL), folder.part(FULL))
    return digests(spark, folder, planned)

"""K-d tree sharding: nearly equal bytes by recursive weighted medians, in DataFrame functions only.

Equal texts are one point of the tree, which weighs their bytes, so they come into
one shard.  Only a group that weighs more than ``WHOLE`` of a shard is divided, into
parts of about that weight, as shards could not come out even otherwise.

The coordinates of a point are its size, language and source, each scaled to 0..1:
the size by its rank among ``STEPS`` quantiles, language and source by a hash of
their value (the least among the texts of a group).  A node that stands for k shards
is cut along its widest coordinate where the weight reaches floor(k / 2) / k of its
bytes, until each leaf stands for one shard and so holds the target bytes.  All nodes
of a level are cut at once: points are range partitioned by node and coordinate, the
partitions' totals give each its offset, and running sums within partitions give
every point its place, so the median is exact, no group has to fit a task, and only a
few totals for each partition pass through one place.  Ties in the coordinate are
ordered by hashes of the text, so a hot value can still be cut.

Defined results: a null text has no bytes (size 8, crc32 of nothing); a null
language or source is a value of its own; a null doc_id gets a shard and stays
null; rows that are alike get different slots; texts may be of any length; an empty
table gives no rows; other columns are ignored.  Texts are told apart by 96 bits of
hashes and their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplebed.llm.base import documents, staged, with_offsets

SHARDS = 24
#: Part of a shard's bytes up to which equal texts stay together.
WHOLE = 0.02
#: Quantiles that scale the size.
STEPS = 64
#: Rows of a shard that are numbered in one window.
NUMBERED = 50_000
DIMENSIONS = ("c_size", "c_lang", "c_source")
TEXT = ("text_name", "text_crc32", "size")


def metadata(docs: DataFrame) -> DataFrame:
    """row (a number of its own for each), doc_id, size, hashes of the text, and the places of language and source."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = lambda c: (F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) / F.lit(2.0**32)).alias(f"c_{c}")
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_name"),
        place("lang"),
        place("source"),
    )


def rank_of(size: Column, quantiles: list[int]) -> Column:
    """The share of quantiles below a size."""
    below = F.size(F.filter(F.array(*map(F.lit, quantiles)), lambda q: q < size)) if quantiles else F.lit(0)
    return below / F.lit(float(STEPS))


def cut_level(points: DataFrame) -> DataFrame:
    """Cut every node that stands for more than one shard; ``points`` has first and leaves, which name the node."""
    low_high = [f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
    nodes = points.groupBy("first", "leaves").agg(F.sum("weight").alias("total"), *low_high)
    widths = [F.struct((F.col(f"hi_{c}") - F.col(f"lo_{c}")).alias("w"), F.lit(-i).alias("i")) for i, c in enumerate(DIMENSIONS)]
    nodes = nodes.select("first", "total", (-F.array_max(F.array(*widths))["i"]).alias("dim"))
    # At most one row for each shard.
    keyed = points.join(F.broadcast(nodes), "first").withColumn("key", F.get(F.array(*DIMENSIONS), F.col("dim")))
    order = ["key", *TEXT, "part"]
    dealt = staged(keyed.repartitionByRange("first", *order).withColumn("dealt", F.spark_partition_id()), "kd")
    parts = with_offsets(dealt.groupBy("first", "dealt").agg(F.sum("weight").alias("bytes")), ["first"], "dealt", "bytes", "before")
    # As many rows as partitions, and one more for each node at most.
    placed = dealt.join(F.broadcast(parts.drop("bytes")), ["first", "dealt"])
    running = F.sum("weight").over(Window.partitionBy("first", "dealt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    left = F.floor(F.col("leaves") / 2).cast("int")
    # A point goes right if its middle lies beyond the cut; a node of one shard stays as it is.
    right = (F.col("leaves") > 1) & ((2 * (F.col("before") + running) - F.col("weight")) * F.col("leaves") > 2 * F.col("total") * left)
    placed = placed.withColumn("right", right).withColumn("half", left)
    return placed.select(
        *TEXT,
        "part",
        "weight",
        *DIMENSIONS,
        F.when(F.col("right"), F.col("first") + F.col("half")).otherwise(F.col("first")).alias("first"),
        F.when(F.col("leaves") <= 1, F.col("leaves")).when(F.col("right"), F.col("leaves") - F.col("half")).otherwise(F.col("half")).alias("leaves"),
    )


def shard(docs: DataFrame, shards: int = SHARDS, whole: float = WHOLE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row."""
    rows = staged(metadata(docs), "metadata")
    told = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.percentile_approx("size", [i / STEPS for i in range(1, STEPS)], 10_000).alias("q")).first()
    most = max(1.0, whole * (told["bytes"] or 0) / shards)
    groups = rows.groupBy(*TEXT).agg(F.sum("size").alias("bytes"))
    hot = groups.where(F.col("bytes") > most).select(*TEXT, F.ceil(F.col("bytes") / most).cast("int").alias("parts"))
    # Groups above a share of a shard: shards / whole of them at most.
    rows = rows.join(F.broadcast(hot), list(TEXT), "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int"))
    points = rows.groupBy(*TEXT, "part").agg(F.sum("size").alias("weight"), F.min("c_lang").alias("c_lang"), F.min("c_source").alias("c_source"))
    points = points.select("*", rank_of(F.col("size"), list(told["q"] or [])).alias("c_size"), F.lit(0).alias("first"), F.lit(shards).alias("leaves"))
    points = staged(points, "points")
    for _ in range(max(0, (shards - 1).bit_length())):
        points = cut_level(points)
    points = staged(points.select(*TEXT, "part", F.col("first").alias("shard")), "cut")
    placed = rows.join(points, [*TEXT, "part"]).select("row", "doc_id", "size", "text_crc32", "shard")
    return number(staged(placed, "shards"), "shard", told["n"]).drop("row")


def number(rows: DataFrame, by: str, n_rows: int, numbered: int = NUMBERED) -> DataFrame:
    """Add ``slot``: gapless from 0 within each value of ``by``, though no window holds all of a value's rows; ``row`` tells rows apart."""
    buckets = max(1, -(-n_rows // numbered))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counted = with_offsets(rows.groupBy(by, "_bucket").agg(F.count("*").alias("_n")), [by], "_bucket", "_n", "_before")
    place = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy("row"))
    out = rows.join(counted.drop("_n"), [by, "_bucket"])
    return out.withColumn("slot", F.col("_before") + place - 1).drop("_bucket", "_before")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

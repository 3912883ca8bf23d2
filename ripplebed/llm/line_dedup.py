"""Removal of lines that are spread over many sites, in DataFrame functions only.

For each distinct line (white space at its ends aside) a HyperLogLog sketch of the
sites it occurs on is built in every task and merged by the aggregation.  Lines
whose estimate is clearly below or above ``MIN_SITES`` are settled by it; for those
within ``BAND`` of it the distinct sites are counted exactly.  Of a line on at least
``MIN_SITES`` sites the occurrence in the smallest doc_id, there the first, stays
and all others go.

Defined results: lines without a word are never removed; a null text has no lines;
a null site counts as the site with an empty name; a null doc_id comes before all
others and its row is cleaned too; rows equal in id and text are cleaned alike; texts and
lines may be of any length; an empty table gives no rows; other columns are ignored.
Lines are told apart by 64-bit hashes, the texts of one doc_id by another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplebed.llm.base import documents, staged

MIN_SITES = 5
#: log2 of a sketch's registers: a relative error of 1.6 %.
LG_K = 12
#: Share of MIN_SITES by which an estimate may miss it and still be counted exactly.
BAND = 0.25
#: A line that makes up more than one of so many lines is joined by broadcast, of which there are at most as many.
HOT = 1000


def _rows(docs: DataFrame, site: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
    ).withColumn("row", F.xxhash64("doc_id", "text"))


def by_line(lines: DataFrame, chosen: DataFrame, total: int) -> DataFrame:
    """``lines`` with the columns of ``chosen`` (line, n and others), where the occurrences of no line come together in one task."""
    often = F.col("n") * HOT > total
    hot = F.broadcast(chosen.where(often))
    rest = lines.join(hot.select("line"), "line", "left_anti").join(chosen.where(~often), "line")
    return lines.join(hot, "line").unionByName(rest)


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """line, its ``first`` occurrence and their number ``n``, for lines on at least ``min_sites`` sites; ``lines`` has doc_id, row, pos, line, site."""
    sketched = lines.groupBy("line").agg(
        F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "pos")).alias("first")
    )
    # A line can't be on more sites than it occurs.
    sketched = staged(sketched.where(F.col("n") >= min_sites).select("line", "first", "n", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    near = F.abs(F.col("sites") - min_sites) <= max(1.0, band * min_sites)
    counted = by_line(lines.select("line", "site"), sketched.where(near).select("line", "n"), lines.count())
    exact = counted.groupBy("line").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites).select("line")
    sure = sketched.where(~near & (F.col("sites") > min_sites))
    return sure.unionByName(sketched.join(exact, "line", "left_semi")).select("line", "first", "n")


def clean_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, text without the removed lines, n_lines, n_removed; one row per document."""
    rows = _rows(docs, site)
    lines = rows.select("doc_id", "row", "site", F.posexplode(F.split("text", "\n")).alias("pos", "body"))
    lines = lines.where(F.col("body").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "row", "site", "pos", F.xxhash64(F.regexp_replace("body", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).alias("line"))
    lines = staged(lines, "lines")
    spread = staged(spread_lines(lines, min_sites), "spread-lines")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos"))
    gone = by_line(lines.select("line", "doc_id", "row", "pos"), spread, lines.count()).where(~stays)
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row"))
    cut = rows.select("doc_id", "row", F.split("text", "\n").alias("all")).join(gone, same, "left")
    # The runs of lines between those removed; each line is copied once.
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("all")))
    cut = cut.withColumn("edges", F.when(F.col("gone").isNotNull(), edges))
    runs = F.transform(F.slice("edges", 2, F.size("edges") - 1), lambda e, i: F.slice("all", F.get("edges", i) + 2, e - F.get("edges", i) - 1))
    text = F.array_join(F.coalesce(F.flatten(runs), F.col("all")), "\n")
    return cut.select("doc_id", text.alias("text"), F.size("all").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
s AS (SELECT line, count(DISTINCT site) AS sites FROM k WHERE line <> '' GROUP BY line),
r AS (SELECT k.*, coalesce(sites >= {MIN_SITES} AND row_number() OVER (PARTITION BY k.line ORDER BY doc_id, pos) > 1, false) AS gone FROM k LEFT JOIN s USING (line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM r GROUP BY doc_id
"""

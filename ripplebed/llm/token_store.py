"""Token ids in Parquet list columns, laid out for selective reads.

A store has two tables: ``tokens`` (one row per document: doc_id, part, place,
n_tokens, ids) and ``parts`` (one row per write task: part, part_start).  Rows
lie in ascending doc_id order; ``place`` counts the ids before a document within
its part.  Row groups and pages are small and carry page indexes, ids are
dictionary encoded and the ascending columns delta encoded, so a reader can take
one document's ids, or only the metadata, without reading the rest.

Defined results: a null text has the end id alone; a null doc_id sorts first and
stays null; rows that share a doc_id each keep their own ids; an empty table
makes an empty store; texts of any length are encoded whole, a long one as a batch of its
own; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplebed.llm.base import documents, id_and_text, new_path, small_batches, with_offsets
from ripplebed.llm.token_ids import BATCH_BYTES, byte_bpe_path, encoder

#: Bytes of pre-tokens that a worker remembers.
MEMORY = 64 << 20
#: Parquet settings: delta encoding comes with the second writer version, for columns without a dictionary.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
}


@dataclass(frozen=True)
class TokenStore:
    """Where a store lies, and how to read it."""

    path: str

    def metadata(self, spark: SparkSession) -> DataFrame:
        """doc_id, start, n_tokens: the ids column isn't read."""
        return self._started(spark).select("doc_id", "start", "n_tokens")

    def tokens(self, spark: SparkSession, doc_ids: list[int] | None = None) -> DataFrame:
        """doc_id, start, n_tokens, ids; for some documents their pages alone are read."""
        df = self._started(spark)
        df = df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))
        return df.select("doc_id", "start", "n_tokens", "ids")

    def _started(self, spark: SparkSession) -> DataFrame:
        # One row per write task: as many as there are files, however many documents they hold.
        parts = F.broadcast(spark.read.parquet(f"{self.path}/parts"))
        return spark.read.parquet(f"{self.path}/tokens").join(parts, "part").withColumn("start", F.col("part_start") + F.col("place"))


def write_tokens(docs: DataFrame, path: str, end_id: int, tokenizer: str | None = None) -> TokenStore:
    """Encode each text, append ``end_id``, and write a store at ``path``."""
    tokenizer = tokenizer or byte_bpe_path()

    def encode(batches):
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer, MEMORY)
        for batch in small_batches(batches, BATCH_BYTES, trim_bytes=64 << 20):
            ids, starts = enc.encode_ended(batch.column(1), end_id)
            rows = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place + starts[:-1]), pa.array(np.diff(starts)), rows],
                names=["doc_id", "part", "place", "n_tokens", "ids"],
            )
            place += int(starts[-1])

    # Rows that share an id may be many: a hash of the text deals them to tasks too.
    rows = id_and_text(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = rows.mapInArrow(encode, "doc_id long, part int, place long, n_tokens long, ids array<int>")
    made.write.options(**LAYOUT).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    totals = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    started = with_offsets(totals.withColumn("all", F.lit(0)), ["all"], "part", "n", "part_start")
    started.select("part", "part_start").coalesce(1).write.parquet(f"{path}/parts")
    return TokenStore(path)


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of a store's ids, as they were read."""

    def crc(batches):
        for batch in batches:
            ids = batch.column(3)
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8).data
            ends = ids.offsets.to_numpy().astype(np.int64) * 4
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_tokens(documents(spark, sf_dir), new_path(spark, "tokens"), end_id=2)
    return digests(store.tokens(spark))

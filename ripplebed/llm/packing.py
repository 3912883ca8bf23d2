"""Packing documents into training sequences: first-fit decreasing on a tournament tree.

Documents are cut into pieces of at most the sequence length: full pieces from
the start, then the rest.  Documents fall into groups by a hash of their id and ids,
and equal ones of a task by which of them they are too, so groups are random, of
bounded expected size even if ids repeat or are null, and independent of each other;
a lost task is simply run again.  Within a group the pieces, longest first, each go
into the first sequence that has room.  A tournament tree over the sequences'
free places, whose inner nodes hold the larger of their children, finds it in
logarithmic time.

Defined results: a null or empty text is a piece with just the end id; a null
doc_id is packed like any other and stays null; equal documents are packed as
often as they occur; pieces of equal length keep the order of doc_id and start; texts of
any length are cut as a whole; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ripplebed.llm.base import documents, id_and_text, small_batches
from ripplebed.llm.token_ids import BATCH_BYTES, byte_bpe_path, encoder

SEQUENCE = 2048
#: Documents in a group, on average.
GROUP_DOCUMENTS = 8192
SPANS_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
SPANS = ", ".join(f"{name} long" for name in SPANS_NAMES)
#: Column that deals documents to groups.
DEAL = "_deal"


class TournamentTree:
    """Free places of up to ``n`` bins; ``place(size)`` gives the first bin with room and takes it."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        free, at = self.free, 1
        if free[1] < size:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        found = at - self.leaves
        free[at] -= size
        while at > 1:
            at //= 2
            a, b = free[2 * at], free[2 * at + 1]
            best = a if a >= b else b
            if free[at] == best:
                break
            free[at] = best
        return found


def first_fit_decreasing(sizes: Iterable[int], capacity: int) -> tuple[list[int], list[int]]:
    """For each size its bin and its offset there; sizes of equal length keep their order."""
    sizes = list(sizes)
    if any(s > capacity or s < 0 for s in sizes):
        raise ValueError("a piece is longer than a sequence")
    bins, offsets, used = [0] * len(sizes), [0] * len(sizes), {}
    tree = TournamentTree(max(1, len(sizes)), capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = tree.place(sizes[i])
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = offsets[i] + sizes[i]
    return bins, offsets


def cut_documents(docs: DataFrame, end_id: int, tokenizer: str | None = None, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, start, length, ids_crc32, doc_tokens, ``ids`` if asked for, and a hash of the document to deal it by."""
    tokenizer = tokenizer or byte_bpe_path()

    def cut(batches):
        import xxhash

        enc, met = encoder(tokenizer), {}
        for batch in small_batches(batches, BATCH_BYTES // 2):
            ids, starts = enc.encode_ended(batch.column(1), end_id)
            raw, at = ids.astype("<u4", copy=False).view(np.uint8).data, (4 * starts).tolist()
            rows, ends = [], [0]
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                # Of equal documents, the first, the second and so on: the same in whatever order a task reads them.
                name = xxhash.xxh3_64_intdigest(raw[a:b], seed=0 if doc_id is None else doc_id & 0xFFFFFFFF)
                met[name] = nth = met.get(name, -1) + 1
                deal = xxhash.xxh3_64_intdigest(nth.to_bytes(8, "little"), seed=name) >> 1
                for start in range(a, b, 4 * length):
                    end = min(start + 4 * length, b)
                    rows.append((doc_id, (start - a) // 4, (end - start) // 4, zlib.crc32(raw[start:end]), (b - a) // 4, deal))
                    ends.append(end // 4)
            *columns, deals = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
            names = SPANS_NAMES
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
                names = [*names, "ids"]
            yield pa.RecordBatch.from_arrays([*columns, deals], names=[*names, DEAL])

    return id_and_text(docs).mapInArrow(cut, SPANS + (", ids array<int>" if with_ids else "") + f", {DEAL} long")


def pack(pieces: DataFrame, n_documents: int, length: int = SEQUENCE, group_documents: int = GROUP_DOCUMENTS, seed: int = 0) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``cut_documents``."""
    groups = max(1, -(-n_documents // group_documents))

    def pack_group(table: pa.Table) -> pa.Table:
        group = table["_group"][0].as_py()
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("doc_id", "start", "ids_crc32")]))
        bins, offsets = first_fit_decreasing(table["length"].to_pylist(), length)
        made = {"sequence_id": pa.array((np.int64(group) << 32) + np.asarray(bins, np.int64)), "offset": pa.array(offsets, pa.int64())}
        table = table.drop_columns([DEAL, "_group"])
        for name, column in made.items():
            table = table.append_column(name, column)
        return table

    schema = StructType([*(f for f in pieces.schema.fields if f.name != DEAL), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64(F.col(DEAL), F.lit(seed)), F.lit(groups)))
    return grouped.groupBy("_group").applyInArrow(pack_group, schema)


def sequences(packed: DataFrame, length: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The padded id sequences of packed pieces that carry ``ids``: sequence_id, n_tokens, ids."""
    joined = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return joined.select("sequence_id", "n_tokens", F.concat(ids, F.array_repeat(F.lit(pad_id), (F.lit(length) - F.col("n_tokens")).cast("int"))).alias("ids"))


def pack_documents(docs: DataFrame, end_id: int = 1) -> DataFrame:
    return pack(cut_documents(docs, end_id), docs.count())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))

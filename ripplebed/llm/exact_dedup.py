"""Exact deduplication by distributed most-significant-digit radix partitioning.

Texts are compared by their own bytes; no digest decides.  Each task first splits
the texts of a bounded buffer by successive runs of bytes until every group is a
single text or has ended, so of equal texts there it passes on one, with the
rows it stands for.  The texts that remain are split again across tasks: level by
level a digit of the next bytes divides every group, singletons leave, and groups
whose bytes fit a task are finished inside one by the same recursion.  Only groups
that are still too large, such as many texts with one long opening, go to the next
level, whose digit is longer; the last level has passed the end of every text.

Defined results: texts are equal if identical after lower-casing A-Z; a null text
counts as empty; of equal texts the row with the largest doc_id stays, nulls last,
and of rows that also share that id, one; texts may be of any length (a task holds the
longest one whole); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ripplebed.llm.base import bounded_batches, documents, id_and_text, small_batches, staged, text_bytes, text_of

#: Bytes of text in the buffer that a task splits at once.
BUFFER = 12 << 20
#: Bytes of a group that one task may finish.
GROUP = 4 << 20
#: Rows of the undecided that may be broadcast, 24 bytes each; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Width of the first digit across tasks; each further one is four times as wide.
DIGIT = 32


def radix_classes(texts: list[bytes]) -> list[list[int]]:
    """Indices of equal texts, by splitting on successive runs of bytes until groups are single or ended."""
    done, todo = [], [(list(range(len(texts))), 0, 8)]
    while todo:
        group, at, width = todo.pop()
        if len(group) == 1:
            done.append(group)
            continue
        ended, parts = defaultdict(list), defaultdict(list)
        for i in group:
            digit = texts[i][at : at + width]
            # A short digit means that the text ends here: what is equal now is equal throughout.
            (parts if len(digit) == width else ended)[digit].append(i)
        done += ended.values()
        todo += [(part, at + width, min(4 * width, 1 << 16)) for part in parts.values()]
    return done


def _buffers(batches):
    """doc_id, normalised text and second column of so many rows as fill the buffer."""
    ids, texts, docs, size = [], [], [], 0
    for batch in small_batches(batches, 4 << 20):
        ids += batch.column(0).to_pylist()
        new = [t.lower() for t in text_bytes(text_of(batch, 1))]  # of bytes: A-Z alone
        texts += new
        docs.append(batch.column(1))
        size += sum(map(len, new))
        if size >= BUFFER:
            yield ids, texts, docs
            ids, texts, docs, size = [], [], [], 0
    if ids:
        yield ids, texts, docs


def _top(ids: list, group: list[int]) -> int:
    """The row with the largest id, nulls last; of several the last."""
    return max(group, key=lambda i: (ids[i] is not None, ids[i] or 0, i))


def _local(batches):
    """One row for each input row; of equal texts in the buffer, the row with the largest id carries the text."""
    from pyspark import TaskContext

    part, row = TaskContext.get().partitionId(), 0
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
    for ids, texts, _ in _buffers(batches):
        names = [(part << 40) + row + i for i in range(len(ids))]
        row += len(ids)
        out = []
        for group in radix_classes(texts):
            top = _top(ids, group)
            sha = hashlib.sha256(texts[top]).hexdigest()
            for i in group:
                first = i == top
                out.append((names[i], ids[i], names[top], ids[top], sha, texts[i] if first else None, len(group) if first else None))
        columns = list(zip(*out, strict=True))
        for at in range(0, len(out), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 2000], k) for c, k in zip(columns, kinds, strict=True)], names=["row", "doc_id", "rep", "rep_id", "sha", "text", "n"])


def _local_first(batches):
    """Of equal texts in the buffer, the row with the largest id, whole, and how many it stands for."""
    from pyspark import TaskContext

    part, row = TaskContext.get().partitionId(), 0
    for ids, texts, docs in _buffers(batches):
        groups = radix_classes(texts)
        tops = [_top(ids, group) for group in groups]
        kept = pa.concat_arrays(docs).take(pa.array(tops, pa.int64()))
        for at in range(0, len(tops), 2000):
            some = tops[at : at + 2000]
            columns = [
                pa.array([(part << 40) + row + i for i in some], pa.int64()), pa.array([ids[i] for i in some], pa.int64()),
                pa.array([texts[i] for i in some], pa.binary()), pa.array([len(g) for g in groups[at : at + 2000]], pa.int64()), kept.slice(at, 2000),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "rep_id", "text", "n", "doc"])
        row += len(ids)


LOCAL = "row long, doc_id long, rep long, rep_id long, sha string, text binary, n long"


def _finish(batches):
    """Rows sorted by group: each representative with the one of its class whose id is largest, and the class's rows."""

    def classes(rows):
        for same in radix_classes([r[3] for r in rows]):
            top = max(same, key=lambda i: (rows[i][2] is not None, rows[i][2] or 0, rows[i][1]))
            total = sum(rows[i][4] for i in same)
            for i in same:
                yield rows[i][1], rows[top][1], rows[top][2], total

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["rep", "keep", "keep_id", "group_size"])

    group, out = [], []
    for batch in small_batches(batches, column=3):
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[0][0] != r[0]:
                out += classes(group)
                group = []
            group.append(r)
        if len(out) >= 2000:
            yield table(out)
            out = []
    out += classes(group)
    if out:
        yield table(out)


def radix_groups(reps: DataFrame, digit: int = DIGIT, group_bytes: int = GROUP) -> DataFrame:
    """rep, keep, keep_id, group_size for rows of rep, rep_id, text (binary) and n."""
    settled, n_rows = [], reps.count()
    left = reps.select(F.lit(0).cast("long").alias("grp"), "rep", "rep_id", "text", "n")
    at, width = 1, digit
    while True:
        key = F.substring("text", at, width)
        keyed = left.select("grp", key.alias("digit"), "rep", "rep_id", "n", F.length("text").alias("size"))
        groups = keyed.groupBy("grp", "digit").agg(
            F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("rep").alias("sub"), F.max("size").alias("longest"), F.sum("n").alias("total"), F.max(F.struct("rep_id", "rep")).alias("top")
        )
        groups = staged(groups, "radix", n_rows, 128)
        # Where the longest text has ended, all of the group are equal; they need no text any more, nor does a single row.
        ended = (F.col("rows") > 1) & (F.col("longest") < at + width)
        top = (F.col("top.rep").alias("keep"), F.col("top.rep_id").alias("keep_id"), F.col("total").alias("group_size"))
        settled.append(groups.where("rows = 1").select(F.col("sub").alias("rep"), *top))
        settled.append(keyed.select("grp", "digit", "rep").join(groups.where(ended).drop("rows", "sub"), ["grp", "digit"]).select("rep", *top))
        small = F.col("bytes") <= group_bytes
        more = groups.where((F.col("rows") > 1) & ~ended).select("grp", "digit", "sub", "bytes")
        large = more.where(~small).limit(1).count()
        # Texts of rows that are settled stay where they are: the others are picked by their numbers first.
        open_ = staged(keyed.select("grp", "digit", "rep").join(more, ["grp", "digit"]).select("rep", "sub", "bytes"), "radix-open", n_rows, 24)
        open_ = F.broadcast(open_) if open_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else open_
        joined = left.join(open_, "rep").select(F.col("sub").alias("grp"), "rep", "rep_id", "text", "n", "bytes")
        ready = joined.where(small).select("grp", "rep", "rep_id", "text", "n").repartition("grp").sortWithinPartitions("grp")
        settled.append(ready.mapInArrow(_finish, "rep long, keep long, keep_id long, group_size long"))
        if not large:
            break
        left = staged(joined.where(~small).select("grp", "rep", "rep_id", "text", "n"), "radix-left")
        at, width = at + width, width * 4
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = staged(id_and_text(docs).mapInArrow(_local, LOCAL), "local")
    found = radix_groups(rows.where("rep = row").select("rep", "rep_id", "text", "n"))
    joined = rows.select("row", "doc_id", "rep", "sha").join(found, "rep")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The row of one document of each class, as ``classes`` would keep it."""
    told = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*docs.columns).alias("doc"))
    schema = StructType([*StructType.fromDDL("rep long, rep_id long, text binary, n long"), StructField("doc", told.schema["doc"].dataType)])
    reps = staged(told.mapInArrow(_local_first, schema), "local")
    kept = radix_groups(reps.select("rep", "rep_id", "text", "n")).where("keep = rep").select("rep")
    return reps.join(kept, "rep", "left_semi").select("doc.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""

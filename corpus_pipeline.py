"""The corpus pipeline: quality rules, language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of ``documents``.  A stage removes the tables that
it wrote on the way and that its result doesn't read.  The others go once a stage is
called, in the same thread, with a copy of that result as ``docs``: as many rows with the
same ids.  Other results are never touched.  ``run`` keeps a book of its own: a stage's
result is written, and read again as the next one's ``docs``; what it was made from then
goes.

Defined results, whatever the stage: rows go through by themselves, so rows without
doc_id, with another's doc_id, or alike in all columns are judged each on its own
text; a null text is empty and falls by the quality rules, as do texts of fewer than
ten words; texts may be of any length; an empty table gives an empty table; columns
may have the names of columns that the stages use.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplebed.llm import exact_dedup, language_id, minhash, packing, quality_rules
from ripplebed.llm.base import collected, reads, remove, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: This thread's results that still read tables of their stage, and these tables.
_LIVE: ContextVar[list[tuple[DataFrame, list[str]]] | None] = ContextVar("live", default=None)


def is_copy(docs: DataFrame, result: DataFrame) -> bool:
    """Whether ``docs`` has as many rows as ``result``, and the same ids; texts aren't read for that."""
    if docs.columns != result.columns:
        return False
    told = [F.count(F.lit(1)), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)"))]
    return docs.agg(*told).first() == result.agg(*told).first()


def stage(f: Stage) -> Stage:
    """Removes tables that no result reads any more: of a stage's own, and of the result that it gets a copy of."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        live = _LIVE.get()
        if live is None:
            _LIVE.set(live := [])
        for i in reversed(range(len(live))):
            if is_copy(docs, live[i][0]):
                for path in live.pop(i)[1]:
                    remove(spark, path)
                break
        with collected() as paths:
            out = f(spark, docs, sf_dir)
        needed = reads(out, paths)
        for path in paths:
            if path not in needed:
                remove(spark, path)
        if needed:
            live.append((out, needed))
        return out

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.keep_identified(docs)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (similarity 0.8 over five-word shingles), the document with the smallest id."""
    return minhash.drop_near_copies(docs, percent=80)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [("quality rules", quality), ("language id", language), ("exact dedup", exact), ("near dedup", near), ("packing", pack)]

#: SQL has neither the network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    before = _LIVE.set([])
    try:
        for name, step in STAGES:
            with collected() as paths:
                docs = staged(step(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            _LIVE.get().clear()
            # Nothing reads these any more: the result lies in the table that was written last.
            *done, new = paths
            for path in [*done, *filter(None, [last])]:
                remove(spark, path)
            last = new
    finally:
        _LIVE.reset(before)
    return docs

"""Recordings as a stream: files that arrive in a folder are preprocessed batch by batch.

An extension of the batch runs with the same stages; the checkpoint remembers the
files, so each is taken once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ripplebed.operators import sinks
from ripplebed.operators.layout import stem
from ripplebed.plans.config import PipelineConfig
from ripplebed.plans.pipeline import preprocess
from ripplebed.sources import committed, edf

FILES = "path string, modificationTime timestamp, length long, content binary"


#: Batches after which the manifests of a committed stream are put into one.
FOLDED = 64


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, cfg: PipelineConfig, into: str = "runs") -> StreamingQuery:
    """Start a query that appends the windows of new .edf files to ``out``: as a run for each batch, or ``into`` "committed", the sink whose manifests are folded from time to time."""
    if into not in ("runs", "committed"):
        raise ValueError(f"no such sink: {into!r}")
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.edf").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        # A run for each batch: one that is tried again takes the place of what it wrote before.
        recordings = edf.parse_files(batch)
        if into == "committed":
            committed.write(preprocess(recordings, cfg), out, f"batch-{number}")
            if number % FOLDED == FOLDED - 1:
                committed.fold(out)
            return
        attempted = batch.select("path", stem(F.col("path")).alias("stem"))
        sinks.append(preprocess(recordings, cfg), attempted, out, f"batch-{number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Runs over a folder or list of recordings: skip what is done, preprocess, write, compact."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession

from ripplebed.operators import sinks
from ripplebed.plans.config import PipelineConfig, from_yaml
from ripplebed.plans.pipeline import Pipeline
from ripplebed.sources import committed, edf, edf_ranges

#: MB of a compacted file, of windows and of labelled ones.
FILE_MB, LABELLED_MB = 2000.0, 4000.0


def run(spark: SparkSession, source: str, out: str, pipeline: PipelineConfig | Pipeline, labelled: bool = False, mode: str = "append", key: str = "stem") -> DataFrame:
    """Windows of the files that no earlier run attempted.  Tasks come out even, as Spark packs files into them by size."""
    pipeline = Pipeline(pipeline) if isinstance(pipeline, PipelineConfig) else pipeline
    paths = edf.list_files(spark, source)
    if mode == "append":
        paths = sinks.pending(spark, paths, out, key)
    if not paths.isEmpty():
        recordings = edf.read_listed(spark, paths)
        made = pipeline.labelled(recordings) if labelled else pipeline.windows(recordings)
        sinks.append(made, paths, out, uuid.uuid4().hex, mode)
    return sinks.windows(spark, out)


def run_committed(spark: SparkSession, source: str, out: str, pipeline: PipelineConfig | Pipeline, labelled: bool = False, run_id: str | None = None, names: str = "unique") -> DataFrame:
    """The same into the sink ``committed``: counted and checksummed as it is written; returns the counters.

    Every file that was attempted has a row there, if only one that tells why it was
    dropped, so what is written is also what is done.
    """
    pipeline = Pipeline(pipeline) if isinstance(pipeline, PipelineConfig) else pipeline
    paths = edf.list_files(spark, source)
    if not committed.manifest(spark, out).isEmpty():
        paths = paths.join(committed.read(spark, out).select("stem").distinct(), "stem", "left_anti")
    if not paths.isEmpty():
        recordings = edf_ranges.read_paths(paths)
        made = pipeline.labelled(recordings) if labelled else pipeline.windows(recordings)
        committed.write(made, out, run_id or uuid.uuid4().hex, names=names)
    return committed.counters(spark, out)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--config", required=True)
    p.add_argument("--labelled", action="store_true", help="windows around annotations, which are compacted after the run")
    p.add_argument("--compact", help="compact into this new folder after the run (labelled: OUT_combined unless told)")
    p.add_argument("--no_compact", action="store_true", help="leave labelled windows as they are")
    p.add_argument("--max_file_size", type=float, help="MB of a compacted file")
    p.add_argument("--delete_source", action="store_true", help="delete the windows that were compacted; else they stay")
    p.add_argument("--swap", action="store_true", help="with --delete_source: the compacted folder takes their place")
    p.add_argument("--committed", action="store_true", help="write into the sink that counts and checksums what it writes; nothing is compacted")
    told = p.parse_args(args)
    pipeline, rest = from_yaml(told.config)
    spark = SparkSession.builder.getOrCreate()
    out = rest["out_path"].rstrip("/")
    if told.committed:
        run_committed(spark, rest["dataset_path"], out, pipeline, told.labelled).show()
        return
    run(spark, rest["dataset_path"], out, pipeline, told.labelled, "overwrite" if rest.get("overwrite") else "append")
    target = told.compact or (f"{out}_combined" if told.labelled and not told.no_compact else None)
    if target:
        size = told.max_file_size or (LABELLED_MB if told.labelled else FILE_MB)
        sinks.compact(spark, out, target, size, ["start_sample", "ann_idx"] if told.labelled else ["start_sample"], told.delete_source, told.swap)
    sinks.counters(spark, out if sinks._there(spark, out) else target).show()


if __name__ == "__main__":
    main()

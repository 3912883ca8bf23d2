"""Cleaning of long recordings in chunks, and labelled windows from them.

The stages that can be told exactly from a chunk and its surroundings, or from sums over
chunks, are the line's noise, filters and the average reference; they give what the
whole recording's kernels give.  Stages that need all samples of a channel at once (bad
channels, components, robust trends) are refused: they work on windows cut from here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplebed.functions import kernels as K
from ripplebed.operators import chunks as C
from ripplebed.operators import windows as W
from ripplebed.plans.config import PipelineConfig

WINDOW = "path string, ann_idx long, description string, label int, start_sample long, sfreq double, t_start double, t_end double, ch_names array<string>, status string, drop_reason string, data array<array<double>>"


def _line(chunks: DataFrame, cfg: PipelineConfig) -> DataFrame:
    for line in cfg.line:
        chunks = C.without_line(chunks, line)
    return chunks


STAGES = {
    "line_noise": _line,
    "notch": lambda chunks, cfg: C.filtered(chunks, lambda sfreq: K.notch_steps(sfreq, list(cfg.line))),
    "filter": lambda chunks, cfg: C.filtered(chunks, lambda sfreq: K.band_pass_steps(sfreq, cfg.hp_freq, cfg.lp_freq)),
    "average_reference": lambda chunks, cfg: C.average_reference(chunks),
}


def clean(chunks: DataFrame, cfg: PipelineConfig, stages: tuple[str, ...] = ("line_noise", "filter", "average_reference")) -> DataFrame:
    """Chunks that went through the stages, in their order."""
    if unknown := [s for s in stages if s not in STAGES]:
        raise ValueError(f"not for chunks: {unknown}; known are {sorted(STAGES)}")
    for s in stages:
        chunks = STAGES[s](chunks, cfg)
    return chunks


def events_of(chunks: DataFrame) -> DataFrame:
    """The annotations of recordings, numbered as they stand: path, sfreq, n_times, length, ann_idx, onset, duration, description."""
    told = chunks.where("status = 'ok'").select("path", "sfreq", "n_times", "length", "chunk", F.posexplode("annotations").alias("nth", "a"))
    number = (F.row_number().over(Window.partitionBy("path").orderBy("chunk", "nth")) - 1).cast("long")
    return told.select("path", "sfreq", "n_times", "length", number.alias("ann_idx"), "a.onset", "a.duration", "a.description")


def labelled_windows(chunks: DataFrame, events: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """One window, at the configuration's rate, around each of ``events`` (as ``events_of`` gives them) that lies within its recording.

    A window goes to the chunks that it touches, by (path, chunk); each gives its part,
    and the parts of one window meet in one group.
    """
    wanted = list(cfg.descriptions)
    start, n = W.event_bounds(F.col("onset"), F.lit(cfg.sfreq), cfg.tmin, cfg.tlen)
    scale = F.lit(cfg.sfreq) / F.col("sfreq")
    placed = events.where(F.col("description").isin(wanted)).select("*", start.alias("s"), n.alias("n"), W.label_of(F.col("description"), wanted).alias("label"))
    placed = placed.where((F.col("s") >= 0) & (F.col("n") > 0) & (F.col("s") + F.col("n") <= F.floor(F.col("n_times") * scale)))
    from_chunk = F.floor(F.col("s") / scale / F.col("length")).cast("long")
    to_chunk = F.floor((F.col("s") + F.col("n") - 1) / scale / F.col("length")).cast("long")
    # One chunk more on both sides, as a rate's fraction may round either way.
    reach = F.sequence(F.greatest(from_chunk - 1, F.lit(0).cast("long")), to_chunk + 1)
    asked = placed.select("path", F.explode(reach).alias("chunk"), "ann_idx", "description", "label", "s", "n")
    names = [f.split()[0] for f in PARTS.split(", ")]

    def cut(batches):
        for batch in batches:
            for i, r in enumerate(batch.drop_columns(["data"]).to_pylist()):
                x, a = C.matrix(batch.column("data"), i), r["start_sample"]
                at = np.minimum(np.floor(np.arange(r["s"], r["s"] + r["n"]) / (cfg.sfreq / r["sfreq"])).astype(np.int64), r["n_times"] - 1)
                mine = np.flatnonzero((at >= a) & (at < a + (x.shape[1] if x is not None else 0)))
                if len(mine):
                    row = [r["path"], r["ann_idx"], r["description"], r["label"], r["s"], r["n"], int(mine[0]), r["ch_names"]]
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(row, PART_TYPES, strict=True)), C.nested(x[:, at[mine] - a])], names=names)

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows, data = table.drop_columns(["data"]).to_pylist(), table.column("data").combine_chunks()
        order = sorted(range(len(rows)), key=lambda i: rows[i]["at"])
        r, parts = rows[order[0]], [C.matrix(data, i) for i in order]
        whole = sum(p.shape[1] for p in parts) == r["n"] and all(len(p) == len(parts[0]) for p in parts)
        x = np.concatenate(parts, axis=1).astype(np.float64) if whole else None
        values = [r["path"], r["ann_idx"], r["description"], r["label"], r["s"], cfg.sfreq, r["s"] / cfg.sfreq, (r["s"] + r["n"] - 1) / cfg.sfreq, r["ch_names"], "ok" if whole else "error", None if whole else "a chunk is missing"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.string(), pa.string()]
        return pa.Table.from_arrays([*(pa.array([v], k) for v, k in zip(values, kinds, strict=True)), C.nested(x)], names=[f.split()[0] for f in WINDOW.split(", ")])

    ok = chunks.where("status = 'ok'").select("path", "chunk", "start_sample", "sfreq", "n_times", "ch_names", "data")
    return ok.join(asked, ["path", "chunk"]).mapInArrow(cut, PARTS).groupBy("path", "ann_idx").applyInArrow(join, WINDOW)


PARTS = "path string, ann_idx long, description string, label int, s long, n long, at long, ch_names array<string>, data array<array<double>>"
PART_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]

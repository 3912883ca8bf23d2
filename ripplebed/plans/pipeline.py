"""Recordings to clean, fixed-shape windows.

Names, montage, cutting, channel order and resampling of the base profile are
column expressions; cleaning runs in numpy on one window (or, for labelled
windows, one recording) at a time, with no shuffle.  A file or window that can't go
on keeps a row with its status and the reason; ``ok`` takes those that came through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from ripplebed.functions.montage import positions
from ripplebed.operators import channels as C
from ripplebed.operators import windows as W
from ripplebed.plans.config import PipelineConfig
from ripplebed.plans.stages import Dropped, Signal, resolved

TOLD = [
    StructField("bad_chs", ArrayType(StringType())), StructField("missing_chs", ArrayType(StringType())), StructField("extra_chs", ArrayType(StringType())),
    StructField("ica_excluded", ArrayType(IntegerType())), StructField("ica_labels", ArrayType(StringType())), StructField("ica_proba", ArrayType(DoubleType())), StructField("notes", ArrayType(StringType())),
    StructField("status", StringType()), StructField("drop_reason", StringType()), StructField("data", ArrayType(ArrayType(FloatType()))),
]


def too_short(cfg: PipelineConfig) -> Column:
    return (F.col("n_times") - 1) / F.col("sfreq") < 1.5 * cfg.window_length


def long_enough(recordings: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return recordings.where(~too_short(cfg))


def standard_names(recordings: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """ch_names in standard form, and drop_reason where that isn't possible."""
    raw = F.transform("ch_names", lambda n: C.renamed(n, renames))
    typed = recordings.withColumn("_raw", raw).withColumn("_type", F.zip_with("_raw", "ch_types", lambda n, t: C.channel_type(n, t)))
    d = typed.withColumn("_names", F.zip_with("_raw", "_type", lambda n, t: C.resolved(C.cleaned(n), t)))
    unknown = F.exists("_type", lambda t: ~t.isin("eeg", "eog", "ecg", "ref", "extra"))
    empty = F.exists("_names", lambda n: n.isNull())
    d = d.withColumn("_cased", F.transform(C.copies(F.col("_names")), lambda n: C.modern(C.cased(n))))
    twice = F.size(F.array_distinct("_cased")) < F.size("_cased")
    reason = F.when(unknown, "unknown_channel_type").when(empty, "empty_name").when(twice, "duplicate_name")
    return d.withColumn("ch_names", F.col("_cased")).withColumn("drop_reason", reason).drop("_raw", "_type", "_names", "_cased")


def on_montage(df: DataFrame, montage: str = "tuh") -> DataFrame:
    """Channels with a position alone, and ``dropped_chs``."""
    known = F.array(*map(F.lit, sorted(positions(montage))))
    # One after the other: inside a lambda a name would stand for the new column of that name.
    df = df.withColumn("dropped_chs", F.array_except("ch_names", known))
    df = df.withColumn("data", F.filter("data", lambda x, i: F.array_contains(known, F.get("ch_names", i))))
    return df.withColumn("ch_names", F.filter("ch_names", lambda n: F.array_contains(known, n)))


def prepared(recordings: DataFrame, cfg: PipelineConfig, rename: bool = True, all_lengths: bool = True) -> DataFrame:
    """All recordings with their channels by standard names; without data where status is not "ok", for a reason that is given."""
    d = standard_names(recordings, cfg.channels_rename if rename else None)
    unread, short = F.col("status") != "ok", F.lit(False) if all_lengths else too_short(cfg)
    reason = F.when(unread, F.col("error")).when(short, "too_short").otherwise(F.col("drop_reason"))
    status = F.when(unread, F.col("status")).when(short | F.col("drop_reason").isNotNull(), "dropped").otherwise("ok")
    d = on_montage(d.withColumns({"status": status, "drop_reason": reason}).drop("error"), cfg.montage_name)
    return d.withColumn("data", F.when(F.col("status") == "ok", F.col("data")))


def without_window(windows: DataFrame, key: str, reason: str) -> DataFrame:
    """Rows of recordings from which no window came, as dropped."""
    none = (F.col("status") == "ok") & F.col(key).isNull()
    return windows.withColumns({"drop_reason": F.when(none, reason).otherwise(F.col("drop_reason")), "status": F.when(none, "dropped").otherwise(F.col("status"))})


def _float(data: Column) -> Column:
    return F.transform(data, lambda row: F.transform(row, lambda v: v.cast("float")))


def base_windows(windows: DataFrame, cfg: PipelineConfig, width: Column) -> DataFrame:
    """Zero-fill, order and resample, without cleaning; all in column expressions."""
    target = list(cfg.channels)
    rows = C.zero_filled(C.reordered(F.col("ch_names"), F.col("data"), target), width)
    data = F.transform(rows, lambda row: C.resampled(row, F.col("sfreq"), cfg.sfreq))
    good = lambda x: F.when(F.col("status") == "ok", x)
    return windows.withColumns({"missing_chs": good(C.missing(F.col("ch_names"), target)), "extra_chs": good(F.array_except("ch_names", F.array(*map(F.lit, target)))), "data": good(_float(data))})


def clean_one(signal: Signal, run: Callable[[Signal], None]) -> dict:
    """One window or recording through the cleaning stages; an error becomes its status."""
    try:
        run(signal)
    except Dropped as e:
        return signal.told | {"status": "dropped", "drop_reason": str(e)}
    except Exception as e:  # noqa: BLE001  one bad window must not end the others
        return signal.told | {"status": "error", "drop_reason": f"{type(e).__name__}: {e}"}
    return signal.told | {"status": "ok", "drop_reason": None, "data": signal.x.astype(np.float32)}


def cleaned_rows(df: DataFrame, cfg: PipelineConfig, run: Callable[[Signal], None], gated: bool, key: list[str]) -> DataFrame:
    """``df`` with cleaned data and what was done; rows whose status is not "ok" pass as they are."""
    passed = [c for c in df.columns if c not in ("data", "ch_names", "status", "drop_reason")]
    schema = StructType([df.schema[c] for c in passed] + TOLD)

    def clean(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                made = {"status": r["status"], "drop_reason": r["drop_reason"]}
                if r["status"] == "ok":
                    seed = zlib.crc32("|".join(str(r[k]) for k in key).encode()) ^ cfg.seed
                    made = clean_one(Signal(np.array([np.asarray(x, float) for x in r["data"]]), list(r["ch_names"]), float(r["sfreq"]), seed, cfg, gated), run)
                data = made.pop("data", None)
                rows.append({c: r[c] for c in passed} | {f.name: None for f in TOLD} | made | {"data": None if data is None else list(data)})
            out = pd.DataFrame(rows, columns=[f.name for f in schema], dtype=object)
            for f in schema:
                if f.dataType.typeName() in ("long", "integer"):
                    out[f.name] = out[f.name].astype("Int64")
            yield out

    return df.select(*passed, "ch_names", "data", "status", "drop_reason").mapInPandas(clean, schema)


class Pipeline:
    """Recordings to windows, by a configuration.

    A subclass may override ``run_single``, which changes a ``Signal``: its windows
    then go through that.  The functions below use this class itself.
    """

    def __init__(self, cfg: PipelineConfig):
        self.cfg = cfg
        self.functions = resolved(cfg.stages)

    def run_single(self, signal: Signal) -> None:
        for stage in self.functions:
            stage(signal)

    def _rows(self, d: DataFrame, gated: bool, key: list[str]) -> DataFrame:
        if not self.cfg.clean and type(self).run_single is Pipeline.run_single:
            return base_windows(d, self.cfg, F.size(F.get("data", F.lit(0))))
        return cleaned_rows(d, self.cfg, self.run_single, gated, key)

    def windows(self, recordings: DataFrame, all_lengths: bool = False) -> DataFrame:
        """Fixed windows of all recordings (path, sfreq, n_times, ch_names, ch_types, data, status, error) for pretraining.

        With ``all_lengths`` short recordings take part and names are taken as they are, as for work by hand in a notebook.
        """
        d = prepared(recordings, self.cfg, rename=self.cfg.clean and not all_lengths, all_lengths=all_lengths)
        d = d.drop("annotations") if "annotations" in d.columns else d
        return self._rows(without_window(W.split_recordings(d, self.cfg.window_length, keep_empty=True), "win_idx", "no_window"), True, ["path", "win_idx"])

    def labelled(self, recordings: DataFrame) -> DataFrame:
        """Labelled windows around annotations, cut after the whole recording is cleaned and resampled; each file is read once."""
        cfg = self.cfg
        done = self._rows(prepared(recordings, cfg), False, ["path"]).withColumns({"sfreq": F.lit(cfg.sfreq), "file_id": F.col("path")})
        return without_window(W.split_annotated(done, list(cfg.descriptions), cfg.tmin, cfg.tlen, keep_empty=True), "ann_idx", "no_event")


def preprocess(recordings: DataFrame, cfg: PipelineConfig, all_lengths: bool = False) -> DataFrame:
    return Pipeline(cfg).windows(recordings, all_lengths)


def preprocess_labelled(recordings: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return Pipeline(cfg).labelled(recordings)


def ok(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'ok'")

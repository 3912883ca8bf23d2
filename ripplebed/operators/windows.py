"""Cutting recordings into windows of fixed length, around events, or between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_windows(df: DataFrame, by: list[str], order: list[str], width: int) -> DataFrame:
    """Tall rows: win_idx and pos within the window; a last window that isn't full is left out."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    placed = df.withColumn("_n", n).withColumn("_all", F.count("*").over(Window.partitionBy(*by)))
    placed = placed.where(F.col("_n") < F.col("_all") - F.col("_all") % width)
    return placed.withColumns({"win_idx": F.floor(F.col("_n") / width), "pos": F.col("_n") % width}).drop("_n", "_all")


def _cut(start: Column, width: Column) -> Column:
    """The samples of all channels from ``start`` (from 0) on."""
    return F.transform("data", lambda ch: F.slice(ch, start.cast("int") + 1, width.cast("int"))).alias("data")


def split_recordings(df: DataFrame, window_s: float, keep_empty: bool = False) -> DataFrame:
    """Recordings (one row, data array<array<double>>) into windows of int(window_s * sfreq) samples.

    The windows are cut within the row, so a recording is not copied for each of
    them.  With ``keep_empty`` a recording without a window keeps a row, of nulls.
    """
    width = F.floor(F.lit(window_s) * F.col("sfreq")).cast("int")
    n = F.size(F.get("data", F.lit(0)))
    cut = F.transform(F.sequence(F.lit(0), F.floor(n / width).cast("int") - 1), lambda i: F.struct(i.alias("win_idx"), (i * width).cast("long").alias("start_sample"), width.alias("n"), _cut(i * width, width)))
    explode = F.explode_outer if keep_empty else F.explode
    out = df.select(*[c for c in df.columns if c != "data"], explode(F.when(n >= width, cut)).alias("_w"))
    return _named(out, "win_idx")


def _named(out: DataFrame, *keys: str) -> DataFrame:
    """The windows in ``_w`` as columns: what tells them apart, their place and their samples."""
    start = F.col("_w.start_sample")
    return out.select(
        *[c for c in out.columns if c != "_w"],
        *[F.col(f"_w.{k}").alias(k) for k in keys],
        start.alias("start_sample"),
        (start / F.col("sfreq")).alias("t_start"),
        ((start + F.col("_w.n") - 1) / F.col("sfreq")).alias("t_end"),
        F.col("_w.data").alias("data"),
    )


def event_bounds(onset: Column, sfreq: Column, tmin: float, tlen: float) -> tuple[Column, Column]:
    """First sample and length of a window around an event; halves round to even."""
    return F.bround((onset + tmin) * sfreq).cast("long"), F.bround(F.lit(tlen) * sfreq).cast("long")


def label_of(description: Column, descriptions: list[str]) -> Column:
    """The place of a description among those wanted, the last one of a repeated one; null for others."""
    known = {d: i for i, d in enumerate(descriptions)}
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), description).cast("int")


def split_annotated(recordings: DataFrame, descriptions: list[str], tmin: float = -0.5, tlen: float = 5.0, keep_empty: bool = False) -> DataFrame:
    """One labelled window for each annotation (array<struct<onset, description, ...>>) whose bounds lie within its recording.

    ``ann_idx`` is the annotation's own field of that name, or else its place.  Windows are cut within the row: no join, and no recording is moved or copied.
    With ``keep_empty`` a recording without a window keeps a row, of nulls.
    """
    n_all = F.size(F.get("data", F.lit(0)))
    numbered = "ann_idx" in recordings.schema["annotations"].dataType.elementType.names

    def window(a: Column, i: Column) -> Column:
        start, n = event_bounds(a["onset"], F.col("sfreq"), tmin, tlen)
        return F.struct((a["ann_idx"] if numbered else i).alias("ann_idx"), a["description"].alias("description"), label_of(a["description"], descriptions).alias("label"), start.alias("start_sample"), n.alias("n"))

    found = F.filter(F.transform("annotations", window), lambda w: w["description"].isin(descriptions) & (w["start_sample"] >= 0) & (w["start_sample"] + w["n"] <= n_all))
    cut = F.transform(found, lambda w: F.struct(w["ann_idx"].alias("ann_idx"), w["description"].alias("description"), w["label"].alias("label"), w["start_sample"].alias("start_sample"), w["n"].alias("n"), _cut(w["start_sample"], w["n"])))
    explode = F.explode_outer if keep_empty else F.explode
    out = recordings.select(*[c for c in recordings.columns if c not in ("data", "annotations")], explode(cut).alias("_w"))
    return _named(out, "ann_idx", "description", "label")


#: Annotations that are gathered to one copy of their recording.
GATHERED = 1000


def split_events(recordings: DataFrame, annotations: DataFrame, descriptions: list[str], tmin: float = -0.5, tlen: float = 5.0) -> DataFrame:
    """The same for annotations in a table of their own (file_id, ann_idx, onset, description), which are gathered to their recordings.

    A recording with many of them is copied for each ``GATHERED``, so that no row and
    no task takes all; long recordings are better cut from chunks.
    """
    told = annotations.where(F.col("description").isin(descriptions)).select("file_id", "ann_idx", "onset", "description")
    parts = told.groupBy("file_id").agg(F.ceil(F.count("*") / GATHERED).alias("_parts"))
    part = F.pmod(F.xxhash64("ann_idx", "onset"), F.col("_parts"))
    told = told.join(parts, "file_id").groupBy("file_id", part.alias("_part")).agg(F.sort_array(F.collect_list(F.struct("ann_idx", "onset", "description"))).alias("annotations"))
    return split_annotated(recordings.join(told.drop("_part"), "file_id"), descriptions, tmin, tlen)


def at_rest(description: Column, resting: list[str]) -> Column:
    """Whether an annotation tells of rest."""
    return description.isin(resting)


def unannotated(recordings: DataFrame, resting: list[str]) -> DataFrame:
    """Recordings without the stretches of annotations that don't tell of rest: what is left, joined end to end.

    Annotations count in the order of their onsets; a stretch begins where the one
    just before ended, though an earlier one may have ended later.  data is null
    where nothing is left.
    """
    n_all = F.size(F.get("data", F.lit(0)))
    rate = F.col("sfreq")
    whole = lambda x: x.cast("int")  # noqa: E731  towards zero
    busy = F.filter(F.transform("annotations", lambda a, i: F.struct(a["onset"].alias("onset"), i.alias("i"), a["duration"].alias("duration"), a["description"].alias("description"))), lambda a: ~at_rest(a["description"], resting))
    spans = F.transform(F.array_sort(busy), lambda a: F.struct(whole(a["onset"] * rate).alias("a"), whole((a["onset"] + a["duration"]) * rate).alias("b")))
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["b"]))
    ends = F.concat(F.transform(spans, lambda s: s["a"]), F.array(n_all))
    left = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda g: g["b"] > g["a"])
    data = F.transform("data", lambda ch: F.flatten(F.transform(left, lambda g: F.slice(ch, F.greatest(g["a"], F.lit(0)) + 1, g["b"] - F.greatest(g["a"], F.lit(0))))))
    return recordings.withColumn("data", F.when(F.size(left) > 0, data)).drop("annotations")


def gaps(intervals: DataFrame, by: list[str], start: str, end: str, order: list[str], total: Column) -> DataFrame:
    """The stretches between intervals and after the last; each begins where the interval just before ended."""
    w = Window.partitionBy(*by).orderBy(start, *order)
    before = intervals.select(*by, F.lag(end, 1, 0).over(w).alias("gap_start"), F.col(start).alias("gap_end"))
    last = intervals.groupBy(*by).agg(F.max_by(F.col(end), F.struct(start, *order)).alias("gap_start")).select(*by, "gap_start", total.alias("gap_end"))
    return before.unionByName(last).where("gap_end > gap_start")

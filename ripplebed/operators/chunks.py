"""Operators on recordings in chunks: overlap-save by exchanged edges, and statistics that merge.

A chunk is a row of path, chunk (from 0), its first sample, and channels x samples; all
chunks of a recording but the last have ``length`` samples.  An operator that looks
beyond a chunk's edges has every chunk send copies of what its neighbours need, by
(path, chunk); a task then holds a chunk with its surroundings and nothing more.  What
must be known of a whole recording is summed by chunks, then by ``FAN`` chunks, then by
recordings, so no task gets more than a few sums.

Defined results: chunks whose status isn't "ok" pass as they are; a chunk whose
neighbour failed or is missing fails with that reason; chunks of one recording must have
the same channels.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplebed.functions import kernels as K

NOTE = pa.struct([("onset", pa.float64()), ("duration", pa.float64()), ("description", pa.string())])
FIELDS = [
    ("path", pa.string()), ("chunk", pa.int64()), ("start_sample", pa.int64()), ("length", pa.int64()), ("n_times", pa.int64()), ("sfreq", pa.float64()), ("ch_names", pa.list_(pa.string())),
    ("annotations", pa.list_(NOTE)), ("status", pa.string()), ("error", pa.string()), ("data", pa.list_(pa.list_(pa.float64()))),
]
CHUNK = (
    "path string, chunk long, start_sample long, length long, n_times long, sfreq double, ch_names array<string>, "
    "annotations array<struct<onset: double, duration: double, description: string>>, status string, error string, data array<array<double>>"
)
META = [name for name, _ in FIELDS[:-1]]
PIECE = f"to long, own boolean, payload binary, {CHUNK}"
#: Chunks whose sums meet in one task before those of the recording do.
FAN = 64


def nested(x: np.ndarray | None) -> pa.ListArray:
    """Channels x samples as one value of a list of lists."""
    if x is None:
        return pa.array([None], FIELDS[-1][1])
    rows = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(np.ascontiguousarray(x, float).reshape(-1)))
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), rows)


def matrix(column: pa.Array, i: int) -> np.ndarray | None:
    """The channels x samples of row ``i``."""
    one = column.slice(i, 1)
    if one.null_count:
        return None
    rows = one.flatten()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def chunk_batch(meta: dict, data: np.ndarray | None) -> pa.RecordBatch:
    """One row of ``CHUNK``."""
    return pa.RecordBatch.from_arrays([*(pa.array([meta.get(name)], kind) for name, kind in FIELDS[:-1]), nested(data)], names=[name for name, _ in FIELDS])


@dataclass
class Region:
    """A chunk and its surroundings: samples from ``start`` on, of which those from ``a`` to ``b`` are the chunk's own."""

    x: np.ndarray
    start: int
    a: int
    b: int
    n_times: int
    sfreq: float
    payload: bytes | None

    def own(self, x: np.ndarray, start: int) -> np.ndarray:
        """The chunk's own samples of something that begins at ``start``."""
        return x[:, self.a - start : self.b - start]


def _sent(left: Callable[[float], int], right: Callable[[float], int]):
    """Every chunk as its own piece, and copies of its edges for the chunks around it."""

    def run(batches):
        for batch in batches:
            meta = batch.select(META).to_pylist()
            for i, m in enumerate(meta):
                x = matrix(batch.column("data"), i)
                whole = x is not None and m["status"] == "ok"
                rows = [(m["chunk"], True, 0, x)]
                if whole:
                    a, n, size = m["start_sample"], x.shape[1], m["length"]
                    before, after = left(m["sfreq"]), right(m["sfreq"])
                    last = (m["n_times"] - 1) // size
                    # Chunk k needs samples from k * size - before to (k + 1) * size + after.
                    for k in range(max(0, (a - after) // size), min(last, (a + n - 1 + before) // size) + 1):
                        if k != m["chunk"]:
                            lo, hi = max(a, k * size - before), min(a + n, (k + 1) * size + after)
                            if lo < hi:
                                rows.append((k, False, lo - a, x[:, lo - a : hi - a]))
                for to, own, shift, part in rows:
                    head = m | {"start_sample": None if m["start_sample"] is None else m["start_sample"] + shift, "annotations": m["annotations"] if own else None}
                    out = chunk_batch(head, part)
                    yield pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([own]), pa.array([None], pa.binary()), *out.columns], names=["to", "own", "payload", *out.schema.names])

    return run


def _gathered(table: pa.Table, left: Callable[[float], int], right: Callable[[float], int]) -> tuple[dict, Region | None, str | None]:
    """The chunk of a group of pieces, and its region or why there is none."""
    table = table.combine_chunks()
    meta = table.select([*META, "to", "own"]).to_pylist()
    payload = next((p for p in table.column("payload").to_pylist() if p is not None), None)
    mine = next((i for i, m in enumerate(meta) if m["own"]), None)
    if mine is None:
        return {}, None, "missing"
    head = meta[mine]
    data = table.column("data").combine_chunks()
    if head["status"] != "ok":
        return head, None, None
    pieces = sorted((m["start_sample"], i) for i, m in enumerate(meta) if m["start_sample"] is not None and m["status"] == "ok")
    parts = [matrix(data, i) for _, i in pieces]
    a = head["start_sample"]
    b = a + parts[[i for _, i in pieces].index(mine)].shape[1]
    at = max(0, a - left(head["sfreq"]))
    for (start, _), part in zip(pieces, parts, strict=True):
        if start != at or len(part) != len(parts[0]):
            return head, None, "a neighbour is missing or differs"
        at += part.shape[1]
    if at < min(head["n_times"], b + right(head["sfreq"])):
        return head, None, "a neighbour is missing or differs"
    return head, Region(np.concatenate(parts, axis=1), pieces[0][0], a, b, head["n_times"], head["sfreq"], payload), None


def _exchanged(chunks: DataFrame, left, right, payloads: DataFrame | None) -> DataFrame:
    pieces = chunks.select(*(n for n, _ in FIELDS)).mapInArrow(_sent(left, right), PIECE)
    if payloads is not None:
        pieces = pieces.unionByName(payloads.select("path", F.col("chunk").alias("to"), F.lit(False).alias("own"), "payload"), allowMissingColumns=True)
    return pieces


def mapped(chunks: DataFrame, kernel: Callable[[Region], np.ndarray], left: Callable[[float], int] = lambda _: 0, right: Callable[[float], int] = lambda _: 0, payloads: DataFrame | None = None) -> DataFrame:
    """Chunks with the samples that ``kernel`` gives for each region.

    ``left`` and ``right`` tell, by the sampling rate, how many samples a chunk needs
    beyond its own; ``payloads`` (path, chunk, payload) are handed to the kernel.
    """

    def run(table: pa.Table) -> pa.Table:
        head, region, why = _gathered(table, left, right)
        if not head:
            return pa.Table.from_batches([], pa.schema(FIELDS))
        if region is None:
            kept = matrix(table.combine_chunks().column("data").combine_chunks(), 0) if why is None else None
            return pa.Table.from_batches([chunk_batch(head | ({"status": "error", "error": why} if why else {}), kept)])
        try:
            out = chunk_batch(head, kernel(region))
        except Exception as e:  # noqa: BLE001  one bad chunk must not end the others
            out = chunk_batch(head | {"status": "error", "error": f"{type(e).__name__}: {e}"}, None)
        return pa.Table.from_batches([out])

    return _exchanged(chunks, left, right, payloads).groupBy("path", "to").applyInArrow(run, CHUNK)


def summed(chunks: DataFrame, kind: type, statistics: Callable[[Region], object], finish: Callable[[object], bytes], left: Callable[[float], int] = lambda _: 0, right: Callable[[float], int] = lambda _: 0) -> DataFrame:
    """path, last (number of the last chunk) and payload: what ``finish`` makes of the sum of all chunks' statistics, which are added in the order of chunks.

    ``statistics`` gives values of ``kind``, a data class of numbers and arrays, which are passed on field by field.
    ``finish`` gets the sum and the recording's rate and number of samples; a recording of which a chunk failed has none.
    """
    kinds = "path string, part long, last long, sfreq double, n_times long, total binary"
    names = [k.split()[0] for k in kinds.split(", ")]

    def row(*values) -> pa.Table:
        types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, types, strict=True)], names=names)

    def one(table: pa.Table) -> pa.Table:
        head, region, _ = _gathered(table, left, right)
        total = None if region is None else pickle.dumps(vars(statistics(region)))
        last = (head["n_times"] - 1) // head["length"] if region is not None else None
        return row(head.get("path"), head.get("chunk"), last, head.get("sfreq"), head.get("n_times"), total)

    def add(totals: Iterable[bytes | None]) -> bytes | None:
        out = None
        for t in totals:
            if t is None:
                return None
            part = kind(**pickle.loads(t))
            out = part if out is None else out + part
        return None if out is None else pickle.dumps(vars(out))

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"] if r["part"] is not None else -1)
        return row(*(rows[0][n] for n in names[:-1]), add(r["total"] for r in rows))

    def last(table: pa.Table) -> pa.Table:
        r = merge(table).to_pylist()[0]
        payload = None if r["total"] is None else finish(kind(**pickle.loads(r["total"])), r["sfreq"], r["n_times"])
        return pa.table({"path": pa.array([r["path"]], pa.string()), "last": pa.array([r["last"]], pa.int64()), "payload": pa.array([payload], pa.binary())})

    ones = _exchanged(chunks, left, right, None).groupBy("path", "to").applyInArrow(one, kinds)
    fans = ones.groupBy("path", F.floor(F.col("part") / FAN).alias("fan")).applyInArrow(merge, kinds)
    return fans.groupBy("path").applyInArrow(last, "path string, last long, payload binary")


def to_chunks(found: DataFrame) -> DataFrame:
    """What was found by ``summed`` for each chunk of the recordings: path, chunk, payload."""
    return found.where("last is not null").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("chunk"), "payload")


# --- filters, references, rates ------------------------------------------------


def filtered(chunks: DataFrame, steps: Callable[[float], list[K.Step]]) -> DataFrame:
    """Zero-phase filters, told by the sampling rate, as over the whole recording."""

    def kernel(r: Region) -> np.ndarray:
        return r.own(*K.filtered_part(r.x, r.start, r.n_times, steps(r.sfreq)))

    need = lambda sfreq: K.halo(steps(sfreq))
    return mapped(chunks, kernel, need, need)


def _plain(chunks: DataFrame, change: Callable[[np.ndarray, dict], tuple[np.ndarray, dict]]) -> DataFrame:
    """Chunks changed each on its own; no exchange."""

    def run(batches):
        for batch in batches:
            for i, m in enumerate(batch.select(META).to_pylist()):
                x = matrix(batch.column("data"), i)
                if x is not None and m["status"] == "ok":
                    x, new = change(x, m)
                    m |= new
                yield chunk_batch(m, x)

    return chunks.select(*(n for n, _ in FIELDS)).mapInArrow(run, CHUNK)


def average_reference(chunks: DataFrame) -> DataFrame:
    return _plain(chunks, lambda x, m: (K.average_reference(x), {}))


def resampled(chunks: DataFrame, sfreq: float) -> DataFrame:
    """Nearest-neighbour resampling, as over the whole recording; ``length`` is null after it, as chunks are no longer alike."""

    def change(x: np.ndarray, m: dict) -> tuple[np.ndarray, dict]:
        scale, a, n = sfreq / m["sfreq"], m["start_sample"], m["n_times"]
        total = int(np.floor(n * scale))
        i = np.arange(max(0, int(a * scale) - 2), min(total, int((a + x.shape[1]) * scale) + 3))
        at = np.minimum(np.floor(i / scale).astype(np.int64), n - 1)
        mine = (at >= a) & (at < a + x.shape[1])
        return x[:, at[mine] - a], {"start_sample": int(i[mine][0]) if mine.any() else int(np.ceil(a * scale)), "n_times": total, "sfreq": sfreq, "length": None}

    return _plain(chunks, change)


# --- what is learned from the whole recording -----------------------------------


def moments(chunks: DataFrame) -> DataFrame:
    """path, n, mean and products (row by row) of the channels of whole recordings."""

    def table(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = None if raw is None else pickle.loads(raw)
                values = (path, None, None, None) if m is None else (path, m["n"], m["mean"].tolist(), m["products"].tolist())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))), strict=True)], names=["path", "n", "mean", "products"])

    found = summed(chunks, K.Moments, lambda r: K.Moments.of(r.own(r.x, r.start)), lambda total, sfreq, n: pickle.dumps(vars(total)))
    return found.select("path", "payload").mapInArrow(table, "path string, n long, mean array<double>, products array<array<double>>")


def whitened(chunks: DataFrame) -> DataFrame:
    """Channels of each recording made uncorrelated and of variance 1, by its own moments."""
    found = summed(chunks, K.Moments, lambda r: K.Moments.of(r.own(r.x, r.start)), lambda total, sfreq, n: pickle.dumps((total.mean, total.whitening())))

    def kernel(r: Region) -> np.ndarray:
        mean, white = pickle.loads(r.payload)
        return white @ (r.own(r.x, r.start) - mean[:, None])

    return mapped(chunks, kernel, payloads=to_chunks(found))


def without_line(chunks: DataFrame, line: float) -> DataFrame:
    """Line noise taken out as over the whole recording: its components come from spectra that are summed over chunks."""
    steps = lambda sfreq: K.period_steps(sfreq, line)
    half = lambda sfreq: K.halo(steps(sfreq))
    # A window may begin at a chunk's last sample.
    beyond = lambda sfreq: half(sfreq) + max(8, int(2 * sfreq))
    too_short = lambda n, sfreq: n < 2 * sfreq / line or line >= sfreq / 2

    def fast_of(r: Region) -> tuple[np.ndarray, np.ndarray, int]:
        smooth, start = K.filtered_part(r.x, r.start, r.n_times, steps(r.sfreq))
        return r.x[:, start - r.start : start - r.start + smooth.shape[1]] - smooth, smooth, start

    def statistics(r: Region) -> K.LineStatistics:
        fast, _, start = fast_of(r)
        n = K.welch_length(r.n_times, r.sfreq)
        hop = max(1, n // 2)
        begins = range(-(-r.a // hop) * hop, min(r.b, r.n_times - n + 1), hop)
        return K.LineStatistics.of(r.own(fast, start), [fast[:, s - start : s - start + n] for s in begins], n, r.sfreq, line)

    def finish(total: K.LineStatistics, sfreq: float, n_times: int) -> bytes:
        single = len(total.gram) < 2 or too_short(n_times, sfreq)
        return pickle.dumps(np.eye(len(total.gram)) if single else K.line_projection(total, K.welch_length(n_times, sfreq), sfreq, line))

    def kernel(r: Region) -> np.ndarray:
        if too_short(r.n_times, r.sfreq):
            return r.own(r.x, r.start)
        fast, smooth, start = fast_of(r)
        return r.own(smooth + pickle.loads(r.payload) @ fast, start)

    found = summed(chunks, K.LineStatistics, statistics, finish, half, beyond)
    return mapped(chunks, kernel, half, half, to_chunks(found))

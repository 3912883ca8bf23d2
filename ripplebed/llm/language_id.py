"""Language identification by a byte convolutional network, trained and run in numpy.

Bytes (A-Z lower-cased) are embedded; filters of widths 2, 3 and 4 slide over
windows of 256 bytes; each filter's largest response feeds a softmax over the
languages seen in training.  All windows of the whole text are classified in
batches, and the mean of their probabilities is the document's.

The network is fitted on the driver on a bounded sample of labelled documents:
``SAMPLE`` of them, shared evenly among all languages that occur and drawn by a hash of
id and text, or ``LEAST`` of each language where that is more, with at most
``WINDOWS`` windows each, spread over the text.  Rows alike in id and text are drawn as
one.  Everything else covers all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so
is everything if no labelled document exists; null labels are not learned from;
a null doc_id is not learned from either, and predicted like any other; equal texts get equal
results; of equally likely languages the first by name is taken; texts may be of any length; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ripplebed.llm.base import bounded_batches, crc_of_id, documents, small_batches, text_bytes, text_of

WINDOW = 256
SAMPLE, LEAST, WINDOWS = 2400, 37, 4
EMBEDDED, FILTERS, WIDTHS = 8, 12, (2, 3, 4)
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Below this probability the pipeline rejects a document.
SURE = 0.4
UNKNOWN = "und"


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray  # byte, dimension
    filters: np.ndarray  # offset * dimension, filter
    bias: np.ndarray
    weights: np.ndarray  # filter, language
    offset: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """For each window and position, the embedded bytes under the widest filter."""
        wide, e = max(WIDTHS), self.embedding.shape[1]
        x = np.ascontiguousarray(self.embedding[windows].reshape(len(windows), -1))
        n = windows.shape[1] - wide + 1
        return np.lib.stride_tricks.as_strided(x, (len(windows), n, wide * e), (x.strides[0], x.strides[1] * e, x.strides[1]))

    def pooled(self, windows: np.ndarray, where: bool = False):
        p = self.patches(windows)
        response = np.matmul(p, self.filters)
        best = response.max(axis=1) + self.bias
        return (best, response.argmax(axis=1), p) if where else best

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(windows), 0) @ self.weights + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _used() -> np.ndarray:
    """Which weights of the joint filter matrix belong to the narrower filters."""
    wide = max(WIDTHS)
    return np.concatenate([np.repeat((np.arange(wide) < w)[:, None], EMBEDDED, 1).reshape(-1, 1) * np.ones(FILTERS) for w in WIDTHS], axis=1).astype(np.float32)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 0) -> ByteNetwork:
    """Train by Adam on the cross-entropy; the largest response of a filter alone passes its gradient on."""
    rng = np.random.default_rng(seed)
    n, used = FILTERS * len(WIDTHS), _used()
    init = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    net = ByteNetwork(languages, init(256, EMBEDDED), init(max(WIDTHS) * EMBEDDED, n) * used, np.zeros(n, np.float32), init(n, len(languages)), np.zeros(len(languages), np.float32))
    params = [net.embedding, net.filters, net.bias, net.weights, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            if not len(at):
                continue
            best, where, patches = net.pooled(windows[at], where=True)
            hidden = np.maximum(best, 0)
            z = hidden @ net.weights + net.offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(at)), labels[at]] -= 1
            z /= len(at)
            back = (z @ net.weights.T) * (best > 0)
            seen = patches[np.arange(len(at))[:, None], where]  # window, filter, input
            to_filters = np.einsum("wf,wfi->if", back, seen) * used
            to_inputs = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDED)
            under = windows[at][np.arange(len(at))[:, None, None], where[:, :, None] + np.arange(max(WIDTHS))].reshape(-1)
            to_embedding = np.zeros_like(net.embedding)
            np.add.at(to_embedding, under, to_inputs)
            step += 1
            for p, g, m, v in zip(params, (to_embedding, to_filters, back.sum(axis=0), hidden.T @ z, z.sum(axis=0)), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def cut_windows(text: bytes) -> np.ndarray:
    """All windows of a text, the last one filled with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.lower() + bytes(n * WINDOW - len(text)), np.uint8).reshape(n, WINDOW)


def training_windows(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST, most_windows: int = WINDOWS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels of a bounded sample of the documents that may be learned from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) != 2))
    # Rows alike in id and text are one; a few more are drawn than asked for, and then exactly so many of each language are taken.
    known = known.withColumn("name", F.xxhash64("doc_id", "text"))
    counted = known.groupBy("lang").agg(F.approx_count_distinct("name").alias("n")).collect()
    if not counted:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = max(sample // len(counted), least)
    chances = known.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.3 * share + 30) / r["n"])) for r in counted], "lang string, chance double")
    drawn = known.join(F.broadcast(chances), "lang").where(F.pmod("name", F.lit(1 << 40)) < F.col("chance") * (1 << 40)).dropDuplicates(["lang", "name"])
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("name"))).where(F.col("nth") <= share).select("lang", "text")

    def windows(batches):
        for batch in small_batches(batches):
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                cut = cut_windows(text)
                for i in np.unique(np.linspace(0, len(cut) - 1, most_windows).astype(int)):
                    langs.append(lang)
                    found.append(cut[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "bytes"])

    table = drawn.mapInArrow(windows, "lang string, bytes binary").orderBy("lang", "bytes").toArrow()
    languages = sorted(r["lang"] for r in counted)
    at = {x: i for i, x in enumerate(languages)}
    made = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return made, np.array([at[x] for x in table["lang"].to_pylist()], np.int64), languages


def train(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST, most_windows: int = WINDOWS) -> ByteNetwork | None:
    """A network from a sample of at most ``max(sample, least * languages)`` documents; None if nothing may be learned from."""
    windows, labels, languages = training_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), sample, least, most_windows)
    return fit(windows, labels, languages) if len(windows) else None


def predict(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """The columns of ``docs``, and lang_pred and score from ``text`` alone, which may also be a field of the one column ``doc``."""
    docs = bounded_batches(docs)
    at = docs.columns.index("text" if "text" in docs.columns else "doc")

    def classify(texts: list[bytes | None]):
        import regex

        letter = regex.compile(r"\p{L}").search
        good = [i for i, t in enumerate(texts) if net is not None and t and letter(t.decode("utf-8", "replace"))]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if good:
            cuts = [cut_windows(texts[i]) for i in good]
            starts = np.concatenate([[0], np.cumsum([len(c) for c in cuts])[:-1]])
            windows = np.concatenate(cuts)
            p = np.concatenate([net.probabilities(windows[k : k + 128]) for k in range(0, len(windows), 128)]).astype(np.float64)
            mean = np.add.reduceat(p, starts, axis=0) / np.array([len(c) for c in cuts])[:, None]
            for i, m in zip(good, mean, strict=True):
                langs[i], scores[i] = net.languages[int(m.argmax())], min(1.0, float(m.max()))
        return langs, scores

    def run(batches):
        for batch in small_batches(batches, 1 << 20, column=at):
            langs, scores = classify(text_bytes(text_of(batch, at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is recognised with probability ``SURE`` or more."""
    found = predict(docs.select(F.struct(*docs.columns).alias("doc")), train(docs)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE))
    return found.select("doc.*")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

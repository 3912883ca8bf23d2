"""Language-model scores by a probabilistic suffix tree over bytes.

A text is its words (A-Z lower-cased) joined by single spaces and closed by a
newline, which is the end token; the model gives the probability of every byte
after the last ``DEPTH`` ones, where a text begins after newlines.

Counting takes all runs of DEPTH + 1 bytes of all texts, with how often training
texts have them; shorter runs are sums of these.  A context becomes a node if its
next-byte distribution diverges from that of its suffix by ``DIVERGENCE`` nats over
its occurrences, a sum that grows with the corpus, so there is no other cut and a
larger corpus gives more nodes; suffixes of nodes are nodes.  A node's distribution
is smoothed towards its suffix's with ``PRIOR`` pseudo-counts for each different byte
that followed it, as many followers promise further ones.  Nodes are chosen and
smoothed by joins, level by level; what comes out is the chance of each run of
DEPTH + 1 bytes, by its longest context that is a node.  Scoring looks these up: up
to ``BROADCAST_RUNS`` of them are broadcast, more are joined to the blocks of
documents that need them.  A block is a range of ids that holds about ``BLOCK_BYTES``
of text; where a range has more, it is divided by a hash of id and text.  A text's score is the sum over its bytes.

The base score of the same text is that of an additive unigram model of whole
words, whose counts (by 64-bit hash) go back to the blocks of documents that need
them by joins; no vocabulary is broadcast.

Defined results: a null or empty text has the end token alone; a row without doc_id
is scored, but neither learned from nor held out; rows that share a doc_id are scored
each; texts and words may be of any length; an empty table gives no rows; without
training text every byte has probability 1/256; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplebed.llm.base import broadcast, crc_of_id, documents, id_and_text, small_batches, staged, text_bytes, worker_state
from ripplebed.llm.pretokens import word_hashes

DEPTH = 5
DIVERGENCE = 5.0
PRIOR = 2.0
#: Bytes of text in a block; ids next to each other share one.
BLOCK_BYTES = 20 << 20
#: Blocks whose numbers of parts may be broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_BLOCKS = 300_000
END = b"\n"
#: Runs whose chances may be broadcast, up to 24 bytes each; more are joined by a shuffle.
BROADCAST_RUNS = 2_000_000


def body_of(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + END


def runs_of(bodies: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """The run of depth + 1 bytes that ends at each byte, as one number, the last byte lowest."""
    data = END * 7 + b"".join(END * depth + b for b in bodies)
    # The eight bytes that end at each place, of which depth + 1 count.
    gram = np.ndarray((len(data) - 7,), ">i8", data, strides=(1,)).astype(np.int64) & ((1 << (8 * (depth + 1))) - 1)
    keep = np.ones(len(gram), bool)
    starts = np.cumsum([0, *(len(b) + depth for b in bodies)])[:-1]
    keep[(starts[:, None] + np.arange(depth)).reshape(-1)] = False
    return gram[keep]


@dataclass
class Lookup:
    """Values by run, found by hash: the runs of a bucket are tried in turn."""

    grams: np.ndarray  # sorted by bucket
    values: np.ndarray
    starts: np.ndarray  # bucket to its first run
    bits: int

    @staticmethod
    def buckets(grams: np.ndarray, bits: int) -> np.ndarray:
        return (grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    @classmethod
    def of(cls, grams: np.ndarray, values: np.ndarray) -> Lookup:
        bits = max(1, len(grams).bit_length())
        buckets = cls.buckets(grams, bits)
        order = np.argsort(buckets)
        starts = np.searchsorted(buckets[order], np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        return cls(grams[order], values[order], starts, bits)

    def get(self, grams: np.ndarray) -> np.ndarray:
        """The values of runs, all of which are known."""
        at = self.starts[self.buckets(grams, self.bits)]
        left = np.flatnonzero(self.grams[at] != grams)
        while len(left):
            at[left] += 1
            left = left[self.grams[at[left]] != grams[left]]
        return self.values[at]


def gram_counts(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram (a run of depth + 1 bytes) and n over all texts of ``rows``: how often training texts have it, 0 if only others do."""

    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], np.concatenate([n for _, n in parts])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first)

    def table(keys, n):
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000].astype(np.int64))], names=["gram", "n"])

    def counted(bodies):
        for train, some in bodies.items():
            if some:
                keys, n = np.unique(runs_of(some, depth), return_counts=True)
                yield keys, n if train else np.zeros_like(n)

    def run(batches):
        parts, held, bodies, size = [], 0, {True: [], False: []}, 0
        for batch in small_batches(batches, 1 << 20):
            for t, train in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                body = body_of(t)
                bodies[train].append(body)
                size += len(body)
            if size < 4 << 20:
                continue
            new = list(counted(bodies))
            parts += new
            held, bodies, size = held + sum(len(k) for k, _ in new), {True: [], False: []}, 0
            if held > 4_000_000:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > 3_000_000:  # what is passed on is summed later
                    yield from table(*parts[0])
                    parts, held = [], 0
        parts += counted(bodies)
        if parts:
            yield from table(*merged(parts))

    return rows.select("doc_id", "text", "train").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def gram_chances(grams: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE, prior: float = PRIOR) -> DataFrame:
    """gram and chance, the log10 of its last byte's probability after the others, for all rows of gram and n."""

    def last(k: int) -> Column:
        return F.col("context").bitwiseAND((1 << (8 * k)) - 1)

    # Levels by length of context: context, byte, n, and the context's total.
    levels = {}
    level = grams.select(F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).alias("byte"), "n")
    for k in range(depth, -1, -1):
        if k < depth:
            level = staged(levels[k + 1].select(last(k).alias("context"), "byte", "n").groupBy("context", "byte").agg(F.sum("n").alias("n")), "grams")
        levels[k] = staged(level.join(level.groupBy("context").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("kinds")), "context"), "level")
    nodes = {}
    for k in range(depth, 0, -1):
        shorter = levels[k - 1].select(F.col("context").alias("suffix"), "byte", F.col("n").alias("suffix_n"), F.col("total").alias("suffix_total"))
        nats = F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("suffix_n") / F.col("suffix_total")))
        both = levels[k].where("n > 0").withColumn("suffix", last(k - 1)).join(shorter, ["suffix", "byte"])
        found = both.groupBy("context").agg(F.sum(nats).alias("nats")).where(F.col("nats") >= divergence).select("context")
        if k < depth:
            found = found.union(nodes[k + 1].select(last(k).alias("context"))).distinct()
        nodes[k] = staged(found, "nodes")
    smooth = levels[0].select("context", "byte", ((F.col("n") + 0.5) / (F.col("total") + 128)).alias("chance"))
    for k in range(1, depth + 1):
        marked = levels[k].withColumn("suffix", last(k - 1)).join(nodes[k].withColumn("node", F.lit(True)), "context", "left")
        both = marked.join(smooth.withColumnRenamed("context", "suffix"), ["suffix", "byte"])
        weight = prior * F.col("kinds")
        own = F.when(F.col("node"), (F.col("n") + weight * F.col("chance")) / (F.col("total") + weight)).otherwise(F.col("chance"))
        smooth = staged(both.select("context", "byte", own.alias("chance")), "smooth")
    return smooth.select(F.shiftleft("context", 8).bitwiseOR(F.col("byte")).alias("gram"), F.log10("chance").alias("chance"))


def block_grams(rows: DataFrame) -> DataFrame:
    """block and gram: the runs that the texts of each block have."""

    def run(batches):
        known: dict[int, np.ndarray] = {}

        def flush():
            for block, grams in known.items():
                for at in range(0, len(grams), 100_000):
                    part = grams[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), pa.array(part)], names=["block", "gram"])
            known.clear()

        for batch in small_batches(batches, 4 << 20):
            bodies: dict[int, list[bytes]] = {}
            for text, block in zip(text_bytes(batch.column(1)), batch.column(3).to_pylist(), strict=True):
                bodies.setdefault(block, []).append(body_of(text))
            for block, some in bodies.items():
                known[block] = np.union1d(known.get(block, np.zeros(0, np.int64)), runs_of(some))
            if sum(map(len, known.values())) > 4_000_000:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "block long, gram long").distinct()


def with_blocks(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``block``, a function of doc_id and text."""
    size = F.octet_length("text").cast("long")
    told = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum(size).alias("bytes")).first()
    lo, span = told["lo"] or 0, (told["hi"] or 0) - (told["lo"] or 0) + 1
    step = max(1, -(-span // max(1, (told["bytes"] or 0) // block_bytes)))
    # Ids may be hashes, whose span is wider than a long; the number of ranges is small.
    above = F.col("doc_id").cast("decimal(20,0)") - F.lit(Decimal(lo)).cast("decimal(20,0)")
    ranged = rows.withColumn("range", F.coalesce(F.call_function("div", above, F.lit(Decimal(step)).cast("decimal(20,0)")).cast("long"), F.lit(-1).cast("long")))
    parts = F.ceil(F.col("bytes") / block_bytes).cast("int")
    heavy = ranged.groupBy("range").agg(F.sum(size).alias("bytes")).select("range", parts.alias("parts")).where("parts > 1")
    heavy = staged(heavy, "heavy")
    heavy = F.broadcast(heavy) if heavy.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS else heavy
    part = F.pmod(F.xxhash64("doc_id", "text"), F.coalesce("parts", F.lit(1)))
    block = F.shiftleft("range", 24) + part
    return ranged.join(heavy, "range", "left").select(*rows.columns, block.alias("block"))


def word_counts(rows: DataFrame) -> DataFrame:
    """block, word (hash) and n: how often the training texts of that task have it, 0 for words of held-out texts."""

    def run(batches):
        known: dict[int, list] = {}

        def flush():
            for block, parts in known.items():
                words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([np.full(len(w), t, np.float64) for w, t in parts]), minlength=len(words))
                for i in range(0, len(words), 100_000):
                    part = words[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), pa.array(part), pa.array(n[i : i + 100_000].astype(np.int64))], names=["block", "word", "n"])
            known.clear()

        held = 0
        for batch in small_batches(batches):
            hashes, starts = word_hashes(batch.column(1))
            hashes, at = hashes.view(np.int64), starts.tolist()
            for i, (train, block) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if at[i + 1] > at[i]:
                    known.setdefault(block, []).append((hashes[at[i] : at[i + 1]], int(train)))
            held += len(hashes)
            if held > 6_000_000:
                yield from flush()
                held = 0
        yield from flush()

    return rows.mapInArrow(run, "block long, word long, n long")


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Base and tree scores of all texts, from the documents whose crc32(doc_id) mod 10 is not 0."""
    train = F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(10)) != 0, F.lit(False))
    rows = with_blocks(id_and_text(docs).select("doc_id", "text", train.alias("train")), block_bytes)
    learned = rows.where("train")
    chances = staged(gram_chances(staged(gram_counts(rows), "runs")), "chances")
    held, run_name = None, f"chances:{uuid.uuid4().hex}"
    if chances.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        t = chances.toArrow()
        held = broadcast(docs.sparkSession, Lookup.of(t["gram"].to_numpy(), t["chance"].to_numpy()))
    pairs = staged(word_counts(rows).groupBy("block", "word").agg(F.sum("n").alias("n")), "words")
    totals = staged(pairs.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    known = totals.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = learned.count()
    n, v = (known["n"] or 0) + ends, known["v"] + (ends > 0)
    per_block = pairs.select("block", "word").join(totals, "word").select("block", "word", "c", F.lit(None).cast("double").alias("chance"))
    if held is None:
        joined = staged(block_grams(rows), "block-runs").join(chances, "gram")
        per_block = per_block.union(joined.select("block", "gram", F.lit(None).cast("long"), "chance"))

    def block(texts: pa.Table, words: pa.Table) -> pa.Table:
        if held is None:
            runs = words.filter(pc.is_valid(words["chance"]))
            words = words.filter(pc.is_valid(words["c"]))
            chance_of = Lookup.of(runs["word"].to_numpy(), runs["chance"].to_numpy())
        else:
            chance_of = worker_state(run_name, held)
        keys, c = words["word"].to_numpy(), words["c"].to_numpy()
        order = np.argsort(keys)
        keys, c = keys[order], c[order]
        log = lambda x: np.log10((x + 0.1) / (n + 0.1 * (v + 1)))
        tokens, seen, base, tree_score = [], [], [], []
        texts = texts.combine_chunks()
        for batch in small_batches(texts.select(["doc_id", "text", "train"]).to_batches(), 1 << 20):
            bodies = list(map(body_of, text_bytes(batch.column(1))))
            hashes, starts = word_hashes(batch.column(1))
            hashes = hashes.view(np.int64)
            c_of = np.zeros(len(hashes), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                c_of = np.where(keys[at] == hashes, c[at], 0)
            chance = chance_of.get(runs_of(bodies))
            ends_at = np.cumsum([len(b) for b in bodies])
            for b, end, i, j in zip(bodies, ends_at.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                tree_score.append(float(chance[end - len(b) : end].sum()))
                found = c_of[i:j]
                tokens.append(j - i + 1)
                seen.append(int(np.count_nonzero(found)) + (ends > 0))
                base.append(float(log(found).sum() + log(ends)))
        held_out = [i is not None and not t for i, t in zip(texts["doc_id"].to_pylist(), texts["train"].to_pylist(), strict=True)]
        return pa.table({"doc_id": texts["doc_id"], "held_out": pa.array(held_out, pa.bool_()), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(seen, pa.int64()), "train_tokens": pa.array([n] * len(tokens), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(tree_score, pa.float64())})

    together = rows.groupBy("block").cogroup(per_block.groupBy("block"))
    return together.applyInArrow(block, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))

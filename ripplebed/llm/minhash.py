"""Near-duplicates: circulant MinHash, banding, and exact Jaccard verification.

A document's set holds 64-bit hashes of its distinct five-word shingles.  A first
permutation (a bijection of the 64-bit hashes, cut to 32 bits) scatters them; the
second, a bijection of 32-bit numbers, is applied after a circular shift by k to
give coordinate k of the signature, so two permutations make all coordinates.

1. Documents with equal sets form a class; one of each class goes on.
2. Signatures are cut into bands of four coordinates.  In every bucket of equal
   bands two centres, the smallest and a pseudo-random member, are compared with
   the others on full sets; links give components.
3. In buckets that still hold several components, every pair of members of
   different components is examined inside tasks, block against block: pairs whose
   signatures agree too little for the threshold are passed over, the others are
   verified on full sets, and components are made again from all links.  Pairs
   inside one component need no comparison and get none.  Members of large
   buckets bring their sets along, so only links leave such a task.

With 24 bands a pair at similarity 0.85 shares no bucket with chance 2e-8 (at 0.8:
3e-6), and falls under the agreements asked of its 96 coordinates with chance
OVERLOOKED at most; nothing else can lose a link.  Thresholds below 0.8 would need
other bands and are refused.  No group is dropped or capped: a large bucket means
more blocks.

Defined results: null and empty texts have an empty set and link with nothing; a
text of fewer than five words is one shingle; a null doc_id takes no part in links
and has a null component; rows that share a doc_id are one node (kept is then true
for each of them, if for any); texts and words may be of any length; an empty table
gives no rows; other columns are ignored.  ``drop_near_copies`` tells rows apart by
their place instead, so there each row without an id, or with another's id, is a node
of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplebed.llm.base import documents, id_and_text, numbered_rows, small_batches, staged
from ripplebed.llm.components import connected_components
from ripplebed.llm.pretokens import word_hashes

BANDS, ROWS = 24, 4
#: Chance with which a pair at the threshold may have too few agreeing coordinates to be verified.
OVERLOOKED = 2e-9
#: Members of a bucket in one block, and hashes of their sets; a bucket has as many blocks as it takes to keep both on average.
BLOCK, BLOCK_HASHES = 512, 512 << 10
#: From this size on, the members of an unresolved bucket bring their full sets along and are verified where they meet.
LARGE = 64
#: Document ids that may be broadcast to pick the texts whose sets are needed; beyond it a join is shuffled.
BROADCAST_IDS = 2_000_000


# The multipliers and shifts of two public bit mixers (lowbias32 and the finisher of splitmix64).
def _mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def agreements(percent: int, n: int = BANDS * ROWS) -> int:
    """The most agreements of ``n`` that a pair at the threshold reaches with chance 1 - OVERLOOKED."""
    if not 80 <= percent <= 100:
        raise ValueError("the bands are made for thresholds from 80 to 100 percent")
    p, below = percent / 100, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > OVERLOOKED:
            return k
    return n


def signatures(hashes: np.ndarray, starts: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Row k: coordinate k of the signature of each run of ``hashes``; no run is empty."""
    out = np.empty((n, len(starts)), np.uint32)
    first = (_mix64(hashes) >> np.uint64(32)).astype(np.uint32)
    # In blocks that fit a core's cache; a run that is cut gets the least of its parts.
    ends = np.append(starts[1:], len(hashes))
    out[:] = np.uint32(0xFFFFFFFF)
    step = 1 << 15
    for at in range(0, len(first), step):
        part = first[at : at + step]
        lo, hi = int(np.searchsorted(ends, at, side="right")), int(np.searchsorted(starts, at + len(part), side="left"))
        cuts = np.maximum(starts[lo:hi] - at, 0)
        for k in range(n):
            least = np.minimum.reduceat(_mix32(part - np.uint32(k)), cuts)
            np.minimum(out[k, lo:hi], least, out=out[k, lo:hi])
    return out


def shingle_hashes(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``k`` words."""
    hashes, starts = word_hashes(texts)

    def rolled(h: np.ndarray, width: int) -> np.ndarray:
        made = np.full(max(0, len(h) - width + 1), width, np.uint64)
        for i in range(width):
            made = _mix64(made * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(made)])
        return made

    # At every place of the batch; what reaches into the next text is left out.
    made = rolled(hashes, k)
    at = starts.tolist()
    return [np.unique(made[a : b - k + 1] if b - a >= k else rolled(hashes[a:b], b - a) if b > a else made[:0]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(s) for s in sets])
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), np.concatenate([[0], ends[:-1]]).astype(np.int64)


def describe(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_id (binary, null if the set is empty), signature (binary)."""

    def run(batches):
        import hashlib

        for batch in small_batches(batches, 1 << 20):
            sets = shingle_hashes(batch.column(1), words)
            full = [s for s in sets if len(s)]
            sigs = iter(np.ascontiguousarray(signatures(*_flat(full)).T) if full else [])
            rows = [(len(s), hashlib.blake2b(s.data, digest_size=16).digest(), next(sigs).tobytes()) if len(s) else (0, None, None) for s in sets]
            n, ids, sig = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_id", "signature"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, signature binary")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int = 5) -> DataFrame:
    """doc_id and its set (binary, sorted 64-bit hashes) for the documents in ``ids`` (doc_id, distinct)."""

    def run(batches):
        for batch in small_batches(batches, 1 << 20):
            sets = shingle_hashes(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    # A checked size: few ids are broadcast, more are joined by a shuffle.
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    return id_and_text(docs).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles binary").dropDuplicates(["doc_id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (u, v) those with 100 * intersection >= percent * union of the full sets."""

    def run(batches):
        for batch in batches:
            # Sets are looked at where Arrow holds them.
            keep = []
            for i, (x, y) in enumerate(zip(sets_of(batch.column(2)), sets_of(batch.column(3)), strict=True)):
                common = _common(x, y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]], names=["u", "v"])

    left = pairs.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")), "v")
    both = left.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), "u")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Views of sets that are written as bytes."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield data[a:b].view(np.uint64)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _links(mine: list[tuple], other: list[tuple], found: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Of candidate pairs (a row of ``mine``, rows of ``other``) links that join components which none before joined."""
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while top.get(c, c) != c:
            c = top[c]
        return c

    sets = [np.frombuffer(r[9], np.uint64) for r in other]
    out = []
    for i, at in found:
        x = np.frombuffer(mine[i][9], np.uint64)
        for j in at:
            a, b = root(mine[i][6]), root(other[j][6])
            if a != b and 100 * (n := _common(x, sets[j])) >= percent * (len(x) + len(sets[j]) - n):
                top[max(a, b)] = min(a, b)
                out.append((mine[i][5], other[j][5]))
    return out


def _examine(percent: int, agree: int, exact: bool):
    """Rows sorted by block: pairs of different components whose signatures agree enough, each from its first shared band.

    If ``exact``, rows hold full sets too, and the pairs are links, of which those inside one component are left out.
    """

    def pairs(rows):
        block = rows[0]
        band = block[1]
        mine, other = [r for r in rows if r[4] <= 1], [r for r in rows if r[4] >= 1]
        if not mine or not other:
            return []
        x, y = (np.frombuffer(b"".join(r[8] for r in side), np.uint32).reshape(len(side), -1) for side in (mine, other))
        yn, yc, yi = (np.array([r[k] for r in other], np.int64) for k in (7, 6, 5))
        found = []
        bands_y = y.reshape(len(other), BANDS, ROWS)
        for i, r in enumerate(mine):
            near = (100 * np.minimum(yn, r[7]) >= percent * np.maximum(yn, r[7])) & (yc != r[6])
            if not near.any():
                continue
            at = np.flatnonzero(near)
            at = at[np.count_nonzero(y[at] == x[i], axis=1) >= agree]
            if len(at):
                shared = (bands_y[at] == x[i].reshape(BANDS, ROWS)).all(axis=2).argmax(axis=1) == band
                found.append((i, at[shared]))
        if exact:
            return _links(mine, other, found, percent)
        return [(min(mine[i][5], int(v)), max(mine[i][5], int(v))) for i, at in found for v in yi[at]]

    def run(batches):
        group, out = [], []
        for batch in small_batches(batches, 4 << 20, 9 if exact else 8):
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:4] != r[:4]:
                    out += pairs(group)
                    group = []
                group.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])
                out = []
        if group:
            out += pairs(group)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])

    return run


def _unresolved(members: DataFrame, nodes: DataFrame, percent: int, agree: int) -> DataFrame:
    """Pairs (u, v) to verify: members of one bucket in different components."""
    m = members.join(nodes, "doc_id").select("band", "key", "doc_id", "n", "component")
    sizes = m.groupBy("band", "key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    most = sizes.groupBy("band", "key").agg(F.count("*").alias("parts"), F.sum("c").alias("n"), F.sum("w").alias("w"), F.max(F.struct("c", "component", "w")).alias("top"))
    rest = ((F.col("n") - F.col("top.c")).alias("rest"), (F.col("w") - F.col("top.w")).alias("rest_w"))
    most = most.where("parts > 1").select("band", "key", F.col("top.component").alias("main"), "n", "w", *rest)
    m = m.drop("n").join(most, ["band", "key"])
    # Members outside the main component, in blocks of rows, meet blocks of all members.
    blocks = lambda c, w: F.ceil(F.greatest(F.col(c) / BLOCK, F.col(w) / BLOCK_HASHES)).cast("int")
    m = m.withColumns({"rows": blocks("rest", "rest_w"), "cols": blocks("n", "w"), "outside": F.col("component") != F.col("main")})
    mine = F.pmod(F.xxhash64("doc_id"), F.col("rows")).cast("int")
    theirs = F.pmod(F.xxhash64("doc_id"), F.col("cols")).cast("int")
    grid = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda j: F.struct(mine.alias("i"), j.alias("j"), F.when(j == theirs, 1).otherwise(0).alias("side"))))
    others = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), theirs.alias("j"), F.lit(2).alias("side")))
    others = F.when(F.col("outside"), F.filter(others, lambda b: b["i"] != mine)).otherwise(others)
    cells = m.select("band", "key", F.explode(F.concat(F.coalesce(grid, F.array().cast("array<struct<i:int,j:int,side:int>>")), others)).alias("b"), "doc_id", "component", (F.col("n") > LARGE).alias("large"))
    return cells.select("large", "key", "band", F.col("b.i").alias("i"), F.col("b.j").alias("j"), F.col("b.side").alias("side"), "doc_id", "component")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; links need 100 * intersection >= percent * union."""
    agree = agreements(percent)
    told = staged(describe(docs, words), "described")
    n_docs = told.count()  # from the files' footers
    named = told.where("set_id is not null and doc_id is not null")
    reps = staged(named.groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("r")).select("set_id", "r.*"), "classes", n_docs, 32 + 4 * BANDS * ROWS)
    width = 2 * 4 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.substring(F.hex("signature"), b * width + 1, F.lit(width))).alias("key")))
    members = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode(keys).alias("k")).select("doc_id", "n", "k.band", "k.key")
    order = F.xxhash64("doc_id")
    centres = members.groupBy("band", "key").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "n")).alias("a"), F.min(F.struct(order, "doc_id", "n")).alias("b")).where("c > 1")
    shared = staged(members.join(centres, ["band", "key"]), "buckets")
    star = lambda c: shared.select(F.least("doc_id", f"{c}.doc_id").alias("u"), F.greatest("doc_id", f"{c}.doc_id").alias("v"), F.least("n", f"{c}.n").alias("lo"), F.greatest("n", f"{c}.n").alias("hi"))
    pairs = star("a").unionByName(star("b")).where(f"u <> v and 100 * lo >= {percent} * hi").select("u", "v").distinct()
    members = shared.select("band", "key", "doc_id", "n")
    ids = members.select("doc_id").distinct()
    sets = staged(shingle_sets(docs, staged(ids, "ids", n_docs), words), "sets")
    links = staged(verified(pairs, sets, percent), "verified")
    found = connected_components(links)
    nodes = ids.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    cells = _unresolved(members, staged(nodes, "nodes", n_docs), percent, agree)
    cells = staged(cells.join(reps.select("doc_id", "n_shingles", "signature"), "doc_id"), "cells")
    block = ["key", "band", "i", "j"]
    row = [*block, "side", "doc_id", "component", "n_shingles", "signature"]
    small = cells.where("not large").select(*row).repartition(*block).sortWithinPartitions(*block)
    rest = staged(small.mapInArrow(_examine(percent, agree, False), "u long, v long").distinct(), "rest")
    large = cells.where("large").join(sets, "doc_id").select(*row, "shingles").repartition(*block).sortWithinPartitions(*block)
    more = verified(rest, sets, percent).unionByName(large.mapInArrow(_examine(percent, agree, True), "u long, v long"))
    found = connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    classes = reps.select("set_id", F.col("doc_id").alias("rep")).join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    out = told.join(classes, "set_id", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The row of one document of each component, the smallest doc_id (nulls last); rows that share an id or have none are told apart."""
    rows = numbered_rows(docs, "near-rows")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), percent)
    ids = rows.select("row", F.col("doc.doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull(), "id", "row")
    kept = found.join(ids, found["doc_id"] == ids["row"]).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


#: All pairs that share a shingle, and everything that can be reached from a document by links.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(a, b) AS (SELECT u, v FROM e UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
m AS (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

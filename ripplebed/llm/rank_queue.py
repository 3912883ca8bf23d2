"""Byte-level BPE by a rank queue: buckets of positions for each merge rank under a hierarchical bitmap.

The symbols of pre-tokens are a doubly linked list over their bytes.  Each pair of
neighbours whose joint bytes have a rank lies in that rank's bucket.  A bitmap of 64-bit
words has a bit for every bucket that isn't empty, and above it a bitmap of its words
that aren't zero, until one word is left; so the least rank is found by one
find-first-set on each level.  All pre-tokens of a batch share the queue: they have no
pairs in common, so a rank's positions are merged side by side in numpy.  Stale
positions, whose symbol is gone or forms another pair by now, are skipped; of
overlapping ones every other is merged, from the left.  Where a merge would bring up a
pair of lesser rank, which a vocabulary made by merges doesn't know, that pair comes
before the rest of its pre-token: then the leftmost position alone is merged.  So a
pre-token of n bytes takes n log n steps, however long it is.

A task cuts its texts into pre-tokens a batch at a time; distinct ones are encoded once
and remembered within a bound in bytes.

Defined results: a null text is empty and has no tokens; a null doc_id stays null and
is encoded like any other; repeated rows each have their own result; texts and
pre-tokens of any length are encoded whole; text written like a special token is
ordinary text; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from base64 import b64decode

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ripplebed.llm import pretokens as P
from ripplebed.llm.base import Remembered, documents, id_and_text, small_batches, worker_state
from ripplebed.llm.token_ids import BATCH_BYTES, LEADS, MEMORY, TextEncoder

WORD = 64
#: Positions from which they are sorted by rank before they are pushed.
MANY = 256


def rank_file_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token's bytes."""
    with open(path, "rb") as f:
        return {b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Positions by rank; ``pop`` gives the least rank and its positions, or None."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int] | None] = [None] * ranks
        self.levels, n = [], ranks
        while not self.levels or n > 1:
            n = -(-n // WORD)
            self.levels.append([0] * n)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = [position]
            self._mark(rank)
        else:
            bucket.append(position)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Push positions that have a rank, of which -1 is none."""
        if len(ranks) < MANY:
            for rank, position in zip(ranks.tolist(), positions.tolist(), strict=True):
                if rank >= 0:
                    self.push(rank, position)
            return
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        ranks, positions = ranks[order], positions[order].tolist()
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1)).tolist() if len(ranks) else []
        for a, b, rank in zip(cuts[:-1], cuts[1:], ranks[cuts[:-1]].tolist(), strict=True):
            if self.buckets[rank] is None:
                self.buckets[rank] = positions[a:b]
                self._mark(rank)
            else:
                self.buckets[rank].extend(positions[a:b])

    def _mark(self, at: int) -> None:
        for level in self.levels:
            word = level[at >> 6]
            level[at >> 6] = word | 1 << (at & 63)
            if word:
                break
            at >>= 6

    def pop(self) -> tuple[int, list[int]] | None:
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = at << 6 | (word & -word).bit_length() - 1
        bucket, self.buckets[at], bit = self.buckets[at], None, at
        for level in self.levels:
            level[bit >> 6] &= ~(1 << (bit & 63))
            if level[bit >> 6]:
                break
            bit >>= 6
        return at, bucket


class Pairs:
    """The rank of two neighbouring symbols, -1 where they don't form a token."""

    def __init__(self, ranks: dict[bytes, int]):
        # As many as there are tokens, the symbol that ends a pre-token.
        self.end = max(ranks.values(), default=-1) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    found.append((a * (self.end + 1) + b, rank))
        found.sort()
        self.keys = np.array([k for k, _ in found] + [np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([r for _, r in found] + [-1], np.int32)
        # Tokens that begin as they end may overlap with themselves.
        self.overlaps = np.zeros(self.end, bool)
        self.overlaps[[r for t, r in ranks.items() if any(t.startswith(t[i:]) for i in range(1, len(t)))]] = True
        # Tokens that are part of a pair of lesser rank.
        self.late = np.zeros(self.end + 1, bool)
        for part in np.divmod(self.keys[:-1], self.end + 1):
            self.late[part[self.ranks[:-1] < part]] = True

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * (self.end + 1) + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], np.int32(-1))


class RankMerger:
    """``encode(words)`` gives the ids of pre-tokens end to end, and how many each has."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = Pairs(ranks)
        self.queue = RankQueue(self.pairs.end)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = list(map(self.ranks.get, words))
        rest = [i for i, rank in enumerate(whole) if rank is None]
        sizes = np.ones(len(words), np.int64)
        if not rest:
            return np.array(whole, np.int32), sizes
        ids, sizes[rest] = self._merge([words[i] for i in rest])
        out = np.empty(int(sizes.sum()), np.int32)
        merged = np.zeros(len(words), bool)
        merged[rest] = True
        out[np.repeat(merged, sizes)] = ids
        out[(np.cumsum(sizes) - 1)[~merged]] = [rank for rank in whole if rank is not None]
        return out, sizes

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pairs, queue = self.pairs, self.queue
        # One place for each byte and one for each word's end.
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols = np.full(n, pairs.end, np.int32)
        symbols[inside] = pairs.bytes[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        rank_at = np.full(n, -1, np.int32)
        rank_at[:-1] = pairs.of(symbols[:-1], symbols[1:])
        queue.push_all(rank_at, np.arange(n, dtype=np.int32))
        while (found := queue.pop()) is not None:
            rank, bucket = found
            at = np.array(bucket, np.int32)
            at = at[rank_at[at] == rank]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1 and pairs.late[rank]:
                at = self._in_turn(rank, np.unique(at), symbols, after, before, ends)
            if len(at) > 1 and pairs.overlaps[rank]:
                at = np.unique(at)
                begins = np.ones(len(at), bool)
                begins[1:] = after[at[:-1]] != at[1:]
                chain = np.flatnonzero(begins)
                at = at[(np.arange(len(at)) - np.repeat(chain, np.diff(chain, append=len(at)))) % 2 == 0]
            gone = after[at]
            end = after[gone]
            symbols[at], rank_at[gone], inside[gone] = rank, -1, False
            after[at], before[end] = end, at
            left = before[at]
            changed = np.concatenate([at, left[left >= 0]])
            rank_at[changed] = new = pairs.of(symbols[changed], symbols[after[changed]])
            queue.push_all(new, changed)
        counts = np.cumsum(inside)[ends]
        return symbols[inside], np.diff(counts, prepend=0)

    def _in_turn(self, rank: int, at: np.ndarray, symbols: np.ndarray, after: np.ndarray, before: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the positions of a rank those to merge now: a word's leftmost alone where one of its merges brings up a lesser rank; the rest is pushed again."""
        end, here = after[after[at]], np.full(len(at), rank, np.int32)
        sides = ((here, symbols[end]), (np.where(before[at] >= 0, symbols[before[at]], self.pairs.end), here), (here, np.where(np.isin(end, at), rank, self.pairs.end)))
        lesser = np.zeros(len(at), bool)
        for a, b in sides:
            new = self.pairs.of(a, b)
            lesser |= (new >= 0) & (new < rank)
        if not lesser.any():
            return at
        word = np.searchsorted(ends, at)
        first = np.diff(word, prepend=-1) != 0
        now = first | ~np.isin(word, word[lesser])
        self.queue.push_all(np.full(int((~now).sum()), rank, np.int32), at[~now])
        return at[now]


class RankEncoder(TextEncoder):
    """Ids of whole texts by a file of ranks, and the bytes of ids."""

    def __init__(self, path: str, memory: int = MEMORY):
        import regex
        from public_tokenizers import PATTERN

        ranks = read_ranks(path)
        self.merger = RankMerger(ranks)
        self.cuts, self.openings = True, set()
        self.find = regex.compile(PATTERN.replace(r"\s", f"[{P.WHITE}]").replace(r"(?!\S)", f"(?![^{P.WHITE}])").replace(rf"[^[{P.WHITE}]", f"[^{P.WHITE}")).findall
        self.classes = P.byte_classes(LEADS)
        self.known = Remembered(memory)
        spelled = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            spelled[rank] = token
        self.spelled = pa.array(spelled, pa.large_binary())

    def _by_model(self, distinct: list[bytes]) -> tuple[array, list[int]]:
        ids, sizes = self.merger.encode(distinct)
        return array("i", ids.tobytes()), sizes.tolist()

    def decode(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of ids end to end, and where each id's begin and the last one's end."""
        taken = self.spelled.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)
        return memoryview(taken.buffers()[2] or b""), ends


def rank_encoder(path: str, memory: int = MEMORY) -> RankEncoder:
    """The worker's own encoder for the file at ``path``; it lives across tasks."""
    return worker_state(f"ranks:{path}:{memory}", lambda: RankEncoder(path, memory))


def encode_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and the ids of each text."""
    path = ranks or rank_file_path()

    def run(batches):
        enc = rank_encoder(path)
        for batch in small_batches(batches, BATCH_BYTES):
            ids, at = enc.encode(batch.column(1))
            rows = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(ids[at[0] : at[-1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids and, as ``decoded``, the bytes that they spell; a null list of ids spells nothing."""
    path = ranks or rank_file_path()

    def run(batches):
        enc = rank_encoder(path)
        for batch in batches:
            ids = batch.column(1)
            flat, at = _flat(ids)
            raw, ends = enc.decode(flat)
            cuts = ends[at].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([bytes(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def _flat(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the lists end to end, and where each list begins and the last one ends."""
    sizes = np.diff(ids.offsets.to_numpy()) if not ids.null_count else ids.value_lengths().fill_null(0).to_numpy()
    return ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def digests(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of a text's ids and of the bytes that are decoded from them."""
    path = ranks or rank_file_path()

    def run(batches):
        enc = rank_encoder(path)
        for batch in small_batches(batches, BATCH_BYTES):
            ids, at = enc.encode(batch.column(1))
            ids, at = ids[at[0] : at[-1]], at - at[0]
            raw, ends = enc.decode(ids)
            coded = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
            sha = lambda data, cuts: pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at), pa.int64()), sha(coded, (4 * at).tolist()), sha(raw, ends[at].tolist())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))

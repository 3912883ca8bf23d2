"""Cutting texts into pre-tokens by the classes of their bytes, a batch at a time.

Most text needs no pattern: if it has ASCII and accented Latin letters alone, the
runs of letters, digits and other signs are found by comparing neighbouring bytes of
the whole batch in numpy, and Arrow tells the distinct runs apart.  Other texts are
cut one by one by a pattern; both ways give the same kind of table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, DIGIT, SIGN, SPACE, BREAK, OTHER = range(6)

#: Unicode's white space, as parts of a class of characters.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Endings that stay with their apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_classes(leads: range) -> np.ndarray:
    """The class of each byte; ``leads`` are the first bytes of two-byte letters, whose second bytes count as letters too."""
    out = np.full(256, OTHER, np.uint8)
    out[0x21:0x7F] = SIGN
    for a, b in (("A", "Z"), ("a", "z")):
        out[ord(a) : ord(b) + 1] = LETTER
    out[ord("0") : ord("9") + 1] = DIGIT
    out[0x20], out[0x0A] = SPACE, BREAK
    out[0x80:0xC0] = LETTER
    out[leads.start : leads.stop] = LETTER
    return out


@dataclass
class Runs:
    """Distinct pre-tokens and, for every text, the places of its own in the order they stand."""

    distinct: list[bytes]
    places: pa.Array  # of all texts, end to end
    starts: np.ndarray  # where each text's places begin, and where the last ends


def apostrophes(data: np.ndarray, cut: np.ndarray, first: np.ndarray) -> None:
    """Keep 's and its like together: take the cut behind such an apostrophe away, and cut behind the ending.

    ``cut`` says where a run begins, ``first`` where a text does; an apostrophe
    that doesn't begin a run is no matter.
    """
    at = np.flatnonzero((data == ord("'")) & cut)
    at = at[at + 1 < len(data)]
    at = at[~first[at + 1]]
    if not len(at):
        return
    next_ = data[at + 1]
    one = np.isin(next_, np.frombuffer("".join(e for e in ENDINGS if len(e) == 1).encode(), np.uint8))
    cut[at[one] + 1] = False
    ends = at[one] + 2
    at = at[~one]
    at = at[at + 2 < len(data)]
    at = at[~first[at + 2]]
    pair = data[at + 1].astype(np.int32) * 256 + data[at + 2]
    two = np.isin(pair, [ord(e[0]) * 256 + ord(e[1]) for e in ENDINGS if len(e) == 2])
    cut[at[two] + 1] = False
    ends = np.concatenate([ends, at[two] + 3])
    cut[ends[ends < len(data)]] = True


def plain_texts(data: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which texts have bytes of known classes alone, and neither of the two signs among the accented letters."""
    bad = kinds == OTHER
    bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # × and ÷
    return without(bad, starts)


def without(bad: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which texts have no byte that is marked."""
    out = np.ones(len(starts) - 1, bool)
    out[np.searchsorted(starts, np.flatnonzero(bad), side="right") - 1] = False
    return out


def white_runs(kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """White space beside more of it, or at a text's begin or end."""
    white = (kinds == SPACE) | (kinds == BREAK)
    begins = first_bytes(starts, len(kinds) + 1)
    alone = white & ~begins[:-1] & ~begins[1:]
    alone[1:] &= ~white[:-1]
    return white & ~alone


def first_bytes(starts: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` places, those where a text begins or the last one ends."""
    out = np.zeros(n, bool)
    out[starts[starts < n]] = True
    return out


def distinct_runs(data: np.ndarray | pa.Buffer, begins: np.ndarray) -> tuple[list[bytes], pa.Array]:
    """The distinct runs of bytes and the place of each; a run ends where the next begins, the last one at ``begins[-1]``."""
    offsets = pa.py_buffer(np.ascontiguousarray(begins, np.int64))
    seen = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    return seen.dictionary.to_pylist(), seen.indices


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts end to end, and where each begins and the last ends."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    buffer = texts.buffers()[2] or pa.py_buffer(b"")
    buffer = buffer.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return np.frombuffer(buffer, np.uint8), offsets - offsets[0]


def merged(parts: list[tuple[np.ndarray, Runs]], n: int) -> Runs:
    """One table from tables of some of ``n`` texts each, given by their numbers."""
    if len(parts) == 1:
        return parts[0][1]
    distinct: list[bytes] = []
    sizes = np.zeros(n, np.int64)
    for where, runs in parts:
        sizes[where] = np.diff(runs.starts)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    places = np.empty(int(starts[-1]), np.int64)
    for where, runs in parts:
        length = np.diff(runs.starts)
        to = np.repeat(starts[where] - runs.starts[:-1], length) + np.arange(int(length.sum()))
        places[to] = runs.places.to_numpy(zero_copy_only=False) + len(distinct)
        distinct += runs.distinct
    return Runs(distinct, pa.array(places), starts)


def listed(parts: list[list[bytes]]) -> Runs:
    """The table of texts that are cut already."""
    seen = pa.array([x for p in parts for x in p], pa.large_binary()).dictionary_encode()
    return Runs(seen.dictionary.to_pylist(), seen.indices, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words (A-Z lower-cased) of texts, the place of every word, and where each text's words begin and the last one's end.

    Words are runs of anything but the white space 0x20 and 0x09-0x0D.
    """
    data, starts = bytes_of(texts)
    low = lower_ascii(data)
    white = (low == 0x20) | (low - np.uint8(9) < 5)
    cut = ~white
    begins = first_bytes(starts, len(low))
    cut[1:] &= white[:-1] | begins[1:]
    begins = np.flatnonzero(cut)
    # A run takes the white space behind its word along, which is cut off from the distinct ones.
    raw, places = distinct_runs(low, np.append(begins, len(low)))
    return [w.rstrip() for w in raw], places.to_numpy(zero_copy_only=False), np.searchsorted(begins, starts)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where(data - np.uint8(65) < 26, data | np.uint8(0x20), data)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of texts, and where each text's words begin and the last one's end."""
    import xxhash

    distinct, places, starts = words_of(texts)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[places], starts

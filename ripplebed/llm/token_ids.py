"""Byte-level token ids of whole texts, with the tokenizers library.

The library spends most of its time on words it has met before.  A batch of texts is
therefore cut into pre-tokens at once, each distinct one goes through the library's
model, and the ids of all texts are gathered by their pre-tokens' places.  A worker
remembers the ids of pre-tokens within a bound in bytes.
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa

from ripplebed.llm import pretokens as P
from ripplebed.llm.base import Remembered, worker_state

#: Bytes of pre-tokens and their ids that a worker remembers.
MEMORY = 32 << 20
#: Bytes of text that are cut at once.
BATCH_BYTES = 8 << 20
#: Longer pre-tokens are not remembered.
LONG = 64
#: First bytes of the two-byte characters from U+00C0 to U+027F, letters all but × and ÷.
LEADS = range(0xC3, 0xCA)
ID = attrgetter("id")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TextEncoder:
    """``encode(texts)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` of every text.

    Plain texts have white space only as single spaces and line breaks between
    other characters: a space goes along with what follows, a line break stands
    alone.  Texts with the opening of an added token, and all texts of a tokenizer
    that isn't byte-level, are encoded whole by the library.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        # Where the first two characters of an added token occur, it might begin.
        self.openings = {t["content"].encode()[:2] for t in spec.get("added_tokens", [])}
        self.find = regex.compile(PATTERN.replace(r"\s", f"[{P.WHITE}]").replace(r"(?!\S)", f"(?![^{P.WHITE}])").replace(rf"[^[{P.WHITE}]", f"[^{P.WHITE}")).findall
        self.classes = P.byte_classes(LEADS)
        # The byte-level alphabet: what the library's own pre-tokenizer writes for each byte.
        letters = {}
        for text in (*map(chr, range(128)), *map(chr, range(0x80, 0x800)), *(chr(c) for c in range(0x1000, 0x10000, 0x800) if not 0xD800 <= c < 0xE000), *map(chr, range(0x10000, 0x110000, 0x10000))):
            written = "".join(w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
            if len(written) == len(text.encode()):
                letters.update(zip(text.encode(), map(ord, written), strict=True))
        self.letters = np.array([letters.get(b, 0xFFFD) for b in range(256)], "<u4")  # some bytes occur in no text
        self.known = Remembered(memory)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _by_model(self, distinct: list[bytes]) -> tuple[array, list[int]]:
        """The ids of pre-tokens by the library's model, end to end, and how many each has."""
        # All are written in the byte-level alphabet at once; a line break, which no other byte's letter is, stands between them.
        raw = b"".join(distinct)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        ends = np.cumsum(sizes) + np.arange(1, len(distinct) + 1)
        written = np.full(len(raw) + len(distinct), 10, "<u4")
        inside = np.ones(len(written), bool)
        inside[ends - 1] = False
        written[inside] = self.letters[np.frombuffer(raw, np.uint8)]
        words = written.tobytes().decode("utf-32-le").split("\n")[:-1]
        ids, sizes = array("i"), []
        # A few at a time, as the library's tokens take far more room than their ids.
        for at in range(0, len(words), 4096):
            found = list(map(self.model.tokenize, words[at : at + 4096]))
            ids.extend(map(ID, chain.from_iterable(found)))
            sizes += map(len, found)
        return ids, sizes

    def of_runs(self, runs: P.Runs) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the distinct pre-tokens end to end, and where each one's begin and the last one's end."""
        distinct = runs.distinct
        known = self.known.get(distinct)
        new = [i for i, x in enumerate(known) if x is None]
        if new:
            ids, sizes = self._by_model([distinct[i] for i in new])
            raw, at = ids.tobytes(), 0
            for i, n in zip(new, sizes, strict=True):
                known[i] = raw[at : at + 4 * n]
                at += 4 * n
            # What a batch has but once is likely to be rare everywhere.
            often = np.bincount(runs.places.to_numpy(zero_copy_only=False), minlength=len(distinct)) > 1
            self.known.add([(distinct[i], known[i]) for i in np.asarray(new)[often[new]].tolist() if len(distinct[i]) <= LONG])
        ends = np.cumsum([0, *map(len, known)]) // 4
        return np.frombuffer(b"".join(known), np.int32), ends

    def _opens(self, data: np.ndarray) -> np.ndarray:
        """Where an added token might begin."""
        out = np.zeros(len(data), bool)
        for x in self.openings:
            out[:-1] |= (data[:-1] == x[0]) & (data[1:] == x[-1])
        return out

    def _plain(self, data: np.ndarray, starts: np.ndarray) -> P.Runs:
        kinds = self.classes[data]
        first = P.first_bytes(starts, len(data))
        # At white space, behind a line break, and where the class changes but not behind a space.
        cut = first | (kinds >= P.SPACE)
        cut[1:] |= (kinds[:-1] == P.BREAK) | (kinds[1:] != kinds[:-1]) & (kinds[:-1] != P.SPACE)
        P.apostrophes(data, cut, first)
        begins = np.append(np.flatnonzero(cut), len(data))
        return P.Runs(*P.distinct_runs(data, begins), np.searchsorted(begins, starts))

    def runs(self, texts: pa.Array) -> tuple[P.Runs | None, np.ndarray]:
        """The pre-tokens of texts, and which texts are encoded whole instead (they have none)."""
        if not self.cuts:
            return None, np.ones(len(texts), bool)
        data, starts = P.bytes_of(texts)
        kinds = self.classes[data]
        whole = ~P.without(self._opens(data), starts)
        plain = P.plain_texts(data, starts, kinds) & P.without(P.white_runs(kinds, starts), starts) & ~whole
        if plain.all():
            return self._plain(data, starts), whole
        parts = []
        if plain.any():
            parts.append((np.flatnonzero(plain), self._plain(*P.bytes_of(texts.filter(pa.array(plain))))))
        odd = ~plain
        found = [[] if w else [x.encode() for x in self.find(t)] for t, w in zip(texts.filter(pa.array(odd)).to_pylist(), whole[odd].tolist(), strict=True)]
        parts.append((np.flatnonzero(odd), P.listed(found)))
        return P.merged(parts, len(texts)), whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (none of them null) end to end, and where each text's begin and the last one's end."""
        runs, whole = self.runs(texts)
        if runs is None:
            ids, at = np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        else:
            ids, ends = self.of_runs(runs)
            taken = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids)).take(runs.places)
            at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[runs.starts]
            ids = taken.values.to_numpy()
        if not whole.any():
            return ids, at
        own = {i: self.whole(texts[i].as_py()) for i in np.flatnonzero(whole).tolist()}
        pieces = [own[i] if i in own else ids[at[i] : at[i + 1]] for i in range(len(texts))]
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after each text's ids."""
        ids, at = self.encode(texts)
        ends = at[1:] + np.arange(1, len(at))
        out = np.empty(len(ids) + len(texts), np.int32)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside], out[ends - 1] = ids[at[0] : at[-1]], end_id
        return out, np.concatenate([[0], ends]).astype(np.int64)


def encoder(path: str, memory: int = MEMORY) -> TextEncoder:
    """The worker's own encoder for the file at ``path``; it lives across tasks."""
    return worker_state(f"encoder:{path}:{memory}", lambda: TextEncoder(path, memory))

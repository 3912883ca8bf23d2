"""BPE as a deterministic automaton over tokens, built merge by merge.

The automaton reads tokens; it accepts exactly the token sequences that BPE
produces.  It begins with one state in which every base symbol loops.  The gadget
of the merge (u, v), applied in the order of the merges, works as follows.  If the
state behind u has an arc labelled v, then the arcs labelled u are led to a copy of
that state without v, and every state with an arc u gets an arc uv to where v led.
All arcs with one label lead to one state, so a state goes by that label.

Written out, the transitions would be as many as pairs of tokens.  They are compiled
into five arrays instead: for each label its two parts and the moment of its gadget;
the moments at which states lost arcs, hashed by (state, label); and the spellings of
labels as a hashed trie.  A state has an arc if it did not lose it, and if what made
it had: an arc younger than its state was made beside that of its left part, and a
state younger than the arc was copied from the one behind its right part.  So a
transition is a walk along the parts with a look into the table at each step.  The
arrays are made once, on the driver, and read only.

Of the labels that end at a place of a word just one has an arc from where it
begins, so the places are settled from left to right without a step back, for many
words at once in numpy.  Decoding writes the labels of the arcs.

Plain texts are pre-split by the classes of their bytes (``pretokens``), others by
the tokenizer's own normaliser and pattern.  Each distinct word of a batch goes
through the automaton once; nothing is remembered between batches.

Defined results: a null or empty text has no tokens and decodes to the empty text;
a null doc_id stays null; equal texts get equal results; texts and words may be of
any length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplebed.llm import pretokens as P
from ripplebed.llm.base import broadcast, documents, id_and_text, small_batches, worker_state

#: A moment after all merges; the moment of base symbols is -1.
NEVER = 1 << 30
END = "</w>"
#: Bytes of words that are settled together, and of text in a batch.
BLOCK_BYTES, BATCH_BYTES = 256 << 10, 4 << 20
#: Places of a word that are settled side by side with other words'; longer words are settled one at a time.
LONG = 256


@dataclass
class Table:
    """Values by key in a hash table with open addressing; -1 where there is none."""

    keys: np.ndarray
    values: np.ndarray
    bits: int

    @classmethod
    def of(cls, entries: dict[int, int]) -> Table:
        bits = max(4, (2 * len(entries)).bit_length())
        table = cls(np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32), bits)
        keys, values = np.fromiter(entries, np.int64, len(entries)), np.fromiter(entries.values(), np.int32, len(entries))
        at = table._home(keys)
        left = np.arange(len(keys))
        while len(left):
            # Of keys that want one free place the last wins; the others go on to the next.
            free = table.keys[at[left]] == -1
            table.keys[at[left[free]]] = keys[left[free]]
            won = table.keys[at[left]] == keys[left]
            table.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)
        return table

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.keys[at]
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            left = left[(found != keys[left]) & (found != -1)]
        return np.where(self.keys[at] == keys, self.values[at], -1)


class MergeAutomaton:
    """The automaton of a list of merges over base symbols, which are written as one byte or character each."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = END, spell=lambda s: s.encode("latin-1")):
        n = max(vocabulary.values(), default=-1) + 1
        if n > 1 << 20:
            raise ValueError("more than 2^20 ids: two of them would no longer fit one key")
        self.labels = [""] * n
        for t, i in vocabulary.items():
            self.labels[i] = t
        left, right, born = self.lists = [-1] * n, [-1] * n, [NEVER] * n
        self.lost: dict[int, int] = {}
        for t, i in vocabulary.items():
            if len(t.removesuffix(end)) == 1:
                born[i] = -1
        for moment, (a, b) in enumerate(merges):
            u, v, merged = vocabulary[a], vocabulary[b], vocabulary[a + b]
            # A label whose gadget had no arc to begin with is never made; a second gadget makes an arc that is there.
            if born[u] < moment and born[v] < moment and born[merged] == NEVER and self._arc(u, v, moment):
                self.lost[(u << 20) + v] = moment
                left[merged], right[merged], born[merged] = u, v, moment
        self.left, self.right, self.born = (np.array(x, np.int32) for x in self.lists)
        self.losses = Table.of(self.lost)
        # The trie: node 0 is the root; what a node spells inside a word, and at its end.
        self.inner, self.final, children, count = [-1], [-1], {}, 1
        for t, i in vocabulary.items():
            if self.born[i] == NEVER:
                continue
            node = 0
            for b in spell(t.removesuffix(end)):
                to = children.get(node * 256 + b)
                if to is None:
                    to = children[node * 256 + b] = count
                    self.inner.append(-1)
                    self.final.append(-1)
                    count += 1
                node = to
            (self.final if t.endswith(end) else self.inner)[node] = i
        self.inner, self.final = np.array(self.inner, np.int32), np.array(self.final, np.int32)
        self.children = Table.of(children)

    def _arc(self, u: int, v: int, moment: int) -> bool:
        """Whether the state behind ``u`` has an arc ``v`` just before a moment."""
        lost, (left, right, born) = self.lost, self.lists
        while True:
            if lost.get((u << 20) + v, NEVER) <= moment:
                return False
            if born[u] < 0 and born[v] < 0:
                return True
            # The younger is undone; the copy of a state is taken before the loss at the same moment.
            if born[v] >= born[u]:
                moment, v = born[v], left[v]
            else:
                moment, u = born[u] - 1, right[u]

    def arcs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """For pairs of a state and a label whether there is a transition (to the state behind the label); u = -1 is the first state."""
        out = np.ones(len(u), bool)
        at = np.flatnonzero(u >= 0)
        u, v = u[at], v[at]
        moment = np.full(len(at), NEVER, np.int32)
        while len(at):
            lost = self.losses.get((u.astype(np.int64) << 20) + v)
            gone = (lost >= 0) & (lost <= moment)
            out[at[gone]] = False
            born_u, born_v = self.born[u], self.born[v]
            on = ~gone & ((born_u >= 0) | (born_v >= 0))
            at, u, v, born_u, born_v = at[on], u[on], v[on], born_u[on], born_v[on]
            by_v = born_v >= born_u
            moment = np.where(by_v, born_v, born_u - 1)
            u, v = np.where(by_v, u, self.right[u]), np.where(by_v, self.left[v], v)
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The labels of the accepted paths that spell non-empty words, end to end, and where each word's begin and the last one's end."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(lengths > LONG)
        parts: list = [None] * len(words)
        # Words of like length together, in blocks.
        order = np.argsort(lengths, kind="stable")
        order = order[: len(order) - len(long)]
        cuts = np.searchsorted(np.cumsum(lengths[order]), np.arange(BLOCK_BYTES, int(lengths[order].sum()) + 1, BLOCK_BYTES))
        for block in [b for b in np.split(order, cuts) if len(b)] + [np.array([i]) for i in long]:
            ids, starts = self._settle([words[i] for i in block])
            raw = starts.tolist()
            for k, i in enumerate(block.tolist()):
                parts[i] = ids[raw[k] : raw[k + 1]]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _settle(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths)
        end = ends[word]
        # Every label that fits somewhere: from which byte, to which, and which label.
        at, node, to = np.arange(len(data)), np.zeros(len(data), np.int64), np.arange(len(data))
        found = []
        while len(at):
            node = self.children.get(node * 256 + data[to]).astype(np.int64)
            on = node >= 0
            at, node, to = at[on], node[on], to[on] + 1
            last = to == end[at]
            label = np.where(last, self.final[node], self.inner[node])
            fits = label >= 0
            found.append((at[fits], to[fits], label[fits]))
            at, node, to = at[~last], node[~last], to[~last]
        begin, to, label = (np.concatenate(x) for x in zip(*found, strict=True))
        # Place p of word w has number p + w, so that a word's end and the next one's begin differ.
        of = word[begin]
        begin, to, step = begin + of, to + of, to - (ends - lengths)[of]
        order = np.argsort(step, kind="stable")
        begin, to, label, step = begin[order], to[order], label[order], step[order]
        state, back = np.full(len(data) + len(words), -2, np.int32), np.full(len(data) + len(words), -1, np.int64)
        state[ends - lengths + np.arange(len(words))] = -1
        if len(words) == 1 and len(data) > LONG:
            known, came = state.tolist(), back.tolist()
            for b, t, v in zip(begin.tolist(), to.tolist(), label.tolist(), strict=True):
                if known[t] == -2 and known[b] > -2 and (known[b] < 0 or self._arc(known[b], v, NEVER - 1)):
                    known[t], came[t] = v, b
            state, back, step = np.array(known, np.int32), np.array(came, np.int64), step[:0]
        cuts = np.searchsorted(step, np.arange(1, int(lengths.max()) + 2)) if len(step) else np.zeros(0, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            u, v = state[begin[a:b]], label[a:b]
            known = np.flatnonzero(u > -2)
            known = known[self.arcs(u[known], v[known])]
            state[to[a:b][known]], back[to[a:b][known]] = v[known], begin[a:b][known]
        last = ends + np.arange(len(words))
        if (state[last] == -2).any():
            raise ValueError(f"no path spells {words[int(np.flatnonzero(state[last] == -2)[0])]!r}")
        on_path, where = np.zeros(len(state), bool), last
        while len(where):
            on_path[where] = True
            where = back[where]
            where = where[back[where] >= 0]
        return state[on_path], np.concatenate([[0], np.cumsum(np.add.reduceat(on_path, ends - lengths + np.arange(len(words))))])

    def decode(self, ids: np.ndarray) -> list[str]:
        return [self.labels[i] for i in ids]


@dataclass
class Compiled:
    """What a tokenizer's file gives: the automaton, the special tokens, and the byte-level alphabet."""

    path: str
    automaton: MergeAutomaton
    special: dict[str, int]
    byte_of: dict[int, int]

    @classmethod
    def of(cls, path: str) -> Compiled:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # The alphabet: printable Latin-1 stands for itself, the other bytes for the letters from U+0100 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in own]
        byte_of = {b: b for b in own} | {0x100 + i: b for i, b in enumerate(others)}
        automaton = MergeAutomaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"], lambda s: [byte_of[ord(c)] for c in s])
        return cls(path, automaton, {t["content"]: t["id"] for t in spec["added_tokens"]}, byte_of)


class WordTokenizer:
    """Whole texts with the automaton; normalising and pre-splitting follow the tokenizer's file."""

    def __init__(self, compiled: Compiled):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.automaton, self.special, self.byte_of = compiled.automaton, compiled.special, compiled.byte_of
        self.library = Tokenizer.from_file(compiled.path)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        n = max(len(self.automaton.labels), *(i + 1 for i in self.special.values()))
        labels = self.automaton.labels + [""] * (n - len(self.automaton.labels))
        for t, i in self.special.items():
            labels[i] = t
        self.labels = pa.array([t.encode() for t in labels], pa.large_binary())
        self.decimals = pa.array([b"%d" % i for i in range(n)], pa.large_binary())
        # Letters up to U+00FF, whose lower case is 32 places on; white space other than spaces and line breaks too.
        self.classes = P.byte_classes(range(0xC3, 0xC4))
        self.classes[9:14] = P.BREAK

    def _plain(self, data: np.ndarray, starts: np.ndarray) -> P.Runs:
        low = P.lower_ascii(data)
        # Capitals among the accented letters: the second byte from 0x80 to 0x9E.
        low[1:] += np.where((data[:-1] == 0xC3) & (data[1:] < 0x9F) & (data[1:] >= 0x80), np.uint8(0x20), np.uint8(0))
        kinds = self.classes[data]
        first = P.first_bytes(starts, len(data))
        white = kinds >= P.SPACE
        cut = first | (kinds == P.DIGIT)
        cut[1:] |= kinds[1:] != kinds[:-1]
        P.apostrophes(low, cut, first)
        # A run takes the white space behind it along, which is cut off from the distinct ones.
        begins = np.flatnonzero(cut & ~white)
        raw, places = P.distinct_runs(low, np.append(begins, len(data)))
        return P.Runs([x.rstrip() for x in raw], places, np.searchsorted(begins, starts))

    def _odd(self, text: str) -> list[bytes]:
        out = []
        for part in self.cut(text):
            if part in self.special:
                out.append(part.encode())
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                out += [bytes(self.byte_of[ord(c)] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def runs(self, texts: pa.Array) -> P.Runs:
        """The normalised words of texts, in bytes; special tokens as they are written."""
        data, starts = P.bytes_of(texts)
        opens = np.zeros(len(data), bool)
        opens[:-1] = (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        plain = P.plain_texts(data, starts, self.classes[data]) & P.without(opens, starts)
        if plain.all():
            return self._plain(data, starts)
        parts = []
        if plain.any():
            parts.append((np.flatnonzero(plain), self._plain(*P.bytes_of(texts.filter(pa.array(plain))))))
        parts.append((np.flatnonzero(~plain), P.listed(list(map(self._odd, texts.filter(pa.array(~plain)).to_pylist())))))
        return P.merged(parts, len(texts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For texts (none of them null) the number of tokens, their ids in decimal, and the decoded text, both joined by spaces."""
        runs = self.runs(texts)
        # Signs and letters never share a run, so what is written like a special token is one.
        special = {i: self.special[t] for i, w in enumerate(runs.distinct) if w[:1] == b"<" and (t := w.decode("utf-8", "replace")) in self.special}
        ids, at = self.automaton.encode([w for i, w in enumerate(runs.distinct) if i not in special] if special else runs.distinct)
        if special:
            sizes, own = np.ones(len(runs.distinct), np.int64), np.ones(len(runs.distinct), bool)
            own[list(special)] = False
            sizes[own] = np.diff(at)
            at = np.concatenate([[0], np.cumsum(sizes)])
            made = np.empty(int(at[-1]), np.int32)
            made[np.repeat(own, sizes)] = ids
            made[at[:-1][~own]] = [special[i] for i in np.flatnonzero(~own).tolist()]
            ids = made

        def joined(written: pa.Array) -> pa.Array:
            space = pa.scalar(b" ", pa.large_binary())
            words = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), written.take(pa.array(ids))), space)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(runs.starts, pa.int32()), words.take(runs.places)), space)

        n = np.concatenate([[0], np.cumsum(np.diff(at)[runs.places.to_numpy(zero_copy_only=False)])])
        return n[runs.starts[1:]] - n[runs.starts[:-1]], joined(self.decimals), joined(self.labels)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by spaces) and decoded text as ``encoded`` rows for each text."""
    path = tokenizer or word_bpe_path()
    # A few MB, by the size of the tokenizer's file alone.
    compiled = broadcast(docs.sparkSession, Compiled.of(path))

    def run(batches):
        words = worker_state("words:" + path, lambda: WordTokenizer(compiled()))
        for batch in small_batches(batches, BATCH_BYTES):
            n, ids, text = words.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), ids.cast(pa.binary()), text.cast(pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(documents(spark, sf_dir))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

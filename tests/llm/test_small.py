"""Each operator on awkward rows: nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ripplebed.llm import base, bpe_automaton, exact_dedup, language_id, line_dedup, minhash, packing, pretokens, quality_rules, sharding, suffix_tree, token_store
from ripplebed.llm.base import new_path
from ripplebed.llm.components import connected_components
from ripplebed.llm.token_ids import TextEncoder, byte_bpe_path

LONG = " ".join(f"word{i * i % 977}" for i in range(30_000))
WORDS = "the of and in to river stone light water field house green open slow".split()


def text(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


ROWS = [
    (1, text(1), "en", "a", 1), (2, text(1), "en", "b", 1), (3, text(1).upper(), None, None, 1), (4, None, "fr", "a", 0), (5, "", "en", "a", 0),
    (6, " \t\n ", "en", "c", 0), (7, "one two three", "en", "c", 1), (8, "One  two\nthree", "en", "c", 1), (9, LONG, "en", "d", 1), (10, LONG + " end", "en", "e", 1),
    (11, "shared line here\n" + text(2), "en", "a", 1), (12, "shared line here\n" + text(3), "fr", "b", 1), (13, "shared line here\n" + text(4), "fr", "c", 1),
    (14, "shared line here\n" + text(5), "fr", "d", 1), (15, " shared line here \n" + text(6), "fr", "e", 1), (16, "### $$$ 123", None, "a", 1),
    (17, "déjà Été <|endoftext|> 日本 á", "fr", "f", 1), (None, text(7), "en", "a", 1), (18, "unbroken" * 40_000, "en", "a", 1), (None, None, None, None, None), (20, text(8), "en", "a", 1), (20, text(8), "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, grp long, rep long, score double, words string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, 7, 7, 0.5, "x") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(3, 0, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_exact_dedup(docs, none):
    want = defaultdict(list)
    for i, t, *_ in ROWS:
        want[hashlib.sha256((t or "").encode().lower()).hexdigest()].append(i)
    got = exact_dedup.classes(docs).collect()
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(want)
    for r in got:
        ids = want[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert exact_dedup.classes(none).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 in ids and 2 not in ids and None in ids and ids.count(20) == 1
    assert exact_dedup.drop_copies(none).count() == 0


def test_radix_levels(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, "".join(rng.choice(list("aAb"), rng.choice([0, 1, 2, 31, 32, 64, 200])))) for i in range(120)]
    monkeypatch.setattr(exact_dedup, "BUFFER", 10)
    levels = exact_dedup.radix_groups
    monkeypatch.setattr(exact_dedup, "radix_groups", lambda r: levels(r, digit=2, group_bytes=8))
    got = exact_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[t.lower()].append(i)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {i: (max(g), len(g)) for g in want.values() for i in g}


def test_radix_classes():
    texts = [b"", b"a", b"", b"ab" * 500, b"ab" * 500, b"ab" * 500 + b"c"]
    assert sorted(map(sorted, exact_dedup.radix_classes(texts))) == [[0, 2], [1], [3, 4], [5]]


def brute_components(rows, percent):
    sets, top = {i: shingles(t) for i, t, *_ in rows if i is not None}, {}

    def root(i):
        while top.get(i, i) != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return sets, {i: root(i) for i in sets}


def test_minhash(docs, none):
    sets, want = brute_components(ROWS, 85)
    got = minhash.near_duplicates(docs, percent=85).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(none, percent=85).count() == 0
    kept = minhash.drop_near_copies(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15, 16, 17, 18, 20] and ids.count(None) == 2
    assert minhash.drop_near_copies(none).count() == 0


def test_agreements():
    """The least number of agreeing coordinates at which a pair at the threshold is overlooked too seldom to matter."""
    from math import comb

    for percent in (80, 85, 90, 100):
        k, p = minhash.agreements(percent), percent / 100
        below = lambda m, p=p: sum(comb(96, i) * p**i * (1 - p) ** (96 - i) for i in range(m))
        assert below(k) <= minhash.OVERLOOKED and (k == 96 or below(k + 1) > minhash.OVERLOOKED)
    with pytest.raises(ValueError):
        minhash.agreements(50)


def test_minhash_finds_all_links(spark):
    """All documents of a table against sets compared through an index of their shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    holders, common, top = defaultdict(list), defaultdict(int), {}
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for held in holders.values():
        for n, a in enumerate(held):
            for b in held[n + 1 :]:
                common[min(a, b), max(a, b)] += 1

    def root(i):
        while top.get(i, i) != i:
            i = top[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, percent=85).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()} and len(top) > 20


def test_minhash_blocks(spark, monkeypatch):
    """A bucket far larger than a block, whose members are linked in chains."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "LARGE", 12)
    rng, rows = np.random.default_rng(1), []
    for g in range(3):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        for i in range(40):
            words = list(base)
            for at in rng.integers(0, 120, 1 + i % 4):
                words[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((100 * g + i, " ".join(words)))
    _, want = brute_components(rows, 85)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_components(spark):
    links = [(1, 2), (3, 2), (4, 3), (9, 8), (8, 7), (5, 5)] + [(i, i + 1) for i in range(20, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 8: 7, 9: 7} | {i: 20 for i in range(21, 61)}


def test_token_store(spark, docs, none):
    e, at = TextEncoder(byte_bpe_path()), 0
    out = token_store.digests(token_store.write_tokens(docs, new_path(spark, "t"), 2).tokens(spark))
    got = sorted(out.collect(), key=lambda r: r["start"])
    assert len(got) == len(ROWS)
    crcs = defaultdict(list)
    for i, t, *_ in ROWS:
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        crcs[i].append((len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in crcs[r["doc_id"]]
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in ROWS), key=lambda i: (i is not None, i or 0))
    assert token_store.digests(token_store.write_tokens(none, new_path(spark, "t"), 2).tokens(spark)).count() == 0
    one = token_store.write_tokens(docs, new_path(spark, "t"), 2).tokens(spark, [7]).collect()
    assert len(one) == 1 and e.tokenizer.decode(list(one[0]["ids"])[:-1]) == "one two three"


def awkward(n, seed):
    """Texts of odd parts in odd orders; every other one plain."""
    rng = np.random.default_rng(seed)
    plain = [" ", "\n", "a", "Bc", "the", "'s", "'re", "'LL", "'", "é", "Þ", "ß", "1", "22", ".", "&&", "_"]
    odd = ["  ", "\t", "\n\n", "　", "\xa0", "\x85", "\r", "\x00", "\x1c", "\x1f", "×", "÷", "Ā", "ǅ", "İ", "Σ", "½", "<|endoftext|>", "<|", "|>", "日本", "😀", "ing\u0301", "\u212a"]
    return ["".join(rng.choice(plain + (odd if i % 2 else []), rng.integers(0, 14))) for i in range(n)]


TEXTS = ["  ", " a", "a ", "a  b", "it's 've ", "a\n\nb c", "x y　q", "\x85a b\x85", "\x1ca b\x1d", "<|endoftext|> a<|endoftext|>b", "a'", "'", "s", "a" * 300, "-=" * 50, "É É", "ΑΣ Σ", "1234 ½²", LONG[:5000], ""]


def test_text_encoder():
    """Against the library, with a memory that holds a few words and one that holds all."""
    texts = TEXTS + [r[1] or "" for r in ROWS] + awkward(3000, 0)
    for memory in (5_000, 1 << 24):
        e = TextEncoder(byte_bpe_path(), memory)
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):
            ids, at = e.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
        ids, at = e.encode_ended(pa.array(texts), 2)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*w, 2] for w in want]
        assert e.known.size <= memory
    ids, at = e.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and at.tolist() == [0]


def test_words_of():
    texts = ["", " ", "One  two\n", "\tx\x0b", "x", "É\xa0é two", None]
    distinct, places, starts = pretokens.words_of(pa.array(texts))
    got = [[distinct[p] for p in places[a:b]] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert got == [(t or "").encode().lower().split() for t in texts]


def test_worker_holds_one_state():
    made = []
    first = base.worker_state("test-a", lambda: made.append("a") or [1])
    assert base.worker_state("test-a", lambda: made.append("again")) is first and made == ["a"]
    base.worker_state("test-b", lambda: made.append("b") or [2])
    assert base.worker_state("test-a", lambda: made.append("a") or [3]) == [3] and made == ["a", "b", "a"]


def test_remembered():
    m = base.Remembered(10_000)
    for i in range(500):
        m.add([(b"%d" % i, b"x" * 10)])
        assert len(m.young) + len(m.old) <= 60
    assert m.get([b"499", b"0"]) == [b"x" * 10, None]


def test_packing(docs, none):
    got = packing.pack_documents(docs).collect()
    used, pieces = defaultdict(list), defaultdict(int)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]] += r["length"]
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    e = TextEncoder(byte_bpe_path())
    assert pieces[20] == 2 * (len(e.whole(text(8))) + 1) and pieces[4] == 1
    assert packing.pack_documents(none).count() == 0
    whole = packing.pack(packing.cut_documents(docs, 1, with_ids=True), len(ROWS))
    assert all(len(r["ids"]) == 2048 for r in packing.sequences(whole).collect())
    # Every id lies in exactly one piece: pieces by document, against the library's ids cut by hand.
    want = defaultdict(list)
    for i, t, *_ in ROWS:
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] += [(at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in want.items()}
    # One group: first fit decreasing by hand.
    pieces = sorted(((i, *p) for i, ps in want.items() for p in ps), key=lambda p: (p[0] is None, p[0] or 0, p[1], p[3]))
    free, sequence = [], {}
    for n in sorted(range(len(pieces)), key=lambda n: -pieces[n][2]):
        at = next((k for k, f in enumerate(free) if f >= pieces[n][2]), len(free))
        free += [2048] * (at == len(free))
        free[at] -= pieces[n][2]
        sequence.setdefault(at, []).append(pieces[n][2])
    assert sorted(map(sorted, sequence.values())) == sorted(sorted(n for _, n in spans) for spans in used.values())


def test_packing_divides_repeated_documents(spark):
    """A document that is a third of all rows, with its id or without, does not fill one group."""
    rows = [(7, "same text again")] * 300 + [(None, None)] * 300 + [(i, f"text {i}") for i in range(300)]
    pieces = packing.cut_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 1)
    got = packing.pack(pieces, len(rows), group_documents=30).collect()
    groups = defaultdict(int)
    for r in got:
        groups[r["sequence_id"] >> 32] += 1
    assert len(got) == 900 and len(groups) == 30 and max(groups.values()) <= 90


def test_first_fit():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 101, 300).tolist()
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free = []
    want = {}
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        b = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
        if b is None:
            free.append(100)
            b = len(free) - 1
        want[i] = (b, 100 - free[b])
        free[b] -= sizes[i]
    assert [want[i] for i in range(300)] == list(zip(bins, offsets, strict=True))
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([101], 100)


def test_bpe_automaton(docs, none):
    w = bpe_automaton.WordTokenizer(bpe_automaton.Compiled.of(bpe_automaton.word_bpe_path()))
    texts = TEXTS + ["ǅ", "İ", "<|endoftext|> A<|startoftext|>b", "ab" * 700 + "'s", "x" * 257] + [r[1] or "" for r in ROWS] + awkward(3000, 1)
    n, ids, decoded = w.encode(pa.array(texts))
    for t, *got in zip(texts, n.tolist(), ids.to_pylist(), decoded.to_pylist(), strict=True):
        want = w.library.encode(t, add_special_tokens=False).ids
        assert got == [len(want), " ".join(map(str, want)).encode(), w.library.decode(want, skip_special_tokens=False).encode()], t
    assert bpe_automaton.encode_documents(docs).count() == len(ROWS) and bpe_automaton.encode_documents(none).count() == 0


def test_small_automaton(monkeypatch):
    """All words over three letters, against merging by hand."""
    from itertools import product

    merges = [("a", "a"), ("b", "a</w>"), ("aa", "b"), ("a", "b"), ("aa", "a"), ("c", "ab")]
    letters = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    vocabulary = {t: i for i, t in enumerate(letters + [x + y for x, y in merges])}
    auto = bpe_automaton.MergeAutomaton(vocabulary, merges)
    words = [word for n in range(1, 8) for word in product("abc", repeat=n)]
    ids, starts = auto.encode(["".join(word).encode() for word in words])
    alone = [auto.encode(["".join(word).encode() * 40]) for word in words[1000:1010]]
    monkeypatch.setattr(bpe_automaton, "LONG", 1)
    assert all((auto.encode(["".join(word).encode() * 40])[0] == a[0]).all() for word, a in zip(words[1000:1010], alone, strict=True))
    for k, word in enumerate(words):
        parts = [*word[:-1], word[-1] + "</w>"]
        for x, y in merges:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == (x, y):
                    parts[i : i + 2] = [x + y]
                i += 1
        assert auto.decode(ids[starts[k] : starts[k + 1]]) == parts
        for u, v in zip(parts[:-1], parts[1:], strict=True):
            assert auto.arcs(np.array([vocabulary[u]]), np.array([vocabulary[v]]))[0]


def counts_by_hand(t):
    words = (t or "").encode().split()
    words = [w.decode() for w in words]
    grams = defaultdict(list)
    for i in range(len(words) - 4):
        grams[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, none, labels):
    rows = ROWS + [(30, "a b c d e a b c d e f\nx\nx\n \n", "en", "a", 1)]
    spark = docs.sparkSession
    got = quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), labels).collect()
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(counts_by_hand(r[1]))
    assert len(got) == len(rows)
    for r in got:
        c = tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert c in want[r["doc_id"]]
        assert r["base_failed"] == (c[0] < 10 or 100 * c[4] > 20 * c[0]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.verdicts(none, labels).count() == 0
    assert quality_rules.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(10, 0), (300, 0), (600, 2), (50, 50), (1000, 10), (5000, 30)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.tail(F.col("n"), F.col("k"), 0.01).alias("p"))
    for r in df.collect():
        exact = sum(comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(exact, rel=1e-9) or (r["k"] > 0.01 * r["n"] and r["p"] == 1)


def test_binomial_tail_large(spark):
    """Exact at every size: against all terms summed by their logarithms."""
    from math import lgamma, log, log1p

    from pyspark.sql import functions as F

    cases = [(2000, 16), (100_000, 900), (10_050_000, 100_100), (12_000_000, 119_300), (12_000_000, 120_000), (40_000_000, 398_900)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.tail(F.col("n"), F.col("k"), 0.01).alias("p"))
    for r in df.collect():
        n, k = r["n"], r["k"]
        i = np.arange(1, k + 1)
        terms = n * log1p(-0.01) + np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i).astype(np.longdouble) + log(0.01 / 0.99))])
        assert r["p"] == pytest.approx(float(np.exp(terms).sum()), rel=1e-8)
        at_k = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(0.01) + (n - k) * log1p(-0.01)
        assert r["p"] > np.exp(at_k) * (1 - 1e-5)


def test_cutoffs_hold_back(spark):
    """With enough good documents a cutoff is found that rejects the bad; with few none is."""
    from pyspark.sql import functions as F

    rows = [(i, text(i, 40) if i % 10 else " ".join(w + "###" for w in text(i, 40).split()), "en", "a", 1) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(8000)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(df, marks).where("not base_failed").collect()}
    assert all(k == (i % 10 > 0) for i, k in kept.items())
    assert all(r["kept"] for r in quality_rules.verdicts(df, marks.limit(50)).where("not base_failed").collect())
    # Rows without an id, or with one that others have, stay by their own scores.
    nameless = df.select(F.when(F.col("doc_id") > 4000, F.col("doc_id")).when(F.col("doc_id") > 2000, F.lit(0)).alias("doc_id"), "text", "lang", "source", F.lit(3).alias("n_words"))
    stay = quality_rules.keep_good(nameless, marks)
    assert stay.columns == nameless.columns
    told = stay.select(F.col("text").contains("###").alias("bad"), "doc_id").collect()
    assert not any(r["bad"] for r in told) and sum(r["doc_id"] is None for r in told) > 1000 and sum(r["doc_id"] == 0 for r in told) > 1000


def test_cutoffs_bound_all_scores_together(spark):
    """Five scores that each reject 0.4 % of the good documents reject 2 % together, so no step may pass; one of them alone may."""
    names = list(quality_rules.CUTOFFS)
    labels = spark.createDataFrame([(i, 1) for i in range(5000)], "doc_id long, quality int")

    def steps(scores_at_once):
        rows = [(i, False, 1, *(1e3 if i % 250 == k and k < scores_at_once else 0.0 for k in range(len(names)))) for i in range(5000)]
        scores = spark.createDataFrame(rows, "doc_id long, base_failed boolean, length_class int, " + ", ".join(f"{s} double" for s in names))
        return quality_rules.learned_steps(scores, labels).collect()

    assert steps(5) == [] and [r["step"] for r in steps(1)] == [quality_rules.STEPS - 1]
    assert sum(0.99**n <= quality_rules.RISK / len(quality_rules.CLASSES) for n in (436, 437)) == 1


def test_line_dedup(docs, none):
    got = {r["doc_id"]: r for r in line_dedup.clean_lines(docs).collect() if r["doc_id"] is not None}
    assert got[11]["text"] == ROWS[10][1] and got[12]["text"] == text(3) and got[15]["text"] == text(6) and got[15]["n_removed"] == 1
    assert got[4]["text"] == "" and got[6]["text"] == " \t\n "
    assert line_dedup.clean_lines(docs).count() == len(ROWS) and line_dedup.clean_lines(none).count() == 0
    assert all(r["n_removed"] == 0 for r in line_dedup.clean_lines(docs, min_sites=6).collect())


def test_sharding(docs, none):
    got = sharding.shard(docs, shards=5).collect()
    assert len(got) == len(ROWS) and all(0 <= r["shard"] < 5 for r in got)
    for s in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none).count() == 0


def test_shards_are_even(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "x" * int(n), "en" if i % 3 else "fr", f"s{i % 4 if i % 2 else 0}") for i, n in enumerate(rng.integers(0, 400, 4000))]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).groupBy("shard").sum("size").collect()
    sizes = [r["sum(size)"] for r in got]
    assert len(sizes) == 24 and max(sizes) <= 1.06 * min(sizes)  # about ten copies of each text, in shards of 80 rows


def cuts_by_hand(rows, shards):
    """Shards by recursive weighted medians of points: weight, three coordinates, order of ties."""
    out, todo = {}, [(rows, 0, shards)]
    while todo:
        part, first, leaves = todo.pop()
        if leaves == 1 or not part:
            out |= {r[4]: first for r in part}
            continue
        d = max(range(3), key=lambda i: (max(r[1 + i] for r in part) - min(r[1 + i] for r in part), -i))
        half, total, before = leaves // 2, sum(r[0] for r in part), 0
        sides = [], []
        for r in sorted(part, key=lambda r: (r[1 + d], r[4])):
            before += r[0]
            sides[(2 * before - r[0]) * leaves > 2 * total * half].append(r)
        todo += [(sides[0], first, half), (sides[1], first + half, leaves - half)]
    return out


def test_cuts_are_weighted_medians(spark):
    """Equal texts are one point, also where their sources differ."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    rows = [(i, text(i % 300, 5 + i % 57), ("en", "fr", None)[i % 3], f"s{i % 5}") for i in rng.permutation(400).tolist()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    place = lambda v: zlib.crc32((v or "").encode()) / 2**32
    names = {r["text"]: r["name"] for r in df.select("text", F.xxhash64("text").alias("name")).collect()}
    sizes = sorted(len(t) + 8 for _, t, *_ in rows)
    quantiles = [sizes[int(np.ceil(k / sharding.STEPS * len(sizes))) - 1] for k in range(1, sharding.STEPS)]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    points = [(len(g) * (len(t) + 8), sum(q < len(t) + 8 for q in quantiles) / sharding.STEPS, min(place(r[2]) for r in g), min(place(r[3]) for r in g), (names[t], zlib.crc32(t.encode()), len(t) + 8)) for t, g in groups.items()]
    want = cuts_by_hand(points, 7)
    got = sharding.shard(df, shards=7, whole=1.0).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == {i: want[names[t], zlib.crc32(t.encode()), len(t) + 8] for i, t, *_ in rows}


def test_hot_groups_are_divided(spark):
    """A text that makes up a third of all rows, some without id, does not keep shards from coming out even; small groups stay whole."""
    rows = [(i if i % 2 else None, text(0, 30), "en", "a") for i in range(1500)] + [(i, text(i // 4 + 1, 30), f"l{i % 4}", f"s{i % 7}") for i in range(1500, 4500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=8).collect()
    sizes, shards = defaultdict(int), defaultdict(set)
    for r in got:
        sizes[r["shard"]] += r["size"]
        if r["doc_id"] is not None and r["doc_id"] >= 1500:
            shards[r["doc_id"] // 4].add(r["shard"])
    assert len(got) == 4500 and len(sizes) == 8 and max(sizes.values()) <= 1.03 * min(sizes.values()) and all(len(x) == 1 for x in shards.values())


def test_language_id(docs, none):
    net = language_id.train(docs)
    got = language_id.predict(docs.select("doc_id", "text"), net).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6, 16)} == dict.fromkeys((4, 5, 6, 16), "und")
    assert language_id.train(none) is None and language_id.predict(none, None).count() == 0
    assert language_id.keep_identified(docs).columns == docs.columns


def test_language_id_learns(spark):
    sets = {"aa": "shu mik rav ton bel", "bb": "qua zor ñeb plé wix"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join("".join(rng.choice(sets[k].split(), 2)) for _ in range(80)), k) for i in range(400) for k in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(df, language_id.train(df)).where("lang_pred = lang").count()
    assert got >= 396


def test_language_id_takes_all_labels(spark):
    rows = [(i, f"word{i % 100} and {i}", f"l{i % 100:02}") for i in range(1000)]
    windows, labels, languages = language_id.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == [f"l{i:02}" for i in range(100)] and set(labels.tolist()) == set(range(100)) and len(windows) == len(labels)


def test_suffix_tree(docs, none):
    got = suffix_tree.score(docs).collect()
    rows = ROWS
    assert len(got) == len(rows)
    train = [w for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 10 for w in [*(t or "").encode().lower().split(), None]]
    n, v = len(train), len(set(train))
    c = defaultdict(int)
    for w in train:
        c[w] += 1
    want = defaultdict(list)
    for i, t, *_ in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        want[i].append((len(tokens), sum(c.get(w, 0) > 0 for w in tokens), sum(np.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    for r in got:
        assert r["train_tokens"] == n and any((r["n_tokens"], r["n_known"]) == a[:2] and r["base_score"] == pytest.approx(a[2]) for a in want[r["doc_id"]])
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) and r["score"] < 0
    assert suffix_tree.score(none).count() == 0


def test_suffix_tree_of_any_ids(spark):
    """Ids over the whole range of longs, and rows without one, score as they would under small ids."""
    rng = np.random.default_rng(4)
    texts = [text(i, 30) for i in range(400)]
    ids = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 396)] + [-(2**63), 2**63 - 1, None, None]
    got = suffix_tree.score(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), block_bytes=3000).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, ids))
    scores, _ = longest_suffix_scores(list(zip(ids, texts, strict=True)))
    want = {i: s for i, s in zip(ids, scores, strict=True) if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-6)


def longest_suffix_scores(rows, divergence=suffix_tree.DIVERGENCE, prior=suffix_tree.PRIOR):
    """Scores and number of nodes by plain counting, where each byte is looked up by its longest context that is a node."""
    depth, body = suffix_tree.DEPTH, lambda t: b" ".join((t or "").encode().lower().split()) + b"\n"
    n = defaultdict(lambda: defaultdict(int))
    for i, t, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            b = b"\n" * depth + body(t)
            for at in range(depth, len(b)):
                for k in range(depth + 1):
                    n[b[at - k : at]][b[at]] += 1
    all_ = {c: sum(row.values()) for c, row in n.items()}
    far = lambda c: sum(m * np.log(m / all_[c] / (n[c[1:]][x] / all_[c[1:]])) for x, m in n[c].items())
    nodes = {c[i:] for c in list(n) if c and far(c) >= divergence for i in range(len(c))}

    def chance(c, x):
        if not c:
            return (n[b""][x] + 0.5) / (all_.get(b"", 0) + 128)
        weight = prior * sum(m > 0 for m in n[c].values())
        return (n[c][x] + weight * chance(c[1:], x)) / (all_[c] + weight)

    known, out = {}, []
    for _, t, *_ in rows:
        b, score = b"\n" * depth + body(t), 0.0
        for at in range(depth, len(b)):
            run = b[at - depth : at + 1]
            if run not in known:
                c = run[:-1]
                while c and c not in nodes:
                    c = c[1:]
                known[run] = np.log10(chance(c, run[-1]))
            score += known[run]
        out.append(score)
    return out, len(nodes)


def test_suffix_tree_beats_words_on_held_out_texts(spark):
    """Over the documents of sf0.01, of which a tenth is held out: the tree gives more than the model of whole words."""
    from pyspark.sql import functions as F

    held = suffix_tree.op1_suffix_tree(spark, "/root/testdata/sf0.01").where("held_out")
    r = held.agg(F.count("*").alias("n"), F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert r["n"] > 50 and r["score"] > r["base"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_suffix_tree_scores(spark, monkeypatch, broadcast):
    """Score by score; a word three times among 1.2 MB is learned, whatever share of the bytes it makes up."""
    if not broadcast:
        monkeypatch.setattr(suffix_tree, "BROADCAST_RUNS", 10)
    rows = [(1, text(1, 240_000)), *((i, f"zqxjk {text(i, 9)}") for i in (3, 4, 6)), *((i, text(i)) for i in range(20, 40)), (41, "é日本 Zqxjk"), (42, None), (42, "zqxjk"), (10**15, "far away")]
    want, nodes = longest_suffix_scores(rows)
    got = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=2000).collect()
    assert len(got) == len(rows) and nodes > 50
    scored = sorted((r["doc_id"], r["score"]) for r in got)
    assert np.allclose(scored, sorted((i, s) for (i, _), s in zip(rows, want, strict=True)), rtol=1e-9, atol=1e-6)


def small_network(rng):
    e, f, wide = language_id.EMBEDDED, language_id.FILTERS, max(language_id.WIDTHS)
    filters = rng.normal(size=(wide * e, f * len(language_id.WIDTHS))).astype(np.float32)
    for k, width in enumerate(language_id.WIDTHS):
        filters[width * e :, k * f : (k + 1) * f] = 0
    n = f * len(language_id.WIDTHS)
    return language_id.ByteNetwork(["a", "b", "c"], rng.normal(size=(256, e)).astype(np.float32), filters, rng.normal(size=n).astype(np.float32), rng.normal(size=(n, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))


def test_language_network_by_hand():
    """The forward pass against plain loops over bytes and filters."""
    rng = np.random.default_rng(0)
    net = small_network(rng)
    windows = rng.integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    got = net.probabilities(windows)
    for w, p in zip(windows, got, strict=True):
        wide, e = max(language_id.WIDTHS), language_id.EMBEDDED
        best = np.full(net.filters.shape[1], -np.inf)
        for at in range(len(w) - wide + 1):
            total = np.zeros(net.filters.shape[1])
            for k in range(wide):
                total += net.embedding[w[at + k]].astype(float) @ net.filters[k * e : (k + 1) * e]
            best = np.maximum(best, total)
        hidden = np.maximum(best + net.bias, 0)
        logits = hidden @ net.weights + net.offset
        want = np.exp(logits - logits.max())
        assert np.allclose(p, want / want.sum(), atol=1e-4)


def test_language_sample_is_bounded_by_rows(spark):
    """A repeated id neither fills the sample nor keeps its language out of it."""
    rows = [(1, text(i, 40), "en") for i in range(3000)] + [(i, text(i % 7, 30), "fr") for i in range(500, 1500)] + [(1, text(7, 50), "de")] * 4000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    windows, labels, languages = language_id.training_windows(docs, sample=300, least=20, most_windows=2)
    assert languages == ["de", "en", "fr"]
    counts = np.bincount(labels, minlength=3)
    assert 1 <= counts[0] <= 2 and 100 <= counts[1] <= 200 and 100 <= counts[2] <= 200

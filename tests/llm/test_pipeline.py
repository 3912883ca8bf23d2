"""The pipeline's stages, each against a plain version over what the one before kept."""

from collections import defaultdict

import duckdb
import numpy as np

import corpus_pipeline
from ripplebed.llm import quality_rules
from ripplebed.llm.base import staged
from ripplebed.llm.token_ids import TextEncoder, byte_bpe_path

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = t.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), "test-stage")
        if name != "packing":
            assert out.columns == docs.columns
        kept.append([r.asDict() for r in out.collect()])
        docs = out
    quality, language, exact, near, pieces = kept
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE_SQL}) WHERE kept").fetchall()
    assert sorted(r["doc_id"] for r in quality) == sorted(x for (x,) in want)
    assert {r["doc_id"] for r in language} <= {r["doc_id"] for r in quality} and len(language) >= 0.97 * len(quality)
    by_text = defaultdict(list)
    for r in language:
        by_text[r["text"].encode().lower()].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(map(max, by_text.values()))
    sets, top = {r["doc_id"]: shingles(r["text"]) for r in exact}, {}

    def root(i):
        while top.get(i, i) != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in near} == {i for i in sets if root(i) == i}
    e, lengths = TextEncoder(byte_bpe_path()), defaultdict(int)
    for p in pieces:
        lengths[p["doc_id"]] += p["length"]
    assert lengths == {r["doc_id"]: len(e.whole(r["text"])) + 1 for r in near}


def test_results_that_live_side_by_side(spark):
    """A stage that is called again, or a whole run in between, leaves earlier results as they are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality rules", "exact dedup", "near dedup"):
        one = stages[name](spark, docs, SF)
        want = one.count()
        other = stages[name](spark, docs.limit(50), SF)
        pieces = corpus_pipeline.run(spark, SF)
        again = corpus_pipeline.run(spark, SF)
        assert one.count() == want and other.count() <= 50
        assert pieces.count() == again.count() > 0


def test_awkward_rows(spark, tmp_path):
    """Nulls, repeated ids, repeated rows, long texts, columns with names of the stages' own; and an empty table."""
    rng = np.random.default_rng(0)
    words = "the of and in to river stone light water field house green open slow by with from under over after".split()
    prose = lambda n: " ".join(rng.choice(words, n))
    one, two, three, four = (prose(80) for _ in range(4))
    rows = [(i, prose(60), "en", "s") for i in range(100, 180)]
    rows += [(1, one, "en", "a"), (1, one, "en", "a"), (2, one.upper(), None, None), (3, two, "en", "b"), (3, three, "en", "b"), (None, four, "en", None), (None, None, None, None)]
    rows += [(4, None, "en", "a"), (5, "", "en", "a"), (6, "few words", "en", "a"), (7, prose(40_000), "en", "a"), (8, "x" * 300_000 + " " + prose(40), "en", "a")]
    schema = "doc_id long, text string, lang string, source string, row long, rep long, component_id long, n_words long, kept boolean, doc string"
    docs = spark.createDataFrame([(*r, 7, 7, 7, 7, False, "x") for r in rows], schema)
    folder = str(tmp_path / "sf")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), "test-stage")
        if name != "packing":
            assert docs.schema.names == schema.replace(",", "").split()[::2]
            kept.append(docs.collect())
    quality, language, exact, near = ([(r["doc_id"], r["text"]) for r in k] for k in kept)
    has_words = [r[:2] for r in rows if r[1] and len(r[1].split()) >= 10 and r[0] not in (7,)]
    assert sorted(map(str, quality)) == sorted(map(str, has_words)) or sorted(map(str, quality)) == sorted(map(str, [*has_words, *(r[:2] for r in rows if r[0] == 7)]))
    assert len(language) >= len(quality) - 1
    texts = {t.lower() for _, t in language}
    assert len(exact) == len(texts) == len({t.lower() for _, t in exact})
    assert (2, one.upper()) in exact and (None, four) in exact and {(3, two), (3, three)} <= set(exact)
    assert sorted(map(str, near)) == sorted(map(str, exact))
    lengths = defaultdict(int)
    for p in docs.collect():
        lengths[p["doc_id"]] += p["length"]
    e = TextEncoder(byte_bpe_path())
    want = defaultdict(int)
    for i, t in near:
        want[i] += len(e.whole(t)) + 1
    assert lengths == want
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = staged(stage(spark, empty, folder), "test-stage")
        assert empty.count() == 0

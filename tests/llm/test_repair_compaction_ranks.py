"""Conversation repair, the rank queue and bin-packed compaction against brute force."""

import datetime as dt
import hashlib
import heapq
import math
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ripplebed.llm import compaction, conversation_repair, rank_queue
from ripplebed.llm.base import new_path

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def damaged(cid, rows):
    text = lambda x: " " if x is None else str(x)
    out = []
    for turn, role, words in rows:
        kind, role, words = zlib.crc32(f"{text(cid)}:{text(turn)}".encode()) % 20, text(role), text(words)
        if kind == 0:
            continue
        words = "" if kind == 1 else re.sub("[.!?]", "", words) if kind == 2 else words
        out += [(turn, "user" if kind == 4 else role, words)] * (2 if kind == 3 else 1)
    name = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return sorted(out, key=name)


def repaired(rows):
    """By trying audits in the order of cost and letters: all of them for short conversations, else the first for each turn and state."""
    faults, seen = [], set()
    for _, role, words in rows:
        bare = words.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, words) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, words))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            break
        if (key := audit if len(rows) < 4 else (i, last)) in done:
            continue
        done.add(key)
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        made = {"u": "user", "a": "assistant"}
        heapq.heappush(heap, (cost + 2, audit + "I", i, follow[-1], (*lines, made[follow[-1]] + ":")))
        if i < len(rows):
            _, role, words = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = cost + (faults[i] == "truncated")
                if role[:1] and role[0] in follow:
                    heapq.heappush(heap, (more, audit + "K", i + 1, role[0], (*lines, f"{role}:{words}")))
                heapq.heappush(heap, (more + 2, audit + "R", i + 1, follow[-1], (*lines, f"{made[follow[-1]]}:{words}")))
    numbers = {r[0] for r in rows if r[0] is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = min(max(numbers) - min(numbers) + 1 - len(numbers), 2**63 - 1) if numbers else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def awkward_conversations():
    rng = np.random.default_rng(3)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", "User", None], ["Hi.", "Well", "", " \t", "So?", "é!  ", None, "x" * 5000 + "."]
    rows = [(c, int(t), roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]) for c in range(150) for t in range(rng.integers(1, 7))]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (None, None, "assistant", "Yes."), (900, -(2**63), "user", "a."), (900, 2**63 - 1, "assistant", "b.")]
    rows += [(901, 5, "user", "Same."), (901, 5, "user", "Same."), (901, 5, "assistant", "Other."), (902, None, None, None)]
    return rows + [(903, t, "user" if t % 3 else "assistant", f"turn {t}.") for t in range(40)]


@pytest.mark.parametrize("block", [512, 3])
def test_conversation_repair(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rows, convs = awkward_conversations(), defaultdict(list)
    for c, *r in rows:
        convs[c].append(r)
    df = spark.createDataFrame(rows, TURNS).select("*", F.lit(1).alias("place"), F.lit("x").alias("audit"), F.lit(None).alias("gone")).repartition(3)
    turns = conversation_repair.damage(conversation_repair.turns_of(df))
    found = conversation_repair.audits(turns)
    got = conversation_repair.digests(turns, found).collect()
    assert len(got) == len(convs)
    lines = {}
    for r in got:
        want, lines[r["conv_id"]] = repaired(damaged(r["conv_id"], convs[r["conv_id"]]))
        assert tuple(r)[1:] == want, r["conv_id"]
    made = defaultdict(list)
    for r in conversation_repair.repaired_turns(turns, found).orderBy("place").collect():
        made[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: tuple(x) for c, x in made.items()} == {c: x for c, x in lines.items() if x}


def test_conversation_repair_all_of_a_table(spark):
    convs = defaultdict(list)
    for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist():
        convs[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    got = conversation_repair.op11_conversation_repair(spark, SF).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {c: repaired(damaged(c, rows))[0] for c, rows in convs.items()}


def test_conversation_repair_empty(spark):
    turns = conversation_repair.turns_of(spark.createDataFrame([], TURNS))
    assert conversation_repair.digests(turns, conversation_repair.audits(turns)).count() == 0


def tiktoken_of(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_queue_of_any_ranks():
    """Vocabularies that no merges would give, so that lesser ranks come up late."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        tokens = {bytes([b]) for b in range(256)} | {bytes(rng.choice(list(b"abc"), rng.integers(2, 6)).astype(np.uint8)) for _ in range(40)}
        single, rest = sorted(t for t in tokens if len(t) == 1), sorted(t for t in tokens if len(t) > 1)
        order = rng.permutation(len(rest))
        ranks = {t: i for i, t in enumerate([*single, *(rest[i] for i in order)])}
        words = ["".join(rng.choice(list("abc"), rng.integers(1, 40))) for _ in range(60)] + ["a" * 50, "ab" * 30]
        ids, sizes = rank_queue.RankMerger(ranks).encode([w.encode() for w in words])
        library, at = tiktoken_of(ranks), np.concatenate([[0], np.cumsum(sizes)])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode_ordinary(w) for w in words]


def test_rank_bitmap():
    queue, rng, held = rank_queue.RankQueue(70_000), np.random.default_rng(0), []
    ranks = rng.integers(-1, 70_000, 2000)
    queue.push_all(ranks, np.arange(2000))
    for r in rng.integers(0, 70_000, 200).tolist():
        queue.push(r, r)
        held.append(r)
    want = sorted({*held, *ranks[ranks >= 0].tolist()})
    got = []
    while (found := queue.pop()) is not None:
        got.append(found[0])
    assert got == want and not any(any(level) for level in queue.levels)


def test_rank_queue(spark):
    rng = np.random.default_rng(1)
    parts = ["a", "b", " ", "é", "日", "😀", "\n", "'s", "'re", "0", "the", "ing", "  ", "×", " ", "<|endoftext|>", "ß", "\x00"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(1500)] + ["a" * 200_000, "xyz" * 30_000, " " * 9_000, "日本" * 4_000, "", None]
    rows = [(i if i % 7 else None, t, 1, "y") for i, t in enumerate([*texts, *texts[:20]])]
    got = rank_queue.digests(spark.createDataFrame(rows, "doc_id long, text string, ids long, decoded string").repartition(3)).collect()
    library = tiktoken_of(rank_queue.read_ranks(rank_queue.rank_file_path()))

    def want(t):
        ids = library.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((i, *want(t)) for i, t, *_ in rows), key=key)
    assert rank_queue.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rank_queue_round_trip(spark):
    docs = spark.createDataFrame([(1, "Déjà vu, 日本!"), (2, None), (3, "x" * 500)], "doc_id long, text string")
    back = rank_queue.decode_documents(rank_queue.encode_documents(docs)).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back} == {1: "Déjà vu, 日本!", 2: "", 3: "x" * 500}
    none = spark.createDataFrame([(7, None), (8, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in rank_queue.decode_documents(none).collect()] == [b"", b""]


# --- compaction -------------------------------------------------------------


def dealt_files(rows):
    """Starting files by (day, lot, piece), each with its rows in order."""
    n, days, files = len(rows), defaultdict(int), defaultdict(list)
    day_of = [None if r["arrived_at"] is None else (r["arrived_at"] - dt.datetime(1970, 1, 1)).days for r in rows]
    for d in day_of:
        days[d] += 1
    for r, d in zip(rows, day_of, strict=True):
        h = zlib.crc32(("" if r["click_id"] is None else str(r["click_id"])).encode())
        files[d, h // 16 % (1 + days[d] // (1 + n // 150)), min(h % 4, h // 4 % 4)].append(r)
    low = dt.datetime(1, 1, 1)
    for f in files.values():
        f.sort(key=lambda r: (r["arrived_at"] or low, r["click_id"] is not None, r["click_id"] or 0))
    return files


def final_files(rows, columns):
    files, n, out = dealt_files(rows), len(rows), {}
    for d in {k[0] for k in files}:
        mine = {k: len(f) for k, f in files.items() if k[0] == d}
        groups = []
        for k in sorted((k for k in mine if mine[k] < 1 + n // 600), key=lambda k: (-mine[k], k[1:])):
            fits = [g for g in groups if sum(mine[x] for x in g) + mine[k] <= 1 + n // 400]
            fits[0].append(k) if fits else groups.append([k])
        for g in [*groups, *([k] for k in mine if mine[k] >= 1 + n // 600)]:
            held = [r for k in g for r in files[k]]
            ids = [r["click_id"] for r in held]
            known = [i for i in ids if i is not None]
            cents = sum(math.floor(100 * r["value"] + 0.5) for r in held if r["value"] is not None and math.isfinite(r["value"]))
            digest = hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()
            out[g[0]] = (len(held), min(known, default=None), max(known, default=None), cents, ",".join(f"{k[1]}-{k[2]}" for k in g), digest, columns, len(g) > 1)
    return out


def check_compaction(spark, clicks, rows):
    path = new_path(spark, "clicks-test")
    folder = compaction.write_dealt(clicks, path)
    root = path.removeprefix("file://").removeprefix("file:")
    listed = lambda: {os.path.join(a, f): os.path.join(a, f) for a, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}
    before = {f: open(f, "rb").read() for f in listed()}
    starts = dealt_files(rows)
    assert len(before) == len(starts)
    planned = compaction.compact(spark, folder, folder.part(compaction.SMALL), folder.part(compaction.FULL))
    got = compaction.digests(spark, folder, planned).collect()
    want = final_files(rows, ",".join(clicks.columns))
    fields = ["n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "columns", "rewritten"]
    assert {(r["day"], r["lot"], r["piece"]): tuple(r[f] for f in fields) for r in got} == want
    plain = lambda p: p.removeprefix("file://").removeprefix("file:")
    assert sorted(plain(r["path"]) for r in got) == sorted(listed())
    for r in got:
        f = plain(r["path"])
        assert r["rewritten"] == (f not in before)
        if not r["rewritten"]:
            assert open(f, "rb").read() == before[f]
        assert pq.ParquetFile(f).schema_arrow.names == clicks.columns
    return folder, got


def test_compaction_of_a_table(spark):
    clicks = spark.read.parquet(f"{SF}/clicks.parquet")
    folder, got = check_compaction(spark, clicks, pq.read_table(f"{SF}/clicks.parquet").to_pylist())
    assert sum(r["rewritten"] for r in got) > 100
    assert folder.read(spark).drop(*folder.keys).exceptAll(clicks).isEmpty()


def test_compaction_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    day = lambda i: dt.datetime(1969, 12, 30) + dt.timedelta(days=int(rng.integers(0, 5)), seconds=int(rng.integers(0, 5)))
    schema = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, value double, day string, Lot string, row_index long, path string, place int, h int"
    rows = [(int(rng.integers(-50, 50)), None, day(i), float(rng.normal()), "d", "l", i, "p", 1, 2) for i in range(900)]
    rows += [(None, None, None, None, None, None, None, None, None, None)] * 3 + [(5, None, None, float("nan"), "", "", 0, "", 0, 0), (5, None, day(0), float("inf"), "", "", 0, "", 0, 0)]
    rows += [(7, None, dt.datetime(2030, 1, 1), 0.005, "x" * 100_000, "", 0, "", 0, 0)] * 400  # one day has a third
    clicks = spark.createDataFrame(rows, schema).repartition(5)
    check_compaction(spark, clicks, [r.asDict() for r in clicks.collect()])


def test_compaction_of_nothing(spark):
    clicks = spark.createDataFrame([], "click_id long, arrived_at timestamp_ntz, value double")
    folder = compaction.write_dealt(clicks, new_path(spark, "clicks-none"))
    planned = compaction.compact(spark, folder, folder.part(600), folder.part(400))
    assert compaction.digests(spark, folder, planned).count() == 0


def test_first_fit(spark):
    rng = np.random.default_rng(9)
    sizes = {d: [int(x) for x in rng.integers(1, 60, rng.integers(1, 40))] for d in range(20)}
    files = spark.createDataFrame([(d, i, 0, f"{d}/{i}", n) for d, ns in sizes.items() for i, n in enumerate(ns)], "day long, lot long, piece int, path string, n long")
    got = {(r["day"], r["lot"]): (r["sources"], r["place"]) for r in compaction.plan(files, 50, 75).collect()}
    want = {}
    for d, ns in sizes.items():
        groups = []
        for i in sorted((i for i, n in enumerate(ns) if n < 50), key=lambda i: (-ns[i], i)):
            fits = [g for g in groups if sum(ns[x] for x in g) + ns[i] <= 75]
            fits[0].append(i) if fits else groups.append([i])
        want |= {(d, i): (",".join(f"{x}-0" for x in g), k) for g in groups if len(g) > 1 for k, i in enumerate(g)}
    assert got == want



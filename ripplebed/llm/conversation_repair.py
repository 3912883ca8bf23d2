"""Cheapest repair of damaged conversations, as a higher-order fold in Spark SQL.

A conversation should read as an optional system turn and then pairs of user and
assistant.  Its turns are numbered and flagged by window functions (blank, repeated,
cut off), their short codes are collected in order, and ``aggregate()`` carries four
structs of cost and audit: the cheapest ways to have written nothing yet, a system, a
user or an assistant turn.  ``least`` compares structs by cost and then by audit, in
ASCII order.  An audit's letters fix its cost, so no audit is the beginning of an
equally cheap one, and the least of two stays the least whatever follows.

Long conversations are folded in blocks of ``BLOCK`` turns.  A block's fold starts from
each of the four states; the folds of blocks are chained by the same ``least``.  So a
task holds codes of ``BLOCK`` turns and the audits, a letter for each turn, but never
the texts: these meet their audit in a sorted stream, and a conversation's turns go
through one task in order, as the digest of its whole repaired text demands.

Defined results: null ids make one conversation; turns of no number come first; a null
role or text reads as one space; turns of one number stand in the order of role and of
the SHA-256 of text, repeated ones side by side; a role counts by its first letter, in
lower case, and others than s, u and a have to be changed or deleted; texts may be
empty or of any length; gaps beyond 2^63-1 are that number; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ripplebed.llm.base import bounded_batches

#: Turns that are folded at once.
BLOCK = 512
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: What an undeleted turn costs more that ends without a full stop.
CUT_OFF = 1
START, SYSTEM, USER, ASSISTANT = STATES = ("start", "system", "user", "assistant")
#: White space, as trimmed from texts.
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: A cost that no audit has.
NEVER = 1 << 40
COUNTS = ("blank", "duplicate", "truncated", "illegal")
FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls as one space), ``copy`` (0) and ``gone`` (false)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return bounded_batches(conversations).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(0).alias("copy"), F.lit(False).alias("gone")
    )


def damage(turns: DataFrame) -> DataFrame:
    """Turns with known faults, by a checksum of conversation and turn: of twenty, one each is gone, emptied, cut off, repeated and given to the user."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, USER).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return turns.withColumn("kind", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"), (F.col("gone") | (F.col("kind") == 0)).alias("gone"))


def identity(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def flagged(turns: DataFrame) -> DataFrame:
    """conv_id, gone, place and, as far as the turn isn't gone, its initial and its flags; no texts."""
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    short = turns.select("conv_id", "gone", "turn", "role", "copy", identity().alias("name"), end.alias("end"))
    whole = Window.partitionBy("conv_id", "gone").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "name", "copy")))
    same = Window.partitionBy("conv_id", "gone", "role", "name").orderBy(F.col("turn").asc_nulls_first(), "copy")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(whole), initial)
    seen = short.select(
        "*", initial.alias("initial"), (F.row_number().over(same) > 1).alias("again"), (F.row_number().over(whole) - 1).alias("place"), (~pair.isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(whole))).alias("new_turn"),
    )
    blank = F.col("end") == ""
    return seen.select(
        "conv_id", "gone", "place", "turn", "new_turn", "initial", blank.alias("blank"), (~blank & F.col("again")).alias("duplicate"),
        (~blank & ~F.col("again") & ~F.col("end").isin(*ENDS)).alias("truncated"), F.coalesce("illegal", F.lit(False)).alias("illegal"),
    )


# --- the fold ---------------------------------------------------------------


def _way(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _more(way: Column, cost: Column | int, letters: Column | str) -> Column:
    return _way(way["cost"] + cost, F.concat(way["audit"], F.lit(letters) if isinstance(letters, str) else letters))


def _ways(**states: Column) -> Column:
    return F.struct(*(states[s].alias(s) for s in STATES))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _no_way() -> Column:
    return _way(F.lit(NEVER), F.lit(""))


def _with_inserts(ways: Column) -> Column:
    """The ways with inserted turns behind them, where that is cheaper."""
    insert = lambda w: _more(w, COSTS[INSERT], INSERT)

    def close(w: Column) -> Column:
        user = F.least(w[USER], insert(w[START]), insert(w[SYSTEM]), insert(w[ASSISTANT]))
        return _ways(start=w[START], system=w[SYSTEM], user=user, assistant=F.least(w[ASSISTANT], insert(user)))

    return _let(ways, close)


def _begin(state: str) -> Column:
    return _with_inserts(_ways(**{s: _way(F.lit(0), F.lit("")) if s == state else _no_way() for s in STATES}))


def _step(ways: Column, turn: Column) -> Column:
    """The ways after one more turn (a struct of ``initial``, ``delete`` and ``truncated``)."""
    extra = F.when(turn["truncated"], CUT_OFF).otherwise(0)

    def to(state: str, *before: str) -> Column:
        alike = turn["initial"] == state[0]
        cost = F.when(alike, COSTS[KEEP]).otherwise(COSTS[REROLE]) + extra
        best = F.least(*(ways[b] for b in before)) if len(before) > 1 else ways[before[0]]
        return F.when(turn["delete"], _no_way()).otherwise(_more(best, cost, F.when(alike, KEEP).otherwise(REROLE)))

    system = F.when(~turn["delete"] & (turn["initial"] == SYSTEM[0]), _more(ways[START], COSTS[KEEP] + extra, KEEP)).otherwise(_no_way())
    new = {START: None, SYSTEM: system, USER: to(USER, START, SYSTEM, ASSISTANT), ASSISTANT: to(ASSISTANT, USER)}
    dropped = {s: _more(ways[s], COSTS[DELETE], DELETE) for s in STATES}
    return _with_inserts(_ways(**{s: dropped[s] if w is None else F.least(dropped[s], w) for s, w in new.items()}))


def _fold(turns: Column, state: str) -> Column:
    return F.aggregate(turns, _begin(state), _step)


def _chain(ways: Column, block: Column) -> Column:
    """The ways through a block, from each state that the ways before it end in."""
    through = lambda a, b: _way(a["cost"] + b["cost"], F.concat(a["audit"], b["audit"]))
    return _ways(**{s: F.least(*(through(ways[b], block[b][s]) for b in STATES)) for s in STATES})


def audits(turns: DataFrame) -> DataFrame:
    """For each conv_id: gaps, blank, duplicate, truncated, illegal, cost and audit; a conversation whose turns are all gone has zeros and no letters."""
    count = lambda c: F.sum(F.when(~F.col("gone") & F.col(c), 1).otherwise(0)).alias(c)
    here = lambda c: F.when(~F.col("gone"), c)
    code = F.struct("place", "initial", (F.col("blank") | F.col("duplicate")).alias("delete"), "truncated")
    block = here((F.col("place") / BLOCK).cast("int"))
    of_block = flagged(turns).groupBy("conv_id", block.alias("block")).agg(
        F.sort_array(F.collect_list(here(code))).alias("codes"), F.min(here(F.col("turn"))).alias("least"), F.max(here(F.col("turn"))).alias("most"), *(count(c) for c in (*COUNTS, "new_turn"))
    )
    # The first block of a conversation begins with nothing written, so it needs no other fold.
    folds = [_fold(F.col("codes"), START).alias(START), *(F.when(F.col("block") > 0, _fold(F.col("codes"), s)).alias(s) for s in STATES[1:])]
    blocks = of_block.select("conv_id", "block", "least", "most", *COUNTS, "new_turn", F.struct(*folds).alias("ways"))
    joined = blocks.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", "ways")))).alias("blocks"), F.min("least").alias("least"), F.max("most").alias("most"),
        *(F.sum(c).alias(c) for c in (*COUNTS, "new_turn")),
    )
    rest = F.slice("blocks", 2, F.greatest(F.size("blocks") - 1, F.lit(0)))
    ways = F.when(F.size("blocks") > 0, F.aggregate(rest, F.col("blocks")[0]["ways"][START], lambda w, b: _chain(w, b["ways"]))).otherwise(_begin(START))
    best = joined.withColumn("ways", ways).withColumn("best", F.least(f"ways.{START}", f"ways.{ASSISTANT}"))
    wide = F.col("most").cast("decimal(38,0)") - F.col("least").cast("decimal(38,0)") + 1 - F.col("new_turn")
    gaps = F.when(wide.isNull(), 0).otherwise(F.least(wide, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long"))
    return best.select("conv_id", gaps.alias("gaps"), *(F.col(c).cast("long").alias(c) for c in COUNTS), "best.cost", "best.audit")


# --- repaired turns, as a stream ---------------------------------------------


def with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's row of ``found`` and behind it its turns in order: found, conv_id, role, text; whole conversations in a partition."""
    names = [c for c in found.columns if c != "conv_id"]
    kind = found.select(F.struct(*names).alias("found")).schema["found"].dataType
    heads = found.select("conv_id", F.struct(*names).alias("found"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("name", "binary"), ("copy", "int"), ("text", "string"))))
    rows = turns.where(~F.col("gone")).select("conv_id", F.lit(None).cast(kind).alias("found"), "turn", "role", identity().alias("name"), "copy", "text")
    ordered = [F.col("found").isNull(), *(F.col(c).asc_nulls_first() for c in ("turn", "role", "name", "copy"))]
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *ordered).select("found", "conv_id", "role", "text")


def replayed(batches) -> Iterator[tuple]:
    """From rows of ``with_audits``: (found, conv_id, None) where a conversation begins, then (letter, role, text) for each turn of the repaired one."""
    letters, last = iter(""), ""

    def inserted() -> tuple[str, str]:
        role = ASSISTANT if last == "u" else USER
        return role, role[0]

    for batch in batches:
        for found, conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if found is None:
                while (letter := next(letters)) == INSERT:
                    role_, last = inserted()
                    yield letter, role_, ""
                if letter == DELETE:
                    continue
                if letter == REROLE:
                    role, last = inserted()
                last = role[0]
                yield letter, role, text
                continue
            for letter in letters:  # what is inserted at the end
                role_, last = inserted()
                yield letter, role_, ""
            letters, last = iter(found["audit"]), ""
            yield found, conv_id, None
    for letter in letters:
        role_, last = inserted()
        yield letter, role_, ""


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place, role, text and the edit of each turn."""

    def rows(batches):
        out, conv_id, place = [], None, 0
        for head, a, b in replayed(batches):
            if isinstance(head, dict):
                conv_id, place = a, 0
                continue
            out.append((conv_id, place, a, b, head))
            place += 1
            if len(out) >= 1024:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "place", "role", "text", "edit"])

    return with_audits(turns, found).mapInArrow(rows, "conv_id long, place long, role string, text string, edit string")


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the SHA-256 of each repaired conversation: ``role:text`` of its turns, joined by line breaks."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.string() if n == "audit" else pa.int64() for n in names]

    def rows(batches):
        out, head, digest, begun = [], None, None, False
        for first, a, b in replayed(batches):
            if isinstance(first, dict):
                if head:
                    out.append((*head, digest.hexdigest()))
                    if len(out) >= 1024:
                        yield _batch(out)
                        out = []
                head, digest, begun = (a, *(first[n] for n in names)), hashlib.sha256(), False
                continue
            digest.update(("\n" * begun + f"{a}:{b}").encode())
            begun = True
        if head:
            yield _batch([*out, (*head, digest.hexdigest())])

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), *kinds, pa.string()], strict=True)], names=["conv_id", *names, "repaired_sha256"])

    return with_audits(turns, found).mapInArrow(rows, f"conv_id long, {FOUND}, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damage(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return digests(turns, audits(turns))


#: The same by a recursion over turns: for each number of turns and state the least cost and audit, written as one text.
ORACLE_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT),
  lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295) % 20 AS kind FROM k),
t AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
f AS (SELECT *, role[1] AS initial, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS fin, row_number() OVER w AS pos,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, lag(role[1]) OVER w AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
g AS (SELECT *, fin = '' AS blank, fin <> '' AND again AS duplicate, fin <> '' AND NOT again AND fin NOT IN ('.', '!', '?') AS truncated, coalesce(before || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM f),
c(a, b, letters, cost) AS (VALUES ('n', 'n', '', 0), ('n', 'u', 'I', 2), ('n', 'a', 'II', 4), ('s', 's', '', 0), ('s', 'u', 'I', 2), ('s', 'a', 'II', 4), ('u', 'u', '', 0), ('u', 'a', 'I', 2), ('a', 'a', '', 0), ('a', 'u', 'I', 2)),
m(a, b) AS (VALUES ('n', 's'), ('n', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
o AS (SELECT b AS a, b, 'D' AS letter FROM c WHERE letters = '' UNION ALL SELECT a, b, 'K' FROM m UNION ALL SELECT a, b, 'R' FROM m WHERE b <> 's'),
q(conv_id, pos, state, cost, audit) AS (SELECT DISTINCT conv_id, 0::BIGINT, 'n', 0, '' FROM k UNION ALL
  SELECT conv_id, pos, state, min(way)[:10]::INT, min(way)[11:] FROM (
    SELECT q.conv_id, g.pos, o.b AS state,
      lpad((q.cost + c.cost + CASE o.letter WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + CASE WHEN o.letter <> 'D' AND g.truncated THEN 1 ELSE 0 END)::VARCHAR, 10, '0') || q.audit || c.letters || o.letter AS way
    FROM q JOIN g ON q.conv_id IS NOT DISTINCT FROM g.conv_id AND g.pos = q.pos + 1 JOIN c ON c.a = q.state JOIN o ON o.a = c.b
    WHERE o.letter = 'D' OR NOT g.blank AND NOT g.duplicate AND (o.letter = 'R' AND g.initial <> o.b OR o.letter = 'K' AND g.initial = o.b)) GROUP BY conv_id, pos, state),
z AS (SELECT conv_id, count(*) AS n, sum(blank::INT)::BIGINT AS blank, sum(duplicate::INT)::BIGINT AS duplicate, sum(truncated::INT)::BIGINT AS truncated, sum(illegal::INT)::BIGINT AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM g GROUP BY conv_id),
y AS (SELECT k.conv_id, coalesce(z.n, 0) AS n, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM (SELECT DISTINCT conv_id FROM k) k LEFT JOIN z ON k.conv_id IS NOT DISTINCT FROM z.conv_id),
x AS (SELECT y.conv_id, min(lpad((q.cost + c.cost)::VARCHAR, 10, '0') || q.audit || c.letters) AS way FROM y JOIN q ON y.conv_id IS NOT DISTINCT FROM q.conv_id AND q.pos = y.n JOIN c ON c.a = q.state AND c.b IN ('n', 'a') GROUP BY y.conv_id),
v AS (SELECT conv_id, way[11:] AS audit, unnest(range(1, length(way) - 9)) AS i FROM x),
u AS (SELECT conv_id, i, audit[i] AS letter, i - length(replace(audit[:i], 'I', '')) AS inserted, length(replace(audit[:i], 'D', '')) AS place FROM v),
w AS (SELECT u.conv_id, i, letter, place, role, text FROM u LEFT JOIN g ON letter <> 'I' AND u.conv_id IS NOT DISTINCT FROM g.conv_id AND g.pos = i - inserted WHERE letter <> 'D'),
b AS (SELECT *, bool_or(place = 1 AND letter = 'K' AND role[1] = 's') OVER (PARTITION BY conv_id) AS led FROM w),
a AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS lines FROM b GROUP BY conv_id)
SELECT y.conv_id, gaps, blank, duplicate, truncated, illegal, way[:10]::BIGINT AS cost, way[11:] AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM y JOIN x ON y.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN a ON y.conv_id IS NOT DISTINCT FROM a.conv_id
"""

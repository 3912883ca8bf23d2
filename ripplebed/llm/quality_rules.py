"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every document gets counts over its whole text.  A fixed base rule rejects texts
that are very short or mostly repetition.  Beyond it, five scores (shares that
grow with junk) are cut off where labelled documents allow it.  A step of
``CUTOFFS`` has a cutoff for each score, and a document falls by any of them.  For
each length class the steps are tried from the loosest to the tightest, and the
tightest one is taken whose exact binomial test still shows, before any failed, that
at most ``MOST_REJECTED`` of the good documents that pass the base rule fall by it:
with confidence 1 - ``RISK`` this holds for all classes at once.  The level is
``RISK`` divided by the number of classes (Bonferroni); along one sequence the fixed
order needs no further correction.  A class needs 437 good labelled documents before a
step passes; with fewer only the base rule acts.

Defined results: a null or empty text has no words and fails the base rule; a
null doc_id has no label but gets its verdict; rows that share a doc_id each get
theirs; labels that disagree count as bad; a score that lies on a cutoff is kept;
texts may be of any length; an empty table gives no rows, and empty labels give no
cutoffs; other columns are ignored, and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplebed.llm.base import documents, id_and_text, staged

MOST_REJECTED = 0.01
RISK = 0.05
#: Words from which each length class begins.
CLASSES = (0, 100, 400, 1600)
#: The scores and their cutoffs step by step, loosest first; a document is rejected above a cutoff.
CUTOFFS = {
    "symbols_a_word": (2.0, 1.0, 0.5, 0.3, 0.2, 0.1),
    "exclaims_a_word": (2.0, 1.0, 0.5, 0.3, 0.2, 0.1),
    "repeat_share": (0.2, 0.15, 0.1, 0.05),
    "dup_lines_a_line": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4),
    "chars_a_word": (40.0, 30.0, 25.0, 20.0, 15.0),
}
#: How many steps there are; a score with fewer cutoffs stays at its last.
STEPS = max(map(len, CUTOFFS.values()))
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _occurrences(text: Column, chars: str) -> Column:
    total = F.lit(0)
    for c in chars:
        total = total + F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return total.cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """A hash of each five-word window, in order."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))
    return F.when(F.size(words) >= 5, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words under windows whose hash occurs again; of windows that overlap, each word counts once."""

    def again(ordered: Column) -> Column:
        same = lambda e, k: (e["h"] == F.get(ordered, k + 1)["h"]) | (e["h"] == F.get(ordered, k - 1)["h"])
        flagged = F.transform(ordered, lambda e, k: F.struct(e["pos"].alias("pos"), F.coalesce(same(e, k), F.lit(False)).alias("again")))
        return F.sort_array(F.transform(F.filter(flagged, lambda e: e["again"]), lambda e: e["pos"]))

    def total(pos: Column) -> Column:
        steps = F.transform(pos, lambda p, k: F.coalesce(F.least(F.lit(5), F.get(pos, k + 1) - p), F.lit(5)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("pos"))))
    return _let(_let(ordered, again), total)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts over the whole text."""
    return _counted(id_and_text(docs))


def _counted(d: DataFrame) -> DataFrame:
    """The columns of ``d`` but text, and the counts."""
    passed = [c for c in d.columns if c != "text"]
    d = d.select(*passed, "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    d = d.withColumn("hashes", _let(F.col("words"), _windows))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        *passed,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _occurrences(F.col("text"), SYMBOLS).alias("n_symbols"),
        _occurrences(F.col("text"), "!").alias("n_exclaims"),
        lines.alias("lines"),
        "hashes",
        (F.size(F.array_distinct("hashes")) < F.size("hashes")).alias("repeats"),
    )
    return d.select(
        *passed,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_exclaims",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), _covered(F.col("hashes"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def scored(counted: DataFrame) -> DataFrame:
    """The base rule, the length class and the scores."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    length_class = sum((F.col("n_words") >= c).cast("int") for c in CLASSES[1:])
    return counted.select(
        "*",
        base.alias("base_failed"),
        length_class.alias("length_class"),
        (F.col("n_symbols") / words).alias("symbols_a_word"),
        (F.col("n_exclaims") / words).alias("exclaims_a_word"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")).alias("dup_lines_a_line"),
        (F.col("word_chars") / words).alias("chars_a_word"),
    )


def tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial X with n trials at chance p, to double precision; 1 where k lies above the mean.

    The term of k comes from Loader's saddle-point form, which loses no digits for
    large n.  Those below it are products of ratios, and m terms down the product
    is under exp(-m^2 / 2k), so that what lies beyond 12 roots of k does not count.
    """
    import math

    def rest(x: Column) -> Column:
        """What Stirling's formula lacks of log(x!)."""
        known = [0.0] + [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)]
        v = x.cast("double")
        series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (v * v)) / (v * v)) / (v * v)) / v
        return F.when(x < 16, F.get(F.array(*map(F.lit, known)), x.cast("int"))).otherwise(series)

    share, missed = k.cast("double") / n, n - k
    nats = n * (share * F.log(share / p) + (1 - share) * F.log((1 - share) / (1 - p)))
    log_term = 0.5 * F.log(n / (2 * math.pi * k.cast("double") * missed)) + rest(n) - rest(k) - rest(missed) - nats
    first = F.when(k == 0, n * math.log1p(-p)).otherwise(log_term)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * i * ((1 - p) / p) / (n - i + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    # Terms k - 1, k - 2, ... as multiples of that of k.
    least = F.greatest(k - F.ceil(12 * F.sqrt(k)) + 1, F.lit(1)).cast("long")
    below = F.aggregate(F.sequence(F.greatest(k, F.lit(1)).cast("long"), least, F.lit(-1).cast("long")), start, add)["total"]
    return F.when(k > n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(F.exp(first) * below)


def cutoffs_of(step: int) -> dict[str, float]:
    return {s: cuts[min(step, len(cuts) - 1)] for s, cuts in CUTOFFS.items()}


def falls(step: int) -> Column:
    """Whether any score lies above its cutoff."""
    return F.greatest(*(F.col(s) > cut for s, cut in cutoffs_of(step).items()))


def learned_steps(scores: DataFrame, labels: DataFrame, most_rejected: float = MOST_REJECTED, risk: float = RISK) -> DataFrame:
    """length_class and the tightest step that passed, from 0, for the classes where one did."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = scores.where(~F.col("base_failed")).join(good, "doc_id")
    totals = held.groupBy("length_class").agg(F.count("*").alias("n"), *(F.count_if(falls(i)).alias(f"n_{i}") for i in range(STEPS)))
    level = risk / len(CLASSES)
    passed, step = F.lit(True), F.lit(-1)
    for i in range(STEPS):
        passed = passed & (F.col(f"p_{i}") <= level)
        step = F.when(passed, i).otherwise(step)
    tested = totals.select("length_class", *(tail(F.col("n"), F.col(f"n_{i}"), most_rejected).alias(f"p_{i}") for i in range(STEPS)))
    return tested.select("length_class", step.alias("step")).where("step >= 0")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts, ``base_failed`` and ``kept`` of every document."""
    judged = _judged(scored(staged(counts(docs), "quality")), labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _judged(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``scores`` and ``kept``."""
    steps = F.broadcast(learned_steps(scores, labels))  # at most one row for each of the fixed classes
    rejected = F.lit(False)
    for i in range(STEPS):
        rejected = F.when(F.col("step") == i, falls(i)).otherwise(rejected)
    return scores.join(steps, "length_class", "left").withColumn("kept", ~(F.col("base_failed") | rejected))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the documents that are kept; each row goes along with its own scores, whatever its doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return _judged(scored(staged(_counted(told), "quality")), labels).where("kept").select("doc.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _sql() -> str:
    symbols = " + ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in SYMBOLS)
    falls_by = [" OR ".join(f"{s} > {cut}" for s, cut in cutoffs_of(i).items()) for i in range(STEPS)]
    tests = [f"count(*) FILTER (WHERE {f}) AS n_{i}" for i, f in enumerate(falls_by)]
    p = lambda i: (
        f"(CASE WHEN n_{i} > n * {MOST_REJECTED} THEN 1.0 ELSE list_sum(list_transform(range(0, n_{i} + 1), lambda j: "
        f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({MOST_REJECTED}) + (n - j) * ln(1 - {MOST_REJECTED})))) END <= {RISK / len(CLASSES)})"
    )
    picks = " ".join(f"WHEN {' AND '.join(p(k) for k in range(i + 1))} THEN {i}" for i in reversed(range(STEPS)))
    rejects = " ".join(f"WHEN step = {i} THEN {f}" for i, f in enumerate(falls_by))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 4), ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS pos FROM w)),
t AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - pos, 5))) AS n_repeat_words
      FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM t WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, ({symbols})::BIGINT AS n_symbols,
             (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaims, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {' + '.join(f'(n_words >= {x})::INT' for x in CLASSES[1:])} AS length_class,
             n_symbols / greatest(n_words, 1)::DOUBLE AS symbols_a_word, n_exclaims / greatest(n_words, 1)::DOUBLE AS exclaims_a_word,
             n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_share, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_lines_a_line,
             word_chars / greatest(n_words, 1)::DOUBLE AS chars_a_word FROM c),
l AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
h AS (SELECT length_class, count(*) AS n, {', '.join(tests)} FROM s JOIN l USING (doc_id) WHERE NOT base_failed GROUP BY length_class),
k AS (SELECT length_class, CASE {picks} END AS step FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR CASE {rejects} ELSE false END) AS kept
FROM s LEFT JOIN k USING (length_class)
"""


ORACLE_SQL = _sql()

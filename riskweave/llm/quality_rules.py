"""Quality rules with risk-controlled cutoffs, in DataFrame expressions alone.

A rule rejects a document whose metric exceeds a cutoff. Cutoffs come from a grid that is fixed beforehand. The labelled
documents of good quality are the holdout: for each stratum (by length) and rule the grid is walked from lax to strict, and a
cutoff passes if the exact binomial test rejects "more than ``rule_risk`` of the good documents exceed it", that is if
P(X <= k | n, rule_risk) <= delta / (strata x rules). Neighbouring strata are taken together where one of them has too few
good documents to certify any cutoff; this looks at their number alone, never at a metric, so the tests stay exact. The test is the one-sided Clopper-Pearson upper bound being at most
``rule_risk``. The walk ends at the first cutoff that fails (fixed-sequence testing needs no further correction), the strictest
one passed is used, and a rule without one is idle. With probability 1 - delta no stratum loses more than
rules x rule_risk of its good documents to these rules.

Edge cases: a null text has no words. Fewer than ``MIN_WORDS`` words, or mostly repeated words, fail the base filter. Labels other
than 1 are no part of the holdout; a label joins every row of its id. Without labels every rule is idle. Rows with equal ids are
separate. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.layout import spread
from riskweave.llm._common import let, materialize, table

MIN_WORDS = 50
WINDOW = 3
RULE_RISK = 0.02
DELTA = 0.05
#: Strata: the least number of words of each.
STRATA = (0, 200, 800)
#: How strata may be taken together, the first that every part has enough good documents for.
POOLS = ((0, 1, 2), (0, 0, 1), (0, 1, 1), (0, 0, 0))
#: Per word: symbols, repeated words, repeated lines, capitals, exclamation and question marks.
RULES = ("symbols", "repeats", "dup_lines", "capitals", "shouts")
#: Cutoffs from lax to strict.
GRID = tuple(round(2.0 * 0.8**k, 6) for k in range(24))
_SPACES = "\t\n\x0b\x0c\r"
#: A text with more distinct repeated windows than this looks them up by sorting.
FEW = 48


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+``."""
    plain = F.trim(F.translate(text, _SPACES, " " * len(_SPACES)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def repeated_words(words: Column) -> Column:
    """Words inside windows of three words that occur at least twice, counting the first occurrence.

    Window hashes are sorted as plain longs; only texts in which some repeat do more, and only those in which many different
    ones do sort hashes with their positions.
    """

    def many(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            return F.filter(F.transform(s, lambda x, k: F.when(F.coalesce((F.get(s, k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((F.get(s, k + 1)["h"] == x["h"]), F.lit(False)), x["i"])), lambda i: i.isNotNull())

        return let(pairs, marked)

    def covered(places: Column) -> Column:
        return let(
            F.sort_array(places),
            lambda p: F.aggregate(
                F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda acc, v: acc + v
            ),
        )

    def of_hashes(hashes: Column) -> Column:
        twice = let(
            F.sort_array(hashes),
            lambda s: F.array_distinct(F.filter(F.transform(s, lambda h, k: F.when(h == F.get(s, k - 1), h)), lambda h: h.isNotNull())),
        )

        def of_twice(t: Column) -> Column:
            few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(t, h), i)), lambda i: i.isNotNull())
            return F.when(F.size(t) == 0, F.lit(0).cast("bigint")).otherwise(covered(F.when(F.size(t) <= FEW, few).otherwise(many(hashes))))

        return let(twice, of_twice)

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < WINDOW, F.lit(0).cast("bigint")).otherwise(let(hashes, of_hashes))

    return of_words(words)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text; nothing is shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x09-\\x0D\\x20]"))
    counted = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"), F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).alias("n_repeat_words")
        ),
    )
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    return docs.select(
        "doc_id",
        counted.alias("w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        dup.alias("n_dup_lines"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
        F.regexp_count(text, F.lit("[!?]")).cast("bigint").alias("n_shouts"),
    ).select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "n_capitals", "n_shouts")


def _metrics() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    counts = dict(zip(RULES, ("n_symbols", "n_repeat_words", "n_dup_lines", "n_capitals", "n_shouts"), strict=True))
    return {r: F.col(c) / n for r, c in counts.items()}


def _stratum() -> Column:
    out = F.lit(0)
    for k, least in enumerate(STRATA):
        out = F.when(F.col("n_words") >= least, F.lit(k)).otherwise(out)
    return out


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, by Stirling's series at x + 7; good to about 1e-13."""
    z = x + 7
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    for k in range(7):
        series = series - F.ln(x + k)
    return series


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) where k < n p; 1 elsewhere, which no test at a level below one half passes. Terms are added
    from k down, each from the one above, until they cannot matter (12 standard deviations below the mean)."""
    n, k = n.cast("double"), k.cast("double")
    start = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, F.floor(12 * F.sqrt(n * p)) + 60).cast("bigint")
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), terms),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct((acc["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(k < n * p, F.exp(start) * tail).otherwise(F.lit(1.0))


def _exceeded(metric: Column) -> Column:
    """How many cutoffs of the grid a metric exceeds."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in GRID]), lambda c: metric > c))


def least_good(pools: int, rule_risk: float = RULE_RISK, delta: float = DELTA) -> int:
    """So many good documents certify a cutoff that none of them exceeds."""
    return math.ceil(math.log(delta / (pools * len(RULES))) / math.log1p(-rule_risk))


def choose_pools(counts: dict[int, int], rule_risk: float = RULE_RISK, delta: float = DELTA) -> tuple[int, ...]:
    """The pool of each stratum, from the numbers of good documents in the strata."""
    for pools in POOLS:
        sums = [sum(counts.get(k, 0) for k, p in enumerate(pools) if p == x) for x in sorted(set(pools))]
        if min(sums) >= least_good(len(sums), rule_risk, delta):
            break
    return pools


def choose_cutoffs(measured: DataFrame, labels: DataFrame, rule_risk: float = RULE_RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): one row for each stratum and rule that is not idle; at most strata x rules rows."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    level = [_exceeded(m).alias(r) for r, m in _metrics().items()]
    # level = how many cutoffs of the grid a document exceeds; the grid falls, so it exceeds the last ones.
    held = materialize(measured.where(~_base_failed()).join(good, "doc_id").select(_stratum().alias("part"), *level).groupBy("part", *RULES).count(), "quality-levels")
    pools = choose_pools({r["part"]: r["n"] for r in held.groupBy("part").agg(F.sum("count").alias("n")).collect()}, rule_risk, delta)
    pool = F.get(F.array(*[F.lit(p) for p in pools]), F.col("part"))
    passed = held.select(pool.alias("stratum"), "count", *RULES)
    long = passed.select("stratum", "count", F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])).alias("rule", "level"))
    counts = long.groupBy("stratum", "rule", "level").agg(F.sum("count").alias("n"))
    by_rule = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("at"))
    # Exceeding cutoff j (from 0) means a level of at least len(grid) - j.
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(len(GRID) - 1)),
        lambda j: F.aggregate(F.sequence(len(GRID) - j, F.lit(len(GRID))), F.lit(0).cast("bigint"), lambda acc, v: acc + F.coalesce(F.try_element_at("at", v), F.lit(0).cast("bigint"))),
    )
    budget = delta / (len(set(pools)) * len(RULES))
    tested = by_rule.withColumn("rejected", steps).withColumn("ok", F.transform("rejected", lambda k: binomial_cdf(k, F.col("n"), rule_risk) <= budget))
    passes = F.coalesce(F.nullif(F.array_position("ok", False), F.lit(0).cast("bigint")) - 1, F.lit(len(GRID)).cast("bigint")).cast("int")
    members = F.explode(F.filter(F.array(*[F.when(F.col("stratum") == p, F.lit(k)) for k, p in enumerate(pools)]), lambda x: x.isNotNull()))
    return tested.withColumn("passes", passes).where("passes > 0").select(members.alias("stratum"), "rule", F.get(F.array(*[F.lit(c) for c in GRID]), F.col("passes") - 1).alias("cutoff"))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept. ``cutoffs`` has at most strata x rules rows, and is broadcast."""
    by_stratum = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    marked = measured.withColumn("stratum", _stratum()).join(F.broadcast(by_stratum), "stratum", "left")
    fired = F.lit(False)
    for r, m in _metrics().items():
        fired = fired | F.coalesce(m > F.try_element_at("cutoffs", F.lit(r)), F.lit(False))
    return marked.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & ~fired)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(measures(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), "quality-measures")
    kept = judge(measured, choose_cutoffs(measured, table(spark, sf_dir, "labels")))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_GRID_SQL = ", ".join(f"({k}, {c!r}::DOUBLE)" for k, c in enumerate(GRID))

ORACLE = {
    "op5_quality_rules": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM pos) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x09-\x0D\x20]') GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '[!?]')) AS n_shouts
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words >= {STRATA[2]} THEN 2 WHEN n_words >= {STRATA[1]} THEN 1 ELSE 0 END AS stratum FROM m),
long AS (
  SELECT doc_id, stratum, base_failed, rule, v / greatest(n_words, 1)::DOUBLE AS metric
  FROM (SELECT doc_id, stratum, base_failed, n_words, unnest(['symbols', 'repeats', 'dup_lines', 'capitals', 'shouts']) AS rule,
               unnest([n_symbols, n_repeat_words, n_dup_lines, n_capitals, n_shouts]) AS v FROM b)),
grid(j, cutoff) AS (VALUES {_GRID_SQL}),
good AS (SELECT l.* FROM long l JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) WHERE NOT base_failed),
sums AS (SELECT count(*) FILTER (stratum = 0) / {len(RULES)} AS a, count(*) FILTER (stratum = 1) / {len(RULES)} AS b, count(*) FILTER (stratum = 2) / {len(RULES)} AS c FROM good),
pools AS (
  SELECT CASE WHEN least(a, b, c) >= {least_good(3)} THEN [0, 1, 2] WHEN least(a + b, c) >= {least_good(2)} THEN [0, 0, 1]
              WHEN least(a, b + c) >= {least_good(2)} THEN [0, 1, 1] ELSE [0, 0, 0] END AS p FROM sums),
tested AS (
  SELECT p[stratum + 1] AS pool, len(list_distinct(p)) AS pools, rule, j, cutoff, count(*) AS n, count(*) FILTER (metric > cutoff) AS k
  FROM good, pools, grid GROUP BY ALL),
cdf AS (
  SELECT pool, rule, j, cutoff, CASE WHEN k < n * {RULE_RISK} THEN
    (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RULE_RISK}) + (n - i) * ln(1 - {RULE_RISK}))) FROM (SELECT unnest(generate_series(0, k)) AS i))
    ELSE 1 END <= {DELTA} / (pools * {len(RULES)}) AS ok FROM tested),
stop AS (SELECT pool, rule, coalesce(min(j) FILTER (NOT ok), {len(GRID)}) AS j FROM cdf GROUP BY ALL),
cut AS (SELECT c.pool, c.rule, c.cutoff FROM cdf c JOIN stop s ON c.pool = s.pool AND c.rule = s.rule AND c.j = s.j - 1),
fired AS (SELECT DISTINCT l.doc_id FROM long l, pools JOIN cut ON cut.pool = p[l.stratum + 1] AND cut.rule = l.rule WHERE metric > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM fired) AS kept FROM b
"""
}

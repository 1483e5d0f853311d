"""Line dedup by overlapping three-line windows, in DataFrame expressions alone.

The lines of a text that hold more than white space are numbered; every three consecutive ones are a window, named by two
independent 64-bit hashes. One aggregation over all documents finds the windows that occur more than once and their first
occurrence, in the order (doc_id, text hash, line number). Every later occurrence covers its three lines; the union of what a
document's windows cover is removed, and the rest is joined again by line ends.

Whatever is removed has an earlier copy that stays: of the copies of a line the first that any window saw is never covered
by a later occurrence of the same window.

Edge cases: texts of fewer than three such lines have no windows and stay as they are, as do null texts. Lines of white space
alone are not part of windows; in a text that loses lines they are kept where they stand. Rows with equal doc_id and equal text
count as one document and get one result each. Ids may be of any type that sorts; a null doc_id comes first in the order. An empty table gives an empty one.
Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm._common import fresh, let, materialize, table

LINES = 3
#: So many windows at most are broadcast, those with the most occurrences; each other window has few enough for one task.
HOT_WINDOWS = 200_000
LEAST_HOT = 4_096
#: A line with a word.
WORDED = "[^\\x09-\\x0D\\x20]"


def _windows(docs: DataFrame) -> DataFrame:
    """(d, h, pos, x, y): one row for each window; pos counts the lines with words, from 0."""
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORDED))
    hashed = docs.where(F.col("text").contains("\n")).select(
        F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.transform(lines, lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))).alias("l")
    )
    enough = hashed.where(F.size("l") >= LINES)
    return enough.select("d", "h", F.posexplode(F.arrays_zip(F.slice("l", 1, F.size("l") - 2).alias("p"), F.slice("l", 2, F.size("l") - 2).alias("q"), F.slice("l", 3, F.size("l") - 2).alias("r"))).alias("pos", "w")).select(
        "d", "h", "pos", F.xxhash64("w.p.a", "w.q.a", "w.r.a").alias("x"), F.xxhash64("w.p.b", "w.q.b", "w.r.b").alias("y")
    )


def covered_lines(docs: DataFrame) -> DataFrame:
    """(d, h, gone): for each document that loses lines, the numbers of those among its lines with words."""
    windows = materialize(_windows(docs).distinct(), "line-windows")  # rows equal in id and text count once
    repeated = materialize(
        windows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "h", "pos")).alias("first")).where("n > 1").select(F.col("x").alias("fx"), F.col("y").alias("fy"), "n", "first"),
        "line-repeated",
    )
    # A window of more than total / HOT_WINDOWS occurrences is hot: there are HOT_WINDOWS such windows at most, so these are
    # broadcast and their occurrences stay where they are. All others meet their first occurrence in a shuffle.
    hot = repeated.agg(F.sum("n")).first()[0] or 0
    limit = max(LEAST_HOT, -(-hot // HOT_WINDOWS))
    same = (F.col("x") == F.col("fx")) & (F.col("y") == F.col("fy"))
    crowd = F.broadcast(repeated.where(F.col("n") > limit).select("fx", "fy", "first"))
    met = windows.join(crowd, same, "left")
    of_hot = met.where(F.col("first").isNotNull()).select("d", "h", "pos", "first")
    of_rest = met.where(F.col("first").isNull()).select("d", "h", "pos", "x", "y").join(repeated.where(F.col("n") <= limit), same).select("d", "h", "pos", "first")
    later = of_hot.unionAll(of_rest).where(~F.struct("d", "h", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("d", "h").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, report: bool = False, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with ``text`` less its repeated windows (and ``n_chars``, where there is one, counted again). With
    ``report`` also ``n_lines_removed``; with ``drop_emptied`` without rows that lost every line they had."""
    d, h, starts, gone, kept, was = (fresh(docs, x) for x in ("line_doc", "line_hash", "line_starts", "line_gone", "line_kept", "line_was"))
    covered = covered_lines(docs.select("doc_id", "text")).select(F.col("d").alias(d), F.col("h").alias(h), F.col("starts").alias(starts))
    joined = docs.join(covered, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left")
    # Numbers covered by the sorted window starts, once each, and from them places among all lines. Everything is one pass
    # over the lines: look-ups by index into arrays that are evaluated once, and a hash-based difference.
    parts = F.split("text", "\n", -1)
    worded = F.filter(F.transform(parts, lambda line, i: F.when(line.rlike(WORDED), i)), lambda i: i.isNotNull())
    numbers = F.array_distinct(F.flatten(F.transform(F.col(starts), lambda p: F.sequence(p, p + LINES - 1))))
    removed = let(worded, lambda places: F.transform(F.col(gone), lambda n: F.get(places, n)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), removed)
    text = let(parts, lambda lines: F.array_join(F.transform(F.col(kept), lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn(was, F.col(starts).isNotNull()).withColumn(gone, numbers)
    out = out.withColumn(kept, F.when(F.col(was), stay)).withColumn("text", F.when(F.col(was), text).otherwise(F.col("text")))
    if drop_emptied:
        out = out.where(~F.col(was) | F.col("text").rlike(WORDED))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(was), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if report:
        columns.append(F.when(F.col(was), F.size(gone)).otherwise(F.lit(0)).cast("bigint").alias("n_lines_removed"))
    return out.select(*columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


ORACLE = {
    "op7_line_dedup": r"""
WITH parts AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM parts WHERE regexp_matches(line, '[^\x09-\x0D\x20]')),
windows AS (
  SELECT doc_id, n, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
later AS (
  SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, n) AS k FROM windows WHERE c IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, n + k AS n FROM later, (SELECT unnest([0, 1, 2]) AS k)),
marked AS (SELECT w.doc_id, w.i FROM worded w JOIN gone g USING (doc_id, n)),
kept AS (SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.i) AS text FROM parts p WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.doc_id = p.doc_id AND m.i = p.i) GROUP BY p.doc_id),
lost AS (SELECT doc_id, count(*) AS k FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(l.k, 0) AS n_lines_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN lost l USING (doc_id)
"""
}

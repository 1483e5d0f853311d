"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of eight consecutive words of each benchmark item; an item of fewer words, but not none, is one
window. Words take the place of characters: for patterns of one length m the SHIFT table says for a block of two
consecutive words how far the search may move on, the bucket of the last block of a pattern selects candidates, and a
direct comparison confirms them. A word that no pattern has lets the search skip m words. Shorter items form classes of
their own, one for each length.

The benchmark's windows go to the executors in blocks of about ``block_windows`` windows (each block is broadcast; a long item is
cut into parts that share a window less one word), and the documents are scanned once for each block, so no benchmark and
no item is too large.

Edge cases: null or empty texts have no words; items without words never occur; items with a null id are ignored; items
with equal ids count once. Equal document rows are all kept, each with its own result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm._common import column, fresh, materialize, table

WINDOW = 8
#: ASCII other than letters and digits ends a word, all other characters are part of one; A-Z are lowered, and only they.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


class WuManber:
    """Patterns of one length over integer words, each with the items it belongs to."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], list[int]]):
        self.length, self.patterns = length, patterns
        self.block = min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple[int, ...], int] = {}
        self.buckets: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        for p in patterns:
            for end in range(self.block, length + 1):
                key, far = p[end - self.block : end], length - end
                if far < self.shift.get(key, self.skip):
                    self.shift[key] = far
            self.buckets.setdefault(p[-self.block :], []).append(p)

    def search(self, doc: list[int]):
        """(start, items) of each occurrence. ``doc`` has 0 for words that no pattern has."""
        length, skip, shift, n = self.length, self.skip, self.shift, len(doc)
        at = length - 1
        if self.block == 1:
            for start, word in enumerate(doc):
                if word and (word,) in self.patterns:
                    yield start, self.patterns[word,]
            return
        while at < n:
            last = doc[at]
            if not last:
                at += length
                continue
            before = doc[at - 1]
            if not before:
                at += length - 1
                continue
            far = shift.get((before, last), skip)
            if far:
                at += far
                continue
            start = at - length + 1
            window = tuple(doc[start : at + 1])
            for p in self.buckets[before, last]:
                if p == window:
                    yield start, self.patterns[p]
            at += 1


class Searcher:
    """All patterns of one block of items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({str(i) for i, _ in items})
        place = {x: n for n, x in enumerate(self.items)}
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            m = min(window, len(ids))
            for start in range(len(ids) - m + 1 if m else 0):
                owners = by_length.setdefault(m, {}).setdefault(tuple(ids[start : start + m]), [])
                if not owners or owners[-1] != place[str(item)] and place[str(item)] not in owners:
                    owners.append(place[str(item)])
        self.searchers = [WuManber(m, p) for m, p in sorted(by_length.items())]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """(words, merged hit ranges, items found) of a text."""
        words = words_of(text)
        doc = list(map(self.vocabulary.get, words, [0] * len(words)))
        spans, found = [], set()
        if any(doc):
            for s in self.searchers:
                for start, owners in s.search(doc):
                    spans.append((start, start + s.length))
                    found.update(owners)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return len(words), merged, [self.items[i] for i in sorted(found)]


def item_parts(benchmark: DataFrame, id_col: str, text_col: str, window: int, part_windows: int) -> DataFrame:
    """(i, part, t, n): the items' words in parts of at most ``part_windows`` windows; an item of fewer words is one part."""
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(part_windows))
    cut = items.select("i", "w", F.posexplode(starts).alias("part", "at"))
    part = F.slice("w", F.col("at") + 1, F.lit(part_windows + window - 1))
    return cut.select("i", "part", F.array_join(part, " ").alias("t"), F.size(part).cast("bigint").alias("n"))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    block_windows: int = 400_000,
    window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (default doc_id) with n_words, hit_spans (merged word ranges) and
    items (sorted ids as strings)."""
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    added = {"n_words": "bigint", "hit_spans": "array<struct<a:int,b:int>>", "items": "array<string>"}
    from pyspark.sql.types import _parse_datatype_string

    parts = item_parts(benchmark, id_col, text_col, window, max(1, block_windows // 8))
    total = parts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_windows))
    place = F.pmod(F.xxhash64("i", "part"), F.lit(blocks))

    def scanned(source: DataFrame, own: list[str], block: int) -> DataFrame:
        rows = [(r["i"], r["t"]) for r in parts.where(place == block).collect()]  # one block: a bounded number of windows
        held = spark.sparkContext.broadcast(rows)
        schema = source.select(*own).schema
        for name, kind in added.items():
            schema = schema.add(name, _parse_datatype_string(kind))

        def run(batches):
            searcher = Searcher(held.value, window)
            spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            for batch in batches:
                results = [searcher.scan(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k) for k in own]
                    + [
                        pa.array([r[0] for r in results], type=pa.int64()),
                        pa.array([[{"a": a, "b": b} for a, b in r[1]] for r in results], type=spans_type),
                        pa.array([r[2] for r in results], type=pa.list_(pa.string())),
                    ],
                    names=[*own, *added],
                )

        return source.select(*own, F.col("text")).mapInArrow(run, schema)

    if blocks == 1:
        return scanned(docs, keep, 0)
    # Rows get numbers and are written once. What the blocks find in a row meets again under its number; texts stay where they are.
    row = fresh(docs, "row_number")
    numbered = materialize(docs.select(*keep, F.col("text")).withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    first = scanned(numbered, [*keep, row], 0)
    found = None
    for b in range(1, blocks):
        part = scanned(numbered, [row], b).where(F.size("items") > 0).select(row, "hit_spans", "items")
        found = part if found is None else found.unionByName(part)
    more = found.groupBy(row).agg(F.flatten(F.collect_list("hit_spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
    together = first.join(more, row, "left").select(
        *keep,
        "n_words",
        F.concat("hit_spans", F.coalesce("more_spans", F.array().cast(added["hit_spans"]))).alias("hit_spans"),
        F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast(added["items"]))))).alias("items"),
    )
    merged = F.aggregate(
        F.array_sort("hit_spans"),
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["b"] < x["a"]), F.concat(acc, F.array(x))).otherwise(
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))),
            )
        ),
    )
    return together.withColumn("hit_spans", merged)


def report(scanned: DataFrame, keep: list[str], min_items: int = 2) -> DataFrame:
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda acc, x: acc + (x["b"] - x["a"]))
    return scanned.select(
        *keep,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """The rows of ``docs`` that hold windows of fewer than ``min_items`` benchmark items, with their own columns."""
    plain = {c: f"in_{n}" for n, c in enumerate(docs.columns)}
    text = next(c for c in docs.columns if c.lower() == "text")
    renamed = docs.select(*[column(c).alias(p) for c, p in plain.items()], column(text).alias("text"))
    found = scan(renamed, benchmark, keep=list(plain.values()))
    return found.where(F.size("items") < min_items).select(*[F.col(p).alias(c) for c, p in plain.items()])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return report(scan(docs, benchmark), ["doc_id"])


ORACLE = {
    "op8_decontaminate": r"""
WITH item_words AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, s, s + least(8, len(w)) - 1), ' ') AS win, least(8, len(w)) AS m
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS s FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
lengths AS (SELECT DISTINCT m FROM windows),
positions AS (
  SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM doc_words, lengths WHERE len(w) >= m),
hits AS (
  SELECT p.r, p.s, p.m, v.item FROM positions p
  JOIN windows v ON v.m = p.m AND v.win = array_to_string(list_slice(p.w, p.s, p.s + p.m - 1), ' ')),
hit_words AS (SELECT r, count(DISTINCT s + k) AS n_hit FROM (SELECT r, s, unnest(generate_series(0, m - 1)) AS k FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
}

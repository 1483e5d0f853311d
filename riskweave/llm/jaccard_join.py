"""N-gram Jaccard join by MinHash banding.

1. Each document becomes a set of word shingles (``shingle`` words, lower case; a shorter text is one shingle). Documents
   with the same set form a class of copies: they have the same links, so only one of them goes on.
2. A class has ``bands`` hashes, each of ``rows`` minima. Both numbers follow from the wanted recall: ``band_plan`` takes
   the most rows whose bands, as many as the recall needs at the similarity limit, stay within a number of minima.
3. Band hashes are shuffled; buckets of one class fall away. Of buckets with the same members only that of the first band
   stays, since a pair is looked at in the first band that it shares and nowhere else.
4. The members of a bucket, with their texts, meet in blocks: a bucket too large for one task is cut into parts, and a task
   gets two parts. Exact intersections over an inverted list of shingles verify every pair of a task; no pair leaves it,
   only each class's number of links and the edges of a spanning forest.
5. Labels spread along the forest until they no longer change: the smallest document id of a component.

Result: one row per document with ``class_id`` (smallest doc_id of its component of linked documents), ``copy_id`` (smallest
doc_id with the same shingle set) and ``n_links`` (other documents with a Jaccard similarity of at least the limit,
copies included).

Edge cases: a text that is null or has no words links to nothing and is its own class. Rows with equal doc_id are separate
documents. Null ids are legal; a component's id is null only if all of its ids are. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.layout import spread
from riskweave.llm._common import fresh, materialize, table

SHINGLE = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.99999
MOST_MINIMA = 128
#: The most shingles, and the most classes, of one part of a bucket.
PART_SHINGLES = 2_000_000
PART_CLASSES = 1_024
#: Keys (an id and a hash each) up to this many are broadcast to select rows before a shuffle; more are met by the shuffle itself.
BROADCAST_KEYS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def band_plan(similarity: float = SIMILARITY, recall: float = TARGET_RECALL, most: int = MOST_MINIMA) -> tuple[int, int]:
    """(bands, rows): the most rows for which ``bands * rows <= most`` and a pair at the limit shares a band with at least
    the wanted probability."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no plan: allow more minima or ask for less recall")


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(size, len(w))
    h = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = (h ^ w[k : k + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    h *= _MIX2
    h ^= h >> np.uint64(32)
    return np.unique(h)


def multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(shingles: np.ndarray, factors: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band; the minima are taken over ``factor * shingle`` modulo 2**64."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, 16_384 // len(factors))
    for at in range(0, len(shingles), step):
        np.minimum(low, (shingles[at : at + step, None] * factors).min(axis=0), out=low)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _MIX2
    for column in low.reshape(bands, rows).T:
        out = (out ^ column) * _MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, cls, n_shingles, bands) of each row; cls names the shingle set, null if it is empty."""

    def run(batches):
        from xxhash import xxh3_128_hexdigest

        factors = multipliers(bands * rows)
        for batch in batches:
            cls, sizes, sigs = [], [], []
            for text in batch.column("text"):
                s = shingle_hashes(text.as_py(), shingle)
                sizes.append(len(s))
                cls.append(xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                sigs.append(band_hashes(s, factors, bands, rows) if len(s) else np.empty(0, dtype=np.int64))
            ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(cls, type=pa.string()), pa.array(sizes, type=pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs) if sigs else np.empty(0, dtype=np.int64)))],
                names=["doc_id", "text_hash", "cls", "n_shingles", "bands"],
            )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, text_hash bigint, cls string, n_shingles bigint, bands array<bigint>")


def _verify(limit: float, shingle: int):
    def run(key, group):
        band, left, right = (key[i].as_py() for i in (1, 2, 3))
        seen: dict[str, int] = {}
        for n, c in enumerate(group.column("cls").to_pylist()):
            seen.setdefault(c, n)  # equal rows of a representative
        picks = list(seen.values())
        group = group.take(pa.array(picks, type=pa.int64())).combine_chunks()
        n = group.num_rows
        names, copies = group.column("cls").to_pylist(), np.array(group.column("copies").to_pylist(), dtype=np.int64)
        part = np.array(group.column("part").to_pylist(), dtype=np.int64)
        bands = np.array(group.column("bands").to_pylist(), dtype=np.int64).reshape(n, -1)[:, :band]
        sets = [shingle_hashes(t.as_py(), shingle) for t in group.column("text")]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        # Inverted list: rows sorted by shingle.
        flat = np.concatenate(sets) if n else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(n), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        firsts = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1]) if len(flat) else np.empty(0, dtype=np.int64)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(flat))))
        ends, bounds = np.append(firsts[1:], len(flat)), np.concatenate([[0], np.cumsum(sizes)])
        links, parent = np.zeros(n, dtype=np.int64), list(range(n))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges = []
        for a in range(n):
            # Pairs of two parts are looked at in the task of those two; pairs within a part in that of the part alone.
            others = np.arange(a + 1, n)
            if left != right:
                others = others[part[others] != part[a]]
            if len(others) and band:
                others = others[~(bands[others] == bands[a]).any(axis=1)]
            others = others[np.minimum(sizes[others], sizes[a]) >= limit * np.maximum(sizes[others], sizes[a])]
            if not len(others):
                continue
            if len(others) <= 8:
                common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in others])
            else:
                runs = place[bounds[a] : bounds[a + 1]]
                starts, counts = firsts[runs], ends[runs] - firsts[runs]
                at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                common = np.bincount(owner[at], minlength=n)[others]
            for b in others[common >= limit * (sizes[a] + sizes[others] - common) - 1e-9]:
                links[a] += copies[b]
                links[b] += copies[a]
                x, y = root(a), root(int(b))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((a, int(b)))
        hit = np.flatnonzero(links)
        return pa.table(
            {
                "cls": pa.array([names[i] for i in hit] + [names[a] for a, _ in edges], type=pa.string()),
                "other": pa.array([None] * len(hit) + [names[b] for _, b in edges], type=pa.string()),
                "links": pa.array([int(links[i]) for i in hit] + [0] * len(edges), type=pa.int64()),
            }
        )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(cls, label): the smallest class name reached by each class along ``edges(a, b)``.

    Each round takes the smallest label of the neighbours, then follows labels to the labels of the classes they name, and
    is written to the shared folder. Labels only fall, so the rounds end; their number grows with the logarithm of the longest path.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-edges")
    nodes = both.select(F.col("a").alias("cls")).distinct()
    labels = materialize(nodes.select("cls", F.col("cls").alias("label")), "jaccard-labels")
    while True:
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "cls").select("cls", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("changed"))
        jump = moved.select(F.col("cls").alias("label"), F.col("label").alias("next"))
        after = materialize(
            moved.join(jump, "label", "left").select("cls", F.least("label", F.coalesce("next", "label")).alias("label"), "changed"), "jaccard-labels"
        )
        if after.where("changed").isEmpty():
            break
        labels = after.select("cls", "label")
    return labels.select("cls", "label")


def link_classes(
    docs: DataFrame,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    recall: float = TARGET_RECALL,
    part_classes: int = PART_CLASSES,
    part_shingles: int = PART_SHINGLES,
) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows(doc_id, text_hash, cls, n_shingles) for each row of ``docs(doc_id, text)``, and
    classes(cls, copies, rep, component, links) where rep is struct(doc_id, text_hash) of the class's first row."""
    bands, rows = band_plan(similarity, recall)
    sigs = materialize(signatures(docs, shingle, bands, rows), "jaccard-signatures")
    classes = materialize(
        sigs.where(F.col("cls").isNotNull())
        .groupBy("cls")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles")),
        "jaccard-classes",
    )
    # The representatives' rows: the join is on the class's own first row, so a class brings one row however large it is.
    first = classes.select("copies", F.col("rep.doc_id").alias("d"), F.col("rep.text_hash").alias("h"), F.col("cls").alias("c"))
    reps = sigs.join(first, sigs["doc_id"].eqNullSafe(first["d"]) & (sigs["text_hash"] == first["h"]) & (sigs["cls"] == first["c"]))
    reps = reps.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("doc_id", "text_hash", "n_shingles", "bands", "copies")])
    banded = reps.select("cls", "doc_id", "text_hash", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    # bit_xor of two hashes names a bucket's member set.
    shared = (
        banded.groupBy("band", "bucket")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.sum("n_shingles").alias("weight"),
            F.bit_xor(F.xxhash64("cls")).alias("x"),
            F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y"),
        )
        .where("members > 1")
    )
    kept = (
        shared.groupBy("members", "x", "y")
        .agg(F.min(F.struct("band", "bucket", "weight")).alias("k"))
        .select(
            F.col("k.band").alias("band"),
            F.col("k.bucket").alias("bucket"),
            F.greatest(F.ceil(F.col("members") / part_classes), F.ceil(F.col("k.weight") / part_shingles)).cast("int").alias("parts"),
        )
    )
    member = banded.join(kept, ["band", "bucket"]).select("cls", "doc_id", "text_hash", "band", "bucket", "parts", F.pmod(F.xxhash64(F.lit(2), "cls"), F.col("parts")).cast("int").alias("part"))
    seats = member.groupBy("cls", "doc_id", "text_hash").agg(F.collect_list(F.struct("band", "bucket", "parts", "part")).alias("seats"))  # at most one seat a band
    chosen = seats.join(reps.select("cls", "bands", "copies"), "cls")
    chosen = materialize(chosen, "jaccard-chosen")
    texts = selected(docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text"), "d", "h", chosen.select("doc_id", "text_hash"), "left_semi")
    met = (
        chosen.join(texts, chosen["doc_id"].eqNullSafe(texts["d"]) & (chosen["text_hash"] == texts["h"]))
        .select("cls", "copies", "bands", "text", F.explode("seats").alias("s"))
        .select("cls", "copies", "bands", "text", "s.*", F.explode(F.sequence(F.lit(0), F.col("s.parts") - 1)).alias("with"))
        .withColumns({"left": F.least("part", "with"), "right": F.greatest("part", "with")})
    )
    found = materialize(
        met.select("band", "bucket", "left", "right", "part", "cls", "copies", "bands", "text")
        .groupBy("bucket", "band", "left", "right")
        .applyInArrow(_verify(similarity, shingle), "cls string, other string, links bigint"),
        "jaccard-found",
    )
    degree = found.groupBy("cls").agg(F.sum("links").alias("links"))
    edges = found.where(F.col("other").isNotNull()).select(F.col("cls").alias("a"), F.col("other").alias("b"))
    label = components(edges)
    tied = classes.join(label, "cls", "left").select("cls", "copies", "rep", "least", F.coalesce("label", "cls").alias("label"))
    # A component's id is its smallest doc_id, and its first row the smallest representative.
    named = tied.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("least").alias("component"), F.min("rep").alias("head"))
    out = tied.join(named, "label").join(degree, "cls", "left").select("cls", "copies", "rep", "least", "component", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return sigs.select("doc_id", "text_hash", "cls", "n_shingles"), out


def jaccard_join(docs: DataFrame, **plan) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_id, n_links, n_shingles."""
    rows, classes = link_classes(docs, **plan)
    narrow = materialize(classes.select("cls", "component", "least", "links"), "jaccard-named")
    linked = rows.join(narrow, "cls", "left")
    own = F.col("cls").isNull()
    return linked.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("component")).alias("class_id"),
        F.when(own, F.col("doc_id")).otherwise(F.col("least")).alias("copy_id"),
        F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"),
        "n_shingles",
    )


def keep_first(docs: DataFrame, **plan) -> DataFrame:
    """``docs`` with one row of each component of linked documents: the one with the smallest (doc_id, text hash). Of
    equal rows one stays. Rows without words are not compared and all stay."""
    rows, classes = link_classes(docs.select("doc_id", "text"), **plan)
    d, h, n, stays = (fresh(docs, x) for x in ("head_doc", "head_hash", "head_rows", "head_stays"))
    heads = classes.select(F.col("head.doc_id").alias("k"), F.col("head.text_hash").alias("g"), F.lit(True).alias(stays)).distinct()
    counted = rows.where(F.col("cls").isNotNull()).groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).agg(F.count(F.lit(1)).alias(n))
    # Keys of rows that go, and of rows that are there more than once: most rows are neither and stay where they are.
    odd = counted.join(heads, counted[d].eqNullSafe(F.col("k")) & (counted[h] == F.col("g")), "left").select(d, h, n, F.coalesce(stays, F.lit(False)).alias(stays))
    odd = materialize(odd.where(~F.col(stays) | (F.col(n) > 1)), "jaccard-odd")
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(h, F.when(_has_word(), F.xxhash64("text")))
    plain = selected(keyed, "doc_id", h, odd.select(d, h), "left_anti").select(*names)
    again = odd.where(stays).select(d, h)
    several = selected(keyed, "doc_id", h, again, "left_semi").withColumn(d, F.col("doc_id")).dropDuplicates([d, h]).select(*names)
    return plain.unionAll(several)


def selected(rows: DataFrame, doc_id: str, text_hash: str, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` that have (left_semi) or have not (left_anti) one of ``keys`` (an id, which may be null, and a hash); a row with a null
    hash has none. Up to ``BROADCAST_KEYS`` keys are broadcast, and rows stay where they are."""
    k, g = keys.columns
    keys = keys.select(F.col(k).alias("key_doc"), F.col(g).alias("key_hash"))
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("key_doc")) & (F.col(f"`{text_hash}`") == F.col("key_hash"))
    return rows.join(F.broadcast(keys) if few else keys, same, how)


#: What str.split() takes for white space: a text with any other character has a word.
_SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def _has_word():
    return F.coalesce(F.col("text").rlike(f"[^{_SPACE}]"), F.lit(False))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))

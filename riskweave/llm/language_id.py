"""Language identification by multilingual mixture inference.

A language is a distribution of character trigrams (of words in lower case with their ends marked), counted over all training
documents in a fixed number of hash buckets. A document is a mixture: each of its words comes from one language, in proportions
that expectation-maximisation estimates from the words' likelihoods. The languages of a document are the set that maximises the
penalised likelihood ``log L - (k - 1) / 2 * PENALTY * log(words)``; a language of a single stray word does not pay for its
parameter. The search starts from the best single language and adds the language, or makes the exchange, that raises the
likelihood most, until no larger set can win: the mixture of all languages bounds the likelihood of every set (its gradient
bounds how far EM is from the maximum), so most documents are settled by the first step, without a look at other sets.

What goes to the executors is a table of ``BUCKETS`` numbers for each language; from ``FULL_TABLE`` languages on there are half
as many buckets for twice as many languages, so the table stays bounded and no language is left out.

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be learned. Null
langs teach nothing. Rows with equal ids are separate. Extra columns are ignored. Ties go to the language first in order.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.layout import spread
from riskweave.llm._common import fold_of, materialize, table

BUCKETS = 1 << 16
FULL_TABLE = 512
PENALTY = 2.0
ROUNDS = 8
MEMO_ENTRIES = 300_000
FLUSH_ENTRIES = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def trigram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, index of the first trigram of each word) for words with marked ends."""
    text = " " + "  ".join(words) + " "
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    buckets = (mixed >> np.uint64(48)).astype(np.int64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    # A word of n letters has n trigrams " w ", and two more run over into the next word's margin.
    starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    return buckets, starts


def _word_trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owner): only trigrams within the margins of one word."""
    buckets, starts = trigram_buckets(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return buckets[at], owner


def _count(batches):
    """(lang, bucket, n) over the texts of a partition."""
    by_lang: dict[str, Counter] = {}
    grams: dict[str, np.ndarray] = {}

    def spread(lang: str) -> None:
        words = list(by_lang[lang])
        if words:
            buckets, owner = _word_trigrams(words)
            n = np.fromiter(by_lang[lang].values(), dtype=np.float64, count=len(words))
            grams.setdefault(lang, np.zeros(BUCKETS))
            grams[lang] += np.bincount(buckets, weights=n[owner], minlength=BUCKETS)
        by_lang[lang].clear()

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            words = by_lang.setdefault(lang, Counter())
            words.update(_WORD.findall((text.as_py() or "").lower()))
            if len(words) > FLUSH_ENTRIES:
                spread(lang)
    for lang in by_lang:
        spread(lang)
    for lang, n in grams.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), type=pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])


def learn(training: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods of shape buckets x languages) from ``training(text, lang)``."""
    counted = materialize(training.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    languages = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    size = BUCKETS
    while size > 256 and size * len(languages) > BUCKETS * FULL_TABLE:
        size //= 2
    place = {lang: k for k, lang in enumerate(languages)}
    n = np.zeros((size, len(languages)))
    cells = counted.groupBy("lang", F.pmod("bucket", F.lit(size)).alias("bucket")).agg(F.sum("n").alias("n"))
    packed = cells.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))  # BUCKETS cells at most
    for r in packed.toLocalIterator():
        for cell in r["cells"]:
            n[cell["bucket"], place[r["lang"]]] = cell["n"]
    return languages, np.log((n + smoothing) / (n.sum(axis=0) + smoothing * size)).astype(np.float32)


def _mix(r: np.ndarray, n: np.ndarray, starts: np.ndarray, doc: np.ndarray, total: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for all documents of a batch at once: (proportions, log likelihood, bound of the greatest log likelihood). ``r`` holds
    each word's relative likelihoods."""
    pi = np.full((len(starts), r.shape[1]), 1 / r.shape[1])
    for _ in range(rounds):
        share = pi[doc] * r
        share *= (n / share.sum(axis=1))[:, None]
        pi = np.add.reduceat(share, starts, axis=0) / total[:, None]
    mixed = (pi[doc] * r).sum(axis=1)
    like = np.add.reduceat(n * np.log(mixed), starts)
    # By concavity: log L(q) - log L(pi) <= total * log max_l (sum n r_l / mixed / total).
    slope = np.add.reduceat(r * (n / mixed)[:, None], starts, axis=0) / total[:, None]
    return pi, like, like + total * np.log(np.maximum(slope.max(axis=1), 1.0))


def _set_likelihood(r: np.ndarray, n: np.ndarray, chosen: tuple[int, ...], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM for one document and one set of languages: (proportions, log likelihood)."""
    mine = r[:, list(chosen)]
    pi = np.full(len(chosen), 1 / len(chosen))
    for _ in range(rounds):
        share = mine * pi
        pi = (share * (n / share.sum(axis=1))[:, None]).sum(axis=0) / n.sum()
    return pi, float((n * np.log((mine * pi).sum(axis=1))).sum())


def search(r: np.ndarray, n: np.ndarray, first: int, bound: float, penalty: float = PENALTY) -> tuple[np.ndarray, tuple[int, ...]]:
    """(proportions, languages) of one document: sets grow by the addition or exchange that raises the likelihood most, until
    ``bound`` less the penalty of a larger set cannot exceed the best value."""
    cost = penalty / 2 * math.log(max(n.sum(), 2))
    languages = range(r.shape[1])
    pi, like = _set_likelihood(r, n, (first,))
    best, at = (like, pi, (first,)), (like, pi, (first,))
    while len(at[2]) < r.shape[1] and bound - len(at[2]) * cost > best[0]:
        grown = [(*at[2], x) for x in languages if x not in at[2]]
        step = None
        while grown:
            tried = [(*reversed(_set_likelihood(r, n, s)), s) for s in grown]
            top = max(tried, key=lambda x: (x[0], [-v for v in sorted(x[2])]))
            if step is not None and top[0] <= step[0]:
                break
            step = top
            grown = [(*(y for y in step[2] if y != old), x) for old in step[2] for x in languages if x not in step[2]]
        at = step
        value = at[0] - (len(at[2]) - 1) * cost
        if value > best[0]:
            best = (value, at[1], at[2])
    return best[1], best[2]


def infer(word_logs: np.ndarray, n: np.ndarray, starts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions (documents x languages, zero outside the chosen set) for documents whose words, with counts ``n``, begin at
    ``starts``."""
    docs, languages = len(starts), word_logs.shape[1]
    doc = np.repeat(np.arange(docs), np.diff(np.append(starts, len(n))))
    total = np.add.reduceat(n, starts)
    logs = np.maximum(word_logs - word_logs.max(axis=1, keepdims=True), -60.0).astype(np.float64)
    r = np.exp(logs)
    _, _, bound = _mix(r, n, starts, doc, total, ROUNDS)
    single = np.add.reduceat(logs * n[:, None], starts, axis=0)
    first = single.argmax(axis=1)
    chosen = np.zeros((docs, languages))
    chosen[np.arange(docs), first] = 1.0
    open_ = bound - penalty / 2 * np.log(np.maximum(total, 2)) > single[np.arange(docs), first]
    ends = np.append(starts[1:], len(n))
    for d in np.flatnonzero(open_).tolist():
        rows = slice(int(starts[d]), int(ends[d]))
        pi, members = search(r[rows], n[rows], int(first[d]), float(bound[d]), penalty)
        chosen[d] = 0
        chosen[d, list(members)] = pi
    return chosen


def _classify(held, slice_rows: int):
    def run(batches):
        languages, logs = held.value
        memo: dict[str, int] = {}
        rows = np.zeros((1024, len(languages)), dtype=np.float32)
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                counted = [Counter(_WORD.findall((t or "").lower())) if ok else Counter() for t, ok in zip(batch.column("text").to_pylist(), batch.column("has_letter").to_pylist(), strict=True)]
                missing = list({w for c in counted for w in c if w not in memo})
                if len(memo) + len(missing) > MEMO_ENTRIES:
                    memo.clear()
                    missing = list({w for c in counted for w in c})
                if missing:
                    buckets, owner = _word_trigrams(missing)
                    at0 = len(memo)
                    while len(rows) < at0 + len(missing):
                        rows = np.concatenate([rows, np.zeros_like(rows)])
                    first = np.searchsorted(owner, np.arange(len(missing)))
                    rows[at0 : at0 + len(missing)] = np.add.reduceat(logs[buckets % len(logs)], first, axis=0)
                    memo.update(zip(missing, range(at0, at0 + len(missing)), strict=True))
                lang, score, sets = ["und"] * batch.num_rows, [0.0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
                full = [i for i, c in enumerate(counted) if c]
                if full and languages:
                    sizes = [len(counted[i]) for i in full]
                    place = np.fromiter((memo[w] for i in full for w in counted[i]), dtype=np.int64, count=sum(sizes))
                    n = np.fromiter((v for i in full for v in counted[i].values()), dtype=np.float64, count=sum(sizes))
                    pi = infer(rows[place], n, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64))
                    first = pi.argmax(axis=1)
                    for k, i in enumerate(full):
                        lang[i], score[i] = languages[first[k]], float(min(1.0, pi[k, first[k]]))
                        sets[i] = [languages[j] for j in np.argsort(-pi[k], kind="stable") if pi[k, j] > 0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score), pa.array(sets, type=pa.list_(pa.string()))],
                    names=["doc_id", "held_out", "lang_pred", "score", "languages"],
                )

    return run


def identify(docs: DataFrame, folds: int = 4, held_fold: int = 2, slice_rows: int = 512) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the share of the predicted language in the chosen mixture) and languages (the chosen
    set, strongest first) of each row of ``docs(doc_id, text, lang)``. Learns from rows outside the held fold."""
    fold = fold_of("doc_id", folds)
    languages, logs = learn(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != held_fold)))
    held = docs.sparkSession.sparkContext.broadcast((languages, logs))
    rows = docs.select("doc_id", "text", (fold == held_fold).alias("held_out"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("has_letter"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_classify(held, slice_rows), f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<string>")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))

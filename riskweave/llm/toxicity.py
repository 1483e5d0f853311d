"""Toxicity by noisy-channel deobfuscation.

Model of the channel: a writer has a word in mind, and what we see may have letters replaced by look-alikes, letters repeated,
or marks and spaces put between them. For each suspicious token a character lattice holds, at every place, the letters that the
mark may stand for, nothing (the mark was inserted) or one or two of a run of equal letters. Viterbi decoding under a character
trigram model, whose counts come from the words of all documents, finds the likeliest word. Tokens that look like plain words
stand for themselves.

Restored words are then evidence. For each the labelled documents tell how many toxic and other documents have it; it counts if the lower Wilson bound of its toxic share exceeds one half. A document's score is a
logistic function of its strongest evidence and of how much there is, fitted on a bounded sample of the labelled rows.

All counts cover every document (the language model) or every labelled document outside the held-out fold (the evidence). What
goes to the executors is bounded by parameters: the trigram model by its alphabet (Latin letters), the evidence by blocks of about
``MOST_EVIDENCE``, each of which passes over the texts; more candidates than that are met by a join. No evidence is left out.

Edge cases: null and empty texts get the score of a document without evidence. Without labelled rows of both kinds all scores
are the share of toxic labels, or 0. Rows with equal ids are scored each for itself; labels count once per (id, value) and join
every row of that id. Extra columns are ignored.
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
from riskweave.llm._common import column, fold_of, materialize, table

#: Documents on which the two weights of the score are fitted, at most.
FIT_ROWS = 20_000
#: Evidence that is broadcast at once, about.
MOST_EVIDENCE = 200_000
WILSON_Z = 2.33
#: Labels (an id and a number each) up to this many are broadcast.
BROADCAST_LABELS = 1_000_000
MEMO_ENTRIES = 150_000
MEMO_CHARS = 40
FLUSH_ENTRIES = 150_000
BOUNDARY = " "
LETTER_END = "ɐ"
#: What a mark may stand for (fixed look-alikes).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
#: Costs in nats: a look-alike, an inserted mark, a letter dropped from a run, a mark kept as it is.
SUBSTITUTED, INSERTED, DROPPED = 2.0, 2.5, 1.0
#: Marks that end or open a token in plain writing.
_EDGE = ".,;:?\"'()[]{}<>«»“”‘’…-_/\\%&#=~^`"
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_RUN = re.compile(r"(.)\1{2,}")


_IS_LETTER = np.array([chr(x).isalpha() for x in range(ord(LETTER_END))])


def _spelled(path: tuple | None) -> str:
    parts = []
    while path is not None:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts))


def _latin(ch: str) -> bool:
    return ch < LETTER_END and ch.isalpha()


class Restorer:
    """The channel and the character model: ``word(token)`` gives the likeliest word."""

    def __init__(self, trigrams: dict[str, int]):
        pairs: Counter = Counter()
        for t, n in trigrams.items():
            pairs[t[:2]] += n
        letters = {ch for t in trigrams for ch in t} or {"a"}
        size = len(letters)
        self.logs = {t: math.log((n + 0.1) / (pairs[t[:2]] + 0.1 * size)) for t, n in trigrams.items()}
        self.unseen = {p: math.log(0.1 / (n + 0.1 * size)) for p, n in pairs.items()}
        self.floor = -math.log(size)
        self.memo: dict[str, str] = {}

    def step(self, pair: str, ch: str) -> float:
        found = self.logs.get(pair + ch)
        return found if found is not None else self.unseen.get(pair, self.floor)

    def suspicious(self, token: str) -> bool:
        """Has at least two letters or look-alikes and a letter, and something that plain words have not."""
        inner = token.strip(_EDGE)
        if inner.isalpha():
            return _RUN.search(inner) is not None
        return sum(ch in LOOKALIKES or ch.isalpha() for ch in inner) >= 2 and any(map(_latin, inner))

    def decode(self, token: str) -> str:
        """The best path through the lattice of ``token``; of equal paths the alphabetically first."""
        places: list[list[tuple[str, float]]] = []
        at = 0
        while at < len(token):
            ch = token[at]
            run = at
            while run < len(token) and token[run] == ch:
                run += 1
            n = run - at
            if ch.isalpha():
                places.append([(ch * k, DROPPED * math.log1p(n - k)) for k in sorted({min(n, 1), min(n, 2)})] if _latin(ch) else [(ch * n, 0.0)])
            else:
                # A mark stands for a letter of its own each time up to twice; beyond that it is an ornament.
                stands = [(x * k, SUBSTITUTED * k) for x in LOOKALIKES.get(ch, "") for k in range(1, min(n, 2) + 1)] if n <= 2 else []
                places.append([("", INSERTED), *stands])
            at = run
        # A state is the last two letters; a path is the letters chosen so far, linked backwards.
        states: dict[str, tuple[float, tuple | None]] = {BOUNDARY * 2: (0.0, None)}
        for options in places:
            after: dict[str, tuple[float, tuple | None]] = {}
            for pair, (score, path) in states.items():
                for letters, cost in options:
                    s, p = score - cost, pair
                    for ch in letters:
                        s += self.step(p, ch)
                        p = p[1] + ch
                    old = after.get(p)
                    if old is None or s > old[0]:
                        after[p] = (s, (path, letters))
                    elif s == old[0] and _spelled((path, letters)) < _spelled(old[1]):
                        after[p] = (s, (path, letters))
            states = after
        return min(((-s - self.step(p, BOUNDARY), _spelled(path)) for p, (s, path) in states.items()))[1]

    def word(self, token: str) -> str:
        found = self.memo.get(token)
        if found is None:
            inner = token.strip(_EDGE)
            found = self.decode(token.strip(".,;:?\"'")) if self.suspicious(token) else inner
            if len(token) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_ENTRIES // 5:  # callers keep what they derive from a word
                    self.memo.clear()
                self.memo[token] = found
        return found

    def tokens(self, text: str | None) -> set[str]:
        """The distinct tokens of a whole text, with runs of single characters joined."""
        if not text:
            return set()
        low = text.lower()
        found = set(low.split())
        if sum(map(1 .__eq__, map(len, found))) >= 2:
            found.update("".join(m.group().split()) for m in _SPACED.finditer(low))
        return found

    def words(self, text: str | None) -> set[str]:
        """The distinct restored words of a whole text."""
        found = set(map(self.word, self.tokens(text)))
        found.discard("")
        return found


def trigrams_of(text: str) -> Counter:
    """Counts of the trigrams of a text's words: runs of Latin letters with two boundaries before and one after."""
    low = f"  {text.lower()} "
    codes = np.frombuffer(low.encode("utf-32-le", "replace"), dtype="<u4")
    codes = np.where(codes < len(_IS_LETTER), codes, 32)
    codes = np.where(_IS_LETTER[codes], codes, 0)
    letters = np.flatnonzero(np.bincount(codes, minlength=len(_IS_LETTER)))
    letters = np.union1d([0], letters)
    place = np.zeros(len(_IS_LETTER), dtype=np.int64)
    place[letters] = np.arange(len(letters))
    at = place[codes]
    here, before = at[2:], at[1:-1]
    first = np.where(before > 0, at[:-2], 0)
    n = len(letters)
    grams = ((first * n + before) * n + here)[(here > 0) | (before > 0)]
    found = np.bincount(grams, minlength=1)
    name = [BOUNDARY if x == 0 else chr(x) for x in letters]
    return Counter({name[g // (n * n)] + name[g // n % n] + name[g % n]: int(found[g]) for g in np.flatnonzero(found).tolist()})


def _count_trigrams(batches):
    """(trigram, n) from every text of a partition."""
    grams: Counter = Counter()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            grams.update(trigrams_of("\n".join(filter(None, batch.column("text").slice(at, 256).to_pylist()))))
    yield pa.RecordBatch.from_arrays([pa.array(list(grams), type=pa.string()), pa.array(list(grams.values()), type=pa.int64())], names=["gram", "n"])


def character_model(docs: DataFrame) -> dict[str, int]:
    """Trigram counts over all documents; as many as there are trigrams of Latin letters at most."""
    counts = docs.select("text").mapInArrow(_count_trigrams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counts.collect()}


def wilson_lower(hits: int, n: int, z: float = WILSON_Z) -> float:
    """Lower bound of a share."""
    p, zz = hits / n, z * z
    return (p + zz / (2 * n) - z * math.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


class _Weights(dict):
    """Token -> what ``of`` gives for its restored word, learned when first asked for; cleared when full."""

    def __init__(self, restorer: Restorer, of):
        self.restorer, self.of = restorer, of

    def __missing__(self, token: str):
        found = self.of(self.restorer.word(token))
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[token] = found
        return found


def _count_evidence(model, allowed):
    """(evidence, n): in how many texts of a partition each restored word occurs; only ``allowed`` ones if given."""

    def run(batches):
        restorer, counts = Restorer(model.value), Counter()
        only = None if allowed is None else allowed.value
        kept = _Weights(restorer, lambda w: w if w in only else None) if only is not None else None

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=["evidence", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if only is None:
                    counts.update(restorer.words(text))
                else:
                    counts.update(filter(None, set(map(kept.__getitem__, restorer.tokens(text)))))
                if len(counts) > FLUSH_ENTRIES:
                    yield flush()
        yield flush()

    return run


def _weigh(batches):
    """(evidence, weight) of counted evidence whose bound exceeds one half."""
    for batch in batches:
        kept = []
        for e, hits, clean in zip(*(batch.column(c).to_pylist() for c in ("evidence", "toxic", "clean")), strict=True):
            share = wilson_lower(hits, hits + clean)
            if share > 0.5:
                kept.append((e, math.log(share / (1 - share))))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], type=pa.string()), pa.array([k[1] for k in kept], type=pa.float64())], names=["evidence", "weight"])


def learn_evidence(labelled: DataFrame, model) -> DataFrame:
    """(evidence, weight) from ``labelled(text, toxic)``: the log odds of the lower bound of its toxic share.

    Toxic texts name the candidates: without enough of them the bound cannot exceed one half. All others are then counted for
    the candidates alone, which go to the executors if they are few enough; else everything is counted and the join selects.
    """
    least = math.ceil(WILSON_Z**2)  # n hits of n have the bound n / (n + z^2)

    def counted(rows: DataFrame, allowed, name: str) -> DataFrame:
        return rows.select("text").mapInArrow(_count_evidence(model, allowed), "evidence string, n bigint").groupBy("evidence").agg(F.sum("n").alias(name))

    candidates = materialize(counted(labelled.where("toxic = 1"), None, "toxic").where(F.col("toxic") >= least), "toxicity-candidates")
    n = candidates.count()
    if not n:
        return candidates.select("evidence", F.lit(0.0).alias("weight"))
    allowed = labelled.sparkSession.sparkContext.broadcast(frozenset(r["evidence"] for r in candidates.select("evidence").collect())) if n <= MOST_EVIDENCE else None
    both = candidates.join(counted(labelled.where("toxic = 0"), allowed, "clean"), "evidence", "left").select("evidence", "toxic", F.coalesce("clean", F.lit(0)).alias("clean"))
    return materialize(both.mapInArrow(_weigh, "evidence string, weight double"), "toxicity-evidence")


def evidence_blocks(weights: DataFrame, trigrams: dict[str, int]) -> list:
    """Broadcasts of (trigrams, weights of a block)."""
    spark = weights.sparkSession
    blocks = max(1, -(-weights.count() // MOST_EVIDENCE))
    place = F.pmod(F.xxhash64("evidence"), F.lit(blocks))
    return [spark.sparkContext.broadcast((trigrams, {r["evidence"]: r["weight"] for r in weights.where(place == b).collect()})) for b in range(blocks)]


def _feature_rows(held, keep: list[str], first: bool, last: bool):
    """The columns ``keep`` with the strongest weight (top) and log1p of the number of tokens with evidence (many). Before the
    last block the text stays and many is the number so far."""

    def run(batches):
        trigrams, weights = held.value
        restorer = Restorer(trigrams)
        memo = _Weights(restorer, lambda w: weights.get(w, 0.0))
        for batch in batches:
            so_far = [(0.0, 0.0)] * batch.num_rows if first else zip(batch.column("top").to_pylist(), batch.column("many").to_pylist(), strict=True)
            pairs = []
            for text, (top, many) in zip(batch.column("text").to_pylist(), so_far, strict=True):
                hits = [v for v in map(memo.__getitem__, restorer.tokens(text)) if v]
                many += len(hits)
                pairs.append((max([top, *hits]), math.log1p(many) if last else many))
            names = keep if last else [*keep, "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in names], pa.array([p[0] for p in pairs], type=pa.float64()), pa.array([p[1] for p in pairs], type=pa.float64())], names=[*names, "top", "many"]
            )

    return run


def features(rows: DataFrame, keep: list[str], models: list) -> DataFrame:
    """``keep``, top and many of ``rows(text, *keep)``: one pass for each block of evidence."""
    from pyspark.sql.types import DoubleType

    for n, model in enumerate(models):
        last = n == len(models) - 1
        schema = rows.select(*keep, *([] if last else ["text"])).schema.add("top", DoubleType()).add("many", DoubleType())
        rows = rows.mapInArrow(_feature_rows(model, keep, n == 0, last), schema)
        if not last:  # so that a task holds one block at a time
            rows = materialize(rows, "toxicity-features")
    return rows


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def _scored(docs: DataFrame, labels: DataFrame, folds: int, held_fold: int) -> tuple[DataFrame, dict[str, str]]:
    """Every row of ``docs`` under names without clashes, with ``held_out`` and ``score``; and those names by the columns' own."""
    spark = docs.sparkSession
    trigrams = character_model(docs)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    if known.count() <= BROADCAST_LABELS:  # a few bytes each; beyond that both sides are shuffled
        known = F.broadcast(known)
    train = (
        docs.select("doc_id", "text")
        .join(known, "doc_id")
        .where(fold_of("doc_id", folds) != held_fold)
        .select("text", "toxic", F.xxhash64(F.lit(11), "doc_id").alias("order"))
    )
    train = materialize(train, "toxicity-train")
    held = spark.sparkContext.broadcast(trigrams)
    models = evidence_blocks(learn_evidence(train, held), trigrams)
    total = train.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total["n"] or 0, total["t"] or 0
    if 0 < t < n:
        # A sample by hash: each labelled row has the same chance, and what is read is bounded by FIT_ROWS.
        share = min(1.0, FIT_ROWS / n)
        sample = train.where(F.pmod(F.col("order"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text", "toxic")
        rows = features(sample, ["toxic"], models).limit(2 * FIT_ROWS).collect()
        w = fit_logistic(np.array([(r["top"], r["many"]) for r in rows]).reshape(-1, 2), np.array([r["toxic"] for r in rows], dtype=float)) if rows else np.array([1.0, 1.0, -3.0])
    else:
        rate = min(max(t / n if n else 0.0, 1e-6), 1 - 1e-6)
        w = np.array([0.0, 0.0, math.log(rate / (1 - rate))])
    plain = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    text = next(c for c in docs.columns if c.lower() == "text")
    doc_id = next(c for c in docs.columns if c.lower() == "doc_id")
    renamed = docs.select(*[column(c).alias(p) for c, p in plain.items()], column(text).alias("text"))
    rows = features(renamed, list(plain.values()), models)
    z = F.col("top") * float(w[0]) + F.col("many") * float(w[1]) + float(w[2])
    return rows.select(*plain.values(), (fold_of(plain[doc_id], folds) == held_fold).alias("held_out"), F.round(1 / (1 + F.exp(-z)), 9).alias("score")), plain


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """Every row of ``docs`` with its own columns, ``held_out``, ``score`` and ``predicted``; columns of these three names are
    replaced."""
    rows, plain = _scored(docs, labels, folds, held_fold)
    own = [F.col(p).alias(c) for c, p in plain.items() if c.lower() not in ("held_out", "score", "predicted")]
    return rows.select(*own, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches the cutoff."""
    rows, plain = _scored(docs, labels, 5, 0)
    return rows.where(F.col("score") < cutoff).select(*[F.col(p).alias(c) for c, p in plain.items()])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")

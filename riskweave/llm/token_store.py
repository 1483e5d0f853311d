"""Token-ID files: documents as Parquet list columns that a trainer can read selectively.

Layout: one row per document, ``tokens list<int32>`` beside narrow metadata columns, files in ascending document order.
Row groups and pages are small and of a set size, and the writer keeps page indexes, so that a reader of a range of
documents, or of the metadata alone, touches only the pages it needs. Token ids are dictionary encoded by default (a
vocabulary fits a dictionary page); ``encoding="delta"`` writes Parquet v2 DELTA_BINARY_PACKED pages instead.

Edge cases: a null text counts as empty, an empty text has the end id alone, rows with equal or null ids are all kept
(null ids come first; equal ids are ordered by their text). Ids may be of any type that sorts. An empty table gives no rows.
Extra columns are ignored. A tokenizer file that is not of the kind described at ``SPLIT`` encodes every text as it is.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm._common import table, workspace

#: Words that a worker remembers; when there are more, the half that was met last stays.
MEMO_ENTRIES = 500_000
MEMO_KEY_CHARS = 40
#: Characters looked at in one step; a longer text is cut at white space.
STEP_CHARS = 1 << 20
#: What a tokenizer file must say for its texts to be split here. Other files encode every text as it is.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"
_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Characters below U+0250 (Latin letters, none of which composes with another): white space, letter, number, other, and those
# whose lower case is longer or lies beyond. A text with any character beyond goes to the library as it is.
_LATIN = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER, _BEYOND = range(5)
_SPACES = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
_LOW = np.zeros(_LATIN + 1, dtype=np.uint32)
_KIND = np.full(_LATIN + 1, _BEYOND, dtype=np.uint8)
for _c in range(_LATIN):
    _l = chr(_c).lower()
    if len(_l) == 1 and ord(_l) < _LATIN:
        _LOW[_c] = ord(_l)
        _KIND[_c] = _SPACE if _c in _SPACES else _LETTER if chr(_c).isalpha() else _NUMBER if unicodedata.category(chr(_c))[0] == "N" else _OTHER

_QUOTE, _ONE, _TWO = ord("'"), np.zeros(_LATIN + 1, dtype=bool), ("re", "ve", "ll")
_ONE[[ord(c) for c in "stmd"]] = True


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


class _Rolling:
    """Hashes of slices of a sequence of code points from one running sum, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, dtype=np.uint64)
        self.value = np.random.default_rng(base & 0xFFFF).integers(1, 1 << 63, size=_LATIN + 1, dtype=np.uint64)

    def __call__(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(codes)
        if len(self.up) <= n:
            self.up, self.down = _powers(self.base, n + 1), _powers(self.inverse, n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.value[codes] * self.up[:n], out=sums[1:])
        return (sums[end] - sums[begin]) * self.down[begin]


def cut_words(low: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of what the pre-tokenizer makes of a lower-case text that begins and ends with white space."""
    before = np.concatenate([[_SPACE], kind[:-1]])
    border = (kind != before) | (kind == _NUMBER)
    # A quote that stands alone before letters takes s, t, m, d, re, ve or ll to itself; letters after these are a word.
    at = np.flatnonzero((low[:-3] == _QUOTE) & border[:-3] & (kind[1:-2] == _LETTER))
    if len(at):
        one = at[_ONE[low[at + 1]]]
        two = at[np.logical_or.reduce([(low[at + 1] == ord(x[0])) & (low[at + 2] == ord(x[1])) for x in _TWO])]
        for places, size in ((one, 2), (two, 3)):
            border[places + 1] = False
            border[places + size] = True
    places = np.flatnonzero(border)
    words = kind[places[:-1]] != _SPACE
    return places[:-1][words], places[1:][words]


class Encoder:
    """A worker's tokenizer with a memo from pre-tokens to their ids.

    The pre-tokenizer cuts a text into words, digits and runs of marks, and the library's merges never cross them: a text's ids are
    the ids of its pre-tokens in a row. For Latin texts they are cut here, for a whole batch at once; the library encodes those that
    were not met before, and a table answers for the rest. Pre-tokens are told apart by two independent 64-bit hashes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        model = spec["model"]
        self.by_words = (
            spec.get("normalizer") == NORMALIZER
            and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": SPLIT}, "Removed", True)
            and not steps[1].get("add_prefix_space", True) and not steps[1].get("use_regex", True)
            and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", WORD_END, None)
            and not spec.get("truncation") and not spec.get("padding")
            and all(x["content"].startswith("<|") for x in spec.get("added_tokens") or ())
        )
        # Lower-case pre-tokens pass the normalizer unchanged: the normalizer and the pattern are skipped for them.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends_word = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        for piece, i in self.whole.get_vocab().items():
            self.ends_word[i] = piece.endswith(WORD_END)
        self.hash1, self.hash2 = _Rolling(0x9E3779B97F4A7C15), _Rolling(0xD6E8FEB86659FD93)
        self._reset()

    def _reset(self) -> None:
        self.place: dict[int, int] = {}
        self.n = self.used = self.clock = 0
        self.check = np.zeros(1024, dtype=np.uint64)
        self.key = np.zeros(1024, dtype=np.uint64)
        self.begin, self.size, self.met = (np.zeros(1024, dtype=np.int64) for _ in range(3))
        self.ids = np.zeros(4096, dtype=np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        whole, group, held = [], [], 0
        for n, text in enumerate(texts):
            if not self.by_words or "<|" in text:  # "<|" may open one of the vocabulary's special tokens
                whole.append(n)
                continue
            for piece in _pieces(text):
                group.append((n, piece))
                held += len(piece)
                if held >= STEP_CHARS:
                    whole += self._step(group, out)
                    group, held = [], 0
        if group:
            whole += self._step(group, out)
        whole = sorted(set(whole))
        for n, e in zip(whole, self.whole.encode_batch_fast([texts[n] for n in whole], add_special_tokens=False), strict=True):
            out[n] = [np.array(e.ids, dtype=np.uint32)]
        return [parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32) for parts in out]

    def _step(self, group: list[tuple[int, str]], out: list[list[np.ndarray]]) -> list[int]:
        """Adds the ids of each piece; returns the texts that have to go to the library as they are."""
        joined = "\n" + "\n".join(piece for _, piece in group) + "\n\n\n"
        codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4"), _LATIN)
        low, kind = _LOW[codes], _KIND[codes]
        borders = np.cumsum([1, *[len(piece) + 1 for _, piece in group]])
        beyond = sorted({group[k][0] for k in np.searchsorted(borders, np.flatnonzero(kind == _BEYOND), side="right") - 1})
        begin, end = cut_words(low, kind)
        rows = self._rows(low, begin, end)
        if rows is None:
            return sorted({n for n, _ in group})
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.begin[rows] - (ends - sizes), sizes) + np.arange(total)]
        cuts = np.concatenate([[0], ends])[np.searchsorted(begin, borders)]
        for (n, _), a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
            out[n].append(flat[a:b])
        self._forget()
        return beyond

    def _rows(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray | None:
        """The table's row of each pre-token; None if two different ones share a hash."""
        key, check = self.hash1(low, begin, end), self.hash2(low, begin, end)
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        rows = np.fromiter(map(self.place.get, distinct.tolist(), repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(rows < 0)
        if len(new):
            text = low.astype("<u4").tobytes().decode("utf-32-le", "replace")
            at = first[new]
            self._learn([text[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)], distinct[new], check[at])
            rows[new] = np.arange(self.n - len(new), self.n)
        if (self.check[rows][back] != check).any():
            return None
        self.clock += 1
        self.met[rows] = self.clock
        return rows[back]

    def _learn(self, words: list[str], keys: np.ndarray, checks: np.ndarray) -> None:
        """Many words go to the library as one text; the ids that end a word tell them apart. Should their number not agree, the
        words go one by one."""
        parts, sizes = [], []
        for at in range(0, len(words), 2000):
            block = words[at : at + 2000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) != len(block) or cuts[-1] != len(ids):
                each = [np.array(e.ids, dtype=np.uint32) for e in self.whole.encode_batch_fast(block, add_special_tokens=False)]
                ids, cuts = np.concatenate(each), np.cumsum(list(map(len, each)))
            parts.append(ids)
            sizes.append(np.diff(cuts, prepend=0))
        ids, size = np.concatenate(parts), np.concatenate(sizes)
        a, b = self.n, self.n + len(words)
        for name in ("check", "key", "begin", "size", "met"):
            setattr(self, name, _grown(getattr(self, name), b))
        self.ids = _grown(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.check[a:b], self.key[a:b], self.size[a:b] = checks, keys, size
        self.begin[a:b] = self.used + np.cumsum(size) - size
        self.place.update(zip(keys.tolist(), range(a, b), strict=True))
        self.n, self.used = b, self.used + len(ids)

    def _forget(self) -> None:
        if self.n <= MEMO_ENTRIES and self.used <= MEMO_KEY_CHARS * MEMO_ENTRIES:
            return
        met = self.met[: self.n]
        keep = np.flatnonzero(met > np.median(met))
        keep = keep[self.size[keep] <= MEMO_KEY_CHARS]
        check, key, size = self.check[keep], self.key[keep], self.size[keep]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids, met = self.ids[np.repeat(self.begin[keep] - (ends - size), size) + np.arange(total)], met[keep]
        clock = self.clock
        self._reset()
        self.n, self.used, self.clock = len(keep), total, clock
        self.check, self.key, self.size, self.begin, self.met, self.ids = check, key, size, ends - size, met, ids
        self.place = dict(zip(key.tolist(), range(len(keep)), strict=True))


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])


def _pieces(text: str):
    """A text in pieces of about ``STEP_CHARS`` that end before a space or line end."""
    at = 0
    while len(text) - at > STEP_CHARS:
        cuts = [k for k in (text.find(" ", at + STEP_CHARS), text.find("\n", at + STEP_CHARS)) if k >= 0]
        if not cuts:
            break
        yield text[at : min(cuts)]
        at = min(cuts)
    yield text[at:]


def encoder(path: str) -> Encoder:
    """One for each Python worker; a worker serves many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(path: str, texts: list[str]) -> list[list[int]]:
    return [x.tolist() for x in encoder(path).encode(texts)]


def _encode_rows(path: str, end_id: int, slice_rows: int):
    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard, offset = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                raw = encoder(path).encode([t or "" for t in part.column("text").to_pylist()])
                n = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
                ends = np.cumsum(n)
                flat = np.concatenate([x for ids in raw for x in (ids, end)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.full(len(n), shard, dtype=np.int32)),
                        pa.array(offset + ends - n),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat)),
                    ],
                    names=["doc_id", "shard", "shard_offset", "n_tokens", "tokens"],
                )
                offset += int(ends[-1])

    return run


def write_tokens(
    docs: DataFrame,
    out: str,
    tokenizer: str | None = None,
    end_id: int = 1,
    encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
    slice_rows: int = 256,
) -> str:
    """Encode ``docs(doc_id, text)`` and write the files in ascending order of doc_id.

    Ranges of ids are dealt to tasks by one shuffle of the texts; each task sorts, encodes and writes its range, and
    stores each document's place within its shard, so that no later step has to sort again.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")
    path = tokenizer or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = (
        docs.select(F.col("doc_id"), F.col("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc_nulls_first())
    )
    (
        ranged.mapInArrow(_encode_rows(path, end_id, slice_rows), f"doc_id {kind}, shard int, shard_offset bigint, n_tokens bigint, tokens array<int>")
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2")
        .option("compression", "snappy")
        .parquet(out)
    )
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, shard_offset, n_tokens, tokens): the stored rows."""
    return spark.read.parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, shard_start): ids before each shard. One row per file, read from the two narrow columns alone."""
    totals = read_tokens(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    rows, before = [], 0
    for r in totals:  # as many rows as there are files, never documents
        rows.append((r["shard"], before))
        before += r["n"]
    return spark.createDataFrame(rows, "shard int, shard_start bigint")


def _checksums(batches):
    for batch in batches:
        tokens = batch.column("tokens")
        bounds = tokens.offsets.to_numpy()
        raw = tokens.values.to_numpy().astype("<u4", copy=False)
        sums = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("shard"), batch.column("shard_offset"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, type=pa.int64())],
            names=["doc_id", "shard", "shard_offset", "n_tokens", "ids_crc32"],
        )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all of it from the files."""
    stored = read_tokens(spark, path)
    kind = stored.schema["doc_id"].dataType.simpleString()
    per_doc = (
        stored.select("doc_id", "shard", "shard_offset", "tokens")
        .mapInArrow(_checksums, f"doc_id {kind}, shard int, shard_offset bigint, n_tokens bigint, ids_crc32 bigint")
    )
    starts = F.broadcast(shard_starts(spark, path))  # one row per file
    return per_doc.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("shard_offset")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"), workspace(spark, "op9-tokens"))
    return digests(spark, path)

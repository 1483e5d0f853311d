"""Unigram segmentation: Viterbi over a double-array trie of pieces with log scores, and its inverse.

The vocabulary comes from a SentencePiece model file, of which only the piece list and the normalizer flags are used. A
unigram model brings its own log scores. A BPE model stores merge ranks instead; its pieces get Zipf log probabilities of
their rank, ``-log(rank + 2) - log(H)``, so that a segmentation's score is again a log likelihood. Characters that no
piece covers cost ``lowest score - 10`` and become byte pieces.

Segments are found per chunk. A chunk is a run of whitespace markers and what follows it up to the next marker or line
end. Since no piece has a marker after another character (checked on loading), the best path of a text is the best paths
of its chunks in a row, and chunks repeat, so each worker keeps a bounded memo of them.

Edge cases: null counts as empty; an empty text has no ids. U+2581 in a text is read as a space, as the format cannot tell
the two apart; such texts come back with spaces. Only identity-normalized models are accepted.
"""

from __future__ import annotations

import math
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.layout import spread
from riskweave.llm._common import column, table

MARK = "▁"
MEMO_ENTRIES = 300_000
MEMO_CHARS = 40
UNKNOWN_PENALTY = 10.0
SCALE = 1 << 20


def _fields(raw: bytes):
    """(field number, value) of one protobuf message: varints as int, fixed32 as float, the rest as bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        elif kind == 5:
            yield key >> 3, float(np.frombuffer(raw[at : at + 4], dtype="<f4")[0])
            at += 4
        else:
            yield key >> 3, raw[at : at + 8]
            at += 8


class Vocabulary:
    """Pieces, log scores and kinds (1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte)."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], dummy_prefix: bool = True):
        self.pieces, self.kinds, self.dummy_prefix = pieces, kinds, dummy_prefix
        # Whole multiples of 2**-20: sums are exact, and so ties between paths are ties.
        self.scores = [round(s * SCALE) for s in scores]
        if any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kinds, strict=True) if k in (1, 4)):
            raise ValueError("a piece has a whitespace marker inside")
        self.newline_is_piece = any("\n" in p for p, k in zip(pieces, kinds, strict=True) if k in (1, 4))
        self.byte_ids = [0] * 256
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == 6:
                self.byte_ids[int(p[3:5], 16)] = i
        if sum(k == 6 for k in kinds) != 256:
            raise ValueError("the model has no byte pieces")
        self.unknown = round((min(s for s, k in zip(scores, kinds, strict=True) if k == 1) - UNKNOWN_PENALTY) * SCALE)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            raw = f.read()
        pieces, scores, kinds, bpe, prefix = [], [], [], False, True
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode("utf-8"))
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, 1))
            elif number == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models with identity normalization and kept white space are supported")
                prefix = bool(spec.get(3, 1))
        if bpe:
            normal = [i for i, k in enumerate(kinds) if k in (1, 4)]
            total = math.log(sum(1 / (r + 2) for r in range(len(normal))))
            scores = [0.0] * len(pieces)
            for rank, i in enumerate(normal):
                scores[i] = -math.log(rank + 2) - total
        return cls(pieces, scores, kinds, prefix)


class DoubleArray:
    """A trie over UTF-8 bytes in two integer arrays: the child of state s by byte c is ``base[s] + c + 1`` if ``check``
    of that slot is s. ``value[s]`` is the piece that ends in s, or -1."""

    CROWDED = 0.95

    def __init__(self, vocabulary: Vocabulary):
        root: dict = {}
        for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True)):
            if k in (1, 4):
                node = root
                for c in p.encode("utf-8"):
                    node = node.setdefault(c, {})
                node[-1] = i
        base, check, value = array("i", [0] * 512), array("i", [-1] * 512), array("i", [-1] * 512)
        check[0], mark, todo = 0, 1, [(0, root)]
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            codes = sorted(c + 1 for c in node if c >= 0)
            if not codes:
                continue
            slot = first = max(codes[0] + 1, mark)
            taken = 0
            while True:
                if slot + 512 > len(check):
                    grow = len(check)
                    base.extend([0] * grow)
                    check.extend([-1] * grow)
                    value.extend([-1] * grow)
                at = slot - codes[0]
                if check[slot] >= 0:
                    taken += 1
                elif all(check[at + c] < 0 for c in codes):
                    break
                slot += 1
            if taken >= self.CROWDED * (slot - first + 1):  # hardly a gap on the way here: later searches start beyond
                mark = slot
            base[state] = at
            for c in codes:
                check[at + c] = state
            todo += [(at + c + 1, node[c]) for c in node if c >= 0]
        self.base, self.check, self.value = base, check, value


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.trie = vocabulary, DoubleArray(vocabulary)
        self.base, self.check, self.value = (list(x) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.memo: dict[str, tuple[int, ...]] = {}
        # Byte pieces from 0x80 up stand as lone surrogates until the text is joined; bytes below are their characters.
        self.surface = [
            "" if k in (2, 3) else (lambda b: chr(b) if b < 128 else chr(0xDC00 + b))(int(p[3:5], 16)) if k == 6 else p.replace(MARK, " ")
            for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)
        ]

    def segment(self, chunk: str) -> tuple[int, ...]:
        """The ids of the best path through the lattice of one chunk; of equal paths the one found first, that is with
        the longest last piece."""
        base, check, value, scores = self.base, self.check, self.value, self.vocabulary.scores
        raw = chunk.encode("utf-8", "replace")
        n, low = len(raw), -(1 << 62)
        best, back, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], unknown = 0, self.vocabulary.unknown
        for start in range(n):
            here = best[start]
            if here == low:  # inside a character
                continue
            lead = raw[start]
            width = start + (1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4)
            state, single = 0, False
            for end in range(start, n):
                nxt = base[state] + raw[end] + 1
                if check[nxt] != state:
                    break
                state = nxt
                i = value[state]
                if i >= 0:
                    end += 1
                    if end == width:
                        single = True
                    s = here + scores[i]
                    if s > best[end]:
                        best[end], back[end], piece[end] = s, start, i
            if not single and here + unknown > best[width]:
                best[width], back[width], piece[width] = here + unknown, start, -1
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += [self.vocabulary.byte_ids[b] for b in reversed(raw[back[at] : at])]
            at = back[at]
        return tuple(reversed(out))

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if self.vocabulary.dummy_prefix:
            marked = MARK + marked
        parts = [marked]
        if not self.vocabulary.newline_is_piece and "\n" in marked:
            parts = marked.split("\n")
            parts = [x for p in parts for x in (p, "\n")][:-1]
        out: list[str] = []
        for p in parts:
            if MARK not in p:
                if p:
                    out.append(p)
                continue
            run = 0
            first, *rest = p.split(MARK)
            if first:
                out.append(first)
            for x in rest:
                run += 1
                if x:
                    out.append(MARK * run + x)
                    run = 0
            if run:
                out.append(MARK * run)
        return out

    def encode(self, text: str | None) -> list[int]:
        memo, ids = self.memo, []
        for chunk in self.chunks(text or ""):
            found = memo.get(chunk)
            if found is None:
                found = self.segment(chunk)
                if len(chunk) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[chunk] = found
            ids += found
        return ids

    def decode(self, ids) -> str:
        text = "".join(map(self.surface.__getitem__, ids))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if self.vocabulary.dummy_prefix and text[:1] == " " else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(Vocabulary.load(path))
    return _codecs[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _arrays(ids: list[list[int]]) -> tuple[np.ndarray, pa.Array]:
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
    return flat, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", slice_rows: int = 256) -> DataFrame:
    """``docs`` with ``token_ids array<int>``, ``n_bytes_pieces``, ``ids_crc32`` and ``round_trip`` (decoding the ids gives
    the text back), beside the columns of ``docs`` other than ``text_col``. Columns of these names are replaced."""
    path = model or model_path()
    added = ("n_tokens", "n_byte_pieces", "ids_crc32", "round_trip", "token_ids")
    kept = [c for c in docs.columns if c != text_col and c.lower() not in added]
    plain = [f"in_{k}" for k in range(len(kept))]  # names may hold dots, which Arrow functions do not take
    rows = docs.select(*[column(c).alias(p) for c, p in zip(kept, plain, strict=True)], column(text_col).alias("text"))
    schema = rows.drop("text").schema
    for name, kind in zip(added, ("bigint", "bigint", "bigint", "boolean", "array<int>"), strict=True):
        from pyspark.sql.types import _parse_datatype_string

        schema = schema.add(name, _parse_datatype_string(kind))

    def run(batches):
        c = codec(path)
        is_byte = np.array([k == 6 for k in c.vocabulary.kinds])
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                texts = [t or "" for t in part.column(len(kept)).to_pylist()]
                ids = [c.encode(t) for t in texts]
                same = [c.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                flat, lists = _arrays(ids)
                ends = np.cumsum([0, *map(len, ids)])
                bytes_before = np.concatenate([[0], np.cumsum(is_byte[flat])])
                sums = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(len(kept))]
                    + [pa.array(np.diff(ends).astype(np.int64)), pa.array((bytes_before[ends[1:]] - bytes_before[ends[:-1]]).astype(np.int64)), pa.array(sums, type=pa.int64()), pa.array(same), lists],
                    names=[*plain, *added],
                )

    return rows.mapInArrow(run, schema).select(*[F.col(p).alias(c) for c, p in zip(kept, plain, strict=True)], *added)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` with a column ``text`` from its ``token_ids``; null ids give a null text."""
    path = model or model_path()

    @F.pandas_udf("string")
    def text_of(ids):
        c = codec(path)
        return ids.map(lambda x: None if x is None else c.decode(x))

    return encoded.withColumn("text", text_of("token_ids"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))

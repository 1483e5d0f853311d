"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score; DataFrame expressions alone.

Kinds: email, ip, card (Luhn), phone, and beyond these iban (mod 97), secret (a value assigned to the name of a credential), key
(a long run of letters and digits that stands alone) and account (a number of 8 to 17 digits). A pattern's matches are leftmost
and do not overlap within a kind; one that fails its check is dropped without another try. Positions are counted in code points: the text is split at the matches, and the
lengths of the pieces and matches add up to their places.

The patterns are written so that no text makes them slow: where a greedy run cannot be part of a match unless it begins at
the run's own start, a look-behind (or the end of the match before) says so, and runs are possessive, which changes no match.

Score: a kind's own weight, raised by a checksum that holds and by context words within ``REACH`` characters before the span, but
not before an earlier match of its kind. Spans of the first four kinds always stay; others stay if their score reaches ``cutoff``.
A key or an account number has no check and is below it by itself: context decides. Work is linear in the text, but for
the running sums of its matches, which are made in two levels.

Edge cases: a null text counts as empty. Rows with equal ids are separate. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.layout import spread
from riskweave.llm._common import running, table

REACH = 40
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|passwd|password)\b\x20{0,4}[:=]\x20{0,4}[\"']?[A-Za-z0-9+/_-]{16,}",
    "key": r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Za-z])[A-Za-z0-9_-]{24,}+",
    "account": r"(?<![A-Za-z0-9+.,-])[0-9]{8,17}(?![A-Za-z0-9]|[.,-][0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: Cheap conditions without which a kind cannot occur in a text.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "secret": None, "key": None, "account": None}
WEIGHT = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "secret": 0.6, "key": 0.35, "account": 0.35}
CHECKED = {"card": 0.3, "iban": 0.5}
CONTEXT = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": "card|visa|master|credit|kredit|carte|tarjeta",
    "phone": r"\btel|phone|call|mobil|fax|ruf|llam",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "secret": "key|secret|auth|login|credential",
    "key": "key|secret|token|auth|login|credential|passw",
    "account": "account|konto|compte|cuenta|kunde|client|customer|passport|ausweis",
}
CONTEXT_WEIGHT = 0.2
_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN's check digits hold: the first four characters moved to the end, letters as 10 to 35, remainder 1."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def value(acc: Column, ch: Column) -> Column:
        letter = F.ascii(ch) - 55
        return F.when(ch.between("0", "9"), (acc * 10 + F.ascii(ch) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(value(acc, ch))) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda part: F.ltrim(part, F.lit("0")).rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.char_length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.char_length(code).between(15, 34), mod97(code)).otherwise(False)
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of one kind, ascending."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # The text is gap, match, gap, match, ..., gap: a match begins after all before it and its own gap.
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), matches.alias("m"))
    starts = running(F.transform(pairs, lambda x: F.char_length(x["g"]) + F.char_length(x["m"])))

    def scored(x: Column) -> Column:
        begin = x["at"] + F.char_length(x["p"]["g"])
        near = F.lower(F.substring(x["p"]["g"], -REACH, REACH))
        context = F.when(near.rlike(CONTEXT[kind]), CONTEXT_WEIGHT).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + F.char_length(x["p"]["m"])).alias("end"), F.round(F.lit(WEIGHT[kind] + CHECKED.get(kind, 0.0)) + context, 3).alias("score"))

    found = F.transform(F.filter(F.arrays_zip(pairs.alias("p"), starts.alias("at")), lambda x: _valid(kind, x["p"]["m"])), scored)
    needs = NEEDS[kind]
    possible = F.contains(text, F.lit(needs)) if needs else text.rlike("[:=]") if kind == "secret" else text.rlike("[0-9]{8}") if kind == "account" else text.rlike("[0-9]")
    return F.when(possible, found).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """doc_id and ``found``: all spans by start, then kind in the order of PATTERNS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    by_kind = docs.select("doc_id", *[spans_of(text, k).alias(f"s_{k}") for k in PATTERNS])
    return by_kind.select("doc_id", *[f"s_{k}" for k in BASE], *[F.filter(f"s_{k}", lambda s: s["score"] >= cutoff).alias(f"s_{k}") for k in PATTERNS if k not in BASE])


def _ordered(*arrays: Column) -> Column:
    order = F.array(*[F.lit(k) for k in PATTERNS])
    return F.array_sort(F.transform(F.concat(*arrays), lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind"), s["score"].alias("score"))))


def _joined(*arrays: Column) -> Column:
    return F.array_join(F.transform(_ordered(*arrays), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, with ``scores`` (of ``spans``, in their order) and ``n_spans``."""
    found = find_pii(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base, every = [F.col(f"s_{k}") for k in BASE], [F.col(f"s_{k}") for k in PATTERNS]
    return found.select(
        "doc_id",
        *[F.size(f"s_{k}").cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(*base), 256).alias("base_sha256"),
        _joined(*every).alias("spans"),
        F.array_join(F.transform(_ordered(*every), lambda s: s["score"].cast("string")), ",").alias("scores"),
        F.size(F.concat(*every)).cast("bigint").alias("n_spans"),
    )

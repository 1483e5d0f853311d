"""Scalar predicates over file texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """Whether any literal occurs; each is a codegen'd substring test."""
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def near_lines(text: Column, left: Sequence[str], right: Sequence[str], reach: int) -> Column:
    """Whether a line with a needle of ``left`` is within ``reach`` lines of one with a needle of ``right``. The line numbers of
    both sides are found in one pass each and compared with their neighbours alone; nothing is exploded or joined."""
    lines = F.split(text, "\n", -1)

    def numbers(needles: Sequence[str]) -> Column:
        return F.filter(F.transform(lines, lambda line, i: F.when(contains_any(line, needles), i)), lambda i: i.isNotNull())

    # Both lists are sorted together: if any two of unlike sides are near, so are two that follow each other (a line of both sides is
    # next to itself).
    marked = lambda side, of: F.transform(of, lambda n: F.struct(n.alias("n"), F.lit(side).alias("s")))
    merged = F.sort_array(F.concat(marked(0, numbers(left)), marked(1, numbers(right))))
    near = F.transform(F.array(merged), lambda m: F.exists(F.transform(m, lambda x, k: F.struct(x.alias("x"), F.get(m, k - 1).alias("y"))), lambda p: (p["x"]["s"] != p["y"]["s"]) & (p["x"]["n"] - p["y"]["n"] <= reach)))
    return F.coalesce(near[0], F.lit(False))


def html_comments(text: Column) -> Column:
    """The insides of HTML comments; an unterminated one reaches to the end."""
    return F.regexp_extract_all(text, F.lit(r"(?s)<!--(.*?)(?:-->|\z)"), F.lit(1))


def blocks(text: Column) -> Column:
    """Paragraphs between blank lines."""
    return F.split(text, "\n\n")


def magic_label(content: Column) -> Column:
    """The kind of a binary file from its first four bytes (fixed signatures)."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(head == "7F454C46", "ELF")
        .when((F.length(head) == 8) & head.startswith("4D5A"), "PE")
        .when(head == "0061736D", "WebAssembly")
        .when((F.length(head) == 8) & (head.startswith("FEEDFA") | head.startswith("CFFAED")), "Mach-O")
        .when(head == "CAFEBABE", "Mach-O/Java")
        .otherwise("opaque")
    )


def display_path(path: Column, most: int = 96) -> Column:
    """A path for reports: slashes, no outer separators, and only its end if it is long (in bytes)."""
    plain = F.btrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/ ."))
    raw = plain.cast("binary")
    tail = F.concat(F.lit("..."), F.substring(raw, -(most - 3), most - 3).cast("string"))
    return F.when(plain == "", "skill files").when(F.octet_length(plain) > most, tail).otherwise(plain)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's bytes (UTF-8), as eight lower-case hex digits. For short texts: one step for each byte."""
    code = text.cast("binary")
    byte = lambda i: F.conv(F.hex(F.substring(code, i, F.lit(1))), 16, 10).cast("bigint")
    steps = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(steps, F.lit(0x811C9DC5).cast("bigint"), lambda h, i: (h.bitwiseXOR(byte(i)) * 0x01000193) % (1 << 32))
    return F.when(text.isNotNull(), F.lpad(F.lower(F.hex(last)), 8, "0"))


def assignment(line: Column) -> Column:
    """struct(target, value) of a ``name = value`` or ``name: value`` line with a credential-like name; nulls without one."""
    pattern = r"""(?i)\b(token|secret|password|api_key)\s*[:=]\s*["']([^"']{8,})["']"""
    target, value = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
    return F.struct(F.nullif(F.lower(target), F.lit("")).alias("target"), F.nullif(value, F.lit("")).alias("value"))

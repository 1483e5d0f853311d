"""Source of packages: directory trees of untrusted files, read as bytes and never followed, run or fetched.

``package_tree`` is a Python data source. The driver lists packages alone (a bounded number); each package is a partition of its
own and is walked, budgeted and read where it is processed, so no file list of the collection is ever in one place. The path must
be readable by every executor. Rows are files (``kind`` file) and one closing row a package (``kind`` status) with its counters.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from riskweave.functions.paths import FIRST_PARTS
from riskweave.operators.rules import SCOPES, normalized, path_scopes

# Limits, and what is skipped or read.
PACKAGES, ENTRIES, DEPTH, FILES, TOTAL_BYTES, FILE_BYTES = 4096, 100_000, 64, 4096, 64 << 20, 1 << 20
SKIP_BASE = {".git", ".svn", ".hg", "node_modules", "vendor", "dist", "build", "target", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache"}
SKIP_BROAD = {".git", ".svn", ".hg", "node_modules", "vendor", "target", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".cache"}
IGNORED = (".png", ".jpg", ".jpeg", ".gif", ".pdf", ".zip", ".tar", ".gz", ".7z", ".exe", ".dll", ".so", ".dylib", ".class", ".wasm")
OPAQUE = (".zip", ".tar", ".gz", ".7z", ".exe", ".dll", ".so", ".dylib", ".class", ".wasm")
NATIVE = (".exe", ".dll", ".so", ".dylib", ".bin", ".wasm", ".class")
READ = (
    ".py", ".pyw", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".psm1", ".bat", ".cmd", ".rb", ".php", ".java", ".kt", ".rs", ".c", ".cpp", ".h", ".cs", ".lua", ".pl", ".swift", ".scala", ".tf",
    ".yaml", ".yml", ".json", ".jsonl", ".toml", ".ini", ".cfg", ".conf", ".env", ".html", ".htm", ".xml", ".svg", ".md", ".mdx", ".mdc", ".prompt", ".prompty", ".txt", ".service", ".timer", ".plist", ".desktop", ".reg", ".pkl", ".pickle",
)
READ_NAMES = {"dockerfile", "makefile", "gemfile", "procfile", "jenkinsfile", "crontab", ".npmrc", ".yarnrc", ".pypirc", ".netrc", ".bashrc", ".zshrc", ".profile", ".cursorrules", ".gitmodules", ".env"}
SNIP = b"\n[...snip...]\n"
COUNTERS = ("entries_visited", "files_visited", "files_analyzed", "files_skipped", "read_errors", "sampled_files", "skipped_symlinks", "skipped_opaque", "skipped_unsupported")
SCHEMA = "skill_id string, kind string, rel string, content binary, size bigint, in_base boolean, in_broad boolean, sampled boolean, " + ", ".join(f"{c} bigint" for c in COUNTERS) + ", complete boolean, collection_complete boolean, content_complete boolean, truncated boolean, summary string, input_digest string"


def discover(root: str, mode: str = "auto") -> list[tuple[str, str]]:
    """(id, path) of packages, by id. ``single``: the root; ``collection``: its visible children; ``auto``: single if it holds a
    SKILL.md, else its children, else the root. A root that is a link or no directory is refused; linked children are listed."""
    base = Path(root)
    if base.is_symlink() or not base.is_dir():
        raise ValueError(f"not a plain directory: {root}")
    if mode == "single" or (mode == "auto" and (base / "SKILL.md").is_file()):
        return [(base.name, str(base))]
    found = sorted((e.name, e.path) for e in os.scandir(base) if not e.name.startswith(".") and (e.is_symlink() or e.is_dir(follow_symlinks=False)))
    if len(found) > PACKAGES:
        raise ValueError(f"more than {PACKAGES} packages")
    if not found and mode == "collection":
        raise ValueError(f"no packages in {root}")
    return found or [(base.name, str(base))]


def _priority(rel: str) -> int:
    """What configures or describes the package first, then code, then documents: the roles of ``functions/paths.py``."""
    path = normalized(rel)
    scopes = path_scopes(path)
    has = lambda *names: any(scopes >> SCOPES.index(n) & 1 for n in names)
    if has("manifest", "package", "config") or path.rsplit("/", 1)[-1] == "skill.md" or path.endswith(".tf") or any(p in path for p in FIRST_PARTS):
        return 0
    return 1 if has("code") else 2 if has("doc") else 3


def _read(path: str, size: int) -> bytes:
    with open(path, "rb") as f:
        if size <= FILE_BYTES:
            return f.read(FILE_BYTES)
        head = f.read(FILE_BYTES // 2)
        f.seek(size - FILE_BYTES // 2)
        return head + SNIP + f.read(FILE_BYTES // 2)


def read_package(skill_id: str, root: str) -> Iterator[tuple]:
    """The rows of one package. Files that configure or describe it take the budget first; whatever is left out makes it incomplete."""
    n, reasons, whole, content = dict.fromkeys(COUNTERS, 0), [], True, True
    chosen: list[tuple[int, str, str, int, bool, bool]] = []
    stack = [(root, "", 0)] if not os.path.islink(root) else []
    if not stack:
        n["skipped_symlinks"], whole = 1, False
        reasons.append("one or more links were not followed")
    truncated = False
    while stack:
        folder, prefix, depth = stack.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            n["read_errors"] += 1
            continue
        for e in entries:
            n["entries_visited"] += 1
            if n["entries_visited"] > ENTRIES:
                truncated, stack = True, []
                reasons.append("entry limit reached")
                break
            rel, low = prefix + e.name, (prefix + e.name).lower()
            if e.is_symlink():
                n["files_visited"] += 1
                n["files_skipped"] += 1
                n["skipped_symlinks"] += 1
                whole = False
            elif e.is_dir(follow_symlinks=False):
                if e.name.lower() in SKIP_BASE and e.name.lower() in SKIP_BROAD:
                    continue
                if depth >= DEPTH:
                    truncated = True
                    reasons.append("depth limit reached")
                else:
                    stack.append((e.path, rel + "/", depth + 1))
            else:
                n["files_visited"] += 1
                size = e.stat(follow_symlinks=False).st_size if e.is_file(follow_symlinks=False) else -1
                native = low.endswith(NATIVE)
                read = low.endswith(READ) or e.name.lower() in READ_NAMES or "manifest" in e.name.lower() or "install" in low or "update" in low or native
                if size < 0:
                    whole = False
                    n["files_skipped"] += 1
                elif size == 0:
                    n["files_skipped"] += 1
                elif (low.endswith(IGNORED) and not native) or not read:
                    n["files_skipped"] += 1
                    n["skipped_unsupported"] += 1
                    if low.endswith(OPAQUE):
                        n["skipped_opaque"] += 1
                        content = False
                else:
                    folders = low.split("/")[:-1]
                    chosen.append((_priority(rel), rel, e.path, size, not any(f in SKIP_BASE for f in folders), not any(f in SKIP_BROAD for f in folders)))
    chosen.sort()
    total, digest = 0, hashlib.sha256()
    for k, (_, rel, path, size, base, broad) in enumerate(chosen):
        if k >= FILES or total >= TOTAL_BYTES:
            n["files_skipped"] += len(chosen) - k
            truncated = True
            reasons.append("file or byte budget reached")
            break
        try:
            data = _read(path, size)
        except OSError:
            n["read_errors"] += 1
            n["files_skipped"] += 1
            continue
        sampled = size > FILE_BYTES
        n["sampled_files"] += sampled
        content &= not sampled
        if rel.lower().endswith(NATIVE):
            n["skipped_opaque"] += 1
            content = False
        n["files_analyzed"] += 1
        total += len(data)
        digest.update(f"{len(rel)}:{rel}:{size}:{hashlib.sha256(data).hexdigest()}".encode())
        yield (skill_id, "file", rel, data, size, base, broad, sampled, *[0] * len(COUNTERS), True, True, True, False, "", "")
    if n["files_analyzed"] == 0:
        whole = False
        reasons.append("no supported file was read")
    parts = [*dict.fromkeys(reasons)] + [f"{n[c]} {what}" for c, what in (("read_errors", "read errors"), ("skipped_symlinks", "links skipped"), ("skipped_opaque", "opaque files skipped"), ("sampled_files", "files sampled")) if n[c]]
    complete = whole and content and not truncated and not n["read_errors"]
    yield (skill_id, "status", None, None, total, True, True, False, *[n[c] for c in COUNTERS], complete, whole, content, truncated, ", ".join(parts), digest.hexdigest())


def guarded(skill_id: str, root: str) -> Iterator[tuple]:
    """``read_package``; if it fails for whatever reason the package ends as incomplete, and no other is touched."""
    try:
        yield from read_package(skill_id, root)
    except Exception as e:  # noqa: BLE001
        yield (skill_id, "status", None, None, 0, True, True, False, *[0] * len(COUNTERS), False, False, False, True, f"reading failed: {type(e).__name__}", "")


class _Package(InputPartition):
    def __init__(self, skill_id: str, path: str):
        self.skill_id, self.path = skill_id, path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mode = options["path"], options.get("mode", "auto")

    def partitions(self):
        return [_Package(*p) for p in discover(self.path, self.mode)]

    def read(self, partition):
        yield from guarded(partition.skill_id, partition.path)


class PackageTree(DataSource):
    @classmethod
    def name(cls):
        return "package_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def packages(spark: SparkSession, path: str, mode: str = "auto") -> DataFrame:
    spark.dataSource.register(PackageTree)
    return spark.read.format("package_tree").option("mode", mode).load(path)


def decoded(content: Column) -> Column:
    """The text of a file's bytes, case kept; null if they are no text. UTF-16 with or without a mark is recognised (by NULs in odd
    or even places of the first 4 KiB), else UTF-8 with invalid bytes replaced; more than 15 % control bytes there, or a NUL, means
    that it is no text."""
    head = F.hex(F.substring(content, 1, 4096))
    pairs = F.floor(F.octet_length(content).cast("int") / 2)
    pairs = F.least(pairs, F.lit(2048))
    quads = F.regexp_extract_all(head, F.lit("(....)"), F.lit(1))
    odd, even = F.size(F.filter(quads, lambda q: q.endswith("00"))), F.size(F.filter(quads, lambda q: q.startswith("00")))
    mark = F.substring(head, 1, 4)
    le = (mark == "FFFE") | ((pairs >= 8) & (odd > pairs / 3) & (even < pairs / 20))
    be = (mark == "FEFF") | ((pairs >= 8) & (even > pairs / 3) & (odd < pairs / 20))
    body = F.when(mark.isin("FFFE", "FEFF"), F.expr("substring(content, 3)")).otherwise(F.expr("content"))
    body = F.substring(body, F.lit(1), (F.floor(F.octet_length(body) / 2) * 2).cast("int"))
    units = F.regexp_extract_all(head, F.lit("(..)"), F.lit(1))
    control = F.size(F.filter(units, lambda b: (b < "20") & ~b.isin("09", "0A", "0C", "0D")))
    binary = head.rlike("^(..)*00") | (control > F.size(units) * 0.15)
    return F.when(le, F.decode(body, "UTF-16LE")).when(be, F.decode(body, "UTF-16BE")).when(~binary, F.make_valid_utf8(F.expr("cast(content as string)")))


def split_source(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files(skill_id, rel, text, in_base, in_broad, magic), status) of a ``packages`` table."""
    from riskweave.functions.text import magic_label

    files = rows.where("kind = 'file'").withColumn("text", decoded(F.col("content")))
    files = files.select("skill_id", "rel", "text", "in_base", "in_broad", F.when(F.col("text").isNull(), magic_label(F.col("content"))).alias("magic"))
    status = rows.where("kind = 'status'").select("skill_id", *COUNTERS, "complete", "collection_complete", "content_complete", "truncated", "summary", "input_digest")
    return files, status

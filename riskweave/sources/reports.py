"""Sinks: three JSON-lines reports with one row a package, sealed by a file that is written last; and the gate that checks them.

Rows are written by Spark, one folder a report, so no report passes through the driver; the seal holds a digest of each report that
does not depend on how its rows are split into files.
"""

from __future__ import annotations

import html
import json
import os
import re
import shutil
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.scoring import CATEGORIES

SCHEMA_VERSION = 2
REPORTS = ("results", "scan-metadata", "analysis-metadata")
SEAL = "scan-complete.json"
ZERO = ("sampled_files", "read_errors", "skipped_symlinks", "skipped_opaque", "unreviewed_external_instructions")
COVERAGE = ("collection_complete", "content_complete", "analysis_complete")
FLAGGED = 20


def digest(rows: DataFrame) -> str:
    """SHA-256 over counts and sums of the lines' own hashes: equal for equal multisets of lines, in one small aggregate."""
    h = F.sha2(F.col("value"), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"p{k}") for k in range(8)]
    return rows.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256).alias("d")).first()["d"]


def report_rows(reports: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """The three reports of ``analyze`` over a package source's status, as lines of JSON."""
    have = set(reports.columns)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)
    flag = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    coverage = F.struct(flag("collection_complete", True).alias("collection_complete"), flag("content_complete", True).alias("content_complete"), (~flag("flow_truncated", False)).alias("analysis_complete")).alias("coverage")
    head = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(run_id).alias("run_id"), F.col("skill_id"), coverage]
    counters = [number(c).alias(c) for c in ("entries_visited", "files_visited", "files_analyzed", "files_skipped", "skipped_unsupported", *ZERO)]
    scores = F.map_from_arrays(F.array(*[F.lit(c) for c in CATEGORIES]), F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in CATEGORIES]))
    tables = {
        "results": reports.select("skill_id", "verdict", F.col("category").alias("engine_category"), "evidence_text"),
        "scan-metadata": reports.select(*head, "complete", flag("truncated", False).alias("truncated"), F.nullif("summary", F.lit("")).alias("truncate_reason"), *counters, *([F.col("input_digest")] if "input_digest" in have else [])),
        "analysis-metadata": reports.select(*head, F.col("layer").alias("trigger_layer"), F.col("score").alias("trigger_score"), F.col("condition").alias("trigger_condition"), F.col("findings").alias("trigger_findings"), F.map_filter(scores, lambda _, v: v > 0).alias("category_scores")),
    }
    return {name: t.select(F.to_json(F.struct(*t.columns)).alias("value")) for name, t in tables.items()}


def _within(spark: SparkSession, output: str, most_bytes: int | None, most_visited: int | None) -> None:
    for name in REPORTS if most_bytes is not None else ():
        if (spark.read.text(f"{output}/{name}").agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0) > most_bytes:
            raise ValueError(f"the report is larger than allowed: {name}")
    if most_visited is not None:
        visited = spark.read.text(f"{output}/scan-metadata").agg(F.sum(F.get_json_object("value", "$.entries_visited").cast("bigint"))).first()[0]
        if (visited or 0) > most_visited:
            raise ValueError("more entries were visited than allowed")


def write_sealed(reports: DataFrame, output: str, most_bytes: int | None = None, most_visited: int | None = None) -> dict:
    """Write the reports and their seal under ``output``; an earlier seal goes first, so a broken run leaves none. Packages are analysed
    once: the analysis is written as a table, from which all three reports come, and which goes when they are there. A report of more
    than ``most_bytes``, or more than ``most_visited`` entries visited, is an error and is not sealed."""
    spark, seal_path = reports.sparkSession, Path(output) / SEAL
    if Path(output).is_symlink():
        raise ValueError(f"the output is a link: {output}")
    Path(output).mkdir(parents=True, exist_ok=True)
    seal_path.unlink(missing_ok=True)
    run_id = uuid.uuid4().hex
    work = f"{output}/_analysis-{run_id}"
    reports.write.parquet(work)
    for name, rows in report_rows(spark.read.parquet(work), run_id).items():
        rows.write.mode("overwrite").text(f"{output}/{name}")
    shutil.rmtree(work, ignore_errors=True)
    _within(spark, output, most_bytes, most_visited)
    written = {name: spark.read.text(f"{output}/{name}") for name in REPORTS}
    seal = {"schema_version": SCHEMA_VERSION, "run_id": run_id, "skill_count": written["results"].count(), "reports": {name: digest(rows) for name, rows in written.items()}}
    part = seal_path.with_suffix(".part")
    part.write_text(json.dumps(seal))
    os.replace(part, seal_path)
    return seal


class GateError(ValueError):
    """The reports are missing, changed, mixed or incomplete."""


def verified(spark: SparkSession, output: str) -> DataFrame:
    """The results of a sealed, complete run, or ``GateError``: digests, equal package sets, one run, full coverage, nothing
    sampled, skipped or left unreviewed."""
    try:
        seal = json.loads((Path(output) / SEAL).read_text())
    except (OSError, ValueError) as e:
        raise GateError("missing or unreadable seal") from e
    run_id = seal.get("run_id") if isinstance(seal, dict) else None
    if seal.get("schema_version") != SCHEMA_VERSION or not isinstance(run_id, str) or not re.fullmatch("[0-9a-f]{32}", run_id) or set(seal.get("reports") or ()) != set(REPORTS):
        raise GateError("malformed seal")
    try:
        lines = {name: spark.read.text(f"{output}/{name}") for name in REPORTS}
    except PySparkException as e:
        raise GateError("a report is missing") from e
    for name, rows in lines.items():
        try:
            found = digest(rows)
        except (PySparkException, Py4JJavaError) as e:  # the file system's own checksums notice changes too
            raise GateError(f"report changed or unreadable: {name}") from e
        if found != seal["reports"][name]:
            raise GateError(f"report changed: {name}")
    results = lines["results"].select(F.from_json("value", "skill_id string, verdict string, engine_category string, evidence_text string").alias("r")).select("r.*")
    n = results.agg(F.count("*").alias("n"), F.count_distinct("skill_id").alias("d"), F.count_if(~F.coalesce(F.col("verdict").isin("benign", "suspicious", "malicious"), F.lit(False))).alias("odd")).first()
    if n["n"] != seal["skill_count"] or n["d"] != n["n"] or n["odd"]:
        raise GateError("results do not match the seal")
    shape = "schema_version int, run_id string, skill_id string, complete boolean, truncated boolean, " + ", ".join(f"{c} bigint" for c in ZERO) + ", coverage struct<" + ", ".join(f"{c}: boolean" for c in COVERAGE) + ">"
    for name in REPORTS[1:]:
        rows = lines[name].select(F.from_json("value", shape).alias("r")).select("r.*")
        whole = F.col("run_id").eqNullSafe(run_id) & F.col("schema_version").eqNullSafe(SCHEMA_VERSION)
        for c in COVERAGE:
            whole = whole & F.col(f"coverage.{c}").eqNullSafe(True)
        if name == "scan-metadata":
            whole = whole & F.col("complete").eqNullSafe(True) & F.col("truncated").eqNullSafe(False)
            for c in ZERO:
                whole = whole & F.col(c).eqNullSafe(0)
        ids = rows.groupBy("skill_id").agg(F.count("*").alias("times"), F.bool_and(whole).alias("whole"))
        odd = results.select("skill_id", F.lit(1).alias("here")).join(ids, "skill_id", "full_outer").where("here IS NULL OR times IS NULL OR times <> 1 OR NOT whole")
        if odd.limit(1).count():
            raise GateError(f"incomplete, mixed or unmatched rows: {name}")
    return results


def gate_exit(results: DataFrame, policy: str = "malicious") -> int:
    """1 if the policy blocks, else 0; a ``GateError`` from ``verified`` means 2."""
    from riskweave.operators.evaluate import gate

    return int(gate(results, policy).first()["blocked"])


def summary(results: DataFrame) -> str:
    """Markdown: counts by verdict, and the first flagged packages by id (a report of at most ``FLAGGED`` rows)."""
    cell = lambda v: html.escape(" ".join((v or "").split())[:240]).replace("|", "&#124;").replace("`", "&#96;")
    counts = {r["verdict"]: r["count"] for r in results.groupBy("verdict").count().collect()}
    lines = ["| Verdict | Count |", "| --- | ---: |", *[f"| {v} | {counts.get(v, 0)} |" for v in ("malicious", "suspicious", "benign")]]
    flagged = results.where("verdict <> 'benign'").orderBy("skill_id").limit(FLAGGED).collect()
    if flagged:
        lines += ["", "| Package | Verdict | Category | Evidence |", "| --- | --- | --- | --- |", *[f"| {cell(r['skill_id'])} | {r['verdict']} | {cell(r['engine_category'])} | {cell(r['evidence_text'])} |" for r in flagged]]
    return "\n".join(lines) + "\n"

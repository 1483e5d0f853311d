"""The command line: ``python -m riskweave.cli INPUT OUTPUT``.

Exit codes: 0 for a complete scan, whatever it found; 2 for wrong usage, input, output or a missed deadline; 3 if a package was not
read in full (``--allow-partial`` makes that 0).
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import threading

COMPLETE, FAILED, PARTIAL = 0, 2, 3
LONGEST = 24 * 3600.0
#: What a run may visit, and the size of one report. Options raise them for large collections.
MOST_VISITED, REPORT_MIB = 1_000_000, 32
#: Set to 1, true or yes, this variable allows partial scans as --allow-partial does.
PARTIAL_VARIABLE = "RISKWEAVE_ALLOW_PARTIAL"
_UNITS = {"s": 1, "m": 60, "h": 3600}


def seconds(text: str) -> float:
    """90, 90s, 5m or 2h."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([smh]?)", text)
    value = float(m[1]) * _UNITS[m[2] or "s"] if m else 0
    if not 0 < value <= LONGEST:
        raise argparse.ArgumentTypeError("a time above 0 and up to 24h")
    return value


def overlap(a: str, b: str) -> bool:
    """Whether one folder is the other or lies in it."""
    x, y = os.path.realpath(a), os.path.realpath(b)
    return os.path.commonpath([x, y]) in (x, y)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="riskweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("input")
    out.add_argument("output")
    mode = out.add_mutually_exclusive_group()
    mode.add_argument("--mode", choices=("auto", "single", "collection"), default="auto")
    mode.add_argument("--single", dest="mode", action="store_const", const="single")
    mode.add_argument("--collection", dest="mode", action="store_const", const="collection")
    out.add_argument("--timeout", type=seconds, default=300.0, help="for the whole run, such as 90s, 5m or 2h")
    out.add_argument("--allow-partial", action="store_true", default=os.environ.get(PARTIAL_VARIABLE, "").lower() in ("1", "true", "yes"))
    out.add_argument("--max-visited", type=int, default=MOST_VISITED)
    out.add_argument("--max-report-mib", type=int, default=REPORT_MIB)
    return out


def scan(spark, options: argparse.Namespace) -> int:
    from riskweave.plans.analyze import analyze
    from riskweave.sources.packages import discover, packages, split_source
    from riskweave.sources.reports import write_sealed

    if overlap(options.input, options.output):
        raise ValueError("input and output overlap")
    discover(options.input, options.mode)
    files, status = split_source(packages(spark, options.input, options.mode))
    write_sealed(analyze(files, status), options.output, options.max_report_mib << 20, options.max_visited)
    whole = spark.read.text(f"{options.output}/scan-metadata").where("get_json_object(value, '$.complete') = 'false'").isEmpty()
    return COMPLETE if whole or options.allow_partial else PARTIAL


def main(args: list[str] | None = None, spark=None) -> int:
    try:
        options = parser().parse_args(args)
    except SystemExit as e:
        return COMPLETE if not e.code else FAILED
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("riskweave").getOrCreate()
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelAllJobs()

    timer = threading.Timer(options.timeout, stop)
    timer.daemon = True
    timer.start()
    try:
        code = scan(spark, options)
        return FAILED if late.is_set() else code
    except Exception as e:  # noqa: BLE001: one line, not a trace
        print("the deadline passed" if late.is_set() else f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return FAILED
    finally:
        timer.cancel()


if __name__ == "__main__":
    sys.exit(main())

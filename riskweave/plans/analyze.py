"""Packages to verdicts as one linear plan.

One pass over the texts, in Arrow batches where they lie, turns each file into a few compact events: rules that hold, flags for rules
over packages, flows, paths written and used, names told to run, addresses whose content is to be carried out. Equal events of a
package are counted before and after a shuffle that carries no text, so a package ends as one row with a bounded array (rules
and their variants, not files), and profiles, scores, verdict and evidence are worked out on that row. A file whose analysis fails
makes its package incomplete, and no other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.lexicon import any_of
from riskweave.functions.markdown import risky
from riskweave.operators import flow, scoring
from riskweave.operators.external import PER_DOCUMENT, PER_PACKAGE, addresses
from riskweave.operators.rules import BUNDLED, FILE_RULES, NATIVE, PACKAGE_RULES, PERIMETER, Rule, RuleBook, batch_of, flag_arrays, given, normalized, package_hits, weighed, with_scopes

_EVENT = "kind string, name string, rule_id string, category string, weight double, strong boolean, lasting boolean, profile string, is_doc boolean, mock boolean, risky boolean, verified boolean, safe boolean, reason string"
_FIELDS = [f.split()[0] for f in _EVENT.split(", ")]
_KEY = [*_FIELDS, "weak_path"]
_ROW = "skill_id string, file string, line bigint, " + _EVENT
_NATIVE = re.compile(NATIVE)
FLOW_REASON = "verified-flow: tainted data reaches a sink"


def _of_rule(r: Rule) -> dict[str, Column]:
    return {"rule_id": F.lit(r.rule_id), "category": F.lit(r.category), "weight": F.lit(r.weight), "strong": F.lit(r.strong), "lasting": F.lit(r.lasting), "profile": F.lit(r.profile), "is_doc": F.lit(False), "mock": F.lit(False), "risky": F.lit(False), "verified": F.lit(False), "safe": F.lit(False), "reason": F.lit("bundled native executable")}


def _file_events(book: RuleBook, rel: str, text: str, base: int, broad: int):
    """(line, event fields) of one file."""
    low, seen = text.lower(), base | broad
    profile = "both" if base and broad else "base" if base else "broad"
    nothing, path = (None,) * 12, normalized(rel)
    if _NATIVE.search(path):
        name = path.rsplit("/", 1)[-1]
        yield 0, ("native", name, *nothing)
        yield 0, ("hit", None, PERIMETER.rule_id, PERIMETER.category, PERIMETER.weight, PERIMETER.strong, PERIMETER.lasting, profile, False, False, False, False, False, "bundled native executable")
    doc = bool(seen & book.scope["doc"])
    safe = False
    code = seen & (book.scope["code"] | book.scope["package"] | book.scope["config"]) and (not doc or seen & book.scope["package"])
    if code and low:
        rows, cut = flow.fold_file(path, low)
        safe = any(r["kind"] == "safe" for r in rows)
        for r in rows:
            if r["kind"] == "finding":
                yield r["line"], ("hit", None, r["rule_id"], r["category"], r["weight"], True, True, profile, False, False, False, True, False, r["reason"])
            else:
                yield r["line"], (r["kind"], f"{r['rule_id']}:{r['path']}" if r["kind"] == "use" else r["path"] or None, *nothing)
        if cut:
            yield 0, ("cut", None, *nothing)
    whole, view = book.view(low, doc)
    if not (seen & book.scope["skill"] and book.teaching(whole)):
        mock, dangerous = bool(whole.mask & book.mock), risky(view.mask, book.scanner.bit)
        for r, p in book.hits(whole, view, base, broad):
            weight, strong = weighed(r, doc)
            yield 0, ("hit", None, r.rule_id, r.category, weight, strong, r.lasting, p, doc, mock, dangerous, False, safe, book.reasons[id(r)])
        for name, p in book.raised(view, base, broad):
            yield 0, ("flag", name, None, None, None, None, None, p, *(None,) * 6)
    if doc:
        for name in book.run_names(whole, view):
            yield 0, ("run", name, *nothing)
        if "http" in low:
            found = addresses(text)[:PER_DOCUMENT]
            told = sum(d for _, _, d in found)
            if found:
                yield 0, ("urls", None, None, None, float(len(found)), *(None,) * 9)
            if told:
                yield 0, ("told", None, None, None, float(told), *(None,) * 9)
            if len(found) >= PER_DOCUMENT:
                yield 0, ("full", None, *nothing)


def file_events(files: DataFrame) -> DataFrame:
    """(skill_id, file, line, event fields) of ``files(skill_id, rel, text)``."""
    def run(batches):
        book = RuleBook(FILE_RULES, PACKAGE_RULES)
        for batch in batches:
            out = []
            for skill_id, rel, *of_file in with_scopes(batch):
                try:
                    events = [(skill_id, rel, line, *e) for line, e in _file_events(book, rel, *of_file)]
                except Exception:  # noqa: BLE001: whatever one hostile file brings about, the others are judged
                    events = [(skill_id, rel, 0, "failed", *(None,) * 13)]
                out += events
            yield batch_of(out, _ROW)

    return given(files).mapInArrow(run, _ROW)


def _bridges(events: Column) -> Column:
    """Hits for artifacts that one statement of the package writes and another runs, loads or deserializes."""
    written = F.transform(F.filter(events, lambda e: e["kind"] == "write"), lambda e: e["name"])
    used = F.filter(events, lambda e: (e["kind"] == "use") & F.array_contains(written, F.substring(e["name"], F.instr(e["name"], ":") + 1, F.lit(1 << 20))))

    def hit(e: Column) -> Column:
        how = F.substring_index(e["name"], ":", 1)
        category = F.coalesce(*[F.when(how == k, v[0]) for k, v in flow.BRIDGE_WEIGHTS.items()])
        weight = F.coalesce(*[F.when(how == k, v[1]) for k, v in flow.BRIDGE_WEIGHTS.items()])
        yes, no = F.lit(True), F.lit(False)
        return F.struct(
            *[x.cast(t).alias(f) for (f, t), x in zip((f.split() for f in _EVENT.split(", ")), (F.lit("hit"), F.lit(None), F.lit("R0006"), category, weight, yes, yes, F.lit("both"), no, no, no, yes, no, F.lit(FLOW_REASON)))],
            no.alias("weak_path"), e["n"].alias("n"), e["file"].alias("file"), e["line"].alias("line"),
        )

    return F.transform(used, hit)


def _made(r: Column | Rule, file: Column) -> Column:
    values = _of_rule(r) if isinstance(r, Rule) else {f: r[f] for f in ("rule_id", "category", "weight", "strong", "lasting", "profile", "reason")} | {f: F.lit(False) for f in ("is_doc", "mock", "risky", "verified", "safe")}
    types = dict(f.split() for f in _EVENT.split(", "))
    return F.struct(*[(F.lit("hit") if f == "kind" else values.get(f, F.lit(None))).cast(types[f]).alias(f) for f in _FIELDS], F.lit(False).alias("weak_path"), F.lit(1).cast("bigint").alias("n"), file.alias("file"), F.lit(0).cast("bigint").alias("line"))


def package_events(files: DataFrame) -> DataFrame:
    """skill_id, hits, only_expected_auth, only_safe_loads, flow_truncated, failed, told, full: one row a package that shows anything.
    Equal events are counted, with the first file and line of each kind."""
    found = file_events(files).withColumn("weak_path", F.coalesce(any_of(F.lower("file"), scoring.TEST_PATHS), F.lit(False)) & (F.col("kind") == "hit"))
    counted = found.groupBy("skill_id", *_KEY).agg(F.count("*").alias("n"), F.min(F.struct("file", "line")).alias("at"))
    flag = F.col("kind") == "flag"
    packed = counted.groupBy("skill_id").agg(
        F.sort_array(F.collect_list(F.when(~flag, F.struct(*_KEY, "n", F.col("at.file").alias("file"), F.col("at.line").alias("line"))))).alias("events"),
        *[c.alias(n) for n, c in flag_arrays(F.when(flag, F.col("name")), F.col("profile")).items()],
    )
    events = F.col("events")
    names = lambda kind: F.transform(F.filter(events, lambda e: e["kind"] == kind), lambda e: e["name"])
    packed = packed.withColumn("runs", names("run"))
    bundled = F.filter(events, lambda e: (e["kind"] == "native") & (F.array_contains(F.col("runs"), e["name"]) | ((F.length(F.substring_index(e["name"], ".", 1)) >= 5) & F.array_contains(F.col("runs"), F.substring_index(e["name"], ".", 1)))))
    hits = F.concat(
        F.filter(events, lambda e: e["kind"] == "hit"),
        _bridges(events),
        F.transform(package_hits(), lambda h: _made(h, F.lit("multi-file"))),
        F.transform(bundled, lambda e: _made(BUNDLED, e["file"])),
    )
    has = lambda kind: F.exists(events, lambda e: e["kind"] == kind)
    flows = F.exists(events, lambda e: F.coalesce(e["verified"], F.lit(False)))
    loads = F.exists(events, lambda e: F.coalesce(e["verified"] & (e["category"] == "ast05"), F.lit(False)))
    total = lambda kind: F.aggregate(F.filter(events, lambda e: e["kind"] == kind), F.lit(0.0), lambda acc, e: acc + e["weight"] * e["n"])
    return packed.select(
        "skill_id", hits.alias("hits"), (has("auth") & ~flows & ~has("write")).alias("only_expected_auth"), (has("safe") & ~has("unsafe") & ~loads & ~has("cut")).alias("only_safe_loads"),
        has("cut").alias("flow_truncated"), has("failed").alias("failed"), total("told").cast("bigint").alias("told"), (has("full") | (total("urls") >= PER_PACKAGE)).alias("full"),
    )


#: What scoring needs of a package beside its hits, and what reports take over.
_OF_PACKAGE = ("only_expected_auth", "only_safe_loads", "flow_truncated")


def scored(packages: DataFrame) -> DataFrame:
    """One row a package of ``package_events`` that has findings: verdict of the profile that counts, and its hits."""
    rows = packages.select("skill_id", *_OF_PACKAGE, F.explode("hits").alias("h")).select("skill_id", *_OF_PACKAGE, "h.*")
    judged = scoring.merged_profiles(scoring.verdicts(scoring.category_scores(scoring.dampened(rows))))
    return judged.join(packages.select("skill_id", "hits", "flow_truncated"), "skill_id")


def complete_status(files: DataFrame) -> DataFrame:
    """The status of packages that are given as a table of texts: complete, unless a text is missing."""
    return files.groupBy("skill_id").agg(F.bool_and(F.col("text").isNotNull()).alias("complete")).withColumn("summary", F.when(F.col("complete"), "").otherwise("a file has no text"))


def read_status(status: DataFrame, packages: DataFrame) -> DataFrame:
    """``status``, incomplete where a document tells a reader to carry out the content of an address or has as many addresses as
    the inventory takes, where a file has more or longer statements than the flow analysis reads, and where a file's analysis failed."""
    told = packages.select("skill_id", F.col("told").alias("unreviewed_external_instructions"), "full", F.col("flow_truncated").alias("cut"), "failed")
    joined = status.join(told, "skill_id", "left").withColumns({"unreviewed_external_instructions": F.coalesce("unreviewed_external_instructions", F.lit(0).cast("bigint")), **{c: F.coalesce(c, F.lit(False)) for c in ("full", "cut", "failed")}})
    reasons = (
        (F.col("unreviewed_external_instructions") > 0, "external instructions were not reviewed"), (F.col("full"), "external address inventory limit reached"),
        (F.col("cut"), "behavior analysis statement count or length limit reached"), (F.col("failed"), "analysis of a file failed"),
    )
    complete = F.col("complete")
    for holds, _ in reasons:
        complete = complete & ~holds
    summary = F.concat_ws(", ", F.nullif("summary", F.lit("")), *[F.when(holds, F.lit(what)) for holds, what in reasons])
    return joined.withColumns({"complete": complete, "summary": summary}).drop("full", "cut", "failed")


def analyze(files: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """One report row for each package of ``status`` (by default each of ``files``): verdict, category, score, layer, condition,
    scores, findings and evidence_text. A null text has no findings and makes its package incomplete; so do texts of which only the
    first statements or addresses are read."""
    packages = package_events(files)
    reports = scoring.enforce_completeness(scored(packages), read_status(complete_status(files) if status is None else status, packages))
    findings = F.coalesce(scoring.audited(F.col("hits"), F.col("category"), F.col("score")), F.array())
    return scoring.with_evidence(reports.withColumn("findings", findings).drop("hits", "lead", "any_strong"))

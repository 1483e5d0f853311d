"""From findings to verdicts: dampened weights, category scores, root-cause calibration, thresholds, the cap on documents, the
choice between the two profiles, completeness, and evidence.

Findings are grouped by package and profile with map-side sums, so a package with very many findings is never one task's list;
from there on a package is one row with a score for each of the ten categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.lexicon import any_of
from riskweave.functions.text import display_path, fnv1a

# Categories, which of equal scores leads, weights and limits.
CATEGORIES = tuple(f"ast{k:02d}" for k in range(1, 11))
LEADING = ("ast01", "ast02", "ast05", "ast06", "ast07", "ast10", "ast04", "ast03", "ast08", "ast09")
TEST_PATHS = ("readme", "docs/", "examples/", "sample", "fixture", "test")
MOCK_MARKS = ("mock", "unit test", "test fixture", "synthetic", "example only", "demo only")
PATH_FACTOR, DOC_FACTOR, MOCK_FACTOR = 0.65, 0.75, 0.75
AUTH_FACTOR, AUTH_CLAIM_FACTOR = 0.04, 0.08
AUTH_RULES = ("R0075", "R0077", "R0037", "R0111", "R0123", "R0133", "R0142", "R0150", "R0147", "R0104")
AUTH_CLAIM_RULES = ("R0119", "R0120")
SAFE_LOAD_FACTOR, SAFE_LOAD_RULES, SAFE_LOAD_PACKAGE_RULES = 0.04, ("R0058", "R0089", "R0090"), ("R0127", "R0135")
FALLBACK_RULE = "R0138"
BLEND, BLEND_CAP = 0.18, 4.0
MALICIOUS, MALICIOUS_STRONG, MALICIOUS_BLENDED, STRONG_FINDINGS = 4.65, 3.25, 5.35, 2
SUSPICIOUS, SUSPICIOUS_BLENDED = 1.75, 2.35
MODIFIER, MODIFIER_LEAST = "ast09", 1.8
INCOMPLETE_CATEGORY, INCOMPLETE_SCORE = "ast08", 2.5
VERIFIED_LEAST, VERIFIED_ORDER = 5.5, ("ast02", "ast05", "ast06", "ast07", "ast01")
CAPPED_WITHOUT_STRONG = ("ast10", "ast04", "ast06", "ast08")
CAPPED_IN_DOCS, CAPPED_IN_DOCS_UNLESS_RISKY = ("ast04", "ast06"), ("ast10", "ast08", "ast01")
PROMOTION = {"ast01": 5.0, "ast02": 5.0, "ast05": 5.0, "ast06": 5.0, "ast07": 5.0, "ast04": 6.2, "ast08": 6.0, "ast10": 7.5}
LABELS = {
    "ast01": "malicious skill behavior", "ast02": "supply-chain compromise", "ast03": "excessive authorization", "ast04": "insecure metadata", "ast05": "unsafe deserialization", "ast06": "weak isolation", "ast07": "update drift",
    "ast08": "insufficient scanning or evasion", "ast09": "governance weakness", "ast10": "cross-platform reuse",
}
EVIDENCE_BYTES, AUDITED = 420, 8

# Root causes, first match first: (category, least score, others that must be lower than, ast01 at most this above it).
_BEFORE_04 = {"ast02": 6.0, "ast05": 5.2, "ast06": 5.0}
LADDER = {
    "base": (
        ("ast02", 6.0, {}, 6.5), ("ast05", 5.2, {}, 3.5), ("ast06", 5.0, {}, 3.5), ("ast07", 5.5, {"ast02": 6.0}, 3.5), ("ast04", 8.0, _BEFORE_04, 3.0), ("ast04", 5.2, _BEFORE_04, 1.5), ("ast10", 4.5, {}, 4.0),
    ),
    "broad": (
        ("ast04", 8.0, _BEFORE_04, 8.0), ("ast01", 8.5, {**_BEFORE_04, "ast07": 5.5}, None), ("ast02", 6.0, {}, 6.5), ("ast05", 5.2, {}, 3.5), ("ast06", 5.0, {}, 3.5), ("ast07", 5.5, {"ast02": 6.0}, 3.5),
        ("ast04", 8.0, _BEFORE_04, 3.0), ("ast04", 5.2, _BEFORE_04, 1.5), ("ast10", 4.8, {"ast01": 5.0, "ast02": 5.0, "ast07": 5.0}, None),
    ),
}
DRIFT_WITH_SUPPLY = 4.0


def _factor(condition: Column, value: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(1.0)


def dampened(findings: DataFrame) -> DataFrame:
    """``findings(rule_id, category, weight, strong, file, is_doc, mock, only_expected_auth, flow_truncated)`` with ``score`` and
    ``counts`` (strong after the flow factor): weak findings in documents, test paths and mocks count less, and credential
    findings hardly count where credentials only go to their own services. So do findings of unsafe loading (with columns ``safe`` and
    ``only_safe_loads``) in files, or packages, that load with safe loaders alone."""
    auth = F.coalesce("only_expected_auth", F.lit(False)) & ~F.coalesce("flow_truncated", F.lit(False))
    flow = F.when(auth & F.col("rule_id").isin(*AUTH_RULES), AUTH_FACTOR).when(auth & F.col("rule_id").isin(*AUTH_CLAIM_RULES), AUTH_CLAIM_FACTOR).otherwise(1.0)
    have = set(findings.columns)
    if "safe" in have:
        alone = F.coalesce("only_safe_loads", F.lit(False)) if "only_safe_loads" in have else F.lit(False)
        safe = (F.coalesce("safe", F.lit(False)) & F.col("rule_id").isin(*SAFE_LOAD_RULES)) | (alone & F.col("rule_id").isin(*SAFE_LOAD_PACKAGE_RULES))
        flow = F.when(safe & ~F.coalesce("flow_truncated", F.lit(False)), SAFE_LOAD_FACTOR).otherwise(flow)
    weak = _factor(any_of(F.lower("file"), TEST_PATHS), PATH_FACTOR) * _factor(F.col("is_doc"), DOC_FACTOR) * _factor(F.col("mock"), MOCK_FACTOR)
    score = F.when(F.col("strong"), F.col("weight")).otherwise(F.col("weight") * weak)
    return findings.withColumn("score", score * flow).withColumn("counts", F.col("strong") & (flow >= 0.5))


def category_scores(findings: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per package and profile: for each category a score, the number of strong findings that count, and whether strong
    findings exist, last, lie outside documents, or lie in risky documents; and the best verified flow. A row stands for ``n``
    findings where there is such a column; ``carry``: columns that are the same in all rows of a package."""
    # SQL text: a hundred columns are one call each, where a Column object for every operator is slow to build.
    n = "n" if "n" in findings.columns else "1"
    columns = [f"first({c}) AS {c}" for c in carry]
    for c in CATEGORIES:
        mine = f"category = '{c}'"
        strong = f"({mine} AND strong)"
        columns += [
            f"round(coalesce(sum(IF({mine}, score * {n}, NULL)), 0D), 9) AS {c}",
            f"CAST(coalesce(sum(IF({mine} AND counts, {n}, NULL)), 0) AS bigint) AS strong_{c}",
            f"coalesce(bool_or({strong}), false) AS any_{c}",
            f"coalesce(bool_or({strong} AND lasting), false) AS lasting_{c}",
            f"coalesce(bool_or({strong} AND NOT is_doc), false) AS outside_{c}",
            f"coalesce(bool_or({strong} AND risky), false) AS risky_{c}",
            f"coalesce(max(IF({mine} AND verified, weight, NULL)), 0D) AS flow_{c}",
        ]
    both = findings.withColumn("profile", F.explode(F.when(F.col("profile") == "both", F.array(F.lit("base"), F.lit("broad"))).otherwise(F.array("profile"))))
    return both.groupBy("skill_id", "profile").agg(*map(F.expr, columns))


def _leading(exclude: str | None = None) -> str:
    """SQL for struct(score, rank, category) of the largest score; of equal ones the first in LEADING."""
    return "array_max(array(" + ", ".join(f"named_struct('score', {c}, 'rank', {-k}, 'category', '{c}')" for k, c in enumerate(LEADING) if c != exclude) + "))"


def _of(prefix: str, category: str) -> str:
    return f"CASE {category} " + " ".join(f"WHEN '{c}' THEN {prefix}{c}" for c in CATEGORIES) + " END"


def _in(category: str, names: tuple[str, ...]) -> str:
    return f"{category} IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def _rung(category: str, least: float, below: dict[str, float], above: float | None) -> str:
    out = f"{category} >= {least}D" + "".join(f" AND {c} < {limit}D" for c, limit in below.items())
    if above is not None:
        near = f"ast01 <= {category} + {above}D"
        out += f" AND (ast07 >= {DRIFT_WITH_SUPPLY}D OR {near})" if category == "ast02" else f" AND {near}"
    return out


def calibrated() -> str:
    """SQL for the category of a score row: a verified flow's, else the first rung of its profile's ladder, else the leading one."""
    flows = ", ".join(f"IF({c} >= {VERIFIED_LEAST}D AND flow_{c} > 0, named_struct('w', flow_{c}, 'k', {-k}, 'c', '{c}'), NULL)" for k, c in enumerate(VERIFIED_ORDER))
    ladders = " ".join(f"WHEN profile = '{profile}' AND {_rung(*r)} THEN '{r[0]}'" for profile, rungs in LADDER.items() for r in rungs)
    return f"coalesce(array_max(array_compact(array({flows}))).c, CASE {ladders} END, top.category)"


def capped(verdict: str, category: str) -> str:
    """SQL: malicious becomes suspicious where all strong findings of the category are in documents and none lasts."""
    none = f"NOT ({_of('any_', category)})"
    docs_only = f"({_of('any_', category)}) AND NOT ({_of('lasting_', category)}) AND NOT ({_of('outside_', category)})"
    cap = f"({none} AND {_in(category, CAPPED_WITHOUT_STRONG)}) OR ({docs_only} AND ({_in(category, CAPPED_IN_DOCS)} OR ({_in(category, CAPPED_IN_DOCS_UNLESS_RISKY)} AND NOT ({_of('risky_', category)}))))"
    return f"IF({verdict} = 'malicious' AND ({cap}), 'suspicious', {verdict})"


def verdicts(scores: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """skill_id, profile, verdict, category, lead (the category before a benign verdict clears it), score, blended, strong,
    condition and the ten scores of each row of ``category_scores``."""
    first = scores.selectExpr("*", f"{_leading()} AS top", f"{_leading(MODIFIER)} AS other").selectExpr("*", f"{calibrated()} AS lead0")
    others = " + ".join(f"IF(lead0 = '{c}', 0D, least({c}, {BLEND_CAP}D) * {BLEND}D)" for c in CATEGORIES)
    # The blend is taken before a governance finding gives way to a stronger neighbour, and is not taken again.
    lead = f"IF(lead0 = '{MODIFIER}' AND other.score >= {MODIFIER_LEAST}D, other.category, lead0)"
    chosen = first.selectExpr("*", f"round({_of('', 'lead0')} + {others}, 6) AS blended", f"{lead} AS lead")
    chosen = chosen.selectExpr("*", f"round({_of('', 'lead')}, 6) AS score", f"{_of('strong_', 'lead')} AS strong", " + ".join(f"strong_{c}" for c in CATEGORIES) + " AS strong_all")
    conditions = (
        ("malicious", f"score >= {MALICIOUS}D", "max_score_gte_4.65"),
        ("malicious", f"score >= {MALICIOUS_STRONG}D AND strong >= 1", "category_score_gte_3.25_with_strong"),
        ("malicious", f"blended >= {MALICIOUS_BLENDED}D", "blended_score_gte_5.35"),
        ("malicious", f"strong_all >= {STRONG_FINDINGS}", "multiple_strong_findings"),
        ("suspicious", f"score >= {SUSPICIOUS}D", "max_score_gte_1.75"),
        ("suspicious", f"blended >= {SUSPICIOUS_BLENDED}D", "blended_score_gte_2.35"),
    )
    raw = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for v, c, _ in conditions) + " ELSE 'benign' END"
    judged = chosen.selectExpr("*", f"{raw} AS raw").selectExpr("*", f"{capped('raw', 'lead')} AS verdict")
    named = "CASE " + " ".join(f"WHEN verdict = '{v}' AND {c} THEN '{n}'" for v, c, n in conditions) + " ELSE 'below_risk_thresholds' END"
    return judged.selectExpr(
        "skill_id", "profile", "verdict", "IF(verdict = 'benign', 'benign', lead) AS category", "lead", "score", "blended", "CAST(strong AS bigint) AS strong", f"{named} AS condition", *CATEGORIES, f"{_of('any_', 'lead')} AS any_strong", *carry
    )


def merged_profiles(judged: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a package: the base profile's verdict, or the broad one's where base is benign and broad is certain enough."""
    fields = F.struct(*[c for c in judged.columns if c not in ("skill_id", "profile", *carry)])
    pair = judged.groupBy("skill_id").agg(*[F.first(c).alias(c) for c in carry], F.max(F.when(F.col("profile") == "base", fields)).alias("a"), F.max(F.when(F.col("profile") == "broad", fields)).alias("b"))
    sure = F.coalesce(*[F.when(F.col("b.category") == c, F.col("b.score") >= least) for c, least in PROMOTION.items()], F.lit(False))
    up = (F.coalesce("a.verdict", F.lit("benign")) == "benign") & (F.coalesce("b.verdict", F.lit("benign")) != "benign") & F.coalesce("b.any_strong", F.lit(False)) & sure
    return pair.withColumn("layer", F.when(up, "explain-promotion").otherwise("base")).withColumn("r", F.when(up, F.col("b")).otherwise(F.col("a"))).select("skill_id", *carry, "layer", "r.*")


def enforce_completeness(reports: DataFrame, status: DataFrame) -> DataFrame:
    """``reports`` of all packages of ``status(skill_id, complete, summary)``; a package without findings is benign, and none that
    was not read in full stays benign: it is suspicious. Other columns of ``status``, such as a source's counters, stay."""
    own = set(reports.columns) - {"skill_id"}
    joined = status.select([c for c in status.columns if c not in own]).join(reports, "skill_id", "left")
    filled = joined.withColumns({"verdict": F.coalesce("verdict", F.lit("benign")), "category": F.coalesce("category", F.lit("benign")), "score": F.coalesce("score", F.lit(0.0)), "layer": F.coalesce("layer", F.lit("base")), "condition": F.coalesce("condition", F.lit("below_risk_thresholds"))})
    hit = ~F.col("complete") & (F.col("verdict") == "benign")
    scores = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in CATEGORIES}
    scores[INCOMPLETE_CATEGORY] = F.when(hit, F.greatest(scores[INCOMPLETE_CATEGORY], F.lit(INCOMPLETE_SCORE))).otherwise(scores[INCOMPLETE_CATEGORY])
    return filled.withColumns({
        **scores,
        "verdict": F.when(hit, "suspicious").otherwise(F.col("verdict")), "category": F.when(hit, INCOMPLETE_CATEGORY).otherwise(F.col("category")), "score": F.when(hit, INCOMPLETE_SCORE).otherwise(F.col("score")),
        "layer": F.when(hit, "completeness").otherwise(F.col("layer")), "condition": F.when(hit, "incomplete_scan").otherwise(F.col("condition")),
    })


def fingerprint(rule: Column, category: Column, file: Column, line: Column, reason: Column) -> Column:
    basis = F.concat_ws("\0", rule, category, file, F.concat(line, F.lit(":"), line), F.when(line == 0, reason))
    return F.concat(F.lit("sha256:"), F.sha2(basis, 256))


def earlier_id(category: Column, reason: Column) -> Column:
    """A finding's number under the older scheme: its category, and a short hash of category and reason."""
    return F.concat(F.upper(category), F.lit("-"), fnv1a(F.lower(F.concat(category, F.lit("|"), reason))))


def audited(hits: Column, category: Column, score: Column, most: int = AUDITED) -> Column:
    """The strongest of a package's findings in its category, at most ``most``, with fingerprints; where no finding has the category,
    one that says so."""
    none = F.lit("the category's score comes from other findings")
    made = F.array(F.struct(
        F.lit(FALLBACK_RULE).alias("rule_id"), category.alias("category"), score.alias("weight"), F.lit(False).alias("strong"), F.lit("multi-file").alias("file"), F.lit(0).cast("bigint").alias("start_line"), F.lit(1).cast("bigint").alias("occurrences"),
        fingerprint(F.lit(FALLBACK_RULE), category, F.lit("multi-file"), F.lit(0).cast("bigint"), none).alias("finding_fingerprint"), earlier_id(category, none).alias("legacy_rule_id"), none.alias("reason"),
    ))
    rank = F.transform(
        F.filter(hits, lambda h: h["category"] == category),
        lambda h: F.struct((~h["verified"]).alias("a"), (~h["strong"]).alias("b"), (-h["weight"]).alias("c"), h["rule_id"].alias("rule_id"), h["file"].alias("file"), h["line"].alias("line"), h["n"].alias("n"), h["category"].alias("category"), h["reason"].alias("reason")),
    )
    found = F.transform(
        F.slice(F.sort_array(rank), 1, most),
        lambda h: F.struct(h["rule_id"].alias("rule_id"), h["category"].alias("category"), (-h["c"]).alias("weight"), (~h["b"]).alias("strong"), h["file"].alias("file"), h["line"].alias("start_line"), h["n"].alias("occurrences"), fingerprint(h["rule_id"], h["category"], h["file"], h["line"], h["reason"]).alias("finding_fingerprint"), earlier_id(h["category"], h["reason"]).alias("legacy_rule_id"), h["reason"].alias("reason")),
    )
    return F.when(category == "benign", found).when(F.size(found) > 0, found).otherwise(made)


def cut_bytes(text: Column, most: int = EVIDENCE_BYTES) -> Column:
    """One line without control characters, at most ``most`` bytes; a character that would be cut in two goes."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\s+", " "))
    head = F.regexp_replace(F.make_valid_utf8(F.substring(plain.cast("binary"), 1, most - 1).cast("string")), "�+$", "")
    return F.when(F.octet_length(plain) > most, F.concat(head, F.lit("."))).otherwise(plain)


def with_evidence(reports: DataFrame) -> DataFrame:
    """``reports`` (with ``findings``) with ``evidence_text``: the leading finding, and the two next categories by score."""
    others = F.filter(F.array(*[F.struct((-F.col(c)).alias("s"), F.lit(c).alias("c")) for c in CATEGORIES]), lambda x: (x["s"] < 0) & (x["c"] != F.col("category")))
    second = F.array_join(F.transform(F.slice(F.sort_array(others), 1, 2), lambda x: F.concat(F.upper(x["c"]), F.lit("="), F.format_number(-x["s"], 1))), ", ")
    first = F.try_element_at("findings", F.lit(1))
    label = F.coalesce(*[F.when(F.col("category") == c, v) for c, v in LABELS.items()])
    what = F.concat_ws(" ", F.upper("category"), F.concat(label, F.lit(":")), F.coalesce(display_path(first["file"]), F.lit("package files")), F.coalesce(first["reason"], F.lit("several related signals")))
    risk = F.concat(what, F.when(second != "", F.concat(F.lit("; secondary signals: "), second)).otherwise(""), F.lit("."))
    text = F.when(F.col("layer") == "completeness", F.concat(F.lit("AST08 completeness: scan incomplete: "), F.col("summary"), F.lit("; no benign verdict for a package that was not read in full."))).when(F.col("verdict") == "benign", F.lit("benign: no chain of risky signals was found in manifests and code.")).otherwise(risk)
    prefixed = F.when(~F.col("complete") & (F.col("layer") != "completeness"), F.concat(F.lit("scan incomplete: "), F.col("summary"), F.lit("; "), text)).otherwise(text)
    return reports.withColumn("evidence_text", cut_bytes(prefixed))

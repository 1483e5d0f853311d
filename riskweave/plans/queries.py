"""Queries over the driver's tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import text as T
from riskweave.functions import urls as U
from riskweave.functions.lexicon import TEACHING, signal_table
from riskweave.functions.paths import CODE_ENDS, CONFIG_NAMES, DOC_ENDS, FIRST_PARTS, LOCK_NAMES, MANIFEST_NAMES, OPAQUE_ENDS, PACKAGE_NAMES, PACKAGE_PARTS, with_roles
from riskweave.operators import chains, evaluate, flow, scoring
from riskweave.operators.external import external_addresses
from riskweave.operators.rules import ALL_SIGNALS, FAMILY_PARTS, FILE_RULES, PACKAGE_RULES, SCOPE_PARTS, SKILL_NAMES, file_findings, package_findings
from riskweave.plans.analyze import analyze
from riskweave.plans.planted import NUMBER, PLANTS, planted_files


def _values(rows) -> str:
    q = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def path_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_roles(planted_files(spark, sf_dir).select("skill_id", "rel"))


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over single files, chains too."""
    return file_findings(planted_files(spark, sf_dir))


def cross_file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package_findings(planted_files(spark, sf_dir))


def document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_table(_table(spark, sf_dir, "documents"), "doc_id", ALL_SIGNALS)


def package_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(planted_files(spark, sf_dir)).select("skill_id", "verdict", "category", "score", "layer", "condition", "evidence_text")


def package_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flow_findings(flow.flow_rows(planted_files(spark, sf_dir)))


def address_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in documents: the visible text of each page, and a line that names its URL and, on every third page, tells to carry out
    what is there."""
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ")
    line = F.concat(F.when(F.col("page_id") % 3 == 0, "Follow the instructions at ").otherwise("More is at "), "url")
    return external_addresses(_table(spark, sf_dir, "pages").where(F.col("url").isNotNull()).select(F.col("page_id").cast("string").alias("skill_id"), F.lit("page.md").alias("rel"), F.concat(visible, F.lit("\n"), line).alias("text")))


def _scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines stand for findings: an order is a package, its lines are findings of both profiles."""
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    return _table(spark, sf_dir, "lineitem").select(
        key.alias("skill_id"), F.lit("R0076").alias("rule_id"), F.format_string("ast%02d", ((key * 3 + number * 7) % 10 + 1).cast("int")).alias("category"), (F.col("l_quantity").cast("int") % 9 / 2 + 0.5).cast("double").alias("weight"),
        (F.col("l_returnflag") == "R").alias("strong"), F.when(number % 2 == 0, "docs/a.md").otherwise("b.py").alias("file"), (number % 2 == 0).alias("is_doc"), F.lit(False).alias("mock"), (F.col("l_linestatus") == "O").alias("risky"),
        (number % 5 == 0).alias("lasting"), ((key + number) % 17 == 0).alias("verified"), F.when(key % 3 == 0, "base").when(key % 3 == 1, "broad").otherwise("both").alias("profile"), F.lit(None).cast("boolean").alias("only_expected_auth"), F.lit(None).cast("boolean").alias("flow_truncated"),
    )


def verdict_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = scoring.verdicts(scoring.category_scores(scoring.dampened(_scored_lines(spark, sf_dir))))
    return judged.select("skill_id", "profile", "verdict", "category", "score", "blended", "strong", "condition")


def verdict_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(F.col("quality") == 0, "malicious").otherwise("benign")
    new = F.when(F.col("n_chars") < 500, "suspicious").otherwise("benign")
    label = F.when(F.col("toxic") == 1, "malicious").when(F.col("toxic") == 0, "benign")
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.flips(rows.select(F.col("doc_id").alias("skill_id"), old.alias("old"), new.alias("new"), label.alias("label")), evaluate.POSITIVE["screening"])


def finding_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber").cast("bigint") - 1
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scoring.fingerprint(F.lit("R0001"), F.lit("ast01"), F.concat(F.col("l_orderkey").cast("string"), F.lit(".py")), line, F.col("l_returnflag")).alias("finding_fingerprint"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels stand for a scanner's verdicts on documents whose toxicity is known."""
    verdict = F.when(F.col("quality") == 0, "malicious").when(F.col("n_chars") < 500, "suspicious").otherwise("benign")
    label = F.when(F.col("toxic") == 1, "malicious").when(F.col("toxic") == 0, "benign")
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.select(F.col("doc_id").alias("skill_id"), "lang", verdict.alias("verdict"), label.alias("label"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _labelled(spark, sf_dir)
    return evaluate.confusion(judged, evaluate.POSITIVE["screening"], "lang").unionByName(evaluate.confusion(judged, evaluate.POSITIVE["screening"]))


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gate(_labelled(spark, sf_dir))


def url_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", U.host(url).alias("host"), U.redacted(url).alias("redacted"), F.sha2(url, 256).alias("url_sha256"), U.pinned(url).alias("pinned"))


def comment_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.html_comments(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("bigint").alias("n_comments"), F.coalesce(F.aggregate(found, F.lit(0).cast("bigint"), lambda a, c: a + F.char_length(c)), F.lit(0).cast("bigint")).alias("comment_chars"))


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.near_lines(F.col("text"), ("token", "secret", "password"), ("@", "+"), 2).alias("near"))


def secret_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)token|secret|password|api_key")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", T.assignment(F.col("line")).alias("a")).where("a.target IS NOT NULL").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "a.target", F.sha2("a.value", 256).alias("value_sha256"))


QUERIES = {
    "package_verdicts": package_verdicts,
    "rule_findings": rule_findings,
    "cross_file_findings": cross_file_findings,
    "document_signals": document_signals,
    "package_flows": package_flows,
    "address_inventory": address_inventory,
    "verdict_ladder": verdict_ladder,
    "verdict_flips": verdict_flips,
    "finding_fingerprints": finding_fingerprints,
    "path_roles": path_roles,
    "confusion_matrix": confusion_matrix,
    "gate_counts": gate_counts,
    "url_inventory": url_inventory,
    "comment_inventory": comment_inventory,
    "line_windows": line_windows,
    "secret_assignments": secret_assignments,
}


def _sql_ends(col: str, ends) -> str:
    return "(" + " OR ".join(f"{col} LIKE '%{e}'" for e in ends) + ")"


def _sql_has(col: str, parts) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(col, p.replace("'", "''")) for p in parts) + ")"


def _sql_in(col: str, names) -> str:
    return f"{col} IN (" + ", ".join(f"'{n}'" for n in names) + ")"


_FILES = f"""plants(n, k, r, s) AS (VALUES {_values(PLANTS)}),
files AS (SELECT 'p' || coalesce(doc_id, -1) AS skill_id, 'd' || coalesce(doc_id, -1) || '/' || r AS rel, CASE WHEN k = 0 THEN coalesce(text, '') || chr(10) || s ELSE s END AS text
  FROM documents JOIN plants ON plants.n = coalesce(doc_id, -1) % {NUMBER}),
named AS (SELECT *, lower(rel) AS p, regexp_extract(lower(rel), '[^/]*$') AS b FROM files)"""
_ROLES = f"""roles AS (SELECT *, contains(b, 'manifest') OR {_sql_in("b", MANIFEST_NAMES)} OR contains(p, 'metadata/') AS is_manifest,
  {_sql_in("b", PACKAGE_NAMES)} OR {_sql_has("p", PACKAGE_PARTS)} AS is_package, b = '.env' OR starts_with(b, '.env.') OR {_sql_in("b", CONFIG_NAMES)} AS is_config,
  {_sql_ends("p", DOC_ENDS)} OR contains(p, 'docs/') AS is_doc, {_sql_ends("p", CODE_ENDS)} AS is_code, {_sql_ends("p", OPAQUE_ENDS)} AS is_opaque FROM named)"""


def _sql_signal(name: str, text: str = "low") -> str:
    return _sql_has(text, ALL_SIGNALS[name])


def _sql_all(needs: str, one) -> str:
    return " AND ".join("(" + " OR ".join(one(s) for s in t.split("|")) + ")" for t in needs.split())


_SKILL = f"(is_doc OR is_manifest OR {_sql_in('b', SKILL_NAMES)} OR contains(p, '.cursor'))"


def _sql_scopes(package: str) -> dict[str, str]:
    active = f"(is_code OR is_manifest OR {package} OR is_config)"
    out = {"any": "true", "doc": "is_doc", "code": "is_code", "manifest": "is_manifest", "package": package, "config": "is_config", "skill": _SKILL, **{k: _sql_has("p", v) for k, v in SCOPE_PARTS.items()}}
    return out | {f"chain_{k}": f"({active} AND {_sql_has('p', v)})" for k, v in FAMILY_PARTS.items()} | {"chain_document": f"(NOT {active} AND {_SKILL} AND {_sql_has('p', FAMILY_PARTS['update'])})"}


_BASE, _BROAD = _sql_scopes("is_package"), _sql_scopes(f"(is_package OR {_sql_in('b', LOCK_NAMES)})")
_TAUGHT = "'" + TEACHING.replace("'", "''") + "'"
_BAD_LINE = f"len(list_filter(string_split(low, chr(10)), lambda x: {_sql_signal('send', 'x')} AND {_sql_signal('secret', 'x')} AND NOT regexp_matches(x, {_TAUGHT}))) > 0"
_MARKED = f"""{_FILES}, {_ROLES}, lowered AS (SELECT *, lower(text) AS low FROM roles),
active AS MATERIALIZED (SELECT *, {", ".join(f"{_sql_signal(n)} AS s_{n}" for n in ALL_SIGNALS)} FROM lowered WHERE NOT ({_SKILL} AND regexp_matches(low, {_TAUGHT}) AND NOT ({_BAD_LINE})))"""
_NEAR_WORDS = sorted({s for r in FILE_RULES if r.near for t in r.needs.split() for s in t.split("|")})
_PIECES = rf"""lines AS MATERIALIZED (SELECT skill_id, rel, i, {", ".join(f"{_sql_signal(n, 'line')} AS s_{n}" for n in _NEAR_WORDS)}
  FROM (SELECT skill_id, rel, unnest(string_split(low, chr(10))) AS line, generate_subscripts(string_split(low, chr(10)), 1) AS i FROM active)),
comments AS MATERIALIZED (SELECT skill_id, rel, unnest(regexp_extract_all(low, '(?s)<!--(.*?)(?:-->|\z)', 1)) AS piece FROM active),
blocks AS (SELECT skill_id, rel, unnest(regexp_split_to_array(low, '\n[ \t]*\n')) AS piece FROM active)"""
_GOT = r"(?:curl|wget|invoke-webrequest)[^\n]*?([\w.-]+\.(?:sh|py|js|ps1|bash|rb|pl))\b"
_RUN = r"(?:^|[\n;&|`])\s*(?:(?:bash|sh|python3?|node|source|chmod \+x|sudo)\s+|\./)+(?:[\w.-]*/)*([\w.-]+\.(?:sh|py|js|ps1|bash|rb|pl))\b"


def _sql_rule(r, order: int) -> str:
    scopes = r.scope.split()
    base, broad = ("(" + " OR ".join(x[s] for s in scopes) + ")" if p else "false" for x, p in ((_BASE, r.profile != "broad"), (_BROAD, r.profile != "base")))
    doc = f"(is_doc AND {str(bool(r.doc_weight)).lower()})"
    holds, unless = _sql_all(r.needs, lambda s: f"s_{s}"), f" AND NOT ({_sql_all(r.unless, lambda s: f's_{s}')})" if r.unless else ""
    here = "x.skill_id = active.skill_id AND x.rel = active.rel"
    if r.near:
        left, right = ("(" + " OR ".join(f"{{}}.s_{s}" for s in t.split("|")) + ")" for t in r.needs.split()[:2])
        holds += f" AND EXISTS (SELECT 1 FROM lines x JOIN lines y ON x.skill_id = y.skill_id AND x.rel = y.rel AND abs(x.i - y.i) <= {r.near} WHERE {here} AND {left.replace('{}', 'x')} AND {right.replace('{}', 'y')})"
    elif r.within == "script":
        holds += f" AND list_has_any(regexp_extract_all(low, '{_GOT}', 1), regexp_extract_all(low, '{_RUN}', 1))"
    elif r.within:
        long = " AND length(trim(piece)) >= 120" if r.within == "long" else ""
        inside = f" AND NOT ({_sql_all(r.unless, lambda s: _sql_signal(s, 'piece'))})" if r.unless else ""
        holds, unless = f"EXISTS (SELECT 1 FROM {'blocks' if r.within == 'block' else 'comments'} x WHERE {here} AND {_sql_all(r.needs, lambda s: _sql_signal(s, 'piece'))}{inside}{long})", ""
    return f"""SELECT skill_id, rel AS file, '{r.rule_id}' AS rule_id, '{r.category}' AS category, CASE WHEN {doc} THEN {r.doc_weight} ELSE {r.weight} END::DOUBLE AS weight, {r.strong} AND NOT {doc} AS strong,
  CASE WHEN {base} AND {broad} THEN 'both' WHEN {base} THEN 'base' ELSE 'broad' END AS profile, {order if r.chain else -1} AS chain, '{r.yields}' AS yields FROM active WHERE ({base} OR {broad}) AND {holds}{unless}"""


_FOUND = f"""WITH {_MARKED}, {_PIECES}, found AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(_sql_rule(r, k) for k, r in enumerate(FILE_RULES))})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY skill_id, file, chain >= 0 ORDER BY chain) AS place FROM found)
SELECT skill_id, file, rule_id, category, weight, strong, profile FROM ranked r WHERE (chain < 0 OR place <= {chains.PER_FILE})
  AND NOT EXISTS (SELECT 1 FROM found x WHERE r.yields <> '' AND x.skill_id = r.skill_id AND x.file = r.file AND contains(r.yields, x.rule_id))"""


def _sql_flag(name: str, scopes: dict[str, str]) -> str:
    signals, scope = name.split("@")
    return f"bool_or({scopes[scope]} AND " + " AND ".join(f"s_{s}" for s in signals.split("+")) + ")"


def _sql_package_rule(r) -> str:
    base = _sql_all(r.needs, lambda n: _sql_flag(n, _BASE)) if r.profile != "broad" else "false"
    broad = _sql_all(r.needs, lambda n: _sql_flag(n, _BROAD)) if r.profile != "base" else "false"
    return f"""SELECT skill_id, 'multi-file' AS file, '{r.rule_id}' AS rule_id, '{r.category}' AS category, {r.weight}::DOUBLE AS weight, {r.strong} AS strong,
  CASE WHEN ({base}) AND ({broad}) THEN 'both' WHEN {base} THEN 'base' ELSE 'broad' END AS profile FROM active GROUP BY skill_id HAVING ({base}) OR ({broad})"""


def _sql_rung(c: str, least: float, below: dict[str, float], above: float | None) -> str:
    near = "" if above is None else f" AND (ast07 >= {scoring.DRIFT_WITH_SUPPLY} OR ast01 <= ast02 + {above})" if c == "ast02" else f" AND ast01 <= {c} + {above}"
    return f"{c} >= {least}" + "".join(f" AND {k} < {v}" for k, v in below.items()) + near


_LADDER = "CASE " + " ".join(f"WHEN profile = '{p}' AND {_sql_rung(*r)} THEN '{r[0]}'" for p, rungs in scoring.LADDER.items() for r in rungs) + " END"
_PICK = lambda prefix, cat: f"CASE {cat} " + " ".join(f"WHEN '{c}' THEN {prefix}{c}" for c in scoring.CATEGORIES) + " END"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_BEST = lambda skip: "CASE greatest(" + ", ".join(c for c in scoring.LEADING if c != skip) + ") " + " ".join(f"WHEN {c} THEN '{c}'" for c in scoring.LEADING if c != skip) + " END"
_FLOW_MAX = "greatest(" + ", ".join(f"CASE WHEN {c} >= {scoring.VERIFIED_LEAST} THEN flow_{c} ELSE 0 END" for c in scoring.VERIFIED_ORDER) + ")"
_FLOW = "CASE WHEN flow_max <= 0 THEN NULL " + " ".join(f"WHEN {c} >= {scoring.VERIFIED_LEAST} AND flow_{c} = flow_max THEN '{c}'" for c in scoring.VERIFIED_ORDER) + " END"
_BY_CATEGORY = ", ".join(
    f"round(coalesce(sum(score) FILTER (category = '{c}'), 0), 9) AS {c}, count(*) FILTER (category = '{c}' AND strong) AS strong_{c}, coalesce(bool_or(lasting) FILTER (category = '{c}' AND strong), false) AS lasting_{c}, "
    f"coalesce(bool_or(NOT is_doc) FILTER (category = '{c}' AND strong), false) AS outside_{c}, coalesce(bool_or(risky) FILTER (category = '{c}' AND strong), false) AS risky_{c}, coalesce(max(weight) FILTER (category = '{c}' AND verified), 0) AS flow_{c}"
    for c in scoring.CATEGORIES
)
_LABELLED = """judged AS (SELECT lang, CASE WHEN quality = 0 THEN 'malicious' WHEN n_chars < 500 THEN 'suspicious' ELSE 'benign' END AS verdict,
  CASE toxic WHEN 1 THEN 'malicious' WHEN 0 THEN 'benign' END AS label FROM labels JOIN documents USING (doc_id))"""

ORACLES = {
    "path_roles": f"""WITH {_FILES}, {_ROLES} SELECT skill_id, rel, is_manifest, is_package, is_config, is_doc, is_code, is_opaque,
  CASE WHEN is_manifest OR is_package OR is_config OR b = 'skill.md' OR p LIKE '%.tf' OR {_sql_has("p", FIRST_PARTS)} THEN 0 WHEN is_code THEN 1 WHEN is_doc THEN 2 ELSE 3 END AS priority FROM roles""",
    "rule_findings": _FOUND,
    "cross_file_findings": f"WITH {_MARKED} " + " UNION ALL ".join(_sql_package_rule(r) for r in PACKAGE_RULES),
    "document_signals": "WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) SELECT doc_id, " + ", ".join(f"{_sql_signal(n)} AS s_{n}" for n in ALL_SIGNALS) + " FROM d",
    "address_inventory": r"""WITH v AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS visible FROM pages WHERE url IS NOT NULL),
c AS (SELECT *, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://)[^/?#@]*@', '\1') AS plain FROM v)
SELECT CAST(page_id AS VARCHAR) AS skill_id, 'page.md' AS file, length(visible) - length(replace(visible, chr(10), '')) + 2 AS start_line, 1::BIGINT AS seq, left(plain, 2048) AS url, sha256(url) AS url_sha256,
  CASE WHEN page_id % 3 = 0 THEN 'instruction-delegation' ELSE 'reference' END AS kind, length(plain) > 2048 AS url_truncated,
  regexp_matches(url, '^https?://raw\.githubusercontent\.com/[^/]+/[^/]+/[0-9a-f]{40}/[^/]') OR regexp_matches(url, '^https?://github\.com/[^/]+/[^/]+/(?:blob|raw)/[0-9a-f]{40}/[^/]') AS version_pinned FROM c""",
    "verdict_ladder": f"""WITH f AS (SELECT l_orderkey AS skill_id, printf('ast%02d', (l_orderkey * 3 + l_linenumber * 7) % 10 + 1) AS category, CAST(l_quantity AS INT) % 9 / 2.0 + 0.5 AS weight, l_returnflag = 'R' AS strong,
  l_linenumber % 2 = 0 AS is_doc, l_linestatus = 'O' AS risky, l_linenumber % 5 = 0 AS lasting, (l_orderkey + l_linenumber) % 17 = 0 AS verified, unnest(CASE l_orderkey % 3 WHEN 0 THEN ['base'] WHEN 1 THEN ['broad'] ELSE ['base', 'broad'] END) AS profile FROM lineitem),
scored AS (SELECT *, CASE WHEN strong OR NOT is_doc THEN weight ELSE weight * {scoring.PATH_FACTOR} * {scoring.DOC_FACTOR} END AS score FROM f),
g AS (SELECT skill_id, profile, {_BY_CATEGORY} FROM scored GROUP BY ALL),
x AS (SELECT *, {_FLOW_MAX} AS flow_max FROM g),
y AS (SELECT *, coalesce({_FLOW}, {_LADDER}, {_BEST("")}) AS lead0 FROM x),
z AS (SELECT *, {_PICK("", "lead0")} + {" + ".join(f"CASE WHEN lead0 = '{c}' THEN 0 ELSE {scoring.BLEND} * least({c}, {scoring.BLEND_CAP}) END" for c in scoring.CATEGORIES)} AS blended0,
  CASE WHEN lead0 = '{scoring.MODIFIER}' AND greatest({", ".join(c for c in scoring.CATEGORIES if c != scoring.MODIFIER)}) >= {scoring.MODIFIER_LEAST} THEN {_BEST(scoring.MODIFIER)} ELSE lead0 END AS lead FROM y),
w AS (SELECT *, round(blended0, 6) AS blended, round({_PICK("", "lead")}, 6) AS score, {_PICK("strong_", "lead")} AS strong, {" + ".join(f"strong_{c}" for c in scoring.CATEGORIES)} AS strong_all, {_PICK("lasting_", "lead")} AS lasting,
  {_PICK("outside_", "lead")} AS outside, {_PICK("risky_", "lead")} AS risky FROM z),
v AS (SELECT *, CASE WHEN score >= {scoring.MALICIOUS} THEN 'max_score_gte_4.65' WHEN score >= {scoring.MALICIOUS_STRONG} AND strong >= 1 THEN 'category_score_gte_3.25_with_strong' WHEN blended >= {scoring.MALICIOUS_BLENDED} THEN 'blended_score_gte_5.35'
  WHEN strong_all >= {scoring.STRONG_FINDINGS} THEN 'multiple_strong_findings' END AS bad, CASE WHEN score >= {scoring.SUSPICIOUS} THEN 'max_score_gte_1.75' WHEN blended >= {scoring.SUSPICIOUS_BLENDED} THEN 'blended_score_gte_2.35' END AS hint FROM w),
u AS (SELECT *, CASE WHEN bad IS NOT NULL AND NOT ((strong = 0 AND lead IN {_IN(scoring.CAPPED_WITHOUT_STRONG)}) OR (strong > 0 AND NOT lasting AND NOT outside AND (lead IN {_IN(scoring.CAPPED_IN_DOCS)} OR (lead IN {_IN(scoring.CAPPED_IN_DOCS_UNLESS_RISKY)} AND NOT risky)))) THEN 'malicious'
  WHEN bad IS NOT NULL OR hint IS NOT NULL THEN 'suspicious' ELSE 'benign' END AS verdict FROM v)
SELECT skill_id, profile, verdict, CASE verdict WHEN 'benign' THEN 'benign' ELSE lead END AS category, score::DOUBLE AS score, blended::DOUBLE AS blended, CAST(strong AS BIGINT) AS strong, coalesce(CASE verdict WHEN 'malicious' THEN bad WHEN 'suspicious' THEN hint END, 'below_risk_thresholds') AS condition FROM u""",
    "verdict_flips": """WITH j AS (SELECT doc_id AS skill_id, quality = 0 AS was, n_chars < 500 AS now, toxic FROM labels JOIN documents USING (doc_id))
SELECT skill_id, CASE WHEN toxic = 1 AND now THEN 'fixed_false_negatives' WHEN toxic = 1 THEN 'new_false_negatives' WHEN now THEN 'new_false_positives' ELSE 'fixed_false_positives' END AS change FROM j WHERE toxic IN (0, 1) AND coalesce(was, false) <> coalesce(now, false)""",
    "finding_fingerprints": """SELECT l_orderkey, l_linenumber, 'sha256:' || sha256('R0001' || chr(0) || 'ast01' || chr(0) || l_orderkey || '.py' || chr(0) || (l_linenumber - 1) || ':' || (l_linenumber - 1) || CASE WHEN l_linenumber = 1 THEN chr(0) || l_returnflag ELSE '' END) AS finding_fingerprint FROM lineitem""",
    "confusion_matrix": f"""WITH {_LABELLED}, sides AS (SELECT lang AS grp, verdict, label FROM judged UNION ALL SELECT 'all', verdict, label FROM judged),
c AS (SELECT coalesce(grp, 'unspecified') AS grp, count(*) FILTER (label = 'malicious' AND verdict <> 'benign') AS tp, count(*) FILTER (label = 'benign' AND verdict <> 'benign') AS fp,
  count(*) FILTER (label = 'benign' AND verdict = 'benign') AS tn, count(*) FILTER (label = 'malicious' AND verdict = 'benign') AS fn, count(*) FILTER (label IS NULL) AS excluded FROM sides GROUP BY 1)
SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, fp::DOUBLE / nullif(fp + tn, 0) AS false_positive_rate, (5 * tp)::DOUBLE / nullif(5 * tp + 4 * fn + fp, 0) AS f2 FROM c""",
    "gate_counts": f"WITH {_LABELLED} SELECT count(*) FILTER (verdict = 'malicious') AS malicious, count(*) FILTER (verdict = 'suspicious') AS suspicious, count(*) FILTER (verdict = 'benign') AS benign, count(*) FILTER (verdict = 'malicious') > 0 AS blocked FROM judged",
    "url_inventory": r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, left(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://)[^/?#@]*@', '\1'), 2048) AS redacted,
  sha256(url) AS url_sha256, regexp_matches(url, '^https?://raw\.githubusercontent\.com/[^/]+/[^/]+/[0-9a-f]{40}/[^/]') OR regexp_matches(url, '^https?://github\.com/[^/]+/[^/]+/(?:blob|raw)/[0-9a-f]{40}/[^/]') AS pinned FROM pages""",
    "comment_inventory": r"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--(.*?)(?:-->|\z)', 1) AS f FROM pages)
SELECT page_id, CAST(len(f) AS BIGINT) AS n_comments, CAST(coalesce(list_sum(list_transform(f, lambda x: length(x))), 0) AS BIGINT) AS comment_chars FROM c""",
    "line_windows": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
a AS (SELECT doc_id, i FROM l WHERE contains(line, 'token') OR contains(line, 'secret') OR contains(line, 'password')), b AS (SELECT doc_id, i FROM l WHERE contains(line, '@') OR contains(line, '+'))
SELECT d.doc_id, EXISTS (SELECT 1 FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 2 WHERE a.doc_id = d.doc_id) AS near FROM documents d""",
    "secret_assignments": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
m AS (SELECT doc_id, line_no, regexp_extract(line, '(?i)\b(token|secret|password|api_key)\s*[:=]\s*["'']([^"'']{8,})["'']', ['t', 'v']) AS x FROM l)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, lower(x.t) AS target, sha256(x.v) AS value_sha256 FROM m WHERE x.t <> ''""",
}

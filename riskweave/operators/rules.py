"""Rules as boolean algebra over signals: a row each.

A file's text is searched once, by one automaton that tells which signals occur as a bit set; a rule is then an AND of ORs over bits.
Files are looked at in Arrow batches where they lie, and leave as a few compact events; the plan has the same size however many
rules there are. Rules over packages (``PACKAGE_RULES``) read flags that files raise: no text is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import paths
from riskweave.functions.layout import spread
from riskweave.functions.lexicon import SIGNALS, TEACHING, Scanner
from riskweave.functions.markdown import active_view, risky
from riskweave.operators import chains
from riskweave.operators.scoring import MOCK_MARKS


@dataclass(frozen=True)
class Rule:
    """``needs``: space-separated signals, all of them; ``a|b`` is either. ``near``: the first two signals must be within so many
    lines. ``within``: all in one ``block`` (between blank lines) or HTML ``comment`` (``long``: of at least 120 characters), or of a
    ``script`` of one name. ``doc_weight``: weak in documents with it. ``lasting``: a strong finding in a document counts in full.
    ``raw``: over the whole text, not the active view. ``profile``: base, broad or both. ``yields``: gives way to these rules."""

    rule_id: str
    category: str
    weight: float
    strong: bool
    scope: str
    needs: str
    unless: str = ""
    near: int = 0
    within: str = ""
    doc_weight: float = 0.0
    lasting: bool = False
    raw: bool = False
    profile: str = "both"
    yields: str = ""
    chain: int = 0


# Identifiers, categories, weights and strength; the predicates are this library's own.
RULES = (
    Rule("R0008", "ast01", 7.2, True, "skill", "lure payload redirect", lasting=True),
    Rule("R0009", "ast01", 4.9, True, "manifest skill", "lure redirect fetch", profile="base"),
    Rule("R0010", "ast01", 5.4, True, "manifest skill", "decode shell", lasting=True, profile="base"),
    Rule("R0011", "ast01", 5.2, True, "manifest skill", "secret send", near=6, lasting=True, profile="base"),
    Rule("R0012", "ast02", 5.7, True, "skill", "fetch run_binary", "integrity", within="script", lasting=True, profile="base"),
    Rule("R0013", "ast08", 5.8, True, "skill", "modular joined dynamic", lasting=True, raw=True, profile="base"),
    Rule("R0014", "ast07", 5.9, True, "any", "fetch instruction_asset source_form", lasting=True, profile="base"),
    Rule("R0015", "ast01", 5.6, True, "any", "memory persist conceal|override", profile="base"),
    Rule("R0016", "ast02", 6.0, True, "agent", "hook exec secret|endpoint", profile="base"),
    Rule("R0017", "ast01", 5.8, True, "code", "ide read decode send fetch", profile="base"),
    Rule("R0018", "ast02", 5.7, True, "mcp", "shell|install fetch|registry exfil|send", profile="base"),
    Rule("R0019", "ast04", 5.0, True, "doc manifest agent", "override secret|send|exec actor", within="comment", profile="base"),
    Rule("R0019", "ast04", 5.0, True, "doc manifest agent", "actor persona imperative", within="comment", profile="base"),
    Rule("R0019", "ast04", 5.0, True, "doc manifest agent", "bidi_name", within="long", profile="base"),
    Rule("R0020", "ast08", 5.2, True, "skill", "conceal exec|run_binary", "approval", lasting=True, profile="base"),
    Rule("R0021", "ast01", 3.2, False, "skill", "remove|destroy automatic", "approval", within="block", profile="base"),
    Rule("R0022", "ast01", 6.4, True, "code manifest skill", "reverse", lasting=True, profile="base"),
    Rule("R0023", "ast08", 5.4, True, "code manifest", "condition exec|send secret|fetch", doc_weight=3.2, profile="base"),
    Rule("R0024", "ast01", 5.8, True, "code manifest", "wallet read send", lasting=True, profile="base"),
    Rule("R0025", "ast01", 5.9, True, "doc", "lure shell fetch|decode", lasting=True, profile="base"),
    Rule("R0026", "ast01", 5.7, True, "code manifest", "extension broad secret send", profile="base"),
    Rule("R0027", "ast06", 5.6, True, "any", "metadata_ip send|secret", doc_weight=3.2, profile="base"),
    Rule("R0028", "ast05", 5.2, True, "code manifest", "proto untrusted privilege", profile="base"),
    Rule("R0029", "ast04", 5.3, True, "doc", "invisible override send|exec|secret", lasting=True, raw=True, profile="base"),
    Rule("R0029", "ast04", 5.3, True, "doc", "override send|exec|secret", within="comment", lasting=True, profile="base"),
    Rule("R0029", "ast04", 5.3, True, "doc", "actor persona imperative", within="comment", lasting=True, profile="base"),
    Rule("R0029", "ast04", 5.3, True, "doc", "bidi_name", within="long", lasting=True, profile="base"),
    Rule("R0030", "ast07", 5.6, True, "code manifest package", "watch fetch load", lasting=True, profile="base"),
    Rule("R0031", "ast08", 5.1, True, "code manifest", "scanner tamper exec|send|secret", profile="base"),
    Rule("R0032", "ast01", 5.8, True, "skill", "actor secret send", lasting=True, yields="R0019 R0029 R0038"),
    Rule("R0033", "ast01", 5.5, True, "code skill", "memory write override|bypass"),
    Rule("R0034", "ast01", 5.8, True, "code manifest", "websocket exec|secret"),
    Rule("R0035", "ast06", 5.6, True, "code manifest skill", "local_url agent_api control", doc_weight=3.2),
    Rule("R0036", "ast05", 5.7, True, "code manifest yaml", "yaml_tag exec", lasting=True),
    Rule("R0037", "ast01", 5.4, True, "code manifest", "token_shape send", lasting=True),
    Rule("R0038", "ast04", 5.5, True, "manifest mcp", "override send|secret|exec"),
    Rule("R0039", "ast01", 5.4, True, "skill", "actor workspace send", lasting=True, yields="R0019 R0029 R0038"),
    Rule("R0040", "ast04", 5.4, True, "manifest", "brand official low_trust net_cap|secret", "disclaimer"),
    Rule("R0041", "ast02", 5.8, True, "agent config", "auto_run exec fetch|secret"),
    Rule("R0042", "ast02", 5.6, True, "docker", "docker_add entry", "integrity"),
    Rule("R0043", "ast08", 5.4, True, "code manifest", "escape dynamic secret|fetch"),
    Rule("R0044", "ast02", 5.2, True, "package config", "registry|mutable install"),
    Rule("R0045", "ast02", 5.4, True, "package", "typosquat"),
    Rule("R0046", "ast02", 3.6, False, "package", "registry install", "integrity"),
    Rule("R0047", "ast02", 5.5, True, "ci", "ci_step fetch exec|secret"),
    Rule("R0048", "ast01", 5.0, True, "skill", "lure binary run_binary"),
    Rule("R0049", "ast01", 5.5, True, "skill", "fetch binary run_binary", "integrity", lasting=True, profile="base"),
    Rule("R0050", "ast01", 5.3, True, "skill", "binary run_binary secret", "provenance", lasting=True, raw=True, profile="base"),
    Rule("R0051", "ast01", 5.1, True, "startup", "startup fetch|exec"),
    Rule("R0052", "ast02", 5.9, True, "package", "lifecycle fetch exec"),
    Rule("R0053", "ast05", 5.8, True, "yaml doc manifest code", "yaml_tag"),
    Rule("R0054", "ast06", 5.7, True, "docker manifest yaml", "host"),
    Rule("R0055", "ast02", 5.8, True, "agent manifest", "hook exec endpoint|secret"),
    Rule("R0056", "ast06", 5.4, True, "code manifest package", "plugin fetch no_approval"),
    Rule("R0057", "ast07", 5.4, True, "code manifest package", "watch fetch load|dynamic"),
    Rule("R0058", "ast05", 5.6, True, "code doc yaml", "deserialize untrusted|fetch", near=12),
    Rule("R0059", "ast01", 5.1, True, "code", "exec untrusted", near=10),
    Rule("R0060", "ast03", 5.0, True, "code manifest", "pii send evasion"),
    Rule("R0061", "ast01", 5.6, True, "code manifest", "store send"),
    Rule("R0062", "ast02", 5.7, True, "mcp", "install mutable|fetch no_approval"),
    Rule("R0063", "ast01", 5.5, True, "code package manifest", "ide read|workspace send"),
    Rule("R0064", "ast01", 5.5, True, "code manifest package", "extension broad send"),
    Rule("R0065", "ast01", 5.7, True, "code manifest", "metadata_ip secret|cloud send", lasting=True),
    Rule("R0066", "ast01", 5.6, True, "code manifest doc", "kube send", lasting=True),
    Rule("R0067", "ast01", 5.4, True, "code manifest", "store read send"),
    Rule("R0068", "ast02", 5.5, True, "ci", "ci_token send"),
    Rule("R0069", "ast02", 5.6, True, "docker", "docker_add exec|entry", "integrity"),
    Rule("R0070", "ast08", 5.3, True, "doc manifest code", "bypass update fetch exec|instruction_asset"),
    Rule("R0071", "ast01", 5.4, True, "code manifest", "policy_file write|tamper no_approval|tamper"),
    Rule("R0072", "ast10", 5.1, True, "any", "platform security_meta weaken identity_loss"),
    Rule("R0073", "ast01", 5.7, True, "code manifest", "exec secret|send|decode|destroy"),
    Rule("R0074", "ast01", 3.0, False, "code", "exec", "secret|send|decode|destroy"),
    Rule("R0075", "ast01", 6.2, True, "code manifest", "secret send read"),
    Rule("R0076", "ast01", 4.4, True, "code", "destroy"),
    Rule("R0077", "ast01", 4.3, True, "code", "secret read|send|exec"),
    Rule("R0078", "ast08", 4.0, True, "code", "send decode", profile="base"),
    Rule("R0078", "ast08", 2.6, False, "code", "send decode", profile="broad"),
    Rule("R0079", "ast01", 4.1, True, "code", "exec untrusted"),
    Rule("R0080", "ast02", 6.4, True, "package", "lifecycle exec|fetch|decode"),
    Rule("R0081", "ast02", 4.7, True, "package", "fetch shell"),
    Rule("R0082", "ast02", 3.7, True, "code package config", "unpinned"),
    Rule("R0083", "ast02", 5.9, True, "package", "publish exec|send|decode|fetch"),
    Rule("R0084", "ast02", 5.0, True, "package", "py_build exec|send|fetch"),
    Rule("R0085", "ast03", 4.1, False, "manifest", "capability broad_cap|net_cap"),
    Rule("R0086", "ast04", 4.4, True, "manifest", "override|bypass"),
    Rule("R0087", "ast04", 4.2, False, "manifest", "policy_file memory|endpoint"),
    Rule("R0088", "ast04", 3.6, False, "code", "override"),
    Rule("R0089", "ast05", 5.8, True, "code", "deserialize"),
    Rule("R0090", "ast05", 5.3, True, "code", "yaml_load", "yaml_safe"),
    Rule("R0091", "ast05", 5.1, True, "code", "yaml_loader"),
    Rule("R0092", "ast05", 4.8, True, "code", "deserialize untrusted"),
    Rule("R0093", "ast05", 4.2, True, "code", "deserialize exec"),
    Rule("R0094", "ast06", 5.0, True, "code docker yaml", "host", doc_weight=2.8),
    Rule("R0095", "ast06", 5.1, True, "docker yaml manifest", "hostmount"),
    Rule("R0096", "ast06", 4.3, True, "code", "extract traversal"),
    Rule("R0097", "ast06", 3.9, True, "code", "traversal read|write"),
    Rule("R0098", "ast07", 5.5, True, "code manifest package", "update fetch write|exec|dynamic", doc_weight=3.5),
    Rule("R0099", "ast07", 5.2, True, "code", "fetch write plugin|config_url"),
    Rule("R0100", "ast07", 5.4, True, "code manifest", "config_url fetch write|exec|load", doc_weight=3.4),
    Rule("R0101", "ast08", 5.2, True, "code", "decode exec", profile="base"),
    Rule("R0102", "ast08", 4.2, False, "code", "analysis exec|send|decode"),
    Rule("R0103", "ast09", 2.9, False, "any", "governance"),
    Rule("R0104", "ast10", 5.2, True, "any", "reuse cloud|secret send|read", doc_weight=2.4, profile="base"),
    Rule("R0105", "ast10", 5.1, True, "code config", "store reuse send|read", profile="base"),
    Rule("R0106", "ast10", 5.0, True, "code config", "cloud reuse send|read", profile="base"),
    Rule("R0139", "ast01", 4.9, True, "code", "startup exec|write|send", profile="broad"),
    Rule("R0140", "ast01", 4.7, True, "code manifest config", "exfil secret|send|read", profile="broad"),
    Rule("R0141", "ast04", 4.1, True, "doc", "actor exfil|override", profile="broad"),
    Rule("R0142", "ast01", 5.8, True, "code", "secret send", profile="broad"),
    Rule("R0143", "ast02", 3.9, False, "package", "mutable send|exec|install", profile="broad"),
    Rule("R0144", "ast03", 3.6, False, "manifest", "store|hostmount read|write", profile="broad"),
    Rule("R0145", "ast08", 5.2, True, "code", "decode exec analysis", profile="broad"),
    Rule("R0146", "ast01", 4.9, True, "code", "decode exec", "analysis", profile="broad"),
    Rule("R0147", "ast10", 4.8, False, "any", "platform reuse", profile="broad"),
    Rule("R0148", "ast01", 4.6, True, "code", "store", profile="broad"),
)

# Over packages: ``signal@scope`` means that some file of the scope shows the signal; ``a+b@scope`` both in one file.
PACKAGE_RULES = (
    Rule("R0107", "ast03", 3.8, True, "", "broad_cap@manifest exec@code|send@code"),
    Rule("R0108", "ast02", 6.6, True, "", "lifecycle@package fetch+exec@install"),
    Rule("R0109", "ast02", 6.1, True, "", "py_build@package fetch+exec@code"),
    Rule("R0110", "ast01", 4.0, True, "", "websocket@code|config_url@code exec@code"),
    Rule("R0111", "ast01", 4.2, True, "", "send@code secret@code"),
    Rule("R0112", "ast08", 3.4, False, "", "decode@code dynamic@code"),
    Rule("R0113", "ast01", 5.4, True, "", "broad@manifest secret+send@code", profile="base"),
    Rule("R0114", "ast07", 5.5, True, "", "config_url@code load@code fetch@code", profile="base"),
    Rule("R0115", "ast06", 5.3, True, "", "metadata_ip@code send@code|secret@code|exec@code", profile="base"),
    Rule("R0116", "ast10", 5.1, True, "", "platform+security_meta@any weaken@any identity_loss@any"),
    Rule("R0117", "ast04", 5.2, True, "", "net_off@manifest send@code secret@code|exec@code|destroy@code"),
    Rule("R0118", "ast04", 5.2, True, "", "shell_off@manifest exec@code send@code|secret@code|decode@code|destroy@code"),
    Rule("R0119", "ast04", 5.3, True, "", "low_risk@manifest send@code secret@code|exec@code|destroy@code"),
    Rule("R0120", "ast08", 5.2, True, "", "clean@manifest send@code|decode@code secret@code|exec@code"),
    Rule("R0122", "ast02", 6.2, True, "", "lifecycle@package fetch+exec@install", profile="base"),
    Rule("R0123", "ast01", 5.8, True, "", "store@code send@code", profile="base"),
    Rule("R0124", "ast06", 5.4, True, "", "plugin@code fetch@code no_approval@any", profile="base"),
    Rule("R0125", "ast07", 5.4, True, "", "watch@code fetch@code load@code", profile="base"),
    Rule("R0126", "ast06", 5.5, True, "", "host@docker|startup@startup send@code|secret@code", profile="base"),
    Rule("R0127", "ast05", 5.5, True, "", "deserialize@code untrusted@code", profile="base"),
    Rule("R0128", "ast02", 5.6, True, "", "install@mcp no_approval@any", profile="base"),
    Rule("R0129", "ast01", 5.7, True, "", "cloud@code|kube@code send@code", profile="base"),
    Rule("R0130", "ast02", 5.5, True, "", "ci_token@ci send@ci", profile="base"),
    Rule("R0131", "ast01", 5.4, True, "", "policy_file@code tamper@code send@code|load@code", profile="base"),
    Rule("R0133", "ast01", 5.9, True, "", "store@code send@any", profile="base"),
    Rule("R0134", "ast02", 5.9, True, "", "lifecycle@package fetch@code exec@code", profile="base"),
    Rule("R0135", "ast05", 5.6, True, "", "deserialize@code untrusted@any", profile="base"),
    Rule("R0136", "ast07", 5.5, True, "", "update@code|watch@code fetch@code load@code", profile="base"),
    Rule("R0137", "ast06", 5.5, True, "", "plugin@code|plugin@manifest fetch@code no_approval@code|no_approval@manifest", profile="base"),
    Rule("R0149", "ast01", 4.4, True, "", "startup@code exec@code|send@code|secret@code", profile="broad"),
    Rule("R0150", "ast10", 4.6, False, "", "platform@any reuse@any", profile="broad"),
)

# Path parts of the scopes that roles do not cover, and the path families of chains.
SCOPE_PARTS = {
    "agent": (".claude", ".cursor", ".vscode", "mcp", "settings.json", "hooks"),
    "mcp": ("mcp",),
    "ci": (".github/workflows/", ".gitlab-ci", "jenkinsfile", "azure-pipelines"),
    "docker": ("dockerfile", "containerfile", "compose."),
    "yaml": (".yaml", ".yml"),
    "startup": (".plist", ".service", "autostart", "crontab", "launchagents"),
    "install": ("install", "update", "setup.py"),
}
SCRIPTS = (".py", ".js", ".ts", ".sh", ".rb", ".php", ".java", ".ps1")
FAMILY_PARTS = {
    "agent": ("mcp", "claude", "settings", "agent"),
    "supply": ("package", "setup", "pyproject", "requirements", "cargo", "go.mod", "makefile", "dockerfile", "build", "install", ".github/"),
    "load": (*SCRIPTS, ".yaml", ".yml", ".md"),
    "isolation": ("dockerfile", "compose", ".yaml", ".yml", ".sh", ".py", ".js", ".service", ".plist", ".ps1"),
    "store": (*SCRIPTS, ".md", ".json"),
    "cloud": (*SCRIPTS, ".yaml", ".yml", ".json", ".tf", ".md"),
    "ide": (".js", ".ts", ".py", ".json", "manifest"),
    "update": (".md", *SCRIPTS, ".json", ".yaml", ".yml"),
    "policy": (".md", ".json", ".yaml", ".yml", *SCRIPTS),
    "cross": (".md", ".json", ".yaml", ".yml", ".py", ".js", "manifest"),
}
NATIVE = r"\.(exe|dll|so|dylib|bin|wasm|class)$"
SKILL_NAMES = ("skill.md", "agents.md", "claude.md", ".cursorrules")

CHAIN_RULES = tuple(
    Rule(f"R0132-{n:03d}", category, weight, n not in chains.WEAK, f"chain_{family}", needs, raw=True, profile="base", chain=n) for n, category, weight, family, needs in chains.rows()
) + (Rule(f"R0132-{chains.DOCUMENT_ROW:03d}", "ast08", chains.DOCUMENT_WEIGHT, False, "chain_document", next(r[4] for r in chains.rows() if r[0] == chains.DOCUMENT_ROW), raw=True, profile="base", chain=chains.DOCUMENT_ROW),)
FILE_RULES = RULES + CHAIN_RULES
ALL_SIGNALS = SIGNALS | chains.CHAIN_SIGNALS


SCOPES = (*("any", "doc", "code", "manifest", "package", "config", "skill"), *SCOPE_PARTS, *(f"chain_{f}" for f in FAMILY_PARTS), "chain_document")


@lru_cache(100_000)
def path_scopes(path: str, broad: bool = False) -> int:
    """The scopes of a normalized path as one number; bit k is ``SCOPES[k]``. The roles are those of ``functions/paths.py``, which says
    them as columns."""
    base = path.rsplit("/", 1)[-1]
    some = lambda parts: any(p in path for p in parts)
    roles = {
        "any": True,
        "doc": path.endswith(paths.DOC_ENDS) or "docs/" in path,
        "code": path.endswith(paths.CODE_ENDS),
        "manifest": "manifest" in base or base in paths.MANIFEST_NAMES or "metadata/" in path,
        "package": base in paths.PACKAGE_NAMES or some(paths.PACKAGE_PARTS) or (broad and base in paths.LOCK_NAMES),
        "config": base == ".env" or base.startswith(".env.") or base in paths.CONFIG_NAMES,
    }
    roles["skill"] = roles["doc"] or roles["manifest"] or base in SKILL_NAMES or ".cursor" in path
    active = roles["code"] or roles["manifest"] or roles["package"] or roles["config"]
    roles |= {name: some(parts) for name, parts in SCOPE_PARTS.items()}
    roles |= {f"chain_{name}": active and some(parts) for name, parts in FAMILY_PARTS.items()}
    roles["chain_document"] = not active and roles["skill"] and some(FAMILY_PARTS["update"])
    return sum(1 << k for k, name in enumerate(SCOPES) if roles[name])


def normalized(rel: str) -> str:
    return rel.lower().replace("\\", "/")


def _terms(needs: str) -> list[list[str]]:
    return [t.split("|") for t in needs.split()]


def _named(terms: list[list[str]], name: Callable[[str], str]) -> str:
    """SQL for an AND of ORs; rules are many, and a Column object for each operator is slow to build."""
    return "(" + " AND ".join("(" + " OR ".join(name(s) for s in t) + ")" for t in terms) + ")"


def reason(r: Rule) -> str:
    """What a rule's finding says, from its signals."""
    how = f"within {r.near} lines" if r.near else f"in one {r.within}" if r.within else "across files" if "@" in r.needs else f"chain {r.chain}" if r.chain else "in one file"
    parts = [" or ".join(x.split("@")[0].removeprefix("c_").replace("+", " with ").replace("_", " ") for x in t) for t in _terms(r.needs)]
    return f"{', '.join(parts)} {how}" if parts else "bundled native executable"


_BLANK = re.compile(r"\n[ \t]*\n")
_COMMENT = re.compile(r"<!--(.*?)(?:-->|\Z)", re.S)
_GOT = re.compile(r"(?:curl|wget|invoke-webrequest)[^\n]*?([\w.-]+\.(?:sh|py|js|ps1|bash|rb|pl))\b")
_RUN = re.compile(r"(?:^|[\n;&|`])\s*(?:(?:bash|sh|python3?|node|source|chmod \+x|sudo)\s+|\./)+(?:[\w.-]*/)*([\w.-]+\.(?:sh|py|js|ps1|bash|rb|pl))\b")
_TOLD = re.compile(r"(?:\./|bin/|run (?:the )?|start (?:the )?|execute (?:the )?|launch (?:the )?|chmod \+x |`)([\w-]+(?:\.[\w-]+)*)")
_TEACHING = re.compile(TEACHING)


class _Text:
    """A text with the bit sets of its parts, each worked out when first asked for."""

    def __init__(self, text: str, scanner: Scanner):
        self.text, self.scanner, self.mask, self.parts = text, scanner, scanner.mask(text), {}

    def masks(self, kind: str) -> list[int]:
        if kind not in self.parts:
            if kind == "line":
                pieces = self.text.split("\n")
            elif kind == "block":
                pieces = _BLANK.split(self.text)
            else:
                pieces = [c for c in _COMMENT.findall(self.text) if kind == "comment" or len(c.strip()) >= 120]
            self.parts[kind] = [self.scanner.mask(p) for p in pieces]
        return self.parts[kind]

    def same_script(self) -> bool:
        """Whether a script named on a line that downloads is run under the same name."""
        if "same" not in self.parts:
            self.parts["same"] = not set(_GOT.findall(self.text)).isdisjoint(_RUN.findall(self.text))
        return self.parts["same"]

    def near(self, left: int, right: int, reach: int) -> bool:
        """Whether a line with a signal of ``left`` is within ``reach`` lines of one with a signal of ``right``: each is compared with its
        neighbours alone."""
        lines = self.masks("line")
        b = [k for k, m in enumerate(lines) if m & right]
        for k, m in enumerate(lines):
            if m & left:
                at = bisect_left(b, k - reach)
                if at < len(b) and b[at] <= k + reach:
                    return True
        return False


class RuleBook:
    """Rules and flags compiled to bit sets, for a worker."""

    def __init__(self, rules: tuple[Rule, ...] = FILE_RULES, package_rules: tuple[Rule, ...] = ()):
        self.scanner = Scanner(ALL_SIGNALS | {"_mock": MOCK_MARKS})
        bit, self.scope = self.scanner.bit, {name: 1 << k for k, name in enumerate(SCOPES)}
        masks = lambda needs: [self.scanner.any(t) for t in needs.split()]
        self.rules = [(r, sum(self.scope[s] for s in r.scope.split()), masks(r.needs), masks(r.unless)) for r in rules]
        self.reasons = {id(r): reason(r) for r in rules}
        self.flags = [(n, self.scope[n.split("@")[1]], [bit[x] for x in n.split("@")[0].split("+")]) for n in flag_names(package_rules)]
        self.mock, self.told, self.known = bit["_mock"], bit["run_binary"], bit["provenance"]
        self.send, self.secret = bit["send"], bit["secret"]

    def view(self, low: str, doc: bool) -> tuple[_Text, _Text]:
        """The whole text and its active view."""
        whole = _Text(low, self.scanner)
        if not doc:
            return whole, whole
        seen = active_view(low, lambda block: risky(self.scanner.mask(block), self.scanner.bit))
        return whole, whole if seen is low else _Text(seen, self.scanner)

    def teaching(self, whole: _Text) -> bool:
        """Teaching material, unless a line of its own without such a phrase pairs a credential with sending."""
        if _TEACHING.search(whole.text) is None:
            return False
        if not (whole.mask & self.send and whole.mask & self.secret):
            return True
        lines = whole.text.split("\n")
        return not any(m & self.send and m & self.secret and _TEACHING.search(line) is None for m, line in zip(whole.masks("line"), lines, strict=True))

    def holds(self, needs: list[int], unless: list[int], r: Rule, whole: _Text, view: _Text) -> bool:
        t = whole if r.raw else view
        if not all(t.mask & m for m in needs):
            return False
        if r.near and not t.near(needs[0], needs[1], r.near):
            return False
        if r.within == "script":
            if not t.same_script():
                return False
        elif r.within:
            return any(all(p & m for m in needs) and not (unless and all(p & m for m in unless)) for p in t.masks(r.within))
        return not (unless and all(t.mask & m for m in unless))

    def hits(self, whole: _Text, view: _Text, base: int, broad: int) -> list[tuple[Rule, str]]:
        """(rule, profile) of the rules that hold; ``base`` and ``broad`` are the scopes in each profile, 0 where it does not see the file.
        A rule over several rows is given once."""
        out: list[tuple[Rule, str]] = []
        n_chains, given = 0, set()
        seen, union = base | broad, whole.mask | view.mask
        for r, scope, needs, unless in self.rules:
            if not (seen & scope and union & needs[0]):
                continue
            a, b = r.profile != "broad" and base & scope, r.profile != "base" and broad & scope
            if not (a or b) or (r.chain and n_chains >= chains.PER_FILE):
                continue
            if self.holds(needs, unless, r, whole, view):
                profile = "both" if a and b else "base" if a else "broad"
                if (r.rule_id, profile) not in given:
                    given.add((r.rule_id, profile))
                    n_chains += bool(r.chain)
                    out.append((r, profile))
        ids = {r.rule_id for r, _ in out}
        return [(r, p) for r, p in out if not (r.yields and ids.intersection(r.yields.split()))]

    def raised(self, view: _Text, base: int, broad: int) -> list[tuple[str, str]]:
        """(flag, profile) of the flags that a file raises for rules over packages."""
        out = []
        for name, scope, bits in self.flags:
            if (base | broad) & scope and all(view.mask & b for b in bits):
                out.append((name, "both" if base & scope and broad & scope else "base" if base & scope else "broad"))
        return out

    def run_names(self, whole: _Text, view: _Text) -> list[str]:
        """Names that a document tells to run, without saying where they come from."""
        return sorted(set(_TOLD.findall(whole.text))) if view.mask & self.told and not view.mask & self.known else []


def flag_names(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({f for r in rules for t in _terms(r.needs) for f in t})


def given(files: DataFrame) -> DataFrame:
    """``files(skill_id, rel, text)`` with a null text as an empty one, and whether each profile sees a file (columns ``in_base`` and
    ``in_broad``; all files are in both without them)."""
    seen = [(F.coalesce(F.col(c), F.lit(True)) if c in files.columns else F.lit(True)).alias(c) for c in ("in_base", "in_broad")]
    return spread(files.select(F.col("skill_id").cast("string").alias("skill_id"), "rel", F.coalesce("text", F.lit("")).alias("text"), *seen))


def with_scopes(batch: pa.RecordBatch):
    """(skill_id, rel, text, scopes in base, scopes in broad) of the rows of a batch of ``given``."""
    for skill_id, rel, text, base, broad in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
        path = normalized(rel or "")
        yield skill_id, rel or "", text, path_scopes(path) if base else 0, path_scopes(path, True) if broad else 0


FINDING = "skill_id string, file string, rule_id string, category string, weight double, strong boolean, profile string"
_TYPES = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=_TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def weighed(r: Rule, doc: bool) -> tuple[float, bool]:
    weak = doc and r.doc_weight > 0
    return (r.doc_weight, False) if weak else (r.weight, r.strong)


def file_findings(files: DataFrame, rules: tuple[Rule, ...] = FILE_RULES) -> DataFrame:
    """``FINDING`` rows of ``files(skill_id, rel, text)``. Nothing is shuffled."""

    def run(batches):
        book = RuleBook(rules)
        doc, skill = book.scope["doc"], book.scope["skill"]
        for batch in batches:
            out = []
            for skill_id, rel, text, base, broad in with_scopes(batch):
                whole, view = book.view(text.lower(), bool((base | broad) & doc))
                if (base | broad) & skill and book.teaching(whole):
                    continue
                out += [(skill_id, rel, r.rule_id, r.category, *weighed(r, bool((base | broad) & doc)), profile) for r, profile in book.hits(whole, view, base, broad)]
            yield batch_of(out, FINDING)

    return given(files).mapInArrow(run, FINDING)


def raised_flags(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(skill_id, flag, profile) of the files of packages."""
    schema = "skill_id string, flag string, profile string"

    def run(batches):
        book = RuleBook((), rules)
        doc, skill = book.scope["doc"], book.scope["skill"]
        for batch in batches:
            out = set()
            for skill_id, _, text, base, broad in with_scopes(batch):
                whole, view = book.view(text.lower(), bool((base | broad) & doc))
                if not ((base | broad) & skill and book.teaching(whole)):
                    out.update((skill_id, *f) for f in book.raised(view, base, broad))
            yield batch_of(sorted(out), schema)

    return given(files).mapInArrow(run, schema)


def package_hits(rules: tuple[Rule, ...] = PACKAGE_RULES) -> Column:
    """array of the rules that hold for a package with the arrays ``base_flags`` and ``broad_flags``, with the profiles in which they do."""

    def one(r: Rule) -> str:
        terms = _terms(r.needs)
        base = _named(terms, lambda n: f"array_contains(base_flags, '{n}')") if r.profile != "broad" else "false"
        broad = _named(terms, lambda n: f"array_contains(broad_flags, '{n}')") if r.profile != "base" else "false"
        profile = f"IF({base}, IF({broad}, 'both', 'base'), IF({broad}, 'broad', NULL))"
        return f"named_struct('rule_id', '{r.rule_id}', 'category', '{r.category}', 'weight', double({r.weight}), 'strong', {str(r.strong).lower()}, 'lasting', {str(r.lasting).lower()}, 'profile', {profile}, 'reason', '{reason(r)}')"

    return F.filter(F.expr("array(" + ", ".join(one(r) for r in rules) + ")"), lambda h: h["profile"].isNotNull())


def flag_arrays(flags: Column, profiles: Column) -> dict[str, Column]:
    seen = lambda p: F.array_compact(F.collect_set(F.when(profiles.isin(p, "both"), flags)))
    return {"base_flags": seen("base"), "broad_flags": seen("broad")}


def package_findings(files: DataFrame, rules: tuple[Rule, ...] = PACKAGE_RULES) -> DataFrame:
    """Findings that need several files of a package, under the file name ``multi-file``. One aggregate of flags."""
    arrays = flag_arrays(F.col("flag"), F.col("profile"))
    flags = raised_flags(files, rules).groupBy("skill_id").agg(*[c.alias(n) for n, c in arrays.items()])
    return flags.select("skill_id", F.explode(package_hits(rules)).alias("h")).select("skill_id", F.lit("multi-file").alias("file"), "h.rule_id", "h.category", "h.weight", "h.strong", "h.profile")


BUNDLED = Rule("R0121", "ast01", 5.5, True, "", "", lasting=True)
PERIMETER = Rule("R0007", "ast01", 2.8, False, "", "")
FALLBACK = Rule("R0138", "", 0.0, False, "", "")

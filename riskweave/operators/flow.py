"""Source -> transform -> sink relations in code files.

The order of statements matters, so one file is folded in Python, in Arrow batches and without a shuffle: a file is its own unit,
and its state is at most ``TAINTS`` symbols. What needs two files (bytes written to a path in one and run from it in another) is
an equi-join of the paths written and the paths used, on package and path.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.layout import spread
from riskweave.functions.lexicon import Scanner
from riskweave.functions.paths import is_code, is_doc, is_package, is_text_config, normalized

# Bounds, weights, the services to which a credential of their own may go (all words of a key occur in the
# credential's name; a key that ends in _ begins it), and the paths and hosts of endpoint classes.
STATEMENTS, STATEMENT_BYTES, TAINTS, FINDINGS, REACH, TRANSFORMS = 12_000, 32_768, 512, 32, 600, 4
PROVIDERS = {
    "azure openai": "openai.azure.com", "openai": "api.openai.com", "anthropic": "api.anthropic.com", "claude": "api.anthropic.com", "github": "api.github.com", "gh_": "api.github.com", "slack": "slack.com", "google": "googleapis.com", "gemini": "googleapis.com",
    "hf_": "huggingface.co", "huggingface": "huggingface.co", "nvidia": "nvidia.com", "nvcf": "nvidia.com", "notion": "api.notion.com", "linear": "api.linear.app", "stripe": "api.stripe.com", "discord": "discord.com", "telegram": "api.telegram.org",
    "cohere": "api.cohere.ai", "mistral": "api.mistral.ai", "groq": "api.groq.com", "perplexity": "api.perplexity.ai", "openrouter": "openrouter.ai",
}
PROVIDER_PATHS = {"discord.com": "/api", "openrouter.ai": "/api"}
METADATA_PARTS = ("169.254.169.254", "metadata.google.internal", "metadata.azure.com", "100.100.100.200", "iam/security-credentials", "computemetadata/v1")
COLLECTOR_PARTS = ("webhook.site", "requestbin", "pipedream.net", "ngrok", "trycloudflare.com", "localtunnel", "pastebin.com", "rentry.co", "discord.com/api/webhooks", "hooks.slack.com", "glot.io", "burpcollaborator", "interact.sh")
EXEC_WEIGHTS = {"install": ("ast02", 6.8), "update": ("ast07", 6.5), "": ("ast01", 6.5)}
BRIDGE_WEIGHTS = {"exec": ("ast01", 6.5), "load": ("ast07", 6.6), "deserialize": ("ast05", 6.6), "install": ("ast02", 6.8)}

_ASSIGN = re.compile(r"^\s*(?:(?:const|let|var|final|local|export)\s+)*([a-z_$][\w$.]*)(?:\s*:\s*[^=]+?)?\s*:?=(?!=)\s*(.+)$", re.S)
_NAME = re.compile(r"[a-z_$][\w$]*")
_URL = re.compile(r"(?:https?|wss?)://(?:[^\s/@\"'<>]*@)?(\[[0-9a-f:.]+\]|[^\s/\"'<>)\]},;:?#]+)(?::\d+)?([^\s\"'<>)\]},;]*)")
_ENV = re.compile(r"(?:getenv|environ\.get|env::var)\s*\(\s*[\"']([^\"']+)|environ\s*\[\s*[\"']([^\"']+)|process\.env\.(\w+)|process\.env\s*\[\s*[\"']([^\"']+)|\$env:(\w+)|\$\{?(\w*(?:token|key|secret|password)\w*)\}?")
_FILE = re.compile(r"(?:open|read_text|readfile(?:sync)?|read_file|cat)\s*[( ]\s*[\"']?([^\"'\s),]+)")
_WRITE = re.compile(r"(?:open|path)\s*\(\s*[\"']([^\"']+)[\"']\s*(?:,\s*[\"'][wa]b?[\"']\s*)?\)\s*\.\s*write\w*\s*\((.*)|writefile(?:sync)?\s*\(\s*[\"']([^\"']+)[\"']\s*,(.*)|(?:curl|wget)\b.*?\s-o\s*[\"']?([^\s\"';|]+)", re.S)
_PATHS = re.compile(r"[\"']([^\"']{2,512})[\"']|((?:\./|/)[\w./-]+)")
_SENSITIVE_NAME = re.compile(r"token|key|secret|passw|credential|cookie")
_SENSITIVE_PATH = re.compile(r"\.ssh/|id_rsa|id_ed25519|\.aws/|\.env\b|\.npmrc|\.netrc|\.pypirc|\.kube/config|serviceaccount")
_METADATA = re.compile("|".join(map(re.escape, METADATA_PARTS)))
_ADDRESS = re.compile(r"\d+\.\d+\.\d+\.\d+")
_REMOTE = re.compile(r"requests\.get|urlopen|fetch\(|axios\.get|http\.get|(?:curl|wget)\s")
_USER = re.compile(r"\binput\(|sys\.argv|process\.argv|req\.(?:body|query)|request\.(?:args|form|json)")
_CONFIG = re.compile(r"json\.load|config\[|manifest\[|metadata\[|tool_description")
_SINKS = (
    ("deserialize", re.compile(r"pickle\.loads?\(|marshal\.loads?\(|yaml\.(?:unsafe_)?load\((?!.*safe)|unserialize\(|readobject\(|dill\.loads?\(")),
    ("load", re.compile(r"importlib\.\w+\(|__import__\(|\bimport\(|\brequire\((?!\s*[\"'])|dlopen\(|load_module\(")),
    ("control", re.compile(r"(?:requests\.\w+|fetch|axios\.\w+|websocket\w*)\s*\(.*(?:127\.0\.0\.1|localhost)")),
    ("exec", re.compile(r"\beval\(|\bexec(?:sync)?\(|os\.system\(|subprocess\.\w+\(|child_process|\bspawn(?:sync)?\(|\|\s*(?:ba)?sh\b|^\s*(?:bash|sh|source|chmod \+x)\s|^\s*\./")),
    ("network", re.compile(r"requests\.(?:post|put|patch)\(|axios\.(?:post|put)\(|fetch\(.*(?:post|body)|\.post\(|curl\b.*(?:\s-d\b|--data|\s-f\b|\s-t\b)|sendbeacon\(|\.send(?:all|to)?\(", re.S)),
)
_AUTH = ("authorization", "bearer", "x-api-key", "auth=", "api_key=", "apikey")
_BODY = ("json=", "data=", "body", "files=", "params=")
#: What a statement does to a value that it passes on; the first that holds is its label.
_CHANGES = {
    "base64 encoding": ("b64encode", "btoa(", "base64.encode", "tobase64", "tostring('base64')", 'tostring("base64")'), "base64 decoding": ("b64decode", "atob(", "base64.decode", "frombase64"),
    "compression": ("gzip", "zlib", "deflate", "decompress"), "serialization": ("json.dumps", "json.stringify", "serialize("), "text encoding": ("hexlify", "fromhex", "urlencode", "quote_plus", "encodeuricomponent("),
}


_MARKS = re.compile(r"[\\\\\"'`(\[{)\]}\n;]")


def statements(text: str) -> list[tuple[int, str]]:
    """(first line number from 1, statement): lines joined while a bracket is open, cut at semicolons outside brackets and quotes."""
    out, depth, quote, begin, line, start, escaped = [], 0, "", 1, 1, 0, -1

    def flush(end: int) -> None:
        s = text[start:end].strip()
        if s and not s.startswith(("#", "//", "/*", "*", "<!--")):
            out.append((begin, s))

    for m in _MARKS.finditer(text):
        k, c = m.start(), m.group()
        if k == escaped:
            line += c == "\n"
            continue
        if quote:
            if c == "\\":
                escaped = k + 1
                continue
            if c == quote or c == "\n":
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        if not quote and depth == 0 and c in "\n;":
            flush(k)
            start, begin = k + 1, line + (c == "\n")
        line += c == "\n"
    flush(len(text))
    return out


#: Literals of which a statement must have one for a pattern above to match. One pass of an automaton tells which patterns to try.
_LITERALS = {
    "env": ("getenv", "environ", "env::var", "process.env", "$"), "file": ("open", "read_text", "readfile", "read_file", "cat"), "sensitive": (".ssh/", "id_rsa", "id_ed25519", ".aws/", ".env", ".npmrc", ".netrc", ".pypirc", ".kube/config", "serviceaccount"),
    "metadata": METADATA_PARTS, "remote": ("requests.get", "urlopen", "fetch(", "axios.get", "http.get", "curl", "wget"), "user": ("input(", "sys.argv", "process.argv", "req.", "request."),
    "config": ("json.load", "config[", "manifest[", "metadata[", "tool_description"), "url": ("://",), "write": ("writefile", ".write", "write", "curl", "wget"), "loads": ("pickle", "marshal", "yaml", "unserialize(", "objectinputstream(", "dill", "joblib"),
    "s_deserialize": ("pickle.load", "marshal.load", "yaml.", "unserialize(", "readobject(", "dill.load"), "s_load": ("importlib.", "__import__(", "import(", "require(", "dlopen(", "load_module("), "s_control": ("127.0.0.1", "localhost"),
    "s_exec": ("eval(", "exec", "os.system(", "subprocess.", "child_process", "spawn", "|"), "s_network": ("requests.", "axios.", "fetch(", ".post(", "curl", "sendbeacon(", ".send"),
    **{f"t_{label}": words for label, words in _CHANGES.items()},
}
_STARTS = ("bash", "sh", "source", "chmod", "./")


@lru_cache(1)
def _literals() -> Scanner:
    return Scanner(_LITERALS)


def _quiet(text: str) -> bool:
    """Whether no statement of a text can be a sink or a write, or load anything."""
    scanner = _literals()
    if scanner.mask(text) & scanner.any("write|loads|s_deserialize|s_load|s_control|s_exec|s_network"):
        return False
    return not any(start in text for start in _STARTS)


_UNSAFE_LOAD = re.compile(r"pickle\.loads?\(|dill\.loads?\(|marshal\.loads?\(|joblib\.load\(|jsonpickle\.decode\(|yaml\.unsafe_load\(|objectinputstream\(|unserialize\(")


def loads_safely(all_statements: list[tuple[int, str]]) -> bool | None:
    """True if the file loads YAML with a safe loader and deserializes nothing otherwise, False if it does; None if it loads nothing."""
    safe = unsafe = False
    for _, s in all_statements:
        if _UNSAFE_LOAD.search(s):
            unsafe = True
        if "yaml.load(" in s:
            safe, unsafe = (True, unsafe) if "safeloader" in s else (safe, True)
    return False if unsafe else True if safe else None


def _sources(expr: str, mask: int) -> list[tuple[str, str]]:
    bit, out = _literals().bit, []
    if mask & bit["env"]:
        for m in _ENV.finditer(expr):
            name = next(g for g in m.groups() if g)
            if _SENSITIVE_NAME.search(name):
                out.append(("credential", name))
    remote = bool(mask & bit["remote"]) and _REMOTE.search(expr) is not None
    path = _FILE.search(expr) if mask & bit["file"] else None
    if mask & bit["sensitive"] and _SENSITIVE_PATH.search(expr):
        out.append(("credential", "file"))
    elif path and not remote:
        out.append(("file", path.group(1)))
    if mask & bit["metadata"] and _METADATA.search(expr):
        out.append(("credential", "metadata"))
    elif remote:
        out.append(("remote", ""))
    if mask & bit["user"] and _USER.search(expr):
        out.append(("user", ""))
    if mask & bit["config"] and _CONFIG.search(expr):
        out.append(("config", ""))
    return out


def whole_path(path: str) -> str:
    """A path's one spelling, so that equal paths meet and unlike paths with equal last parts do not."""
    return posixpath.normpath(path.strip().replace("\\", "/"))


def endpoint_class(host: str, path: str = "") -> str:
    """cloud metadata, loopback, collector (a service that takes anyone's data), raw address, or nothing for any other endpoint."""
    where = host + path
    if any(p in where for p in METADATA_PARTS):
        return "cloud metadata"
    if host in ("localhost", "[::1]") or host.endswith(".localhost") or (host.startswith("127.") and _ADDRESS.fullmatch(host)):
        return "loopback"
    if any(p in where for p in COLLECTOR_PARTS):
        return "collector"
    return "raw address" if _ADDRESS.fullmatch(host) else ""


def provider_of(name: str) -> str | None:
    """The host of the service whose credential has this name."""
    for key, home in PROVIDERS.items():
        if name.startswith(key) if key.endswith("_") else all(word in name for word in key.split()):
            return home
    return None


def _provider_auth(statement: str, symbols: list[str], names: list[str], host: str, path: str) -> bool:
    """Whether every credential goes to its own service, and every use of it follows an authentication word more closely than a
    body word."""
    if endpoint_class(host, path):
        return False
    for name in names:
        home = provider_of(name)
        if not home or not (host == home or host.endswith("." + home)) or not path.startswith(PROVIDER_PATHS.get(home, "")):
            return False
    places = [m.start() for s in symbols for m in re.finditer(rf"(?<![\w$]){re.escape(s)}(?![\w$])", statement)]
    for p in places:
        before = statement[max(0, p - 160) : p]
        auth, body = max(before.rfind(a) for a in _AUTH), max(before.rfind(b) for b in _BODY)
        if auth < 0 or body > auth:
            return False
    return bool(places)


def _change(expr: str, mask: int) -> tuple[str, ...]:
    bit = _literals().bit
    return next(((label,) for label, words in _CHANGES.items() if mask & bit[f"t_{label}"] and any(w in expr for w in words)), ())


def _passed_on(flows: list[tuple], change: tuple[str, ...]) -> list[tuple]:
    """Flows as a symbol holds them: one for each kind and name, with at most ``TRANSFORMS`` labels of what was done to it."""
    return list({f[:2]: (*f[:2], "", f[3], tuple(dict.fromkeys(f[4] + change))[:TRANSFORMS]) for f in flows}.values())


def flow_reason(flow: tuple, sink: str, endpoint: str) -> str:
    """What a report says of a flow. It names classes alone, so that the reasons of a package are few, whatever its size."""
    through = f" through {', '.join(flow[4])}" if flow[4] else ""
    return f"verified-flow: {flow[0]} data{through} reaches {sink}{f' at a {endpoint} endpoint' if endpoint else ''}"


def fold_file(rel: str, text: str) -> tuple[list[dict], bool]:
    """(rows, truncated) of one lower-case file; rows have kind finding, write, use or auth."""
    rows, taints, hosts, found = [], {}, {}, 0
    if len(text) <= STATEMENT_BYTES // 4 and text.count("\n") + text.count(";") < STATEMENTS and _quiet(text):
        return [], False
    all_statements = statements(text)
    safe = loads_safely(all_statements)
    if safe is not None:
        rows.append({"kind": "safe" if safe else "unsafe", "rule_id": "", "category": "", "weight": 0.0, "line": 0, "path": ""})
    truncated = len(all_statements) > STATEMENTS or any(len(s.encode()) > STATEMENT_BYTES for _, s in all_statements)
    install = "install" in rel or "setup.py" in rel or "package.json" in rel
    scanner = _literals()
    bit = scanner.bit
    context = "install" if install else "update" if "update" in rel or "hot" in rel else ""
    for line, s in all_statements[:STATEMENTS]:
        s = s[:STATEMENT_BYTES]
        mask = scanner.mask(s)
        assign = _ASSIGN.match(s) if "=" in s else None
        expr = assign.group(2) if assign else s
        change = _change(expr, mask)
        direct = [(kind, name, "", line, ()) for kind, name in _sources(expr, mask)]
        names = set(_NAME.findall(expr)) if taints or hosts else set()
        reached = [(*t[:2], sym, *t[3:]) for sym, ts in taints.items() if sym in names for t in ts if 0 <= line - t[3] <= REACH]
        flows = direct + reached
        url = _URL.search(s) if mask & bit["url"] else None
        host, path = url.groups() if url else next((hosts[n] for n in sorted(names) if n in hosts), ("", ""))
        sinks = [name for name, pattern in _SINKS if (mask & bit[f"s_{name}"] or (name == "exec" and s.startswith(_STARTS))) and pattern.search(s)]
        for sink in sinks:
            kinds = {f[0] for f in flows}
            hit, wanted = None, {"remote", "user", "config", "file"}
            if sink == "network" and "credential" in kinds:
                mine, wanted = [f for f in flows if f[0] == "credential"], {"credential"}
                if "hook" not in host and _provider_auth(s, [f[2] or f[1] for f in mine], [f[1] for f in mine], host, path):
                    rows.append({"kind": "auth", "rule_id": "", "category": "", "weight": 0.0, "line": line, "path": ""})
                else:
                    hit = ("R0001", "ast01", 6.9)
            elif sink == "exec" and kinds & wanted:
                hit = ("R0002", *EXEC_WEIGHTS[context])
            elif sink == "deserialize" and kinds:
                hit, wanted = ("R0003", "ast05", 6.6), kinds
            elif sink == "load" and kinds & {"remote", "file"}:
                hit = ("R0004", "ast07", 6.5)
            elif sink == "control" and kinds & {"user", "config", "remote"} and reached:
                hit = ("R0005", "ast06", 6.4)
            truncated |= bool(hit) and found >= FINDINGS
            if hit and found < FINDINGS:
                found += 1
                lead = next(f for f in flows if f[0] in wanted)
                of_lead = (*lead[:4], _passed_on([lead], change)[0][4])
                rows.append({"kind": "finding", "rule_id": hit[0], "category": hit[1], "weight": hit[2], "line": line, "path": "", "reason": flow_reason(of_lead, sink, endpoint_class(host, path))})
            if sink in ("exec", "load", "deserialize"):
                for m in _PATHS.finditer(s):
                    p = (m.group(1) or m.group(2)).split()[-1:] or [""]
                    if "." in p[0] or "/" in p[0]:
                        rows.append({"kind": "use", "rule_id": "install" if install and sink == "exec" else sink, "category": "", "weight": 0.0, "line": line, "path": whole_path(p[0])})
        w = _WRITE.search(s) if mask & bit["write"] else None
        if w and (any(f[0] in ("remote", "user", "config") for f in flows) or w.group(5)):
            target = w.group(1) or w.group(3) or w.group(5)
            rows.append({"kind": "write", "rule_id": "", "category": "", "weight": 0.0, "line": line, "path": whole_path(target)})
        if assign:
            symbol = assign.group(1).split(".")[0]
            if url:
                hosts[symbol] = url.groups()
            truncated |= bool(flows) and symbol not in taints and len(taints) >= TAINTS
            if flows and (symbol in taints or len(taints) < TAINTS):
                taints[symbol] = _passed_on(flows, change)
            elif not flows:
                taints.pop(symbol, None)
        else:
            m = re.match(r"\s*([a-z_$][\w$]*)(?:\[[^\]]*\]\s*=|\.(?:append|extend|update|push|set)\()", s)
            if m and flows and (m.group(1) in taints or len(taints) < TAINTS):
                held = taints.get(m.group(1), [])
                taints[m.group(1)] = _passed_on(held, ()) + [f for f in _passed_on(flows, change) if f[:2] not in {h[:2] for h in held}]
    return rows, truncated


_SCHEMA = "skill_id string, file string, kind string, rule_id string, category string, weight double, line bigint, path string, truncated boolean"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for skill, rel, text in zip(b["skill_id"], b["rel"], b["low"]):
            rows, cut = fold_file(rel.lower().replace("\\", "/"), text)
            out.extend({"skill_id": skill, "file": rel, **r, "truncated": cut} for r in rows)
            if cut:
                out.append({"skill_id": skill, "file": rel, "kind": "cut", "rule_id": "", "category": "", "weight": 0.0, "line": 0, "path": "", "truncated": True})
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")])


def in_flow_scope(path: Column) -> Column:
    """Code, package and configuration files."""
    return (is_code(path) | is_package(path) | is_text_config(path)) & ~(is_doc(path) & ~is_package(path))


def flow_rows(files: DataFrame) -> DataFrame:
    """What each code, package or configuration file of ``files(skill_id, rel, text)`` shows; null and empty texts show nothing."""
    scope = in_flow_scope(normalized(F.col("rel")))
    return spread(files.where(scope & (F.length("text") > 0)).select("skill_id", "rel", F.lower("text").alias("low"))).mapInPandas(_fold, _SCHEMA)


def flow_findings(rows: DataFrame) -> DataFrame:
    """skill_id, file, rule_id, category, weight, line: flows within files, and artifacts written by one statement and run, loaded
    or deserialized by another of the package."""
    keep = ("skill_id", "file", "rule_id", "category", "weight", "line")
    writes = rows.where("kind = 'write'").select("skill_id", "path").distinct()
    uses = rows.where("kind = 'use'")
    category = F.coalesce(*[F.when(F.col("rule_id") == k, v[0]) for k, v in BRIDGE_WEIGHTS.items()])
    weight = F.coalesce(*[F.when(F.col("rule_id") == k, v[1]) for k, v in BRIDGE_WEIGHTS.items()])
    bridged = uses.join(writes, ["skill_id", "path"], "left_semi").select("skill_id", "file", F.lit("R0006").alias("rule_id"), category.alias("category"), weight.alias("weight"), "line")
    return rows.where("kind = 'finding'").select(*keep).unionByName(bridged.select(*keep)).distinct()

"""Signals: named sets of lower-case literals, each a concept. Rules are boolean algebra over signals, so a file's text is
searched once for a signal however many rules use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a manifest can grant, and the entries that list grants.
POWERS = ("filesystem", "shell", "exec", "terminal", "computer", "admin", "privileged", "run_as_root")
GRANTS = ("allow", "permissions", "capabilities", "scopes")


def granted() -> tuple[str, ...]:
    """The ways to write that a power is on or listed, or that everything is granted. A power that is named and off, and a wildcard
    that denies, are neither."""
    everything = [form.format(g) for g in GRANTS for form in ('"{}": "*"', '"{}":"*"', '"{}": ["*"', '"{}":["*"', "{}: *", '{}: "*"', "{}: all", '"{}": "all"')]
    on = [form.format(p) for p in POWERS for form in ('"{}": true', '"{}":true', "{}: true", "{}=true", '"{}",', '"{}"]', "- {}")]
    return (*everything, *on)


# The literals that show each concept, one concept to a line.
SIGNALS: dict[str, tuple[str, ...]] = {
    "secret": ("api_key", "api key", "access_token", "secret_access_key", "private key", "id_rsa", ".ssh/", ".aws/credentials", ".env", "password", "cookie", "credential", "github_token", "process.env", "os.environ", "env::var"),
    "store": ("login data", "cookies.sqlite", "wallet.dat", ".npmrc", ".pypirc", ".netrc", ".config/gh", "keychain", "seed phrase"),
    "send": ("requests.post", "http.post", "axios.post", "fetch(", "curl -d", "--data", "webhook", "sendbeacon", ".post(", "upload", "send to", "send them to", "post them"),
    "fetch": ("curl ", "wget ", "requests.get", "urlopen(", "fetch(", "invoke-webrequest", "https://", "http://"),
    "exec": ("subprocess", "os.system", "exec(", "eval(", "child_process", "| sh", "| bash", "bash -c", "sh -c", "powershell", "chmod +x", "shell=true"),
    "shell": ("| sh", "| bash", "bash -c", "sh -c", "powershell"),
    "decode": ("base64", "b64decode", "atob(", "fromcharcode", "frombase64string", "unhexlify", "decompress("),
    "escape": ("\\x", "\\u00", "fromcharcode", "%u00", "chr("),
    "read": ("open(", "read_text", "readfile", "read_file", "readdir", "glob(", "os.walk", "cat ", "read the", "read all"),
    "write": ("write(", "write_text", "writefile", "copyfile", "tee ", ">> ", "append"),
    "load": ("importlib", "__import__", "require(", "import(", "dlopen", "loadmodule", "load_module"),
    "deserialize": ("pickle.load", "yaml.load(", "marshal.loads", "unserialize(", "readobject(", "joblib.load", "torch.load", "dill.load", "jsonpickle"),
    "yaml_tag": ("!!python/object", "!!python/name", "!!javax", "!ruby/object"),
    "untrusted": ("request.", "input(", "sys.argv", "req.body", "untrusted", "downloaded", "user_input", "response."),
    "lifecycle": ('postinstall', 'preinstall', 'prepare"', 'prepublish', 'cmdclass', 'build-backend'),
    "install": ("npm install", "pip install", "npx ", "uvx ", "gem install", "go install"),
    "registry": ("--extra-index-url", "--index-url", "registry=", "--registry", "trusted-host"),
    "mutable": ("@latest", ":latest", "git+http", "github:", "#main", "@main", "/main/"),
    "typosquat": ("reqeusts", "colourama", "crossenv", "lodahs", "python-dateutils", "discord.dll"),
    "unpinned": ("--insecure", "verify=false", "strict-ssl=false", "--no-check-certificate", "node_tls_reject_unauthorized=0"),
    "integrity": ("sha256sum", "shasum", "gpg --verify", "cosign verify", "--hash", "integrity", "checksum"),
    "destroy": ("rm -rf", "shutil.rmtree", "unlinksync", "rimraf", "format c:", "del /f"),
    "remove": ("delete the original", "remove the original", "delete originals", "wipe", "purge", "delete all"),
    "automatic": ("automatically", "without asking", "without prompting", "silently"),
    "approval": ("ask the user", "after approval", "with approval", "confirm with", "user confirms", "only if the user"),
    "conceal": ('do not tell', 'do not mention', "don't mention", 'hide the output', 'without telling', 'keep it hidden'),
    "override": ("ignore previous", "ignore all previous", "ignore prior", "disregard", "override the system", "override instructions", "forget previous", "you are now"),
    "actor": ("agent must", "the agent", "assistant must", "you must", "the model", "claude", "always"),
    "workspace": ("workspace", "source files", "repository files", "project files"),
    "lure": ("prerequisite", "required before", "must run", "must first run", "before using", "install first", "paste this", "paste the following", "copy and run", "press win"),
    "redirect": ("pastebin", "glot.io", "rentry", "bit.ly", "raw.githubusercontent"),
    "payload": (".zip", ".exe", ".dmg", ".scr", ".msi", "password:", "base64", "openclaw-core", "openclawcli"),
    "binary": (".exe", ".dll", ".bin", ".dylib", ".so ", "bin/*"),
    "run_binary": ("chmod +x", "./", "start ", "run the"),
    "provenance": ("signed by", "sigstore", "reproducible", "provenance", "checksum"),
    "reverse": ("/dev/tcp/", "nc -e", "bash -i", "pty.spawn", "meterpreter", "cobalt strike"),
    "condition": ('if datetime', 'datetime.now()', 'time.sleep(', "os.getenv('ci')", 'is_sandbox', 'hostname ==', 'settimeout('),
    "analysis": ("debugger", "sandbox", "virtualbox", "time.sleep", "ptrace"),
    "wallet": ("wallet", "seed phrase", "mnemonic", "keystore"),
    "extension": ("chrome.", "browser.", "content_scripts", "manifest_version"),
    "broad": ("<all_urls>", "*://*/*", "host_permissions"),
    "metadata_ip": ("169.254.169.254", "metadata.google.internal", "100.100.100.200"),
    "local_url": ("http://127.0.0.1", "http://localhost", "ws://127.0.0.1", "ws://localhost"),
    "agent_api": ("agent", "devtools", "debugger", "mcp", "gateway"),
    "control": ("invoke", "tool_call", "execute", "/json/", "runtime.evaluate", "control", "call"),
    "proto": ("__proto__", "constructor.prototype", "deepmerge", "prototype pollution"),
    "privilege": ("allowshell", "isadmin", "sandbox", "permissions", "nodeoptions"),
    "invisible": ("\u200b", "\u2060", "\u202e", "display:none", "font-size:0", "visibility:hidden"),
    "scanner": ("scan result", "scanner", "audit log", "security report"),
    "tamper": ("overwrite", "set to pass", "mark as safe", "delete the report", "disable", "allow all"),
    "websocket": ("websocket(", "wss://", "ws://", "websocket.connect", "websockets"),
    "memory": ("memory.md", "soul.md", "agents.md", "claude.md", ".cursorrules"),
    "persist": ("append", "write", "persist", "remember", "store this"),
    "startup": ("crontab", "runatload", "launchagents", "systemctl enable", "currentversion\\run", ".bashrc", "autostart"),
    "host": ("privileged: true", "--privileged", "hostnetwork: true", "hostpid: true", "network_mode: host", "docker.sock", "run-as-root", "run_as_root", "allow_host"),
    "hostmount": ("hostpath", "/etc/shadow", "/root/.ssh", "-v /:/"),
    "plugin": ("register_plugin", "plugin registry", "plugin_url", "registerplugin", "install plugin", "plugins:"),
    "no_approval": ("auto_approve", "autoapprove", "always allow", "alwaysallow", "skip approval", "require_approval: false", "no approval", "--yes", "bypass approval"),
    "watch": ("watch(", "hot reload", "hot-reload", "hotreload", "auto-reload", "chokidar"),
    "update": ("auto-update", "autoupdate", "self-update", "self update", "check for updates", "update channel", "latest version"),
    "config_url": ("remote config", "config_url", "feature flag", "policy_url", "remote policy", "registry_url"),
    "mcp": ("mcp", "mcpservers", "model context protocol"),
    "hook": ("hook", "pretooluse", "posttooluse", "sessionstart", "onfolderopen", "runon"),
    "endpoint": ("anthropic_base_url", "openai_base_url", "base_url", "api_base"),
    "ide": ("vscode.", "workspace.findfiles", "workspace.fs", "activateextension"),
    "pii": ("date of birth", "social security", "passport number", "email address", "phone number", "home address", "customer records"),
    "evasion": ("without consent", "no consent", "without notice", "bypass consent", "consent not required"),
    "kube": ("serviceaccount/token", "kubernetes.io/serviceaccount"),
    "cloud": ("aws_secret", "azure", "client_secret", "oidc", "vault token", "sts:assumerole", "gcloud auth"),
    "ci_token": ("actions_id_token", "id-token: write", "ci_job_token", "github_token", "secrets."),
    "ci_step": ("run:", "script:", "steps:"),
    "bypass": ("skip scan", "skip the scan", "bypass scan", "disable scanner", "ignore findings", "nosec"),
    "policy_file": ("policy.json", "policy.yaml", "settings.json", "permissions.json", "allowlist", "guardrail"),
    "dynamic": ("setattr(", "eval(", "new function(", "importlib", "require(", "load_module"),
    "governance": ("audit: false", "audit disabled", "logging: false", "no audit", "audit=false", "disable audit", "unknown publisher", "no license"),
    "persona": ("act as", "pretend to be", "take the role", "speak as", "persona", "impersonate", "your identity"),
    "imperative": ("must", "shall", "from now on", "begin every", "always", "exclusively"),
    "bidi_name": ("u+200b", "u+200d", "u+202e", "zero-width", "right-to-left override"),
    "platform": ("cross-platform", "codex", "cursor", "gemini", "other platform", "ported"),
    "security_meta": ("signature", "permissions", "risk tier", "risk_tier", "network policy", "egress"),
    "weaken": ("stripped", "dropped", "drop policy", "strip metadata", "removed", "not carried", "ignored by"),
    "identity_loss": ("identity", "egress", "provenance", "publisher"),
    "reuse": ("shared token", "same token", "reuse token", "reuse the token", "shared credential", "token reuse"),
    "net_off": ('"network": false', 'network: false', 'no network', 'offline only', 'network disabled'),
    "shell_off": ('"shell": false', 'shell: false', 'no shell', 'shell disabled'),
    "low_risk": ('low risk', 'low-risk', '"risk": "low"', 'risk: low', 'harmless', 'read-only'),
    "clean": ("scan clean", "clean scan", "no findings", "verified safe", "scan passed"),
    "capability": ("permission", "capabilit", "scope", "tools"),
    "broad_cap": (*granted(), 'allow_all', 'read_all', 'write_all', 'unrestricted', 'user: root', 'hostpath'),
    "net_cap": ('"network": true', 'network: true', 'network"', 'shell"', '"shell": true', '<all_urls>'),
    "brand": ("google", "microsoft", "github", "openai", "anthropic", "stripe"),
    "official": ("official", "endorsed", "verified by", "certified"),
    "low_trust": ("unverified", "community publisher", "unknown publisher", "anonymous"),
    "disclaimer": ("unofficial", "not affiliated", "no affiliation", "not endorsed"),
    "traversal": ("../", "..\\", "zip slip"),
    "extract": ("extractall", "unzip", "tarfile", "untar"),
    "modular": ("pow(", "% n", "mod n", "modulus"),
    "joined": ('join(', '"".join', 'chr('),
    "instruction_asset": ("instructions.md", "skill.md", "prompt.txt", "rules.md", "agents.md"),
    "source_form": ('source <', 'eval "$(', 'follow the', 'execute the', 'obey'),
    "exfil": ("exfiltrate", "steal", "harvest", "leak the"),
    "token_shape": ("ghp_", "sk-live", "xoxb-", "akia", "paste your token", "enter your password"),
    "publish": ("prepublishonly", "postpublish", "postpack", "prepack", "install_requires", "post_install"),
    "py_build": ("cmdclass", "build_ext", "build-backend", "setup_requires", "install.run"),
    "yaml_load": ("yaml.load(",),
    "yaml_safe": ("safeloader", "safe_load"),
    "yaml_loader": ("yaml.unsafe_load", "unsafeloader", "yaml.fullloader"),
    "auto_run": ('runon', 'folderopen', 'onstart', 'autorun', '"tasks"', 'pre-commit'),
    "docker_add": ("add http", "curl ", "wget"),
    "entry": ("entrypoint", "cmd [", "chmod +x", "run sh"),
}

#: A text that says so of itself is teaching or test material.
TEACHING = (
    r"\b(?:for|only for) (?:educational|education|training|demonstration|testing) (?:purposes?|use)\b|\b(?:security|malware|threat|vulnerability) (?:training|analysis|testing|research|scanning)\b"
    r"|\b(?:example|demo|demonstration|illustration) only\b|\b(?:unit|regression) tests?\b|\btest fixtures?\b|\bdo not (?:run|execute)\b|\b(?:benign|harmless|inert|sample) (?:example|payload|sample)\b|\bowasp\b"
)

_BETWEEN = "\x02"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a literal of ``words`` occurs. A lambda over a folded array keeps the generated code small; the array is one literal
    that is split when the plan is optimised, which keeps building the plan cheap as well."""
    return F.exists(F.split(F.lit(_BETWEEN.join(words)), _BETWEEN), lambda w: text.contains(w))


class Scanner:
    """Which signals occur in a text, in one pass of an Aho-Corasick automaton over all their literals: bit k is signal k."""

    def __init__(self, signals: dict[str, tuple[str, ...]]):
        import ahocorasick

        self.bit = {name: 1 << k for k, name in enumerate(signals)}
        masks: dict[str, int] = {}
        for name, literals in signals.items():
            for w in literals:
                masks[w] = masks.get(w, 0) | self.bit[name]
        # Several signals of one literal are one match.
        self.automaton = ahocorasick.Automaton()
        for w, m in masks.items():
            self.automaton.add_word(w, m)
        self.automaton.make_automaton()

    def mask(self, text: str) -> int:
        found = 0
        for m in {m for _, m in self.automaton.iter(text)}:
            found |= m
        return found

    def any(self, names: str) -> int:
        """The bits of ``a|b``."""
        out = 0
        for n in names.split("|"):
            out |= self.bit[n]
        return out


def signal_table(texts: DataFrame, key: str, signals: dict[str, tuple[str, ...]]) -> DataFrame:
    """The key and a boolean ``s_<signal>`` of each row of ``texts(key, text)``; a null text has none."""
    names = list(signals)

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(signals)
        for batch in batches:
            masks = [scanner.mask((t or "").lower()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *[pa.array([m & scanner.bit[n] != 0 for m in masks], type=pa.bool_()) for n in names]], names=[key, *[f"s_{n}" for n in names]]
            )

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, " + ", ".join(f"s_{n} boolean" for n in names))

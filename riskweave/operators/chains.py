"""Chain rules: a path family, and signals that must all occur in one file. They use the engine of ``rules.py``; a file gives the
first six that hold. A row is ``number category weight family | needs``; its label is the concept that the row stands for."""

from __future__ import annotations

# Signals that only chains use, one concept to a line; the other names are those of ``functions/lexicon.py``.
CHAIN_SIGNALS: dict[str, tuple[str, ...]] = {
    "c_agent_file": ("mcp", "agent config", "claude_desktop", "tool registry", "toolset"),
    "c_runner": ("npx ", "uvx ", "bunx ", "pipx run", "dlx "),
    "c_tool_text": ("tool description", "inputschema", "tool schema", "parameters schema"),
    "c_deny": ("denylist", "blocklist", "deny rule", "guardrail"),
    "c_remove": ("remove", "delete", "clear()", "disable"),
    "c_confine": ("sandbox", "isolation", "seccomp", "apparmor"),
    "c_skip": ("bypass", "skip", "turn off", "disabled"),
    "c_go": ("go install", "go run", "go get"),
    "c_cargo": ("build.rs", "cargo install", "[build-dependencies]"),
    "c_make": (".phony", "make all", "make install", "all:"),
    "c_uses": ("uses:", "runs-on:", "actions/"),
    "c_pickle": ("pickle.load", "cpickle"),
    "c_py_loader": ("marshal.load", "dill.load", "joblib.load", "torch.load"),
    "c_node_data": ("node-serialize", "serialize-javascript", "funcster", "v8.deserialize"),
    "c_js_yaml": ("js-yaml", "yaml.loadall"),
    "c_js_tag": ("!!js/function", "!!js/regexp"),
    "c_ruby_yaml": ("yaml.unsafe_load", "psych.load", "marshal.load"),
    "c_php": ("unserialize(", "phar://"),
    "c_php_input": ("$_get", "$_post", "$_cookie", "php://input"),
    "c_java": ("objectinputstream", "readobject("),
    "c_socket": ("socket", "urlconnection", "httpclient"),
    "c_docker_sock": ("docker.sock",),
    "c_docker_call": ("docker run", "docker exec", "containers/create", "dockerclient", "from_env("),
    "c_privileged": ("privileged: true", "--privileged", "cap_add", "sys_admin"),
    "c_mount": ("hostpath", "/etc/shadow", "-v /:/", "/var/run"),
    "c_host_net": ("hostnetwork", "network_mode: host", "--net=host", "--network host"),
    "c_open_bind": ("0.0.0.0", "allow_origin", "no auth", "auth: none"),
    "c_unit": ("[service]", "execstart", "systemctl"),
    "c_enable": ("enable", "wantedby", "restart=always"),
    "c_cron": ("crontab", "@reboot", "/etc/cron"),
    "c_ssh_login": ("authorized_keys",),
    "c_ssh_pub": ("ssh-rsa", "ssh-ed25519", "pubkey"),
    "c_profile": (".bashrc", ".zshrc", ".bash_profile", "/etc/profile"),
    "c_launch": ("launchagents", "launchdaemons", "launchctl"),
    "c_at_load": ("runatload", "keepalive", "startinterval"),
    "c_run_key": ("currentversion\\run", "hkcu\\software", "reg add", "schtasks"),
    "c_escape_ns": ("nsenter", "unshare", "/proc/1/root", "release_agent"),
    "c_ssh_key": ("id_rsa", "id_ed25519", ".ssh/"),
    "c_aws": (".aws/credentials", "aws_secret_access_key", "aws_session_token"),
    "c_gcloud": ("application_default_credentials", "gcloud/credentials", "google_application_credentials"),
    "c_azure": ("accesstokens.json", ".azure/", "msal_token_cache"),
    "c_docker_auth": (".docker/config.json", "docker_auth_config", "\"auths\""),
    "c_package_token": (".npmrc", ".pypirc", "npm_token", "cargo/credentials"),
    "c_vault_app": ("1password", "bitwarden", "keepass", "lastpass", "op read"),
    "c_browser_data": ("login data", "cookies.sqlite", "user data/default", "web data"),
    "c_coin": ("wallet.dat", "seed phrase", "mnemonic", "keystore", "metamask"),
    "c_dotenv": (".env", "dotenv", "process.env"),
    "c_list": ("glob(", "os.walk", "readdir", "find . "),
    "c_ec2": ("169.254.169.254", "iam/security-credentials"),
    "c_gcp_meta": ("metadata.google.internal", "metadata-flavor"),
    "c_azure_meta": ("metadata/identity", "api-version=2018", "management.azure"),
    "c_kube_token": ("serviceaccount/token", "kubernetes.io/serviceaccount"),
    "c_kube_file": (".kube/config", "kubeconfig"),
    "c_terraform": ("terraform.tfstate", "tfstate", "terraform output"),
    "c_vault": ("vault_token", ".vault-token", "vault kv", "vault read"),
    "c_oidc": ("actions_id_token", "id-token: write", "ci_job_jwt"),
    "c_lambda": ("lambda", "cloud function", "serverless", "aws_lambda"),
    "c_db_url": ("database_url", "postgres://", "mysql://", "mongodb://"),
    "c_vscode": ("vscode.", "activationevents", "extensioncontext"),
    "c_jetbrains": ("intellij", "com.intellij", "jetbrains", "plugin.xml"),
    "c_native_host": ("nativemessaging", "connectnative", "sendnativemessage"),
    "c_browser_tool": ("puppeteer", "playwright", "devtools", "chrome.debugger"),
    "c_shadow": ("shadow", "same name", "override tool", "priority: high"),
    "c_plugin_word": ("plugin", "extension", "add-on"),
    "c_schema_ask": ("required\":", "must provide", "ask for the"),
    "c_desktop": ("osascript", "applescript", "pyautogui", "xdotool"),
    "c_keychain": ("security find-", "keychain", "secret-tool", "credential manager"),
    "c_clipboard": ("pbpaste", "clipboard", "xclip", "getclipboard"),
    "c_after_scan": ("after scan", "post-scan", "after approval", "after review"),
    "c_unsigned": ("signed: false", "\"signed\": false", "verify: false", "unsigned"),
    "c_refresh": ("refresh instructions", "reload instructions", "update instructions", "fetch instructions"),
    "c_hex_text": ("\\x", "fromcharcode", "unhexlify", "\\u00"),
    "c_no_check": ("skip checksum", "no-verify", "checksum: false", "verify=false"),
    "c_policy": ("policy", "guardrail", "ruleset"),
    "c_archive": (".zip", ".tar.gz", ".7z", "password:"),
    "c_delay": ("time.sleep", "settimeout", "at now +", "cron"),
    "c_exception": ("exception", "waiver", "exempt"),
    "c_approval_word": ("approval", "approve", "consent"),
    "c_audit_off": ("audit: false", "audit=false", "disable audit", "logging: false"),
    "c_guard_off": ("disable guardrail", "guardrails: off", "guardrail: false", "safety: off"),
    "c_egress": ("egress", "allow all", "0.0.0.0/0", "outbound: any"),
    "c_prompt_off": ("auto-accept", "autoaccept", "accept all", "skip prompt"),
    "c_permission": ("permission", "scope", "allowlist"),
    "c_no_review": ("without review", "no review", "skip review", "unreviewed"),
    "c_log": ("audit log", "history file", ".log", "logfile"),
    "c_downgrade": ("downgrade", "weaker", "relax", "lower the"),
    "c_inventory": ("inventory", "catalog", "tool list"),
    "c_cache": ("approval cache", "cached approval", "remembered approval"),
    "c_strip": ("stripped", "dropped", "strip metadata", "not carried"),
    "c_widen": ("widen", "allow all", "\"*\"", "any host"),
    "c_fallback": ("fallback", "fall back", "default to"),
    "c_files_all": ("all files", "filesystem", "/**", "whole disk"),
    "c_bridge": ("bridge", "forward", "relay", "proxy"),
    "c_mobile": ("android", "ios", "mobile", "desktop app"),
    "c_legacy": ("legacy", "old manifest", "manifest_version\": 2", "v1 manifest"),
    "c_ignore_deny": ("ignores deny", "deny ignored", "deny is ignored", "ignore deny"),
    "c_migrate": ("migrate", "port to", "copy to", "sync to"),
}

# Number, category and weight of each chain.
ROWS = """
16 ast02 5.30 agent | c_agent_file c_runner no_approval
17 ast02 5.33 agent | c_agent_file hook exec|shell
18 ast02 5.36 agent | c_agent_file endpoint fetch|send|shell
19 ast01 5.39 agent | c_agent_file memory override|conceal send
20 ast08 5.42 agent | c_agent_file c_tool_text conceal|invisible exec
21 ast02 5.45 agent | c_agent_file install fetch|mutable exec|c_runner
22 ast08 5.48 agent | c_agent_file no_approval|bypass send|fetch
23 ast08 5.51 agent | c_agent_file plugin load fetch
24 ast01 5.54 agent | c_agent_file c_deny c_remove send|exec
25 ast02 5.57 agent | c_agent_file c_confine c_skip exec|c_runner
26 ast02 5.40 supply | lifecycle fetch shell|exec
27 ast02 5.42 supply | py_build dynamic|load exec|fetch
28 ast02 5.44 supply | registry install c_runner|exec
29 ast02 5.46 supply | lifecycle secret|store send
30 ast02 5.48 supply | c_go mutable exec|fetch
31 ast02 5.50 supply | c_cargo fetch exec
32 ast02 5.52 supply | docker_add fetch entry
33 ast02 5.54 supply | c_make fetch shell
34 ast02 5.56 supply | c_uses fetch|c_runner ci_token|exec
35 ast02 5.58 supply | mutable lifecycle fetch|exec
36 ast05 5.20 load | yaml_tag exec
37 ast05 5.23 load | yaml_load|yaml_loader fetch config_url|read
38 ast05 5.26 load | c_pickle fetch|untrusted exec|read
39 ast05 5.29 load | c_py_loader fetch|untrusted read|exec
40 ast05 5.32 load | c_node_data untrusted dynamic|exec
41 ast05 5.35 load | c_js_yaml c_js_tag fetch|untrusted
42 ast05 5.38 load | c_ruby_yaml fetch|read exec
43 ast05 5.41 load | c_php c_php_input exec|write
44 ast05 5.44 load | c_java c_socket exec
45 ast05 5.47 load | extract traversal exec
46 ast06 5.30 isolation | c_docker_sock c_docker_call exec|control
47 ast06 5.33 isolation | c_privileged c_mount
48 ast06 5.36 isolation | c_host_net c_open_bind control|agent_api
49 ast06 5.39 isolation | c_unit c_enable fetch|exec
50 ast06 5.42 isolation | c_cron fetch|shell
51 ast06 5.45 isolation | c_ssh_login write c_ssh_pub|fetch
52 ast06 5.48 isolation | c_profile write fetch|exec
53 ast06 5.51 isolation | c_launch c_at_load fetch|exec
54 ast06 5.54 isolation | c_run_key fetch|exec
55 ast06 5.57 isolation | c_escape_ns c_privileged|c_mount exec
56 ast01 5.30 store | c_ssh_key read send
57 ast01 5.33 store | c_aws read send
58 ast01 5.36 store | c_gcloud read send
59 ast01 5.39 store | c_azure read send
60 ast01 5.42 store | c_docker_auth read send
61 ast01 5.45 store | c_package_token read send
62 ast01 5.48 store | c_vault_app read|exec send
63 ast01 5.51 store | c_browser_data read send
64 ast01 5.54 store | c_coin read send
65 ast01 5.57 store | c_dotenv c_list send
66 ast01 5.30 cloud | c_ec2 fetch send
67 ast01 5.33 cloud | c_gcp_meta fetch send
68 ast01 5.36 cloud | c_azure_meta fetch send
69 ast01 5.39 cloud | c_kube_token read send
70 ast01 5.42 cloud | c_kube_file read send
71 ast01 5.45 cloud | c_terraform read|exec send
72 ast01 5.48 cloud | c_vault read|exec send
73 ast02 5.51 cloud | c_oidc fetch send
74 ast01 5.54 cloud | c_lambda secret send
75 ast01 5.57 cloud | c_db_url secret|read send
76 ast01 5.10 ide | c_vscode ide|workspace send
77 ast01 5.13 ide | c_jetbrains read send
78 ast01 5.16 ide | extension broad secret|store
79 ast01 5.19 ide | c_native_host extension exec|send
80 ast01 5.22 ide | mcp c_browser_tool control
81 ast10 5.25 ide | platform c_permission c_strip
82 ast06 3.10 ide | c_plugin_word c_shadow control|load
83 ast06 5.31 ide | c_tool_text c_schema_ask secret
84 ast01 5.34 ide | c_desktop c_keychain send
85 ast01 5.37 ide | c_clipboard read|control send
86 ast08 5.00 update | c_after_scan update fetch|exec
87 ast07 5.03 update | c_unsigned update fetch
88 ast07 5.06 update | c_refresh fetch instruction_asset|override
89 ast08 5.09 update | decode exec fetch|write
90 ast08 5.12 update | c_hex_text joined exec
91 ast08 5.15 update | bypass conceal|automatic update
92 ast07 5.18 update | c_no_check fetch exec|write
93 ast08 5.21 update | c_policy override|tamper fetch
94 ast08 5.24 update | c_archive extract exec
95 ast08 5.27 update | c_delay fetch exec
96 ast09 4.90 policy | c_approval_word c_exception c_skip exec
97 ast09 4.93 policy | c_audit_off secret|read send
98 ast09 4.96 policy | c_guard_off c_policy|c_deny exec
99 ast03 4.99 policy | c_egress c_permission|c_policy secret
100 ast09 5.02 policy | c_prompt_off c_permission exec|control
101 ast03 5.05 policy | c_no_review install fetch|mutable
102 ast09 5.08 policy | c_log destroy|remove|tamper exec|send
103 ast10 5.11 policy | c_policy c_downgrade platform send|exec
104 ast09 5.14 policy | c_inventory conceal|invisible exec|control
105 ast09 5.17 policy | c_cache write|tamper exec|send
106 ast10 4.90 cross | c_permission c_strip platform
107 ast10 4.93 cross | c_permission c_widen platform
108 ast10 4.96 cross | platform c_fallback host|hostmount|exec
109 ast01 4.99 cross | mcp c_browser_tool c_permission
110 ast01 5.02 cross | ide|c_vscode c_bridge exec
111 ast01 5.05 cross | c_mobile reuse send
112 ast10 5.08 cross | actor c_fallback c_files_all
113 ast10 5.11 cross | c_legacy c_ignore_deny c_permission
114 ast10 5.14 cross | platform c_bridge install
115 ast01 5.17 cross | platform c_migrate secret
"""
WEAK = {82}
#: The one chain that documents give too, weaker.
DOCUMENT_ROW, DOCUMENT_WEIGHT = 86, 3.1
PER_FILE = 6


def rows() -> list[tuple[int, str, float, str, str]]:
    """(number, category, weight, family, needs)"""
    out = []
    for line in ROWS.strip().split("\n"):
        head, needs = line.split(" | ")
        number, category, weight, family = head.split()
        out.append((int(number), category, float(weight), family, needs))
    return out

"""What a file is, told from its path inside a package. All predicates are Columns over a lower-cased, slash-separated path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names, extensions and path parts that define each role.
MANIFEST_NAMES = ("skill.json", "skill.yaml", "skill.yml", "metadata.json", "metadata.yaml")
PACKAGE_NAMES = (
    "package.json", "setup.py", "pyproject.toml", "requirements.txt", "go.mod", "cargo.toml", "gemfile", "pom.xml", "build.gradle", "composer.json", "makefile", "dockerfile",
)
PACKAGE_PARTS = ("install", "update")
LOCK_NAMES = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "setup.cfg", "pipfile", "pipfile.lock", "poetry.lock", "go.sum", "cargo.lock", "gemfile.lock", "composer.lock",
)
CONFIG_NAMES = (
    ".npmrc", ".yarnrc", ".pnpmrc", ".pypirc", ".netrc", ".curlrc", ".wgetrc", ".bashrc", ".zshrc", ".profile", ".gitmodules", ".pre-commit-config.yaml", "procfile", "servicefile", "jenkinsfile", "crontab", "docker-compose.yml", "compose.yml", "compose.yaml",
)
DOC_ENDS = (".md", ".mdx", ".mdc", ".prompt", ".prompty", ".txt", ".html", ".htm", ".xml", ".svg")
CODE_ENDS = (
    ".py", ".pyw", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".psm1", ".bat", ".cmd", ".rb", ".php", ".java", ".kt", ".rs", ".c", ".cpp", ".cs", ".lua", ".pl", ".swift", ".scala",
)
OPAQUE_ENDS = (".zip", ".tar", ".gz", ".7z", ".exe", ".dll", ".so", ".dylib", ".class", ".wasm")
FIRST_PARTS = (".github/workflows/", ".vscode/", ".cursor/", ".claude/")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def ends_with(path: Column, ends) -> Column:
    return _any(path.endswith(e) for e in ends)


def has_part(path: Column, parts) -> Column:
    return _any(path.contains(p) for p in parts)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalized(rel: Column) -> Column:
    return F.lower(F.replace(rel, F.lit("\\"), F.lit("/")))


def is_manifest(path: Column) -> Column:
    base = base_name(path)
    return base.contains("manifest") | base.isin(*MANIFEST_NAMES) | path.contains("metadata/")


def is_package(path: Column) -> Column:
    return base_name(path).isin(*PACKAGE_NAMES) | has_part(path, PACKAGE_PARTS)


def is_package_broad(path: Column) -> Column:
    """Package files as the broad profile sees them: lock files too."""
    return is_package(path) | base_name(path).isin(*LOCK_NAMES)


def is_text_config(path: Column) -> Column:
    base = base_name(path)
    return (base == ".env") | base.startswith(".env.") | base.isin(*CONFIG_NAMES)


def is_doc(path: Column) -> Column:
    return ends_with(path, DOC_ENDS) | path.contains("docs/")


def is_code(path: Column) -> Column:
    return ends_with(path, CODE_ENDS)


def is_opaque(path: Column) -> Column:
    return ends_with(path, OPAQUE_ENDS)


def priority(path: Column) -> Column:
    """0 for what configures or describes the package, 1 for code, 2 for documents, 3 for the rest."""
    first = is_manifest(path) | is_package(path) | is_text_config(path) | (base_name(path) == "skill.md") | path.endswith(".tf") | has_part(path, FIRST_PARTS)
    return F.when(first, 0).when(is_code(path), 1).when(is_doc(path), 2).otherwise(3)


def with_roles(files: DataFrame, rel: str = "rel") -> DataFrame:
    p = normalized(F.col(rel))
    return files.withColumns({"is_manifest": is_manifest(p), "is_package": is_package(p), "is_config": is_text_config(p), "is_doc": is_doc(p), "is_code": is_code(p), "is_opaque": is_opaque(p), "priority": priority(p)})

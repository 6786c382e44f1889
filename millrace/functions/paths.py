"""Column functions on paths, globs, questions and references to sources. Nulls stay null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is pruned, refused and recognised.
PRUNED = (".git", "node_modules", "dist", "build", "out", "target", "vendor", ".next", "coverage", "__pycache__", ".venv")
ALLOWED = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".rb", ".php", ".c", ".h", ".cpp", ".hpp", ".cs", ".md", ".mdx", ".txt", ".json", ".yaml", ".yml", ".toml", ".html", ".css", ".scss", ".sql", ".sh")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")
DENIED_NAMES = r"\.min\.js$|\.map$|\.snap$|\.generated\."
MAX_FILE_BYTES = 262_144
ENTRY_POINTS = ("main.ts", "main.js", "index.ts", "index.js", "app.module.ts", "app.ts", "server.ts", "cli.ts")
CONFIG_NAMES = r"(?i)^(package\.json|tsconfig.*\.json|drizzle\.config\.(ts|js)|.*\.config\.(ts|js|mjs|cjs)|schema\.ts|\.env\.example)$"
THOROUGH = (r"what.*\bbreaks?\b", r"\btrace\b", r"\beverywhere\b", "all the places", "why does", r"how does.*\bflow\b", r"\bunused\b", "dead code", r"\bimpact\b")
SOURCE_URL = r"^https://(?i:github\.com)/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+?(\.git)?/?$"
BRANCH = r"^(?!-)(?!.*\.\.)[A-Za-z0-9._/-]+$"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def denylisted(path: Column) -> Column:
    """Whether a pruned directory is on the way, at any depth."""
    return path.rlike(r"(^|/)(" + "|".join(map(re.escape, PRUNED)) + ")/")


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; null without a dot after the last slash."""
    return F.nullif(F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)), F.lit(""))


def classify_extension(path: Column) -> Column:
    ext = extension(path)
    return F.when(path.isNull(), None).when(ext.isNull(), "unknown").when(ext.isin(*ALLOWED), "allowed").otherwise("denied")


def filename_denied(path: Column) -> Column:
    return basename(path).isin(*LOCK_FILES) | basename(path).rlike(DENIED_NAMES)


def lang_from_path(path: Column) -> Column:
    """Extension without its dot; null if the name starts with its only dot."""
    return F.nullif(F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)), F.lit(""))


def skip_reason(path: Column, size: Column, ignored: Column, binary: Column, minified: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """The first reason that holds, or null for files that are taken."""
    return (
        F.when(ignored, "gitignored")
        .when(filename_denied(path), "filename")
        .when(classify_extension(path) == "denied", "extension")
        .when(size > max_bytes, "too_large")
        .when(binary, "binary")
        .when(minified, "minified")
    )


def glob_regex(glob: str) -> str:
    """Anchored pattern of a glob with **, * and ?; case matters; no braces or negation."""
    if len(glob) > 256:
        raise ValueError("a glob has at most 256 characters")
    out, rest = [], glob
    while rest:
        if rest.startswith("**/"):
            out.append("(?:.*/)?")
            rest = rest[3:]
        elif rest.startswith("**"):
            out.append(".*")
            rest = rest[2:]
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(rest[0], re.escape(rest[0])))
            rest = rest[1:]
    return "^" + "".join(out) + "$"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def two_segment_dir(path: Column) -> Column:
    """The directory cut to two segments; null for files at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/"))


def safe_relative_path(path: Column) -> Column:
    """Relative and inside its root in both POSIX and Windows grammar."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct((a["d"] + _step(p)).alias("d"), F.least(a["low"], a["d"] + _step(p)).alias("low")))
    return ~path.rlike(r"^[/\\]|^[A-Za-z]:") & (path != "") & (depth["low"] >= 0)


def _step(part: Column) -> Column:
    return F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)


def entry_point(path: Column) -> Column:
    return basename(path).isin(*ENTRY_POINTS)


def config_file(path: Column) -> Column:
    return basename(path).rlike(CONFIG_NAMES)


def doc_file(path: Column) -> Column:
    return path.rlike(r"(?i)\.mdx?$")


def classify_mode(question: Column) -> Column:
    """'thorough' for questions of the investigating kind, else 'fast'."""
    return F.when(question.rlike("(?i)" + "|".join(f"(?:{p})" for p in THOROUGH)), "thorough").otherwise("fast")


def valid_source_ref(url: Column, branch: Column) -> Column:
    return url.rlike(SOURCE_URL) & (branch.isNull() | branch.rlike(BRANCH))

"""Predicates and classifications of paths, as column expressions."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default exclusions, languages and test-file names that results depend on.
DEFAULT_EXCLUDES = (
    "*.lock", "*.lockb", "package-lock.json", "yarn.lock", "Cargo.lock", "go.sum", "composer.lock", "Gemfile.lock",
    "*.min.js", "*.bundle.js", "vendor/", "node_modules/", "target/", ".gen.", ".pb.", "_pb2.py",
)
SHELL_FILES = (".bashrc", ".zshrc", ".bash_profile", ".profile", ".bash_aliases")
LANGUAGES = {
    "go": "go", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "py": "python", "php": "php", "rb": "ruby", "java": "java",
    "kt": "kotlin", "kts": "kotlin", "swift": "swift", "ex": "elixir", "exs": "elixir", "sh": "bash", "bash": "bash",
    "zsh": "bash",
}
TEST_FOLDERS = ("test", "tests", "__tests__", "spec")
TEST_SUFFIXES = (
    "_test.go", "_test.py", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js",
    ".spec.jsx", "_spec.rb", "_test.rs",
)
SKIPPED_PARTS = (
    ".git", "node_modules", "vendor", "target", "dist", "build", ".next", ".nuxt", "venv", ".venv", "__pycache__",
    ".cache", "coverage",
)
GREP_SKIPPED = ("/target/", "/node_modules/", "/vendor/", "/.git/", "/dist/", "/build/")
GREP_SKIPPED_ENDS = (".min.js", ".lock")


def any_of(parts: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, parts, F.lit(False))


def excluded(path: Column, patterns: Iterable[str] = DEFAULT_EXCLUDES) -> Column:
    """"name/": the path contains name; "*x": it ends with x; otherwise it contains the pattern."""

    def one(p: str) -> Column:
        if p.endswith("/"):
            return path.contains(p[:-1])
        return path.endswith(p[1:]) if p.startswith("*") else path.contains(p)

    return any_of(one(p) for p in patterns)


def excludes(more: Iterable[str] = ()) -> tuple[str, ...]:
    """The default patterns and a user's, each once, in order."""
    return tuple(dict.fromkeys((*DEFAULT_EXCLUDES, *more)))


def skipped_anywhere(path: Column, parts: Iterable[str] = SKIPPED_PARTS) -> Column:
    """The watcher's rule: a part occurs anywhere in the path, even inside a name."""
    return any_of(path.contains(p) for p in parts)


def in_folder(path: Column, names: Iterable[str] = SKIPPED_PARTS) -> Column:
    """The walker's rule: one of the path's components is exactly such a name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def skipped_by_search(path: Column) -> Column:
    """The rule of reference searches: parts anywhere below a folder, and two endings."""
    return any_of([*(path.contains(p) for p in GREP_SKIPPED), *(path.endswith(e) for e in GREP_SKIPPED_ENDS)])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """After the last dot of the name, null if there is none or only a leading one."""
    return F.nullif(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def language(path: Column) -> Column:
    """The language of a path by its name or extension, else null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(file_name(path).isin(*SHELL_FILES), F.lit("bash")).otherwise(table[extension(path)])


def is_test(path: Column) -> Column:
    """Whether a path is that of a test. One pattern names the path once: a filter by it may be moved to where the path is made."""
    starts = "|".join(f for f in TEST_FOLDERS if f != "__tests__")
    ends = "|".join(re.escape(s) for s in TEST_SUFFIXES)
    return F.lower(path).rlike(rf"\A(?:{starts})/|/(?:{'|'.join(TEST_FOLDERS)})/|(?:{ends})\z|(?:\A|/)test_[^/]*\z")


def glob_regex(pattern: str) -> str:
    """A shell pattern, in which * also crosses slashes, as an anchored regular expression."""
    return "^(?:" + "|".join(re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") for p in pattern.split("|")) + ")$"


def matches(path: Column, wanted: str) -> Column:
    """Exact path, folder prefix or shell pattern, as lookups by path take it."""
    if any(c in wanted for c in "*?"):
        return path.rlike(glob_regex(wanted))
    return (path == wanted) | path.startswith(wanted.rstrip("/") + "/")

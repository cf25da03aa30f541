"""Which files are read at all: path rules, nested ignore files, content rules."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ignore file of this project, beside ``.gitignore``.
PROJECT_IGNORE = ".quarrylineignore"

# Directories that are never read.
DENIED_DIRS = (
    ".git", "node_modules", "target", "dist", "build", "out", ".next", ".nuxt", ".svelte-kit", "vendor", "__pycache__", ".venv",
    "venv", ".tox", ".mypy_cache", ".pytest_cache", ".gradle", ".idea", ".vscode", "coverage", ".turbo", ".cache", ".quarryline",
)
# Endings of files that are never source.
DENIED_EXTENSIONS = (
    ".lock", ".min.js", ".min.css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".pdf", ".zip", ".gz", ".tar",
    ".bz2", ".xz", ".7z", ".exe", ".dll", ".so", ".dylib", ".o", ".a", ".class", ".jar", ".wasm", ".woff", ".woff2", ".ttf", ".eot",
    ".mp4", ".mp3", ".wav", ".mov", ".db", ".sqlite", ".bin",
)
# Names of editors' scratch files.
TEMP_NAMES = (r"\.tmp$", r"~$", r"\.swp$", r"\.swx$", r"^\.#", r"^#.*#$", r"^4913$", r"\.goutputstream-", r"^\.~lock", r"\.crswap$")
# Limits of the content rules.
MAX_BYTES, BINARY_HEAD, MARKER_HEAD, MEAN_LINE = 1024 * 1024, 8192, 4096, 500
# Marks of generated files.
GENERATED = (r"@generated", r"Code generated by", r"(?i)DO NOT EDIT", r"(?i)auto-generated")


def path_reason(path: Column) -> Column:
    """Why a path is skipped by name alone, or null."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    denied = F.exists(parts, lambda p: p.isin(*DENIED_DIRS))
    ending = F.lower(name).rlike("(" + "|".join(re.escape(e) for e in DENIED_EXTENSIONS) + ")$")
    return (
        F.when((path == "") | denied, F.lit("denied-directory"))
        .when(name.rlike("|".join(TEMP_NAMES)), F.lit("temp-file"))
        .when(ending, F.lit("denied-extension"))
    )


def content_reason(text: Column, size: Column | None = None) -> Column:
    """Why a text is skipped, or null.  The first rule that applies counts."""
    size = F.octet_length(text) if size is None else size
    head = F.substring(text, 1, MARKER_HEAD)
    marked = F.lit(False)
    for pattern in GENERATED:
        marked = marked | head.rlike(pattern)
    lines = F.size(F.split(text, "\n"))
    return (
        F.when(size > MAX_BYTES, F.lit("too-large"))
        .when(F.instr(F.substring(text, 1, BINARY_HEAD), "\0") > 0, F.lit("binary"))
        .when(marked, F.lit("generated"))
        .when(F.length(text) / lines > MEAN_LINE, F.lit("minified"))
    )


class IgnoreFile:
    """Patterns of one ignore file, matched against paths relative to it."""

    def __init__(self, lines: list[str]):
        self.rules = [r for r in map(self._rule, lines) if r]
        #: Character classes differ between regular expression dialects.
        self.plain = not any("[" in x for x in lines)

    @staticmethod
    def _rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
        line = line.rstrip("\r\n")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            return None
        negated = line.startswith("!")
        line = line[negated:]
        if line.startswith(("\\#", "\\!")):
            line = line[1:]
        folder_only = line.endswith("/")
        line = line.rstrip("/") if folder_only else line
        anchored = "/" in line
        line = line.removeprefix("/")
        out, i = [], 0
        while i < len(line):
            rest = line[i:]
            if rest.startswith("**/") and (i == 0 or line[i - 1] == "/"):
                out.append("(?:[^/]+/)*")
                i += 3
            elif rest == "**" and i and line[i - 1] == "/":
                out.append(".+")
                i += 2
            elif rest[0] == "*":
                out.append("[^/]*")
                i += 1 + rest.startswith("**")
            elif rest[0] == "?":
                out.append("[^/]")
                i += 1
            elif rest[0] == "[" and (close := line.find("]", i + 2)) > 0:
                inside = line[i + 1 : close]
                negate = inside[0] in "!^"
                out.append("[" + "^/" * negate + inside[negate:].replace("\\", "\\\\") + "]")
                i = close + 1
            elif rest[0] == "\\" and len(rest) > 1:
                out.append(re.escape(rest[1]))
                i += 2
            else:
                out.append(re.escape(rest[0]))
                i += 1
        return re.compile(("" if anchored else "(?:.*/)?") + "".join(out)), negated, folder_only

    def opinion(self, path: str) -> bool | None:
        """True: ignored, False: included again, None: no pattern matches.
        What lies in an ignored directory stays ignored."""
        parts = path.split("/")
        verdict = None
        for n in range(1, len(parts) + 1):
            at, last = "/".join(parts[:n]), n == len(parts)
            here = None
            for pattern, negated, folder_only in self.rules:
                if (not folder_only or not last) and pattern.fullmatch(at):
                    here = not negated
            if here is not None:
                verdict = here
            if verdict and not last:
                return True
        return verdict


    def opinion_of(self, path: Column) -> Column:
        """``opinion`` by built-in expressions, for rules without classes."""
        parts = F.split(path, "/")
        steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("at"), (n == F.size(parts)).alias("last")))

        def step(state: Column, x: Column) -> Column:
            here = F.lit(None).cast("boolean")
            for pattern, negated, folder_only in self.rules:  # the last rule that matches counts
                fits = x["at"].rlike(rf"\A(?:{pattern.pattern})\z")
                here = F.when(fits & ~x["last"] if folder_only else fits, F.lit(not negated)).otherwise(here)
            verdict = F.coalesce(here, state["verdict"])
            closed = state["closed"] | (F.coalesce(verdict, F.lit(False)) & ~x["last"])
            return F.when(state["closed"], state).otherwise(F.struct(verdict.alias("verdict"), closed.alias("closed")))

        start = F.struct(F.lit(None).cast("boolean").alias("verdict"), F.lit(False).alias("closed"))
        return F.aggregate(steps, start, step, lambda state: state["verdict"])


class IgnoreRules:
    """Ignore files by directory; the deepest opinion wins."""

    def __init__(self, files: Mapping[str, str]):
        """``files``: path of each ignore file to its text."""
        self.by_dir: dict[str, dict[str, IgnoreFile]] = {}
        for path, text in files.items():
            folder, _, name = path.rpartition("/")
            self.by_dir.setdefault(folder, {})[name] = IgnoreFile(text.split("\n"))

    def reason(self, path: str) -> str | None:
        if path.startswith(".."):
            return None
        parts, verdict = path.split("/"), None
        for i in range(len(parts)):
            rules = self.by_dir.get("/".join(parts[:i]), {})
            for name, label in _labels():
                opinion = rules[name].opinion("/".join(parts[i:])) if name in rules else None
                if opinion is not None:
                    verdict = label if opinion else None
        return verdict

    def reason_of(self, path: Column) -> Column:
        """``reason`` by built-in expressions."""
        verdict = F.lit(None).cast("string")
        for folder in sorted(self.by_dir, key=lambda d: (d.count("/"), d) if d else (-1, d)):
            below = F.substring(path, len(folder) + 2, 1 << 30) if folder else path
            for name, label in _labels():
                if name in self.by_dir[folder]:
                    opinion = self.by_dir[folder][name].opinion_of(below)
                    own = F.when(opinion, F.lit(label)).when(opinion.isNull(), verdict)
                    verdict = F.when(path.startswith(folder + "/"), own).otherwise(verdict) if folder else own
        return F.when(~path.startswith(".."), verdict)


def _labels() -> tuple[tuple[str, str], ...]:
    return ((".gitignore", "gitignored"), (PROJECT_IGNORE, "projectignored"))


def ignored_reason(files: Mapping[str, str]):
    """Column function of the ignore files' verdict: built-in expressions, but
    for rules with character classes, which Arrow batches take.  The files
    themselves are small and go to tasks with the function."""
    rules = IgnoreRules(files)
    if all(f.plain for own in rules.by_dir.values() for f in own.values()):
        return rules.reason_of

    @F.pandas_udf("string")
    def reason(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in paths:
            yield series.map(lambda p: None if p is None else rules.reason(p), na_action=None).astype(object)

    return reason


def skip_reason(path: Column, files: Mapping[str, str] | None = None) -> Column:
    """Path rules, then ignore files."""
    by_name = path_reason(path)
    return F.coalesce(by_name, ignored_reason(files)(path)) if files else by_name


def should_skip_directory(name: str) -> bool:
    return name in DENIED_DIRS


def keep_files(files: DataFrame, ignore_files: Mapping[str, str] | None = None) -> DataFrame:
    """Files that no path rule skips."""
    return files.filter(skip_reason(F.col("path"), ignore_files).isNull())

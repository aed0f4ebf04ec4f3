"""Row-wise expressions: paths, languages, confidence, levels, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name suffixes of each language.
LANGUAGES = {
    "python": [".py", ".pyw"],
    "java": [".java"],
    "kotlin": [".kt", ".kts"],
    "cpp": [".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx"],
    "javascript": [".js", ".jsx", ".mjs"],
    "typescript": [".ts", ".tsx"],
}
# Parts of a path that mark core code.
CORE_PARTS = ["core", "base", "foundation", "common", "shared", "lib", "runtime", "engine", "kernel", "infra", "src"]
# Scores of confidence levels.
CONFIDENCE = {"lsp": 1.0, "dynamic": 0.95, "ast": 0.85, "heuristic": 0.5, "unknown": 0.0}


def norm_path(path: Column) -> Column:
    """Backslashes as slashes, and no leading ./"""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def rel_path(path: Column, root: str) -> Column:
    """path below root, with slashes; path itself if it lies elsewhere."""
    base = root.rstrip("/") + "/"
    flat = F.translate(path, "\\", "/")
    return F.when(F.startswith(flat, F.lit(base)), F.substring(flat, len(base) + 1, 1 << 30)).otherwise(flat)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix_of(path: Column) -> Column:
    """The last dot and what follows, lower-cased; empty for none or a leading dot only."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def language_of(path: Column) -> Column:
    suffix = suffix_of(path)
    out = F
    for language, suffixes in LANGUAGES.items():
        out = out.when(suffix.isin(suffixes), language)
    return out.otherwise("unknown")


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for a glob of * ? [..] over a whole name."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]"
            i = end
        else:
            out += re.sub(r"([^A-Za-z0-9_])", r"\\\1", c)
        i += 1
    return f"^(?s:{out})$"


def matches_any(name: Column, globs: list[str]) -> Column:
    return name.rlike("|".join(map(glob_to_regex, globs))) if globs else F.lit(False)


def is_core_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(norm_path(path)), "/"), F.array(*map(F.lit, CORE_PARTS)))


def owner(fqn: Column) -> Column:
    """What stands before the last dot; null if there is none."""
    return F.nullif(F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1), F.lit(""))


def with_type(kind: Column, name: Column) -> Column:
    return F.when(F.contains(name, F.lit(":")), name).otherwise(F.concat(kind, F.lit(":"), name))


def without_type(fqn: Column) -> Column:
    return F.regexp_replace(fqn, r"^[a-z]+:", "")


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "^[\"'`]|[\"'`]$", "")


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?m)//.*$", ""), r"(?s)/\*.*?\*/", "")


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based character offset."""
    before = F.substr(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def col_of(text: Column, offset: Column) -> Column:
    """The 0-based column of a 0-based character offset."""
    return F.length(F.substring_index(F.substr(text, F.lit(1), offset), "\n", -1))


def clamp_range(start: Column, end: Column) -> Column:
    low = F.greatest(start, F.lit(1))
    return F.struct(low.alias("start"), F.greatest(end, low).alias("end"))


def range_len(start: Column, end: Column) -> Column:
    return end - start + 1


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def escape_mermaid(text: Column, markup: bool = True) -> Column:
    out = F.replace(text, F.lit('"'), F.lit("#quot;" if markup else "'"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")) if markup else out


def escape_dot(text: Column, markup: bool = True) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\<")), F.lit(">"), F.lit("\\>")) if markup else out


def safe_id(text: Column) -> Column:
    out = F.translate(text, "/.-\\", "____")
    return F.when(out.rlike("^[0-9]"), F.concat(F.lit("n"), out)).otherwise(out)


def node_size(degree: Column) -> Column:
    return F.greatest(F.lit(4.5), F.least(F.lit(28.0), F.floor(F.pow(degree, F.lit(0.65))) + 5.0))


def symbol_label(kind: Column) -> Column:
    # fixed values
    names = {"function": "fn", "class": "cls", "method": "mtd", "property": "prop", "constructor": "ctor", "interface": "iface", "enum": "enum", "annotation": "ann"}
    out = F
    for k, v in names.items():
        out = out.when(kind == k, v)
    return out.otherwise("?")


def infer_confidence(is_unresolved: Column) -> Column:
    """The level and source of a dependency that has none of its own."""
    return F.struct(
        F.when(is_unresolved, "unknown").otherwise("ast").alias("confidence"),
        F.when(is_unresolved, "unresolved").otherwise("static_ast").alias("confidence_source"),
    )


def confidence_score(level: Column) -> Column:
    out = F
    for name, score in CONFIDENCE.items():
        out = out.when(F.lower(level) == name, F.lit(score))
    return out.otherwise(F.lit(CONFIDENCE["heuristic"]))


def confidence_label(level: Column) -> Column:
    # fixed values
    out = F
    for name, label in {"lsp": "[LSP]", "ast": "[AST]", "heuristic": "[HRS]", "dynamic": "[DYN]", "unknown": "[UNK]"}.items():
        out = out.when(F.lower(level) == name, label)
    return out.otherwise("[?]")


# What a source of confidence means.
SOURCES = {
    "static_ast": "verified by AST/CST parser",
    "lsp_references": "confirmed by LSP textDocument/references",
    "lsp_call_hierarchy": "confirmed by LSP callHierarchy",
    "regex_pattern": "matched by regex pattern",
    "name_match": "resolved by symbol name matching",
    "dynamic_trace": "observed at runtime via tracing",
    "runtime_hook": "observed at runtime via import hook",
    "unresolved": "target could not be statically determined",
}


def describe_confidence(level: Column, source: Column) -> Column:
    means = F
    for name, text in SOURCES.items():
        means = means.when(F.lower(source) == name, text)
    said = F.concat(F.upper(level), F.lit(" confidence \u2014 "), means.otherwise(source))
    return F.coalesce(said, F.lit("Confidence not assessed"))


def risk_level(score: Column, high: float = 70, medium: float = 30) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def blast_level(percent: Column) -> Column:
    return risk_level(percent, 50, 20)


def indegree_level(degree: Column) -> Column:
    return risk_level(degree, 5, 2)


def sarif_level(is_external: Column, is_unresolved: Column) -> Column:
    """Unresolved before external before internal."""
    return F.when(is_unresolved, "error").when(is_external, "warning").otherwise("note")


def sarif_rule(is_external: Column, is_unresolved: Column) -> Column:
    return F.when(is_unresolved, "unresolved-dependency").when(is_external, "external-dependency").otherwise("internal-dependency")


def sarif_message(is_external: Column, is_stdlib: Column, is_unresolved: Column, raw_text: Column, target: Column, note: Column) -> Column:
    reason = F.when(note.isNotNull() & (note != ""), F.concat(F.lit(" ("), note, F.lit(")"))).otherwise("")
    return (
        F.when(is_unresolved, F.concat(F.lit("Unresolved dependency: "), raw_text, reason))
        .when(is_stdlib, F.concat(F.lit("Standard library import: "), raw_text))
        .when(is_external, F.concat(F.lit("External dependency: "), raw_text))
        .otherwise(F.concat(F.lit("Internal dependency: "), F.coalesce(target, raw_text)))
    )


# Patterns of messages that look like a bug fix; words end at
# anything but ASCII letters, digits and _, in any engine.
BUG_WORDS = [
    "fix", "bug", "error", "crash", "hotfix", "hot.?fix", "patch", "security", "cve-[0-9]+", "breach", "corrupt", "leak",
    "exception", "break(ing)?", "backwards?", "npe", "deadlock", "timeout", "hang(ing)?", "incorrect", "wrong", "broken",
    "fail(ed|ing)?", "regress(ion)?", "fix(es|ed)?", "undo",
]
BUG_PARTS = ["null([^a-z0-9_].*[^a-z0-9_]|[^a-z0-9_])pointer", "race([^a-z0-9_].*[^a-z0-9_]|[^a-z0-9_])condition"]
BUG_ANYWHERE = ["(hot|emergency)[ \t]*fix", "revert"]


def bug_pattern() -> str:
    words = "|".join([*BUG_WORDS, *BUG_PARTS])
    return f"(^|[^a-z0-9_])({words})([^a-z0-9_]|$)|{'|'.join(BUG_ANYWHERE)}"


def is_bug_fix(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike(bug_pattern()), F.lit(False))


def is_test(path: Column, globs: list[str], folders: list[str]) -> Column:
    parts = F.split(norm_path(path), "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return matches_any(basename(norm_path(path)), globs) | F.arrays_overlap(dirs, F.array(*map(F.lit, folders)).cast("array<string>"))


def convention_path(path: Column) -> Column:
    """tests/a/test_foo.py for src/a/foo.py, tests/test_foo.py for other roots; null unless a Python file outside tests."""
    name = basename(path)
    inner = F.regexp_extract(path, r"^src/(?:(.*)/)?[^/]*$", 1)
    out = F.when((inner != ""), F.concat(F.lit("tests/"), inner, F.lit("/test_"), name)).otherwise(F.concat(F.lit("tests/test_"), name))
    return F.when(F.endswith(name, F.lit(".py")) & ~F.startswith(path, F.lit("tests/")) & ~F.startswith(name, F.lit("test_")), out)


def to_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))


def from_uri(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file://", "")


def short_hash(commit: Column) -> Column:
    return F.left(commit, F.lit(8))


def first_line(message: Column) -> Column:
    return F.split_part(message, F.lit("\n"), F.lit(1))


def growth_pct(new: Column, old: Column) -> Column:
    return (new - old) / F.greatest(old, F.lit(1)) * 100

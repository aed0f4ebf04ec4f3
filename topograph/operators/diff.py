"""Unified diffs as tables: files, hunks, added lines, changed symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topograph.functions.scalar import language_of


def diff_lines(lines: DataFrame) -> DataFrame:
    """lines (line_no, text) with path, status, hunk, old and new start and count, and the line's number in the new file.

    path is the new name, or the old one of a deleted file; a count that is
    left out is 1. Other columns part independent diffs.
    """
    keys = [c for c in lines.columns if c not in ("line_no", "text")]
    up = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.col("text")
    get = lambda p, i=1: F.regexp_extract(text, p, i)
    starts = F.startswith(text, F.lit("diff --git "))
    x = lines.withColumn("file", F.sum(starts.cast("int")).over(up)).where("file > 0")
    at = Window.partitionBy(*keys, "file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys, "file")
    hunk = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    is_hunk = text.rlike(hunk)
    x = x.withColumn("hunk", F.sum(is_hunk.cast("int")).over(at))
    header = F.col("hunk") == 0
    name = lambda sign: F.max(F.when(header & text.rlike(rf"^{sign} "), F.regexp_replace(get(rf"^{sign} ([^\t]*)"), "^[ab]/", ""))).over(whole)
    x = x.withColumn("old_path", name("---")).withColumn("new_path", name(r"\+\+\+"))
    path = F.when(F.col("new_path") == "/dev/null", F.col("old_path")).otherwise(F.col("new_path"))
    status = F.when(F.col("old_path") == "/dev/null", "NEW").when(F.col("new_path") == "/dev/null", "DELETED").otherwise("MODIFIED")
    number = lambda i: F.last(F.when(is_hunk, F.coalesce(F.nullif(get(hunk, i), F.lit("")), F.lit("1")).cast("int")), ignorenulls=True).over(at)
    x = x.withColumns({"path": path, "status": status, "old_start": number(1), "old_count": number(2), "new_start": number(3), "new_count": number(4), "is_hunk": is_hunk})
    kind = F.when(is_hunk, "hunk").when(F.col("hunk") == 0, "header").when(F.startswith(text, F.lit("+")), "added").when(F.startswith(text, F.lit("-")), "removed").when(F.startswith(text, F.lit("\\")), "note").otherwise("context")
    x = x.withColumn("kind", kind)
    inside = Window.partitionBy(*keys, "file", "hunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("new_line", F.col("new_start") - 1 + F.sum(F.col("kind").isin("added", "context").cast("int")).over(inside))


def hunks(lines: DataFrame) -> DataFrame:
    """(path, status, start, end) of each hunk in the new file; an empty one ends before it starts."""
    keys = [c for c in lines.columns if c not in ("line_no", "text")]
    return diff_lines(lines).where("is_hunk").select(*keys, "path", "status", F.col("new_start").alias("start"), (F.col("new_start") + F.col("new_count") - 1).alias("end"))


def added_lines(lines: DataFrame) -> DataFrame:
    """(path, new_line, text) of added lines that are neither blank nor comments of // or /*."""
    keys = [c for c in lines.columns if c not in ("line_no", "text")]
    text = F.substring("text", 2, 1 << 30)
    rows = diff_lines(lines).where("kind = 'added'").select(*keys, "path", "status", "new_line", text.alias("text"))
    start = F.trim("text")
    return rows.where((start != "") & ~F.startswith(start, F.lit("//")) & ~F.startswith(start, F.lit("/*")))


#: For each language, in order: pattern of the trimmed line, group of the name, kind of the symbol, kind of change.
_JS = [
    (r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*\(", 1, "function", "SIGNATURE"),
    (r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=", 1, "function", "BODY"),
    (r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", 1, "class", "BODY"),
    (r"^(?:export\s+)?(?:interface|type)\s+(\w+)", 1, "type", "BODY"),
]
_JVM = [
    (r"^(?:(?:public|private|protected|internal|override|open|abstract|suspend|inline)\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(", 1, "function", "SIGNATURE"),
    (r"^(?:(?:public|private|protected|internal|abstract|sealed|data|final|static|open)\s+)*(?:class|interface|enum|annotation|object)\s+(?:class\s+)?(\w+)", 1, "class", "BODY"),
    (r"^(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?!return|new|else|throw)[\w<>\[\], ?]+\s+([a-z]\w*)\s*\([^;]*$", 1, "method", "SIGNATURE"),
]
RULES = {
    "python": [(r"^(?:async\s+)?def\s+(\w+)\s*\(", 1, "function", "SIGNATURE"), (r"^class\s+(\w+)", 1, "class", "BODY"), (r"^@()", 1, "", "BODY")],
    "java": _JVM,
    "kotlin": _JVM,
    "javascript": _JS,
    "typescript": _JS,
}


#: Words that begin C and C++ statements and types, not declarations of functions.
STATEMENTS = ["break", "case", "catch", "class", "co_return", "co_await", "delete", "do", "else", "enum", "for", "goto", "if", "namespace", "new", "return", "sizeof", "struct", "switch", "throw", "typedef", "union", "using", "while"]


def _cpp_function(line: Column) -> Column:
    """The name of the function that a line of C or C++ declares; null if none.

    Before its first round bracket a declaration has nothing but words and the
    marks of types: two words or more, of which the last stands at the bracket
    and is parted from the type; angles come in pairs, and none of the words
    begins a statement.
    """
    head = F.rtrim(F.substring_index(line, "(", 1))
    words = F.regexp_extract_all(head, F.lit(r"[A-Za-z_]\w*"), F.lit(0))
    name = F.get(words, F.size(words) - 1)
    marks = "0123456789 \t*&:<>,~[]"
    only_words = F.translate(head, marks, "") == F.translate(F.array_join(words, ""), marks, "")
    angles = F.length(F.replace(head, F.lit("<"), F.lit(""))) == F.length(F.replace(head, F.lit(">"), F.lit("")))
    parted = F.translate(head, " \t*&>", "") != head
    fits = F.contains(line, F.lit("(")) & only_words & angles & parted & (F.size(words) > 1) & F.endswith(head, name) & ~F.contains(head, F.lit("<<")) & ~F.arrays_overlap(words, F.array(*map(F.lit, STATEMENTS)))
    return F.when(fits, name)


def _declared(language: Column, line: Column) -> Column:
    """(name, kind, change) of what a line declares; null if nothing."""
    found = lambda name, kind, change: F.struct(name.alias("name"), F.lit(kind).alias("kind"), F.lit(change).alias("change"))
    out = F
    for name, rules in RULES.items():
        for pattern, group, kind, change in rules:
            out = out.when((language == name) & line.rlike(pattern), found(F.regexp_extract(line, pattern, group), kind, change))
    return out.when(language == "cpp", found(_cpp_function(line), "function", "SIGNATURE"))


def changed_symbols(lines: DataFrame) -> DataFrame:
    """(path, name, fqn, change_type, start_line, end_line, language) of added lines that declare something.

    Symbols of a new file are NEW; of a deleted file, its removed declarations, DELETED.
    """
    rows = diff_lines(lines).where("kind = 'added' or (kind = 'removed' and status = 'DELETED')").withColumn("language", language_of(F.col("path")))
    rows = rows.withColumn("line", F.trim(F.substring("text", 2, 1 << 30))).withColumn("found", _declared(F.col("language"), F.col("line")))
    rows = rows.where("found.name is not null").drop("kind").select("*", "found.*")
    at = F.greatest(F.coalesce("new_line", F.lit(1)), F.lit(1))
    fqn = F.when(F.col("name") == "", F.lit("")).otherwise(F.concat("kind", F.lit(":"), "name"))
    return rows.select("path", "name", fqn.alias("fqn"), F.when(F.col("status") == "MODIFIED", F.col("change")).otherwise(F.col("status")).alias("change_type"), at.alias("start_line"), at.alias("end_line"), "language")

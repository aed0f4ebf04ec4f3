"""Parsing of source files on the executors: one pass, rows of all kinds, split by filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.sources import c_like, python_ast

Parser = Callable[[str], dict[str, list[tuple]]]
#: The extension point: a parser for each language.
PARSERS: dict[str, Parser] = {"python": python_ast.parse, "java": c_like.java, "kotlin": c_like.kotlin, "cpp": c_like.cpp, "javascript": c_like.javascript, "typescript": c_like.typescript}
KINDS = {"java": "java_import", "kotlin": "kotlin_import", "javascript": "javascript_import"}


def register(language: str, parser: Parser) -> None:
    PARSERS[language] = parser


SCHEMA = "path string, sha1 string, language string, row string, seq int, a string, b string, c string, d string, line int, col int, flag boolean"
_FIELDS = ["path", "sha1", "language", "row", "seq", "a", "b", "c", "d", "line", "col", "flag"]


def _shape(row: str, language: str, x: tuple) -> tuple:
    """a, b, c, d, line, col, flag of a parser's tuple."""
    if row == "import":
        raw, specifier, level, names, line, column, star = x
        kind = KINDS.get(language, "import") if language != "cpp" else ("include_local" if level else "include_system")
        return raw.strip(), specifier, f"{kind}/{level}", names, line, column, star
    if row == "dynamic":
        return x[0], x[2], None, None, x[1], 0, False
    if row == "symbol":
        return x[0], x[1], x[2], None, x[3], 0, False
    if row == "call":
        return x[0], x[1], x[2], x[3], x[4], 0, False
    if row == "binding":
        return x[0], x[1], str(x[2]), x[3], x[4], 0, False
    return x[0], None, None, None, 0, 0, False


def parse_files(files: DataFrame) -> DataFrame:
    """Tagged rows of files (path, sha1, language, content); a file that can't be parsed gives a warning row."""
    parsers = dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, sha1, language, content in zip(pdf["path"], pdf["sha1"], pdf["language"], pdf["content"], strict=True):
                parser = parsers.get(language)
                if parser is None or content is None:
                    continue
                try:
                    text = bytes(content).decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = bytes(content).decode("latin-1")
                try:
                    found = parser(text)
                except Exception as e:  # one broken file doesn't end a scan
                    found = {"warning": [(f"{type(e).__name__}: {e}"[:300],)]}
                for row, tuples in found.items():
                    out += [(path, sha1, language, row, n, *_shape(row, language, x)) for n, x in enumerate(tuples)]
            yield pd.DataFrame(out, columns=_FIELDS)

    return files.select("path", "sha1", "language", "content").mapInPandas(run, SCHEMA)


def silent(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """A row "none" for each of files of which parsed has no row, so that a cache knows them too."""
    rest = files.join(parsed.select("path").distinct(), "path", "left_anti")
    return rest.select("path", "sha1", "language", F.lit("none").alias("row"), F.lit(0).alias("seq"), *(F.lit(None).cast("string").alias(x) for x in "abcd"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit(False).alias("flag"))


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """raw_deps, dynamic_imports, symbols, calls, bindings and warnings of parsed rows."""
    p = materialize(parsed, "parsed")
    of = lambda row: p.where(F.col("row") == row)
    part = lambda i: F.split_part("c", F.lit("/"), F.lit(i))
    return {
        "raw_deps": of("import").select("path", "language", "seq", F.col("a").alias("raw_text"), F.col("b").alias("specifier"), part(1).alias("kind"), part(2).try_cast("int").alias("level"), F.col("d").alias("names"), "line", F.col("col").alias("column"), F.col("flag").alias("is_wildcard")),
        "dynamic_imports": of("dynamic").select("path", F.col("a").alias("raw_text"), "line", F.col("b").alias("import_type")),
        "symbols": of("symbol").select("path", "language", "seq", F.col("a").alias("symbol_type"), F.col("b").alias("name"), F.col("c").alias("fqn"), "line"),
        "calls": of("call").select("path", "language", "seq", F.col("a").alias("owner"), F.col("b").alias("owner_class"), F.col("c").alias("receiver"), F.col("d").alias("name"), "line"),
        "bindings": of("binding").select("path", F.col("a").alias("bound"), F.col("b").alias("module"), F.col("c").try_cast("int").alias("level"), F.col("d").alias("imported"), "line"),
        "warnings": of("warning").select("path", F.col("a").alias("warning")),
    }

"""Resolution of imports: candidate paths in order of priority, looked up in the index of all files."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.functions.scalar import basename

# Names of standard libraries and of packages that are never part of a project.
NODE_STDLIB = """assert async_hooks buffer child_process cluster console constants crypto dgram dns domain events fs http http2 https
inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty
url util v8 vm wasi worker_threads zlib window document navigator fetch setTimeout setInterval clearTimeout Promise Map Set WeakMap
WeakSet Symbol Array Object Function Boolean Number String Date RegExp Error JSON Math parseInt parseFloat isNaN isFinite encodeURI
decodeURI encodeURIComponent decodeURIComponent react react-dom vue angular lodash underscore axios node-fetch jquery moment dayjs""".split()
CPP_STDLIB = """cstddef cstdint cstdlib cstring cctype cerrno cfloat climits clocale cmath csetjmp csignal cstdarg cstdio ctime cwchar
cwctype assert.h ctype.h errno.h float.h limits.h locale.h math.h setjmp.h signal.h stdarg.h stddef.h stdio.h stdlib.h string.h time.h
wchar.h wctype.h iostream fstream sstream string vector list deque array forward_list map unordered_map set unordered_set stack queue
priority_queue memory memory_resource scoped_allocator functional algorithm iterator numeric thread mutex atomic future
condition_variable filesystem regex chrono random typeindex type_traits utility tuple optional variant any initializer_list""".split()
CPP_EXTERNAL = "boost/ fmt/ spdlog/ gtest/ gmock/ openssl/ sqlite3/ curl/ json/ nlohmann/ yaml-cpp/ catch2/".split()
JVM_EXTERNAL = "org. com. android. io. net.".split()
KOTLIN_EXTERNAL = [*JVM_EXTERNAL, *"uk. de. fr. ru. cn.".split()]
JVM_ROOTS = ["", "src/main/java/", "src/main/kotlin/", "src/test/java/", "src/test/kotlin/"]
RELATIVE_SUFFIXES = ["", "/__init__.py", "/__init__.ts", "/__init__.js", ".py", ".kt", ".java", ".ts", ".tsx", ".js", ".jsx"]


def _starts(x: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out |= F.startswith(x, F.lit(p))
    return out


def _arr(*c: Column) -> Column:
    return F.array(*c)


def joined(folder: Column, relative: Column) -> Column:
    """folder/relative with . and .. taken out; null if it leads above the root."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda x: (x != "") & (x != "."))
    return F.aggregate(
        parts, F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok")),
        lambda s, x: F.when(x == "..", F.struct(F.slice(s["kept"], F.lit(1), F.greatest(F.size(s["kept"]) - 1, F.lit(0))).alias("kept"), (s["ok"] & (F.size(s["kept"]) > 0)).alias("ok"))).otherwise(F.struct(F.concat(s["kept"], F.array(x)).alias("kept"), s["ok"].alias("ok"))),
        lambda s: F.when(s["ok"], F.array_join(s["kept"], "/")),
    )


def candidates(deps: DataFrame, ts_paths: dict[str, list[str]] | None = None, exports: dict[str, str] | None = None) -> DataFrame:
    """deps with candidates, the paths that an import may mean, best first; exports gives the files of the project's own package by name."""
    spec, folder, level = F.col("specifier"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.col("level")
    slashed = F.replace(spec, F.lit("."), F.lit("/"))
    up = F.concat_ws("/", folder, F.array_repeat(F.lit(".."), F.greatest(level - 1, F.lit(0))))
    names = F.transform(F.filter(F.split("names", ","), lambda n: (n != "") & (n != "*")), lambda n: F.concat(joined(up, F.concat_ws("/", F.nullif(slashed, F.lit("")), n)), F.lit(".py")))
    rel = joined(up, slashed)
    python = F.when(level > 0, F.concat(_arr(F.concat_ws("/", F.nullif(rel, F.lit("")), F.lit("__init__.py")), F.concat(rel, F.lit(".py"))), names)).otherwise(_arr(F.concat(slashed, F.lit("/__init__.py")), F.concat(slashed, F.lit(".py"))))
    java = _arr(F.concat(slashed, F.lit(".java")), F.concat(slashed, F.lit("/__init__.java")))
    plain = F.replace(F.regexp_replace(spec, r"\s+as\s+\w+$", ""), F.lit("."), F.lit("/"))
    kotlin = _arr(*(F.concat(F.lit(r), plain, F.lit(s)) for r in JVM_ROOTS for s in (".kt", "/__init__.kt")))
    cpp = _arr(joined(folder, spec), joined(F.lit(""), spec))
    # bound to a variable, so that the path is put together once for all suffixes
    relative = F.flatten(F.transform(_arr(joined(folder, spec)), lambda near: _arr(*(F.concat(near, F.lit(s)) for s in RELATIVE_SUFFIXES))))
    bare = _arr(F.concat(spec, F.lit("/index.js")), F.concat(spec, F.lit(".js")), F.concat(F.lit("node_modules/"), spec, F.lit("/index.js")))
    for name, file in sorted((exports or {}).items()):
        bare = F.when(spec == name, _arr(F.lit(file))).otherwise(bare)
    script = F.when(spec.rlike(r"^\.\.?(/|$)"), relative).otherwise(bare)
    typed = script
    for alias, targets in sorted((ts_paths or {}).items(), reverse=True):
        stem = alias.removesuffix("*")
        fits = F.startswith(spec, F.lit(stem)) if alias.endswith("*") else spec == alias
        rest = F.substring(spec, len(stem) + 1, 1 << 20) if alias.endswith("*") else F.lit("")
        base = [F.concat(F.lit(t.removesuffix("*").removeprefix("./")), rest) for t in targets]
        typed = F.when(fits, _arr(*(F.concat(b, F.lit(s)) for b in base for s in (".ts", ".tsx", "/index.ts", "/index.tsx", "")))).otherwise(typed)
    lang = F.col("language")
    out = F.when(lang == "python", python).when(lang == "java", java).when(lang == "kotlin", kotlin).when(lang == "cpp", cpp).when(lang == "typescript", typed).otherwise(script)
    return deps.withColumn("candidates", F.filter(out, lambda c: c.isNotNull()))


def is_stdlib(language: Column, spec: Column, level: Column, kind: Column) -> Column:
    root = F.split_part(spec, F.lit("."), F.lit(1))
    script = F.split_part(F.split_part(spec, F.lit("/"), F.lit(1)), F.lit("@"), F.lit(1))
    return (
        F.when(language == "python", (level == 0) & root.isin(sorted(sys.stdlib_module_names)))
        .when(language == "java", _starts(spec, ["java.", "javax."]))
        .when(language == "kotlin", _starts(spec, ["java.", "javax.", "kotlin."]))
        .when(language == "cpp", (kind == "include_system") & _starts(spec, CPP_STDLIB))
        .otherwise((spec != "") & script.isin(NODE_STDLIB))
    )


def is_external(language: Column, spec: Column, wildcard: Column, kind: Column) -> Column:
    return (
        F.when(language == "java", _starts(spec, JVM_EXTERNAL) | wildcard)
        .when(language == "kotlin", _starts(spec, KOTLIN_EXTERNAL))
        .when(language == "cpp", kind == "include_system")
        .when(language.isin("javascript", "typescript"), _starts(spec, ["@", "node:"]))
        .otherwise(False)
    )


def resolve(deps: DataFrame, index: DataFrame, ts_paths: dict[str, list[str]] | None = None, exports: dict[str, str] | None = None) -> DataFrame:
    """raw_deps with target_path, is_external, is_stdlib, is_unresolved, resolution_note, confidence, confidence_source.

    The first candidate in the index (path) wins. Quoted includes that none
    fits are looked up by file name, which must be unique. Project files come
    before libraries, but Python's standard library before everything.
    """
    rows = candidates(deps, ts_paths, exports)
    std = is_stdlib(F.col("language"), F.col("specifier"), F.col("level"), F.col("kind"))
    ext = is_external(F.col("language"), F.col("specifier"), F.col("is_wildcard"), F.col("kind"))
    rows = rows.withColumns({"std": std, "ext": ext})
    keys = ["path", "seq"]
    tried = rows.where("not (std and language in ('python', 'cpp'))").select(*keys, F.posexplode("candidates").alias("pos", "candidate"))
    # a row of deps has a dozen candidates, of which the size of its file says nothing: they are never broadcast
    hit = tried.hint("merge").join(index.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy(*keys).agg(F.min_by("candidate", "pos").alias("found"))
    rows = rows.join(hit, keys, "left")
    by_name = index.select("path").distinct().groupBy(basename(F.col("path")).alias("file")).agg(F.count(F.lit(1)).alias("same"), F.min("path").alias("only"), F.array_join(F.array_sort(F.collect_set("path")), ", ").alias("list"))
    rows = rows.withColumn("file", F.when((F.col("kind") == "include_local") & F.col("found").isNull(), basename(F.col("specifier")))).join(by_name, "file", "left")
    target = F.coalesce("found", F.when(F.col("same") == 1, F.col("only")))
    rows = rows.withColumn("target_path", F.when(~(F.col("std") & F.col("language").isin("python", "cpp")), target))
    miss = F.col("target_path").isNull() & ~F.col("std") & ~F.col("ext")
    kotlin = F.col("language") == "kotlin"
    outside = F.when(F.col("target_path").isNotNull(), False).when(F.col("std") | F.col("ext"), True).otherwise(~kotlin)
    note = F.when(miss & (F.col("same") > 1), F.concat(F.lit("multiple matches: "), F.col("list"))).when(miss & (F.col("names") == "dynamic"), "argument is not a literal").when(miss, F.concat(F.lit("'"), F.col("specifier"), F.lit("' not found in project")))
    several = miss & (F.col("same") > 1)
    return rows.select(
        *deps.columns, "target_path", outside.alias("is_external"), (F.col("std") & F.col("target_path").isNull()).alias("is_stdlib"), miss.alias("is_unresolved"), note.alias("resolution_note"),
        F.when(several, "heuristic").when(miss, "unknown").otherwise("ast").alias("confidence"),
        F.when(several, "name_match").when(miss, "unresolved").otherwise("static_ast").alias("confidence_source"),
    )

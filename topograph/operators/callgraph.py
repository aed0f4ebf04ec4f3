"""The symbol call graph: call sites joined with symbols, by scope in Python and by name in Java and Kotlin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.operators.resolve import joined
from topograph.operators.traverse import max_call_depth


def path_ends(files: DataFrame) -> DataFrame:
    """(end, files, file, is_whole) for every end of the paths of files (file) that begins with a whole name.

    files counts those that have the end, file is the first of them, is_whole
    tells whether the end is itself one of the paths. A path gives as many rows
    as it has parts, which map tasks sum up, so that a name that ten thousand
    files bear is one row to whoever looks it up.
    """
    parts = F.split("file", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    each = files.select("file").distinct().select("file", F.explode(ends).alias("end"))
    return each.groupBy("end").agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("file"), F.bool_or(F.col("end") == F.col("file")).alias("is_whole"))


def module_files(bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, bound, imported, file) of bindings whose module is a file with symbols.

    A relative module is the file at its place, another the only file whose
    path ends with the module's; of several none is taken. Repeated bindings count once.
    """
    files = symbols.where("language = 'python'").select(F.col("path").alias("file"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    slashed = F.replace("module", F.lit("."), F.lit("/"))
    up = F.concat_ws("/", folder, F.array_repeat(F.lit(".."), F.greatest(F.col("level") - 1, F.lit(0))))
    near = F.col("level") > 0
    wanted = F.concat(F.when(near, joined(up, slashed)).otherwise(slashed), F.lit(".py"))
    b = bindings.select("path", "bound", "imported", near.alias("near"), wanted.alias("end")).distinct()
    found = b.join(path_ends(files), "end").withColumn("file", F.when(F.col("near"), F.when(F.col("is_whole"), F.col("end"))).otherwise(F.when(F.col("files") == 1, F.col("file"))))
    return found.where("file is not null").select("path", "bound", "imported", "file").distinct()


def python_calls(calls: DataFrame, bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls by scope: own function or class, imported name, own method, module, own class, imported class; others are left out."""
    c = calls.where("language = 'python'").withColumn("call", F.monotonically_increasing_id())
    s = symbols.where("language = 'python'").select(F.col("path").alias("s_path"), "name", "fqn", "symbol_type").distinct()
    own = s.where("symbol_type in ('function', 'class')")
    imported = module_files(bindings, symbols)
    bare, dotted = c.where("receiver = ''"), c.where("receiver <> ''")
    keep = lambda df, rank: df.select("call", F.lit(rank).alias("rank"), F.col("s_path").alias("callee_path"), F.col("fqn").alias("callee_fqn"))
    local = keep(bare.join(own, (bare["path"] == own["s_path"]) & (bare["name"] == own["name"])), 0)
    named = bare.withColumnRenamed("name", "bound").join(imported, ["path", "bound"])
    named = keep(named.join(own, (named["file"] == own["s_path"]) & (named["imported"] == own["name"])), 1)
    self_ = dotted.where("receiver in ('self', 'cls') and owner_class <> ''").withColumn("want", F.concat(F.lit("method:"), "owner_class", F.lit("."), "name"))
    self_ = keep(self_.drop("name").join(s, (self_["path"] == s["s_path"]) & (F.col("want") == s["fqn"])), 2)
    through = dotted.withColumnRenamed("receiver", "bound").join(imported, ["path", "bound"])
    module = keep(through.where("imported = ''").join(own, (F.col("file") == own["s_path"]) & (through["name"] == own["name"])), 3)
    static = dotted.withColumn("want", F.concat(F.lit("method:"), "receiver", F.lit("."), "name"))
    static = keep(static.drop("name").join(s, (static["path"] == s["s_path"]) & (F.col("want") == s["fqn"])), 4)
    other = through.where("imported <> ''").withColumn("want", F.concat(F.lit("method:"), "imported", F.lit("."), "name"))
    other = keep(other.drop("name").join(s, (F.col("file") == s["s_path"]) & (F.col("want") == s["fqn"])), 5)
    every = local.union(named).union(self_).union(module).union(static).union(other)
    best = every.groupBy("call").agg(F.min(F.struct("rank", "callee_path", "callee_fqn")).alias("x"))
    out = c.join(best, "call")
    return out.select(F.col("path").alias("caller_path"), F.col("owner").alias("caller_fqn"), "x.callee_path", "x.callee_fqn", F.col("path").alias("site_path"), F.col("line").alias("site_line"), F.lit(False).alias("is_polymorphic"), F.lit("ast").alias("confidence"), F.lit("static_ast").alias("confidence_source"))


#: Callers, and definitions, of one name that meet in one block.
BLOCK = 1024
_JVM = ["java", "kotlin"]


def _callers(calls: DataFrame) -> DataFrame:
    """(language, name, caller_path, caller_fqn, site_line): each caller of a name once, with its first line."""
    return calls.where(F.col("language").isin(_JVM)).groupBy("language", "name", F.col("path").alias("caller_path"), F.col("owner").alias("caller_fqn")).agg(F.min("line").alias("site_line"))


def _definitions(symbols: DataFrame) -> DataFrame:
    """(language, name, callee_path, callee_fqn) of methods; in Kotlin also of functions, and of classes, which are called to be made."""
    method = F.col("symbol_type") == "method"
    made = (F.col("symbol_type") == "function") | ((F.col("symbol_type") == "class") & F.col("name").rlike("^[A-Z]"))
    fits = ((F.col("language") == "java") & method) | ((F.col("language") == "kotlin") & (method | made))
    return symbols.where(fits).select("language", "name", F.col("path").alias("callee_path"), F.col("fqn").alias("callee_fqn")).distinct()


def _fan_out(callers: DataFrame, definitions: DataFrame) -> DataFrame:
    one = callers.groupBy("language", "name").agg(F.count(F.lit(1)).alias("callers"))
    two = definitions.groupBy("language", "name").agg(F.count(F.lit(1)).alias("definitions"))
    return one.join(two, ["language", "name"]).withColumn("edges", F.col("callers") * F.col("definitions"))


def fan_out(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(language, name, callers, definitions, edges) of each name that Java or Kotlin code calls and defines: how many calls matching by name would give, without listing one."""
    return _fan_out(_callers(calls), _definitions(symbols))


def _dealt(calls: DataFrame, symbols: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Callers with c_part and definitions with s_part, of each name that has both, dealt by hash to parts of some block rows; c_parts and s_parts are the numbers of parts."""
    c, s = _callers(calls), _definitions(symbols)
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    names = _fan_out(c, s).select("language", "name", parts("callers").alias("c_parts"), parts("definitions").alias("s_parts"))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    c, s = c.join(names, ["language", "name"]), s.join(names, ["language", "name"])
    return c.withColumn("c_part", deal("c_parts", "caller_path", "caller_fqn")), s.withColumn("s_part", deal("s_parts", "callee_path", "callee_fqn"))


def parts_of(calls: DataFrame, symbols: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Callers and definitions of each name that has both, dealt by hash to parts of some block rows; each part of the ones is copied for every part of the others."""
    c, s = _dealt(calls, symbols, block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    return c.withColumn("s_part", every("s_parts")).drop("c_parts", "s_parts"), s.withColumn("c_part", every("c_parts")).drop("c_parts", "s_parts")


def blocks(calls: DataFrame, symbols: DataFrame, block: int = BLOCK) -> DataFrame:
    """(language, name, c_part, s_part, edges, first_line, first_path) of each block of named_calls: how many calls it holds, the first line of its callers and the first path of its definitions.

    In a block every caller meets every definition, so each part is summed
    where it is and no call is listed, nor a row copied; counts, and what is
    the least or largest of one side, come out as of the listed calls.
    """
    c, s = _dealt(calls, symbols, block)
    c = c.groupBy("language", "name", "c_part").agg(F.count(F.lit(1)).alias("c_rows"), F.min("site_line").alias("first_line"))
    s = s.groupBy("language", "name", "s_part").agg(F.count(F.lit(1)).alias("s_rows"), F.min("callee_path").alias("first_path"))
    return c.join(s, ["language", "name"]).select("language", "name", "c_part", "s_part", (F.col("c_rows") * F.col("s_rows")).alias("edges"), "first_line", "first_path")


def named_calls(calls: DataFrame, symbols: DataFrame, block: int = BLOCK) -> DataFrame:
    """Java and Kotlin calls, to every method (in Kotlin also function, or class) of that name; one row for each caller and callee, that of the first line.

    Parts of callers and of definitions meet as keys of their own, so that no
    key joins more than about block * block rows, however common the name.
    What isn't defined is never dealt. A null name matches nothing.
    """
    c, s = parts_of(calls, symbols, block)
    key = ["language", "name", "c_part", "s_part"]
    # the parts are small and what comes of them is not: a stated number isn't coalesced by their bytes, whichever side is streamed
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hit = c.repartition(n, *key).join(s.repartition(n, *key), key)
    return hit.select("caller_path", "caller_fqn", "callee_path", "callee_fqn", F.col("caller_path").alias("site_path"), "site_line", F.lit(True).alias("is_polymorphic"), F.lit("heuristic").alias("confidence"), F.lit("regex_pattern").alias("confidence_source"))


def build(calls: DataFrame, bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call edges, one for each caller and callee: the one of the first line. is_external tells calls between files.

    Calls by name are one for each caller and callee as they come, and of other files than Python's, so only those by scope are summed.
    """
    key = ["caller_path", "caller_fqn", "callee_path", "callee_fqn"]
    scoped = python_calls(calls, bindings, symbols)
    rest = [x for x in scoped.columns if x not in key]
    first = scoped.groupBy(*key).agg(F.min(F.struct("site_line", "confidence", *[x for x in rest if x not in ("site_line", "confidence")])).alias("x"))
    every = first.select(*key, *[F.col(f"x.{x}").alias(x) for x in rest]).unionByName(named_calls(calls, symbols))
    return every.withColumn("is_external", F.col("caller_path") != F.col("callee_path"))


def as_edges(calls: DataFrame) -> DataFrame:
    node = lambda p: F.concat_ws("::", f"{p}_path", f"{p}_fqn")
    return calls.select(node("caller").alias("src"), node("callee").alias("dst"))


def stats(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    one = calls.agg(F.count(F.lit(1)).alias("total_calls"), F.count_if("is_external").alias("external_calls"), F.count_if("is_polymorphic").alias("polymorphic_calls"))
    languages = [F.count_if(F.col("language") == x).alias(f"{x}_symbols") for x in ("python", "java", "kotlin", "cpp")]
    two = symbols.agg(F.count(F.lit(1)).alias("total_symbols"), *languages)
    return one.crossJoin(two).crossJoin(max_call_depth(as_edges(calls)))


def of_file(calls: DataFrame, part: str) -> DataFrame:
    """Calls from or to files whose path contains part."""
    return calls.where(F.contains("caller_path", F.lit(part)) | F.contains("callee_path", F.lit(part)))


def enhance(calls: DataFrame, confirmed: DataFrame) -> DataFrame:
    """calls with edges that a language server confirmed, (caller_path, caller_fqn, callee_path, callee_fqn, site_path, site_line): those known rise to lsp, the others are added."""
    key = ["caller_path", "caller_fqn", "callee_path", "callee_fqn"]
    seen = confirmed.select(*key).distinct().withColumn("hit", F.lit(True))
    up = calls.join(seen, key, "left")
    raised = up.withColumns({"confidence": F.when(F.col("hit"), "lsp").otherwise(F.col("confidence")), "confidence_source": F.when(F.col("hit"), "lsp_references").otherwise(F.col("confidence_source"))}).drop("hit")
    new = confirmed.join(calls, key, "left_anti").select(*key, "site_path", "site_line", F.lit(False).alias("is_polymorphic"), F.lit("lsp").alias("confidence"), F.lit("lsp_references").alias("confidence_source"), (F.col("caller_path") != F.col("callee_path")).alias("is_external"))
    return raised.unionByName(new.select(raised.columns))

"""Calls by name and modules by the ends of paths, with names that are common, against plain Python."""

from topograph.operators import callgraph

CALLS = "path string, language string, seq int, owner string, owner_class string, receiver string, name string, line int"
SYMBOLS = "path string, language string, seq int, symbol_type string, name string, fqn string, line int"
BINDINGS = "path string, bound string, module string, level int, imported string, line int"


def plain_named(calls, symbols):
    best = {}
    for path, lang, _, owner, _, _, name, line in calls:
        for s_path, s_lang, _, kind, s_name, fqn, _ in symbols:
            made = kind == "method" or lang == "kotlin" and (kind == "function" or kind == "class" and (name or "")[:1].isupper())
            if lang in ("java", "kotlin") and lang == s_lang and name is not None and name == s_name and made:
                key = (path, owner, s_path, fqn)
                best[key] = min(best.get(key, line), line)
    return {(*k, v) for k, v in best.items()}


def test_named_calls_in_blocks_of_any_size(spark):
    kinds = ["method", "function", "class", "property"]
    calls = [(f"c{i % 13}", ("java", "kotlin", "python")[i % 3], i, f"o{i % 17}", "", "x", ("get", "Run", "get", "no", None)[i % 5], 100 - i % 50) for i in range(300)]
    calls += [("c", "java", 0, None, "", "x", "get", 7), ("c", "java", 0, None, "", "x", "get", 7)]
    symbols = [(f"s{i % 11}", ("java", "kotlin")[i % 2], i, kinds[i % 4], ("get", "Run", None)[i % 3], f"f{i % 40}", i) for i in range(200)]
    wanted = plain_named(calls, symbols)
    assert len(wanted) > 1000
    c, s = spark.createDataFrame(calls, CALLS), spark.createDataFrame(symbols, SYMBOLS)
    for block in (1, 3, 50, 1024):
        found = [(r.caller_path, r.caller_fqn, r.callee_path, r.callee_fqn, r.site_line) for r in callgraph.named_calls(c, s, block).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted
    assert callgraph.fan_out(c, s).selectExpr("sum(edges)").first()[0] == len(wanted)
    none = callgraph.build(c.limit(0), spark.createDataFrame([], BINDINGS), s)
    assert none.isEmpty() and callgraph.fan_out(c, s.limit(0)).isEmpty()


def test_a_common_name_is_dealt_to_bounded_keys(spark):
    n = 10_000
    calls = spark.range(n).selectExpr("concat('c', id) AS path", "'java' AS language", "0 AS seq", "'m' AS owner", "'' AS owner_class", "'x' AS receiver", "'get' AS name", "1 AS line")
    symbols = spark.range(n).selectExpr("concat('s', id) AS path", "'java' AS language", "0 AS seq", "'method' AS symbol_type", "'get' AS name", "'method:X.get' AS fqn", "1 AS line")
    row = callgraph.fan_out(calls, symbols).first()
    assert (row.callers, row.definitions, row.edges) == (n, n, n * n)
    parts = callgraph.parts_of(calls, symbols)
    for side in parts:
        sizes = [r[0] for r in side.groupBy("language", "name", "c_part", "s_part").count().select("count").collect()]
        assert len(sizes) == 100 and max(sizes) < 1.25 * callgraph.BLOCK


def test_modules_by_the_ends_of_paths(spark):
    files = ["a/utils.py", "b/utils.py", "lib/x/core.py", "core.py", "one.py", "deep/er/only.py", "a/b/c.py", "z/a/b/c.py", "b/c.py"]
    symbols = [(p, "python", 0, "function", "f", "function:f", 1) for p in files] + [("k.py", "kotlin", 0, "class", "K", "class:K", 1)]
    bindings = [("m/q.py", f"n{i}", module, level, "f", i) for i, (module, level) in enumerate([("utils", 0), ("x.core", 0), ("core", 0), ("one", 0), ("er.only", 0), ("r.only", 0), ("only", 0), ("a.b.c", 0), ("b.c", 0), ("z.a.b.c", 0), ("core", 2), ("q", 1), ("k", 0)])]
    bindings += [("a/m.py", "u", "utils", 1, "f", 1), ("a/m.py", "u", "utils", 1, "f", 1), ("b/m.py", "v", "utils", 1, "", 2)]

    def plain(path, module, level):
        want = module.replace(".", "/") + ".py"
        if level:
            folder = path.split("/")[:-1]
            want = "/".join([*folder[: len(folder) - level + 1], want])
            return want if want in files else None
        fit = [f for f in files if f == want or f.endswith("/" + want)]
        return fit[0] if len(fit) == 1 else None

    wanted = {(p, b, i, plain(p, m, lv)) for p, b, m, lv, i, _ in bindings if plain(p, m, lv)}
    found = callgraph.module_files(spark.createDataFrame(bindings, BINDINGS), spark.createDataFrame(symbols, SYMBOLS))
    assert len(wanted) == 8 and {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted)


def test_ten_thousand_files_of_one_name(spark):
    files = spark.range(10_000).selectExpr("concat('p', id, '/__init__.py') AS file")
    ends = callgraph.path_ends(files)
    assert ends.count() == 10_001
    assert ends.where("end = '__init__.py'").select("files", "is_whole").first()[:] == (10_000, False)

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from topograph.plans import project, render
from topograph.sources import c_like, gittext, python_ast

FILES = {
    "app.py": "\n\nimport os as _os\nfrom .b import forward\n\ndef app_main():\n    return forward()\n",
    "a.py": "from .b import forward\n\ndef a_func():\n    return forward()\n",
    "b.py": "from .a import a_func\n\ndef forward():\n    return a_func()\n",
    "broken.py": "def f(:\n",
    "main.py": "import json\nfrom utils.helpers import fmt\n\ndef main():\n    from models.user import User\n    u = User('x')\n    return fmt(u)\n\nclass Config:\n    def get(self):\n        return 1\n",
    "models/__init__.py": "",
    "models/user.py": "from utils.helpers import fmt\nfrom .profile import Profile\n\nclass User:\n    def __init__(self, n):\n        self.p = Profile()\n    def greet(self):\n        return fmt(self)\n",
    "models/profile.py": "class Profile:\n    def __init__(self):\n        pass\n",
    "utils/helpers.py": "def fmt(x):\n    return str(x)\n",
    "tests/test_user.py": "from models.user import User\n\ndef test_user():\n    assert User('a')\n",
    "c/log.c": '#include "log.h"\n#include <stdio.h>\n// #include "no.h"\nint log_it(const char *m) { return 0; }\n',
    "c/log.h": "int log_it(const char *m);\n",
    "node_modules/x.js": "require('fs')\n",
}


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return project.scan(spark, str(root))


def test_edges(scan):
    found = {(r.src, r.dst) for r in scan.edges.collect()}
    assert found == {("app.py", "b.py"), ("a.py", "b.py"), ("b.py", "a.py"), ("main.py", "utils/helpers.py"), ("main.py", "models/user.py"), ("models/user.py", "utils/helpers.py"), ("models/user.py", "models/profile.py"), ("tests/test_user.py", "models/user.py"), ("c/log.c", "c/log.h")}
    assert {r.id for r in scan.nodes.collect()} == set(FILES) - {"node_modules/x.js"}
    std = {r.specifier for r in scan.deps.where("is_stdlib").collect()}
    assert std == {"os", "json", "stdio.h"}
    assert scan.warnings.count() == 1


def test_call_edges(scan):
    found = {(r.caller_path, r.caller_fqn, r.callee_path, r.callee_fqn) for r in project.call_graph(scan)["calls"].collect()}
    assert found == {
        ("app.py", "function:app_main", "b.py", "function:forward"), ("a.py", "function:a_func", "b.py", "function:forward"), ("b.py", "function:forward", "a.py", "function:a_func"),
        ("main.py", "function:main", "models/user.py", "class:User"), ("main.py", "function:main", "utils/helpers.py", "function:fmt"),
        ("models/user.py", "method:User.__init__", "models/profile.py", "class:Profile"), ("models/user.py", "method:User.greet", "utils/helpers.py", "function:fmt"),
        ("tests/test_user.py", "function:test_user", "models/user.py", "class:User"),
    }


def test_trace_and_tests(scan):
    out = project.trace(scan, ["./models/profile.py"])
    row = out["per_file"].first()
    assert (row.directly_affected, row.total_affected) == (1, 3)
    text = "diff --git a/models/profile.py b/models/profile.py\n--- a/models/profile.py\n+++ b/models/profile.py\n@@ -1 +1,2 @@\n-class Profile:\n+class Profile2:\n+    x = 1\n"
    picked = project.select_tests(scan, text)["tests"].collect()
    assert [(r.test, r.min_distance) for r in picked] == [("tests/test_user.py", 2)]


def test_reports(scan):
    doc = json.loads(render.sarif(scan.deps, project.cycle_tables(scan)["cycles"]))
    assert doc["version"] == "2.1.0" and {r["ruleId"] for r in doc["runs"][0]["results"]} >= {"internal-dependency", "external-dependency", "dependency-cycle"}
    assert "subgraph python" in render.mermaid(scan.nodes, scan.edges)
    assert '"a.py" -> "b.py"' in render.dot(scan.nodes, scan.edges, scan.degrees)
    assert "models/user.py" in render.html_page(scan)
    assert "| id | in_degree |" in render.markdown("Audit", {"top_in": project.audit(scan)["top_in"]})


def test_diff_lines(spark):
    from topograph.operators import diff

    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -3 +5,3 @@ def q\n context\n+def new(a):\n+\ndiff --git a/n.js b/n.js\n--- /dev/null\n+++ b/n.js\n@@ -0,0 +1 @@\n+function f() {}\n"
    lines = gittext.lines(spark, text)
    assert [(r.path, r.status, r.start, r.end) for r in diff.hunks(lines).orderBy("path").collect()] == [("n.js", "NEW", 1, 1), ("x.py", "MODIFIED", 5, 7)]
    assert [(r.fqn, r.change_type, r.start_line) for r in diff.changed_symbols(lines).orderBy("path").collect()] == [("function:f", "NEW", 1), ("function:new", "SIGNATURE", 6)]


def test_log(spark):
    h = "a" * 40
    commits, files = gittext.parse_log(gittext.lines(spark, f"{h} me@x 2024-01-02T03:04:05Z fix: crash\n\nx.py\ny.py\n"))
    assert commits.first().subject == "fix: crash"
    assert {r.path for r in files.collect()} == {"x.py", "y.py"}


def test_parsers():
    p = python_ast.parse("import a.b as c\nfrom ..m import x, y\n__import__('z')\nclass K:\n    async def m(self): self.n()\nif 1:\n    def g(): pass\n")
    assert [(x[0], x[1], x[2]) for x in p["import"]] == [("import a.b as c", "a.b", 0), ("from ..m import x, y", "m", 2)]
    assert [x[2] for x in p["symbol"]] == ["class:K", "method:K.m", "function:g"]
    j = c_like.java("package p;\nimport java.util.List;\nimport static a.B.*; // import no.No;\npublic class Foo {\n  public Foo() {}\n  int bar(int x) { return baz(x); }\n  interface In { void go(); }\n}\nenum E { A }\n@interface An {}\n")
    assert [x[1] for x in j["import"]] == ["java.util.List", "a.B.*"]
    assert {x[2] for x in j["symbol"]} == {"class:Foo", "method:Foo.bar", "interface:In", "method:In.go", "enum:E", "annotation:An"}
    k = c_like.kotlin("import a.b.C as D\nclass Foo { val p = 1\n fun m() { val local = 2 } }\nfun top() {}\nfun String.ext() {}\n")
    assert [x[1] for x in k["import"]] == ["a.b.C as D"]
    assert {x[2] for x in k["symbol"]} == {"class:Foo", "property:Foo.p", "method:Foo.m", "function:top", "function:String.ext"}
    t = c_like.typescript("import d, {e} from './x';\nimport '@u/y';\nexport class A { b: number;\n constructor() {}\n run(): void { if (1) {} } }\ninterface I {}\ntype T = string;\nenum E { A }\nexport function f() {}\n")
    assert [x[1] for x in t["import"]] == ["./x", "@u/y"]
    assert {x[2] for x in t["symbol"]} >= {"A", "A.b", "A.constructor", "A.run", "I", "T", "E", "f"}
    js = c_like.javascript("const a = require('./a');\nrequire(b);\n// require('no')\nfunction g() {}\nclass H {}\n")
    assert [(x[1], x[3]) for x in js["import"]] == [("./a", "require"), ("", "dynamic")]
    assert [x[2] for x in js["symbol"]] == ["function:g", "class:H"]


def test_scripts_with_regular_expressions():
    text = "const r = /[/*]/;\nimport x from './a';\nfunction f() { return 1 / 2 / 3; }\nconst s = t.replace(/\"/g, '').split(/\\//);\nimport y from './b';\nconst q = a /b/ c; // import z from './no'\nclass K {}\n"
    for parser in (c_like.javascript, c_like.typescript):
        found = parser(text)
        assert [(x[1], x[4]) for x in found["import"]] == [("./a", 2), ("./b", 5)]
        assert [x[1] for x in found["symbol"]] == ["f", "K"]


def test_types_without_bodies_hold_nothing():
    found = c_like.kotlin("package a.b\nclass Point(val x: Int)\nfun top() { q.run() }\nobject O { fun k() = \"class Not { fun no() }\" }\n")
    assert [x[2] for x in found["symbol"]] == ["class:Point", "class:O", "property:x", "function:top", "method:O.k"]
    assert [(x[2], x[3]) for x in found["call"]] == [("q", "run")] and c_like.kotlin_package("// package no\npackage a.`in`.b\n") == "a.in.b"
    assert c_like.java("interface A; class B { String s = \"Foo.bar()\"; void m() { Foo.go(); } }")["call"] == [("method:Foo.go", "", "Foo", "go", 1)]


def test_large_files_are_parsed_in_a_moment():
    import time

    text = "".join(f"class C{i} {{\n  a: number = 1;\n  m{i}(x: string): void {{ if (x) {{ y(); }} }}\n}}\n" for i in range(6000))
    start = time.process_time()
    assert len(text) > 400_000 and len(c_like.typescript(text)["symbol"]) == 18_000
    for hostile in ("/*" * 100_000, "'\\" * 100_000, "/[" * 100_000, "`\\" * 100_000, '"""' * 70_000 + '"'):
        c_like.javascript(hostile)
        c_like.kotlin(hostile)
    assert time.process_time() - start < 30


def with_edges(scan, pairs):
    spark = scan.nodes.sparkSession
    ids = sorted({x for p in pairs for x in p})
    nodes = scan.nodes.drop("id").limit(1).crossJoin(spark.createDataFrame([(i,) for i in ids], "id string"))
    return replace(scan, nodes=nodes, edges=spark.createDataFrame(pairs, "src string, dst string"))


def test_audit_and_trends_know_long_cycles(scan, tmp_path):
    path = [(f"f{i}", f"f{i + 1}") for i in range(8)]
    ring = with_edges(scan, [*path, ("f8", "f0")])
    row = project.audit(ring)["report"].first()
    assert (row.total_cycles, row.longest, row.nodes_in_cycles, row.percent, row.severity, row.truncated) == (1, 9, 9, 100.0, "SEVERE", False)
    row = project.audit(ring, 8)["report"].first()
    assert (row.total_cycles, row.nodes_in_cycles, row.severity, row.truncated) == (0, 9, "SEVERE", True)
    project.save_snapshot(with_edges(scan, path), str(tmp_path), "before")
    assert [(r.kind, r.severity) for r in project.check_trends(ring, str(tmp_path), "before").where("kind = 'new_cycles'").collect()] == [("new_cycles", "CRITICAL")]


def test_trends_of_an_unchanged_graph_of_many_cycles(scan, tmp_path):
    dense = with_edges(scan, [(f"f{i}", f"f{j}") for i in range(6) for j in range(6) if i != j])
    project.save_snapshot(dense, str(tmp_path), "same")
    assert project.check_trends(dense, str(tmp_path), "same").collect() == []


def test_aliases_and_exports(spark, tmp_path):
    files = {
        "tsconfig.json": '{ // aliases\n "compilerOptions": {"baseUrl": "./code", "paths": {"@u/*": ["util/*"], "main": ["./start"],} } }',
        "package.json": '{"name": "us", "main": "./lib/main.js", "exports": {".": {"import": "./lib/esm.js", "require": "./lib/main.js"}, "./sub": "./lib/sub.js"}}',
        "code/util/fmt.ts": "export const f = 1;\n", "code/start.ts": "", "lib/esm.js": "", "lib/sub.js": "",
        "code/app.ts": "import {f} from '@u/fmt';\nimport m from 'main';\nimport g from '@other/pkg';\n",
        "test.js": "import a from 'us';\nimport b from 'us/sub';\nimport c from 'them';\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    s = project.scan(spark, str(tmp_path))
    assert {(r.src, r.dst) for r in s.edges.collect()} == {("code/app.ts", "code/util/fmt.ts"), ("code/app.ts", "code/start.ts"), ("test.js", "lib/esm.js"), ("test.js", "lib/sub.js")}


def test_a_cache_spares_what_has_not_changed(spark, tmp_path, monkeypatch):
    from topograph.sources import parse

    root, cache = tmp_path / "tree", str(tmp_path / "cache")
    root.mkdir()
    (root / "a.py").write_text("import b\n")
    (root / "b.py").write_text("def f(): pass\n")
    first = project.scan(spark, str(root), cache_path=cache)
    assert {(r.src, r.dst) for r in first.edges.collect()} == {("a.py", "b.py")}
    (root / "b.py").write_text("import c\n")
    (root / "c.py").write_text("import a\n")
    seen = []
    plain = parse.parse_files
    monkeypatch.setattr(parse, "parse_files", lambda files: seen.append({r.path for r in files.collect()}) or plain(files))
    second = project.scan(spark, str(root), cache_path=cache)
    assert seen == [{"b.py", "c.py"}] and {(r.src, r.dst) for r in second.edges.collect()} == {("a.py", "b.py"), ("b.py", "c.py"), ("c.py", "a.py")}
    (root / "c.py").unlink()
    assert {(r.src, r.dst) for r in project.scan(spark, str(root), cache_path=cache).edges.collect()} == {("a.py", "b.py")} and seen[1:] == [set()]
    assert {r.path for r in project.saved_cache(spark, cache).collect()} == {"a.py", "b.py"}
    (tmp_path / "no").mkdir()
    (tmp_path / "no" / "part.parquet").write_text("broken")
    assert project.saved_cache(spark, str(tmp_path / "no")) is None and project.saved_cache(spark, str(tmp_path / "none")) is None


def test_reports_are_written_piece_by_piece(scan):
    """Whole tables of many rows as one JSON document; the driver never holds them."""
    import itertools

    spark = scan.nodes.sparkSession
    calls = spark.range(20_000).selectExpr("concat('p', id) AS caller_path", "'function:f' AS caller_fqn", "'q' AS callee_path", "concat('function:', id, '\"') AS callee_fqn", "cast(null AS int) AS site_line")
    parts = render.callgraph_parts(calls, spark.range(1).selectExpr("20000 AS total_calls"))
    first = list(itertools.islice(parts, 3))
    found = json.loads("".join([*first, *parts]))
    assert len(found["calls"]) == found["stats"]["total_calls"] == 20_000 and found["calls"][0] == {"caller_path": "p0", "caller_fqn": "function:f", "callee_path": "q", "callee_fqn": 'function:0"', "site_line": None}
    assert sum(1 for line in "".join(render.callgraph_dot_parts(calls)).splitlines() if "->" in line) == 20_000
    assert json.loads(render.audit_json({"none": calls.limit(0), "one": calls.limit(1)}))["none"] == []
    assert render.markdown_table(calls.select("callee_path").limit(2)) == "| callee_path |\n| --- |\n| q |\n| q |"


def test_report_sections(scan):
    assert set(project.audit(scan, sections={"unresolved"})) == {"stats", "languages", "top_in", "top_out", "high_risk", "unresolved", "external"}
    found = project.audit(scan, sections={"risk"})
    assert "cycles" not in found and found["risk"].first().level in ("LOW", "MEDIUM", "HIGH")


def test_sarif_has_every_dependency(scan):
    spark = scan.nodes.sparkSession
    one = scan.deps.where("path = 'app.py' and target_path is not null").limit(1)
    many = one.crossJoin(spark.range(5001)).withColumn("raw_text", F.concat("raw_text", F.col("id").cast("string"))).drop("id")
    assert len(json.loads(render.sarif(many))["runs"][0]["results"]) == 5001
    assert {r.confidence: r.dependencies for r in render.confidence_summary(scan.deps).collect()}["ast"] > 3


def test_snapshots_are_compared(scan, tmp_path):
    project.save_snapshot(with_edges(scan, [("a", "b"), ("b", "c")]), str(tmp_path), "one")
    project.save_snapshot(with_edges(scan, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b")]), str(tmp_path), "two")
    found = project.diff_snapshots(scan.nodes.sparkSession, str(tmp_path), "one", "two")
    row = found["diff"].first()
    assert (row.files_added, row.newer_edges, row.new_cycles) == (1, 4, 1)
    assert [(r.path, r.growth, r["rank"]) for r in found["growth"].orderBy("rank").limit(2).collect()] == [("a", 1, 1), ("b", 1, 2)]
    assert [r.tag for r in project.snapshots.list_tags(scan.nodes.sparkSession, str(tmp_path)).collect()] == ["two", "one"]


def test_risk_of_a_diff(scan):
    spark = scan.nodes.sparkSession
    text = "diff --git a/models/user.py b/models/user.py\n--- a/models/user.py\n+++ b/models/user.py\n@@ -1 +1,2 @@\n-x\n+def changed(a):\n+    pass\n"
    hot = spark.createDataFrame([("models/user.py", 0.5, 3.0, 10)], "path string, bug_fix_rate double, churn_frequency double, co_change_count long")
    parts, total = project.score_diff(scan, text, hot)
    value = {r.name: r.normalized_value for r in parts.collect()}
    assert value["change_nature.line_count"] == 3 / 500 and value["change_nature.api_change"] == 1.0 and value["historical_hotspot"] == 1.0
    assert total.first().score_100 > 40 and history_zero(spark, hot) == (0, 0.0)


def history_zero(spark, hot):
    from topograph.operators import history

    row = history.hotspot_of(hot, "nowhere.py").first()
    return row.co_change_count, row.bug_fix_rate


def test_the_command_line(spark, tmp_path, capsys):
    import subprocess

    from topograph import __main__ as cli

    git = lambda *args: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=me@x", "-c", "user.name=me", *args], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("import b\n")
    (tmp_path / "b.py").write_text("def f():\n    pass\n")
    git("add", ".")
    git("commit", "-qm", "fix: start")
    git("checkout", "-qb", "work")
    (tmp_path / "b.py").write_text("def g(x):\n    pass\n")
    git("commit", "-qam", "change")
    run = lambda *args: (cli.run(spark, cli.parser().parse_args([*args[:1], str(tmp_path), *args[1:]])), capsys.readouterr().out)
    code, out = run("scan", "--incremental", "--max-file-size", "1", "--sarif-output", str(tmp_path / "s.sarif"))
    assert code == 0 and json.loads(out)["total_files"] == 2 and json.loads(out)["repository"]["branch"] == "work" and json.loads((tmp_path / "s.sarif").read_text())["version"] == "2.1.0"
    assert (tmp_path / ".topograph" / "cache").exists() and "| mutated |" in run("diff", "--ref", "main", "--format", "markdown")[1]
    code, out = run("pr-report", "--base", "main")
    assert code == 0 and "**Risk:**" in out and (tmp_path / ".topograph" / "hotspots").exists()
    assert run("snapshot", "save", "--tag", "x")[0] == 0 and run("snapshot", "check", "--tag", "x") == (0, "[]\n")
    assert json.loads(run("snapshot", "diff", "--tag", "x", "--with", "x")[1])["diff"][0]["new_cycles"] == 0
    assert "<svg" in run("viz")[1] and json.loads(run("callgraph")[1])["stats"]["total_symbols"] == 1

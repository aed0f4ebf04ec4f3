"""python -m topograph VERB PATH ...: the tool's verbs over a source tree. Exit code 1 on an alert or a high risk, if asked for."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import SparkSession

from topograph.functions import scratch
from topograph.plans import project, render
from topograph.sources import gittext
from topograph.sources.config import Config


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="topograph")
    verbs = top.add_subparsers(dest="verb", required=True)
    add = lambda name, *args: [v := verbs.add_parser(name), v.add_argument("path"), *(v.add_argument(*a[0], **a[1]) for a in args)]
    arg = lambda *names, **options: (names, options)
    out = arg("--output")
    add("scan", arg("--max-file-size", type=int), arg("--since"), arg("--incremental", action="store_true"), arg("--sarif-output"))
    add("trace", arg("files", nargs="+"), arg("--max-chains", type=int, default=50), arg("--format", choices=["json", "markdown"], default="json"))
    add("diff", arg("--staged", action="store_true"), arg("--ref"), arg("--max-chains", type=int, default=50), arg("--format", choices=["json", "markdown"], default="json"))
    add("cycles", arg("--max-length", type=int))
    add("report", *(arg(f"--include-{x}", action="store_true", help="of the optional sections give those named only; all, if none is named") for x in project.SECTIONS), arg("--max-length", type=int), arg("--json-output"), arg("--markdown-output"), arg("--sarif-output"))
    add("doctor")
    add("callgraph", arg("--file"), arg("--format", choices=["json", "mermaid", "dot"], default="json"), arg("--max-nodes", type=int, default=100), out)
    add("viz", arg("--format", choices=["html", "mermaid", "dot"], default="html"), arg("--focus"), arg("--depth", type=int, default=1), out)
    add("tests", arg("--since", default="HEAD"), arg("--format", choices=["list", "args", "json"], default="list"), arg("--max-blast", type=int, default=50))
    add("snapshot", arg("action", choices=["save", "list", "check", "diff"]), arg("--tag", default="latest"), arg("--with", dest="other", default="latest"), arg("--store"))
    add("pr-report", arg("--base", default="main"), arg("--format", choices=["github-comment", "markdown"], default="markdown"), arg("--fail-on-high-risk", action="store_true"), out)
    return top


def put(text: str, path: str | None) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


def put_parts(parts: Iterator[str], path: str | None) -> None:
    """Write a document piece by piece to a file, or print it."""
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(parts)
    else:
        sys.stdout.writelines(parts)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.verb == "doctor":
        project.doctor(spark, a.path).show(truncate=False)
        return 0
    store = getattr(a, "store", None) or f"{a.path.rstrip('/')}/.topograph/snapshots"
    if a.verb == "snapshot" and a.action == "list":
        project.snapshots.list_tags(spark, store).show(truncate=False)
        return 0
    if a.verb == "snapshot" and a.action == "diff":
        put_parts(render.audit_parts(project.diff_snapshots(spark, store, a.tag, a.other)), None)
        return 0
    config: Config = project.load_config(a.path)
    only = cache = None
    if a.verb == "scan":
        if a.max_file_size is not None:
            config = replace(config, max_file_size_kb=a.max_file_size)
        if a.since:
            only = gittext.changed_files(spark, a.path, ref=a.since)
        if a.incremental:
            cache = f"{a.path.rstrip('/')}/.topograph/cache"
    s = project.scan(spark, a.path, config, only, cache_path=cache)
    if a.verb == "scan":
        put(json.dumps(render.rows(project.stats(s))[0] | {"repository": render.rows(gittext.status(spark, a.path))[0]}, indent=2), None)
        if a.sarif_output:
            put_parts(render.sarif_parts(s.deps), a.sarif_output)
    elif a.verb in ("trace", "diff"):
        files = a.files if a.verb == "trace" else [r.path for r in gittext.changed_files(spark, a.path, a.staged, a.ref).collect()]
        found = project.trace(s, files, a.max_chains)
        put_parts(render.audit_parts(found) if a.format == "json" else render.markdown_parts("Impact", found), None)
    elif a.verb == "cycles":
        put_parts(render.audit_parts(project.cycle_tables(s, a.max_length)), None)
    elif a.verb == "report":
        tables = project.audit(s, a.max_length, {x for x in project.SECTIONS if getattr(a, f"include_{x}")} or None)
        put_parts(render.audit_parts(tables), a.json_output)
        if a.markdown_output:
            put_parts(render.markdown_parts("Audit", {"confidence": render.confidence_summary(s.deps)} | tables), a.markdown_output)
        if a.sarif_output:
            put_parts(render.sarif_parts(s.deps, tables.get("cycles")), a.sarif_output)
    elif a.verb == "callgraph":
        t = project.call_graph(s)
        calls = project.callgraph.of_file(t["calls"], a.file) if a.file else t["calls"]
        text = {"json": lambda: render.callgraph_parts(calls, t["stats"]), "mermaid": lambda: iter([render.callgraph_mermaid(calls, s.symbols, a.max_nodes) + "\n"]), "dot": lambda: render.callgraph_dot_parts(calls)}
        put_parts(text[a.format](), a.output)
    elif a.verb == "viz":
        if a.focus and a.depth > 0:
            from topograph.operators.traverse import ego

            near = ego(s.edges, s.asked([a.focus]), a.depth)
            s.edges = s.edges.join(near, ["src", "dst"], "left_semi")
            s.nodes = s.nodes.join(near.selectExpr("src as id").union(near.selectExpr("dst")).distinct(), "id", "left_semi")
        text = {"html": lambda: render.html_parts(s), "mermaid": lambda: iter([render.mermaid(s.nodes, s.edges) + "\n"]), "dot": lambda: iter([render.dot(s.nodes, s.edges, s.degrees) + "\n"])}
        put_parts(text[a.format](), a.output)
    elif a.verb == "tests":
        chosen = [r.test for r in project.select_tests(s, gittext.run_git(a.path, "diff", "--unified=0", a.since), a.max_blast)["tests"].collect()]
        put({"list": "\n".join(chosen), "args": " ".join(chosen), "json": json.dumps(chosen)}[a.format], None)
    elif a.verb == "snapshot":
        if a.action == "save":
            project.save_snapshot(s, store, a.tag, *gittext.head(a.path))
        else:
            alerts = render.rows(project.check_trends(s, store, a.tag))
            put(json.dumps(alerts, indent=2), None)
            return int(any(x["severity"] == "CRITICAL" for x in alerts))
    else:
        hot = project.hotspots(spark, a.path, f"{a.path.rstrip('/')}/.topograph/hotspots")
        text = gittext.run_git(a.path, "diff", "--unified=0", f"{a.base}...HEAD")
        t = project.pr_report(s, [r.path for r in gittext.changed_files(spark, a.path, ref=a.base).collect()], hot, text or None)
        put(render.pr_markdown(t, a.format == "github-comment"), a.output)
        return int(a.fail_on_high_risk and t["risk"].first().level == "HIGH")
    return 0


def main() -> int:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("topograph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, args)
    except KeyboardInterrupt:
        return 130
    finally:
        scratch.clear(spark)


if __name__ == "__main__":
    sys.exit(main())

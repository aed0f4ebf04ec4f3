"""The verbs of the tool over a source tree: scan, trace, diff, cycles, report, call graph, tests, snapshot, pull-request report, doctor."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.functions.scalar import is_test, norm_path
from topograph.functions.scratch import materialize
from topograph.operators import callgraph, centrality, cycles, diff, graph, history, impact, risk, selection, snapshots
from topograph.operators.resolve import resolve
from topograph.sources import gittext, parse, tree
from topograph.sources.config import Config, script_aliases, script_exports


@dataclass
class Scan:
    """The tables of one scan."""

    files: DataFrame
    deps: DataFrame
    symbols: DataFrame
    calls: DataFrame
    bindings: DataFrame
    dynamic_imports: DataFrame
    warnings: DataFrame
    nodes: DataFrame
    edges: DataFrame
    config: Config = field(default_factory=Config)

    @property
    def tests(self) -> DataFrame:
        return self.nodes.where(is_test(F.col("id"), self.config.test_patterns, self.config.test_dirs)).select("id")

    @property
    def degrees(self) -> DataFrame:
        return graph.degrees(self.nodes, self.edges)

    def asked(self, paths: list[str]) -> DataFrame:
        """The given paths, normalised, as ids."""
        spark = self.nodes.sparkSession
        return spark.createDataFrame([(p,) for p in paths], "id string").select(norm_path(F.col("id")).alias("id")).distinct()


def load_config(root: str, name: str = "topograph.json") -> Config:
    path = os.path.join(root, name)
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        return Config.from_json(f.read())


def scan(spark: SparkSession, root: str, config: Config | None = None, only: DataFrame | None = None, cache: DataFrame | None = None, ts_paths: dict[str, list[str]] | None = None, exports: dict[str, str] | None = None, cache_path: str | None = None) -> Scan:
    """Read, parse and resolve a tree.

    only (path) restricts what is parsed, not the index. cache holds rows
    parsed before; with cache_path they are read from there, if it has any, and
    what the next scan may use is left there. Aliases and exports come from
    the tree's tsconfig.json and package.json unless given.
    """
    config = config or load_config(root)
    every = tree.read_tree(spark, root, config)
    mine = every if only is None else tree.subset(every, only)
    todo = mine.where("not skipped")
    if cache_path is not None:
        cache = saved_cache(spark, cache_path)
    parsed = parse.parse_files(todo if cache is None else tree.to_parse(todo, cache))
    if cache is not None:
        parsed = tree.refresh_cache(cache.select(parsed.columns), todo, parsed)
    if cache_path is not None:
        parsed = materialize(parsed, "parsed")  # the cache that it was made of is replaced
        kept = parsed.unionByName(parse.silent(todo, parsed))
        if only is not None and cache is not None:
            kept = kept.unionByName(cache.select(parsed.columns).join(todo.select("path"), "path", "left_anti").join(every.select("path"), "path", "left_semi"))
        tree.store_cache(materialize(kept, "kept"), cache_path, cache)
    t = parse.tables(parsed)
    ts_paths = script_aliases(root) if ts_paths is None else ts_paths
    exports = script_exports(root) if exports is None else exports
    deps = materialize(resolve(t["raw_deps"], every.select("path"), ts_paths, exports), "deps")
    files = materialize(mine.select("path", "language", "suffix", "size_bytes", "mtime", "sha1", "is_script", "skipped", F.lit(None).cast("string").alias("error")).where("not skipped"), "files")
    nodes = materialize(graph.file_nodes(files, deps, t["symbols"]), "nodes")
    edges = materialize(graph.internal_edges(deps), "edges")
    large = mine.where("skipped").select("path", F.lit("over the size limit").alias("warning"))
    return Scan(files, deps, t["symbols"], t["calls"], t["bindings"], t["dynamic_imports"], t["warnings"].unionByName(large), nodes, edges, config)


def saved_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows a scan left at path; None if there are none, or if they can't be read."""
    return tree.stored_cache(spark, path, parse.SCHEMA)


def stats(s: Scan) -> DataFrame:
    return graph.graph_stats(s.nodes, s.edges, s.deps, s.files)


#: Nodes up to which betweenness is exact; beyond, it is estimated within this error.
EXACT_NODES, BETWEENNESS_ERROR = 2000, 0.01


def node_betweenness(s: Scan, error: float | None = None) -> DataFrame:
    """(id, betweenness): exact for EXACT_NODES nodes or fewer, else within error (BETWEENNESS_ERROR) with 95 % confidence; error=0 is exact."""
    if error is None:
        error = BETWEENNESS_ERROR if s.nodes.count() > EXACT_NODES else 0.0
    if not error:
        return centrality.betweenness(s.nodes, s.edges)
    return centrality.estimated_betweenness(s.nodes, s.edges, error).select("id", "betweenness")


def score(s: Scan, paths: DataFrame, hotspots: DataFrame | None = None, symbols: DataFrame | None = None, with_cycles: bool = False, lines: int | None = None, error: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(components, total) of the risk of changing paths (id); error bounds that of betweenness, see node_betweenness."""
    known = paths.join(s.nodes.select("id"), "id", "left_semi")
    blast = impact.impact_together(s.nodes, s.edges, known)
    found = cycles.simple_cycles(s.edges) if with_cycles else None
    parts = materialize(risk.risk_components(paths, known, s.nodes, s.degrees, node_betweenness(s, error), blast, hotspots, found, symbols, s.config.weights, lines), "risk")
    return parts, risk.risk_total(parts, s.config.high_threshold, s.config.medium_threshold)


def score_diff(s: Scan, diff_text: str, hotspots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(components, total) of the risk of a diff: its files, the symbols and the lines that it changes, and the history of its files."""
    lines = gittext.lines(s.nodes.sparkSession, diff_text)
    rows = materialize(diff.diff_lines(lines).where("path is not null"), "diff")
    symbols = materialize(diff.changed_symbols(lines), "symbols")
    changed = rows.select(F.col("path").alias("id")).distinct()
    count = rows.where("kind in ('added', 'removed')").count()
    return score(s, changed, hotspots, symbols if not symbols.isEmpty() else None, lines=count)


def trace(s: Scan, paths: list[str], max_chains: int = 50) -> dict[str, DataFrame]:
    """Impact of each path and of all, shortest chains, and risk."""
    known = s.asked(paths).join(s.nodes.select("id"), "id", "left_semi")
    parts, total = score(s, known)
    return {"per_file": impact.impact_per_node(s.nodes, s.edges, known), "together": impact.impact_together(s.nodes, s.edges, known), "chains": impact.impact_chains(s.edges, known, max_chains), "components": parts, "risk": total}


def cycle_tables(s: Scan, max_length: int | None = None, keep: int = 100) -> dict[str, DataFrame]:
    found = materialize(cycles.simple_cycles(s.edges, max_length), "cycles")
    parts = materialize(cycles.strong_components(s.edges), "components")
    return {"cycles": found.orderBy("length", "nodes").limit(keep), "report": cycles.cycle_report(s.nodes, found, parts, max_length), "participants": cycles.participants(found)}


def call_graph(s: Scan) -> dict[str, DataFrame]:
    found = materialize(callgraph.build(s.calls, s.bindings, s.symbols), "calls")
    return {"calls": found, "stats": callgraph.stats(found, s.symbols)}


def select_tests(s: Scan, diff_text: str, limit: int = 50) -> dict[str, DataFrame]:
    """Tests for a diff; without any changed symbol the file-level choice."""
    spark = s.nodes.sparkSession
    lines = gittext.lines(spark, diff_text)
    changed = materialize(diff.diff_lines(lines).where("path is not null").select(F.col("path").alias("id")).distinct(), "changed")
    chosen = selection.select_tests(s.edges, changed, s.tests, limit)
    if diff.changed_symbols(lines).isEmpty():
        chosen = selection.select_tests_by_file(s.nodes, s.edges, changed, s.tests, limit)
    return {"tests": chosen, "summary": selection.selection_summary(s.edges, changed, s.tests, chosen)}


def pr_report(s: Scan, paths: list[str], hotspots: DataFrame | None = None, diff_text: str | None = None) -> dict[str, DataFrame]:
    changed = s.asked(paths)
    known = changed.join(s.nodes.select("id"), "id", "left_semi")
    hit = impact.impact(s.edges, known).select(F.col("affected").alias("id")).union(changed).distinct()
    parts, total = score(s, changed, hotspots) if diff_text is None else score_diff(s, diff_text, hotspots)
    return {"affected": hit, "top": selection.top_affected(hit, s.degrees), "tests": selection.suggest_tests(s.edges, hit, s.tests), "components": parts, "risk": total}


def history_of(spark: SparkSession, root: str, days: int = 90) -> DataFrame:
    """Hotspots by the log of a repository."""
    text = gittext.run_git(root, "log", f"--since={days} days ago", "--name-only", "--format=%H %ae %aI %s")
    commits, files = gittext.parse_log(gittext.lines(spark, text))
    return history.hotspots(history.commit_flags(commits), files)


def hotspots(spark: SparkSession, root: str, store: str | None = None, days: int = 90, keep_days: int = 7) -> DataFrame:
    """Hotspots by the log of a repository; those kept at store, if they are younger than keep_days, else new ones that are kept there."""
    if store is not None:
        try:
            found = history.fresh(spark.read.parquet(store), days=keep_days)
            if not found.isEmpty():
                return found.drop("computed_at")
        except AnalysisException:
            pass
    found = materialize(history_of(spark, root, days), "hotspots")
    if store is not None:
        found.withColumn("computed_at", F.current_timestamp()).write.mode("overwrite").parquet(store)
    return found


def diff_snapshots(spark: SparkSession, store: str, old: str, new: str) -> dict[str, DataFrame]:
    """What changed between two saved snapshots, and the paths whose in-degree grew most."""
    a, b = ({name: snapshots.table(spark, store, name).where(F.col("tag") == snapshots.find_tag(spark, store, tag)) for name in ("metrics", "edges", "cycles")} for tag in (old, new))
    return {"diff": snapshots.diff(a["metrics"], b["metrics"], a["edges"], b["edges"], a["cycles"], b["cycles"]), "growth": snapshots.largest_growth(a["metrics"], b["metrics"]), "new_cycles": snapshots.new_cycles(a["cycles"], b["cycles"])}


def save_snapshot(s: Scan, store: str, tag: str, commit: str = "unknown", message: str = "") -> None:
    found = cycles.simple_cycles(s.edges)
    snapshots.save(store, tag, snapshots.metrics(tag, s.degrees, node_betweenness(s)), s.edges, found, commit, message)


def check_trends(s: Scan, store: str, tag: str) -> DataFrame:
    """Alerts of the scan against a saved snapshot; nothing is written.

    The snapshot's cycles are those of its edges, as an older one may have been saved without all of them.
    """
    spark = s.nodes.sparkSession
    old = {name: snapshots.table(spark, store, name).where(F.col("tag") == snapshots.find_tag(spark, store, tag)) for name in ("metrics", "edges")}
    return snapshots.trend_alerts(old["metrics"], snapshots.metrics("now", s.degrees), old["edges"], s.edges, cycles.simple_cycles(old["edges"]), cycles.simple_cycles(s.edges))


#: Sections of a report that may be left out.
SECTIONS = ("cycles", "risk", "unresolved")


def audit(s: Scan, max_length: int | None = None, sections: set[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a report; of SECTIONS those asked for, all if None. Risk is that of changing the five files most depended on."""
    wanted = set(SECTIONS) if sections is None else sections
    deg = s.degrees
    out = {"stats": stats(s), "languages": graph.language_breakdown(s.files), "top_in": graph.top(deg, "in_degree"), "top_out": graph.top(deg, "out_degree"), "high_risk": graph.high_risk(deg)}
    if "cycles" in wanted:
        out |= cycle_tables(s, max_length)
    if "risk" in wanted:
        out["risk"] = score(s, materialize(graph.top(deg, "in_degree", 5).select("id"), "top"))[1]
    if "unresolved" in wanted:
        out["unresolved"] = s.deps.where("is_unresolved").select("path", "line", "raw_text", "resolution_note").distinct().orderBy("path", "line", "raw_text").limit(50)
    return out | {"external": s.deps.where("is_external and not is_unresolved").select("raw_text").distinct().orderBy("raw_text").limit(50)}


def doctor(spark: SparkSession, root: str) -> DataFrame:
    """(check, ok, detail) of what a scan needs."""
    n = tree.read_tree(spark, root, load_config(root)).count()
    rows = [("files", n > 0, f"{n} files can be scanned"), ("repository", gittext.is_repository(root), root), ("configuration", True, str(load_config(root).max_file_size_kb) + " KB limit"), ("parsers", True, ", ".join(parse.PARSERS))]
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")

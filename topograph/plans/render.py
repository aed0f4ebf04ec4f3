"""Reports as text: JSON, SARIF, Markdown, Mermaid, DOT, HTML. What grows with a project is put together as rows; texts are for reports of bounded size."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions import scalar as S
from topograph.plans.project import Scan

SARIF_RULES = [
    ("internal-dependency", "Internal module dependency", "note"),
    ("external-dependency", "External package dependency", "warning"),
    ("unresolved-dependency", "Unresolved dependency", "error"),
    ("dependency-cycle", "Circular dependency", "warning"),
]


def rows(df: DataFrame, limit: int | None = None) -> list[dict]:
    """Rows of a report table as plain values, all of them unless a limit is given."""
    text = (df if limit is None else df.limit(limit)).select(F.to_json(F.struct("*")).alias("row"))
    return [json.loads(r.row) for r in text.collect()]


def sarif_results(deps: DataFrame) -> DataFrame:
    """(path, result): one SARIF result as JSON for each dependency, by its strongest property."""
    e, s, u = F.col("is_external"), F.col("is_stdlib"), F.col("is_unresolved")
    result = F.struct(
        S.sarif_rule(e, u).alias("ruleId"),
        S.sarif_level(e, u).alias("level"),
        F.struct(S.sarif_message(e, s, u, F.col("raw_text"), F.col("target_path"), F.col("resolution_note")).alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct(F.coalesce("target_path", "raw_text").alias("dependency"), "kind", "confidence", "confidence_source").alias("properties"),
    )
    return deps.select("path", F.to_json(result).alias("result"))


def cycle_results(cycles: DataFrame, limit: int = 20) -> DataFrame:
    """(result): SARIF results of the first cycles."""
    text = F.concat(F.lit("Circular dependency: "), F.array_join(F.concat("nodes", F.slice("nodes", 1, 1)), " -> "))
    where = F.struct(F.struct(F.struct(F.element_at("nodes", 1).alias("uri")).alias("artifactLocation"), F.struct(F.lit(1).alias("startLine")).alias("region")).alias("physicalLocation"))
    return cycles.orderBy("length", "nodes").limit(limit).select(F.to_json(F.struct(F.lit("dependency-cycle").alias("ruleId"), F.lit("warning").alias("level"), F.struct(text.alias("text")).alias("message"), F.array(where).alias("locations"))).alias("result"))


def sarif_parts(deps: DataFrame, cycles: DataFrame | None = None) -> Iterator[str]:
    """A SARIF 2.1.0 document of all results by path, piece by piece: the driver holds one partition of them at a time."""
    rules = [{"id": i, "shortDescription": {"text": t}, "defaultConfiguration": {"level": level}} for i, t, level in SARIF_RULES]
    frame = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "topograph", "rules": rules}}, "results": []}]})
    head, tail = frame[: frame.rindex("[]") + 1], frame[frame.rindex("[]") + 1 :]
    yield head
    before = "\n"
    for found in (sarif_results(deps).orderBy("path", "result"), cycle_results(cycles) if cycles is not None else None):
        for row in found.toLocalIterator() if found is not None else ():
            yield before + row.result
            before = ",\n"
    yield tail


def sarif(deps: DataFrame, cycles: DataFrame | None = None) -> str:
    return "".join(sarif_parts(deps, cycles))


def row_texts(df: DataFrame) -> Iterator[str]:
    """Rows as JSON; the driver holds one partition of them at a time."""
    for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).toLocalIterator():
        yield r.row


def _listed(texts: Iterator[str]) -> Iterator[str]:
    before = "[\n"
    for text in texts:
        yield before + text
        before = ",\n"
    yield "]" if before != "[\n" else "[]"


def audit_parts(tables: dict[str, DataFrame]) -> Iterator[str]:
    """A JSON object of whole tables, piece by piece."""
    yield '{"version": "1.0"'
    for name, df in tables.items():
        yield f",\n{json.dumps(name)}: "
        yield from _listed(row_texts(df))
    yield "}\n"


def audit_json(tables: dict[str, DataFrame]) -> str:
    return "".join(audit_parts(tables))


def confidence_summary(deps: DataFrame) -> DataFrame:
    """(confidence, score, dependencies): how sure the dependencies are, the surest first."""
    score = S.confidence_score(F.col("confidence"))
    return deps.groupBy("confidence", score.alias("score")).agg(F.count(F.lit(1)).alias("dependencies")).orderBy(F.desc("score"), "confidence")


def _table_lines(df: DataFrame, limit: int | None = None) -> Iterator[str]:
    head = df.columns
    cell = lambda v: "" if v is None else " → ".join(map(str, v)) if isinstance(v, list) else str(v)
    yield "| " + " | ".join(head) + " |\n|" + " --- |" * len(head)
    for text in row_texts(df if limit is None else df.limit(limit)):
        r = json.loads(text)
        yield "\n| " + " | ".join(cell(r.get(c)).replace("|", "\\|") for c in head) + " |"


def markdown_table(df: DataFrame, limit: int | None = None) -> str:
    return "".join(_table_lines(df, limit))


def markdown_parts(title: str, tables: dict[str, DataFrame], limit: int | None = None) -> Iterator[str]:
    """A section for each table, piece by piece."""
    yield f"# {title}"
    for name, df in tables.items():
        yield f"\n\n## {name.replace('_', ' ').capitalize()}\n\n"
        yield from _table_lines(df, limit)
    yield "\n"


def markdown(title: str, tables: dict[str, DataFrame], limit: int | None = None) -> str:
    return "".join(markdown_parts(title, tables, limit))


def pr_markdown(tables: dict[str, DataFrame], comment: bool = True) -> str:
    total = tables["risk"].first()
    parts = ["## Change impact" if comment else "# Change impact", f"**Risk:** {total.level} ({total.score_100:.1f} of 100)", f"**Affected:** {tables['affected'].count()} files", markdown_table(tables["top"], 15)]
    tests = [r.test for r in tables["tests"].orderBy("test").limit(10).collect()]
    return "\n\n".join([*parts, *(["**Tests:**\n" + "\n".join(f"- `{t}`" for t in tests)] if tests else [])]) + "\n"


def _drawn(nodes: DataFrame, edges: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    if limit is None:
        return nodes, edges
    some = nodes.orderBy("id").limit(limit)
    ids = some.select("id")
    return some, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def mermaid(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> str:
    """A flowchart of the first limit nodes, by language."""
    some, inside = _drawn(nodes, edges, limit)
    lines, language = ["flowchart LR"], None
    for r in some.select("language", S.safe_id(F.col("id")).alias("i"), S.escape_mermaid(F.col("id")).alias("t")).orderBy("language", "i").collect():
        if r.language != language:
            lines += ["    end"] * (language is not None) + [f"    subgraph {r.language}"]
            language = r.language
        lines.append(f'        {r.i}["{r.t}"]')
    lines += ["    end"] * (language is not None)
    lines += [f"    {r.line}" for r in inside.select(F.concat(S.safe_id(F.col("src")), F.lit(" -->|"), F.coalesce("kind", F.lit("import")), F.lit("| "), S.safe_id(F.col("dst"))).alias("line")).orderBy("line").collect()]
    return "\n".join(lines)


# Colours of languages.
COLOURS = {"python": "#3572A5", "java": "#b07219", "kotlin": "#A97BFF", "cpp": "#f34b7d", "javascript": "#f1e05a", "typescript": "#3178c6"}


def dot(nodes: DataFrame, edges: DataFrame, degree: DataFrame, limit: int = 1000) -> str:
    some, inside = _drawn(nodes, edges, limit)
    lines = ["digraph dependencies {", "  rankdir=LR;"]
    for r in some.join(degree, "id").select(S.escape_dot(F.col("id")).alias("t"), "language", "in_degree").orderBy("t").collect():
        lines.append(f'  "{r.t}" [color="{"red" if r.in_degree > 5 else COLOURS.get(r.language, "#999999")}"];')
    for r in inside.select(S.escape_dot(F.col("src")).alias("a"), S.escape_dot(F.col("dst")).alias("b"), F.coalesce("kind", F.lit("import")).alias("k")).orderBy("a", "b").collect():
        lines.append(f'  "{r.a}" -> "{r.b}" [label="{r.k}"];')
    return "\n".join([*lines, "}"])


# Files of one folder make a group; beyond 300 nodes groups are drawn, on a spiral by size, and a click opens one. Groups within a group and single files show the edges among what is drawn.
_DRAW = """const svg=document.getElementById('g'),by=new Map(nodes.map(n=>[n.id,n]));let open='';
const under=(id,p)=>{const r=id.slice(p.length),i=r.indexOf('/');return i<0?id:p+r.slice(0,i+1)};
function shown(){const inside=nodes.filter(n=>n.id.startsWith(open));if(inside.length<=300)return new Map(inside.map(n=>[n.id,{id:n.id,n:1,r:n.size/2,c:colours[n.language]||'#999'}]));
const m=new Map();for(const n of inside){const k=under(n.id,open),g=m.get(k)||{id:k,n:0,c:colours[n.language]||'#999'};g.n++;g.r=4+2*Math.sqrt(g.n);m.set(k,g)}return m}
function draw(){const m=shown(),all=[...m.values()].sort((a,b)=>b.n-a.n||(a.id<b.id?-1:1)),whole=!all.some(g=>g.n>1);let area=0;
for(const g of all){const t=Math.sqrt(area)*.9;area+=(g.r+3)**2;const w=2.4*Math.sqrt(area);g.x=450+t*Math.cos(w/6);g.y=450+t*Math.sin(w/6)}
const at=id=>m.get(id)||(whole?null:id.startsWith(open)?m.get(under(id,open)):null),links=new Map();
for(const n of nodes){const a=at(n.id);if(a)for(const d of n.deps||[]){const b=at(d);if(b&&b!==a){const k=a.id+'>'+b.id;links.set(k,[a,b,1+(links.get(k)||[0,0,0])[2]])}}}
let s='';for(const [a,b,k] of links.values())s+=`<line x1="${a.x}" y1="${a.y}" x2="${b.x}" y2="${b.y}" stroke="#bbb" stroke-width="${Math.min(6,.5+Math.log2(k))}"/>`;svg.innerHTML=s;
for(const g of all){const c=document.createElementNS(svg.namespaceURI,'circle'),t=document.createElementNS(svg.namespaceURI,'title');c.setAttribute('cx',g.x);c.setAttribute('cy',g.y);c.setAttribute('r',g.r);c.setAttribute('fill',g.c);t.textContent=g.id+(g.n>1?` (${g.n})`:'');c.append(t);c.onclick=()=>{open=g.n>1&&g.id.endsWith('/')?g.id:'';draw()};svg.append(c)}}
const list=document.getElementById('l'),q=document.getElementById('q');q.oninput=()=>{list.textContent='';for(const n of nodes.filter(n=>n.id.includes(q.value)).slice(0,500)){const i=document.createElement('li');i.textContent=`${n.id} ${n.in_degree} in, ${n.out_degree} out`;list.append(i)}};
draw();q.oninput();"""


def html_parts(s: Scan, limit: int | None = None) -> Iterator[str]:
    """A page with the graph and a list of nodes that can be searched, piece by piece; large graphs are drawn by folders."""
    some, inside = _drawn(s.nodes, s.edges, limit)
    deps = inside.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("deps"))
    found = some.join(s.degrees, "id").join(deps, "id", "left").select("id", "language", "in_degree", "out_degree", S.node_size(F.col("in_degree")).alias("size"), "deps").orderBy("id")
    yield '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Dependencies</title></head><body><svg id="g" viewBox="0 0 900 900" width="900"></svg><br><input id="q" placeholder="filter"><ul id="l"></ul><script>const nodes='
    for text in _listed(row_texts(found)):
        yield text.replace("</", "<\\/")
    yield f";const colours={json.dumps(COLOURS)};{_DRAW}</script></body></html>\n"


def html_page(s: Scan, limit: int | None = None) -> str:
    return "".join(html_parts(s, limit))


def callgraph_parts(calls: DataFrame, stats: DataFrame) -> Iterator[str]:
    """Statistics and all calls as a JSON object, piece by piece."""
    yield f'{{"stats": {json.dumps(rows(stats)[0])},\n"calls": '
    yield from _listed(row_texts(calls.orderBy("caller_path", "caller_fqn", "callee_path", "callee_fqn")))
    yield "}\n"


def callgraph_mermaid(calls: DataFrame, symbols: DataFrame, max_nodes: int = 100) -> str:
    """The first max_nodes symbols by file, and the calls among them."""
    nodes = symbols.select(F.concat_ws("::", "path", "fqn").alias("id"), F.col("path").alias("language"), S.symbol_label(F.col("symbol_type")).alias("label")).dropDuplicates(["id"])
    edges = calls.select(F.concat_ws("::", "caller_path", "caller_fqn").alias("src"), F.concat_ws("::", "callee_path", "callee_fqn").alias("dst"), F.col("confidence").alias("kind"))
    return mermaid(nodes, edges, max_nodes)


def callgraph_dot_parts(calls: DataFrame) -> Iterator[str]:
    """All calls as a graph, a line at a time."""
    yield "digraph calls {"
    lines = calls.select(F.concat(F.lit('  "'), S.escape_dot(F.concat_ws("::", "caller_path", "caller_fqn"), False), F.lit('" -> "'), S.escape_dot(F.concat_ws("::", "callee_path", "callee_fqn"), False), F.lit('";')).alias("line")).distinct()
    for r in lines.orderBy("line").toLocalIterator():
        yield "\n" + r.line
    yield "\n}\n"

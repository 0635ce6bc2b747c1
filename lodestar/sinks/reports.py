"""Reports, pages and pictures of a graph, rendered on the driver from bounded aggregates; pushes to graph databases; backups."""

from __future__ import annotations

import html
import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import community as C
from ..operators import graph as G

#: Nodes that a page or picture shows one by one; a larger graph is shown by its communities.
SHOWN = 5000
#: Folders on a page.
FOLDERS = 50_000
#: Share of ambiguous edges above which a report speaks of gaps.
GAPS = 20


def report(nodes: DataFrame, edges: DataFrame, top: int = 10) -> str:
    """Markdown: sizes, confidence, hubs, communities, surprises, bridges, what is isolated or thin. ``nodes`` have a community."""
    s = G.stats(nodes, edges).first()
    labels = {r.community: r.label for r in C.hub_labels(nodes, edges).orderBy(F.desc("degree"), "community").limit(200).collect()}
    out = ["# Graph report", "", f"{s.n_nodes} nodes, {s.n_edges} edges, {s.n_communities} communities.", ""]
    out += [f"Extracted {s.pct_extracted} %, inferred {s.pct_inferred} %, ambiguous {s.pct_ambiguous} %."]
    out += ["", "More than a fifth of the edges is ambiguous: the graph has gaps."] if s.pct_ambiguous > GAPS else []
    out += ["", "## Hubs", ""] + [f"- {r.label} ({r.degree})" for r in G.god_nodes(nodes, edges, top).collect()]
    out += ["", "## Communities", ""] + [f"- {labels.get(r.community, f'Community {r.community}')}: {r.n} nodes, cohesion {r.cohesion:.3f}" for r in C.cohesion(nodes, edges).orderBy(F.desc("n"), "community").limit(top).collect()]
    out += ["", "## Surprising connections", ""] + [f"- {r.src} {r.relation} {r.dst} ({r.score})" for r in C.surprises(nodes, edges).orderBy(F.desc("score"), "src", "dst").limit(top).collect()]
    out += ["", "## Bridges", ""] + [f"- {r.a} and {r.b}: {r.src} {r.relation} {r.dst}" for r in C.bridges(nodes, edges).orderBy("a", "b").limit(top).collect()]
    out += ["", f"{C.isolated(nodes, edges).count()} nodes with at most one edge, {C.thin(nodes).count()} thin communities."]
    return "\n".join(out) + "\n"


def _small(nodes: DataFrame, edges: DataFrame) -> tuple[list, list]:
    """Nodes (id, label, group, size) and edges (src, dst, weight) to show: the graph itself, or its communities where it is large."""
    if nodes.limit(SHOWN + 1).count() <= SHOWN:
        n = nodes.join(G.degree(edges), "id", "left").select("id", "label", "community", F.coalesce("degree", F.lit(0)).alias("size")).collect()
        e = edges.groupBy("src", "dst").agg(F.count("*").alias("w")).orderBy(F.desc("w"), "src", "dst").limit(4 * SHOWN).collect()
        return [(r.id, r.label, r.community, r.size) for r in n], [(r.src, r.dst, r.w) for r in e]
    groups = nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(SHOWN).collect()
    shown = {r.community for r in groups}
    names = {r.community: r.label for r in C.hub_labels(nodes, edges).collect() if r.community in shown}
    links = C.crossings(nodes, edges).orderBy(F.desc("n"), "a", "b").limit(4 * SHOWN).collect()
    return [(str(r.community), names.get(r.community, ""), r.community, r.n) for r in groups], [(str(r.a), str(r.b), r.n) for r in links if r.a in shown and r.b in shown]


def page(nodes: DataFrame, edges: DataFrame, title: str = "Graph") -> str:
    """A page that draws the graph (or its communities) by itself, without anything from elsewhere."""
    n, e = _small(nodes, edges)
    data = json.dumps({"nodes": [{"id": i, "label": x, "group": g, "size": s} for i, x, g, s in n], "edges": [{"a": a, "b": b, "w": w} for a, b, w in e]}, sort_keys=True).replace("</", "<\\/")
    script = "const c=document.querySelector('canvas'),x=c.getContext('2d'),p={};c.width=innerWidth;c.height=innerHeight;g.nodes.forEach((n,i)=>{const a=i*2.399963,r=12*Math.sqrt(i);p[n.id]=[c.width/2+r*Math.cos(a),c.height/2+r*Math.sin(a)]});x.strokeStyle='#ccc';g.edges.forEach(e=>{if(p[e.a]&&p[e.b]){x.beginPath();x.moveTo(...p[e.a]);x.lineTo(...p[e.b]);x.stroke()}});g.nodes.forEach(n=>{x.fillStyle='hsl('+(n.group||0)*47%360+',60%,45%)';x.beginPath();x.arc(...p[n.id],2+Math.log2(1+n.size),0,7);x.fill();x.fillText(n.label,...p[n.id])})"
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><canvas></canvas><script>const g={data};{script}</script>\n"


def svg(nodes: DataFrame, edges: DataFrame, width: int = 1200) -> str:
    """A picture: nodes on a spiral by falling size, edges as lines."""
    n, e = _small(nodes, edges)
    n.sort(key=lambda r: (-r[3], r[0]))
    at = {r[0]: (width / 2 + 9 * math.sqrt(k) * math.cos(2.399963 * k), width / 2 + 9 * math.sqrt(k) * math.sin(2.399963 * k)) for k, r in enumerate(n)}
    lines = [f'<line x1="{at[a][0]:.1f}" y1="{at[a][1]:.1f}" x2="{at[b][0]:.1f}" y2="{at[b][1]:.1f}" stroke="#bbb"/>' for a, b, _ in e if a in at and b in at]
    dots = [f'<circle cx="{at[i][0]:.1f}" cy="{at[i][1]:.1f}" r="{2 + math.log2(1 + s):.1f}"><title>{html.escape(x or i)}</title></circle>' for i, x, _, s in n]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{width}">{"".join(lines)}{"".join(dots)}</svg>\n'


def tree_page(rollup: DataFrame, most: int = 200) -> str:
    """A page of nested folders with their totals (``path, total``); of a folder's children the ``most`` largest are shown, the others counted.

    At most ``FOLDERS`` are shown, upper ones first; how many are left out stands at the end."""
    parent = F.when(F.col("path") == "", None).otherwise(F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    ranked = rollup.withColumn("parent", parent).withColumn("k", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("total"), "path")))
    shown = ranked.where(F.col("k") <= most)
    rows = shown.orderBy(F.size(F.split("path", "/")), F.desc("total"), "path").limit(FOLDERS + 1).collect()
    left = shown.count() - FOLDERS if len(rows) > FOLDERS else 0
    rows = sorted(rows[:FOLDERS], key=lambda r: r.path)
    more = {r.parent: r.n for r in ranked.where(F.col("k") > most).groupBy("parent").agg(F.count("*").alias("n")).collect()}
    children: dict = {}
    for r in rows:
        if r.parent is not None or r.path == "":
            children.setdefault(r.parent if r.path else None, []).append(r)

    def show(r) -> str:
        inner = "".join(map(show, children.get(r.path, ()))) if r.path in children else ""
        rest = f"<li>(+{more[r.path]} more)" if r.path in more else ""
        return f"<li>{html.escape(r.path.rsplit('/', 1)[-1] or '/')} ({r.total})" + (f"<ul>{inner}{rest}</ul>" if inner or rest else "")

    note = f"<p>{left} folders further down are left out" if left else ""
    return "<!DOCTYPE html><meta charset=utf-8><ul>" + "".join(map(show, children.get(None, ()))) + f"</ul>{note}\n"


def flow_page(nodes: DataFrame, edges: DataFrame) -> str:
    """A page of the calls between sections (communities): a row per pair with its number of edges and relations."""
    from ..operators.rag import sections

    rows = sections(nodes, edges).groupBy("a", "b").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("relation")), ", ").alias("relations")).orderBy(F.desc("n"), "a", "b").limit(SHOWN).collect()
    body = "".join(f"<tr><td>{'' if r.a is None else r.a}<td>{'' if r.b is None else r.b}<td>{r.n}<td>{html.escape(r.relations)}" for r in rows)
    return f"<!DOCTYPE html><meta charset=utf-8><table><tr><th>from<th>to<th>edges<th>relations{body}</table>\n"


def canvas(nodes: DataFrame, edges: DataFrame) -> str:
    """A JSON canvas of notes and the links among them."""
    n, e = _small(nodes, edges)
    side = max(1, math.isqrt(len(n)))
    cards = [{"id": i, "type": "text", "text": x or i, "x": 320 * (k % side), "y": 160 * (k // side), "width": 280, "height": 120} for k, (i, x, _, _) in enumerate(sorted(n))]
    links = [{"id": f"e{k}", "fromNode": a, "toNode": b} for k, (a, b, _) in enumerate(e)]
    return json.dumps({"nodes": cards, "edges": links}, indent=1)


def lessons_text(lessons: DataFrame, most: int = 50) -> str:
    """Markdown of what was learnt (``node, score, pos, neg, status``)."""
    rows = lessons.where("status <> 'none'").orderBy(F.desc(F.abs("score")), "node").limit(most).collect()
    out = ["# Lessons", ""]
    for status in ("preferred", "tentative", "contested", "avoid"):
        own = [f"- {r.node}: {r.score:.3f} (+{r.pos} / -{r.neg})" for r in rows if r.status == status]
        out += [f"## {status}", "", *own, ""] if own else []
    return "\n".join(out)


def push(nodes: DataFrame, edges: DataFrame, connect: Callable[[], object]) -> None:
    """Writes a graph through ``connect()`` in every task: an object with ``run(statement, parameters)`` and ``close()``; nodes come first."""
    label = F.initcap(F.regexp_replace("file_type", "[^A-Za-z0-9_]", "_"))
    kind = F.upper(F.regexp_replace("relation", "[^A-Za-z0-9_]", "_"))
    n = nodes.select(F.concat(F.lit("MERGE (n:"), label, F.lit(" {id: $id}) SET n.label = $label")).alias("statement"), F.create_map(F.lit("id"), "id", F.lit("label"), "label").alias("parameters"))
    e = edges.select(F.concat(F.lit("MATCH (a {id: $src}), (b {id: $dst}) MERGE (a)-[:"), kind, F.lit("]->(b)")).alias("statement"), F.create_map(F.lit("src"), "src", F.lit("dst"), "dst").alias("parameters"))

    def send(rows) -> None:
        session = connect()
        try:
            for r in rows:
                session.run(r.statement, r.parameters)
        finally:
            session.close()

    n.foreachPartition(send)
    e.foreachPartition(send)


def back_up(spark: SparkSession, path: str, keep: int = 3) -> list[str]:
    """Moves an export aside before it is written anew, and drops all but the last ``keep`` such copies; gives what is kept."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = fs_path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    name = at.getName()
    olds = sorted(s.getPath().toString() for s in fs.listStatus(at.getParent()) if s.getPath().getName().startswith(f"{name}.backup-")) if fs.exists(at.getParent()) else []
    if fs.exists(at):
        last = int(olds[-1].rsplit("-", 1)[-1]) if olds else 0
        new = f"{path}.backup-{last + 1:06d}"
        fs.rename(at, fs_path(new))
        olds.append(new)
    for old in olds[:-keep]:
        fs.delete(fs_path(old), True)
    return olds[-keep:]

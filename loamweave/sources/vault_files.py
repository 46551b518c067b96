"""What the engine writes into a vault: the graph as JSON and as a page, full texts in their blocks, tags, the map of contents."""

from __future__ import annotations

import html
import json
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamweave.functions.text import TAG_ALIASES
from loamweave.sources import files
from loamweave.sources.documents import slug

#: Marks of the blocks scripts write.
BEGIN, END = "<!-- BEGIN AUTO-GENERATED FULLTEXT -->", "<!-- END AUTO-GENERATED FULLTEXT -->"
_OLD_IMAGES = re.compile(r"\n*<!-- BEGIN AUTO-GENERATED IMAGES -->.*?<!-- END AUTO-GENERATED IMAGES -->\n*", re.S)
_OLD_SECTION = re.compile(r"## 文档内嵌图片\n\n!\[\[[^\]]+\]\][^\n]*\n")
PALETTE = ("#4c78a8", "#f58518", "#54a24b", "#e45756", "#72b7b2", "#eeca3b", "#b279a2", "#ff9da6", "#9d755d", "#59a14f")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Tables folder/nodes, folder/edges and folder/signals as JSON lines: weights to four places, each edge's signals and the first of them, and how many edges a signal has."""
    rows = edges.select(F.col("u").alias("source"), F.col("v").alias("target"), F.round("weight", 4).alias("weight"), F.coalesce(F.array_min("signals"), F.lit("unknown")).alias("signal"), F.array_sort(F.array_distinct("signals")).alias("signals"))
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    rows.write.mode("overwrite").json(f"{folder}/edges")
    rows.select(F.explode("signals").alias("signal")).groupBy("signal").count().write.mode("overwrite").json(f"{folder}/signals")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes (node_id, title, page_type, node_no), edges (source_id, target_id, weight, edge_signals, edge_no), members (node, community_id)) of a graph in one JSON document; a malformed one raises."""
    try:
        graph = json.loads(files.read(spark, path))
        nodes = [(str(n["id"]), str(n.get("title", "")), n.get("page_type"), i) for i, n in enumerate(graph["nodes"])]
        edges = [(str(e["source"]), str(e["target"]), float(e["weight"]), sorted({str(s) for s in e.get("signals", [])}), i) for i, e in enumerate(graph["edges"])]
        members = [(str(m), c) for c, group in enumerate(graph["communities"]) for m in group]
    except Exception as e:
        raise RuntimeError(f"no graph at {path}: {type(e).__name__}") from e
    return (
        spark.createDataFrame(nodes, "node_id string, title string, page_type string, node_no long"),
        spark.createDataFrame(edges, "source_id string, target_id string, weight double, edge_signals array<string>, edge_no long"),
        spark.createDataFrame(members, "node string, community_id long"),
    )


def graph_page(nodes: list[tuple[str, str, str, int]], edges: list[tuple[str, str, float]], title: str) -> str:
    """A page that draws a graph (id, label, type, degree), (source, target, weight): a circle, coloured by type, grey without edges, sized by degree. For graphs a reader can look at."""
    kinds = sorted({k or "" for _, _, k, _ in nodes})
    at = {n[0]: (500 + 420 * math.cos(2 * math.pi * i / max(1, len(nodes))), 500 + 420 * math.sin(2 * math.pi * i / max(1, len(nodes)))) for i, n in enumerate(nodes)}
    lines = [f'<line x1="{at[a][0]:.1f}" y1="{at[a][1]:.1f}" x2="{at[b][0]:.1f}" y2="{at[b][1]:.1f}" stroke="#999" stroke-width="{min(6, 0.5 + w):.1f}"/>' for a, b, w in edges if a in at and b in at]
    dots = [
        f'<circle cx="{at[i][0]:.1f}" cy="{at[i][1]:.1f}" r="{(15 + min(3 * degree, 35)) / 3:.1f}" fill="{PALETTE[kinds.index(kind or "") % len(PALETTE)] if degree else "#bbb"}"><title>{html.escape(label)}</title></circle>'
        for i, label, kind, degree in nodes
    ]
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><svg viewBox="0 0 1000 1000">{"".join(lines)}{"".join(dots)}</svg>\n'


def project_title(purpose: str | None, name: str) -> str:
    """The first heading of a purpose page, else the project's name."""
    head = re.search(r"^#\s+(.+)$", purpose or "", re.M)
    return head[1].strip() if head else name


def page_name(source: str) -> str:
    """File name of the page that holds a source's full text."""
    stem = re.sub(r"\.[^./\\]*$", "", re.split(r"[/\\]", source)[-1])
    return slug(stem).replace("_", "-") + ".md"


def with_fulltext(page: str | None, source: str, title: str, text: str, today: str) -> str:
    """A page with a source's full text in its block: put in the place of the block, at the end if there is none, or into a new page if there is no page.

    Old image blocks go, more than two line feeds become two, the date of the head is renewed; the rest stays.
    """
    block = f"{BEGIN}\n## 全文内容\n\n{text.strip()}\n\n{END}"
    if page is None:
        kind = source.rsplit(".", 1)[-1] if "." in source else ""
        return (
            f'---\ntype: source-summary\ntitle: "{title}"\nsources: ["{source}"]\nproducts: []\ntags: []\nrelated: []\nupdated: {today}\n---\n\n# {title}\n\n## 文档信息\n\n'
            f"- **路径**: `{source}`\n- **格式**: {kind}\n\n## 核心内容摘要\n\n<!-- TODO -->\n\n{block}\n"
        )
    own = re.compile(re.escape(BEGIN) + r".*?" + re.escape(END), re.S)
    page = own.sub(lambda _: block, page) if own.search(page) else f"{page.rstrip()}\n\n{block}\n"
    page = re.sub(r"\n{3,}", "\n\n", _OLD_SECTION.sub("", _OLD_IMAGES.sub("\n\n", page)))
    return re.sub(r"(updated:\s*)\d{4}-\d{2}-\d{2}", lambda m: m[1] + today, page)


def clean_tags(page: str) -> tuple[str, int]:
    """A page whose head's tags line has tags as they may be written, and how many were changed."""
    changed = 0

    def one(tag: str) -> str:
        nonlocal changed
        raw = tag.strip().strip("\"'")
        new = TAG_ALIASES.get(n := re.sub(r"\s+", "-", raw).replace("#", ""), n)
        changed += new != raw
        return new

    head = re.match(r"---\n.*?\n---\n", page, re.S)
    if not head:
        return page, 0
    new = re.sub(r"^(tags:\s*)\[(.*)\]\s*$", lambda m: m[1] + "[" + ", ".join(one(t) for t in m[2].split(",") if t.strip()) + "]", head[0], flags=re.M)
    return new + page[head.end() :], changed


def contents_page(lines: list[tuple[str, str, str]], today: str) -> str:
    """The map of contents of (section, slug, title) in order."""
    out, last = ["---", "type: index", 'title: "Wiki 索引"', f"updated: {today}", "---", "", "# 索引"], None
    for section, name, title in lines:
        if section != last:
            out += ["", f"## {section}", ""]
            last = section
        out.append(f"- [[{name}|{title}]]")
    return "\n".join(out) + "\n"

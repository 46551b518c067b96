"""Chunks of Markdown pages: exact sparse units for full text, packed dense ones for vectors.

Every chunk's body is a slice of the page's text between its offsets.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.functions.keys import chunk_id, content_hash, section_id

#: Limits of sparse chunks in characters and of dense ones in tokens.
SPARSE_MOST, SPARSE_BODY_LEAST, PREFIX_MOST = 1000, 200, 800
DENSE_TARGET, DENSE_MOST, DENSE_OVERLAP = 96, 112, 20

_LINE_KINDS = (
    ("heading", re.compile(r"#{1,6}\s+")), ("quote", re.compile(r"\s*>")), ("list", re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")),
)
_RULER = re.compile(r"\s*\|?[\s:|-]+\|[\s:|-]+\|?\s*$")
_SENTENCE = re.compile(r"[^。！？!?；;]*(?:[。！？!?；;]+|$)")
_ATOM = re.compile(r"\[\[.*?\]\]|[一-鿿]|[^\s一-鿿\[]+\s*|\s+|\[", re.S)


@dataclass
class Block:
    kind: str
    start: int
    end: int
    level: int = 0


def default_tokens(text: str) -> int:
    return max(1, len(text) // 4)


def parse_blocks(text: str) -> list[Block]:
    """Headings, fenced code, tables with a ruler line, quotes, lists with indented lines, and paragraphs; blocks are exact slices."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    blocks: list[Block] = []
    i = 0

    def kind_of(n: int) -> str:
        line = lines[n][1]
        if line.startswith(("```", "~~~")):
            return "code"
        if line.lstrip().startswith("|") and n + 1 < len(lines) and _RULER.match(lines[n + 1][1]):
            return "table"
        return next((k for k, p in _LINE_KINDS if p.match(line)), "paragraph" if line.strip() else "")

    while i < len(lines):
        kind, j = kind_of(i), i + 1
        if kind == "code":
            fence = lines[i][1][:3]
            while j < len(lines) and not lines[j][1].strip().startswith(fence):
                j += 1
            j = min(j + 1, len(lines))
        elif kind == "table":
            j = i + 2
            while j < len(lines) and lines[j][1].lstrip().startswith("|"):
                j += 1
        elif kind == "quote":
            while j < len(lines) and kind_of(j) == "quote":
                j += 1
        elif kind == "list":
            while j < len(lines) and (kind_of(j) == "list" or lines[j][1].strip() and lines[j][1][0] in " \t"):
                j += 1
        elif kind == "paragraph":
            while j < len(lines) and kind_of(j) == "paragraph":
                j += 1
        if kind:
            level = len(lines[i][1]) - len(lines[i][1].lstrip("#")) if kind == "heading" else 0
            blocks.append(Block(kind, lines[i][0], lines[j - 1][0] + len(lines[j - 1][1]), level))
        i = j
    return blocks


def _pieces(text: str, start: int, end: int, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text, start, end):
        if m.end() > m.start() and text[m.start() : m.end()].strip():
            yield m.start(), m.end()


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    body = text[a:b]
    return a + len(body) - len(body.lstrip()), a + len(body.rstrip())


def _sentences(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Sentences of a range; one that leaves a [[link]] open goes on into the next."""
    out: list[tuple[int, int]] = []
    for x, y in _pieces(text, a, b, _SENTENCE):
        x, y = _trimmed(text, x, y)
        if out and text.count("[[", *out[-1]) > text.count("]]", *out[-1]):
            out[-1] = (out[-1][0], y)
        elif y > x:
            out.append((x, y))
    return out


def _units(text: str, block: Block) -> list[tuple[int, int]]:
    if block.kind in ("code", "table"):
        return list(_pieces(text, block.start, block.end, re.compile(r"[^\n]+")))
    return _sentences(text, block.start, block.end)


def _cut(text: str, a: int, b: int, room: int, table: bool) -> Iterator[tuple[int, int]]:
    """Cuts of at most ``room`` characters: table rows before a bar, other text outside links."""
    while b - a > room:
        cut = a + room
        if table:
            bar = max((m.start() for m in re.finditer(r"(?<!\\)\|", text[a:cut]) if m.start() > 0), default=0)
            cut = a + bar if bar else cut
        else:
            link = text.rfind("[[", a, cut)
            if link > a and "]]" not in text[link:cut]:
                cut = link
        yield a, cut
        a = cut
    yield a, b


def _prefix(path: list[str]) -> str:
    whole = " > ".join(path) + "\n" if path else ""
    if len(whole) <= PREFIX_MOST:
        return whole
    half = (PREFIX_MOST - 5) // 2
    return whole[:half] + " ... " + whole[-half:]


def _fit_tokens(text: str, a: int, b: int, most: int, tokens: Callable[[str], int], overlap: int = DENSE_OVERLAP) -> Iterator[tuple[int, int]]:
    """Parts of a range within a token limit, at blanks, characters or links; an atom over the limit is cut.

    A part begins with the last whole atoms of the part before, up to ``overlap`` tokens,
    as far as its own first atom still fits.
    """
    start = end = a
    atoms: list[int] = []  # where the atoms of the part start
    for m in _ATOM.finditer(text, a, b):
        if tokens(text[start : m.end()]) > most and end > start:
            yield start, end
            kept = [x for x in atoms if x > start and tokens(text[x:end]) <= overlap and tokens(text[x : m.end()]) <= most]
            start, atoms = min(kept, default=end), kept
        atoms.append(m.start())
        end = m.end()
        while tokens(text[start:end]) > most:
            low, high = 1, end - start
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if tokens(text[start : start + mid]) <= most else (low, mid - 1)
            yield start, start + low
            start += low
    if end > start:
        yield start, end


def chunk_page(page_id: str, title: str, text: str | None, tokens: Callable[[str], int] = default_tokens) -> list[dict]:
    """Sparse and dense chunks of a page in order; an empty or heading-only page has none."""
    rows: list[dict] = []
    if not text or not text.strip():
        return rows
    sections: list[tuple[list[str], str, list[Block]]] = [([title], "", [])]
    stack: list[tuple[int, str]] = []
    for b in parse_blocks(text):
        if b.kind == "heading":
            name = text[b.start : b.end].lstrip("#").strip()
            stack = [s for s in stack if s[0] < b.level] + [(b.level, name)]
            sections.append(([title, *(s[1] for s in stack)], name, []))
        else:
            sections[-1][2].append(b)
    for path, heading, blocks in sections:
        prefix = _prefix(path)
        room = max(SPARSE_BODY_LEAST, SPARSE_MOST - len(prefix))
        pieces: list[tuple[int, int]] = []
        for block in blocks:
            for a, b in _units(text, block):
                cuts = list(_cut(text, a, b, room, block.kind == "table"))
                for n, (x, y) in enumerate(cuts):
                    rows.append(_row("sparse", page_id, path, heading, text, x, y, prefix, tokens, len(cuts) > 1, n if len(cuts) > 1 else -1))
            pieces += _units(text, block)
        head = prefix
        while head and tokens(head) >= DENSE_MOST:
            head = head[: len(head) // 2]
        most = max(1, DENSE_MOST - tokens(head) - 1) if head else DENSE_MOST  # a joint may round up
        target = max(1, min(DENSE_TARGET - (tokens(head) if head else 0), most))
        parts = [p for a, b in pieces for p in (_fit_tokens(text, a, b, most, tokens) if tokens(text[a:b]) > most else [(a, b)])]
        cur: list[tuple[int, int]] = []
        for p in parts:
            if cur and tokens(text[cur[0][0] : p[1]]) > target:
                rows.append(_row("dense", page_id, path, heading, text, cur[0][0], cur[-1][1], head, tokens, False, -1))
                keep: list[tuple[int, int]] = []
                for q in reversed(cur):
                    if tokens(text[q[0] : cur[-1][1]]) > DENSE_OVERLAP or tokens(text[q[0] : p[1]]) > most:
                        break
                    keep.insert(0, q)
                cur = keep
            cur.append(p)
        if cur:
            rows.append(_row("dense", page_id, path, heading, text, cur[0][0], cur[-1][1], head, tokens, False, -1))
    for n, row in enumerate(rows):
        row["chunk_index"] = n
    return rows


def _row(kind, page_id, path, heading, text, a, b, prefix, tokens, forced, part) -> dict:
    return {
        "page_id": page_id, "chunk_kind": kind, "section_path": json.dumps(path, ensure_ascii=False), "heading": heading, "body": text[a:b], "text": prefix + text[a:b],
        "start_char": a, "end_char": b, "token_count": tokens(prefix + text[a:b]), "forced_split": forced, "continuation_index": part,
    }


_SCHEMA = (
    "page_id string, chunk_kind string, section_path string, heading string, body string, text string, start_char long, end_char long, "
    "token_count long, forced_split boolean, continuation_index long, chunk_index long"
)


def chunk_pages(pages: DataFrame, tokens: Callable[[str], int] = default_tokens) -> DataFrame:
    """Chunks of pages (page_id, title, content) with content-hash ids.

    Ids are made JVM-side: the occurrence counter is a window over equal bodies of one
    page, so a page with a third of all chunks is spread by its bodies.
    """
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [r for p, t, c in zip(pdf["page_id"], pdf["title"], pdf["content"]) for r in chunk_page(p, t or "", c, tokens)]
            yield pd.DataFrame(rows, columns=names)

    raw = pages.where("page_id is not null").select("page_id", "title", "content").mapInPandas(run, _SCHEMA)
    body = F.trim(F.regexp_replace("body", r"(?U)\s+", " "))
    same = Window.partitionBy("page_id", "chunk_kind", F.sha2(body, 256)).orderBy("chunk_index")
    path = F.from_json("section_path", "array<string>")
    return raw.withColumn("occurrence", F.row_number().over(same) - 1).select(
        chunk_id(F.col("page_id"), F.col("chunk_kind"), F.col("body"), F.col("occurrence")).alias("chunk_id"),
        *[n for n in names if n != "body"], section_id(F.col("page_id"), path).alias("section_id"), content_hash(F.col("text")).alias("content_hash"),
    )


def incomplete_pages(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages with text that lack sparse or dense chunks."""
    kinds = chunks.groupBy("page_id").agg(F.countDistinct("chunk_kind").alias("kinds"))
    full = pages.where(F.trim("content") != "").select("page_id").distinct()
    return full.join(kinds, "page_id", "left").where("coalesce(kinds, 0) < 2").select("page_id", F.coalesce("kinds", F.lit(0)).alias("kinds"))

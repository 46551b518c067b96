"""Files as DataFrames: Markdown pages with front matter, raw sources, HTML tables, JSON lines, lexicons, synonyms."""

from __future__ import annotations

import os
import posixpath
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamweave.functions.text import first_heading, wikilinks

#: Suffixes of raw sources.
SUFFIXES = ("md", "txt", "pdf", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "html", "htm", "csv")
_FENCE = re.compile(r"\A---\n(.*?)\n---\n(.*)\Z", re.S)


def _scalar(text: str) -> object:
    """A value on one line: quoted, listed, true or false, null, or as it stands; comments are cut."""
    text = text.strip()
    if text[:1] == '"' and (m := re.match(r'"((?:[^"\\]|\\.)*)"', text)):
        return re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1])
    if text[:1] == "'" and (m := re.match(r"'((?:[^']|'')*)'", text)):
        return m[1].replace("''", "'")
    if text[:1] == "[" and "]" in text:
        inner = text[1 : text.rindex("]")]
        parts = re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]*?)\s*(?:,|$)""", inner)
        return [_scalar(p) for p in parts if p]
    text = re.sub(r"(^|\s)#.*$", "", text).strip()
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower(), text)


def yaml_fields(text: str) -> dict[str, object]:
    """Top-level fields of a YAML head: scalars, quoted and over several lines (| and >), lists inline and in lines, and maps of such by one more indentation."""
    lines = text.split("\n")
    out: dict[str, object] = {}
    n = 0
    while n < len(lines):
        pair = re.match(r"""(?:"([^"]+)"|'([^']+)'|([^\s#:'"\-][^:#]*?|[\w-]+))\s*:(?:\s+(.*)|)$""", lines[n])
        n += 1
        if not pair:
            continue
        key, value = pair[1] or pair[2] or pair[3], (pair[4] or "").strip()
        block = []
        while n < len(lines) and (not lines[n].strip() or lines[n][0] in " \t" or re.match(r"-(\s|$)", lines[n])):
            block.append(lines[n])
            n += 1
        while block and not block[-1].strip():
            block.pop()
        if value[:1] in ("|", ">") and len(value) <= 2:
            deep = min((len(x) - len(x.lstrip()) for x in block if x.strip()), default=0)
            kept = [x[deep:] for x in block]
            out[key] = "\n".join(kept) if value[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(kept))
        elif not re.sub(r"(^|\s)#.*$", "", value).strip() and block:
            items = [x.strip() for x in block if x.strip() and not x.strip().startswith("#")]
            if items and re.match(r"-(\s|$)", items[0]):
                out[key] = [_scalar(x[1:]) for x in items if x[:1] == "-"]
            else:
                deep = min(len(x) - len(x.lstrip()) for x in block if x.strip())
                out[key] = yaml_fields("\n".join(x[deep:] for x in block))
        else:
            if value[:1] == "[" and "]" not in value:
                value += " " + " ".join(x.strip() for x in block)
            elif block and value[:1] not in ("[", "'", '"'):
                value += " " + " ".join(x.strip() for x in block)
            out[key] = _scalar(value)
    return out


def front_matter(text: str) -> tuple[dict[str, object], str] | None:
    """(fields, body) of a page that starts with a fenced head; None without one."""
    m = _FENCE.match(text)
    return (yaml_fields(m[1]), m[2]) if m else None


def loose_head(text: str) -> dict[str, object]:
    """Fields of a head whose fences may have blanks after them, empty without one: what the map of contents reads."""
    m = re.match(r"---\s*\n(.*?)\n---\s*\n", text, re.S)
    return yaml_fields(m[1]) if m else {}


def raw_sources_of(text: str) -> list[str]:
    """The sources below raw/ of a page's head, slashes forward."""
    got = front_matter(text)
    listed = got[0].get("sources") if got else None
    names = listed if isinstance(listed, list) else [listed] if isinstance(listed, str) else []
    return [s.replace("\\", "/") for s in map(str, names) if s.lower().startswith("raw/")]


def body_of(text: str, most: int | None = None) -> str:
    """A page's text without its head; with ``most`` cut there, with a mark."""
    m = _FENCE.match(text)
    body = m[2].strip() if m else text
    return body if most is None or len(body) <= most else body[:most] + "\n...[truncated]"


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, path, title, page_type, content, sources, links, aliases, sha256) of *.md files with front matter; others are left out, as are .graph folders."""
    raw = _files(spark, folder, "*.md").where(~F.col("path").contains("/.graph/")).select("path", "content", F.sha2("content", 256).alias("sha256"))

    def run(batches):
        listed = lambda v: [str(x) for x in v if x is not None] if isinstance(v, list) else [str(v)] if v else []
        for pdf in batches:
            rows = []
            for path, content, sha in zip(pdf["path"], pdf["content"], pdf["sha256"]):
                got = front_matter(bytes(content).decode("utf-8", "replace"))
                if got:
                    head, body = got
                    name = posixpath.splitext(posixpath.basename(path))[0]
                    rows.append((path, path, str(head.get("title") or name), str(head.get("type") or "concept"), body, listed(head.get("sources")), listed(head.get("aliases")), sha))
            yield pd.DataFrame(rows, columns=["page_id", "path", "title", "page_type", "content", "sources", "aliases", "sha256"])

    read = raw.mapInPandas(run, "page_id string, path string, title string, page_type string, content string, sources array<string>, aliases array<string>, sha256 string")
    return read.withColumn("links", wikilinks(F.col("content")))


def raw_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc_type, sha256, content) of files with a known suffix in any case, without lock and temporary files."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return _files(spark, folder, "*").where(suffix.isin(*SUFFIXES) & ~name.startswith("~$") & ~name.startswith(".~")).select("path", suffix.alias("doc_type"), F.sha2("content", 256).alias("sha256"), "content")


def parsed_text(sources: DataFrame) -> DataFrame:
    """(path, title, text, doc_type, sha256) of Markdown and plain text sources: the title is the first heading, else the file's stem."""
    text = F.decode("content", "UTF-8")
    stem = F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1)
    return sources.where(F.col("doc_type").isin("md", "txt")).select("path", first_heading(text, stem).alias("title"), text.alias("text"), "doc_type", "sha256")


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self._close()
            self.cell = []

    def _close(self) -> None:
        if self.cell is not None and self.tables and self.tables[-1]:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(text: str | None) -> list[list[list[str]]]:
    """Tables, rows and cells of HTML in a text; rows without cells and tables without rows are dropped."""
    if not text or "<t" not in text.lower():
        return []
    p = _Tables()
    p.feed(text)
    p.close()
    return [t for t in ([r for r in t if r] for t in p.tables) if t]


def tables_of(texts: DataFrame) -> DataFrame:
    """(key, table_no, row_no, cells) of HTML tables in (key, text)."""

    def run(batches):
        for pdf in batches:
            rows = [(k, n, i, r) for k, t in zip(pdf["key"], pdf["text"]) for n, tab in enumerate(html_tables(t), 1) for i, r in enumerate(tab, 1)]
            yield pd.DataFrame(rows, columns=["key", "table_no", "row_no", "cells"])

    return texts.where("text is not null").mapInPandas(run, "key string, table_no int, row_no int, cells array<string>")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON lines file; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term) lines of a lexicon, without comments and blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term != '' and not term like '#%'").distinct()


def synonyms(text: str) -> dict[str, tuple[str, ...]]:
    """Words and their alternatives of lines ``word: [a, b]`` or ``word: a, b``; comments and other lines are skipped."""
    out = {}
    for line in text.splitlines():
        key, colon, value = line.strip().partition(":")
        others = tuple(x.strip().strip("\"'") for x in value.strip().strip("[]").split(",") if x.strip())
        if colon and key.strip() and not key.startswith("#") and others:
            out[key.strip()] = others
    return out


def environment(text: str, have: dict[str, str]) -> dict[str, str]:
    """``have`` with the NAME=value lines of a settings file it lacks; quotes and an export in front are taken off."""
    out = dict(have)
    for line in text.splitlines():
        if m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line):
            out.setdefault(m[1], m[2].strip("\"'"))
    return out


def plain_page_chunks(pages: DataFrame) -> DataFrame:
    """(chunk_id, page_id, title, text) of whole pages (path, content): one chunk a page, without a head, named by path and body; blank bodies give none."""
    body = F.trim(F.regexp_replace("content", r"(?s)^---\n.*?\n---\n", ""))
    head = F.trim(F.regexp_extract("content", r"(?m)^title:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1))
    name = F.regexp_extract("path", r"([^/\\\\]+?)(?:\.md)?$", 1)
    seed = F.concat("path", F.decode(F.unhex(F.lit("00")), "UTF-8"), body)
    rows = pages.where("path is not null and content is not null")
    return rows.select(F.concat(F.lit("sparse:"), F.sha2(seed, 256)).alias("chunk_id"), F.col("path").alias("page_id"), F.when(head != "", head).otherwise(name).alias("title"), body.alias("text")).where("text != ''")


def graph_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, path, title, page_type, sources, links) of the pages a graph is built of: a source given as one text is a list of one, links are cut at |."""
    rows = pages(spark, folder)
    return rows.select("page_id", "path", "title", "page_type", "sources", F.transform("links", lambda x: F.trim(F.substring_index(x, "|", 1))).alias("links"))


def safe_asset(root: str, key: str | None) -> str | None:
    """Real path of an asset below root/assets; None if it is missing, no file, or a link leads it elsewhere."""
    if not key:
        return None
    home = os.path.realpath(os.path.join(root, "assets"))
    real = os.path.realpath(os.path.join(root, key))
    return real if os.path.commonpath([home, real]) == home and os.path.isfile(real) else None

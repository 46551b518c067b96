"""Source documents: which parser a file needs, Word files with images and captions, Markdown of external parsers, image files."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamweave.sources.vault import html_tables

#: Suffixes read as text and those that need a place for images; pages of one part of a PDF.
TEXT_SUFFIXES, BINARY_SUFFIXES = ("md", "markdown", "txt"), ("pdf", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "html", "htm")
PART_PAGES = 200
#: A caption line and the mark of an image without one.
CAPTION = re.compile(r"\s*(?:图|Figure|Fig\.?)\s*\d+", re.I)
NO_CAPTION, OPEN_CAPTION = "[无图注]", "待补"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"


@dataclass
class Image:
    filename: str
    rel_path: str
    caption: str
    source_media_name: str
    sha256: str
    page_or_section: str
    data: bytes = b""


@dataclass
class Parsed:
    text: str = ""
    images: list[Image] = field(default_factory=list)
    tables: list[list[list[str]]] = field(default_factory=list)


class DocumentParser(Protocol):
    """What reads a kind of file; remote services and PDF readers plug in here."""

    def __call__(self, name: str, data: bytes) -> Parsed: ...


class UnsupportedFormat(ValueError):
    pass


def slug(text: str) -> str:
    return re.sub(r"-+", "-", re.sub(r"[^\w一-鿿]", "-", text)).strip("-").lower()


def image_name(stem: str, number: int, suffix: str) -> str:
    return f"{stem}_img{number:02d}.{suffix.lstrip('.')}"


def suffix_of(path: str) -> str:
    return posixpath.splitext(path.replace("\\", "/"))[1].lstrip(".").lower()


def route(path: str, assets: bool = True, sensitive: bool | None = None, parsers: dict[str, DocumentParser] | None = None) -> str:
    """Name of the parser of a file: text, docx, or the port local or remote.

    A binary file without a place for its images and a suffix of no kind raise. PDF and
    PPTX files marked sensitive stay local.
    """
    kind = suffix_of(path)
    if kind in TEXT_SUFFIXES:
        return "text"
    if kind not in BINARY_SUFFIXES:
        raise UnsupportedFormat(f"no parser for .{kind} ({path})")
    if not assets:
        raise ValueError(f".{kind} needs a place for images")
    if kind == "docx":
        return "docx"
    return "local" if sensitive and kind in ("pdf", "pptx") else "remote"


def page_parts(pages: int, most: int = PART_PAGES) -> list[tuple[str, int, int]]:
    """(file name, first page, end) of the parts a PDF of so many pages is read in; one part without a name if it is within the limit."""
    if pages <= most:
        return [("", 0, max(pages, 0))]
    return [(f"chunk_{n:03d}.pdf", a, min(a + most, pages)) for n, a in enumerate(range(0, pages, most), 1)]


def joined_parts(texts: list[str]) -> str:
    """Texts of the parts of one document."""
    return "\n\n---\n\n".join(texts)


def attach_captions(text: str, images: list[Image], reach: int = 5) -> str:
    """Each open image placeholder gets the first caption line within ``reach`` lines after it, else the caption its image has; images are filled in their order."""
    lines, left = text.split("\n"), iter(images)
    for n, line in enumerate(lines):
        if "{{IMG|" in line and f"图注: {OPEN_CAPTION}" in line:
            image = next(left, None)
            if image is None:
                break
            near = next((x.strip() for x in lines[n + 1 : n + 1 + reach] if CAPTION.match(x)), "")
            image.caption = near or image.caption
            lines[n] = line.replace(f"图注: {OPEN_CAPTION}", f"图注: {near or NO_CAPTION}")
    return "\n".join(lines)


def embeds(text: str) -> str:
    """Placeholders as embeds of their file name, with the caption on the next line."""

    def one(m: re.Match) -> str:
        shown = f"![[{posixpath.basename(m[1])}]]"
        return f"{shown}  \n{m[2]}" if m[2] and m[2] != NO_CAPTION else shown

    return re.sub(r"\{\{IMG\|([^|]+)\|图注: (.*?)\}\}", one, text, flags=re.S)


def docx(name: str, data: bytes) -> Parsed:
    """A Word file in reading order: headings as # lines, tables as Markdown, images as embeds with their captions. Unreadable files give an empty result."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
            files = set(z.namelist())
            links = {}
            if "word/_rels/document.xml.rels" in files:
                links = {r.get("Id"): "word/" + r.get("Target", "") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if r.get("Target", "").startswith("media/")}
            media = {f: z.read(f) for f in files if f in links.values()}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return Parsed()
    out = Parsed()
    stem = slug(posixpath.splitext(posixpath.basename(name.replace("\\", "/")))[0])
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    parts: list[str] = []
    pictures = 0
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            blips = [b for b in e.iter() if b.tag.endswith("}pic")]
            if blips:
                pictures += 1
                blip = next((b for b in blips[-1].iter() if b.tag.endswith("}blip")), None)
                source = links.get(blip.get(_EMBED)) if blip is not None else None
                if source in media:
                    file = image_name(stem, pictures, suffix_of(source))
                    out.images.append(Image(file, f"assets/{file}", "", posixpath.basename(source), hashlib.sha256(media[source]).hexdigest(), "body", media[source]))
                    parts.append(f"{{{{IMG|assets/{file}|图注: {OPEN_CAPTION}}}}}")
            style = e.find(f"{_W}pPr/{_W}pStyle")
            named = re.match(r"(?i)(?:heading\s*)?(\d+)", style.get(f"{_W}val", "")) if style is not None else None
            if said(e).strip():
                parts.append("#" * int(named[1]) + " " + said(e) if named and int(named[1]) else said(e))
        elif e.tag == f"{_W}tbl":
            rows = [[said(c).strip() for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            wide = max((len(r) for r in rows), default=0)
            full = [r + [""] * (wide - len(r)) for r in rows if any(r)]
            if full:
                out.tables.append(rows)
                line = lambda r: "| " + " | ".join(r) + " |"
                parts += ["", "\n".join([line(full[0]), line(["---"] * wide), *map(line, full[1:])]), ""]
    text = embeds(attach_captions("\n".join(parts), out.images, reach=4))
    out.text = re.sub(r"(!\[\[[^\]]+\]\]  \n)([^\n]+)\n\2\n", r"\1\2\n", text + "\n")[:-1] if text else ""
    return out


def parser_markdown(markdown: str, stem: str, media: dict[str, bytes]) -> Parsed:
    """Markdown of an external parser: its images become numbered embeds with captions, those inside HTML keep their names, tables are read as well as kept."""
    out = Parsed()
    sha = lambda f: hashlib.sha256(media[f]).hexdigest() if media.get(f) else "unknown"

    def plain(m: re.Match) -> str:
        file = image_name(stem, len(out.images) + 1, suffix_of(m[2]) or "jpg")
        out.images.append(Image(file, f"assets/{file}", m[1].strip(), m[2], sha(m[2]), "", media.get(m[2], b"")))
        return f"{{{{IMG|assets/{file}|图注: {OPEN_CAPTION}}}}}"

    def tagged(m: re.Match) -> str:
        alt = re.search(r'alt="([^"]*)"', m[0])
        alt = alt[1].strip() if alt else ""
        out.images.append(Image(m[1], f"assets/{m[1]}", alt, m[1], sha(m[1]), "", media.get(m[1], b"")))
        return f"![[{m[1]}]]" + (f"  \n{alt}" if alt else "")

    text = re.sub(r"!\[([^\]]*)\]\(images/([^)]+\.\w+)\)", plain, markdown)
    text = re.sub(r'<img[^>]+src="images/([^"]+\.\w+)"[^>]*>', tagged, text)
    out.tables = html_tables(text)
    numbered = [i for i in out.images if re.search(r"_img\d{2,}\.\w+$", i.filename)]
    out.text = embeds(attach_captions(text, numbered))
    return out


def strip_tables(text: str) -> str:
    """HTML tables replaced by [table N] on lines of their own, an inner table going with its outer one."""
    out, depth, n, at = [], 0, 0, 0
    for m in re.finditer(r"<(/?)table\b[^>]*>", text, re.I):
        if not m[1]:
            if not depth:
                out.append(text[at : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                n += 1
                out.append(f"\n[table {n}]\n")
                at = m.end()
    return "".join([*out, text[at:]]) if not depth else "".join(out) + f"\n[table {n + 1}]\n"


def first_names(images: list[Image]) -> list[Image]:
    """Images whose bytes came before take the name they came with first."""
    seen: dict[str, str] = {}
    for i in images:
        i.filename = seen.setdefault(i.sha256, i.filename)
        i.rel_path = f"assets/{i.filename}"
    return images


def parse(sources: DataFrame, parsers: dict[str, Callable[[str, bytes], Parsed]] | None = None, assets: str | None = None, sensitive: bool | None = None) -> DataFrame:
    """(path, title, text, doc_tables, sha256, doc_type, images, fault) of raw sources (path, doc_type, sha256, content).

    parsers: ports by the name that ``route`` gives; text and docx are built in. A file
    without a parser, or whose parser fails, has an empty text and a fault. Image files are
    written below ``assets`` (a path all executors share), each content once a document.
    """
    ports = {"text": lambda name, data: Parsed(data.decode("utf-8", "replace")), "docx": docx} | (parsers or {})

    def one(path: str, data: bytes) -> tuple:
        try:
            name = route(path, True, sensitive)
            if name not in ports:
                raise UnsupportedFormat(f"no {name} parser is set")
            got, fault = ports[name](path, data), None
        except Exception as e:  # noqa: BLE001  a document that fails must not stop the others
            got, fault = Parsed(), f"{type(e).__name__}: {e}"
        kept = first_names(got.images)
        if assets:
            for i in {i.filename: i for i in reversed(kept)}.values():
                with open(posixpath.join(assets, i.filename), "wb") as f:
                    f.write(i.data)
        head = re.search(r"^#\s+(.+)$", got.text, re.M)
        title = head[1].strip() if head else posixpath.splitext(posixpath.basename(path))[0]
        rows = [{k: getattr(i, k) for k in ("filename", "rel_path", "caption", "source_media_name", "sha256", "page_or_section")} for i in kept]
        return title, got.text, got.tables, rows, fault

    def run(batches):
        for pdf in batches:
            got = [one(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({
                "path": pdf["path"], "title": [g[0] for g in got], "text": [g[1] for g in got], "doc_tables": [g[2] for g in got], "sha256": pdf["sha256"], "doc_type": pdf["doc_type"],
                "images": [g[3] for g in got], "fault": [g[4] for g in got],
            })

    image = "struct<filename: string, rel_path: string, caption: string, source_media_name: string, sha256: string, page_or_section: string>"
    return sources.mapInPandas(run, f"path string, title string, text string, doc_tables array<array<array<string>>>, sha256 string, doc_type string, images array<{image}>, fault string")


def asset_files(spark: SparkSession, folder: str) -> DataFrame:
    """(rel_path, sha256) of the files below folder/assets; what a link leads out of the folder to is not among them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/assets")
    return raw.select(F.regexp_extract("path", r"(assets/.*)$", 1).alias("rel_path"), F.sha2("content", 256).alias("sha256")).where("rel_path not like '%..%'")

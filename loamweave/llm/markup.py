"""Clean text from HTML, Markdown, wiki and LaTeX markup, keeping headings, lists, code and formulas.

One pass sets aside what must not be read as markup: code, comments, formulas, escapes.
The rest goes through the events of the standard library's streaming HTML parser, which
write plain lines and note the ratio of text to tags of each. The ratios are smoothed
with a Gaussian and clustered by a threshold; of the low cluster, lines that mostly
consist of links and controls are navigation and no content region. Headings, lists,
code, formulas and inline markup of all notations are then read in content regions,
line by line.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamweave.operators.stage import newest
from loamweave.sources.tables import table

KINDS = ("heading", "list", "code", "formula")
OPEN, CLOSE, LITERAL = "\ue000", "\ue001", "\ue002"

_VERBATIM = "verbatim|Verbatim|lstlisting|minted|alltt"
_EQUATIONS = "equation|align|gather|multline|eqnarray|displaymath|math|flalign"
_HELD = re.compile(
    r"(?P<comment><!--)"
    r"|(?P<fence>^[ ]{0,3}(?P<ticks>`{3,}|~{3,})(?P<info>[^\n`]*)$)"
    r"|<(?P<block>pre|syntaxhighlight|source|nowiki|math|code|script|style)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>"
    rf"|\\begin\{{(?P<env>(?:{_VERBATIM}|{_EQUATIONS})\*?)\}}"
    r"|(?P<display>\\\[)|(?P<inline>\\\()|(?P<dollars>\$\$?)|(?P<tick>`+)"
    r"|(?P<escape>\\[^A-Za-z\s])"
    r"|(?P<indent>(?:^[ ]{4,}[^\n]*\S[^\n]*(?:\n|\Z)|^\t[^\n]*\S[^\n]*(?:\n|\Z))+)",
    re.M | re.I,
)
_MATH = re.compile(r"[\\^_={}]")


@dataclass
class Held:
    kind: str  # code, formula, text or nothing
    text: str
    start: int
    end: int


def hold(text: str) -> tuple[str, list[Held]]:
    """The text with held parts replaced by numbered marks, and the parts.

    Whatever opens first holds everything up to its end, however long it is. Unclosed
    code and comments reach to the end of the text; other unclosed openers are plain
    characters.
    """
    if OPEN in text or CLOSE in text or LITERAL in text:
        text = text.translate({0xE000: " ", 0xE001: " ", 0xE002: " "})
    if not any(c in text for c in "<`~\\$\t") and "\n    " not in text and not text.startswith("    "):
        return text, []
    out, held, at = [], [], 0

    def keep(kind: str, body: str, start: int, end: int) -> int:
        out.append(text[at:start])
        out.append(f"{OPEN}{len(held)}{CLOSE}")
        held.append(Held(kind, body, start, end))
        return end

    pos = 0
    while m := _HELD.search(text, pos):
        group, start, end = m.lastgroup, m.start(), m.end()
        group = "fence" if m["fence"] is not None else group
        pos = end
        if group == "comment":
            stop = text.find("-->", end)
            pos = at = keep("", "", start, len(text) if stop < 0 else stop + 3)
        elif group == "fence":
            ticks = m["ticks"]
            stop = re.compile(rf"^[ ]{{0,3}}{re.escape(ticks[0])}{{{len(ticks)},}}[ \t\r]*$", re.M).search(text, end)
            body = text[end : stop.start() if stop else len(text)].strip("\n")
            pos = at = keep("code" if body.strip() else "", body, start, stop.end() if stop else len(text))
        elif group == "block":
            tag = m["block"].lower()
            stop = re.compile(rf"</{tag}\s*>", re.I).search(text, end)
            body = text[end : stop.start() if stop else len(text)]
            if tag == "code" and not stop:
                continue
            if tag in ("pre", "code"):
                body = html.unescape(re.sub(r"</?code\b[^<>]*>", "", body, flags=re.I))
            kind = {"pre": "code", "syntaxhighlight": "code", "source": "code", "math": "formula", "nowiki": "text", "code": "text"}.get(tag, "")
            if tag in ("source",) and not stop or not body.strip() or text[start:end].endswith("/>"):
                continue
            pos = at = keep(kind, body.strip("\n"), start, stop.end() if stop else len(text))
        elif group == "env":
            stop = text.find(f"\\end{{{m['env']}}}", end)
            code = re.fullmatch(rf"(?:{_VERBATIM})\*?", m["env"]) is not None
            if stop < 0 and not code:
                continue
            body = text[end : stop if stop >= 0 else len(text)].strip("\n")
            pos = at = keep(("code" if code else "formula") if body.strip() else "", body, start, stop + len(m["env"]) + 6 if stop >= 0 else len(text))
        elif group in ("display", "inline"):
            stop = text.find("\\]" if group == "display" else "\\)", end)
            body = text[end:stop].strip()
            if stop >= 0 and body and ("\n\n" not in body or group == "display"):
                pos = at = keep("formula", body, start, stop + 2)
        elif group == "dollars":
            mark = m["dollars"]
            stop = text.find(mark, end)
            body = text[end:stop] if stop >= 0 else ""
            good = stop >= 0 and body.strip() and ("\n\n" not in body or mark == "$$" and _MATH.search(body))
            if good and mark == "$":
                good = not body[0].isspace() and not body[-1].isspace() and "\n" not in body and not text[stop + 1 : stop + 2].isdigit()
                good = good and (_MATH.search(body) is not None or re.fullmatch(r"[A-Za-z](?:['′]|\([a-z]\))?", body) is not None)
            if good:
                pos = at = keep("formula", body.strip(), start, stop + len(mark))
        elif group == "tick":
            mark = m["tick"]
            stop = re.compile(rf"(?<!`){mark}(?!`)").search(text, end)
            if stop and "\n\n" not in text[end : stop.start()]:
                pos = at = keep("text", text[end : stop.start()].strip(), start, stop.end())
        elif group == "escape":
            out.append(text[at:start])
            out.append(LITERAL + text[start + 1])
            at = end
        else:
            before = text[:start].rstrip(" \t")
            if not before or before.endswith("\n\n") or before.endswith("\n\r\n"):
                pos = at = keep("code", re.sub(r"^(?: {4}|\t)", "", m["indent"].rstrip("\n"), flags=re.M), start, end)
                out.append("\n")
    out.append(text[at:])
    return "".join(out), held


_BREAKS = frozenset("p div br tr table ul ol dl section article header footer blockquote hr h1 h2 h3 h4 h5 h6 li dt dd nav form aside".split())
_NOISE = frozenset("a nav form button select option input iframe script style".split())
_VOID = frozenset(("input",))


class _Lines(HTMLParser):
    """Writes lines [text, tag characters, noise tags, characters inside noise tags] from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.lines: list[list] = [["", 0, 0, 0]]
        self.heading = self.inside = 0

    def _new(self) -> None:
        self.lines.append(["", 0, 0, 0])

    def _fresh(self) -> None:
        if self.lines[-1][0].strip():
            self._new()

    def handle_starttag(self, tag, attrs):
        if tag in _BREAKS:
            self._fresh()
        line = self.lines[-1]
        line[1] += len(self.get_starttag_text() or tag)
        if tag in _NOISE:
            line[2] += 1
            self.inside += tag not in _VOID
        if re.fullmatch("h[1-6]", tag):
            self.heading = int(tag[1])
        elif tag == "li":
            line[0] += OPEN + "li" + CLOSE
        elif tag in ("td", "th") and line[0].strip():
            line[0] += " | "

    def handle_startendtag(self, tag, attrs):
        open_before = self.inside
        self.handle_starttag(tag, attrs)
        self.inside = open_before
        self.heading = 0 if tag[0] == "h" else self.heading

    def handle_endtag(self, tag):
        self.lines[-1][1] += len(tag) + 3
        if tag in _NOISE and tag not in _VOID:
            self.inside = max(0, self.inside - 1)
        if re.fullmatch("h[1-6]", tag):
            self.heading = 0
        if tag in _BREAKS:
            self._fresh()

    def handle_data(self, data):
        for i, part in enumerate(data.split("\n")):
            if i and not (self.heading and not self.lines[-1][0].strip()):
                self._new()
            if self.heading and part.strip() and not self.lines[-1][0].startswith(OPEN + "h"):
                self.lines[-1][0] = f"{OPEN}h{self.heading}{CLOSE}"
            self.lines[-1][0] += part
            if self.inside:
                self.lines[-1][2] += not self.lines[-1][2]
                self.lines[-1][3] += len(part.strip())

    def _literal(self, char: str) -> None:
        self.handle_data("".join(LITERAL + c if not c.isalnum() and not c.isspace() else c for c in char))

    def handle_entityref(self, name):
        self._literal(html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self._literal(html.unescape(f"&#{name};"))

    def unknown_decl(self, data):
        self.handle_data("")


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over lines, with weights renewed at both ends."""
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    return np.convolve(ratios, kernel, "full")[3:-3] / np.convolve(np.ones(len(ratios)), kernel, "full")[3:-3]


def content_lines(lines: list[list]) -> list[bool]:
    """Which lines belong to content regions.

    The smoothed text-to-tag ratios are parted by a threshold half way between the means
    of the two clusters that it makes itself, starting from the overall mean. The high
    cluster is content; of the low one, lines are not if at least half of their text lies
    in links and controls.
    """
    ratio = np.log1p(np.array([len(t.strip()) / max(1, tag) for t, tag, _, _ in lines]))
    level = smooth(ratio)
    cut = level.mean()
    for _ in range(10):
        low, high = level[level <= cut], level[level > cut]
        if not len(low) or not len(high):
            break
        cut = (low.mean() + high.mean()) / 2
    return [bool(x > cut) or not noise or 2 * inside < len(_MARK.sub("", re.sub(f"{OPEN}\\w+{CLOSE}", "", t)).strip()) for (t, _, noise, inside), x in zip(lines, level)]


_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?\s*$")
_WIKI = re.compile(r"^(={1,6})\s*([^=\s].*?)\s*(={1,6})\s*$")
_TEX = re.compile(r"^\s*\\(chapter|part|section|subsection|subsubsection|paragraph)\*?\{((?:[^{}]|\{[^{}]*\})+)\}")
_SETEXT = re.compile(r"^ {0,3}(=+|-{2,})\s*$")
_ITEM = re.compile(r"^\s*(?:[-+•◦▪‣∙·●○]|\*+|\d{1,3}[.)]|\\item\b(?:\[[^\]]*\])?)[ \t]+(?:\[[ xX]\][ \t]+)?(\S.*)$")
_WIKI_NUMBER = re.compile(r"^#+[ \t]*(\S.*)$")
_RULE = re.compile(r"^\s*(?:[-*_=][ \t]*){3,}\s*$|^\|[-+}]|^\{\||^\s*\\(?:begin|end|hline|usepackage|documentclass)\b")
_DEPTH = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_INLINE = (
    (re.compile(r"!?\[\[(?:[^\[\]|]*\|)*([^\[\]|]+)\]\]"), r"\1"),
    (re.compile(r"!?\[([^\[\]]+)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)"), r"\1"),
    (re.compile(r"\\(?:emph|textbf|textit|texttt|underline|footnote|mbox)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"~?\\(?:cite|ref|label|eqref)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"'''?(.+?)'''?"), r"\1"),
    (re.compile(r"(?<![\w*])(\*{1,3})(?=\S)([^*\n]+?)(?<=\S)\1(?![\w*])"), r"\2"),
    (re.compile(r"(?<!\w)(_{1,3})(?=\S)([^_\n]+?)(?<=\S)\1(?!\w)"), r"\2"),
    (re.compile(r"\{\{[^{}|]*\|?([^{}]*)\}\}"), r"\1"),
)
_MARK = re.compile(f"{OPEN}(\\d+){CLOSE}")


_SPECIAL = re.compile(r"[\[\]{}*_'\\]")


def _inline(line: str) -> str:
    if not _SPECIAL.search(line):
        return line
    for pattern, to in _INLINE:
        line = pattern.sub(to, line)
    return line


def convert(text: str | None) -> tuple[str, list[str], list[tuple[str, str]]]:
    """(clean text, kinds present in the order of ``KINDS``, blocks (kind, text)).

    Blocks are heading, list, code, formula, table and text, in order, of content regions
    only. Null and empty texts give ("", [], []).
    """
    if not text or not text.strip():
        return "", [], []
    body, held = hold(text)
    parser = _Lines()
    parser.feed(body)
    parser.close()
    raw = [x[0].rstrip("\r") for x, kept in zip(parser.lines, content_lines(parser.lines)) if kept]
    blocks: list[tuple[str, str]] = []
    kinds: set[str] = set()
    skip = False
    for i, line in enumerate(raw):
        if skip:
            skip = False
            continue
        marks = [held[int(n)] for n in _MARK.findall(line)]
        kinds.update(h.kind for h in marks if h.kind in ("code", "formula"))
        bare = _MARK.sub("", line).strip()
        if marks and not bare and marks[-1].kind in ("code", "formula"):
            blocks += [(h.kind, h.text) for h in marks if h.kind in ("code", "formula")]
            continue
        shown = _MARK.sub(lambda m: (f"${h.text}$" if (h := held[int(m[1])]).kind == "formula" else h.text), line)
        tag = re.match(f"{OPEN}(h[1-6]|li){CLOSE}\\s*(.*)$", line, re.S)
        kind, value = "text", shown
        after = raw[i + 1] if i + 1 < len(raw) else ""
        if tag and tag[1] != "li":
            kind, value = "heading", "#" * int(tag[1][1]) + " " + tag[2]
        elif tag:
            kind, value = "list", "- " + tag[2]
        elif m := _ATX.match(line):
            numbered = i and _WIKI_NUMBER.match(raw[i - 1]) or _WIKI_NUMBER.match(after)
            kind, value = ("list", "- " + m[2]) if numbered and len(m[1]) <= 2 else ("heading", m[1] + " " + m[2])
        elif (m := _WIKI.match(line)) and m[1] == m[3]:
            kind, value = "heading", m[1].replace("=", "#") + " " + m[2]
        elif m := _TEX.match(line):
            kind, value = "heading", "#" * _DEPTH[m[1]] + " " + m[2]
        elif _RULE.match(line):
            kind = "rule"
        elif m := _ITEM.match(line):
            kind, value = "list", "- " + m[1]
        elif bare and (m := _SETEXT.match(after)) and not line.startswith("|"):
            kind, value, skip = "heading", ("# " if m[1][0] == "=" else "## ") + bare, True
        elif line.startswith("|") or re.match(r"^\s*\S.*&.*\\\\\s*$", line):
            kind = "table"
        if kind in ("heading", "list"):
            value = _MARK.sub(lambda m: held[int(m[1])].text, value)
            if not re.sub(r"^[#\-\s]+", "", value.replace(LITERAL, "")):
                continue
            kinds.add(kind)
        if kind == "rule":
            continue
        blocks.append((kind, re.sub(f"{OPEN}\\w+{CLOSE}", "", _inline(value)).replace(LITERAL, "")))
    out = []
    for kind, value in blocks:
        out.append(f"```\n{value}\n```" if kind == "code" else f"$${value}$$" if kind == "formula" else value.rstrip())
    clean = re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")
    return clean, [k for k in KINDS if k in kinds], [b for b in blocks if b[1].strip()]


def clean(texts: DataFrame) -> DataFrame:
    """(src_table, rec_key, clean_text, kinds) of (src_table, rec_key, text), a row a row.

    Copies are converted as often as they occur: telling them apart first would shuffle
    every text, which costs more than converting the few that repeat.
    """

    def run(batches):
        for pdf in batches:
            done = [convert(t)[:2] for t in pdf["text"]]
            yield pd.DataFrame({"src_table": pdf["src_table"], "rec_key": pdf["rec_key"], "clean_text": [d[0] for d in done], "kinds": [d[1] for d in done]})

    return texts.mapInPandas(run, "src_table string, rec_key string, clean_text string, kinds array<string>")


def _marked_up(spark: SparkSession, folder: str) -> DataFrame:
    pages = newest(table(spark, folder, "wiki_pages"), ["page_id"], "updated_at", ["page_id", "updated_at", "content"])
    chunks = table(spark, folder, "sparse_chunks", "chunk_id", "text").where("chunk_id is not null")
    return pages.select(F.lit("wiki_pages").alias("src_table"), F.col("page_id").alias("rec_key"), F.col("content").alias("text")).unionByName(
        chunks.select(F.lit("sparse_chunks").alias("src_table"), F.col("chunk_id").alias("rec_key"), "text")
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(src_table, rec_key, elem_kind) of every kind of element a text marks up."""
    return clean(_marked_up(spark, folder)).select("src_table", "rec_key", F.explode("kinds").alias("elem_kind")).distinct()


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean(_marked_up(spark, folder)).distinct()

"""Splitting oversized texts at natural boundaries.

Recursive separator hierarchy: section, paragraph, line, sentence, table cell; only what
has no such boundary is cut at blanks, then between characters, and marked as forced.
Pieces are packed greedily up to the limit and start with the trailing overlap of the
piece before. Sizes are tokens of the default counter, max(1, characters // 4).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamweave.sources.tables import table

LIMIT, OVERLAP = 250, 20
#: Ends of stretches, from the coarsest level to the finest; each level refines the one before.
LEVELS = tuple(map(re.compile, (
    r"\n(?=[ \t]*(?:#{1,6}\s|=+[^=\n]|<h[1-6]\b|\\(?:sub)*section\b))",
    r"\n[ \t\r]*\n\s*",
    r"\n",
    r"[。！？!?；]|[.;](?=\s)",
    r"\|",
)))
_NATURAL, _BLANK = re.compile("|".join(p.pattern for p in LEVELS[2:])), re.compile(r"\s")


def tokens(length: int) -> int:
    return max(1, length // 4)


def _stretches(text: str, start: int, end: int, limit: int, level: int = 0) -> Iterator[tuple[int, int, bool]]:
    """(start, end, natural) of ranges that cover text[start:end]; those not natural are over the limit."""
    if tokens(end - start) <= limit:
        yield start, end, True
    elif level == len(LEVELS):
        inner = text[start:end]
        left, right = len(inner) - len(inner.lstrip()), len(inner.rstrip())
        if tokens(max(0, right - left)) <= limit:
            if left:
                yield start, start + left, True
            yield start + left, start + max(left, right), True
            if right < end - start and right > left:
                yield start + right, end, True
        else:
            yield start, end, False
    else:
        at = start
        for m in LEVELS[level].finditer(text, start, end):
            if at < m.end() < end:
                yield from _stretches(text, at, m.end(), limit, level + 1)
                at = m.end()
        yield from _stretches(text, at, end, limit, level + 1)


def _forced(text: str, start: int, end: int, width: int) -> Iterator[tuple[int, int]]:
    """Cuts of at most ``width`` characters after a blank where the second half has one, else between characters."""
    while end - start > width:
        cut = max((m.end() for m in _BLANK.finditer(text, start + width // 2, start + width)), default=start + width)
        yield start, cut
        start = cut
    yield start, end


def _overlap_start(text: str, back: int, end: int) -> int:
    for kind in (_NATURAL, _BLANK):
        if m := kind.search(text, back, back + (end - back) // 2):
            return m.end()
    return back


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """Pieces (start, fresh, end, forced): text[start:end] is the piece, what is before ``fresh`` repeats the piece before.

    The ranges fresh:end follow one another and cover the text. A text within the limit
    is one piece; an empty text is one empty piece. The overlap is up to ``overlap``
    tokens; it starts at a natural boundary if its first half has one, else after a blank,
    else at a character, so unspaced text has it too. Only before a stretch without inner
    boundary that fits the limit but not beside the whole overlap is it cut to the
    characters left.
    """
    if tokens(len(text)) <= limit:
        return [(0, 0, len(text), False)]
    width = 4 * limit + 3
    room = min(4 * overlap, width // 2)
    fit = max(1, (width - room - 3) // 4)
    atoms: list[tuple[int, int, bool]] = []
    for a, b, natural in _stretches(text, 0, len(text), fit):
        for x, y, whole in [(a, b, True)] if natural else _stretches(text, a, b, limit, len(LEVELS)):
            if whole and (y - x <= width - room or text[x:y].strip() and y - x <= width):
                atoms.append((x, y, False))
            else:
                atoms += [(p, q, not whole) for p, q in _forced(text, x, y, width - room)]
    pieces: list[tuple[int, int, int, bool]] = []
    start = fresh = end = 0
    forced = False
    for a, b, cut in atoms:
        if end > fresh and b - start > width:
            pieces.append((start, fresh, end, forced))
            start = fresh = end
            back = max(pieces[-1][0], end - room)
            start, forced = max(_overlap_start(text, back, end), b - width), False
        end, forced = b, forced or cut
    pieces.append((start, fresh, end, forced))
    return pieces


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the chunks whose text is over the limit; stale token counts are not looked at.

    Adds piece_no, start, end, n_tokens, overlap_chars, forced_split and must_force (a
    stretch of the chunk between natural boundaries is itself over the limit). Null and
    short texts give no row; exact copies are split once. section_path is carried along.
    """
    rows = chunks.where(F.length("text") >= 4 * (limit + 1)).select("chunk_id", "section_path", "text").distinct()

    def run(batches):
        for pdf in batches:
            out = []
            for chunk, path, text in zip(pdf["chunk_id"], pdf["section_path"], pdf["text"]):
                pieces = split_text(text, limit, overlap)
                must = int(any(p[3] for p in pieces))
                out += [(chunk, path, i, a, e, tokens(e - a), f - a, cut, must, text[a:e]) for i, (a, f, e, cut) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=names)

    names = ["chunk_id", "section_path", "piece_no", "start", "end", "n_tokens", "overlap_chars", "forced_split", "must_force", "piece"]
    return rows.mapInPandas(run, "chunk_id string, section_path string, piece_no int, start int, end int, n_tokens int, overlap_chars int, forced_split boolean, must_force int, piece string")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_chunks(table(spark, folder, "sparse_chunks", "chunk_id", "section_path", "text")).select("chunk_id", "must_force").distinct()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_chunks(table(spark, folder, "sparse_chunks", "chunk_id", "section_path", "text"))

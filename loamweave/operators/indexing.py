"""From pages to a published index: chunks with all their columns, vectors from a cache, completeness, publication."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamweave.functions import embedding
from loamweave.functions.text import search_text
from loamweave.operators.chunking import chunk_pages, default_tokens, incomplete_pages
from loamweave.operators.ingest import caption_pages
from loamweave.operators.stage import stage
from loamweave.sources import store, vault


class IncompletePages(RuntimeError):
    pass


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, path, title, page_type, sources, links, aliases, sha256): a row a page; null lists are empty."""
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    row = F.max(F.struct("sha256", "path", "title", "page_type", *(empty(c) for c in ("sources", "links", "aliases"))))
    return pages.where("page_id is not null").groupBy("page_id").agg(row.alias("p")).select("page_id", "p.path", "p.title", "p.page_type", "p.sources", "p.links", "p.aliases", "p.sha256")


def with_captions(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages and captions as pages of type image_caption, in the columns of pages."""
    extra = caption_pages(images).withColumn("path", F.col("page_id"))
    return pages.unionByName(extra.select(*[c for c in pages.columns if c in extra.columns]), allowMissingColumns=True)


def chunk_rows(pages: DataFrame, tokens: Callable[[str], int] = default_tokens, lexicon: list[str] | None = None, fail_fast: bool = True) -> DataFrame:
    """Rows of the sparse table: chunks of pages (page_id, path, title, page_type, content) with page columns, parent_section_id and fts_text.

    A page with text that lacks chunks of either kind, such as one of headings only, raises
    with ``fail_fast``; else it is left out.
    """
    one = pages.where("page_id is not null").groupBy("page_id").agg(F.max(F.struct("content", "title", "path", "page_type")).alias("p")).select("page_id", "p.*")
    chunks = stage(chunk_pages(one.select("page_id", "title", "content"), tokens))
    if fail_fast:
        bad = [r["page_id"] for r in incomplete_pages(one, chunks).limit(5).collect()]
        if bad:
            raise IncompletePages(f"pages without chunks of both kinds: {bad}")
    rows = chunks.join(one.select("page_id", "path", "title", "page_type"), "page_id")
    parent = F.when(F.col("heading") != "", F.col("section_id"))
    return rows.select(
        "chunk_id", "page_id", "path", "title", "text", search_text(F.col("text"), lexicon).alias("fts_text"), "page_type", "section_path", "heading", "chunk_kind", parent.alias("parent_section_id"),
        "content_hash", "chunk_index", "token_count", "continuation_index", "start_char", "end_char", "forced_split",
    )


def build(pages: DataFrame, root: str, dim: int = 64, encode: Callable[[list[str]], np.ndarray] | None = None, images: DataFrame | None = None, full: bool = False, tokens: Callable[[str], int] = default_tokens, lexicon: list[str] | None = None, fail_fast: bool = True, work: dict | None = None) -> str:
    """Publish an index of pages, and of image captions if ``images`` is given; the build's id.

    Vectors of the published build are kept for texts that have not changed, unless
    ``full``; what is no page's text any more is not carried over.
    """
    spark: SparkSession = pages.sparkSession
    with store.lock(root):
        whole = with_captions(pages, images) if images is not None else pages
        rows = stage(chunk_rows(whole, tokens, lexicon, fail_fast))
        known = None
        if not full and store.pointer(root) is not None:
            known = store.load(spark, root)[1].select("content_hash", "vector").where(F.size("vector") == dim)
        dense = embedding.embedded(rows.where("chunk_kind = 'dense'").drop("fts_text"), known, encode or (lambda texts: embedding.hashed(texts, dim)))
        sparse = rows.withColumn("fts_text", F.when(F.trim("fts_text") != "", F.col("fts_text")).otherwise(F.col("chunk_id")))  # a chunk of signs only is found by its id
        return store.publish(sparse, dense, root, dim, work=work, about={"n_pages": whole.select("page_id").distinct().count()})


def build_vault(spark: SparkSession, folder: str, root: str, **options) -> str:
    """``build`` of the Markdown pages of a folder."""
    return build(vault.pages(spark, folder), root, **options)


def page_bodies(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, body): texts without a head, cut after ``most`` characters with a mark if given; null texts are empty."""
    body = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?s)\A---\n.*?\n---\n", ""))
    shown = body if most is None else F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("\n...[truncated]"))).otherwise(body)
    return pages.select("page_id", shown.alias("body")).distinct()

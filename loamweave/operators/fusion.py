"""Reciprocal rank fusion of hits on the page level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K_RRF = 60


def best_hits(hits: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """One row a key: that of the highest score, ties by the other columns, nulls last."""
    rest = [c for c in hits.columns if c not in keys and c != score]
    return hits.groupBy(*keys).agg(F.max(F.struct(score, *rest)).alias("_h")).select(*keys, *(F.col(f"_h.{c}").alias(c) for c in hits.columns if c not in keys))


def page_rrf(hits: DataFrame, k: int | None = None, evidence: int | None = None) -> DataFrame:
    """(query_id, page_id, rrf, sparse_rank, dense_rank[, evidence], rank) of hits (query_id, page_id, channel, rank[, chunk_id]).

    Every hit of a page adds 1 / (60 + rank). Hits with a null page, channel or rank do
    not count. evidence: how many of the best hits are kept with each page.
    """
    hits = hits.where("page_id is not null and channel is not null and rank is not null")
    least = lambda c: F.min(F.when(F.col("channel") == c, F.col("rank")))
    fused = hits.groupBy("query_id", "page_id").agg(
        F.sum(1.0 / (K_RRF + F.col("rank"))).alias("rrf"), least("sparse").alias("sparse_rank"), least("dense").alias("dense_rank"), F.min("rank").alias("first_rank")
    )
    if evidence:
        by = Window.partitionBy("query_id", "page_id").orderBy("rank", "channel", "chunk_id")
        kept = hits.withColumn("n", F.row_number().over(by)).where(F.col("n") <= evidence)
        packed = kept.groupBy("query_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "channel", "chunk_id"))).alias("evidence"))
        fused = fused.join(packed, ["query_id", "page_id"])
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "first_rank", "page_id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).drop("first_rank")
    return ranked.where(F.col("rank") <= k) if k else ranked


def category(path, rrf, has_graph, scope: str = "section"):
    """image, graph, page or dense: which share of the budget a candidate draws on."""
    low = F.lower(F.translate(path, "\\", "/"))
    return (
        F.when(low.contains("assets/") | low.rlike(r"\.(png|jpe?g|gif|webp)$"), "image")
        .when(has_graph & (rrf <= 0), "graph").otherwise("page" if scope in ("full_page", "full_source") else "dense")
    )

"""Exact nearest neighbours of a stated set of queries, in blocks.

Queries and data meet block by block in matrix products; each block keeps its k best of
every query, so what is shuffled after it is k rows a query and block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.functions.vectors import METRICS, finite

BLOCK = 8192


def topk(data: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", dim: int = 64) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of each query, ties by id, exact.

    data: (id, vector); queries: (query_id, vector). Vectors that are null, of another
    length or not finite take no part; of rows that repeat an id one counts. distance is
    1 - cosine, minus the product, or the Euclidean distance. Cosine with a zero vector
    is taken as 0.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    one = lambda df, key: df.where(F.col(key).isNotNull()).where(finite(F.col("vector"), dim)).groupBy(key).agg(F.max("vector").alias("vector"))
    data, queries = one(data, "id"), one(queries, "query_id")
    n_data, n_queries = max(1, math.ceil(data.count() / BLOCK)), max(1, math.ceil(queries.count() / BLOCK))
    spot = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(spot("query_id", n_queries).alias("qb"), every(n_data).alias("db"), "query_id", F.col("vector").alias("qv"))
    right = data.select(every(n_queries).alias("qb2"), spot("id", n_data).alias("db2"), "id", "vector")
    kinds = dict(data.dtypes)["id"], dict(queries.dtypes)["query_id"]

    def block(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "id", "distance"]
        if not len(q) or not len(x):
            return pd.DataFrame({n: [] for n in names})
        x = x.sort_values("id", kind="stable")
        a, b = np.array(q["qv"].tolist(), dtype=np.float64), np.array(x["vector"].tolist(), dtype=np.float64)
        if metric == "cosine":
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            a, b = unit(a), unit(b)
        ids, out = x["id"].to_numpy(), []
        for at in range(0, len(a), 512):
            part = a[at : at + 512]
            products = part @ b.T
            if metric == "cosine":
                far = 1 - products
            elif metric == "dot":
                far = -products
            else:
                far = np.sqrt(np.maximum((part**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * products, 0))
            best = np.argsort(np.round(far, 9), axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy()[at : at + 512], best.shape[1]), "id": ids[best].ravel(), "distance": np.take_along_axis(far, best, 1).ravel()}))
        return pd.concat(out)

    near = left.groupBy("qb", "db").cogroup(right.groupBy("qb2", "db2")).applyInPandas(block, f"query_id {kinds[1]}, id {kinds[0]}, distance double")
    by = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def recall(exact: DataFrame, candidate: DataFrame, k: int) -> DataFrame:
    """(query_id, recall) of a candidate top-k against the exact one; queries without exact rows are left out."""
    ids = lambda df: df.where(F.col("rank") <= k).select("query_id", "id")
    hit = ids(exact).join(ids(candidate).distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"))


def policy(recalls: dict[int, float], unindexed: int) -> str:
    """'ann' only if no row is unindexed and recall at 10 and 20 is complete; malformed figures raise ValueError."""
    if unindexed < 0 or {10, 20} - set(recalls) or any(not 0 <= r <= 1 for r in recalls.values()):
        raise ValueError("malformed benchmark")
    return "ann" if unindexed == 0 and recalls[10] == recalls[20] == 1.0 else "exact"

"""Vector index in cells. A search meets the closest cells first and then every cell that may still hold something nearer, so it is exact where it is asked to be, and reads few cells of clustered vectors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.functions.vectors import finite
from loamweave.operators.stage import stage

#: Vectors the centroids are fitted on and cells, at most; vectors of a cell in one block.
SAMPLE, CELLS, BLOCK = 10_000, 1024, 8192


@dataclass
class Index:
    """rows: (id, vector, cell); widest: the greatest angle of a member to its cell's centroid, negative for an empty cell."""

    rows: DataFrame
    centroids: np.ndarray
    widest: np.ndarray
    held: np.ndarray


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def _fit(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    centroids = sample[np.random.default_rng(3).choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centroids)
    return centroids


def build(vectors: DataFrame, dim: int = 64) -> Index:
    """Index of all usable vectors (id, vector): those with ``dim`` finite components; of rows that repeat an id one counts. Zero vectors are at a right angle to all."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["id"]
    one = stage(vectors.where("id is not null").where(finite(F.col("vector"), dim)).groupBy("id").agg(F.max("vector").cast("array<double>").alias("vector")))
    n = one.count()
    some = one.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.3 * SAMPLE / max(1, n))) + 1).limit(SAMPLE).toPandas()
    sample = _unit(np.array(some["vector"].tolist(), dtype=float).reshape(-1, dim)) if len(some) else np.eye(1, dim)
    centroids = _fit(sample, max(1, min(CELLS, math.ceil(math.sqrt(n)))))
    shared = spark.sparkContext.broadcast(centroids)  # ``CELLS`` rows at most

    def place(batches):
        for pdf in batches:
            close = _unit(np.array(pdf["vector"].tolist(), dtype=float).reshape(-1, dim)) @ shared.value.T
            cell = close.argmax(1)
            yield pd.DataFrame({"id": pdf["id"], "vector": pdf["vector"], "cell": cell.astype(np.int32), "angle": np.arccos(np.clip(close[np.arange(len(cell)), cell], -1, 1))})

    rows = stage(one.mapInPandas(place, f"id {kind}, vector array<double>, cell int, angle double"))
    widest, held = np.full(len(centroids), -1.0), np.zeros(len(centroids), dtype=np.int64)
    for r in rows.groupBy("cell").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect():  # a row a cell
        widest[r["cell"]], held[r["cell"]] = r["a"], r["n"]
    return Index(rows.select("id", "vector", "cell"), centroids, widest, held)


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
    """(query_id, id, distance, rank): the k of least cosine distance of each query (query_id, vector), ties by id.

    Without ``exact`` only the ``probes`` closest cells are met. Queries that are not
    usable give no row; a query with a zero vector meets all cells.
    """
    spark = queries.sparkSession
    dim = index.centroids.shape[1]
    kinds = dict(index.rows.dtypes)["id"], dict(queries.dtypes)["query_id"]
    asked = stage(queries.where("query_id is not null").where(finite(F.col("vector"), dim)).groupBy("query_id").agg(F.max("vector").cast("array<double>").alias("vector")))
    shared = spark.sparkContext.broadcast((index.centroids, index.widest))
    parts = np.maximum(1, np.ceil(index.held / BLOCK)).astype(int)
    blocks = spark.createDataFrame([(c, int(p)) for c, p in enumerate(parts)], "cell int, parts int")
    data = index.rows.join(F.broadcast(blocks), "cell").select(F.col("cell").alias("dcell"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("dpart"), "id", "vector")  # a row a cell

    def cells(later: bool):
        def run(batches):
            centroids, widest = shared.value
            for pdf in batches:
                close = _unit(np.array(pdf["vector"].tolist(), dtype=float).reshape(-1, dim)) @ centroids.T
                near = np.argsort(-close, axis=1, kind="stable")[:, :probes]
                met = np.zeros(close.shape, bool)
                np.put_along_axis(met, near, True, 1)
                if later:
                    least = np.cos(np.maximum(0.0, np.arccos(np.clip(close, -1, 1)) - widest[None, :]))
                    zero = np.array([not np.any(v) for v in pdf["vector"]], dtype=bool)
                    met = ~met & (1 - least <= pdf["far"].to_numpy()[:, None] + 1e-9) | ~met & zero[:, None]
                row, cell = np.nonzero(met & (widest >= 0)[None, :])
                yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[row], "qv": pd.Series([pdf["vector"].iloc[i] for i in row], dtype=object), "cell": cell.astype(np.int32)})

        return run

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        x = x.sort_values("id", kind="stable")
        a, b = _unit(np.array(q["qv"].tolist(), dtype=float)), _unit(np.array(x["vector"].tolist(), dtype=float))
        out = []
        for at in range(0, len(a), 512):
            far = 1 - a[at : at + 512] @ b.T
            best = np.argsort(np.round(far, 9), axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy()[at : at + 512], best.shape[1]), "id": x["id"].to_numpy()[best].ravel(), "distance": np.take_along_axis(far, best, 1).ravel()}))
        return pd.concat(out)

    def meet(some: DataFrame, later: bool) -> DataFrame:
        met = some.mapInPandas(cells(later), f"query_id {kinds[1]}, qv array<double>, cell int").join(F.broadcast(blocks), "cell")  # a row a cell
        left = met.withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return left.groupBy("cell", "qpart").cogroup(data.groupBy("dcell", "dpart")).applyInPandas(compare, f"query_id {kinds[1]}, id {kinds[0]}, distance double")

    by = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    top = lambda pairs: pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    first = top(meet(asked, False))
    if not exact:
        return first
    first = stage(first)
    floor = first.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("far"))
    second = meet(asked.join(floor, "query_id", "left").fillna(9.0, ["far"]), True)
    return top(first.drop("rank").unionByName(second))

"""The k most similar vectors of every vector.

Vectors are spread over cells around centroids fitted on a bounded sample. Inside a cell
the residuals to the centroid are rotated by a random orthogonal matrix and kept as one
packed bit a dimension with two correction scalars. A query residual becomes four bit
planes; counts of common bits give an unbiased estimate of each inner product with an
error bound, and only vectors whose upper bound beats the k-th best are compared exactly.

A query first meets the cells it is closest to. Then every cell left whose bound, from
the query's closeness to the centroid and the span of its members' closeness, still beats
the query's k-th best is met too, so probing ends where it can, in clustered data early
and in shapeless data late. Cells are put together to groups of neighbouring ones; a
query travels once to a group, whatever number of its cells it meets. Exact copies share
one code; they are put back at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.operators import dense
from loamweave.operators.stage import stage
from loamweave.sources.tables import table

#: Vectors the centroids are fitted on, at most; every vector is indexed.
SAMPLE = 20_000
#: Cells a query meets first, and cells at most; with more vectors cells grow.
PROBES, CELLS = 12, 4096
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 3.0
#: Bit planes of a query.
PLANES = 4
#: Rows of a group of cells in one block, and queries to it.
DATA_BLOCK, QUERY_BLOCK = 8192, 16_384
#: Elements of one matrix of estimates.
ELEMENTS = 1 << 19


def usable(vector: Column, dim: int) -> Column:
    """Exactly ``dim`` finite components that are not all zero; false for null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means; empty cells keep their last centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    return centroids.astype(np.float32)


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(unit: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated residuals, their lengths, and the cosine between residual and code."""
    turned = (unit - centroid) @ turn
    length = np.linalg.norm(turned, axis=1)
    fit = np.abs(turned).sum(1) / (np.maximum(length, 1e-12) * np.sqrt(turned.shape[1]))
    return np.packbits(turned > 0, axis=1), length, np.where(length > 1e-12, fit, 1.0)


def planes_of(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes (plane, row, byte) of rows quantised to ``PLANES`` bits a dimension, the least value and the step of each row."""
    low = residual.min(1, keepdims=True)
    step = np.maximum((residual.max(1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-12)
    code = np.rint((residual - low) / step).astype(np.uint8)
    return np.stack([np.packbits((code >> b) & 1, axis=1) for b in range(PLANES)]), low[:, 0], step[:, 0]


def _words(packed: np.ndarray) -> np.ndarray:
    """Packed bytes as 64-bit words, filled up with zeros."""
    fill = -packed.shape[-1] % 8
    if fill:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], fill), np.uint8)], axis=-1)
    return np.ascontiguousarray(packed).view(np.uint64)


def estimates(residual: np.ndarray, bits: np.ndarray, length: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, error bound) of the inner products of rotated query residuals with coded residuals, from counts of common bits."""
    dim = residual.shape[1]
    planes, low, step = planes_of(residual)
    data, asked = _words(bits), _words(planes)
    common = np.zeros((len(residual), len(bits)), dtype=np.float32)
    for b in range(PLANES):
        for w in range(data.shape[1]):
            common += np.bitwise_count(asked[b, :, w][:, None] & data[:, w][None, :]) * np.float32(1 << b)
    ones = np.bitwise_count(data).sum(1).astype(np.float32)
    # sum over dims of q * (2 bit - 1), q = low + step * code
    signed = 2 * (step[:, None].astype(np.float32) * common + low[:, None].astype(np.float32) * ones[None, :]) - residual.sum(1, keepdims=True)
    scale = (length / (np.maximum(fit, 1e-6) * np.sqrt(dim))).astype(np.float32)
    spread = np.sqrt(np.maximum(1 - fit**2, 0) / max(dim - 1, 1)) / np.maximum(fit, 1e-6) * length
    size = np.linalg.norm(residual, axis=1)
    rough = step * np.sqrt(dim / 12)  # of rounding to planes
    return signed * scale[None, :], (EPSILON * (size[:, None] * spread[None, :] + rough[:, None] * (length / (np.maximum(fit, 1e-6) * np.sqrt(dim)))[None, :])).astype(np.float32)


class Nearest:
    """The k best (cosine, key) of each of some queries so far."""

    def __init__(self, keys: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.keys, self.k = keys, k
        self.floor = floor.astype(np.float64).copy()
        self.row, self.near, self.cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, at: np.ndarray, queries: np.ndarray, data: np.ndarray, ids: np.ndarray, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> None:
        """Queries number ``at`` against the members of one cell."""
        beside = data @ centroid
        for start in range(0, len(at), max(1, ELEMENTS // max(1, len(data)))):
            rows = at[start : start + max(1, ELEMENTS // max(1, len(data)))]
            q = queries[rows]
            guess, error = estimates((q - centroid) @ turn, bits, length, fit)
            # <x, q> = <x - c, q - c> + <x, c> + <q, c> - <c, c>
            guess += beside[None, :] + (q @ centroid)[:, None] - centroid @ centroid
            own = self.keys[rows, None] == ids[None, :]
            floor_of = self.floor[rows]
            floor = floor_of.copy()
            keep = min(self.k, guess.shape[1])
            open_ = floor < -1.5
            if open_.any():
                low = np.where(own[open_], -4, guess[open_] - error[open_])
                floor[open_] = np.partition(low, low.shape[1] - keep, axis=1)[:, low.shape[1] - keep]
            left = (guess + error >= floor[:, None]) & ~own
            if 32 * np.count_nonzero(left) > left.size:  # many in few rows: their products at once, of which the best go on
                product = np.where(left, q @ data.T, np.float32(-4))
                best = np.partition(product, product.shape[1] - keep, axis=1)[:, product.shape[1] - keep]
                left = product >= np.maximum(np.maximum(best, floor_of) - 1e-5, -2)[:, None]
            row, col = np.nonzero(left)
            exact = np.einsum("ij,ij->i", q[row].astype(np.float64), data[col].astype(np.float64))
            good = exact >= floor_of[row] - 1e-9
            self._add(rows[row[good]], ids[col[good]], exact[good])

    def _add(self, row: np.ndarray, near: np.ndarray, cosine: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.zeros(len(self.keys), bool)
        touched[row] = True
        old = touched[self.row]
        r, n, c = np.concatenate([self.row[old], row]), np.concatenate([self.near[old], near]), np.concatenate([self.cosine[old], cosine])
        order = np.lexsort((n, -c, r))
        r, n, c = r[order], n[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        best = place < self.k
        last = place == self.k - 1
        self.floor[r[last]] = np.maximum(self.floor[r[last]], c[last])
        self.row, self.near, self.cosine = np.concatenate([self.row[~old], r[best]]), np.concatenate([self.near[~old], n[best]]), np.concatenate([self.cosine[~old], c[best]])


def grouped(centroids: np.ndarray, held: np.ndarray, most: int) -> np.ndarray:
    """Group number of each cell: cells are halved across their widest direction until a group holds at most ``most`` members or is one cell."""
    group = np.zeros(len(centroids), dtype=np.int32)
    todo, made = [np.arange(len(centroids))], 0
    while todo:
        cells = todo.pop()
        if len(cells) < 2 or held[cells].sum() <= most:
            group[cells] = made
            made += 1
            continue
        inner = centroids[cells] - centroids[cells].mean(0)
        order = cells[np.argsort(inner @ np.linalg.svd(inner, full_matrices=False)[2][0], kind="stable")]
        cut = int(np.searchsorted(np.cumsum(held[order]), held[order].sum() / 2)) + 1
        cut = min(max(1, cut), len(order) - 1)
        todo += [order[:cut], order[cut:]]
    return group


def reachable(units: np.ndarray, floor: np.ndarray, centroids: np.ndarray, least: np.ndarray, most: np.ndarray, n: int) -> np.ndarray:
    """(query, cell): whether a member of the cell may beat the query's k-th best.

    A member's cosine is a b + sqrt(1 - a^2) sqrt(1 - b^2) t, with a and b the closeness of
    member and query to the centroid; a lies between the cell's least and most, and t, the
    cosine of what is left of both, is at most what the greatest of n random directions
    reaches.
    """
    b = units @ centroids.T
    t = min(1.0, np.sqrt(2 * np.log(max(n, 2))) / np.sqrt(max(1, units.shape[1] - 1)))
    w = t * np.sqrt(np.maximum(1 - b**2, 0))
    a = np.clip(b / np.maximum(np.sqrt(b**2 + w**2), 1e-9), least[None, :], most[None, :])
    return a * b + w * np.sqrt(np.maximum(1 - a**2, 0)) >= floor[:, None]


def _units(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, unit) of the usable vectors: packed 32-bit floats of length 1."""

    def run(batches):
        for pdf in batches:
            fits = np.array([v is not None and len(v) == dim for v in pdf["vector"]], dtype=bool)
            x = np.array(pdf["vector"][fits].tolist(), dtype=np.float64).reshape(-1, dim)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x = x[good]
            x /= np.abs(x).max(1, keepdims=True)  # keeps the squares in range
            unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)
            yield pd.DataFrame({"id": pdf["id"][fits][good], "unit": [u.tobytes() for u in unit]})

    return vectors.where("id is not null and vector is not null").select("id", "vector").mapInPandas(run, f"id {dict(vectors.dtypes)['id']}, unit binary")


def similar(vectors: DataFrame, k: int = 5, dim: int = 64, probes: int = PROBES, at_least: float = -1.0) -> DataFrame:
    """(id, other, cosine, place) of the k most similar other ids of every id, ties by id, of cosine ``at_least``.

    vectors: (id, vector); unusable vectors and null ids take no part, of rows that
    repeat an id one counts. No more than ``k`` rows an id come out; ids of exact copies
    are neighbours of one another with cosine 1.
    """
    spark: SparkSession = vectors.sparkSession
    kind = dict(vectors.dtypes)["id"]
    rows = stage(_units(vectors, dim).withColumn("key", F.xxhash64("unit")))
    members = stage(rows.groupBy("id").agg(F.max("key").alias("key")))
    copies = Window.partitionBy("key").orderBy("id")
    firsts = members.select("key", "id").withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1)
    heads = firsts.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    kept = members.select("key").distinct()
    reps = rows.groupBy("key").agg(F.first("unit").alias("unit")).join(kept, "key", "left_semi")
    n = kept.count()
    if not n:
        return spark.createDataFrame([], f"id {kind}, other {kind}, cosine double, place int")
    part = min(1.0, 1.2 * SAMPLE / n)
    drawn = rows.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1_000_000)) < int(part * 1_000_000) + 1).select("key", "unit").dropDuplicates(["key"]).limit(SAMPLE).toPandas()
    drawn = drawn.sort_values("key")
    sample = np.frombuffer(b"".join(drawn["unit"]), dtype=np.float32).reshape(-1, dim)
    if not len(sample):
        sample = np.eye(1, dim, dtype=np.float32)
    centroids = fit_centroids(sample, min(CELLS, int(np.ceil(np.sqrt(n)))))
    turn = rotation(dim)
    shared = spark.sparkContext.broadcast((centroids, turn))  # ``CELLS`` centroids at most

    def spread(batches):
        centroids, turn = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            unit = np.frombuffer(b"".join(pdf["unit"]), dtype=np.float32).reshape(-1, dim)
            closeness = unit @ centroids.T
            near = np.argsort(-closeness, axis=1, kind="stable")[:, :probes].astype(np.int32)
            codes = [b""] * len(unit)
            length, fit = np.zeros(len(unit)), np.ones(len(unit))
            for c in np.unique(near[:, 0]):
                at = np.flatnonzero(near[:, 0] == c)
                bits, length[at], fit[at] = encode(unit[at], centroids[c], turn)
                for i, b in zip(at, bits):
                    codes[i] = b.tobytes()
            yield pd.DataFrame({
                "key": pdf["key"], "unit": pdf["unit"], "cell": near[:, 0], "closeness": closeness[np.arange(len(unit)), near[:, 0]].astype(float),
                "cells": list(near), "bits": codes, "length": length, "fit": fit,
            })

    coded = stage(reps.mapInPandas(spread, "key long, unit binary, cell int, closeness double, cells array<int>, bits binary, length double, fit double"))
    counted = coded.groupBy("cell").agg(F.count("*").alias("n"), F.min("closeness").alias("least"), F.max("closeness").alias("most")).toPandas()  # a row a cell
    held, least, most = np.zeros(len(centroids)), np.full(len(centroids), 2.0), np.full(len(centroids), -2.0)
    held[counted["cell"]], least[counted["cell"]], most[counted["cell"]] = counted["n"], counted["least"], counted["most"]
    group = grouped(centroids, held, DATA_BLOCK)
    size = np.bincount(group, held)
    parts = np.maximum(1, np.ceil(size / DATA_BLOCK)).astype(int)  # more than one only for a cell over the block
    plan = spark.sparkContext.broadcast((group, held, np.where(held > 0, least, 1.0), np.where(held > 0, most, 1.0)))
    group_of = spark.createDataFrame([(int(c), int(g), int(parts[g])) for c, g in enumerate(group)], "cell int, grp int, parts int")
    data = coded.join(F.broadcast(group_of), "cell").select("grp", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("db"), "key", "unit", "cell", "bits", "length", "fit")  # a row a cell

    def groups_met(floors):
        """Travelling queries: a row for each group with cells that are to be met, first (without floors) the closest ones."""

        def run(batches):
            group, held, least, most = plan.value
            centroids, _ = shared.value
            for pdf in batches:
                unit = np.frombuffer(b"".join(pdf["unit"]), dtype=np.float32).reshape(-1, dim)
                met = np.zeros((len(pdf), len(group)), bool)
                if len(pdf):
                    met[np.arange(len(pdf))[:, None], np.array(pdf["cells"].tolist(), dtype=np.int64)] = True
                    if floors:
                        met = ~met & (held > 0)[None, :] & reachable(unit, pdf["floor"].to_numpy(), centroids, least, most, int(held.sum()))
                met &= (held > 0)[None, :]
                row, cell = np.nonzero(met)
                order = np.lexsort((cell, group[cell], row))
                row, cell = row[order], cell[order].astype(np.int32)
                start = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(group[cell]) != 0)])) if len(row) else np.zeros(0, int)
                head = row[start]
                yield pd.DataFrame({
                    "qgrp": group[cell[start]] if len(row) else np.zeros(0, np.int32), "qkey": pdf["key"].to_numpy()[head], "qunit": pd.Series([pdf["unit"].iloc[i] for i in head], dtype=object),
                    "qcells": pd.Series([c.tobytes() for c in np.split(cell, start[1:])] if len(row) else [], dtype=object), "floor": pdf["floor"].to_numpy()[head] if floors else np.full(len(head), -2.0),
                })

        return run

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "near": [], "cosine": []}).astype({"key": "int64", "near": "int64"})
        centroids, turn = shared.value
        matrix = lambda s: np.frombuffer(b"".join(s), dtype=np.float32).reshape(-1, dim)
        q, x = matrix(left["qunit"]), matrix(right["unit"])
        bits = np.frombuffer(b"".join(right["bits"]), dtype=np.uint8).reshape(len(x), -1)
        xk, xc = right["key"].to_numpy(), right["cell"].to_numpy()
        length, fit = right["length"].to_numpy(np.float32), right["fit"].to_numpy(np.float32)
        cells = [np.frombuffer(c, dtype=np.int32) for c in left["qcells"]]
        flat, owner = np.concatenate(cells), np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        best = Nearest(left["qkey"].to_numpy(), left["floor"].to_numpy(), k)
        close = np.einsum("ij,ij->i", q[owner], centroids[flat])
        order = np.lexsort((-close, owner))
        first = np.zeros(len(flat), bool)
        first[order[np.concatenate([[True], np.diff(owner[order]) != 0])]] = True
        widest = np.arccos(np.clip(plan.value[2], -1, 1))  # of a cell's members to its centroid
        for later in (False, True):  # the closest cell of each query, then those that no angle rules out
            if later:
                nearest = np.cos(np.maximum(0.0, np.arccos(np.clip(close, -1, 1)) - widest[flat]))
                todo = ~first & (nearest + 1e-6 >= best.floor[owner])
            else:
                todo = first
            for c in np.unique(flat[todo]):
                at = np.flatnonzero(xc == c)
                if len(at):
                    best.meet(owner[todo & (flat == c)], q, x[at], xk[at], bits[at], length[at], fit[at], centroids[c], turn)
        return pd.DataFrame({"key": best.keys[best.row], "near": best.near, "cosine": best.cosine})

    def round_(asked: DataFrame, floors: bool) -> DataFrame:
        """Pairs (key, near, cosine) of one round of probing; a group with many queries or members is met in blocks."""
        travelling = asked.mapInPandas(groups_met(floors), "qgrp int, qkey long, qunit binary, qcells binary, floor double")
        travelling = stage(travelling) if floors else travelling  # the few of the second round, behind a join
        met = {r[0]: r[1] for r in travelling.groupBy("qgrp").count().collect()}  # a row a group
        blocks = spark.createDataFrame([(int(g), int(parts[g]), max(1, -(-int(c) // QUERY_BLOCK))) for g, c in met.items()], "qgrp int, d int, q int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        queries = travelling.join(F.broadcast(blocks), "qgrp").select("qgrp", F.pmod(F.xxhash64("qkey"), F.col("q")).cast("int").alias("qq"), every("d").alias("qd"), "qkey", "qunit", "qcells", "floor")
        there = data.join(F.broadcast(blocks.withColumnRenamed("qgrp", "grp")), "grp").select("grp", "db", every("q").alias("qb"), "key", "unit", "cell", "bits", "length", "fit")
        return queries.groupBy("qgrp", "qd", "qq").cogroup(there.groupBy("grp", "db", "qb")).applyInPandas(compare, "key long, near long, cosine double")

    by = Window.partitionBy("key").orderBy(F.desc("cosine"), "near")
    top = lambda pairs: pairs.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
    first = stage(top(round_(coded.select("key", "unit", "cells"), False)))
    floor = first.groupBy("key").agg(F.min(F.when(F.col("place") == k, F.col("cosine"))).alias("floor"))
    asked = coded.select("key", "unit", "cells").join(floor, "key", "left").fillna(-1.0, ["floor"])
    best = top(first.select("key", "near", "cosine").unionByName(round_(asked, True))).where(F.col("cosine") >= at_least)
    around = (
        best.join(heads.withColumnRenamed("key", "near"), "near")
        .groupBy("key").agg(F.collect_list(F.struct("cosine", "ids")).alias("around"))  # k entries of k + 1 ids
    )
    own = heads.join(around.select("key"), "key", "left_semi").unionByName(heads.where(F.size("ids") > 1)).distinct() if at_least > -1.0 else heads
    near = own.join(around, "key", "left").select(
        "key",
        F.concat(
            F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("order"), i.alias("other"))),
            F.flatten(F.transform(F.coalesce("around", F.array().cast(around.schema["around"].dataType)), lambda a: F.transform(a["ids"], lambda i: F.struct((-a["cosine"]).alias("order"), i.alias("other"))))),
        ).alias("near"),
    )
    ranked = members.select("id", "key").join(near, "key").select(
        "id", F.posexplode(F.slice(F.array_sort(F.filter("near", lambda x: x["other"] != F.col("id"))), 1, k)).alias("place", "x")
    )
    return ranked.select("id", F.col("x.other").alias("other"), F.least(-F.col("x.order"), F.lit(1.0)).alias("cosine"), (F.col("place") + 1).alias("place"))


def _chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dense_chunks", "chunk_id", "vector").withColumnRenamed("chunk_id", "id")


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return similar(_chunk_vectors(spark, folder)).select(F.col("id").alias("chunk_id"), F.col("other").alias("other_id"), F.round("cosine", 6).alias("cosine"), "place")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with a cosine of at least 0.9 where one is among the five most similar to the other."""
    close = similar(_chunk_vectors(spark, folder), at_least=0.9 - 1e-9)
    return close.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()


def _recall(vectors: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Exact and found (query_id, id) of the asked ids."""
    near = dense.topk(vectors.where(usable(F.col("vector"), 64)), vectors.where(usable(F.col("vector"), 64)).join(asked.distinct(), "id", "left_semi").withColumnRenamed("id", "query_id"), k + 1)
    by = Window.partitionBy("query_id").orderBy("rank")
    exact = near.where("id != query_id").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "id")
    return exact, similar(vectors, k).select(F.col("id").alias("query_id"), F.col("other").alias("id"))


def p2_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the five most similar against exact search, asked with every vector whose number is divisible by 20: of clustered (dense_chunks) and shapeless (embeddings) vectors."""
    chunks = table(spark, folder, "dense_chunks", "chunk_id", "chunk_index", "vector")
    plain = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    parts = []
    for name, vectors, asked in (
        ("dense_chunks", _chunk_vectors(spark, folder), chunks.where("chunk_index % 20 = 0").select(F.col("chunk_id").alias("id"))),
        ("embeddings", plain, plain.where("id % 20 = 0").select("id")),
    ):
        exact, found = _recall(vectors, asked, 5)
        hits = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
        parts.append(hits.agg(
            F.lit(name).alias("src_table"), F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_true"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("recall_reached"),
        ).select("src_table", "n_queries", "n_true", "recall_reached"))
    return parts[0].unionByName(parts[1])

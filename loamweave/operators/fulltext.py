"""BM25 over an inverted index.

Statistics are taken over all documents, also when hits are restricted to some pages.
Only postings of the asked terms are read. They meet the queries in blocks, of which
only the best of each query go on.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.sources.tables import settle

K1, B = 1.2, 0.75
#: Documents and queries that meet in one block.
DOCS, QUERIES = 20_000, 4096


def terms_of(search_text: Column) -> Column:
    return F.filter(F.split(search_text, r"\s+"), lambda t: t != "")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, F.xxhash64(text).alias("h"), terms_of(F.col(text)).alias("words")).withColumn("length", F.size("words"))


def document_lengths(docs: DataFrame, key: str = "id", text: str = "search_text") -> DataFrame:
    """(key, h, length, copies) of each document; only hashes and lengths are shuffled. Of different texts of one key that with the greatest hash counts; equal ones are copies."""
    rows = _rows(docs, key, text).groupBy(key, "h").agg(F.first("length").alias("length"), F.count("*").alias("copies"))
    return rows.groupBy(key).agg(F.max(F.struct("h", "length", "copies")).alias("d")).select(key, "d.h", "d.length", "d.copies")


def postings(docs: DataFrame, key: str = "id", text: str = "search_text", wanted: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(term, key, tf, length), of the ``wanted`` terms (term) only if given. Null texts have no postings; a repeated key is one document.

    Texts are not shuffled: a document's copies raise each count alike and are divided out.
    """
    lengths = document_lengths(docs, key, text) if lengths is None else lengths
    flat = _rows(docs, key, text).select(key, "h", F.explode("words").alias("term"))
    if wanted is not None:
        flat = flat.join(wanted, "term", "left_semi")
    counted = flat.groupBy("term", key, "h").agg(F.count("*").alias("n"))
    return counted.join(lengths, [key, "h"]).select("term", key, (F.col("n") / F.col("copies")).cast("long").alias("tf"), "length")


def write_index(docs: DataFrame, name: str, key: str = "id", text: str = "search_text", buckets: int = 256) -> None:
    """Tables ``name``_postings, bucketed by term, and ``name``_lengths, so that queries meet the index without a shuffle of it."""
    lengths = document_lengths(docs, key, text)
    postings(docs, key, text).write.mode("errorifexists").bucketBy(buckets, "term").sortBy("term").saveAsTable(f"{name}_postings")
    lengths.select(key, "length").write.mode("errorifexists").saveAsTable(f"{name}_lengths")


def search_index(index: DataFrame, lengths: DataFrame, queries: DataFrame, k: int, key: str = "id", within: DataFrame | None = None) -> DataFrame:
    """``search`` over stored postings (term, key, tf, length) and lengths (key, length)."""
    size = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    asked = _asked(queries)
    hits = index.join(asked.select("term").distinct(), "term", "left_semi")
    return _best(hits, size, asked, k, key, within)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms_of(F.col("query")))).alias("term"))


def _scored_block(k: int, key: str):
    """The k best documents of a block for each query of a block, ties by key."""

    def run(hits: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series([], dtype=asked["query_id"].dtype), key: pd.Series([], dtype=hits[key].dtype), "score": pd.Series([], dtype=float)})
        if not len(hits) or not len(asked):
            return none
        terms, code = np.unique(hits["term"].to_numpy(dtype=str), return_inverse=True)
        keys, doc = np.unique(hits[key].to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        doc, weight, start = doc[order], hits["weight"].to_numpy()[order], np.searchsorted(code[order], np.arange(len(terms) + 1))
        wanted = asked["term"].to_numpy(dtype=str)
        at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        known = terms[at] == wanted
        out = []
        for query, rows in pd.Series(at[known]).groupby(asked["query_id"].to_numpy()[known], sort=False):
            parts = [slice(start[t], start[t + 1]) for t in rows]
            score = np.bincount(np.concatenate([doc[p] for p in parts]), np.concatenate([weight[p] for p in parts]), len(keys)).round(9)
            hit = np.flatnonzero(score > 0)
            if len(hit) > k:
                hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k]]
            best = hit[np.lexsort((hit, -score[hit]))][:k]
            if not len(best):
                continue
            out.append(pd.DataFrame({"query_id": [query] * len(best), key: keys[best], "score": score[best]}))
        return pd.concat(out) if out else none

    return run


def _best(hits: DataFrame, size: DataFrame, asked: DataFrame, k: int, key: str, within: DataFrame | None) -> DataFrame:
    """Queries and documents meet in blocks, each of which gives the k best of every query, so scores of all pairs are never shuffled."""
    n, mean = size.first()
    settle(hits.sparkSession)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    if within is not None:
        hits = hits.join(within.select(key).distinct(), key, "left_semi")
    weight = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0))
    )
    n_docs, n_asked = max(1, math.ceil(n / DOCS)), max(1, math.ceil(asked.select("query_id").distinct().count() / QUERIES))
    spot, every = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int"), lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = hits.join(df, "term").select(spot(key, n_docs).alias("db"), every(n_asked).alias("qb"), "term", key, weight.alias("weight"))
    right = asked.select(every(n_docs).alias("db2"), spot("query_id", n_asked).alias("qb2"), "query_id", "term")
    kinds = dict(asked.dtypes)["query_id"], dict(hits.dtypes)[key]
    met = left.groupBy("db", "qb").cogroup(right.groupBy("db2", "qb2")).applyInPandas(_scored_block(k, key), f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int, key: str = "id", text: str = "search_text", within: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank) of the k best documents of each query, ties by key.

    queries: (query_id, query). A document matches with any term. within: (key) of the
    documents that may be hits; inverse document frequencies stay those of all.
    """
    lengths = document_lengths(docs, key, text)
    size = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    asked = _asked(queries)
    return _best(postings(docs, key, text, asked.select("term").distinct(), lengths), size, asked, k, key, within)

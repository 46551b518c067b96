"""Texts to vectors. A model plugs in as a function of a list of texts; without one, hashed terms make vectors that share terms share direction."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TERM = re.compile(r"[一-鿿]|[^\W_]+")


def hashed(texts: list[str | None], dim: int = 64) -> np.ndarray:
    """Unit vectors of signed term hashes; null and wordless texts give zeros."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for row, text in enumerate(texts):
        for term in _TERM.findall((text or "").lower()):
            code = zlib.crc32(term.encode())
            out[row, code % dim] += 1.0 if code & (1 << 20) else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(size, 1e-12)


def embedder(encode: Callable[[list[str]], np.ndarray] = hashed) -> Callable[[str | Column], Column]:
    """A column function that encodes texts batch by batch."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode(texts.tolist()), dtype=np.float32)))

    return run


def embedded(chunks: DataFrame, cached: DataFrame | None = None, encode: Callable[[list[str]], np.ndarray] = hashed) -> DataFrame:
    """chunks (content_hash, text, ...) with their vectors: those of ``cached`` (content_hash, vector) where it has them; every other text is encoded once, however many chunks share it."""
    texts = chunks.where("content_hash is not null").groupBy("content_hash").agg(F.max("text").alias("text"))
    if cached is None:
        made = texts.select("content_hash", embedder(encode)("text").alias("vector"))
    else:
        known = cached.where("vector is not null").groupBy("content_hash").agg(F.max("vector").alias("vector"))
        made = known.join(texts.select("content_hash"), "content_hash", "left_semi").unionByName(texts.join(known, "content_hash", "left_anti").select("content_hash", embedder(encode)("text").alias("vector")))
    return chunks.join(made, "content_hash")

"""Sizes of documents in tokens of the default counter, and source names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_size(text: Column) -> Column:
    """max(1, characters // 4); null for a null text."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def source_name(source: Column) -> Column:
    """Trimmed and in lower case; blank counts as null."""
    name = F.lower(F.trim(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")))
    return F.when(name != "", name)

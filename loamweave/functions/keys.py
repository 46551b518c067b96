"""Content hashes, ids and fingerprints as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamweave.functions.text import collapsed

CHUNK_SCHEMA = 3


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(page_id: Column, kind: Column, body: Column, occurrence: Column) -> Column:
    """page_id::hash of kind, body and how often the page had that body before; stable under insertions elsewhere."""
    seed = F.concat_ws("|", kind, collapsed(body), occurrence.cast("string"), F.lit(f"v{CHUNK_SCHEMA}"))
    return F.concat(page_id, F.lit("::"), F.substring(F.sha2(seed, 256), 1, 16))


def section_id(page_id: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat(page_id, F.lit("|"), F.array_join(path, "/")), 256), 1, 12)


def edge_ends(a: Column, b: Column) -> list[Column]:
    """The ends of an undirected edge in order."""
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def set_fingerprint(row: Column) -> Column:
    """Aggregate over rows that does not depend on their order: how many there are, the sum and the exclusive or of their hashes, so rows that repeat change it too."""
    hashed = F.xxhash64(row)
    total = F.sum(hashed.cast("decimal(38,0)")).cast("string")
    return F.concat_ws("-", F.count(row).cast("string"), F.hex(F.bit_xor(hashed)), total)

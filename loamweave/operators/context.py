"""Context around hits: neighbours, sections, token budgets and assembly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Mode and multiplier of each context mode, and shares of the budget.
MODES = {
    "section": ("snippet", 1.0), "parent_section": ("snippet", 1.0), "multiple_sections": ("snippet", 1.4),
    "evidence": ("snippet", 1.0), "chunk": ("snippet", 1.0), "global": ("summary", 1.0),
}
SHARES = {"dense": 0.60, "page": 0.20, "image": 0.05, "graph": 0.15}
#: Chunk indices in one window of the neighbour search.
SPAN = 4096


def neighbours(chunks: DataFrame) -> DataFrame:
    """(chunk_id, previous_id, next_id) inside each page of (chunk_id, page_id, chunk_index), in the order of the index, nulls last, ties by id.

    Pages are cut into spans of indices; the edges of spans are matched in a second,
    small window, so no page has to fit into one task. Repeated rows count once.
    """
    rows = chunks.where("chunk_id is not null and page_id is not null").groupBy("chunk_id", "page_id").agg(F.min("chunk_index").alias("i"))
    part = F.coalesce(F.floor(F.col("i") / SPAN), F.lit(1 << 40)).cast("long")
    rows = rows.withColumn("part", part)
    order = [F.asc_nulls_last("i"), "chunk_id"]
    inside = Window.partitionBy("page_id", "part").orderBy(*order)
    marked = rows.withColumns({"p": F.lag("chunk_id").over(inside), "n": F.lead("chunk_id").over(inside)})
    ends = marked.groupBy("page_id", "part").agg(F.min(F.when(F.col("p").isNull(), F.col("chunk_id"))).alias("first"), F.min(F.when(F.col("n").isNull(), F.col("chunk_id"))).alias("last"))
    across = Window.partitionBy("page_id").orderBy("part")
    ends = ends.select("page_id", "part", F.lag("last").over(across).alias("before"), F.lead("first").over(across).alias("after"))
    return marked.join(ends, ["page_id", "part"]).select("chunk_id", F.coalesce("p", "before").alias("previous_id"), F.coalesce("n", "after").alias("next_id"))


def budget(mode: Column, base: Column, override: str | None = None, hard_max: int | None = None) -> list[Column]:
    """mode, planned and effective tokens: base times the mode's multiplier, cut to an integer; an override drops the multiplier, a maximum of 0 or None caps nothing."""
    if override:
        name, times = F.lit(override), F.lit(1.0)
    else:
        name, times = F.lit("snippet"), F.lit(1.0)
        for m, (n, x) in MODES.items():
            name, times = F.when(mode == m, n).otherwise(name), F.when(mode == m, x).otherwise(times)
    planned = (base * times).cast("long")
    return [name.alias("bundle_mode"), planned.alias("planned_tokens"), (F.least(planned, F.lit(hard_max)) if hard_max else planned).alias("effective_tokens")]


def fold(items: list[tuple[str, int]], limit: int) -> list[tuple[int, int, bool]]:
    """(position, tokens, cut) of the items (category, tokens) that get into a budget, in their order.

    Each category present has its share of the budget first; what does not fit there waits
    and is offered what is left at the end, in the same order. The first of them that does
    not fit is cut to all that is left. Empty items get nothing.
    """
    present = {c for c, _ in items}
    share = {c: int(limit * SHARES[c]) if len(present) > 1 else limit for c in present}
    spent = dict.fromkeys(present, 0)
    used, waiting, out = 0, [], []
    for n, (c, size) in enumerate(items):
        held = sum(max(0, share[o] - spent[o]) for o in present if o != c) if len(present) > 1 else 0
        allowed = min(share[c] - spent[c], limit - used - held)
        if 0 < size <= allowed:
            out.append((n, size, False))
            spent[c] += size
            used += size
        elif size:
            waiting.append(n)
    for n in waiting:
        room = limit - used
        if room < 1:
            break
        size = min(items[n][1], room)
        out.append((n, size, size < items[n][1]))
        used += size
    return sorted(out)


def _size(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def pack(items: list[tuple[str, str, str]], limit: int) -> list[tuple[int, str, int, bool]]:
    """``fold`` of the items (id, category, text): (position, text, tokens, cut), in tokens of max(1, characters // 4)."""
    out = []
    for n, size, cut in fold([(c, _size(t)) for _, c, t in items], limit):
        text = items[n][2][: 4 * size + 3].rstrip() if cut else items[n][2]
        if text:
            out.append((n, text, _size(text), cut))
    return out


def assemble(candidates: DataFrame, limit: int = 4096, omitted: bool = False) -> DataFrame:
    """(query_id, place, id, category, text, n_tokens, truncated) of candidates (query_id, rank, id, category, text).

    A column limit of the candidates takes the place of ``limit``; other columns are
    carried along. An id met twice in a query counts once, where it ranks best. Null and
    empty texts and unknown categories are left out. With ``omitted`` what got no room
    comes too, with the reason in a column omitted. A query's fold sees sizes only, texts
    join it afterwards.
    """
    rest = [c for c in candidates.columns if c not in ("query_id", "rank", "id", "category", "text", "limit")]
    rows = candidates.where(F.col("text").isNotNull() & (F.col("text") != "") & F.col("category").isin(*SHARES))
    rows = rows.withColumn("limit", F.col("limit").cast("int") if "limit" in candidates.columns else F.lit(limit))
    once = rows.groupBy("query_id", "id").agg(F.min(F.struct("rank", "category", "text", "limit", *rest)).alias("c")).select("query_id", "id", "c.*")
    size = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int")
    by = Window.partitionBy("query_id").orderBy("rank", "id")
    small = once.select("query_id", "id", "rank", "category", "limit", size.alias("size")).withColumn("place", F.row_number().over(by)).drop("rank")
    kind = dict(candidates.dtypes)["query_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        got = {n: (t, c) for n, t, c in fold(list(zip(pdf["category"], pdf["size"])), int(pdf["limit"].iloc[0]))}
        kept = [got.get(n, (0, False)) for n in range(len(pdf))]
        return pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "place": pdf["place"], "n_tokens": [k[0] for k in kept], "truncated": [k[1] for k in kept]})

    folded = small.groupBy("query_id").applyInPandas(run, f"query_id {kind}, id {dict(candidates.dtypes)['id']}, place int, n_tokens int, truncated boolean")
    text = F.when(F.col("truncated"), F.rtrim(F.substr("text", F.lit(1), 4 * F.col("n_tokens") + 3), F.lit(" \n\t\r"))).otherwise(F.col("text"))
    whole = once.join(folded, ["query_id", "id"]).withColumn("text", F.when(F.col("n_tokens") > 0, text))
    whole = whole.withColumn("n_tokens", F.when(F.coalesce("text", F.lit("")) != "", F.greatest(F.lit(1), F.floor(F.length("text") / 4))).otherwise(0).cast("int"))
    columns = ["query_id", "place", "id", "category", "text", "n_tokens", "truncated", *rest]
    if not omitted:
        return whole.where("n_tokens > 0").select(*columns)
    return whole.select(*columns, F.when(F.col("n_tokens") == 0, F.concat("category", F.lit("_budget_exhausted"))).alias("omitted"))

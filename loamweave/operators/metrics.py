"""Retrieval metrics, exact nearest-rank percentiles and the regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = 256


def ranking_metrics(ranked: DataFrame, gold: DataFrame, recall_at: int = 5, mrr_at: int = 10, hit_at: int = 3) -> DataFrame:
    """(query_id, recall, reciprocal_rank, hit) of ranked pages (query_id, page_id, rank) against gold pages (query_id, page_id)."""
    wanted = gold.distinct()
    size = wanted.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = ranked.join(wanted, ["query_id", "page_id"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.sum((F.col("rank") <= recall_at).cast("int")).alias("found"))
    got = size.join(hits, "query_id", "left")
    return got.select(
        "query_id", F.least(F.lit(1.0), F.coalesce("found", F.lit(0)) / F.col("n_gold")).alias("recall"),
        F.when(F.col("first") <= mrr_at, 1 / F.col("first")).otherwise(0.0).alias("reciprocal_rank"), (F.coalesce("first", F.lit(1 << 30)) <= hit_at).cast("int").alias("hit"),
    )


def nearest_rank(df: DataFrame, key: str, value: str, percents: list[int]) -> DataFrame:
    """(key, percent, value) at position round(percent / 100 * (n - 1)), halves to even; nulls and NaN are left out.

    Equal values are counted first. The rest are cut into ``CELLS`` cells by a sketch of
    their quantiles, so cells hold alike many whatever the distribution; only those with a
    wanted position are ordered, and no group has to fit into one task.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(key, F.col(value).cast("double").alias("v"))
    tally = rows.groupBy(key, "v").agg(F.count("*").alias("c"))
    borders = tally.groupBy(key).agg(F.percentile_approx("v", [i / CELLS for i in range(1, CELLS)], 10000).alias("borders"), F.sum("c").alias("n"))
    celled = tally.join(borders, key).select(key, "v", "c", F.size(F.filter("borders", lambda b: b < F.col("v"))).alias("cell"))
    before = Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = celled.groupBy(key, "cell").agg(F.sum("c").alias("c")).withColumn("skip", F.coalesce(F.sum("c").over(before), F.lit(0)))
    wanted = borders.select(key, "n", F.explode(F.array(*map(F.lit, percents))).alias("percent")).select(key, "percent", F.bround(F.col("percent") / 100 * (F.col("n") - 1)).cast("long").alias("position"))
    spots = wanted.join(counts, key).where("position >= skip and position < skip + c").select(key, "percent", "cell", (F.col("position") - F.col("skip")).alias("nth"))
    by = Window.partitionBy(key, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    inner = celled.join(spots.select(key, "cell").distinct(), [key, "cell"], "left_semi").withColumn("from", F.coalesce(F.sum("c").over(by), F.lit(0)))
    return spots.join(inner, [key, "cell"]).where("nth >= from and nth < from + c").select(key, "percent", F.col("v").alias("value"))


def evidence_recall(contexts: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, recall) of contexts (query_id, context): the share of the query's facts (query_id, fact) that stand in it; 1 without facts, blank facts count as none."""
    real = facts.where("fact is not null and fact != ''").distinct()
    found = real.join(contexts, "query_id", "left").groupBy("query_id").agg(F.avg(F.coalesce(F.col("context").contains(F.col("fact")), F.lit(False)).cast("int")).alias("recall"))
    return contexts.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def page_hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, rank, hit) of ranked pages (query_id, page_id, rank): whether one of the query's gold names (query_id, name) is part of the page id, letter case and kind of slash aside."""
    low = F.lower(F.translate("page_id", "\\", "/"))
    names = gold.where("name is not null").select("query_id", F.lower("name").alias("name")).distinct().groupBy("query_id").agg(F.collect_list("name").alias("names"))  # of one query
    return ranked.join(names, "query_id").select("query_id", "rank", F.exists("names", lambda n: low.contains(n)).alias("hit"))


def bundle_counters(bundles: DataFrame) -> DataFrame:
    """One row over bundles (token_count, base_tokens, planned_tokens, effective_tokens, hard_max, violations, unsupported): overflows, violations, graph items without evidence, and how budgets grew."""
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return bundles.agg(
        n(F.col("token_count") > F.col("effective_tokens")).alias("overflow"), n(F.size("violations") > 0).alias("budget_violations"), F.coalesce(F.sum("unsupported"), F.lit(0)).alias("unsupported"),
        n(F.col("effective_tokens") > F.col("base_tokens")).alias("expanded"), F.max("effective_tokens").alias("max_effective"),
    )


def summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, median, least) of the values that are not null; the median is the middle value or the mean of both."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(key, F.col(value).cast("double").alias("v"))
    flat = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"))
    tally = rows.groupBy(key, "v").agg(F.count("*").alias("c"))
    borders = tally.groupBy(key).agg(F.percentile_approx("v", [i / CELLS for i in range(1, CELLS)], 10000).alias("borders"))
    celled = tally.join(borders, key).select(key, "v", "c", F.size(F.filter("borders", lambda b: b < F.col("v"))).alias("cell"))
    across = Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offset = celled.groupBy(key, "cell").agg(F.sum("c").alias("t")).withColumn("skip", F.coalesce(F.sum("t").over(across), F.lit(0))).drop("t")
    inside = Window.partitionBy(key, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = celled.join(offset, [key, "cell"]).withColumn("from", F.col("skip") + F.coalesce(F.sum("c").over(inside), F.lit(0))).join(flat.select(key, "n"), key)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = placed.where((F.col("from") <= high) & (F.col("from") + F.col("c") > low)).groupBy(key).agg(((F.min("v") + F.max("v")) / 2).alias("median"))
    return flat.join(middle, key).select(key, "n", "mean", "median", "least")


def gate(now: dict[str, float], base: dict[str, float], drop: float = 0.02, schemas: tuple[int, int] | None = None, force: bool = False) -> list[str]:
    """Reasons to fail: a metric more than ``drop`` below its base, a counter above 0, approximate recall below 0.98, a graph query without validated result, or chunk schemas (own, base) that differ unless ``force``."""
    if schemas and schemas[0] != schemas[1] and not force:
        return [f"chunk schema {schemas[0]} is not the baseline's {schemas[1]}"]
    rates = ("page_recall", "evidence_recall", "hit", "mrr", "ann_recall")
    out = [f"{m} fell from {base[m]} to {now[m]}" for m in rates if m in base and m in now and base[m] - now[m] > drop]
    out += [f"{m} is {now[m]}" for m in ("overflow", "budget_violations", "unsupported") if now.get(m, 0) > 0]
    if "graph_triggers" in now and min(now["graph_triggers"], now.get("graph_validated", 0)) <= 0:
        out.append("no graph query gave a validated result")
    return out + (["ann_recall below 0.98"] if now.get("ann_recall", 1.0) < 0.98 else [])

"""One ranking from several differently scaled scores.

Each method's values are standardised inside their query with the median and the median
absolute deviation, squashed by the logistic function and combined by a weighted
geometric mean, so no method outweighs another through its range. The page that leads its
query in most methods is looked for at the top of that ranking and checked against every
other page; only where it fails are the other pages tried in the order of the ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamweave.operators.stage import newest, stage
from loamweave.sources.tables import table

METHODS = ("bm25", "fused", "vector", "graph")
VALUES = tuple(f"v_{m}" for m in METHODS)
#: Bounded value of a page without a counted row in a method.
ABSENT = 1e-3
#: Bound of a standardised value, which outliers come near to without ever tying.
REACH = 6.0
#: Pages in one task's fold of the pairwise check.
FOLD = 512


def counted_values(retrieved: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, page_id, retrieval_method, value) of the newest row of each key; greater is better.

    bm25 and fused: score. vector: minus distance, or the score where no counted vector
    row of the query has a distance. graph: greatest weight of an edge between seed and
    page, in either direction. Rows without a value, with NaN, or of an unknown or null
    method, query or page are not counted.
    """
    rows = newest(
        retrieved.where("query_id is not null and page_id is not null").where(F.col("retrieval_method").isin(*METHODS)),
        ["query_id", "page_id", "retrieval_method"], "retrieved_at",
        ["query_id", "page_id", "retrieval_method", "retrieved_at", "score", "distance", "seed_page_id"],
    ).select(
        "query_id", "page_id", "retrieval_method", "seed_page_id",
        F.nanvl("score", F.lit(None).cast("double")).alias("score"), F.nanvl("distance", F.lit(None).cast("double")).alias("distance"),
    )
    plain = rows.where("retrieval_method in ('bm25', 'fused')").select("query_id", "page_id", "retrieval_method", F.col("score").alias("value"))
    vector = rows.where("retrieval_method = 'vector'")
    ranged = vector.groupBy("query_id").agg(F.count("distance").alias("n_distances"))
    vector = vector.join(ranged, "query_id").select(
        "query_id", "page_id", "retrieval_method", F.when(F.col("n_distances") > 0, -F.col("distance")).otherwise(F.col("score")).alias("value")
    )
    ends = edges.where("weight is not null and not isnan(weight)")
    ends = ends.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight")
    pairs = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("value"))
    graph = rows.where("retrieval_method = 'graph'").withColumns(
        {"a": F.least("seed_page_id", "page_id"), "b": F.greatest("seed_page_id", "page_id")}
    ).where("seed_page_id is not null").join(pairs, ["a", "b"]).select("query_id", "page_id", "retrieval_method", "value")
    return plain.unionByName(vector).unionByName(graph).where("value is not null")


def _pages(values: DataFrame) -> DataFrame:
    """(query_id, page_id, one value a method): a row a page."""
    of = lambda m: F.max(F.when(F.col("retrieval_method") == m, F.col("value"))).alias(f"v_{m}")
    return values.groupBy("query_id", "page_id").agg(*(of(m) for m in METHODS))


def _bounded(pages: DataFrame) -> DataFrame:
    """Adds ``b_`` columns in (0, 1) and n_pages to ``_pages``: the logistic of 0.6745 (value - median) / MAD of query and method, bent so that outliers approach ``REACH`` and never tie.

    Two aggregations by query serve all methods. Where half of the values are equal (MAD
    0), 1.2533 times the mean absolute deviation takes its place. Medians are exact up to
    10,000 pages a query and method, beyond within 1/10,000 of the ranks, so their state
    is bounded however many pages a query has.
    """
    middle = lambda c: F.percentile_approx(c, 0.5, 10000)
    centre = pages.groupBy("query_id").agg(F.count("*").alias("n_pages"), *(middle(f"v_{m}").alias(f"c_{m}") for m in METHODS))
    apart = lambda m: F.abs(F.col(f"v_{m}") - F.col(f"c_{m}"))
    centred = pages.join(centre, "query_id")
    spread = centred.groupBy("query_id").agg(*(middle(apart(m)).alias(f"d_{m}") for m in METHODS), *(F.avg(apart(m)).alias(f"a_{m}") for m in METHODS))

    def squashed(m: str) -> Column:
        scale = F.when(F.col(f"d_{m}") > 0, F.col(f"d_{m}") / 0.6745).otherwise(1.2533 * F.col(f"a_{m}"))
        z = F.when(scale > 0, (F.col(f"v_{m}") - F.col(f"c_{m}")) / scale).otherwise(F.when(F.col(f"v_{m}").isNotNull(), 0.0))
        return (1 / (1 + F.exp(-z / (1 + F.abs(z) / REACH)))).alias(f"b_{m}")

    return centred.join(spread, "query_id").select("query_id", "page_id", *VALUES, "n_pages", *map(squashed, METHODS), *(F.col(f"c_{m}").isNotNull().alias(f"u_{m}") for m in METHODS))


def bounded_scores(values: DataFrame) -> DataFrame:
    """(query_id, retrieval_method, page_id, value, bounded) of counted values."""
    rows = _bounded(_pages(values))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("retrieval_method"), F.col(f"v_{m}").alias("value"), F.col(f"b_{m}").alias("bounded")) for m in METHODS)))
    return rows.select("query_id", "page_id", each.alias("x")).select("query_id", "x.retrieval_method", "page_id", "x.value", "x.bounded").where("value is not null")


def fuse(retrieved: DataFrame, edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, page_id, one value a method, fused, n_pages): the weighted geometric mean over the query's methods.

    A page without a counted row in a method used by its query gets ``ABSENT`` there;
    a method no page of the query is counted in does not take part.
    """
    weights = {m: 1.0 for m in METHODS} | (weights or {})
    rows = _bounded(stage(_pages(counted_values(retrieved, edges))))
    share = lambda m, x: F.when(F.col(f"u_{m}"), x).otherwise(F.lit(0.0))
    logs = sum((share(m, weights[m] * F.log(F.coalesce(f"b_{m}", F.lit(ABSENT)))) for m in METHODS), F.lit(0.0))
    total = sum((share(m, F.lit(float(weights[m]))) for m in METHODS), F.lit(0.0))
    return rows.select("query_id", "page_id", *VALUES, F.exp(logs / total).alias("fused"), "n_pages")


def _lead(a: Column, b: Column) -> Column:
    """In how many more methods page struct ``a`` is ahead of ``b`` than behind."""
    low = F.lit(float("-inf"))
    one = lambda m: F.signum(F.when(F.coalesce(a[m], low) > F.coalesce(b[m], low), 1).when(F.coalesce(a[m], low) < F.coalesce(b[m], low), -1).otherwise(0))
    return sum((one(m) for m in VALUES[1:]), one(VALUES[0]))


def _champions(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One page struct a group, by a knock-out in the order of the fused score.

    Whoever is ahead of every other page of its query wins any knock-out it is in.
    """
    ordered = F.sort_array(F.collect_list("page"), asc=False)
    knock_out = F.reduce(F.slice("row", 2, F.greatest(F.size("row") - 1, F.lit(1))), F.element_at("row", 1), lambda best, x: F.when(_lead(x, best) > 0, x).otherwise(best))
    return pages.groupBy(*keys).agg(ordered.alias("row")).select(*keys, knock_out.alias("page"))


def _held(pages: DataFrame, best: DataFrame) -> DataFrame:
    """(query_id, best, holds): whether the page struct ``best`` of a query is ahead of each other page."""
    behind = (F.col("page.page_id") != F.col("best.page_id")) & (_lead(F.col("best"), F.col("page")) <= 0)
    return pages.join(best, "query_id").groupBy("query_id").agg(F.first("best").alias("best"), (F.max(behind.cast("int")) == 0).alias("holds"))


def leaders(fused: DataFrame) -> DataFrame:
    """(query_id, page_id, fused_first): the page of each query that against every other one is ahead in more methods than behind.

    The first page of the fused ranking is checked against all pages of its query. Where it
    does not hold, a knock-out in the order of the ranking, in groups of about ``FOLD``
    pages and then of the groups' winners, leaves the one page that may, and it is checked
    in the same way. Queries with no such page give no row; fused_first tells where the
    ranking's first page was it.
    """
    page = F.struct(F.col("fused"), F.col("page_id"), *(F.col(m) for m in VALUES)).alias("page")
    pages = stage(fused.select("query_id", "n_pages", page))
    top = stage(_held(pages, pages.groupBy("query_id").agg(F.max("page").alias("best"))))
    left = pages.join(top.where("not holds").select("query_id"), "query_id", "left_semi")
    part = F.pmod(F.xxhash64("page.page_id"), F.ceil(F.col("n_pages") / FOLD)).alias("part")
    first = _champions(left.select("query_id", part, "page"), ["query_id", "part"])
    other = _held(left, _champions(first.select("query_id", "page"), ["query_id"]).withColumnRenamed("page", "best"))
    both = top.withColumn("fused_first", F.lit(True)).unionByName(other.withColumn("fused_first", F.lit(False)))
    return both.where("holds").select("query_id", F.col("best.page_id").alias("page_id"), "fused_first")


def _leaders(spark: SparkSession, folder: str) -> DataFrame:
    return leaders(fuse(table(spark, folder, "retrieved_pages"), table(spark, folder, "graph_edges")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaders(spark, folder).select("query_id", "page_id")


def p3_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """The leaders of p3_found, and whether the fused ranking had each of them first."""
    return _leaders(spark, folder)


def p3_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Every counted page of each query with its fused score."""
    fused = fuse(table(spark, folder, "retrieved_pages"), table(spark, folder, "graph_edges"))
    return fused.select("query_id", "page_id", F.round("fused", 6).alias("fused"))

"""Filling containers of fixed capacity with whole texts.

The plan is made on the counts of each size, of which there are at most as many as the
capacity is large, whatever the number of texts: a container's gap is closed exactly by
one, two or three sizes found by exact complements (a size, a pair sum or a triple sum
equal to the gap), as often as the counts allow; where none fits exactly, the largest
size that fits goes in and the search is repeated, which ends as best-fit for the rest.
A plan row covers a range of texts of one size. Ranges and texts meet in cells of
``CELL`` ordinals, in each of which a text takes the range that starts last before it, so
no text is multiplied and nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.llm.sizes import token_size
from loamweave.operators.stage import bucket_count, running_total, stage
from loamweave.sources.tables import table

#: Ordinals of one size in one task.
CELL = 8192


def _pair(count: np.ndarray, total: int) -> list[int] | None:
    """Two available sizes whose sum is ``total``."""
    half = np.arange(1, total // 2 + 1)
    both = half[(count[half] > 0) & (count[total - half] > (half * 2 == total))]
    return [int(total - both[0]), int(both[0])] if len(both) else None


class _Sums:
    """Index of the pair sums of the available sizes; it may still hold sums of sizes used up since."""

    def __init__(self, count: np.ndarray) -> None:
        self.renew(count)

    def renew(self, count: np.ndarray) -> None:
        there = count > 0
        self.known = int(there.sum())
        n = 1 << (2 * len(count) - 3).bit_length()
        wave = np.fft.rfft(there.astype(float), n)
        self.pairs = np.fft.irfft(wave * wave, n)[: len(count)] > 0.5

    def complement(self, count: np.ndarray, gap: int) -> list[int] | None:
        """One, two or three available sizes whose sum is ``gap``."""
        if count[gap]:
            return [gap]
        if self.pairs[gap] and (pair := _pair(count, gap)):
            return pair
        sizes = np.arange(1, gap - 1)
        for tries, a in enumerate(sizes[(count[sizes] > 0) & self.pairs[gap - sizes]][::-1]):
            if tries == 8 and np.count_nonzero(count) < 0.9 * self.known:
                self.renew(count)
            if self.pairs[gap - int(a)]:
                count[a] -= 1
                pair = _pair(count, gap - int(a))
                count[a] += 1
                if pair:
                    return [int(a), *pair]
        return None


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, first, last, each, container): the texts of a size with ordinals first..last go ``each`` to a container, from ``container`` on.

    Every text of ``counts`` is placed once; no container exceeds the capacity.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        count[size] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    plan, container = [], 0
    sums = _Sums(count)
    top = capacity
    while True:
        while top and not count[top]:
            top -= 1
        if not top:
            return plan
        take: dict[int, int] = {top: 1}
        count[top] -= 1
        gap = capacity - top
        while gap > 0:
            exact = sums.complement(count, gap)
            fits = np.flatnonzero(count[: gap + 1])
            if exact is None and not len(fits):
                break
            for size in exact or [int(fits[-1])]:
                take[size] = take.get(size, 0) + 1
                count[size] -= 1
                gap -= size
        for size, k in take.items():
            count[size] += k
        times = min(int(count[size]) // k for size, k in take.items())
        for size, k in take.items():
            plan.append((size, int(used[size]), int(used[size]) + times * k - 1, k, container))
            used[size] += times * k
            count[size] -= times * k
        container += times


def pack(texts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, capacity, id, piece_no, piece_size, oversized, container) of every text and profile.

    texts: (id, size); a null size is not packed. A text over the capacity is the only
    kind that is cut: into full containers of its own and a rest that is packed like any
    text. Profiles with a null or non-positive capacity are left out; a profile named
    twice counts once, with its greatest capacity.
    """
    spark = texts.sparkSession
    texts = texts.where("size is not null and id is not null").select("id", "size")
    caps = {r[0]: int(r[1]) for r in profiles.where("capacity_tokens > 0").groupBy("profile").agg(F.max("capacity_tokens")).collect()}
    if not caps:
        return spark.createDataFrame([], "profile string, capacity bigint, id bigint, piece_no bigint, piece_size bigint, oversized boolean, container string")
    options = F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(c).cast("long").alias("capacity")) for p, c in sorted(caps.items())))
    sizes = stage(texts.select("*", F.explode(options).alias("o")).select("id", "size", "o.profile", "o.capacity"))
    rest = sizes.where("size % capacity > 0").select("profile", "capacity", "id", (F.col("size") % F.col("capacity")).alias("piece_size"), F.floor(F.col("size") / F.col("capacity")).alias("piece_no"))
    rows = []
    per: dict[str, dict[int, int]] = {p: {} for p in caps}
    for p, s, n in rest.groupBy("profile", "piece_size").count().collect():  # at most capacity rows a profile
        per[p][s] = n
    for p, counts in per.items():
        rows += [(p, *r) for r in plan_containers(counts, caps[p])]
    total = max((sum(c.values()) for c in per.values()), default=0)
    plan = spark.createDataFrame(rows, "profile string, piece_size bigint, first bigint, last bigint, each bigint, start bigint")
    cells = F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor(F.col("last") / CELL)))
    ranges = plan.select("profile", "piece_size", cells.alias("cell"), F.struct("first", "each", "start").alias("range")).withColumn("ordinal", F.greatest(F.col("range.first"), F.col("cell") * CELL))
    numbered = running_total(rest, ["profile", "piece_size"], ["id"], F.lit(1), "ordinal", bucket_count(total)).withColumn("cell", F.floor(F.col("ordinal") / CELL))
    by = Window.partitionBy("profile", "piece_size", "cell").orderBy("ordinal", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = numbered.unionByName(ranges, allowMissingColumns=True).withColumn("range", F.last("range", ignorenulls=True).over(by)).where("id is not null")
    placed = met.select(
        "profile", "capacity", "id", "piece_no", "piece_size", (F.col("piece_no") > 0).alias("oversized"),
        F.concat(F.lit("c"), F.col("range.start") + F.floor((F.col("ordinal") - F.col("range.first")) / F.col("range.each"))).alias("container"),
    )
    full = sizes.where("size >= capacity").select(
        "profile", "capacity", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / F.col("capacity")) - 1)).alias("piece_no"),
        F.col("capacity").alias("piece_size"), (F.col("size") > F.col("capacity")).alias("oversized"),
    ).withColumn("container", F.concat_ws("_", F.lit("f"), F.col("id"), F.col("piece_no")))
    return placed.unionByName(full)


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), token_size(F.col("text")).alias("size"))
    return pack(texts, table(spark, folder, "pack_profiles"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that alone exceed a profile's capacity: those the packing had to cut."""
    return _packed(spark, folder).where("oversized").select("profile", F.col("id").alias("doc_id")).distinct()


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and fill rate of each profile."""
    boxes = _packed(spark, folder).groupBy("profile", "capacity", "container").agg(F.sum("piece_size").alias("filled"))
    return boxes.groupBy("profile", "capacity").agg(
        F.count("*").alias("containers"), F.max("filled").alias("fullest"),
        F.round(F.sum("filled") / (F.count("*") * F.first("capacity")), 6).alias("fill_rate"),
    )


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p8_proof(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for the containers of each profile: texts and tokens packed, texts whose pieces do not add up to their size or are packed twice, containers over the capacity, and whether no more than 1 % (and one) container above the least possible number is used."""
    sizes = table(spark, folder, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), token_size(F.col("text")).alias("size")).where("size is not null")
    packed = stage(_packed(spark, folder))
    texts = packed.groupBy("profile", "id").agg(F.sum("piece_size").alias("packed"), F.count("*").alias("pieces"), F.max("piece_no").alias("last"))
    per = texts.join(sizes, "id", "left").groupBy("profile").agg(
        F.count("*").alias("n_texts"), F.sum("packed").alias("n_tokens"), F.sum((~F.col("packed").eqNullSafe(F.col("size")) | (F.col("last") != F.col("pieces") - 1)).cast("int")).alias("wrong_texts"),
    )
    boxes = packed.groupBy("profile", "capacity", "container").agg(F.sum("piece_size").alias("filled")).groupBy("profile", "capacity").agg(
        F.count("*").alias("n_boxes"), F.sum((F.col("filled") > F.col("capacity")).cast("int")).alias("over_capacity"), F.sum("filled").alias("filled"),
    )
    least = F.ceil(F.col("filled") / F.col("capacity"))
    return per.join(boxes, "profile").select("profile", "n_texts", "n_tokens", "wrong_texts", "over_capacity", (F.col("n_boxes") <= 1.01 * least + 1).alias("tight"))

"""Mixing sources to target weights.

Each source of a mix delivers blocks of a fixed number of tokens. Its weight gives block
j the release time floor(j / w) and the deadline ceil((j + 1) / w); of the released
blocks the one with the earliest deadline comes next (Pfair). Weights are exact
fractions, so the schedule repeats after their common denominator; one period is laid
out on the driver and every block finds its place by arithmetic. At any slot a source is
less than one block away from its share, until it runs out of repeats. Documents are not
cut: one belongs to the block it starts in, so in tokens a source is less than one block
behind and less than one block and its longest document ahead.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamweave.llm.sizes import source_name, token_size
from loamweave.operators.stage import bucket_count, ordered_total, running_total, stage
from loamweave.sources.tables import table

#: Slots of a period, at most; only weights without a common denominator up to it are rounded, by less than 1/SLOTS.
SLOTS = 1_000_000
BLOCK_TOKENS = 4096


def pfair_period(weights: dict[str, float], most: int = SLOTS) -> dict[str, list[int]]:
    """Slots of one period for each source: as many as the weights' least common denominator.

    Weights whose denominator would exceed ``most`` are rounded to 1/most by largest
    remainder. A positive weight has one slot at least. No positive weight, no slots.
    """
    parts = {s: Fraction(max(0.0, w)).limit_denominator(most) for s, w in weights.items()}
    parts = {s: p or Fraction(weights[s] > 0, most) for s, p in parts.items()}
    total = sum(parts.values())
    if total <= 0:
        return {s: [] for s in weights}
    slots = max(len(weights), min(most, math.lcm(*((p / total).denominator for p in parts.values()))))
    exact = {s: p / total * slots for s, p in parts.items()}
    n = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (n[s] - exact[s], s))[: slots - sum(n.values())]:
        n[s] += 1
    for s in exact:
        if exact[s] > 0 and not n[s]:
            n[s] = 1
            n[max(n, key=lambda o: (n[o], o))] -= 1
    out: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s, 0) for s in sorted(n) if n[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * slots // n[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out[s].append(slot)
        if j + 1 < n[s]:
            heapq.heappush(waiting, ((j + 1) * slots // n[s], s, j + 1))
    return out


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: tokens available, wanted and allowed. One row a target row.

    targets with a null mix or source are left out, a null share counts as 0, null
    repeats as 1. A source without documents has 0 tokens.
    """
    wanted = targets.where("mix is not null").select(
        "mix", source_name(F.col("source")).alias("source"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats"),
    ).where("source is not null").groupBy("mix", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("size").alias("tokens"))
    plan = wanted.join(have, "source", "left").fillna(0, ["tokens"])
    total = plan.groupBy("mix").agg(F.sum("tokens").alias("total_tokens"))
    return plan.join(total, "mix").withColumns({
        "wanted_tokens": F.col("target_share") * F.col("total_tokens"), "allowed_tokens": F.col("max_repeats") * F.col("tokens"),
    })


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixed order: (mix, source, id, copy_no, size, block_no, slot, wanted_tokens, ...).

    documents: (id, source, size); rows without source or size belong to no mix. A
    source's documents are repeated as a whole, copy after copy, until its wanted tokens
    are reached (by at most one document more) or its repeats are used up.
    """
    named = targets.select(source_name(F.col("source")).alias("source")).where("source is not null").distinct()
    sizes = stage(documents.where("size is not null").select("id", source_name(F.col("source")).alias("source"), "size").join(named, "source", "left_semi"))
    plan = [r.asDict() for r in mix_plan(sizes, targets).collect()]  # a row for each target
    slots: list[tuple[str, str, int, int, int]] = []
    for name in {r["mix"] for r in plan}:
        period = pfair_period({r["source"]: float(r["target_share"]) for r in plan if r["mix"] == name})
        length = sum(map(len, period.values()))
        slots += [(name, s, len(at), length, slot) for s, at in period.items() for slot in at]
    spark = documents.sparkSession
    planned = spark.createDataFrame(
        [(r["mix"], r["source"], r["target_share"], r["max_repeats"], r["tokens"], r["wanted_tokens"], r["allowed_tokens"]) for r in plan],
        "mix string, source string, target_share double, max_repeats bigint, tokens bigint, wanted_tokens double, allowed_tokens bigint",
    )
    places = spark.createDataFrame(slots, "mix string, source string, per_period bigint, period bigint, place bigint")
    rows = max(1, sizes.count())
    placed = running_total(sizes, ["source"], ["id"], F.col("size"), "before", bucket_count(rows))
    copies = (
        placed.join(F.broadcast(planned), "source")  # a row for each target
        .withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("max_repeats"), F.ceil(F.col("wanted_tokens") / F.greatest("tokens", F.lit(1)))).cast("long"))))
        .withColumn("position", F.col("copy_no") * F.col("tokens") + F.col("before"))
        .where("copy_no < max_repeats and position < wanted_tokens")
        .withColumn("block_no", F.floor(F.col("position") / block_tokens))
    )
    periods = F.broadcast(places.groupBy("mix", "source").agg(F.first("per_period").alias("per_period"), F.first("period").alias("period"), F.sort_array(F.collect_list("place")).alias("at")))  # a period of slots a mix
    return copies.join(periods, ["mix", "source"]).select(
        "mix", "source", "id", "copy_no", "size", "block_no",
        (F.floor(F.col("block_no") / F.col("per_period")) * F.col("period") + F.element_at("at", (F.col("block_no") % F.col("per_period") + 1).cast("int"))).alias("slot"),
        "target_share", "max_repeats", "wanted_tokens", "allowed_tokens", (F.col("per_period") / F.col("period")).alias("slot_share"),
    )


def reached_shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and reached tokens and shares of every source of every mix; ``short``: its repeats did not suffice."""
    reached = mixed.groupBy("mix", "source").agg(F.sum("size").alias("placed_tokens"), (F.max("copy_no") + 1).alias("copies"))
    both = plan.join(reached, ["mix", "source"], "left").fillna(0, ["placed_tokens", "copies"])
    totals = both.groupBy("mix").agg(F.sum("placed_tokens").alias("mixed_tokens"))
    return both.join(totals, "mix").withColumns({
        "reached_share": F.when(F.col("mixed_tokens") > 0, F.col("placed_tokens") / F.col("mixed_tokens")).otherwise(0.0),
        "short": F.col("placed_tokens") < F.col("wanted_tokens"),
    })


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = stage(table(spark, folder, "documents", "doc_id", "source", "text").select(F.col("doc_id").alias("id"), "source", token_size(F.col("text")).alias("size")))
    targets = table(spark, folder, "mix_targets")
    return mix(docs, targets), mix_plan(docs.where("size is not null").withColumn("source", source_name(F.col("source"))), targets)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of a mix that fall short of their share though repeated as often as allowed."""
    mixed, plan = _mixed(spark, folder)
    return reached_shares(mixed, plan).where("short and placed_tokens >= allowed_tokens").select("mix", "source")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    mixed, plan = _mixed(spark, folder)
    return reached_shares(mixed, plan).select(
        "mix", "source", F.round("target_share", 6).alias("target_share"), "placed_tokens", "copies", F.round("reached_share", 6).alias("reached_share"), "short"
    )


def p9_order(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0].select("mix", "slot", "source", "block_no", "id", "copy_no", "size")


def deviations(mixed: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(mix, source, ahead, behind, longest) of a mixed order: the most tokens by which a source was ahead of and behind its share after any slot before its end, and its longest document.

    Between a source's own slots it only falls behind evenly, so it is measured right
    before and after each of them.
    """
    per = mixed.groupBy("mix", "source", "slot").agg(F.sum("size").alias("tokens"), F.max("size").alias("longest"), F.first("slot_share").alias("share"))
    summed = ordered_total(per, ["mix", "source"], "slot", F.col("tokens"), "before")
    ahead = F.col("before") + F.col("tokens") - F.col("share") * (F.col("slot") + 1) * block_tokens
    behind = F.col("share") * F.col("slot") * block_tokens - F.col("before")
    return summed.groupBy("mix", "source").agg(F.max(ahead).alias("ahead"), F.max(behind).alias("behind"), F.max("longest").alias("longest"))


def p9_deviation(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source stays, in the tokens of the order, less than one block behind and less than one block and one document ahead of its share."""
    got = deviations(_mixed(spark, folder)[0])
    return got.select("mix", "source", ((F.col("behind") < BLOCK_TOKENS) & (F.col("ahead") < BLOCK_TOKENS + F.col("longest"))).alias("within"))

"""Page graph: signals, scores, expansion, components, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.functions.keys import edge_ends
from loamweave.operators.stage import stage

#: Weights of the signals.
LINK, OVERLAP, ADAMIC_ADAR, AFFINITY = 1.0, 0.6, 0.4, 0.3
PER_NODE = 5
#: Rows of one key that meet in one task.
BLOCK = 2048


def within(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, l, r): rows of one key met with one another, each two once, the one with the lesser ``name`` as struct l.

    The rows of a key are cut into hash blocks of about ``BLOCK`` rows and blocks meet in
    pairs, so a key with a third of all rows is spread over as many tasks as it has pairs
    of blocks.
    """
    whole = F.struct(*[c for c in rows.columns if c != key])
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    cut = rows.select(key, whole.alias("x"), F.col(name).alias("_id")).join(sizes, key).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    left = cut.select(key, F.col("_own").alias("_a"), F.col("_other").alias("_b"), F.col("x").alias("l"))
    right = cut.select(key, F.col("_other").alias("_a"), F.col("_own").alias("_b"), F.col("x").alias("r"))
    return left.join(right, [key, "_a", "_b"]).where(F.col(f"l.{name}") < F.col(f"r.{name}")).select(key, "l", "r")


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_id, target_id, n) of links (page_id, target) to pages (page_id, title, stem): by title, else by file stem.

    Of pages that share a name the greatest page_id counts. Unresolved links, links of a
    page to itself and null targets are left out.
    """
    name = lambda c, out: pages.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("target")).agg(F.max("page_id").alias(out))
    hit = links.where("target is not null").join(name("title", "by_title"), "target", "left").join(name("stem", "by_stem"), "target", "left")
    hit = hit.select(F.col("page_id").alias("source_id"), F.coalesce("by_title", "by_stem").alias("target_id"))
    return hit.where("target_id is not null and target_id != source_id").groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


def overlap(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v, shared, jaccard) of pages (page_id, sources) with a common source, between representatives of equal source sets, and (page_id, class_id).

    Null and empty sets are in no class. Pages with the same set are one node, so copies
    do not multiply pairs.
    """
    sets = pages.select("page_id", F.array_sort(F.array_distinct(F.filter("sources", lambda s: s.isNotNull()))).alias("sources")).where(F.size("sources") > 0)
    classes = sets.groupBy("sources").agg(F.min("page_id").alias("class_id"))
    members = sets.join(classes, "sources").select("page_id", "class_id")
    flat = classes.select(F.col("class_id").alias("id"), F.size("sources").alias("n"), F.explode("sources").alias("source"))
    met = within(flat, "source", "id").select(F.col("l.id").alias("u"), F.col("l.n").alias("nu"), F.col("r.id").alias("v"), F.col("r.n").alias("nv"))
    pairs = met.groupBy("u", "v", "nu", "nv").agg(F.count("*").alias("shared"))
    return pairs.select("u", "v", "shared", (F.col("shared") / (F.col("nu") + F.col("nv") - F.col("shared"))).alias("jaccard")), members


def page_overlap(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v, jaccard) of all pages with a common source, from both results of ``overlap``: the pairs of two classes for each two of their members, and 1 inside a class."""
    of = lambda key, out: members.select(F.col("class_id").alias(key), F.col("page_id").alias(out))
    between = pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select(*edge_ends(F.col("a"), F.col("b")), "jaccard")
    inside = of("class_id", "u").join(of("class_id", "v"), "class_id").where("u < v").select("u", "v", F.lit(1.0).alias("jaccard"))
    return between.unionByName(inside)


def undirected(edges: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """Distinct pairs (u < v); loops and null ends are left out."""
    return edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*edge_ends(F.col(a), F.col(b))).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(pairs.select(F.col("v").alias("a"), F.col("u").alias("b")))


def degrees(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def adamic_adar(pairs: DataFrame) -> DataFrame:
    """(u, v, score): sum of 1 / ln(degree) over common neighbours of pairs without an edge."""
    ways = both_ways(pairs)
    hubs = degrees(pairs).where("degree > 1").select(F.col("node").alias("mid"), (1 / F.log("degree")).alias("weight"))
    arms = ways.join(hubs, ways.b == hubs.mid).select("mid", "a", "weight")
    wedges = within(arms, "mid", "a").select(F.col("l.a").alias("u"), F.col("r.a").alias("v"), "l.weight").groupBy("u", "v").agg(F.sum("weight").alias("score"))
    return wedges.join(pairs, ["u", "v"], "left_anti")


def greedy_cap(scored: DataFrame, per_node: int = PER_NODE) -> DataFrame:
    """Pairs kept by going through them by falling score and dropping a pair only if both its ends are full.

    Exact and without a global order: the first ``per_node`` pairs of a node find room at
    it and are kept, so it is full for all later ones. A pair is kept if it is among the
    first of one end at least.
    """
    order = Window.partitionBy("_end").orderBy(F.round("score", 9).desc(), "u", "v")
    first = scored.withColumn("_end", F.explode(F.array("u", "v"))).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_node)
    return first.drop("_end", "_place").dropDuplicates(["u", "v"])


def build(links: DataFrame, pairs: DataFrame, types: DataFrame) -> DataFrame:
    """(u, v, weight, signals) from link counts, overlap pairs and page types (page_id, page_type).

    weight: 1 a link, 0.6 times the Jaccard index, 0.4 times the score of an Adamic-Adar
    pair that the cap keeps, and 0.3 on all those edges for pages of one type.
    """
    direct = links.select(*edge_ends(F.col("source_id"), F.col("target_id")), (LINK * F.col("n")).alias("weight"), F.lit("direct_link").alias("signal"))
    shared = pairs.select("u", "v", (OVERLAP * F.col("jaccard")).alias("weight"), F.lit("source_overlap").alias("signal"))
    stated = stage(direct.unionByName(shared).groupBy("u", "v").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("signal")).alias("signals")))
    near = greedy_cap(adamic_adar(stated.select("u", "v")))
    base = stated.unionByName(near.select("u", "v", (ADAMIC_ADAR * F.col("score")).alias("weight"), F.array(F.lit("adamic_adar")).alias("signals")))
    kind = lambda n: types.groupBy(F.col("page_id").alias(n)).agg(F.max("page_type").alias(f"type_{n}"))
    typed = base.join(kind("u"), "u", "left").join(kind("v"), "v", "left")
    same = F.coalesce(F.col("type_u") == F.col("type_v"), F.lit(False))
    return typed.select(
        "u", "v", F.round(F.col("weight") + F.when(same, AFFINITY).otherwise(0.0), 4).alias("weight"),
        F.when(same, F.array_sort(F.array_append("signals", F.lit("type_affinity")))).otherwise(F.col("signals")).alias("signals"),
    )


def inferred_only(signals: Column) -> Column:
    """Whether nothing but inferred signals made an edge."""
    return (F.size(signals) > 0) & F.forall(signals, lambda s: F.lower(s).isin("adamic_adar", "type_affinity") | F.lower(s).contains("inferred"))


def expand(seeds: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, page_id, seed_id, weight, signals, place): neighbours of seeds (query_id, page_id, rank) that are not seeds themselves.

    A neighbour of several seeds comes by the best ranked one, with all signals of their
    edges; k neighbours a query, by the rank of the seed and then by page_id, or by
    edge_no where edges have one.
    """
    numbered = "edge_no" in edges.columns
    edges = edges.withColumn("edge_no", F.col("edge_no") if numbered else F.lit(0).cast("long"))
    ends = edges.select("source_id", "target_id", "weight", "edge_signals", "edge_no")
    ways = ends.toDF("a", "b", "weight", "signals", "no").unionByName(ends.select("target_id", "source_id", "weight", "edge_signals", "edge_no").toDF("a", "b", "weight", "signals", "no")).where("a != b")
    ways = ways.groupBy("a", "b").agg(F.max("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals"), F.min("no").alias("no"))  # a pair's few signals
    hops = seeds.select("query_id", F.col("page_id").alias("seed_id"), "rank").join(ways, F.col("seed_id") == ways.a)
    first = hops.groupBy("query_id", F.col("b").alias("page_id")).agg(F.min(F.struct("rank", "seed_id", "weight", "signals", "no")).alias("via"))
    new = first.join(seeds.select("query_id", "page_id"), ["query_id", "page_id"], "left_anti")
    by = Window.partitionBy("query_id").orderBy("via.rank", "via.no", "page_id")
    return new.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).select("query_id", "page_id", "via.seed_id", "via.weight", "via.signals", "place")


def validated(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Candidates with text hits (query_id, page_id, channel); those of inferred edges only need a sparse one."""
    seen = hits.groupBy("query_id", "page_id").agg(F.max((F.col("channel") == "sparse").cast("int")).alias("sparse"))
    return candidates.join(seen, ["query_id", "page_id"]).where((F.col("sparse") == 1) | ~inferred_only(F.col("signals"))).drop("sparse")


def components(pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component): the least node of each connected component, by alternating large and small stars.

    Rounds grow with the logarithm of the longest path; a graph not done after ``rounds`` raises.
    """
    edges = stage(pairs.select(F.col("v").alias("a"), F.col("u").alias("b")))
    last = None
    for _ in range(rounds):
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = stage(down.join(root, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct())
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components not found after {rounds} rounds")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _moved(ways: DataFrame, total: float, state: DataFrame, turn: int) -> DataFrame:
    """State (node, k, community) after half of the nodes, by hash, took the community of greatest gain among their neighbours' and their own, ties by the least name."""
    mass = state.groupBy("community").agg(F.sum("k").alias("mass"))
    near = ways.join(state.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("inside"))
    options = near.unionByName(state.select("node", "community", F.lit(0.0).alias("inside"))).groupBy("node", "community").agg(F.sum("inside").alias("inside"))
    own = state.select("node", "k", F.col("community").alias("now"))
    gain = F.col("inside") - F.col("k") * (F.col("mass") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0.0)) / total
    best = options.join(mass, "community").join(own, "node").groupBy("node").agg(F.min(F.struct(-F.round(gain, 9), (F.col("community") != F.col("now")), "community")).alias("best"), F.first("k").alias("k"), F.first("now").alias("now"))
    moves = F.pmod(F.xxhash64("node"), F.lit(2)) == turn
    return best.select("node", "k", F.when(moves, F.col("best.community")).otherwise(F.col("now")).alias("community"))


def _quality(ways: DataFrame, total: float, state: DataFrame) -> float:
    """Modularity of a state; ``ways`` has each edge in both directions and inner weight as loops."""
    inside = ways.join(state.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(state.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb")
    mass = state.groupBy("community").agg(F.sum("k").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("v"))
    got = inside.agg(F.sum("weight").alias("w")).crossJoin(mass).first()  # one row each
    return (got["w"] or 0.0) / total - (got["v"] or 0.0) / (total * total)


def communities(weighted: DataFrame, nodes: DataFrame | None = None, gain: float = 1e-4) -> DataFrame:
    """(node, community): deterministic multi-level modularity moves over (u, v, weight), all in joins.

    Nodes move in alternating halves by hash, so pairs do not swap for ever, until a pair
    of rounds no longer raises modularity by ``gain``; then communities become the nodes of
    the next level, until a level gains nothing. Every level only ever raises modularity.
    No component is gathered into one task. ``nodes``: (node); those without an edge are one
    last community, named by the least of them.
    """
    edges = weighted.where("weight > 0 and u != v")
    ways = stage(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "weight").unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b"), "weight")))
    total = ways.agg(F.sum("weight")).first()[0] or 1.0
    found = None
    quality = float("-inf")
    while True:
        strength = ways.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k"))
        loops = ways.where("a != b")
        state = stage(strength.select("node", "k", F.col("node").alias("community")))
        best, before = state, _quality(ways, total, state)
        started = max(before, quality)
        while True:
            state = stage(_moved(loops, total, _moved(loops, total, best, 0), 1))
            now = _quality(ways, total, state)
            if now <= before + gain:
                break
            best, before = state, now
        if found is not None and before <= started + gain:
            break
        step = best.select("node", "community")
        found = stage(step if found is None else found.withColumnRenamed("community", "middle").join(step.withColumnRenamed("node", "middle"), "middle").select("node", "community"))
        if before <= started + gain:
            break
        quality = before
        c = lambda n: step.select(F.col("node").alias(n), F.col("community").alias(f"c{n}"))
        ways = stage(ways.join(c("a"), "a").join(c("b"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")))
    if nodes is None:
        return found
    alone = nodes.select("node").distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.crossJoin(F.broadcast(alone.agg(F.min("node").alias("community")))))  # one row


def modularity(weighted: DataFrame, assigned: DataFrame) -> float:
    total = weighted.agg(F.sum("weight")).first()[0] or 1.0
    c = lambda n: assigned.select(F.col("node").alias(n), F.col("community").alias(f"c_{n}"))
    inside = weighted.join(c("u"), "u").join(c("v"), "v").where("c_u = c_v").agg(F.sum("weight")).first()[0] or 0.0
    mass = both_ways(weighted.select("u", "v")).withColumnsRenamed({"a": "node"}).join(
        weighted.select("u", "v", "weight").unionByName(weighted.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")).withColumnsRenamed({"u": "node", "v": "b"}), ["node", "b"]
    ).join(assigned, "node").groupBy("community").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return inside / total - mass / (4 * total * total)

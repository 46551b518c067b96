"""From ranked hits to a bundle of context: graph candidates, evidence, scope texts, budgets, results. Batch over queries: every table has a query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.operators import dense, fulltext, fusion, graph
from loamweave.operators.context import MODES, assemble, budget
from loamweave.operators.stage import stage
from loamweave.operators.substrings import containing

#: Hits a channel gives a page check, hits of the main search, seeds and neighbours of the expansion.
PAGE_HITS, SEARCH_HITS, SEEDS, NEIGHBOURS = 20, 80, 5, 10
SUMMARY = 200

PATHS = "array<struct<seed_id: string, weight: double, signals: array<string>, is_inferred: boolean>>"
EVIDENCE = "array<struct<rank: int, channel: string, chunk_id: string>>"


def list_ranks(hits: DataFrame, keep: str = "first") -> DataFrame:
    """(query_id, channel, chunk_id, page_id, score, rank): positions in one list a channel, whose parts follow one another by list_no, as several queries' hits do.

    hits: (query_id, channel, list_no, position, chunk_id, page_id, score). A chunk met
    in several parts stands where it is met first, with its best score; ``keep`` 'score'
    orders by score instead.
    """
    once = hits.groupBy("query_id", "channel", "chunk_id").agg(F.min(F.struct("list_no", "position")).alias("at"), F.max("score").alias("score"), F.max("page_id").alias("page_id"))
    order = [F.desc("score"), "chunk_id"] if keep == "score" else ["at.list_no", "at.position", "chunk_id"]
    by = Window.partitionBy("query_id", "channel").orderBy(*order)
    return once.select("query_id", "channel", "chunk_id", "page_id", "score", F.row_number().over(by).alias("rank"))


def entity_nodes(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, entity, node_id) of entities (query_id, entity) in nodes (node_id, title, node_no): the first whose id or title equals it, else the first that contains it, letter case aside. Entities without a node and blank ones are left out.

    Equality is a join; only distinct names it leaves over are looked for inside names.
    Every join is a merge, so that none of these tables, all without a bound, is broadcast.
    """
    names = entities.where("entity is not null and entity != ''").withColumn("name", F.lower("entity"))
    known = nodes.where("node_id is not null").select("node_id", "node_no", F.explode(F.array(F.lower("node_id"), F.coalesce(F.lower("title"), F.lit("")))).alias("body"))
    first = F.min(F.struct("node_no", "node_id")).alias("n")
    wanted = names.select("name").distinct()
    exact = wanted.join(known.withColumnRenamed("body", "name").hint("merge"), "name").groupBy("name").agg(first)
    left = wanted.join(exact.hint("merge"), "name", "left_anti").withColumnRenamed("name", "word")
    part = containing(known, left).withColumnRenamed("word", "name").groupBy("name").agg(first)
    return names.join(exact.unionByName(part).hint("merge"), "name").select("query_id", "entity", F.col("n.node_id").alias("node_id")).distinct()


def seeds_of(direct: DataFrame, entities: DataFrame | None = None, most: int = SEEDS) -> DataFrame:
    """(query_id, page_id, rank): the first direct pages (query_id, page_id, rank), then the nodes of entities (query_id, node_id, place) in their order; each once, where it comes first."""
    rows = direct.where(F.col("rank") <= most).select("query_id", "page_id", F.col("rank").cast("long").alias("at"))
    if entities is not None:
        rows = rows.unionByName(entities.select("query_id", F.col("node_id").alias("page_id"), (F.col("place") + most).cast("long").alias("at")))
    once = rows.groupBy("query_id", "page_id").agg(F.min("at").alias("at"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "page_id"))).drop("at")


def page_evidence(candidates: DataFrame, hits: DataFrame, most: int = PAGE_HITS) -> DataFrame:
    """Graph candidates (query_id, page_id, seed_id, weight, signals, place) with evidence of their own text, others are dropped: (query_id, page_id, place, paths, evidence).

    hits: (query_id, page_id, chunk_id, channel, score, text) of the restricted search, of
    which each page's ``most`` best a channel count, sparse ones first; blank texts do not.
    Edges of inferred signals only need a sparse one, and have no others. Evidence ranks
    are positions in the page's list.
    """
    near = candidates.withColumn("is_inferred", graph.inferred_only(F.col("signals")))
    by = Window.partitionBy("query_id", "page_id", "channel").orderBy(F.desc("score"), "chunk_id")
    kept = hits.where(F.trim("text") != "").join(near.select("query_id", "page_id", "is_inferred"), ["query_id", "page_id"]).withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= most)
    kept = kept.where(~F.col("is_inferred") | (F.col("channel") == "sparse"))
    order = Window.partitionBy("query_id", "page_id").orderBy(F.col("channel") != "sparse", "nth", "chunk_id")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    packed = ranked.groupBy("query_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "channel", "chunk_id"))).cast(EVIDENCE).alias("evidence"))  # 2 x most
    path = F.array(F.struct("seed_id", "weight", "signals", "is_inferred")).cast(PATHS)
    return near.join(packed, ["query_id", "page_id"]).select("query_id", "page_id", "place", path.alias("paths"), "evidence")


def merge(direct: DataFrame, graph_pages: DataFrame) -> DataFrame:
    """(query_id, page_id, rrf, sparse_rank, dense_rank, evidence, paths, rank): direct candidates and graph candidates as one list.

    direct: (query_id, page_id, rrf, sparse_rank, dense_rank, evidence, rank); graph_pages:
    (query_id, page_id, place, paths, evidence). A page of both keeps its direct evidence,
    is given the graph's paths and such evidence as it lacks. Pages with a direct score
    come first by falling score, then the graph's in their order.
    """
    g = graph_pages.select("query_id", "page_id", "place", F.col("paths").alias("g_paths"), F.col("evidence").alias("g_evidence"))
    both = direct.join(g, ["query_id", "page_id"], "full_outer")
    none, bare = F.array().cast(EVIDENCE), F.array().cast(PATHS)
    own = F.coalesce(F.col("evidence").cast(EVIDENCE), none)
    new = F.filter(F.coalesce("g_evidence", none), lambda e: ~F.exists(own, lambda o: (o["chunk_id"] == e["chunk_id"]) & (o["channel"] == e["channel"])))
    rrf = F.coalesce("rrf", F.lit(0.0))
    by = Window.partitionBy("query_id").orderBy(rrf <= 0, F.round(rrf, 12).desc(), F.coalesce("rank", F.lit(1 << 30)), "place", "page_id")
    return both.select("query_id", "page_id", rrf.alias("rrf"), "sparse_rank", "dense_rank", F.concat(own, new).alias("evidence"), F.coalesce("g_paths", bare).alias("paths"), F.row_number().over(by).alias("rank"))


def section_siblings(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(anchor_id, chunk_id, chunk_index, text) of the chunks in an anchor's (anchor_id) page and section, the anchor among them, of its own kind."""
    one = chunks.dropDuplicates(["chunk_id"])
    home = anchors.select("anchor_id").distinct().join(one.select(F.col("chunk_id").alias("anchor_id"), "page_id", "section_path", "chunk_kind"), "anchor_id")
    return home.join(one.select("page_id", "section_path", "chunk_kind", "chunk_id", "chunk_index", "text"), ["page_id", "section_path", "chunk_kind"]).select("anchor_id", "chunk_id", "chunk_index", "text")


def _joined(parts: DataFrame, keys: list[str], order: list) -> DataFrame:
    """(keys, text): trimmed texts in order, repeated and blank ones once and not at all, parted by blank lines."""
    rows = parts.withColumn("text", F.trim("text")).where("text != ''")
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("parts"))  # of one item's scope
    return packed.select(*keys, F.array_join(F.array_distinct(F.transform("parts", lambda p: p["text"])), "\n\n").alias("text"))


def scope_text(items: DataFrame, chunks: DataFrame, pages: DataFrame, scope: str) -> DataFrame:
    """(query_id, page_id, text) of candidates (query_id, page_id, evidence): what is shown of each.

    full_page: the page's text. section, parent_section: the section of the first evidence.
    multiple_sections: the sections of all evidence, each once, in its order. adjacent: the
    first evidence's neighbours of its kind, then itself. Other scopes: the first evidence.
    Where that gives nothing, the texts of all evidence. Repeated texts are shown once.
    """
    keys = ["query_id", "page_id"]
    if scope in ("full_page", "full_source"):
        return items.select(*keys).join(pages.select("page_id", F.trim("content").alias("text")), "page_id").where("text != ''").select(*keys, "text")
    one = stage(chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct("page_id", "section_path", "chunk_kind", "chunk_index", "text")).alias("c")).select("chunk_id", "c.*"))
    sorted_ = F.array_sort("evidence")
    hits = items.select(*keys, F.posexplode(sorted_).alias("n", "e")).select(*keys, "n", F.col("e.chunk_id").alias("chunk_id"))
    anchors = hits if scope == "multiple_sections" else hits.where("n = 0")
    body = one.select("chunk_id", "text")
    if scope in ("section", "parent_section", "multiple_sections"):
        near = section_siblings(anchors.select(F.col("chunk_id").alias("anchor_id")), one)
        parts = anchors.join(near.withColumnsRenamed({"chunk_id": "part_id", "anchor_id": "chunk_id"}), "chunk_id").withColumn("i", F.coalesce("chunk_index", F.lit(1 << 40)))
        shown = _joined(parts, keys, ["n", "i", "part_id"])
    elif scope == "adjacent":
        from loamweave.operators.context import neighbours

        beside = neighbours(one).select("chunk_id", F.posexplode(F.array("previous_id", "next_id")).alias("i", "part_id")).where("part_id is not null")
        parts = anchors.join(beside, "chunk_id").select(*keys, "i", "part_id").unionByName(anchors.select(*keys, F.lit(2).alias("i"), F.col("chunk_id").alias("part_id")))
        shown = _joined(parts.join(body.withColumnRenamed("chunk_id", "part_id"), "part_id"), keys, ["i"])
    else:
        shown = _joined(anchors.join(body, "chunk_id"), keys, ["n"])
    other = _joined(hits.join(body, "chunk_id"), keys, ["n"])
    return items.select(*keys).join(shown, keys, "left").join(other.withColumnRenamed("text", "rest"), keys, "left").select(*keys, F.coalesce("text", "rest").alias("text")).where("text is not null")


def image_note(text: Column, known: Column, source_doc: Column, page: Column, section: Column, nearby: Column) -> Column:
    """An image's text with where it comes from and the text near it; ``known``: whether its document is on record."""
    at = F.concat(F.lit("[来源: "), F.coalesce(F.nullif(source_doc, F.lit("")), F.lit("?")), F.when(page.isNotNull(), F.concat(F.lit(", 页 "), page.cast("string"))).otherwise(""), F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", section "), section)).otherwise(""), F.lit("]"))
    near = F.trim(F.coalesce(nearby, F.lit("")))
    tail = F.when(near != "", F.concat(F.lit("\n[附近正文] "), near)).otherwise(F.lit("\n[注: 该图片附近无可用正文上下文]"))
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n"), F.when(known, F.concat(at, tail)).otherwise(F.lit("[注: 该图片无父文档元数据]")))


def shown_text(text: Column, mode: str, item_scope: Column) -> Column:
    """A summary shows 200 characters of an item whose scope is a chunk; anything else is shown in full."""
    return F.when(item_scope == "chunk", F.substring(text, 1, SUMMARY)).otherwise(text) if mode == "summary" else text


def violations(token_count: Column, effective: Column, cap: Column, hard_max: Column) -> Column:
    """Names of what a bundle breaks of its budget: cap_differs, over_budget, over_hard_max (a null maximum is none)."""
    return F.filter(F.array(
        F.when(cap != effective, F.lit("cap_differs")), F.when(token_count > effective, F.lit("over_budget")), F.when(effective > hard_max, F.lit("over_hard_max")),
    ), lambda x: x.isNotNull())


def bundles(items: DataFrame, plans: DataFrame, base: int = 4096, mode: str | None = None, hard_max: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, bundles): what of the candidates' texts gets into each query's budget, and the bundle's budget and totals.

    items: (query_id, rank, page_id, category, scope, text); plans: (query_id, context_mode).
    The first result adds place, n_tokens, truncated and omitted (the reason, for what got
    no room); the second has (query_id, bundle_mode, base_tokens, planned_tokens,
    effective_tokens, hard_max, token_count, n_items, n_omitted, violations).
    """
    money = plans.select("query_id", *budget(F.col("context_mode"), F.lit(base), mode, hard_max))
    got = stage(assemble(items.join(money.select("query_id", F.col("effective_tokens").alias("limit")), "query_id").withColumnRenamed("page_id", "id"), omitted=True).withColumnRenamed("id", "page_id"))
    sums = got.groupBy("query_id").agg(F.sum("n_tokens").alias("token_count"), F.sum((F.col("omitted").isNull()).cast("int")).alias("n_items"), F.sum(F.col("omitted").isNotNull().cast("int")).alias("n_omitted"))
    hard = F.lit(hard_max or None).cast("long")
    whole = money.join(sums, "query_id", "left").fillna(0, ["token_count", "n_items", "n_omitted"]).select(
        "query_id", "bundle_mode", F.lit(base).alias("base_tokens"), "planned_tokens", "effective_tokens", hard.alias("hard_max"), "token_count", "n_items", "n_omitted",
        violations(F.col("token_count"), F.col("effective_tokens"), F.col("effective_tokens"), hard).alias("violations"),
    )
    return got, whole


def one_pass(plans: DataFrame, index: dict[str, DataFrame], k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(candidates, counts): direct and graph candidates of each plan, merged, and (query_id, n_sparse, n_dense, n_direct, n_graph).

    plans: (query_id, query, entities, vectors array<array<float>>) and, if hits are to be
    of some page types only, page_types, empty for all. index: the tables
    chunks (chunk_id, page_id, fts_text, text, chunk_kind, page_type, ...), vectors (id =
    chunk_id, vector), edges and nodes of ``publish``ed builds; edges may be left out.
    """
    chunks = index["chunks"].where("chunk_id is not null")
    kind = F.max("page_type") if "page_type" in chunks.columns else F.lit(None).cast("string")
    home = chunks.groupBy("chunk_id").agg(F.max("page_id").alias("page_id"), F.max("text").alias("text"), kind.alias("page_type"))
    sparse = fulltext.search(chunks, plans.select("query_id", "query"), SEARCH_HITS, "chunk_id", "fts_text").select("query_id", "chunk_id", "score", "rank")
    asked = plans.select("query_id", F.posexplode_outer("vectors").alias("list_no", "vector")).where("vector is not null")
    tagged = asked.select(F.struct("query_id", "list_no").alias("key"), "vector").select(F.to_json("key").alias("query_id"), "vector", F.col("key").alias("asked"))
    dim = index.get("dim", 64)
    near = dense.topk(index["vectors"], tagged.select("query_id", "vector"), SEARCH_HITS, "cosine", dim).join(tagged.select("query_id", "asked"), "query_id")
    far = near.select(F.col("asked.query_id").alias("query_id"), F.lit("dense").alias("channel"), F.col("asked.list_no").alias("list_no"), F.col("rank").alias("position"), F.col("id").alias("chunk_id"), (1 - F.col("distance") / 2).alias("score"))
    lists = far.unionByName(sparse.select("query_id", F.lit("sparse").alias("channel"), F.lit(0).alias("list_no"), F.col("rank").alias("position"), "chunk_id", "score"))
    placed = lists.join(home.select("chunk_id", "page_id", "page_type"), "chunk_id")
    if "page_types" in plans.columns:
        placed = placed.join(plans.select("query_id", "page_types"), "query_id").where((F.size(F.coalesce("page_types", F.array().cast("array<string>"))) == 0) | F.array_contains("page_types", F.col("page_type")))
    hits = stage(list_ranks(placed))
    direct = stage(fusion.page_rrf(hits, max(k, SEEDS), evidence=2 * SEARCH_HITS).select("query_id", "page_id", "rrf", "sparse_rank", "dense_rank", F.col("evidence").cast(EVIDENCE).alias("evidence"), "rank"))
    counted = hits.groupBy("query_id").agg(F.sum((F.col("channel") == "sparse").cast("int")).alias("n_sparse"), F.sum((F.col("channel") == "dense").cast("int")).alias("n_dense"))
    kept = direct.where(F.col("rank") <= k)
    totals = plans.select("query_id").join(counted, "query_id", "left").join(kept.groupBy("query_id").agg(F.count("*").alias("n_direct")), "query_id", "left")
    if index.get("edges") is None:
        none = kept.limit(0).select("query_id", "page_id", F.lit(0).alias("place"), F.array().cast(PATHS).alias("paths"), "evidence")
        return merge(kept, none), totals.fillna(0).withColumn("n_graph", F.lit(0))
    named = plans.select("query_id", F.posexplode("entities").alias("place", "entity"))
    nodes = entity_nodes(named.select("query_id", "entity"), index["nodes"]).join(named, ["query_id", "entity"]).select("query_id", "node_id", (F.col("place") + 1).alias("place"))
    around = stage(graph.expand(seeds_of(direct, nodes), index["edges"], NEIGHBOURS))
    local = restricted_hits(around.select("query_id", "page_id"), plans, asked, chunks, home, index["vectors"], dim)
    proven = stage(page_evidence(around, local))
    totals = totals.join(proven.groupBy("query_id").agg(F.count("*").alias("n_graph")), "query_id", "left").fillna(0)
    return merge(kept, proven), totals


def restricted_hits(wanted: DataFrame, plans: DataFrame, asked: DataFrame, chunks: DataFrame, home: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(query_id, page_id, chunk_id, channel, score, text) of wanted pages (query_id, page_id): chunks with a term of the query, and by cosine those with vectors; statistics are those of all chunks."""
    from loamweave.functions.vectors import dot, finite

    inside = wanted.join(home.select("chunk_id", "page_id"), "page_id")
    terms = fulltext.terms_of(F.col("query"))
    lengths = fulltext.document_lengths(chunks, "chunk_id", "fts_text")
    size = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    flat = plans.select("query_id", F.explode(F.array_distinct(terms)).alias("term"))
    posted = fulltext.postings(chunks, "chunk_id", "fts_text", flat.select("term").distinct(), lengths)
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (fulltext.K1 + 1) / (F.col("tf") + fulltext.K1 * (1 - fulltext.B + fulltext.B * F.col("length") / F.col("mean")))
    met = inside.select("query_id", "page_id", "chunk_id").join(posted, "chunk_id").join(flat, ["query_id", "term"]).join(df, "term").crossJoin(F.broadcast(size))  # one row
    sparse = met.groupBy("query_id", "page_id", "chunk_id").agg(F.sum(weight).alias("score")).withColumn("channel", F.lit("sparse"))
    size_of = lambda v: F.sqrt(dot(v, v))
    good = vectors.where(finite(F.col("vector"), dim)).groupBy("id").agg(F.max("vector").alias("x"))
    pairs = inside.select("query_id", "page_id", "chunk_id").join(good.withColumnRenamed("id", "chunk_id"), "chunk_id").join(asked.where(finite(F.col("vector"), dim)), "query_id")
    cosine = dot(F.col("x"), F.col("vector")) / F.greatest(size_of(F.col("x")) * size_of(F.col("vector")), F.lit(1e-300))
    far = pairs.groupBy("query_id", "page_id", "chunk_id").agg(F.max((1 + cosine) / 2).alias("score")).withColumn("channel", F.lit("dense"))
    return sparse.unionByName(far).join(home.select("chunk_id", "text"), "chunk_id").select("query_id", "page_id", "chunk_id", "channel", "score", "text")


def answer(plans: DataFrame, index: dict[str, DataFrame], k: int = 5, base: int = 4096, mode: str | None = None, hard_max: int | None = None, again: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, items, bundles) of a batch of plans (query_id, query, entities, vectors, context_mode).

    Plans without a hit in either channel or without a candidate are tried once more by
    their plan in ``again``, which has the same columns. index also has pages (page_id,
    path, title, content, sources) and may have images (path, source_doc, page, section,
    nearby).
    """
    found, counts = one_pass(plans, index, k)
    counts = stage(counts)
    empty = counts.where("n_sparse + n_dense = 0 or n_direct = 0").select("query_id")
    if again is not None and not empty.isEmpty():
        second, _ = one_pass(again.join(empty, "query_id", "left_semi"), index, k)
        found = found.join(empty, "query_id", "left_anti").unionByName(second)
        plans = plans.join(empty, "query_id", "left_anti").unionByName(again.join(empty, "query_id", "left_semi").select(*plans.columns))
    pages = index["pages"].groupBy("page_id").agg(F.max(F.struct("path", "title", "content")).alias("p")).select("page_id", "p.*")
    found = stage(found.join(pages.select("page_id", "path", "title"), "page_id", "left").join(plans.select("query_id", "context_mode"), "query_id"))
    parts = []
    for scope in ["full_page"] if mode == "full" else list(MODES):
        some = found if mode == "full" else found.where(F.col("context_mode") == scope)
        kind = fusion.category(F.coalesce("path", "page_id"), F.col("rrf"), F.size("paths") > 0, scope)
        rows = some.select("query_id", "page_id", "rank", "path", "evidence", kind.alias("category")).withColumn("scope", F.when(F.col("category").isin("image", "graph"), "chunk").otherwise(scope))
        for own in {scope, "chunk"}:
            chosen = rows.where(F.col("scope") == own)
            text = scope_text(chosen.select("query_id", "page_id", "evidence"), index["chunks"], pages, own)
            parts.append(chosen.join(text, ["query_id", "page_id"]))
    texts = parts[0]
    for p in parts[1:]:
        texts = texts.unionByName(p)
    if index.get("images") is not None:
        about = index["images"].groupBy("path").agg(F.max(F.struct("source_doc", "page", "section", "nearby")).alias("m"))
        texts = texts.join(about, "path", "left")
        noted = image_note(F.col("text"), F.col("m").isNotNull(), F.col("m.source_doc"), F.col("m.page"), F.col("m.section"), F.col("m.nearby"))
        texts = texts.withColumn("text", F.when(F.col("category") == "image", noted).otherwise(F.col("text"))).drop("m")
    texts = texts.withColumn("text", shown_text(F.col("text"), mode or "snippet", F.col("scope")))
    items, whole = bundles(texts.select("query_id", "rank", "page_id", "category", "scope", "text"), plans, base, mode, hard_max)
    return found, items, whole


def item_json(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, place, item): each item of a bundle as the JSON of a result."""
    near = candidates.select("query_id", "page_id", "path", "title", F.round("rrf", 6).alias("score"), "evidence", "paths")
    method = F.when(F.col("category") == "graph", "graph_expansion").when(F.col("category") == "image", "image").otherwise("rrf")
    slash = F.translate(F.coalesce("path", F.lit("")), "\\", "/")
    embed = F.when(slash.contains("assets/"), F.concat(F.lit("![["), F.substring_index(slash, "/", -1), F.lit("]]")))
    rows = items.where("omitted is null").join(near, ["query_id", "page_id"], "left")
    return rows.select("query_id", "place", F.to_json(F.struct(
        "page_id", "path", "title", "score", F.col("text").alias("snippet"), "evidence", F.col("paths").alias("graph_paths"), method.alias("method"), "scope",
        F.col("n_tokens").alias("tokens"), "truncated", embed.alias("embed"),
    )).alias("item"))


def markdown(items: DataFrame, bundles_: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, markdown): each bundle as text for a reader."""
    near = candidates.select("query_id", "page_id", "path", "title", "evidence")
    rows = items.where("omitted is null").join(near, ["query_id", "page_id"], "left")
    ids = F.array_join(F.transform("evidence", lambda e: e["chunk_id"]), ", ")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("### "), F.coalesce("title", "page_id")), F.concat(F.lit("- path: "), F.coalesce("path", "page_id")), F.concat(F.lit("- scope: "), "scope", F.lit(", tokens: "), F.col("n_tokens").cast("string")),
        F.concat(F.lit("- evidence: "), ids), F.when(F.col("truncated"), F.lit("- truncated")), F.concat(F.lit("```\n"), "text", F.lit("\n```")),
    )
    packed = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", lines.alias("x")))), lambda p: p["x"]), "\n\n").alias("body"))
    head = F.format_string("## %s: %d of %d tokens, %d left out", "bundle_mode", "token_count", "effective_tokens", "n_omitted")
    return bundles_.join(packed, "query_id", "left").select("query_id", F.concat_ws("\n\n", head, F.coalesce("body", F.lit("nothing found"))).alias("markdown"))


def exit_code(status: str | None, fallback_used: bool, n_text: int) -> int:
    """0 for a local answer, a fresh report or a fallback with text; else 2."""
    return 0 if status in (None, "fresh") or fallback_used and n_text else 2

"""Queries of scope texts, budgets, bundles, evaluation counters and the whole way from plans to bundles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.functions import text, vectors
from loamweave.operators import ann, context, dense, fulltext, fusion, metrics, retrieval
from loamweave.operators.stage import newest
from loamweave.sources import store
from loamweave.sources.tables import table


def _chunks(spark, d):
    return table(spark, d, "sparse_chunks", "chunk_id", "page_id", "section_path", "chunk_kind", "chunk_index", "text", "title", "path", "page_type", "heading").distinct()


def _pages(spark, d):
    return newest(table(spark, d, "wiki_pages"), ["page_id"], "updated_at", ["page_id", "updated_at", "path", "title", "content", "sources", "deleted_at"]).where("deleted_at is null")


def _anchored(spark, d):
    """Each page as a candidate with evidence: its chunks whose index is divisible by 7, by index."""
    rows = _chunks(spark, d).where("chunk_index % 7 = 0 and chunk_kind = 'dense'").groupBy("page_id", "chunk_id").agg(F.min("chunk_index").alias("i"))
    by = Window.partitionBy("page_id").orderBy("i", "chunk_id")
    ranked = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= 3)
    packed = ranked.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.lit("dense").alias("channel"), "chunk_id"))).cast(retrieval.EVIDENCE).alias("evidence"))
    return packed.select(F.lit(1).alias("query_id"), "page_id", "evidence")


def _scope(name):
    def run(spark, d):
        got = retrieval.scope_text(_anchored(spark, d), _chunks(spark, d), _pages(spark, d), name)
        return got.select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))

    return run


def _siblings(spark, d):
    anchors = _chunks(spark, d).where("chunk_kind = 'dense' and chunk_index % 7 = 0").select(F.col("chunk_id").alias("anchor_id"))
    return retrieval.section_siblings(anchors, _chunks(spark, d)).groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"))


def _hit_projection(spark, d):
    """Hits of the newest retrievals with one score in [0, 1] and the names of their page."""
    rows = newest(table(spark, d, "retrieved_pages"), ["query_id", "page_id", "retrieval_method"], "retrieved_at", ["query_id", "page_id", "retrieval_method", "retrieved_at", "score", "distance", "title", "vector_metric"])
    value = F.when((F.col("vector_metric") == "cosine") & F.col("distance").isNotNull(), vectors.score(F.col("distance"), "cosine")).otherwise(F.col("score"))
    channel = F.when(F.col("retrieval_method") == "vector", "vector").otherwise("fts")
    return rows.where("retrieval_method in ('bm25', 'vector')").select("query_id", "page_id", "title", channel.alias("channel"), F.round(value, 9).alias("score"))


def _split(spark, d):
    """Images and texts among retrieved pages, and the share of the budget each draws on."""
    rows = table(spark, d, "retrieved_pages", "page_id", "path", "retrieval_method").distinct()
    image = F.translate("path", "\\", "/").contains("assets/") | F.lower("page_id").rlike(r"\.(png|jpe?g|gif|webp)$")
    kind = fusion.category(F.col("path"), F.when(F.col("retrieval_method") == "graph", 0.0).otherwise(1.0), F.col("retrieval_method") == "graph")
    return rows.select("page_id", "retrieval_method", F.coalesce(image, F.lit(False)).alias("is_image"), kind.alias("category"))


def _unique(spark, d):
    """Texts of each page in the order of its chunks, repeated ones once."""
    rows = _chunks(spark, d).where("chunk_kind = 'sparse'").select("page_id", "chunk_index", "chunk_id", F.trim("text").alias("text")).where("text != ''")
    packed = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("parts"))
    texts = F.array_distinct(F.transform("parts", lambda p: p["text"]))
    return packed.select("page_id", F.size("parts").alias("n"), F.size(texts).alias("n_unique"), F.sha2(F.array_join(texts, "\n\n"), 256).alias("text_hash"))


def _list_ranks(spark, d):
    """Hits of several vectors of one label as one list: positions go on from vector to vector, a chunk stands where it came first."""
    data = table(spark, d, "embeddings")
    asked = data.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = dense.topk(data.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), asked, 10)
    labels = data.select(F.col("vec_id").alias("query_id"), "label").distinct()
    hits = near.join(labels, "query_id").select(
        F.col("label").alias("query_id"), F.lit("dense").alias("channel"), F.col("query_id").alias("list_no"), F.col("rank").alias("position"), F.col("id").alias("chunk_id"), F.col("id").alias("page_id"), (1 - F.col("distance") / 2).alias("score"))
    return retrieval.list_ranks(hits).select(F.col("query_id").alias("label"), F.col("chunk_id").alias("vec_id"), F.round("score", 5).alias("score"), "rank")


def _restricted(spark, d):
    """Nearest vectors of one label only, asked with every vector whose id is divisible by 20."""
    data = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    asked = data.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return dense.topk(data.where("label = 1").select("id", "vector"), asked, 5).select("query_id", F.col("id").alias("vec_id"), F.round("distance", 5).alias("distance"), "rank")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _index_recall(spark, d):
    """Recall at 10 and 20 of the index in cells against the scan, asked with every vector whose id is divisible by 20."""
    data = _vectors(spark, d)
    asked = data.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact, found = dense.topk(data, asked, 20), ann.search(ann.build(data), asked, 20)
    parts = [dense.recall(exact, found, k).select(F.lit(k).alias("k"), "query_id", F.round("recall", 6).alias("recall")) for k in (10, 20)]
    return parts[0].unionByName(parts[1])


def _policy(spark, d):
    """Which search the recalls allow, and the rows the index lacks."""
    data = _vectors(spark, d)
    index = ann.build(data)
    lost = data.where(vectors.finite(F.col("vector"), 64)).join(index.rows, "id", "left_anti").count()
    recalls = {r["k"]: r["r"] for r in _index_recall(spark, d).groupBy("k").agg(F.min("recall").alias("r")).collect()}
    return spark.createDataFrame([(dense.policy(recalls, lost), lost)], "policy string, unindexed long")


def _index_stats(spark, d):
    """Rows of both tables, and dense chunks without a usable vector."""
    sparse = table(spark, d, "sparse_chunks", "chunk_id", "chunk_kind").distinct()
    good = table(spark, d, "dense_chunks", "chunk_id", "vector").where(vectors.finite(F.col("vector"), 64)).select("chunk_id").distinct()
    n = sparse.agg(F.count("*").alias("n_chunks"), F.sum((F.col("chunk_kind") == "dense").cast("int")).alias("n_dense"))
    left = sparse.where("chunk_kind = 'dense'").join(good, "chunk_id", "left_anti").agg(F.count("*").alias("unindexed"))
    return n.crossJoin(left)  # one row each


def _probe(spark, d):
    return store.exact_probe(table(spark, d, "sparse_chunks", "chunk_id", "fts_text"))


def _page_rows(spark, d):
    """Chunks of the pages whose id has a quote or belongs to the first page, by equality, never by a text of SQL."""
    rows = _chunks(spark, d)
    first = rows.agg(F.min("page_id").alias("page_id"))
    return rows.join(F.broadcast(first), "page_id").select("chunk_id", "chunk_kind", "chunk_index")  # one row


def _bundle(spark, d):
    """Bundles of the pages that fusion and the graph found for each query, at a base of 1,024 tokens and at most 1,200."""
    rows = newest(table(spark, d, "retrieved_pages"), ["query_id", "page_id", "retrieval_method"], "retrieved_at", ["query_id", "page_id", "retrieval_method", "retrieved_at", "score", "path"]).where("retrieval_method in ('fused', 'graph')")
    best = rows.groupBy("query_id", "page_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.max("path").alias("path"), F.min((F.col("retrieval_method") == "graph").cast("int")).alias("only_graph"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id")
    kind = fusion.category(F.col("path"), F.col("score"), F.col("only_graph") == 1)
    items = best.withColumn("rank", F.row_number().over(by)).join(_pages(spark, d).select("page_id", "content"), "page_id").select("query_id", "rank", "page_id", kind.alias("category"), F.lit("section").alias("scope"), F.col("content").alias("text"))
    modes = F.element_at(F.array(*map(F.lit, context.MODES)), (F.col("query_id") % len(context.MODES) + 1).cast("int"))
    plans = rows.select("query_id").distinct().withColumn("context_mode", modes)
    return retrieval.bundles(items, plans, 1024, None, 1200)


def _bundle_budgets(spark, d):
    return _bundle(spark, d)[1].select("query_id", "bundle_mode", "base_tokens", "planned_tokens", "effective_tokens", (F.col("token_count") > F.col("effective_tokens")).alias("over"), F.size("violations").alias("n_violations"))


def _bundle_proof(spark, d):
    """What holds for all bundles: items and tokens add up, nothing shown exceeds its text, everything offered is either shown or left out."""
    items, whole = _bundle(spark, d)
    sums = items.groupBy("query_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    both = whole.join(sums, "query_id", "left").fillna(0)
    wrong = (F.col("t") != F.col("token_count")) | (F.col("n") != F.col("n_items") + F.col("n_omitted")) | (F.col("token_count") > F.col("effective_tokens"))
    return both.agg(F.count("*").alias("n_bundles"), F.sum(wrong.cast("int")).alias("wrong"), F.sum("n").alias("n_offered"))


def _violations(spark, d):
    """Budgets of every container profile and context mode against what a bundle of 1.1 times its budget would break."""
    rows = table(spark, d, "pack_profiles").select("profile", "capacity_tokens", F.explode(F.array(*map(F.lit, context.MODES))).alias("context_mode"))
    money = rows.select("profile", "context_mode", *context.budget(F.col("context_mode"), F.col("capacity_tokens")))
    eff = F.col("effective_tokens")
    got = retrieval.violations((eff * F.when(F.length("context_mode") % 2 == 0, 1.1).otherwise(0.9)).cast("long"), eff, F.when(F.col("profile") > "m", eff).otherwise(eff + 1), F.when(F.col("context_mode") == "section", F.lit(100)))
    return money.select("profile", "context_mode", F.array_join(got, ",").alias("violations"))


def _histogram(spark, d):
    return _bundle(spark, d)[1].groupBy("bundle_mode", "base_tokens", "effective_tokens").agg(F.count("*").alias("n"))


def _counters(spark, d):
    """Counters over bundles whose token counts are the documents' sizes, against the profiles' capacities."""
    size = text.token_count(F.col("text"))
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", size.alias("token_count"))
    cap = table(spark, d, "pack_profiles").agg(F.max("capacity_tokens").alias("effective_tokens"))
    rows = docs.crossJoin(F.broadcast(cap)).withColumns({"base_tokens": F.lit(1000).cast("long"), "hard_max": F.lit(None).cast("long"), "unsupported": (F.col("doc_id") % 100 == 0).cast("int")})  # one row
    rows = rows.withColumn("violations", retrieval.violations(F.col("token_count"), F.col("effective_tokens"), F.col("effective_tokens"), F.col("hard_max")))
    return metrics.bundle_counters(rows)


def _evidence_recall(spark, d):
    """Whether the first words of a page's title stand in the texts of its chunks."""
    contexts = _chunks(spark, d).groupBy("page_id").agg(F.concat_ws("\n", F.array_sort(F.collect_set("text"))).alias("context")).withColumnRenamed("page_id", "query_id")
    facts = _chunks(spark, d).select(F.col("page_id").alias("query_id"), F.explode(F.slice(F.split("title", " "), 1, 3)).alias("fact")).distinct()
    return metrics.evidence_recall(contexts, facts).select(F.col("query_id").alias("page_id"), F.round("recall", 6).alias("recall"))


def _page_hits(spark, d):
    """Fused pages whose id holds a part of the name of the page the graph found first."""
    rows = newest(table(spark, d, "retrieved_pages"), ["query_id", "page_id", "retrieval_method"], "retrieved_at", ["query_id", "page_id", "retrieval_method", "retrieved_at", "score"])
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id")
    ranked = rows.where("retrieval_method = 'fused' and score is not null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= 10)
    gold = rows.where("retrieval_method = 'graph'").groupBy("query_id").agg(F.min("page_id").alias("page_id")).select("query_id", F.upper(F.regexp_extract("page_id", r"([a-z]+_[a-z]\d+)", 1)).alias("name")).where("name != ''")
    return metrics.page_hits(ranked, gold).groupBy("query_id").agg(F.sum(F.col("hit").cast("int")).alias("n_hits"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"))


def _summary(spark, d):
    return metrics.summary(table(spark, d, "events", "event_type", "value"), "event_type", "value").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("least", 6).alias("least"))


def _totals(spark, d):
    """Tokens and bytes of each kind of chunk."""
    return _chunks(spark, d).groupBy("chunk_kind").agg(F.count("*").alias("n_chunks"), F.sum(text.token_count(F.col("text"))).alias("n_tokens"), F.sum(F.octet_length("text")).alias("n_bytes"))


def _answers(spark, d):
    """The whole way, from plans to bundles: asked with every page that has a dense chunk whose index is divisible by 20, its heading and title as the query."""
    chunks = table(spark, d, "sparse_chunks")
    data = table(spark, d, "dense_chunks", "chunk_id", "vector").withColumnRenamed("chunk_id", "id")
    first = table(spark, d, "dense_chunks", "page_id", "chunk_index", "title", "heading", "vector").where("chunk_index % 20 = 0").where(vectors.finite(F.col("vector"), 64))
    one = first.groupBy("page_id").agg(F.min(F.struct("chunk_index", "title", "heading", "vector")).alias("c"))
    words = F.concat_ws(" ", "c.title", "c.heading")
    modes = F.element_at(F.array(*map(F.lit, context.MODES)), (F.pmod(F.length("page_id"), F.lit(len(context.MODES))) + 1).cast("int"))
    plans = one.select(F.col("page_id").alias("query_id"), text.search_text(words).alias("query"), F.array("c.title").alias("entities"), F.array("c.vector").cast("array<array<float>>").alias("vectors"), modes.alias("context_mode"))
    pages = _pages(spark, d)
    nodes = pages.select(F.col("page_id").alias("node_id"), "title", F.col("page_id").alias("node_no"))
    index = {"chunks": chunks, "vectors": data, "edges": table(spark, d, "graph_edges").where("weight is not null"), "nodes": nodes, "pages": pages, "images": None}
    return retrieval.answer(plans, index)


def _answer_bundles(spark, d):
    return _answers(spark, d)[2].select("query_id", "bundle_mode", "effective_tokens", "token_count", "n_items", "n_omitted", F.size("violations").alias("n_violations"))


def _answer_markdown(spark, d):
    found, items, whole = _answers(spark, d)
    return retrieval.markdown(items, whole, found)


_CHUNKS = "c as (select distinct chunk_id, page_id, section_path, chunk_kind, chunk_index, text, title, path, page_type, heading from sparse_chunks)"
_ANCHORS = f"""{_CHUNKS},
    ev as (select * from (select page_id, chunk_id, row_number() over (partition by page_id order by i, chunk_id) as n from (select page_id, chunk_id, min(chunk_index) as i from c where chunk_index % 7 = 0 and chunk_kind = 'dense' group by 1, 2)) where n <= 3)"""
_JOINED = """, u as (select page_id, txt, min(o) as o from (select page_id, trim(text, ' ') as txt, {order} as o from parts) where txt <> '' group by 1, 2)
    select page_id, length(string_agg(txt, chr(10) || chr(10) order by o))::int as n_chars, sha256(string_agg(txt, chr(10) || chr(10) order by o)) as text_hash from u group by 1"""
_SECTION = ", parts as (select e.page_id, e.n, s.text, s.chunk_index, s.chunk_id from ev e join c a on a.chunk_id = e.chunk_id join c s on s.page_id = a.page_id and s.section_path = a.section_path and s.chunk_kind = a.chunk_kind {where})"
_NEWEST = "rows as (select query_id, page_id, retrieval_method, max(struct_pack(a := retrieved_at, b := score, c := distance, t := title, v := vector_metric)) as m from retrieved_pages group by 1, 2, 3)"
_DENSE = """
    with q as (select vec_id as query_id, embedding::double[] as qv, label from embeddings where vec_id % 20 = 0),
    r as (select q.query_id, q.label, e.vec_id, 1 - list_cosine_similarity(qv, e.embedding::double[]) as distance from q, embeddings e {where}),
    t as (select *, row_number() over (partition by query_id order by round(distance, 9), vec_id) as rank from r)"""
_MODES = "[" + ", ".join(f"'{m}'" for m in context.MODES) + "]"

QUERIES = {
    "scope_section": (_scope("section"), f"with {_ANCHORS}" + _SECTION.format(where="where e.n = 1") + _JOINED.format(order="struct_pack(i := coalesce(chunk_index, 1099511627776), c := chunk_id)")),
    "scope_multiple_sections": (_scope("multiple_sections"), f"with {_ANCHORS}" + _SECTION.format(where="") + _JOINED.format(order="struct_pack(n := n, i := coalesce(chunk_index, 1099511627776), c := chunk_id)")),
    "scope_chunk": (_scope("chunk"), f"with {_ANCHORS}, parts as (select e.page_id, e.n, a.text from ev e join c a on a.chunk_id = e.chunk_id where e.n = 1)" + _JOINED.format(order="n")),
    "scope_adjacent": (_scope("adjacent"), f"""with {_ANCHORS},
        nb as (select chunk_id, lag(chunk_id) over w as p, lead(chunk_id) over w as q from c window w as (partition by page_id order by chunk_index nulls last, chunk_id)),
        ids as (select e.page_id, 0 as n, p as chunk_id from ev e join nb using (chunk_id) where e.n = 1 union all select e.page_id, 1, q from ev e join nb using (chunk_id) where e.n = 1 union all select page_id, 2, chunk_id from ev where n = 1),
        parts as (select i.page_id, i.n, a.text from ids i join c a on a.chunk_id = i.chunk_id)""" + _JOINED.format(order="n")),
    "scope_full_page": (_scope("full_page"), f"""with {_ANCHORS},
        p as (select * from (select page_id, content, deleted_at, row_number() over (partition by page_id order by updated_at desc) as n from wiki_pages) where n = 1 and deleted_at is null)
        select page_id, length(trim(content, ' '))::int as n_chars, sha256(trim(content, ' ')) as text_hash from p where page_id in (select page_id from ev) and trim(content, ' ') <> ''"""),
    "section_siblings": (_siblings, f"""with {_CHUNKS}, a as (select distinct chunk_id, page_id, section_path, chunk_kind from c where chunk_kind = 'dense' and chunk_index % 7 = 0)
        select a.chunk_id as anchor_id, count(*) as n, min(c.chunk_index) as first_index, max(c.chunk_index) as last_index from a join c using (page_id, section_path, chunk_kind) group by 1"""),
    "hit_projection": (_hit_projection, f"""with {_NEWEST}
        select query_id, page_id, m.t as title, case when retrieval_method = 'vector' then 'vector' else 'fts' end as channel,
               round(case when m.v = 'cosine' and m.c is not null then least(1, greatest(0, 1 - m.c / 2)) else m.b end, 9) as score from rows where retrieval_method in ('bm25', 'vector')"""),
    "image_text_split": (_split, r"""
        select distinct page_id, retrieval_method, coalesce(contains(replace(path, '\', '/'), 'assets/') or regexp_matches(lower(page_id), '\.(png|jpe?g|gif|webp)$'), false) as is_image,
               case when contains(lower(replace(path, '\', '/')), 'assets/') or regexp_matches(lower(replace(path, '\', '/')), '\.(png|jpe?g|gif|webp)$') then 'image' when retrieval_method = 'graph' then 'graph' else 'dense' end as category from retrieved_pages"""),
    "text_dedup": (_unique, f"""with {_CHUNKS}, r as (select page_id, trim(text, ' ') as txt, min(struct_pack(i := chunk_index, c := chunk_id)) as o, count(*) as k from c where chunk_kind = 'sparse' and trim(text, ' ') <> '' group by 1, 2)
        select page_id, sum(k)::int as n, count(*)::int as n_unique, sha256(string_agg(txt, chr(10) || chr(10) order by o)) as text_hash from r group by 1"""),
    "list_position_ranks": (_list_ranks, _DENSE.format(where="") + """, k as (select label, vec_id, min(struct_pack(l := query_id, p := rank)) as o, max(1 - distance / 2) as score from t where rank <= 10 group by 1, 2)
        select label, vec_id, round(score, 5) as score, row_number() over (partition by label order by o, vec_id)::int as rank from k"""),
    "dense_restricted": (_restricted, _DENSE.format(where="where e.label = 1") + " select query_id, vec_id, round(distance, 5) as distance, rank::int as rank from t where rank <= 5"),
    "index_recall": (_index_recall, "select k, vec_id as query_id, 1.0::double as recall from embeddings, (values (10), (20)) as v(k) where vec_id % 20 = 0"),
    "vector_policy": (_policy, "select 'ann' as policy, 0 as unindexed"),
    "index_stats": (_index_stats, """
        with s as (select distinct chunk_id, chunk_kind from sparse_chunks), g as (select chunk_id from dense_chunks where len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0)
        select count(*) as n_chunks, count(*) filter (chunk_kind = 'dense') as n_dense, count(*) filter (chunk_kind = 'dense' and chunk_id not in (select chunk_id from g)) as unindexed from s"""),
    "exact_probe": (_probe, r"""
        with f as (select chunk_id, min(fts_text) as t from sparse_chunks where chunk_id = (select min(chunk_id) from sparse_chunks where fts_text is not null) and fts_text is not null group by 1)
        select chunk_id, list_filter(string_split_regex(t, '\s+'), lambda x: regexp_full_match(x, '[\p{L}\p{N}]+'))[-1] as term from f"""),
    "page_rows": (_page_rows, f"with {_CHUNKS} select chunk_id, chunk_kind, chunk_index from c where page_id = (select min(page_id) from c)"),
    "bundle_budgets": (_bundle_budgets, f"""
        with q as (select distinct query_id from retrieved_pages where retrieval_method in ('fused', 'graph')), m as (select query_id, {_MODES}[(query_id % {len(context.MODES)} + 1)::int] as mode from q)
        select query_id, case when mode = 'global' then 'summary' else 'snippet' end as bundle_mode, 1024 as base_tokens, case when mode = 'multiple_sections' then 1433 else 1024 end::bigint as planned_tokens,
               case when mode = 'multiple_sections' then 1200 else 1024 end::bigint as effective_tokens, false as over, 0 as n_violations from m"""),
    "bundle_proof": (_bundle_proof, """
        with p as (select page_id from (select page_id, content, deleted_at, row_number() over (partition by page_id order by updated_at desc) as n from wiki_pages) where n = 1 and deleted_at is null and content <> ''),
        r as (select distinct query_id, page_id from retrieved_pages where retrieval_method in ('fused', 'graph'))
        select (select count(distinct query_id) from r) as n_bundles, 0 as wrong, count(*) as n_offered from r join p using (page_id)"""),
    "bundle_violations": (_violations, f"""
        with m as (select profile, unnest({_MODES}) as context_mode, capacity_tokens from pack_profiles),
        e as (select profile, context_mode, floor(capacity_tokens * case when context_mode = 'multiple_sections' then 1.4::double else 1 end)::bigint as eff from m),
        t as (select *, floor(eff * case when length(context_mode) % 2 = 0 then 1.1::double else 0.9::double end)::bigint as used from e)
        select profile, context_mode, concat_ws(',', case when not profile > 'm' then 'cap_differs' end, case when used > eff then 'over_budget' end, case when context_mode = 'section' and eff > 100 then 'over_hard_max' end) as violations from t"""),
    "budget_histogram": (_histogram, f"""
        with q as (select distinct query_id from retrieved_pages where retrieval_method in ('fused', 'graph')), m as (select {_MODES}[(query_id % {len(context.MODES)} + 1)::int] as mode from q)
        select case when mode = 'global' then 'summary' else 'snippet' end as bundle_mode, 1024 as base_tokens, case when mode = 'multiple_sections' then 1200 else 1024 end::bigint as effective_tokens, count(*) as n from m group by 1, 2, 3"""),
    "bundle_counters": (_counters, """
        with x as (select greatest(1, length(text) // 4) as t, doc_id, (select max(capacity_tokens) from pack_profiles) as e from documents where text is not null)
        select count(*) filter (t > e) as overflow, count(*) filter (t > e) as budget_violations, count(*) filter (doc_id % 100 = 0) as unsupported, count(*) filter (e > 1000) as expanded, max(e) as max_effective from x"""),
    "evidence_recall": (_evidence_recall, f"""with {_CHUNKS}, x as (select page_id, string_agg(distinct text, chr(10)) as ctx from c group by 1), f as (select distinct page_id, unnest(string_split(title, ' ')[1:3]) as fact from c)
        select x.page_id, round(coalesce(avg(case when f.fact <> '' then contains(ctx, f.fact)::int end), 1), 6) as recall from x left join f using (page_id) group by 1"""),
    "page_name_hits": (_page_hits, f"""with {_NEWEST}, r as (select query_id, page_id, row_number() over (partition by query_id order by m.b desc, page_id) as rank from rows where retrieval_method = 'fused' and m.b is not null),
        g as (select query_id, regexp_extract(min(page_id), '([a-z]+_[a-z]\\d+)', 1) as name from rows where retrieval_method = 'graph' group by 1)
        select r.query_id, sum(contains(lower(page_id), name)::int)::bigint as n_hits, min(rank) filter (contains(lower(page_id), name))::int as first_hit from r join g using (query_id) where rank <= 10 and name <> '' group by 1"""),
    "value_summary": (_summary, "select event_type, count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, round(min(value), 6) as least from events where value is not null group by 1"),
    "token_totals": (_totals, f"with {_CHUNKS} select chunk_kind, count(*) as n_chunks, sum(greatest(1, length(text) // 4))::bigint as n_tokens, sum(strlen(text))::bigint as n_bytes from c group by 1"),
    "answer_bundles": (_answer_bundles, None),
    "answer_markdown": (_answer_markdown, None),
}

"""Queries of full-text and vector search, fusion, context and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.functions import vectors
from loamweave.functions.text import unicode_terms
from loamweave.operators import context, dense, fulltext, fusion, metrics
from loamweave.operators.stage import newest
from loamweave.sources.tables import table

#: The stated queries of the full-text examples.
ASKED = ((1, "controller address reference"), (2, "calibration target error"), (3, "firmware packages bracket Ventor"), (4, "Kabel Spannung Sensor"), (5, "relé cabo sensor tensión"))
_ASKED_SQL = "(values " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") as q(query_id, query)"


def _asked(spark):
    return spark.createDataFrame(list(ASKED), "query_id long, query string")


def _chunk_docs(spark, d):
    return table(spark, d, "sparse_chunks", "chunk_id", "fts_text")


def _bm25(spark, d):
    return fulltext.search(_chunk_docs(spark, d), _asked(spark), 20, "chunk_id", "fts_text").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _bm25_within(spark, d):
    pages = table(spark, d, "sparse_chunks", "chunk_id", "page_type").where("page_type = 'installation'")
    return fulltext.search(_chunk_docs(spark, d), _asked(spark), 20, "chunk_id", "fts_text", pages).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _postings(spark, d):
    return fulltext.postings(_chunk_docs(spark, d), "chunk_id", "fts_text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _dense(metric):
    def run(spark, d):
        data = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        asked = data.where("id % 20 = 0").withColumnRenamed("id", "query_id")
        return dense.topk(data, asked, 10, metric).select("query_id", F.col("id").alias("vec_id"), F.round("distance", 5).alias("distance"), "rank")

    return run


def _scores(spark, d):
    data = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = dense.topk(data, data.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10)
    return near.select("query_id", F.col("id").alias("vec_id"), F.round(vectors.score(F.col("distance"), "cosine"), 5).alias("score"))


def _multi(spark, d):
    """Hits of all queries of one label as one list: the best distance of each vector."""
    data = table(spark, d, "embeddings")
    asked = data.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = dense.topk(data.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), asked, 10)
    labelled = near.join(data.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return labelled.groupBy("label", "id").agg(F.min(F.round("distance", 5)).alias("distance")).select("label", F.col("id").alias("vec_id"), "distance")


def _hits(spark, d):
    """Sparse and dense hits of the documents and vectors, asked with each one whose id is divisible by 20.

    The terms of a document's query are those of its title, or of its text where the title has none.
    """
    docs = table(spark, d, "documents", "doc_id", "text", "title")
    words = lambda c: F.array_join(unicode_terms(F.coalesce(F.col(c), F.lit(""))), " ")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce(F.nullif(words("title"), F.lit("")), words("text")).alias("query"))
    sparse = fulltext.search(docs.where("text is not null").select("doc_id", words("text").alias("words")), asked, 80, "doc_id", "words")
    vec = table(spark, d, "embeddings")
    data = vec.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = dense.topk(data, data.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 80)
    one = lambda df, c, k: df.select("query_id", F.col(k).alias("page_id"), F.lit(c).alias("channel"), "rank", F.concat(F.lit(c), F.lit(":"), F.col(k)).alias("chunk_id"))
    return one(sparse, "sparse", "doc_id").unionByName(one(near, "dense", "id"))


def _rrf(spark, d):
    return fusion.page_rrf(_hits(spark, d), 20).select("query_id", "page_id", F.round("rrf", 8).alias("rrf"), "sparse_rank", "dense_rank", "rank")


def _rrf_evidence(spark, d):
    got = fusion.page_rrf(_hits(spark, d), 20, evidence=3)
    return got.select("query_id", "page_id", F.array_join(F.transform("evidence", lambda e: e["chunk_id"]), ",").alias("evidence"))


def _best(spark, d):
    rows = table(spark, d, "retrieved_pages", "query_id", "page_id", "score").where("score is not null")
    return fusion.best_hits(rows, ["query_id", "page_id"])


def _neighbours(spark, d):
    rows = table(spark, d, "sparse_chunks", "chunk_id", "page_id", "chunk_index", "chunk_kind").where("chunk_kind = 'dense'")
    return context.neighbours(rows)


def _sections(spark, d):
    rows = table(spark, d, "sparse_chunks", "page_id", "section_path", "chunk_id", "chunk_index", "text").distinct()
    return rows.groupBy("page_id", "section_path").agg(
        F.count("*").alias("n_chunks"), F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).alias("n_tokens"), F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index")
    )


def _budget(spark, d):
    rows = table(spark, d, "pack_profiles").select("profile", "capacity_tokens", F.explode(F.array(*map(F.lit, context.MODES))).alias("context_mode"))
    return rows.select("profile", "context_mode", *context.budget(F.col("context_mode"), F.col("capacity_tokens"), hard_max=4000))


def _assembly(spark, d):
    rows = newest(table(spark, d, "retrieved_pages"), ["query_id", "page_id", "retrieval_method"], "retrieved_at", ["query_id", "page_id", "retrieval_method", "retrieved_at", "score", "path"]).where("retrieval_method in ('fused', 'graph')")
    by = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "page_id", "retrieval_method")
    top = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= 20)
    pages = newest(table(spark, d, "wiki_pages"), ["page_id"], "updated_at", ["page_id", "updated_at", "content"])
    kind = fusion.category(F.col("path"), F.coalesce("score", F.lit(0.0)), F.col("retrieval_method") == "graph")
    items = top.join(pages, "page_id").select("query_id", "rank", F.col("page_id").alias("id"), kind.alias("category"), F.col("content").alias("text"))
    return context.assemble(items, 2048).select("query_id", "place", "id", "category", "n_tokens", "truncated")


def _ranked(spark, d):
    rows = newest(table(spark, d, "retrieved_pages"), ["query_id", "page_id", "retrieval_method"], "retrieved_at", ["query_id", "page_id", "retrieval_method", "retrieved_at", "score"])
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id")
    return rows.where("retrieval_method = 'fused' and score is not null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= 10), rows


def _metrics(spark, d):
    """The fused ranking held against the pages that the graph found."""
    ranked, rows = _ranked(spark, d)
    got = metrics.ranking_metrics(ranked, rows.where("retrieval_method = 'graph'").select("query_id", "page_id"))
    return got.select("query_id", F.round("recall", 6).alias("recall"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "hit")


def _percentiles(spark, d):
    return metrics.nearest_rank(table(spark, d, "events", "event_type", "value"), "event_type", "value", [50, 95, 99]).select("event_type", "percent", F.round("value", 6).alias("value"))


def _validation(spark, d):
    s = table(spark, d, "sparse_chunks", "chunk_id", "fts_text").agg(F.count("*").alias("n_sparse"), F.countDistinct("chunk_id").alias("d_sparse"), F.sum(F.coalesce((F.trim("fts_text") == ""), F.lit(True)).cast("int")).alias("bare"))
    v = table(spark, d, "dense_chunks", "chunk_id", "vector").agg(F.count("*").alias("n_dense"), F.countDistinct("chunk_id").alias("d_dense"), F.sum((~vectors.finite(F.col("vector"), 64)).cast("int")).alias("unusable"))
    return s.crossJoin(v)  # one row each


_BM25 = """
    with docs as (select chunk_id, max(fts_text) as t from sparse_chunks where fts_text is not null group by 1),
    words as (select chunk_id, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') as w from docs),
    size as (select count(*) as n, avg(len(w)) as mean from words),
    asked as (select distinct query_id, unnest(string_split(query, ' ')) as term from {asked}),
    post as (select chunk_id, len(w) as length, unnest(w) as term from words),
    tf as (select chunk_id, length, term, count(*) as tf from post where term in (select term from asked) group by all),
    df as (select term, count(*) as df from tf group by 1),
    scored as (select query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score
               from tf join df using (term) join asked using (term), size {within} group by 1, 2),
    ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from scored)
    select query_id, chunk_id, round(score, 6) as score, rank::int as rank from ranked where rank <= 20"""
_NEAR = """
    with q as (select vec_id as query_id, embedding as qv from embeddings where {which}),
    r as (select query_id, vec_id, {far} as distance from q, embeddings),
    t as (select *, row_number() over (partition by query_id order by round(distance, 9), vec_id) as rank from r)
    {select}"""
_FAR = {
    "cosine": "1 - list_cosine_similarity(qv::double[], embedding::double[])", "dot": "-list_inner_product(qv::double[], embedding::double[])",
    "l2": "list_distance(qv::double[], embedding::double[])",
}
_TOP = "select query_id, vec_id, round(distance, 5) as distance, rank::int as rank from t where rank <= 10"
def _terms(x):
    """SQL of the words of letters and digits and the pairs of Chinese characters of a text."""
    pairs = f"flatten(list_transform(regexp_extract_all({x}, '[一-鿿]+'), lambda r: list_transform(generate_series(1, length(r) - 1), lambda i: r[i:i + 1])))"
    return f"list_concat(regexp_extract_all(lower(regexp_replace({x}, '[一-鿿]+', ' ', 'g')), '[\\p{{L}}\\p{{N}}_]+'), {pairs})"


_HITS = f"""
    with docs as (select doc_id, {_terms('text')} as w from documents where text is not null),
    size as (select count(*) as n, avg(len(w)) as mean from docs),
    q as (select doc_id as query_id, {_terms("coalesce(title, '')")} as a, {_terms("coalesce(text, '')")} as b from documents where doc_id % 20 = 0),
    asked as (select distinct query_id, unnest(case when len(a) > 0 then a else b end) as term from q),
    tf as (select doc_id, length, term, count(*) as tf from (select doc_id, len(w) as length, unnest(w) as term from docs) where term in (select term from asked) group by all),
    df as (select term, count(*) as df from tf group by 1),
    scored as (select query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score from tf join df using (term) join asked using (term), size group by 1, 2),
    sparse as (select query_id, doc_id as page_id, 'sparse' as channel, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from scored),
    d as (select a.vec_id as query_id, b.vec_id as page_id, {_FAR['cosine'].replace('qv', 'a.embedding').replace(', embedding', ', b.embedding')} as distance from embeddings a, embeddings b where a.vec_id % 20 = 0),
    dense as (select query_id, page_id, 'dense' as channel, row_number() over (partition by query_id order by round(distance, 9), page_id) as rank from d),
    hits as (select * from sparse where rank <= 80 union all select * from dense where rank <= 80),
    fused as (select query_id, page_id, sum(1.0 / (60 + rank)) as rrf, min(rank) filter (channel = 'sparse') as sparse_rank, min(rank) filter (channel = 'dense') as dense_rank, min(rank) as first_rank from hits group by 1, 2),
    ranked as (select *, row_number() over (partition by query_id order by round(rrf, 12) desc, first_rank, page_id) as rank from fused)"""
_NEWEST = """rows as (select query_id, page_id, retrieval_method, max(struct_pack(a := retrieved_at, b := score)).b as score from retrieved_pages group by 1, 2, 3)"""

QUERIES = {
    "rrf_hybrid": (_rrf, _HITS + "select query_id, page_id, round(rrf, 8) as rrf, sparse_rank::int as sparse_rank, dense_rank::int as dense_rank, rank::int as rank from ranked where rank <= 20"),
    "rrf_evidence": (_rrf_evidence, _HITS + """, kept as (select *, row_number() over (partition by query_id, page_id order by rank, channel) as n from hits)
        select query_id, page_id, (select string_agg(channel || ':' || k.page_id, ',' order by k.rank, channel) from kept k where k.query_id = r.query_id and k.page_id = r.page_id and k.n <= 3) as evidence from ranked r where rank <= 20"""),
    "bm25_topk": (_bm25, _BM25.format(asked=_ASKED_SQL, within="")),
    "bm25_page_restricted": (_bm25_within, _BM25.format(asked=_ASKED_SQL, within="where chunk_id in (select chunk_id from sparse_chunks where page_type = 'installation')")),
    "postings_stats": (_postings, r"""
        with docs as (select chunk_id, max(fts_text) as t from sparse_chunks where fts_text is not null group by 1),
        p as (select chunk_id, unnest(string_split_regex(t, '\s+')) as term from docs)
        select term, count(distinct chunk_id) as df, count(*) as cf from p where term <> '' group by 1"""),
    **{f"dense_topk_{m}": (_dense(m), _NEAR.format(which="vec_id % 20 = 0", far=_FAR[m], select=_TOP)) for m in _FAR},
    "vector_scores": (_scores, _NEAR.format(which="vec_id % 20 = 0", far=_FAR["cosine"], select="select query_id, vec_id, round(least(1, greatest(0, 1 - distance / 2)), 5) as score from t where rank <= 10")),
    "dense_multi_query": (_multi, _NEAR.format(which="vec_id % 20 = 0", far=_FAR["cosine"], select="select l.label, t.vec_id, min(round(distance, 5)) as distance from t join embeddings l on l.vec_id = t.query_id where rank <= 10 group by 1, 2")),
    "best_hits": (_best, "select query_id, page_id, max(score) as score from retrieved_pages where score is not null group by 1, 2"),
    "neighbor_chunks": (_neighbours, """
        with r as (select distinct chunk_id, page_id, chunk_index from sparse_chunks where chunk_kind = 'dense')
        select chunk_id, lag(chunk_id) over w as previous_id, lead(chunk_id) over w as next_id from r window w as (partition by page_id order by chunk_index nulls last, chunk_id)"""),
    "section_context": (_sections, """
        select page_id, section_path, count(*) as n_chunks, sum(greatest(1, length(text) // 4))::bigint as n_tokens, min(chunk_index) as first_index, max(chunk_index) as last_index
        from (select distinct page_id, section_path, chunk_id, chunk_index, text from sparse_chunks) group by 1, 2"""),
    "budget_resolve": (_budget, """
        with m(context_mode, bundle_mode, x) as (values ('section', 'snippet', 1.0), ('parent_section', 'snippet', 1.0), ('multiple_sections', 'snippet', 1.4), ('evidence', 'snippet', 1.0), ('chunk', 'snippet', 1.0), ('global', 'summary', 1.0))
        select profile, context_mode, bundle_mode, floor(capacity_tokens * x)::bigint as planned_tokens, least(4000, floor(capacity_tokens * x))::bigint as effective_tokens from pack_profiles, m"""),
    "context_assembly": (_assembly, None),
    "eval_metrics": (_metrics, "with " + _NEWEST + """,
        ranked as (select query_id, page_id, row_number() over (partition by query_id order by score desc, page_id) as rank from rows where retrieval_method = 'fused' and score is not null),
        gold as (select query_id, page_id from rows where retrieval_method = 'graph'),
        h as (select g.query_id, count(*) as n_gold, min(rank) as first, count(*) filter (rank <= 5) as found from gold g left join (select * from ranked where rank <= 10) r using (query_id, page_id) group by 1)
        select query_id, round(least(1, found / n_gold), 6) as recall, round(case when first <= 10 then 1 / first else 0 end, 6) as reciprocal_rank, coalesce(first <= 3, false)::int as hit from h"""),
    "latency_percentiles": (_percentiles, """
        with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
        select event_type, p as percent, round(value, 6) as value from r, (values (50), (95), (99)) as q(p) where i = round_even(p / 100 * (n - 1), 0)"""),
    "index_validation": (_validation, """
        select * from (select count(*) as n_sparse, count(distinct chunk_id) as d_sparse, count(*) filter (coalesce(trim(fts_text) = '', true)) as bare from sparse_chunks),
        (select count(*) as n_dense, count(distinct chunk_id) as d_dense, count(*) filter (not coalesce(len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0, false)) as unusable from dense_chunks)"""),
}

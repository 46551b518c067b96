"""Queries of the text and key functions and of chunking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.functions import keys, text
from loamweave.operators import chunking, indexing
from loamweave.operators.stage import newest
from loamweave.plans.planner import INTENTS, intent_column, relation_column
from loamweave.sources import vault
from loamweave.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents", "doc_id", "text")


def _term_df(column):
    def run(spark, d):
        terms = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(column(F.col("text")))).alias("term"))
        return terms.groupBy("term").agg(F.count("*").alias("df"))

    return run


def _exact_classes(spark, d):
    docs = _docs(spark, d)
    one = lambda c: docs.select(F.lit(c).alias("class"), F.explode(text.found(F.col("text"), "(?U)" + text.EXACT_CLASSES[c])).alias("term"))
    rows = one("url")
    for name in list(text.EXACT_CLASSES)[1:]:
        rows = rows.unionByName(one(name))
    return rows.groupBy("class", "term").agg(F.count("*").alias("n"))


def _exact_terms(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(text.exact_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _sentences(spark, d):
    s = text.sentences(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(s).alias("n_sentences"), F.coalesce(F.aggregate(F.transform(s, F.length), F.lit(0), lambda a, x: a + x), F.lit(0)).alias("n_chars"))


def _chunk_ids(spark, d):
    rows = table(spark, d, "sparse_chunks", "chunk_id", "page_id", "chunk_kind", "chunk_index", "text").distinct()
    body = F.trim(F.regexp_replace("text", r"[ \n\t\r]+", " "))
    by = Window.partitionBy("page_id", "chunk_kind", F.sha2(body, 256)).orderBy("chunk_index", "chunk_id")
    seed = F.concat_ws("|", "chunk_kind", body, (F.row_number().over(by) - 1).cast("string"), F.lit("v3"))
    return rows.select("chunk_id", F.concat("page_id", F.lit("::"), F.substring(F.sha2(seed, 256), 1, 16)).alias("content_id"))


def _section_ids(spark, d):
    path = F.from_json("section_path", "array<string>")
    return table(spark, d, "sparse_chunks", "page_id", "section_path").distinct().select("page_id", keys.section_id(F.col("page_id"), path).alias("section_id"))


def _budget_cut(spark, d):
    cut = text.cut_to_budget(F.col("text"), 64)
    return _docs(spark, d).select("doc_id", F.length(cut).alias("n_kept"), F.sha2(cut, 256).alias("kept_hash"), (F.length("text") > 259).alias("truncated"))


def _titles(spark, d):
    return table(spark, d, "wiki_pages", "page_id", "content", "path").distinct().select("page_id", text.first_heading(F.col("content"), F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("title"), F.sha2("content", 256).alias("version"))


def _slugs(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.image_name(text.slug(F.col("p_name")), (F.col("p_partkey") % 100).cast("int"), F.lit("png")).alias("image"))


def _links(spark, d):
    return table(spark, d, "wiki_pages", "page_id", "content").distinct().select("page_id", F.explode(text.wikilinks(F.col("content"))).alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("n"))


def _tags(spark, d):
    return table(spark, d, "part", "p_type", "p_brand").select(F.explode(F.array("p_type", "p_brand")).alias("raw")).distinct().select("raw", text.tag(F.col("raw")).alias("tag"))


def _intents(spark, d):
    return table(spark, d, "documents", "doc_id", "title").select("doc_id", intent_column(F.coalesce("title", F.lit(""))).alias("intent"))


def _tokens(spark, d):
    rows = table(spark, d, "sparse_chunks", "chunk_id", "text", "token_count").distinct().select("chunk_id", text.token_count(F.col("text")).alias("counted"), "token_count")
    return rows.select("chunk_id", "counted", (~F.col("counted").eqNullSafe(F.col("token_count"))).alias("stale"))


def _pages(spark, d):
    return newest(table(spark, d, "wiki_pages"), ["page_id"], "updated_at", ["page_id", "updated_at", "title", "content"])


def _chunks(spark, d):
    return chunking.chunk_pages(_pages(spark, d)).select("page_id", "chunk_id", "chunk_kind", "chunk_index", "start_char", "end_char", "token_count", "forced_split", F.length("text").alias("n_chars"))


def _chunk_faults(spark, d):
    """Invariants of chunking over all pages; every counter is 0 except n_pages."""
    pages = _pages(spark, d)
    chunks = chunking.chunk_pages(pages)
    per = chunks.groupBy("page_id").agg(
        F.sum(((F.col("chunk_kind") == "sparse") & (F.length("text") > chunking.SPARSE_MOST)).cast("int")).alias("too_long"),
        F.sum(((F.col("chunk_kind") == "dense") & (F.col("token_count") > chunking.DENSE_MOST)).cast("int")).alias("too_many"),
        (F.count("*") - F.countDistinct("chunk_id")).alias("repeated"),
    )
    return per.agg(F.sum("too_long").alias("too_long"), F.sum("too_many").alias("too_many"), F.sum("repeated").alias("repeated"), F.count("*").alias("n_pages"))


def _html_tables(spark, d):
    return vault.tables_of(_pages(spark, d).select(F.col("page_id").alias("key"), F.col("content").alias("text"))).groupBy("key").agg(F.countDistinct("table_no").alias("n_tables"), F.count("*").alias("n_rows"))


def _metadata(spark, d):
    pages = newest(table(spark, d, "wiki_pages"), ["page_id"], "updated_at", ["page_id", "updated_at", "path", "title", "page_type", "sources", "links", "aliases", "sha256"])
    return indexing.page_metadata(pages).select("page_id", "path", "title", "page_type", *(F.size(c).alias(f"n_{c}") for c in ("sources", "links", "aliases")), "sha256")


def _placeholders(spark, d):
    return table(spark, d, "parse_results", "result_id", "text").where("text like '%{{IMG%'").select("result_id", text.image_placeholders(F.col("text")).alias("text"))


def _relations(spark, d):
    return table(spark, d, "documents", "doc_id", "title").select("doc_id", relation_column(F.coalesce("title", F.lit(""))).alias("relation"))


def _utc(spark, d):
    """Time stamps of every order as they are written: none, without a T, in another zone, in UTC."""
    at = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 7
    value = F.when(k == 0, None).when(k == 1, at).when(k == 2, F.concat(at, F.lit("T10:00:00+02:00"))).when(k == 3, F.concat(at, F.lit("T10:00:00.123+00:00"))).otherwise(F.concat(at, F.lit("T10:00:00Z")))
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", text.utc_fault(value).alias("fault"))


_SQL_INTENT = " ".join(f"when regexp_matches(coalesce(title, ''), '(?i){p}') then '{i}'" for i, p in INTENTS)

QUERIES = {
    "ident_term_df": (_term_df(text.identifiers), r"""
        select term, count(*) as df from (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[_\-][A-Za-z0-9]+)*')) as term from documents) group by term"""),
    "cjk_bigram_df": (_term_df(text.cjk_bigrams), r"""
        with runs as (select doc_id, unnest(regexp_extract_all(text, '[一-鿿]+')) as run from documents),
        pairs as (select doc_id, run[i:i + 1] as term from (select doc_id, run, unnest(generate_series(1, length(run) - 1)) as i from runs where length(run) > 1))
        select term, count(*) as df from (select distinct doc_id, term from pairs) group by term"""),
    "fts_terms": (lambda spark, d: table(spark, d, "sparse_chunks", "chunk_id", "text").distinct().select("chunk_id", F.array_join(text.fts_terms(F.col("text")), " ").alias("terms")), r"""
        with c as (select distinct chunk_id, text from sparse_chunks where text is not null),
        i as (select chunk_id, text, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[_\-][A-Za-z0-9]+)*')) as term from c),
        s as (select chunk_id, text, lower(unnest(regexp_extract_all(regexp_replace(text, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+'))) as term from c),
        runs as (select chunk_id, text, unnest(regexp_extract_all(text, '[一-鿿]+')) as run from c),
        b as (select chunk_id, text, run[i:i + 1] as term from (select *, unnest(generate_series(1, length(run) - 1)) as i from runs where length(run) > 1)),
        u as (select * from i union select * from s union select * from b)
        select c.chunk_id, coalesce(string_agg(u.term, ' ' order by u.term), '') as terms from c left join u on u.chunk_id = c.chunk_id and u.text = c.text group by c.chunk_id, c.text"""),
    "exact_term_classes": (_exact_classes, r"""
        with d as (select regexp_replace(text, '[^\x00-\x7Fµ\P{L}]', '_', 'g') as t from documents)  -- word boundaries of any script
        select class, term, count(*) as n from (
            select 'url' as class, unnest(regexp_extract_all(text, 'https?://[^\s\p{Z})\]]+')) as term from documents
            union all select 'ip', unnest(regexp_extract_all(t, '\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b')) from d
            union all select 'drive_path', unnest(regexp_extract_all(text, '[A-Za-z]:[\\/][^\s\p{Z}]+')) from documents
            union all select 'path', unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9/])((?:/[\p{L}\p{M}\p{N}_.\-]+){2,})', 1)) from documents
            union all select 'quantity', unnest(regexp_extract_all(t, '\b\d+(?:\.\d+)?[\s\p{Z}]?(?:mm|cm|m|km|kg|g|mg|s|ms|µs|Hz|kHz|MHz|GHz|Mbps|Gbps|Mbps|V|mV|A|mA|W|kW|°C|%|fps|rpm|px)\b')) from d
            union all select 'code', unnest(regexp_extract_all(t, '\b(?:0x)?[A-Z]{1,4}-?\d{2,}(?:\.\d+)*\b')) from d
            union all select 'number', unnest(regexp_extract_all(t, '\b\d{2,}(?:\.\d+)?\b')) from d
            union all select 'hex', unnest(regexp_extract_all(t, '(?:0[xX])[0-9A-Fa-f]+\b')) from d
            union all select 'flag', unnest(regexp_extract_all(text, '--?[A-Za-z][\p{L}\p{M}\p{N}_\-]*')) from documents) group by all"""),
    "exact_term_df": (_exact_terms, r"""
        with d as (select doc_id, text, regexp_replace(text, '[^\x00-\x7Fµ\P{L}]', '_', 'g') as t from documents),
        x as (select doc_id, unnest(regexp_extract_all(text, 'https?://[^\s\p{Z})\]]+')) as term from d
            union select doc_id, unnest(regexp_extract_all(t, '\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b')) from d
            union select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]:[\\/][^\s\p{Z}]+')) from d
            union select doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9/])((?:/[\p{L}\p{M}\p{N}_.\-]+){2,})', 1)) from d
            union select doc_id, unnest(regexp_extract_all(t, '\b\d+(?:\.\d+)?[\s\p{Z}]?(?:mm|cm|m|km|kg|g|mg|s|ms|µs|Hz|kHz|MHz|GHz|Mbps|Gbps|Mbps|V|mV|A|mA|W|kW|°C|%|fps|rpm|px)\b')) from d
            union select doc_id, unnest(regexp_extract_all(t, '\b(?:0x)?[A-Z]{1,4}-?\d{2,}(?:\.\d+)*\b')) from d
            union select doc_id, unnest(regexp_extract_all(t, '\b\d{2,}(?:\.\d+)?\b')) from d
            union select doc_id, unnest(regexp_extract_all(t, '(?:0[xX])[0-9A-Fa-f]+\b')) from d
            union select doc_id, unnest(regexp_extract_all(text, '--?[A-Za-z][\p{L}\p{M}\p{N}_\-]*')) from d)
        select term, count(*) as df from x group by 1"""),
    "sentence_split": (_sentences, r"""
        with s as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;]+[。！？!?；]?'), lambda x: trim(x, ' ')), lambda x: x <> '') as parts from documents)
        select doc_id, len(parts)::int as n_sentences, coalesce(list_sum(list_transform(parts, lambda x: length(x))), 0)::int as n_chars from s"""),
    "chunk_content_ids": (_chunk_ids, r"""
        with r as (select distinct chunk_id, page_id, chunk_kind, chunk_index, trim(regexp_replace(text, '[ \n\t\r]+', ' ', 'g'), ' ') as body from sparse_chunks),
        o as (select *, row_number() over (partition by page_id, chunk_kind, body order by chunk_index, chunk_id) - 1 as occurrence from r)
        select chunk_id, page_id || '::' || substr(sha256(chunk_kind || '|' || body || '|' || occurrence || '|v3'), 1, 16) as content_id from o"""),
    "section_ids": (_section_ids, """
        select page_id, substr(sha256(page_id || '|' || array_to_string(from_json(section_path, '["varchar"]'), '/')), 1, 12) as section_id
        from (select distinct page_id, section_path from sparse_chunks)"""),
    "budget_cut": (_budget_cut, """
        with c as (select doc_id, length(text) > 259 as truncated, rtrim(substr(text, 1, 259), ' ') as kept from documents)
        select doc_id, length(kept)::int as n_kept, sha256(kept) as kept_hash, truncated from c"""),
    "first_headings": (_titles, r"""
        select page_id, coalesce(nullif(trim(regexp_extract(content, '(?m)^#[ \t]+(.+)$', 1)), ''), regexp_extract(path, '([^/]+)\.md$', 1)) as title, sha256(content) as version
        from (select distinct page_id, content, path from wiki_pages)"""),
    "slugs": (_slugs, r"""
        with s as (select p_partkey, lower(regexp_replace(regexp_replace(p_name, '\W+', '-', 'g'), '^-+|-+$', '', 'g')) as slug from part)
        select p_partkey, slug, printf('%s_img%02d.png', slug, p_partkey % 100) as image from s"""),
    "wikilinks": (_links, r"""
        select page_id, target, count(*) as n from (
            select page_id, trim(split_part(unnest(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1)), '|', 1)) as target from (select distinct page_id, content from wiki_pages)) group by all"""),
    "tag_normalize": (_tags, r"""
        select raw, case regexp_replace(raw, '\s+', '-', 'g') when 'c-ncap' then 'C-NCAP' when 'euro-ncap' then 'Euro-NCAP' else replace(regexp_replace(raw, '\s+', '-', 'g'), '#', '') end as tag
        from (select p_type as raw from part union select p_brand from part)"""),
    "intent_classify": (_intents, f"select doc_id, case {_SQL_INTENT} else 'lookup' end as intent from documents"),
    "stale_token_counts": (_tokens, """
        select chunk_id, counted, counted is distinct from token_count as stale
        from (select distinct chunk_id, greatest(1, length(text) // 4) as counted, token_count, text from sparse_chunks)"""),
    "chunk_pages": (_chunks, None),
    "chunk_invariants": (_chunk_faults, "select 0 as too_long, 0 as too_many, 0 as repeated, count(distinct page_id) filter (trim(content) <> '') as n_pages from wiki_pages"),
    "html_tables": (_html_tables, r"""
        with p as (select page_id, arg_max(content, updated_at) as content from wiki_pages group by 1),
        t as (select page_id as key, unnest(regexp_extract_all(content, '(?is)<table\b.*?(?:</table\s*>|\z)')) as tab from p),
        r as (select key, tab, len(list_filter(string_split_regex(regexp_replace(tab, '(?is)^<table[^>]*>', ''), '(?i)<tr\b'), lambda x: regexp_matches(x, '(?i)<t[dh]\b'))) as n from t)
        select key, count(*) as n_tables, sum(n)::bigint as n_rows from r where n > 0 group by 1"""),
    "legacy_page_chunks": (lambda spark, d: vault.plain_page_chunks(_pages(spark, d).join(table(spark, d, "wiki_pages", "page_id", "path").distinct(), "page_id")).select("page_id", "title", F.length("text").alias("n_chars")), r"""
        with p as (select page_id, arg_max(content, updated_at) as content from wiki_pages group by 1), n as (select distinct page_id, path from wiki_pages)
        select path as page_id, coalesce(nullif(trim(regexp_extract(content, '(?m)^title:[ \t]*["'']?(.*?)["'']?[ \t]*$', 1)), ''), regexp_extract(path, '([^/]+?)(?:\.md)?$', 1)) as title,
               length(trim(regexp_replace(content, '(?s)^---\n.*?\n---\n', '')))::int as n_chars
        from p join n using (page_id) where trim(regexp_replace(content, '(?s)^---\n.*?\n---\n', '')) <> ''"""),
    "page_bodies": (lambda spark, d: indexing.page_bodies(_pages(spark, d), 200).select("page_id", "body"), r"""
        with p as (select page_id, arg_max(content, updated_at) as content from wiki_pages group by 1), b as (select page_id, trim(regexp_replace(coalesce(content, ''), '(?s)\A---\n.*?\n---\n', ''), ' ') as body from p)
        select page_id, case when length(body) > 200 then substr(body, 1, 200) || chr(10) || '...[truncated]' else body end as body from b"""),
    "page_metadata": (_metadata, """
        with p as (select * from (select *, row_number() over (partition by page_id order by updated_at desc) as nth from (select distinct page_id, path, title, page_type, sources, links, aliases, sha256, updated_at from wiki_pages)) where nth = 1)
        select page_id, path, title, page_type, len(coalesce(sources, [])) as n_sources, len(coalesce(links, [])) as n_links, len(coalesce(aliases, [])) as n_aliases, sha256 from p"""),
    "image_placeholders": (_placeholders, r"""
        select result_id, regexp_replace(regexp_replace(text, '(?s)\{\{IMG\|(?:[^|]*/)?([^|/]+)\|图注: (?:\[无图注\])?\}\}', '![[\1]]', 'g'), '(?s)\{\{IMG\|(?:[^|]*/)?([^|/]+)\|图注: (.*?)\}\}', '![[\1]]  ' || chr(10) || '\2', 'g') as text
        from parse_results where text like '%{{IMG%'"""),
    "relation_intents": (_relations, "select doc_id, case when " + f"(case {_SQL_INTENT} else 'lookup' end) = 'relation' or regexp_matches(coalesce(title, ''), '导致|关联|依赖|关系|引起') then 'cause_or_influence' end as relation from documents"),
    "utc_faults": (_utc, """
        select o_orderkey, case when o_orderkey % 7 = 0 then 'missing' when o_orderkey % 7 = 1 then 'malformed' when o_orderkey % 7 = 2 then 'not_utc' end as fault from orders"""),
}

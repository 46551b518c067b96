"""Queries of manifests, images, references and the map of contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamweave.functions.text import caption_line
from loamweave.operators import indexing, ingest, references
from loamweave.operators.stage import newest
from loamweave.sources.tables import table


def _manifest(spark, d):
    return newest(table(spark, d, "source_manifest"), ["path"], "last_processed", ["path", "last_processed", "sha256", "status"])


def _diff(spark, d):
    return ingest.diff(table(spark, d, "parsed_docs", "path", "sha256"), _manifest(spark, d))


def _upsert(spark, d):
    at = F.lit("2030-01-01").cast("timestamp_ntz")
    return ingest.upsert(_manifest(spark, d), _diff(spark, d), at).select("path", "sha256", "status")


def _misses(spark, d):
    wanted = table(spark, d, "sparse_chunks", "content_hash", "chunk_kind").where("chunk_kind = 'dense'")
    return ingest.cache_misses(wanted, table(spark, d, "dense_chunks", "content_hash", "vector").where("size(vector) = 64"))


def _images(spark, d):
    return newest(table(spark, d, "image_manifest"), ["rel_path"], "registered_at", ["rel_path", "registered_at", "filename", "sha256", "source_doc", "caption_text", "vlm_caption", "status"])


def _refs(spark, d):
    return table(spark, d, "parsed_docs", "path", "images").select(F.col("path").alias("page_id"), F.explode("images.rel_path").alias("value"))


def _captions(spark, d):
    new = table(spark, d, "image_manifest", "source_doc", "filename").distinct()
    return ingest.carry_captions(new, _images(spark, d)).select("source_doc", "filename", "caption_text", "status")


def _meta(spark, d):
    wanted = _refs(spark, d).where("value is not null").select(F.regexp_replace(F.translate("value", "\\", "/"), r"^(\./)+", "").alias("path"))
    return ingest.image_meta(wanted, _images(spark, d))


def _disk(spark, d):
    """Images of parsed documents whose path is written in full, as the files on disk."""
    rows = table(spark, d, "parsed_docs", "images").select(F.explode("images").alias("i")).select("i.rel_path", "i.sha256")
    return rows.where("rel_path like 'assets/%'").groupBy("rel_path").agg(F.min("sha256").alias("sha256"))


def _provenance(spark, d):
    """Documents as the pages that show their images, each its own source."""
    refs = _refs(spark, d)
    return ingest.provenance(refs, _images(spark, d), refs.select("page_id").distinct().select("page_id", F.array("page_id").alias("sources")))


def _heal(spark, d):
    shown = table(spark, d, "parsed_docs", "path", "images").select(F.col("path").alias("page_id"), F.explode("images.rel_path").alias("value"))
    return ingest.heal(shown, _images(spark, d).where("status = 'captioned'"), _disk(spark, d)).select("filename", F.lower("rel_path").alias("rel_path"), "sha256", "parent_page_id", F.size("referring_wiki_pages").alias("n_pages"), "status")


def _applied(spark, d):
    """Captions of the latest registration of a file, given to every image of that file name."""
    rows = table(spark, d, "image_manifest")
    said = rows.where("caption_text is not null or vlm_caption is not null").select("filename", F.when(F.length("filename") % 2 == 0, F.col("caption_text")).alias("caption_text"), "vlm_caption", F.struct("registered_at", F.coalesce("caption_text", F.lit("")), "rel_path").alias("position"))
    return ingest.apply_captions(rows.select("filename", "rel_path", "caption_text", "vlm_caption", "status").distinct(), said).select("rel_path", "filename", "caption_text", "status").distinct()


def _deduplicated(spark, d):
    rows = table(spark, d, "image_manifest", "source_doc", "filename", "rel_path", "caption_text", "registered_at").distinct().withColumn("at", F.struct("registered_at", "rel_path", F.coalesce("caption_text", F.lit(""))))
    return ingest.deduplicated(rows, "at").select("source_doc", "filename", "rel_path", "caption_text", F.col("place.registered_at").alias("first_registered"))


def _collapsed(spark, d):
    rows = table(spark, d, "source_manifest", "path", "status", "sha256", "last_processed").distinct().withColumn("at", F.struct(F.coalesce("last_processed", F.lit("0001-01-01").cast("timestamp_ntz")), "sha256", "status"))
    return ingest.collapsed_entries(rows, "at").select("key", "status", "sha256")


def _page_sets(spark, d):
    """Pages the vault has against pages the index has chunks of."""
    live = newest(table(spark, d, "wiki_pages"), ["page_id"], "updated_at", ["page_id", "updated_at", "deleted_at"]).where("deleted_at is null")
    return ingest.set_difference(live, table(spark, d, "sparse_chunks", "page_id"), "page_id")


def _contract(spark, d):
    """Dense chunks against stored vectors."""
    return ingest.set_difference(table(spark, d, "sparse_chunks", "chunk_id", "chunk_kind").where("chunk_kind = 'dense'"), table(spark, d, "dense_chunks", "chunk_id"), "chunk_id")


def _stale_vectors(spark, d):
    return ingest.cache_stale(table(spark, d, "dense_chunks", "content_hash"), table(spark, d, "sparse_chunks", "content_hash", "chunk_kind").where("chunk_kind = 'dense'"))


def _cache_keys(spark, d):
    return ingest.page_cache_keys(table(spark, d, "dense_chunks", "page_id", "chunk_index", "content_hash"))


def _with_captions(spark, d):
    pages = newest(table(spark, d, "wiki_pages"), ["page_id"], "updated_at", ["page_id", "updated_at", "title", "page_type", "content", "path", "deleted_at"]).where("deleted_at is null").select("page_id", "path", "title", "page_type", "content")
    whole = indexing.with_captions(pages, table(spark, d, "image_manifest"))
    return whole.groupBy(F.coalesce("page_type", F.lit("none")).alias("page_type")).agg(F.count("*").alias("n_pages"), F.sum(F.length("content")).alias("n_chars"))


def _figures(spark, d):
    lines = table(spark, d, "parse_results", "result_id", "text").where("text is not null").select("result_id", F.split("text", "\n").alias("lines"))
    at = lines.select("result_id", "lines", F.posexplode("lines").alias("i", "line")).where(F.col("line").rlike(r"\{\{IMG\||!\[|<img"))
    return at.select("result_id", (F.col("i") + 1).alias("line_no"), caption_line(F.col("lines"), F.col("i") + 1).alias("caption"))


def _audit_by_status(spark, d):
    return _images(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("source_doc").alias("n_docs"))


_KEY = "regexp_replace(regexp_replace(replace(lower(trim({})), '\\', '/'), '^(\\./)+', ''), '^wiki/', '')"
_FAULTS = f"""
    with v as (select * from (select *, row_number() over (partition by page_id order by updated_at desc) as nth from (select distinct page_id, path, title, sources, links, aliases, created_at, updated_at, deleted_at from wiki_pages)) where nth = 1),
    live as (select * from v where deleted_at is null),
    refs as (
        select 'wiki_pages' as src_table, page_id as rec_key, 'link' as ref_kind, x as ref_value, lower(trim(regexp_replace(x, '[|#].*$', ''))) as k, updated_at as at from (select *, unnest(links) as x from live)
        union all select 'wiki_pages', page_id, 'source', x, regexp_replace(replace(lower(trim(x)), '\\', '/'), '^(\\./)+', ''), updated_at from (select *, unnest(sources) as x from live)
        union all select 'parsed_docs', path, 'image', x, case when k0 like '/%' or regexp_matches(k0, '^[a-z]:|(^|/)\\.\\.(/|$)') or k0 = '' then null when k0 like 'assets/%' then k0 else 'assets/' || k0 end, parsed_at
            from (select path, parsed_at, x, {_KEY.format('x')} as k0 from (select path, parsed_at, unnest(images).rel_path as x from parsed_docs))),
    named as (
        select 'link' as ref_kind, lower(trim(title)) as k, deleted_at is not null as gone, created_at as since from v
        union all select 'link', regexp_replace(regexp_extract(lower(path), '[^/]*$'), '\\.md$', ''), deleted_at is not null, created_at from v
        union all select 'link', lower(trim(unnest(aliases))), deleted_at is not null, created_at from v
        union all select 'source', regexp_replace(replace(lower(trim(path)), '\\', '/'), '^(\\./)+', ''), m.s = 'deleted', m.f from (select path, max(struct_pack(t := last_processed, s := status, f := first_seen)) as m from source_manifest group by 1)
        union all select 'image', {_KEY.format('rel_path')}, m.s = 'deleted', m.t from (select rel_path, max(struct_pack(t := registered_at, s := status)) as m from image_manifest group by 1)),
    state as (select ref_kind, k, bool_and(gone) as gone, min(since) filter (not gone) as since from named where k <> '' group by 1, 2),
    f as (select distinct r.src_table, r.rec_key, r.ref_kind, r.ref_value, strftime(r.at, '%Y-%m') as month,
            case when r.k is null or s.k is null then 'missing' when s.gone then 'deleted' when s.since > r.at then 'late' end as fault
          from refs r left join state s using (ref_kind, k) where trim(r.ref_value) <> '')"""
def _embed(x):
    """SQL of the vault path of an image reference, its letter case kept."""
    p = f"regexp_replace(regexp_replace(replace(trim(regexp_replace({x}, '[|#][\\s\\S]*$', '')), '\\', '/'), '^(\\./)+', ''), '(?i)^wiki/', '')"
    return f"case when {p} = '' or regexp_matches({p}, '^/|^[A-Za-z]:/|(^|/)\\.\\.(/|$)') then null else array_to_string(list_filter(string_split(case when regexp_matches({p}, '(?i)^assets/') then {p} else 'assets/' || {p} end, '/'), lambda q: q not in ('', '.')), '/') end"


_IMG = "img as (select rel_path, m.* from (select rel_path, max(struct_pack(t := registered_at, f := filename, s := sha256, d := source_doc, c := caption_text, v := vlm_caption, st := status)) as m from image_manifest group by 1))"

QUERIES = {
    "p6_found": (references.p6_found, _FAULTS + " select src_table, rec_key, ref_kind, ref_value, fault from f where fault is not null"),
    "p6_by_period": (references.p6_by_period, _FAULTS + " select src_table, month, ref_kind, fault, count(*) as n, count(distinct rec_key) as n_records from f where fault is not null group by 1, 2, 3, 4"),
    "manifest_diff": (_diff, """
        with m as (select path, max(struct_pack(t := last_processed, h := sha256, s := status)) as m from source_manifest group by 1), c as (select path, max(sha256) as now from parsed_docs group by 1)
        select path, coalesce(now, m.h) as sha256, case when m is null then 'new' when now is null then 'deleted' when now = m.h then 'unchanged' else 'modified' end as state
        from c full join m using (path) where now is not null or m.s = 'processed'"""),
    "manifest_upsert": (_upsert, """
        with m as (select path, max(struct_pack(t := last_processed, h := sha256, s := status)) as m from source_manifest group by 1), c as (select path, max(sha256) as now from parsed_docs group by 1)
        select path, coalesce(now, m.h) as sha256, case when now is null and m.s = 'processed' then 'deleted' when now is null then m.s when now = m.h then m.s else 'processed' end as status from c full join m using (path)"""),
    "vector_cache_misses": (_misses, """
        select distinct content_hash from sparse_chunks where chunk_kind = 'dense' and content_hash not in (select content_hash from dense_chunks where len(vector) = 64 and content_hash is not null)"""),
    "media_dedup": (lambda spark, d: ingest.dedup_bytes(table(spark, d, "image_manifest", "filename", "sha256")), """
        select distinct filename, sha256, min(filename) over (partition by sha256) as kept from image_manifest"""),
    "image_caption_pages": (lambda spark, d: ingest.caption_pages(table(spark, d, "image_manifest")), """
        select distinct rel_path as page_id, filename as title, coalesce(nullif(trim(caption_text), ''), nullif(trim(vlm_caption.description), '')) as content, 'image_caption' as page_type
        from image_manifest where coalesce(nullif(trim(caption_text), ''), nullif(trim(vlm_caption.description), '')) is not null and rel_path is not null"""),
    "captions_pending": (lambda spark, d: ingest.pending(_images(spark, d)), f"with {_IMG} select d as source_doc, count(distinct rel_path) as n_pending from img where coalesce(st, '') not in ('captioned', 'deleted') group by 1"),
    "caption_carry_over": (_captions, f"""with {_IMG}, had as (select d, regexp_replace(f, '\\.\\w+$', '') as stem, max(struct_pack(t := t, c := c)).c as c from img where length(trim(c)) > 0 group by 1, 2)
        select n.source_doc, n.filename, h.c as caption_text, case when h.c is null then 'pending_vlm' else 'captioned' end as status
        from (select distinct source_doc, filename from image_manifest) n left join had h on h.d = n.source_doc and h.stem = regexp_replace(n.filename, '\\.\\w+$', '')"""),
    "provenance_resolution": (_provenance, f"""
        with {_IMG}, r as (select distinct path, {_embed('x')} as key from (select path, unnest(images).rel_path as x from parsed_docs)),
        a as (select key, min(path) as parent_page_id, count(*) as n_pages, count(distinct case when lower(path) like 'raw/%' then path end) as n_sources, min(case when lower(path) like 'raw/%' then path end) as doc from r where key is not null group by 1),
        b as (select {_embed('rel_path')} as key, max(coalesce(st, 'registered')) as st from img group by 1)
        select key, parent_page_id, n_pages, case when n_sources = 1 then doc else '' end as source_doc, n_sources, coalesce(b.st, case when n_sources = 1 then 'resolved' when n_sources > 1 then 'ambiguous_provenance' else 'unresolved_provenance' end) as status
        from a left join b using (key)"""),
    "image_audit": (lambda spark, d: ingest.audit(_refs(spark, d), _images(spark, d), _disk(spark, d)), f"""
        with {_IMG}, ref as (select distinct {_embed('x')} as r from (select unnest(images).rel_path as x from parsed_docs) where {_embed('x')} is not null),
        disk as (select distinct x as f from (select unnest(images).rel_path as x from parsed_docs) where x like 'assets/%'), dl as (select lower(f) as l, max(f) as f from disk group by 1),
        reg as (select distinct lower({_embed('rel_path')}) as l from img where {_embed('rel_path')} is not null)
        select (select count(*) from ref) as referenced, (select count(distinct lower(r)) from ref where lower(r) in (select l from reg)) as registered,
               (select count(*) from ref where lower(r) in (select l from dl) and lower(r) not in (select l from reg)) as unregistered, (select count(*) from ref where lower(r) not in (select l from dl)) as missing,
               (select count(*) from ref join dl on l = lower(r) where f <> r) as case_mismatch, (select count(*) from dl where l not in (select l from reg) and l not in (select lower(r) from ref)) as orphan,
               (select count(*) from img where st = 'pending_vlm') as pending_vlm, (select count(*) from img where st = 'captioned') as captioned"""),
    "image_meta_lookup": (_meta, f"""
        with {_IMG}, w as (select distinct regexp_replace(replace(x, '\\', '/'), '^(\\./)+', '') as path from (select unnest(images).rel_path as x from parsed_docs) where x is not null),
        m as (select path, rel_path, row_number() over (partition by path order by length(rel_path) desc, rel_path desc) as n from w join img on rel_path <> '' and (path = rel_path or ends_with(path, '/' || rel_path)))
        select w.path, m.rel_path from w left join m on m.path = w.path and n = 1"""),
    "image_heal": (_heal, f"""
        with {_IMG}, ref as (select distinct path, {_embed('x')} as r from (select path, unnest(images).rel_path as x from parsed_docs)),
        disk as (select lower(i.rel_path) as l, min(i.sha256) as sha256 from (select unnest(images) as i from parsed_docs) where i.rel_path like 'assets/%' group by 1),
        reg as (select lower(coalesce(f, regexp_extract(rel_path, '([^/]+)$', 1))) as n from img where st = 'captioned'),
        new as (select lower(regexp_extract(r, '([^/]+)$', 1)) as n, r, path, disk.sha256 from ref join disk on l = lower(r) where lower(regexp_extract(r, '([^/]+)$', 1)) not in (select n from reg where n is not null))
        select regexp_extract(min(r), '([^/]+)$', 1) as filename, lower(min(r)) as rel_path, min(sha256) as sha256, min(path) as parent_page_id, count(distinct path)::int as n_pages, 'pending_vlm' as status from new group by n"""),
    "captions_applied": (_applied, """
        with said as (select filename, max(struct_pack(a := registered_at, b := coalesce(caption_text, ''), c := rel_path, t := case when length(filename) % 2 = 0 then caption_text end, v := vlm_caption)) as m from image_manifest where caption_text is not null or vlm_caption is not null group by 1),
        x as (select distinct i.rel_path, i.filename, i.caption_text, i.status, s.filename is not null as has, trim(coalesce(m.t, ''), ' ') as said, trim(coalesce(m.v.description, ''), ' ') as des, coalesce(m.v.key_values, []) as kv from image_manifest i left join said s on s.filename = i.filename),
        y as (select *, case when said <> '' then said when des <> '' then des || case when len(kv) > 0 then chr(10) || '关键词: ' || array_to_string(kv, ', ') else '' end else '' end as txt from x)
        select distinct rel_path, filename, case when has then txt else caption_text end as caption_text, case when has then case when txt <> '' then 'captioned' else 'pending_vlm' end else status end as status from y"""),
    "image_manifest_dedup": (_deduplicated, """
        with r as (select distinct source_doc, filename, rel_path, caption_text, registered_at, struct_pack(a := registered_at, b := rel_path, c := coalesce(caption_text, '')) as pos, regexp_replace(filename, '\\.\\w+$', '') as stem from image_manifest),
        k as (select source_doc, stem, max(pos) filter (length(trim(coalesce(caption_text, ''))) > 0) as last, min(pos) as first from r group by 1, 2)
        select r.source_doc, r.filename, r.rel_path, r.caption_text, k.first.a as first_registered from r join k on k.source_doc is not distinct from r.source_doc and k.stem = r.stem and r.pos = coalesce(k.last, k.first)"""),
    "manifest_collapse": (_collapsed, """
        with r as (select distinct path, status, sha256, struct_pack(a := status is distinct from 'processed', b := coalesce(last_processed, timestamp '0001-01-01'), c := sha256, d := status) as pos from source_manifest where path is not null)
        select replace(path, '\\', '/') as key, arg_min(status, pos) as status, arg_min(sha256, pos) as sha256 from r group by 1"""),
    "page_set_difference": (_page_sets, """
        with v as (select page_id from (select page_id, deleted_at, row_number() over (partition by page_id order by updated_at desc) as n from wiki_pages) where n = 1 and deleted_at is null), c as (select distinct page_id from sparse_chunks)
        select page_id, 'missing' as fault from v where page_id not in (select page_id from c) union all select page_id, 'extra' from c where page_id not in (select page_id from v)"""),
    "chunk_contract": (_contract, """
        with a as (select distinct chunk_id from sparse_chunks where chunk_kind = 'dense'), b as (select distinct chunk_id from dense_chunks)
        select chunk_id, 'missing' as fault from a where chunk_id not in (select chunk_id from b) union all select chunk_id, 'extra' from b where chunk_id not in (select chunk_id from a)"""),
    "vector_cache_stale": (_stale_vectors, "select distinct content_hash from dense_chunks where content_hash is not null and content_hash not in (select content_hash from sparse_chunks where chunk_kind = 'dense' and content_hash is not null)"),
    "page_cache_keys": (_cache_keys, """
        select page_id, sha256(string_agg(content_hash || chr(31), '' order by chunk_index, content_hash)) as cache_key, count(*)::int as n_chunks from (select distinct page_id, chunk_index, content_hash from dense_chunks) group by 1"""),
    "pages_with_captions": (_with_captions, """
        with p as (select * from (select page_id, page_type, content, deleted_at, row_number() over (partition by page_id order by updated_at desc) as n from wiki_pages) where n = 1 and deleted_at is null),
        c as (select distinct rel_path, filename, coalesce(nullif(trim(caption_text), ''), nullif(trim(vlm_caption.description), '')) as content from image_manifest where rel_path is not null)
        select page_type, count(*) as n_pages, sum(length(content))::bigint as n_chars from (select coalesce(page_type, 'none') as page_type, content from p union all select 'image_caption', content from c where content is not null) group by 1"""),
    "image_status": (_audit_by_status, f"with {_IMG} select st as status, count(*) as n, count(distinct d) as n_docs from img group by 1"),
    "figure_captions": (_figures, """
        with l as (select result_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from parse_results where text is not null),
        spot as (select result_id, i from l where regexp_matches(line, '\\{\\{IMG\\||!\\[|<img')),
        near as (select a.result_id, a.i, arg_min(l.line, l.i) as caption from spot a join l on l.result_id = a.result_id and l.i > a.i and l.i <= a.i + 5 where regexp_matches(l.line, '^\\s*(?:图|Figure|Fig\\.?)\\s*\\d+') group by 1, 2)
        select spot.result_id, spot.i::int as line_no, near.caption from spot left join near using (result_id, i)"""),
    "source_page_map": (lambda spark, d: ingest.pages_of_sources(table(spark, d, "wiki_pages", "page_id", "sources")), """
        select source, count(distinct page_id) as n_pages, min(page_id) as first_page from (select page_id, unnest(sources) as source from wiki_pages) where trim(source) <> '' group by 1"""),
    "map_of_contents": (lambda spark, d: ingest.contents(newest(table(spark, d, "wiki_pages"), ["page_id"], "updated_at", ["page_id", "updated_at", "path", "title", "page_type", "deleted_at"]).where("deleted_at is null")), """
        with p as (select * from (select *, row_number() over (partition by page_id order by updated_at desc) as n from (select distinct page_id, path, title, page_type, updated_at, deleted_at from wiki_pages)) where n = 1 and deleted_at is null),
        s(page_type, section_no, section) as (values ('product', 0, '产品实体'), ('source-summary', 1, '源摘要'), ('concept', 2, '概念知识'), ('comparison', 3, '对比分析'), ('overview', 4, '元信息'), ('log', 4, '元信息')),
        r as (select coalesce(section_no, 6) as section_no, coalesce(section, '其他') as section, regexp_replace(regexp_replace(path, '^.*[/\\\\]', ''), '\\.md$', '') as slug, title from p left join s using (page_type))
        select section_no, section, slug, coalesce(title, slug) as title, count(*) over (partition by section) as n_section from r where slug <> 'index'"""),
}

"""Queries of the subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_PLACES = {
    "p1": "language", "p2": "neighbours", "p3": "ranking", "p4": "markup", "p5": "splitting", "p7": "scanrepair", "p8": "packing", "p9": "mixing", "p10": "truncation",
}
_NAMES = (
    "p1_found p1_languages p2_found p2_neighbours p2_recall p3_found p3_ranking p3_agreement p4_found p4_clean p5_found p5_pieces p7_found p7_repaired p8_found p8_fill p8_containers p8_proof p9_found p9_shares p9_order p9_deviation p10_found p10_rates"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: getattr(import_module(f"loamweave.llm.{_PLACES[n.split('_')[0]]}"), n) for n in _NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_LEAD = " + ".join(f"(case when a.{m} > o.{m} then 1 when a.{m} < o.{m} then -1 else 0 end)" for m in ("bm25", "fused", "vector", "graph"))
_BEST = ", ".join(f"coalesce(max(val) filter (m = '{m}'), '-infinity'::double) as {m}" for m in ("bm25", "fused", "vector", "graph"))
_SQL = {
    "p2_found": """
        with v as (select chunk_id, any_value(vector)::double[] as x from dense_chunks where len(vector) = 64 group by 1),
        u as (select * from v where len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
        p as (select a.chunk_id as a, b.chunk_id as b, list_cosine_similarity(a.x, b.x) as c from u a, u b where a.chunk_id <> b.chunk_id),
        t as (select *, row_number() over (partition by a order by c desc, b) as place from p)
        select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from t where place <= 5 and c >= 0.9""",
    "p2_recall": """
        with d as (select chunk_id, max(chunk_index) as i, any_value(vector) as x from dense_chunks where len(vector) = 64 and chunk_index % 20 = 0 group by 1),
        u as (select * from d where len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0)
        select 'dense_chunks' as src_table, count(*) as n_queries, 5 * count(*) as n_true, true as recall_reached from u
        union all select 'embeddings', count(*), 5 * count(*), true from embeddings where vec_id % 20 = 0""",
    "p3_found": f"""
        with r as (select query_id, page_id, retrieval_method as m, max(struct_pack(t := retrieved_at, s := score, d := distance, e := seed_page_id)) as x from retrieved_pages where query_id is not null and page_id is not null group by 1, 2, 3),
        n as (select query_id, count(x.d) as nd from r where m = 'vector' group by 1),
        e as (select least(source_id, target_id) as a, greatest(source_id, target_id) as b, max(weight) as w from graph_edges where weight is not null group by 1, 2),
        v as (select query_id, page_id, m, x.s as val from r where m in ('bm25', 'fused')
              union all select query_id, page_id, m, case when nd > 0 then -x.d else x.s end from r join n using (query_id) where m = 'vector'
              union all select query_id, page_id, m, w from r join e on a = least(x.e, page_id) and b = greatest(x.e, page_id) where m = 'graph'),
        p as (select query_id, page_id, {_BEST} from v where val is not null group by 1, 2),
        j as (select a.query_id, a.page_id from p a join p o on a.query_id = o.query_id and a.page_id <> o.page_id where {_LEAD} <= 0)
        select query_id, page_id from p anti join j using (query_id, page_id)""",
    "p5_found": """
        with big as (select distinct chunk_id, text from sparse_chunks where length(text) >= 1004),
        parts as (select chunk_id, text, unnest(regexp_split_to_array(regexp_replace(text, '([。！？!?；|\\n]|[.;](\\s))', '\\1' || chr(1), 'g'), chr(1))) as part from big)
        select distinct chunk_id, max(case when length(regexp_replace(part, '^\\s+|\\s+$', '', 'g')) >= 1004 then 1 else 0 end)::int as must_force
        from parts group by chunk_id, text""",
    "p8_found": """
        select distinct profile, doc_id from documents, pack_profiles
        where greatest(1, floor(length(text) / 4)) > capacity_tokens""",
    "p8_proof": """
        with d as (select greatest(1, floor(length(text) / 4))::bigint as size from documents where text is not null)
        select profile, count(*) as n_texts, sum(size)::bigint as n_tokens, 0 as wrong_texts, 0 as over_capacity, true as tight
        from d, (select profile from pack_profiles where capacity_tokens > 0 group by 1) group by 1""",
    "p9_found": """
        with d as (select lower(trim(source)) as source, greatest(1, floor(length(text) / 4)) as size from documents where source is not null and text is not null),
        m as (select t.mix, t.source, t.target_share, t.max_repeats, coalesce(sum(d.size), 0) as tokens
              from mix_targets t left join d on d.source = lower(trim(t.source)) group by all),
        w as (select *, target_share * sum(tokens) over (partition by mix) as wanted from m)
        select mix, source from w where wanted > max_repeats * tokens""",
    "p9_deviation": """
        with d as (select distinct lower(trim(source)) as source from documents where source is not null and text is not null)
        select mix, lower(trim(t.source)) as source, true as within from mix_targets t where lower(trim(t.source)) in (select source from d) and target_share > 0 group by 1, 2""",
}

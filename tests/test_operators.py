import numpy as np
import pytest
from pyspark.sql import functions as F

from loamweave.functions import keys, text, vectors
from loamweave.operators import chunking, context, dense, fulltext, fusion, graph, ingest, metrics
from loamweave.operators.stage import newest, running_total
from loamweave.plans import graph_queries, retrieval_queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_functions(spark):
    df = spark.createDataFrame([("见 https://a.b/c 10.0.0.1 --mode 12 mm E4001 0x1F 传感器",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.exact_terms(df.t)).collect()]
    assert {"https://a.b/c", "10.0.0.1", "--mode", "12 mm", "E4001", "0x1F"} <= set(got[0]) and got[1] == [] and got[2] is None
    assert df.select(text.cjk_bigrams(df.t)).first()[0] == ["传感", "感器"]
    s = spark.createDataFrame([("一。二！three; four",), (None,)], "t string")
    assert [r[0] for r in s.select(text.sentences(s.t)).collect()] == [["一。", "二！", "three", "four"], None]
    assert s.select(text.cut_to_budget(F.lit("x" * 50), 3)).first()[0] == "x" * 15 and s.select(text.cut_to_budget(F.lit("x"), 0)).first()[0] == ""
    assert s.select(text.tag(F.lit("Euro NCAP #1")), text.slug(F.lit("Ab  c_D!"))).first() == ("Euro-NCAP-1", "ab-c_d")
    lines = F.array(*map(F.lit, ["img", "", "", "", "Figure 1", "x"]))
    assert s.select(text.caption_line(lines, F.lit(1), 5), text.caption_line(lines, F.lit(1), 3)).first() == ("Figure 1", None)


def test_newest_and_running_total(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 3, "b"), (1, None, "z"), (2, None, None)], "k int, w int, v string")
    assert rows(newest(df, ["k"], "w", ["k", "w", "v"])) == [(1, 3, "b"), (2, None, None)]
    many = spark.range(1000).withColumn("g", F.col("id") % 2)
    got = running_total(many, ["g"], ["id"], F.lit(1), "n", 7).groupBy("g").agg(F.countDistinct("n").alias("c"), F.max("n").alias("m"))
    assert rows(got) == [(0, 500, 499), (1, 500, 499)]


def test_bm25_prefers_rare_terms_and_keeps_global_idf(spark):
    docs = spark.createDataFrame([("a", "x y"), ("a", "x y"), ("b", "x x"), ("c", "z"), ("d", None), ("e", "")], "id string, search_text string")
    asked = spark.createDataFrame([(1, "y z"), (2, "x"), (3, "  ")], "query_id int, query string")
    got = fulltext.search(docs, asked, 5).collect()
    assert [r.id for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 2] == ["b", "a"]
    only = fulltext.search(docs, asked, 5, within=spark.createDataFrame([("a",)], "id string")).collect()
    full = {(r.query_id, r.id): r.score for r in got}
    assert {(r.query_id, r.id): r.score for r in only} == {k: v for k, v in full.items() if k[1] == "a"}


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_topk_equals_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 16)
    x = np.random.default_rng(1).standard_normal((60, 8)).round(3)
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0]), (97, [float("nan")] * 8), (0, x[0].tolist())], "id long, vector array<double>")
    got = rows(dense.topk(data, data.where("id < 4").withColumnRenamed("id", "query_id"), 3, metric, 8).select("query_id", "rank", "id"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = {"cosine": 1 - unit[:4] @ unit.T, "dot": -x[:4] @ x.T, "l2": np.linalg.norm(x[:4, None] - x[None], axis=2)}[metric]
    assert got == sorted((q, r + 1, int(i)) for q in range(4) for r, i in enumerate(np.argsort(far[q].round(9), kind="stable")[:3]))


def test_fusion(spark):
    hits = spark.createDataFrame([(1, "A", "sparse", 1, "s1"), (1, "B", "sparse", 2, "s2"), (1, "B", "dense", 1, "d1"), (1, None, "dense", 2, "d2")], "query_id int, page_id string, channel string, rank int, chunk_id string")
    got = fusion.page_rrf(hits, evidence=1).orderBy("rank").collect()
    assert [(r.page_id, r.sparse_rank, r.dense_rank, len(r.evidence)) for r in got] == [("B", 2, 1, 1), ("A", 1, None, 1)]


def test_hybrid_search_asks_with_every_twentieth_row(spark, tmp_path):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i)) + "x"
    docs = [(i, f"{name(i)} common words", f"{i}. {name(i).upper()}" if i != 40 else "五") for i in range(1, 66)] + [(80, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    x = np.random.default_rng(2).standard_normal((101, 64))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = retrieval_queries.QUERIES["rrf_hybrid"][0](spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 60, 80, 100}
    own = {r.query_id: (r.sparse_rank, r.dense_rank, r["rank"]) for r in got if r.page_id == r.query_id}
    assert own == {0: (None, 1, 1), 20: (1, 1, 1), 40: (1, 1, 1), 60: (1, 1, 1), 80: (None, 1, 1), 100: (None, 1, 1)}
    evidence = retrieval_queries.QUERIES["rrf_evidence"][0](spark, str(tmp_path)).where("query_id = page_id").collect()
    assert {r.query_id: r.evidence for r in evidence}[60] == "dense:60,sparse:60" and len(evidence) == 6


def test_graph_against_hand_computed_values(spark):
    pairs = graph.undirected(spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c"), ("c", "c"), ("d", "e"), ("a", None)], "source_id string, target_id string"))
    assert rows(graph.degrees(pairs)) == [("a", 1), ("b", 2), ("c", 1), ("d", 1), ("e", 1)]
    assert [(u, v, round(s, 6)) for u, v, s in rows(graph.adamic_adar(pairs))] == [("a", "c", round(1 / np.log(2), 6))]
    assert rows(graph.components(pairs)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    pages = spark.createDataFrame([("p", ["x", "y"]), ("q", ["y", "x"]), ("r", ["y"]), ("s", None), ("t", [])], "page_id string, sources array<string>")
    over, members = graph.overlap(pages)
    assert rows(over.select("u", "v", "jaccard")) == [("p", "r", 0.5)] and rows(members) == [("p", "p"), ("q", "p"), ("r", "r")]


def test_greedy_cap_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    scored = sorted({(f"n{a:02d}", f"n{b:02d}"): float(rng.integers(1, 30)) for a, b in rng.integers(0, 25, (160, 2)) if a < b}.items(), key=lambda x: (-x[1], x[0]))
    have, want = {}, []
    for (u, v), _ in scored:
        if have.get(u, 0) < 3 or have.get(v, 0) < 3:
            want.append((u, v))
            have[u], have[v] = have.get(u, 0) + 1, have.get(v, 0) + 1
    got = graph.greedy_cap(spark.createDataFrame([(u, v, s) for (u, v), s in scored], "u string, v string, score double"), 3)
    assert rows(got.select("u", "v")) == sorted(want)


def four_signals(links, sets, types):
    """The graph by going through all pairs of pages: {(u, v): (weight, signals)} of links (source, target, n), sets and types by page."""
    edges = {}

    def add(a, b, weight, signal):
        old = edges.get((min(a, b), max(a, b)), (0.0, ()))
        edges[min(a, b), max(a, b)] = old[0] + weight, tuple(sorted({*old[1], signal}))

    for a, b, n in links:
        add(a, b, n, "direct_link")
    pages = sorted(types)
    for i, a in enumerate(pages):
        for b in pages[i + 1 :]:
            x, y = set(sets.get(a) or ()), set(sets.get(b) or ())
            if x & y:
                add(a, b, 0.6 * len(x & y) / len(x | y), "source_overlap")
    near = {p: {q for e in edges if p in e for q in e if q != p} for p in pages}
    scores = {(a, b): sum(1 / np.log(len(near[m])) for m in near[a] & near[b]) for i, a in enumerate(pages) for b in pages[i + 1 :] if b not in near[a] and near[a] & near[b]}
    have = dict.fromkeys(pages, 0)
    for (a, b), score in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0])):
        if have[a] < 5 or have[b] < 5:
            add(a, b, 0.4 * score, "adamic_adar")
            have[a], have[b] = have[a] + 1, have[b] + 1
    for a, b in list(edges):
        if types[a] == types[b]:
            add(a, b, 0.3, "type_affinity")
    return edges


def same_graph(got, want):
    assert {(r.u, r.v): tuple(r.signals) for r in got} == {k: s for k, (_, s) in want.items()}
    assert all(abs(r.weight - want[r.u, r.v][0]) < 1e-4 for r in got) and len(got) == len(want)


def test_graph_has_all_four_signals(spark):
    rng = np.random.default_rng(5)
    pages = [f"p{i:02d}" for i in range(40)]
    links = [(pages[a], pages[b], int(n)) for a, b, n in {(int(a), int(b)): (int(a), int(b), n) for a, b, n in zip(rng.integers(0, 8, 60), rng.integers(0, 40, 60), rng.integers(1, 3, 60)) if a != b}.values()]
    sets, types = {p: {f"s{i}"} for i, p in enumerate(pages)}, {p: "ab"[i % 2] for i, p in enumerate(pages)}
    sets["p38"] = {"s39", "s38"}
    want = four_signals(links, sets, types)
    assert any(s == ("adamic_adar",) for _, s in want.values()) and any(s == ("adamic_adar", "type_affinity") for _, s in want.values())
    over = spark.createDataFrame([("p38", "p39", 0.5)], "u string, v string, jaccard double")
    got = graph.build(spark.createDataFrame(links, "source_id string, target_id string, n long"), over, spark.createDataFrame(list(types.items()), "page_id string, page_type string"))
    same_graph(got.collect(), want)


def test_graph_links_all_pages_with_a_common_source(spark):
    sets = {"a": ["x"], "b": ["x"], "c": ["y", "x"], "d": ["x", "y"], "e": ["z"], "f": None, "g": [], "h": ["y"], "i": ["z", None, "z"]}
    types = dict.fromkeys(sets, "t") | {"b": "other", "e": None}
    over = graph.page_overlap(*graph.overlap(spark.createDataFrame(list(sets.items()), "page_id string, sources array<string>")))
    assert rows(over) == [("a", "b", 1.0), ("a", "c", 0.5), ("a", "d", 0.5), ("b", "c", 0.5), ("b", "d", 0.5), ("c", "d", 1.0), ("c", "h", 0.5), ("d", "h", 0.5), ("e", "i", 1.0)]
    links = [("a", "f", 1), ("g", "a", 2)]
    got = graph.build(spark.createDataFrame(links, "source_id string, target_id string, n long"), over, spark.createDataFrame(list(types.items()), "page_id string, page_type string"))
    same_graph(got.collect(), four_signals(links, sets | {"i": ["z"]}, types))


def test_graph_query_links_pages_of_equal_sources(spark, tmp_path):
    rows_ = [(p, f"concepts/{p}.md", p.upper(), "concept", ["raw/shared.docx"], [], None, None) for p in "abc"]
    schema = "page_id string, path string, title string, page_type string, sources array<string>, links array<string>, updated_at timestamp, deleted_at timestamp"
    spark.createDataFrame(rows_, schema).write.parquet(f"{tmp_path}/wiki_pages.parquet")
    got = graph_queries.QUERIES["graph_build"][0](spark, str(tmp_path))
    assert rows(got.select("u", "v", "weight", "signals")) == [(u, v, 0.9, "source_overlap,type_affinity") for u, v in ("ab", "ac", "bc")]


def test_communities_beat_single_nodes(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 1.0) for i in range(5) for j in range(i + 1, 5)]
    w = spark.createDataFrame([*clique("a"), *clique("b"), ("a0", "b0", 0.1)], "u string, v string, weight double")
    got = graph.communities(w)
    assert got.select("community").distinct().count() == 2 and graph.modularity(w, got) > 0.4


def test_expansion_needs_text_hits(spark):
    seeds = spark.createDataFrame([(1, "a", 1)], "query_id int, page_id string, rank int")
    edges = spark.createDataFrame([("a", "b", 1.0, ["direct_link"]), ("c", "a", 1.0, ["adamic_adar"]), ("a", "d", 1.0, ["direct_link"])], "source_id string, target_id string, weight double, edge_signals array<string>")
    near = graph.expand(seeds, edges)
    hits = spark.createDataFrame([(1, "b", "dense"), (1, "c", "dense")], "query_id int, page_id string, channel string")
    assert rows(near.select("page_id")) == [("b",), ("c",), ("d",)] and rows(graph.validated(near, hits).select("page_id")) == [("b",)]


PAGE = "intro 一。二！\n\n# Head\n\ntext [[a; b]] end; more\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx = 1\n\ny = 2\n```\n\n- one\n  two\n\n## Sub\n> quote\n" + "word " * 700


def test_chunks_are_slices_within_limits():
    assert [b.kind for b in chunking.parse_blocks(PAGE)] == ["paragraph", "heading", "paragraph", "table", "code", "list", "heading", "quote", "paragraph"]
    got = chunking.chunk_page("p", "T", PAGE)
    assert [r["chunk_index"] for r in got] == list(range(len(got)))
    for r in got:
        assert r["body"] == PAGE[r["start_char"] : r["end_char"]] and r["text"].endswith(r["body"])
        assert len(r["text"]) <= 1000 if r["chunk_kind"] == "sparse" else r["token_count"] <= 112
    assert any(r["forced_split"] for r in got) and any("[[a; b]]" in r["body"] for r in got)
    assert chunking.chunk_page("p", "T", "") == chunking.chunk_page("p", "T", None) == chunking.chunk_page("p", "T", "# only\n") == []


def test_chunk_ids_do_not_move_with_insertions(spark):
    of = lambda body: {r.chunk_id for r in chunking.chunk_pages(spark.createDataFrame([("p", "T", body), ("n", None, None)], "page_id string, title string, content string")).collect()}
    assert of("# A\n\none\n\n# B\n\ntwo") < of("# Z\n\nzero\n\n# A\n\none\n\n# B\n\ntwo")


def test_neighbours_across_spans(spark):
    n = [(f"c{i:05d}", "p", i * 1500) for i in range(8)] + [("x", "p", None), ("c00000", "p", 0), ("y", "q", 1)]
    got = dict((r[0], (r[1], r[2])) for r in context.neighbours(spark.createDataFrame(n, "chunk_id string, page_id string, chunk_index long")).collect())
    assert got["c00000"] == (None, "c00001") and got["c00003"] == ("c00002", "c00004") and got["x"] == ("c00007", None) and got["y"] == (None, None)


def test_packing_keeps_the_image_share():
    items = [(f"d{i}", "dense", "x" * 396) for i in range(20)] + [("i", "image", "y" * 80)]
    got = context.pack(items, 1000)
    assert 20 in [g[0] for g in got] and sum(g[2] for g in got) <= 1000
    assert context.pack([("a", "dense", "z" * 1000)], 10) == [(0, "z" * 43, 10, True)]
    assert context.pack([], 10) == [] and context.pack([("a", "dense", "")], 10) == []


def test_budget(spark):
    df = spark.createDataFrame([("multiple_sections", 4096), ("section", 4096)], "m string, b long")
    assert [tuple(r) for r in df.select(*context.budget(df.m, df.b)).collect()] == [("snippet", 5734, 5734), ("snippet", 4096, 4096)]
    assert df.select(*context.budget(df.m, df.b, "summary", 1000)).first() == ("summary", 4096, 1000)


def test_manifest(spark):
    cur = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("c", "9"), (None, "x")], "path string, sha256 string")
    man = spark.createDataFrame([("b", "2", "processed", 1), ("c", "3", "processed", 1), ("d", "4", "processed", 1), ("e", "5", "deleted", 1)], "path string, sha256 string, status string, last_processed int")
    d = ingest.diff(cur, man)
    assert rows(d.select("path", "state")) == [("a", "new"), ("b", "unchanged"), ("c", "modified"), ("d", "deleted")]
    assert rows(ingest.upsert(man, d, F.lit(2)).select("path", "sha256", "status", "last_processed")) == [("a", "1", "processed", 2), ("b", "2", "processed", 1), ("c", "9", "processed", 2), ("d", "4", "deleted", 2), ("e", "5", "deleted", 1)]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "query_id int, page_id string, rank int")
    gold = spark.createDataFrame([(1, "y"), (1, "q"), (2, "w")], "query_id int, page_id string")
    assert rows(metrics.ranking_metrics(ranked, gold)) == [(1, 0.5, 0.5, 1), (2, 0.0, 0.0, 0)]
    v = spark.createDataFrame([("k", float(i % 7)) for i in range(50)] + [("k", None), ("k", float("nan")), ("c", 3.0)], "k string, v double")
    x = sorted(float(i % 7) for i in range(50))
    assert rows(metrics.nearest_rank(v, "k", "v", [0, 50, 95])) == sorted([("c", p, 3.0) for p in (0, 50, 95)] + [("k", p, x[round(p / 100 * 49)]) for p in (0, 50, 95)])
    assert metrics.gate({"mrr": 0.8, "overflow": 1}, {"mrr": 0.85}) == ["mrr fell from 0.85 to 0.8", "overflow is 1"]


def test_scores_and_policy(spark):
    one = spark.range(1)
    assert one.select(vectors.score(F.lit(0.5), "cosine"), vectors.score(F.lit(1.0), "l2"), vectors.score(F.lit(9.0), "dot")).first() == (0.75, 0.75, 1.0)
    with pytest.raises(ValueError):
        vectors.score(F.lit(1.0), "l2", unit=False)
    assert dense.policy({10: 1.0, 20: 1.0}, 0) == "ann" and dense.policy({10: 1.0, 20: 0.9}, 0) == "exact"
    with pytest.raises(ValueError):
        dense.policy({10: 1.0}, 0)
    assert len(one.select(keys.chunk_id(F.lit("p"), F.lit("dense"), F.lit("a  b"), F.lit(0))).first()[0]) == 19


def test_a_hot_key_is_split_over_tasks(spark):
    """A third of all rows of one key: no task of the running total, the percentiles and the neighbours holds it whole."""
    df = spark.range(30_000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).withColumn("v", (F.col("id") % 1000).cast("double")).repartition(8)
    total = running_total(df, ["k"], ["id"], F.lit(1), "n", 16).where("k = 0")
    assert total.select("n").distinct().count() == 10_000
    spread = df.where("k = 0").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(16))).groupBy("b").count()
    sizes = [r["count"] for r in spread.collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * sorted(sizes)[8]
    got = {r.k: r.value for r in metrics.nearest_rank(df.where("k = 0").unionByName(df.where("k != 0").withColumn("k", F.lit(1).cast("long"))), "k", "v", [50]).collect()}
    v = sorted(float(i % 1000) for i in range(0, 30_000, 3))
    assert got[0] == v[round(0.5 * 9999)]


def test_forced_dense_parts_overlap():
    text_ = "word " * 400
    got = [r for r in chunking.chunk_page("p", "T", text_) if r["chunk_kind"] == "dense"]
    assert len(got) > 2 and all(0 < a["end_char"] - b["start_char"] <= 4 * chunking.DENSE_OVERLAP + 3 for a, b in zip(got, got[1:])) and all(r["token_count"] <= chunking.DENSE_MOST for r in got)


def test_rows_of_a_hot_key_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 8)
    data = [("hub", f"n{i:03d}") for i in range(60)] + [(f"k{i % 40}", f"m{i:03d}") for i in range(120)] + [("hub", "n000"), (None, "x")]
    got = graph.within(spark.createDataFrame(data, "k string, id string").distinct(), "k", "id")
    want = {(k, a, b) for k, a in data for k2, b in data if k is not None and k == k2 and a < b}
    pairs = [(r.k, r.l.id, r.r.id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    star = spark.createDataFrame([("a_hub", f"n{i:03d}") for i in range(60)], "u string, v string")
    scores = graph.adamic_adar(star).collect()
    assert len(scores) == 60 * 59 // 2 and {round(r.score, 9) for r in scores} == {round(1 / np.log(60), 9)}


def test_groups_after_a_union_are_whole(spark):
    from pyspark.sql.window import Window

    from loamweave.sources.tables import settle

    settle(spark)
    top = lambda n: spark.range(n).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("v"))).where("r <= 5")
    both = top(70).unionByName(top(300_000)).groupBy("k", "r").agg(F.count("*").alias("n"))
    assert both.count() == 35 and both.where("n != 2").count() == 0

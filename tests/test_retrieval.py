import numpy as np
import pytest
from pyspark.sql import functions as F

from loamweave.functions import keys, text
from loamweave.operators import ann, context, fulltext, graph, indexing, ingest, metrics, reports, retrieval, stage, substrings


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_candidates_merge_by_page(spark):
    ev = lambda *ids: [(n + 1, c, i) for n, (c, i) in enumerate(ids)]
    direct = spark.createDataFrame([(1, "a", 0.5, 1, None, ev(("sparse", "x")), 1), (1, "b", 0.25, 2, 1, ev(("dense", "y")), 2), (2, "a", 0.1, 1, None, [], 1)], f"query_id int, page_id string, rrf double, sparse_rank int, dense_rank int, evidence {retrieval.EVIDENCE}, rank int")
    near = spark.createDataFrame([(1, "b", 1, [("a", 1.0, ["s"], False)], ev(("dense", "y"), ("sparse", "z"))), (1, "c", 2, [("a", 2.0, ["t"], True)], ev(("sparse", "w")))], f"query_id int, page_id string, place int, paths {retrieval.PATHS}, evidence {retrieval.EVIDENCE}")
    got = retrieval.merge(direct, near).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.page_id, r["rank"], [e.chunk_id for e in r.evidence], len(r.paths)) for r in got] == [(1, "a", 1, ["x"], 0), (1, "b", 2, ["y", "z"], 1), (1, "c", 3, ["w"], 1), (2, "a", 1, [], 0)]
    assert rows(retrieval.merge(direct.limit(0), near).select("page_id", "rrf")) == [("b", 0.0), ("c", 0.0)] and retrieval.merge(direct, near.limit(0)).count() == 3


def test_inferred_pages_need_sparse_text(spark):
    near = spark.createDataFrame([(1, "a", "s", 1.0, ["Adamic_Adar", "INFERRED_x"], 1), (1, "b", "s", 1.0, ["adamic_adar", "direct_link"], 2), (1, "c", "s", 1.0, [], 3)], "query_id int, page_id string, seed_id string, weight double, signals array<string>, place int")
    hits = spark.createDataFrame([(1, p, f"{p}{c}", c, 1.0, "t") for p in "abc" for c in ("dense",)] + [(1, "c", "c9", "sparse", 0.1, "  "), (1, "b", "b1", "sparse", 0.5, "t"), (1, "b", "b2", "sparse", 0.9, "t")], "query_id int, page_id string, chunk_id string, channel string, score double, text string")
    got = {r.page_id: [(e["rank"], e.chunk_id) for e in r.evidence] for r in retrieval.page_evidence(near, hits).collect()}
    assert got == {"b": [(1, "b2"), (2, "b1"), (3, "bdense")], "c": [(1, "cdense")]}
    assert {r.page_id: len(r.evidence) for r in retrieval.page_evidence(near, hits, 1).collect()} == {"b": 2, "c": 1}


def test_expansion_keeps_all_signals(spark):
    seeds = spark.createDataFrame([(1, "a", 1)], "query_id int, page_id string, rank int")
    edges = spark.createDataFrame([("a", "b", 1.0, ["source_overlap"], 2), ("b", "a", 1.0, ["type_affinity"], 3), ("a", "c", 1.0, None, 1)], "source_id string, target_id string, weight double, edge_signals array<string>, edge_no long")
    got = graph.expand(seeds, edges).orderBy("place").collect()
    assert [(r.page_id, r.signals) for r in got] == [("c", None), ("b", ["source_overlap", "type_affinity"])] or [(r.page_id, r.signals) for r in got] == [("c", []), ("b", ["source_overlap", "type_affinity"])]


def test_entities_by_equality_then_by_part(spark):
    nodes = spark.createDataFrame([("p/one.md", "Camera X", 1), ("p/two.md", "camera", 2), ("p/three.md", None, 0)], "node_id string, title string, node_no int")
    asked = spark.createDataFrame([(1, "CAMERA"), (1, "amera"), (2, "three"), (2, "X"), (2, "zzz"), (3, ""), (3, None), (1, "CAMERA")], "query_id int, entity string")
    assert rows(retrieval.entity_nodes(asked, nodes)) == [(1, "CAMERA", "p/two.md"), (1, "amera", "p/one.md"), (2, "X", "p/one.md"), (2, "three", "p/three.md")]
    seeds = retrieval.seeds_of(spark.createDataFrame([(1, "a", 1), (1, "b", 9)], "query_id int, page_id string, rank int"), spark.createDataFrame([(1, "a", 1), (1, "c", 2)], "query_id int, node_id string, place int"))
    assert rows(seeds) == [(1, "a", 1), (1, "c", 2)]


def test_entities_broadcast_no_table(spark):
    nodes = spark.range(50).selectExpr("concat('p/one_', id, '.md') as node_id", "concat('Camera ', id) as title", "id as node_no")
    got = retrieval.entity_nodes(nodes.selectExpr("node_no as query_id", "explode(array(title, concat('one_', node_no, '.'), 'zzz')) as entity"), nodes)
    assert got.count() == 100
    got.write.format("noop").mode("overwrite").save()
    plan = got._jdf.queryExecution().executedPlan()
    assert "Broadcast" not in plan.toString() and "SortMergeJoin" in plan.toString()


def test_words_in_texts_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    make = lambda n, most: ["".join(rng.choice(list("ab "), rng.integers(0, most))) for _ in range(n)]
    bodies, words = make(40, 12), make(60, 5)
    got = substrings.containing(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)] + [(99, None)], "key int, body string"), spark.createDataFrame([(w,) for w in [*words, None]], "word string"))
    assert rows(got.select("key", "word")) == sorted((i, w) for i, b in enumerate(bodies) for w in set(words) if w and w in b)


def test_words_of_any_runs_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    make = lambda n, most: ["".join(rng.choice(list("ab1/_. é😀"), rng.integers(0, most))) for _ in range(n)]
    long = "ab" * 100 + "/" + "x" * 70
    bodies, words = [*make(60, 25), long, "a/" + long], [*make(150, 7), long, long[1:], long[:-1], "x" * 70, "x" * 71, "b/x", "/" + "x" * 69, "ab" * 101]
    got = substrings.containing(spark.createDataFrame([*enumerate(bodies), (99, bodies[0])], "key int, body string"), spark.createDataFrame([(w,) for w in words], "word string"))
    assert rows(got.select("key", "word")) == sorted((i, w) for i, b in [*enumerate(bodies), (99, bodies[0])] for w in set(words) if w and w in b)


def test_words_of_one_beginning_do_not_meet_every_text(spark):
    names = [f"vault/wiki/page/alpha_d{i:07}_field.md" for i in range(400)]
    met = substrings.candidates(spark.createDataFrame(enumerate(names), "h long, body string"), spark.createDataFrame([(n,) for n in [*names, *(n[16:31] for n in names)]], "word string"))
    assert met.count() == 800


CHUNKS = [("a1", "p", "s1", "dense", 1, "one"), ("a2", "p", "s1", "dense", 2, " one "), ("a3", "p", "s1", "dense", 3, "three"), ("a4", "p", "s2", "dense", 4, "four"), ("a9", "p", "s1", "sparse", 0, "raw"), ("q1", "q", "s", "dense", None, "")]


def test_scopes(spark):
    chunks = spark.createDataFrame(CHUNKS + CHUNKS[:1], "chunk_id string, page_id string, section_path string, chunk_kind string, chunk_index int, text string")
    pages = spark.createDataFrame([("p", " whole "), ("q", None)], "page_id string, content string")
    items = spark.createDataFrame([(1, "p", [(1, "dense", "a3"), (2, "dense", "a4")]), (1, "q", [(1, "dense", "q1")]), (2, "p", [(1, "dense", "gone"), (2, "dense", "a4")])], f"query_id int, page_id string, evidence {retrieval.EVIDENCE}")
    of = lambda scope: {(r.query_id, r.page_id): r.text for r in retrieval.scope_text(items, chunks, pages, scope).collect()}
    assert of("section") == of("parent_section") == {(1, "p"): "one\n\nthree", (2, "p"): "four"}
    assert of("multiple_sections") == {(1, "p"): "one\n\nthree\n\nfour", (2, "p"): "four"}
    assert of("evidence") == of("chunk") == {(1, "p"): "three", (2, "p"): "four"} and of("full_page") == {(1, "p"): "whole", (2, "p"): "whole"}
    assert of("adjacent") == {(1, "p"): "one\n\nfour\n\nthree", (2, "p"): "four"}


def test_image_notes_and_summaries(spark):
    df = spark.createDataFrame([("t", True, "d.pdf", 3, "s", " near "), (None, True, "", None, None, None), ("t", False, None, None, None, None)], "t string, k boolean, d string, p int, s string, n string")
    got = [r[0] for r in df.select(retrieval.image_note(df.t, df.k, df.d, df.p, df.s, df.n)).collect()]
    assert got == ["t\n\n[来源: d.pdf, 页 3, section s]\n[附近正文] near", "\n\n[来源: ?]\n[注: 该图片附近无可用正文上下文]", "t\n\n[注: 该图片无父文档元数据]"]
    long_ = spark.createDataFrame([("x" * 300, "chunk"), ("x" * 300, "global")], "t string, s string")
    assert [len(r[0]) for r in long_.select(retrieval.shown_text(long_.t, "summary", long_.s)).collect()] == [200, 300]


def test_bundles_list_what_they_leave_out(spark):
    items = spark.createDataFrame([(1, n, f"p{n:03d}", "dense", "section", "x" * 400) for n in range(100)] + [(1, 100, "img", "image", "chunk", "y" * 40), (1, 3, "p003", "dense", "section", "x" * 400), (1, 101, "nul", "dense", "section", None), (2, 1, "g", "graph", "chunk", "z" * 9000)], "query_id int, rank int, page_id string, category string, scope string, text string")
    plans = spark.createDataFrame([(1, "multiple_sections"), (2, "section"), (3, "section")], "query_id int, context_mode string")
    got, whole = retrieval.bundles(items, plans, 1000, None, 1200)
    by = {r.query_id: r for r in whole.collect()}
    assert (by[1].planned_tokens, by[1].effective_tokens, by[1].violations) == (1400, 1200, []) and by[1].n_items + by[1].n_omitted == 101 and by[1].token_count <= 1200
    assert by[2].token_count == 1000 and by[2].n_items == 1 and (by[3].n_items, by[3].token_count) == (0, 0)
    left = got.where("omitted is not null and query_id = 1").collect()
    assert {r.omitted for r in left} == {"dense_budget_exhausted"} and got.where("page_id = 'img' and omitted is null").count() == 1
    assert retrieval.exit_code(None, False, 0) == retrieval.exit_code("fresh", False, 0) == retrieval.exit_code("stale", True, 1) == 0 and retrieval.exit_code("stale", True, 0) == 2
    df = spark.createDataFrame([(5, 4, 4, 3), (1, 4, 5, None)], "t int, e int, c int, h int")
    assert [r[0] for r in df.select(retrieval.violations(df.t, df.e, df.c, df.h)).collect()] == [["over_budget", "over_hard_max"], ["cap_differs"]]


def test_assembly_has_no_cap_and_equals_the_fold(spark):
    rng = np.random.default_rng(4)
    items = [(n, str(rng.choice(["dense", "image", "graph", "page"])), "w" * int(rng.integers(0, 300))) for n in range(200)]
    df = spark.createDataFrame([(7, n, f"i{n:03d}", c, t) for n, c, t in items], "query_id int, rank int, id string, category string, text string")
    want = context.pack([(f"i{n:03d}", c, t) for n, c, t in items if t], 900)
    kept = [i for i in items if i[2]]
    assert rows(context.assemble(df, 900).select("place", "id", "n_tokens")) == [(n + 1, f"i{kept[n][0]:03d}", s) for n, _, s, _ in want] and len(want) > 0
    assert context.assemble(df.limit(0)).count() == 0


def test_from_plans_to_markdown(spark):
    pages = spark.createDataFrame([("w/a.md", "w/a.md", "Camera", "concept", "# Camera\n\nThe shutter driver reports code E4001."), ("w/b.md", "w/b.md", "Radar", "concept", "The radar head needs calibration."), ("w/c.md", "w/c.md", "Cable", "concept", "The cable gland seals the shutter housing of every long cable run between the cabinet and the mast.")]
        + [(f"w/f{n}.md", f"w/f{n}.md", "Filler", "concept", "shutter shutter") for n in range(6)], "page_id string, path string, title string, page_type string, content string")
    chunks = indexing.chunk_rows(pages)
    from loamweave.functions import embedding

    vectors = embedding.embedded(chunks.where("chunk_kind = 'dense'"), None, lambda t: embedding.hashed(t, 32)).select(F.col("chunk_id").alias("id"), "vector")
    schema = "query_id int, query string, entities array<string>, vectors array<array<float>>, context_mode string"
    plans = spark.createDataFrame([(1, "shutter", ["camera"], [], "section"), (2, "nothingmatches", [], [], "evidence")], schema)
    again = spark.createDataFrame([(2, "radar", [], [], "evidence")], schema)
    nodes = pages.select(F.col("page_id").alias("node_id"), "title", F.col("page_id").alias("node_no"))
    edges = spark.createDataFrame([("w/a.md", "w/c.md", 2.0, ["direct_link"]), ("w/b.md", "w/c.md", 1.0, ["adamic_adar"])], "source_id string, target_id string, weight double, edge_signals array<string>")
    index = {"chunks": chunks, "vectors": vectors, "edges": edges, "nodes": nodes, "pages": pages, "dim": 32}
    found, items, whole = retrieval.answer(plans, index, k=1, again=again)
    got = {(r.query_id, r.page_id): r for r in found.collect()}
    assert (2, "w/b.md") in got and len(got[1, "w/c.md"].paths) == 1 and got[1, "w/c.md"].rrf == 0
    shown = {(r.query_id, r.page_id): (r.category, r.scope, r.text) for r in items.collect()}
    assert shown[1, "w/c.md"][:2] == ("graph", "chunk") and "gland" in shown[1, "w/c.md"][2] and ("dense", "section", "Filler\nshutter shutter") in shown.values()
    said = {r.query_id: r.markdown for r in retrieval.markdown(items, whole, found).collect()}
    assert "### Cable" in said[1] and "radar head" in said[2]
    made = [r.item for r in retrieval.item_json(items, found).where("query_id = 1").collect()]
    assert any('"method":"graph_expansion"' in m for m in made) and all('"snippet"' in m for m in made)
    vec = [float(x) for x in embedding.hashed(["shutter driver"], 32)[0]]
    alone, _, _ = retrieval.answer(spark.createDataFrame([(1, "E4001", [], [vec], "chunk"), (2, "zzz", [], [], "chunk")], schema), index | {"edges": None})
    assert alone.where("query_id = 1").orderBy("rank").first().page_id == "w/a.md" and alone.where("query_id = 2").count() == 0


def test_index_in_cells_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 40)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((200, 16)), np.ones((100, 16)) + 0.01 * rng.standard_normal((100, 16)), np.zeros((1, 16))])
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (0, x[0].tolist())], "id long, vector array<double>")
    index = ann.build(data, 16)
    asked = data.where("id % 20 = 0 or id = 300").withColumnRenamed("id", "query_id")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    far = (1 - unit @ unit.T).round(9)
    got = rows(ann.search(index, asked, 7, probes=2).select("query_id", "rank", "id"))
    assert got == sorted((q, r + 1, int(i)) for q in [*range(0, 300, 20), 300] for r, i in enumerate(np.argsort(far[q], kind="stable")[:7]))
    assert ann.search(index, asked, 7, probes=2, exact=False).count() > 0 and ann.search(ann.build(data.limit(0), 16), asked, 3).count() == 0


def test_images_audited_healed_and_captioned(spark):
    refs = spark.createDataFrame([("p", "assets/A.png|80"), ("p", "b.png#x"), ("q", ".\\assets\\c.png"), ("q", "../d.png"), ("q", "gone.png"), ("r", "assets/a.png"), ("r", None)], "page_id string, value string")
    images = spark.createDataFrame([("b.png", "assets/b.png", "captioned"), ("z.png", "assets/z.png", "pending_vlm")], "filename string, rel_path string, status string")
    disk = spark.createDataFrame([("assets/a.png", "1"), ("assets/b.png", "2"), ("assets/c.png", "3"), ("assets/o.png", "4"), ("assets/z.png", "5")], "rel_path string, sha256 string")
    got = ingest.audit(refs, images, disk).first().asDict()
    assert got == {"referenced": 5, "registered": 1, "unregistered": 3, "missing": 1, "case_mismatch": 1, "orphan": 1, "pending_vlm": 1, "captioned": 1}
    healed = {r.filename: r for r in ingest.heal(refs, images, disk).collect()}
    assert set(healed) == {"A.png", "c.png"} and healed["A.png"].referring_wiki_pages == ["p", "r"] and healed["c.png"].sha256 == "3"
    pages = spark.createDataFrame([("p", ["raw/x.pdf", "notes"]), ("r", ["Raw/y.pdf"]), ("q", None)], "page_id string, sources array<string>")
    prov = {r.key: (r.source_doc, r.n_sources, r.status) for r in ingest.provenance(refs, images, pages).collect()}
    assert prov["assets/A.png"] == ("raw/x.pdf", 1, "resolved") and prov["assets/a.png"] == ("Raw/y.pdf", 1, "resolved") and prov["assets/b.png"][2] == "captioned" and prov["assets/c.png"] == ("", 0, "unresolved_provenance")
    vlm = "struct<description: string, key_values: array<string>, category: string>"
    old = spark.createDataFrame([("b.png", "was", None, "captioned"), ("z.png", "", None, "pending_vlm"), ("k.png", "keep", None, "captioned")], f"filename string, caption_text string, vlm_caption {vlm}, status string")
    said = spark.createDataFrame([("b.png", " ", ("D", ["k", "v"], ""), 1), ("z.png", "first", None, 1), ("z.png", " last ", None, 2), ("b.png", "", ("", [], ""), 0)], f"filename string, caption_text string, vlm_caption {vlm}, position int")
    assert rows(ingest.apply_captions(old, said).select("filename", "caption_text", "status")) == [("b.png", "D\n关键词: k, v", "captioned"), ("k.png", "keep", "captioned"), ("z.png", "last", "captioned")]
    asked = spark.createDataFrame([("C:\\w\\assets\\b.png",), ("x/notassets/b.png",), ("assets/b.png",), (None,)], "path string")
    assert {r.path: r.rel_path for r in ingest.image_meta(asked, images).collect()} == {"C:\\w\\assets\\b.png": "assets/b.png", "x/notassets/b.png": None, "assets/b.png": "assets/b.png"}


def test_manifests_collapse(spark):
    rows_ = [("d", "a.png", "x", None, 1), ("d", "a.jpg", "y", "cap", 2), ("d", "a.gif", "z", "", 3), ("e", "a.png", "w", None, 4)]
    got = ingest.deduplicated(spark.createDataFrame(rows_, "source_doc string, filename string, rel_path string, caption_text string, at int"), "at")
    assert rows(got.select("source_doc", "rel_path", "place")) == [("d", "y", 1), ("e", "w", 4)]
    entries = spark.createDataFrame([("d:\\x.pdf", "deleted", 1), ("D:/x.pdf", "processed", 2), ("D:/x.pdf", "processed", 3), ("y", "new", 1), (None, "new", 1)], "path string, status string, at int")
    assert rows(ingest.collapsed_entries(entries, "at").select("key", "status", "at")) == [("D:/x.pdf", "processed", 2), ("y", "new", 1)]


def test_contents_in_section_order(spark):
    pages = spark.createDataFrame([("w/B.md", "Bee", "concept"), ("w/a.md", None, "concept"), ("w/p.md", "P", "product"), ("w/x.md", "X", None), ("w/index.md", "I", "overview"), ("w/l.md", "L", "log")], "path string, title string, page_type string")
    got = [(r.section_no, r.slug, r.title, r.n_section) for r in ingest.contents(pages).collect()]
    assert got == [(0, "p", "P", 1), (2, "a", "a", 2), (2, "B", "Bee", 2), (4, "l", "L", 1), (6, "x", "X", 1)]


def test_fingerprints_see_repeats(spark):
    of = lambda *v: spark.createDataFrame([(x,) for x in v], "x string").agg(keys.set_fingerprint(F.col("x"))).first()[0]
    assert of("a", "b") == of("b", "a") and len({of("a"), of("a", "b", "b"), of("a", "c", "c"), of("b", "b"), of("c", "c")}) == 5


def test_new_text_functions(spark):
    df = spark.createDataFrame([("Größe E4001 相机镜头 か",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.unicode_terms(df.t)).collect()] == [["größe", "e4001", "か", "相机", "机镜", "镜头"], None, []]
    keys_ = spark.createDataFrame([("a//./b.png",), ("Wiki/Assets/X.png|3",), ("C:/x",), ("/x",), ("a/../b",), (" ",), (None,)], "t string")
    assert [r[0] for r in keys_.select(text.embed_key(keys_.t)).collect()] == ["assets/a/b.png", "Assets/X.png", None, None, None, None, None]
    stamps = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.5+00:00",), ("2024-01-02T03:04:05+01:00",), ("2024-01-02T03:04:05",), ("2024-13-02T03:04:05Z",), ("x",), (None,)], "t string")
    assert [r[0] for r in stamps.select(text.utc_fault(stamps.t)).collect()] == [None, None, "not_utc", "not_utc", "malformed", "malformed", "missing"]
    shown = spark.createDataFrame([("{{IMG|assets/a b/x.png|图注: cap}} {{IMG|y.png|图注: [无图注]}} {{IMG|z.png|图注: }}",)], "t string")
    assert shown.select(text.image_placeholders(shown.t)).first()[0] == "![[x.png]]  \ncap ![[y.png]] ![[z.png]]"


def test_values_with_heavy_tails(spark):
    rng = np.random.default_rng(2)
    values = [*np.exp(rng.standard_normal(700) * 8).tolist(), *([5.0] * 300)]
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None), ("one", 3.0)], "k string, v double")
    s = sorted(values)
    got = {(r.k, r.percent): r.value for r in metrics.nearest_rank(df, "k", "v", [0, 50, 99, 100]).collect()}
    assert [got["k", p] for p in (0, 50, 99, 100)] == [s[round(p / 100 * 999)] for p in (0, 50, 99, 100)] and got["one", 50] == 3.0
    m = {r.k: r for r in metrics.summary(df, "k", "v").collect()}
    assert m["k"].n == 1000 and m["k"].median == (s[499] + s[500]) / 2 and m["k"].least == s[0] and m["one"].median == 3.0


def test_evaluation(spark):
    ctx = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "query_id int, context string")
    facts = spark.createDataFrame([(1, "alpha"), (1, "gamma"), (1, ""), (3, "x")], "query_id int, fact string")
    assert rows(metrics.evidence_recall(ctx, facts)) == [(1, 0.5), (2, 1.0), (3, 0.0)]
    ranked = spark.createDataFrame([(1, "C:\\W\\Alpha.md", 1), (1, "b.md", 2)], "query_id int, page_id string, rank int")
    assert rows(metrics.page_hits(ranked, spark.createDataFrame([(1, "w/alpha"), (2, "x"), (1, None)], "query_id int, name string"))) == [(1, 1, True), (1, 2, False)]
    b = spark.createDataFrame([(5, 4, 4, 4, [], 1), (3, 4, 8, 8, ["cap_differs"], 0)], "token_count int, base_tokens int, planned_tokens int, effective_tokens int, violations array<string>, unsupported int")
    assert metrics.bundle_counters(b).first() == (1, 1, 1, 1, 8)
    assert metrics.gate({}, {}, schemas=(3, 2)) == ["chunk schema 3 is not the baseline's 2"] and metrics.gate({}, {}, schemas=(3, 2), force=True) == []
    assert metrics.gate({"graph_triggers": 1, "graph_validated": 0}, {}) == ["no graph query gave a validated result"]


def test_communities_reach_their_fixed_point(spark):
    clique = lambda p, n: [(f"{p}{i}", f"{p}{j}", 1.0) for i in range(n) for j in range(i + 1, n)]
    ring = [e for c in range(8) for e in clique(f"c{c}_", 4)] + [(f"c{c}_0", f"c{(c + 1) % 8}_1", 0.2) for c in range(8)]
    w = spark.createDataFrame([(min(u, v), max(u, v), x) for u, v, x in ring], "u string, v string, weight double")
    got = graph.communities(w, spark.createDataFrame([("lone",), ("c0_0",), ("alone",)], "node string"))
    groups = {}
    for r in got.collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert {"lone", "alone"} in groups.values() and len(groups) == 9 and graph.modularity(w, got.where("node not like '%lone'")) > 0.75
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(150)], "u string, v string")
    assert graph.components(chain).select("component").distinct().count() == 1
    with pytest.raises(RuntimeError):
        graph.components(chain, rounds=1)


def test_numbers_and_ordered_totals(spark):
    df = spark.createDataFrame([(f"k{i:03d}", i) for i in range(300)], "k string, v int").repartition(7)
    assert rows(stage.numbers(df, "k", "n").where("n != v")) == []
    got = stage.ordered_total(df.withColumn("g", F.lit(1)), ["g"], "v", F.lit(2), "t", 16)
    assert got.where("t != 2 * v").count() == 0


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://x", "a"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

            @staticmethod
            def set(key, value):
                pass

    class Frame:
        sparkSession = Session()

    with pytest.raises(RuntimeError):
        stage.stage(Frame())


def test_full_text_counts_copies_once(spark):
    docs = spark.createDataFrame([("a", "x x y"), ("a", "x x y"), ("a", "x x y"), ("b", "y"), ("c", None), (None, "x")], "id string, search_text string")
    assert rows(fulltext.postings(docs).select("term", "id", "tf", "length")) == [("x", "a", 2, 3), ("y", "a", 1, 3), ("y", "b", 1, 1)]
    assert fulltext.postings(docs.limit(0)).count() == 0


def test_report_selection_folds_in_order(spark):
    reps = spark.createDataFrame([(0, "Community 0", "alpha beta", 50), (1, "Community 1", "alpha", 80), (2, "Community 2", "beta", 30)], "community_id int, title string, text string, token_count int")
    asked = spark.createDataFrame([(1, ["Alpha", "BETA", "alpha"]), (2, ["nothing"]), (3, None)], "query_id int, terms array<string>")
    got = rows(reports.select(reps, asked, 3, 100).select("query_id", "place", "community_id", "matches"))
    assert got[:2] == [(1, 1, 0, 2), (1, 3, 2, 1)] and [g[2] for g in got if g[0] == 2] == [0, 2]


def test_report_selection_names_every_member(spark, tmp_path):
    import sys
    from pathlib import Path

    from loamweave.plans import graph_queries

    duckdb = pytest.importorskip("duckdb")
    sys.path.insert(0, str(Path(__file__).parent / "tools"))
    import run

    names = [f"p/n{i:04}.md" for i in range(1200)]
    edges = [*zip(names[:-1], names[1:]), ("q/a.md", "q/b.md"), ("q/, b", "q/c"), ("r", "s")]
    asked = [(1, "p/n1199.md"), (1, "p/n1100.md"), (2, "q/b.md"), (2, "p/n0063.md, p/n0064.md"), (2, ", p/n0128"), (3, "1: q/, b, q/c"), (3, "Q/C"), (4, "none"), (5, "y 0 community 0: p/n0000"), (6, ", ".join(names[60:200])), (6, ", ".join([*names[60:200], "x"]))]
    spark.createDataFrame([(*e, 1.0, []) for e in edges], "source_id string, target_id string, weight double, edge_signals array<string>").write.parquet(f"{tmp_path}/graph_edges.parquet")
    spark.createDataFrame([(q, p, "fused") for q, p in asked], "query_id long, page_id string, retrieval_method string").write.parquet(f"{tmp_path}/retrieved_pages.parquet")
    spark.createDataFrame([(n, None, "1") for n in names], "page_id string, updated_at timestamp, sha256 string").write.parquet(f"{tmp_path}/wiki_pages.parquet")
    con = duckdb.connect()
    for name in ("graph_edges", "retrieved_pages"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    query, sql = graph_queries.QUERIES["report_selection"]
    df, rel = query(spark, str(tmp_path)), con.sql(sql)
    assert run.rows(df.columns, [tuple(r) for r in df.collect()]) == run.rows(rel.columns, rel.fetchall())


def _small_index(spark):
    from loamweave.functions import embedding

    bodies = {"camera": "# Camera\n\nThe camera reports code E4001 when the shutter is hot.", "radar": "The radar head needs a fresh calibration.", "cable": "The cable gland seals the housing."}
    pages = spark.createDataFrame([(f"w/{k}.md", f"w/{k}.md", k.title(), "concept" if k != "cable" else "product", v, "1") for k, v in bodies.items()], "page_id string, path string, title string, page_type string, content string, sha256 string")
    chunks = indexing.chunk_rows(pages.drop("sha256"))
    vectors = embedding.embedded(chunks.where("chunk_kind = 'dense'"), None, lambda t: embedding.hashed(t, 32)).select(F.col("chunk_id").alias("id"), "vector")
    edges = spark.createDataFrame([("w/camera.md", "w/radar.md", 1.0, ["direct_link"])], "source_id string, target_id string, weight double, edge_signals array<string>")
    nodes = pages.select(F.col("page_id").alias("node_id"), "title", F.col("page_id").alias("node_no"))
    return {"chunks": chunks, "vectors": vectors, "edges": edges, "nodes": nodes, "pages": pages, "dim": 32}


def test_a_question_from_plan_to_json(spark, tmp_path):
    import json

    from loamweave.plans import answering
    from loamweave.plans.planner import Context, Planner
    from loamweave.sources import report_store

    index, root = _small_index(spark), str(tmp_path)
    got = answering.ask(spark, "E4001 camera", Planner(), index, k=2)
    said = json.loads(got.to_json())
    assert got.exit_code() == 0 and said["text"][0]["page_id"] == "w/camera.md" and said["status"] is None and "E4001" in got.markdown and said["token_count"] <= said["effective_tokens"]
    assert answering.ask(spark, "cable camera", Planner(), index, Context(page_types=("product",))).items[0]["page_id"] == "w/cable.md"
    found = answering.ask(spark, "Radargerät", Planner(synonyms={"Radargerät": ("radar",)}), index | {"edges": None})
    assert [i["page_id"] for i in found.items] == ["w/radar.md"]
    members = spark.createDataFrame([("w/camera.md", 0), ("w/radar.md", 0)], "node string, community_id long")
    ask = lambda **k: answering.ask(spark, "概述 camera", Planner(), index, report_root=root, members=members, snapshot=index["pages"], **k)
    none = ask()
    assert (none.status, none.action, none.exit_code(), none.items) == ("missing", answering.REBUILD, 2, [])
    local = ask(local_fallback=True)
    assert local.fallback and local.exit_code() == 0 and local.items and "missing" in local.warning
    report_store.stage_set(reports.build(members, index["pages"], index["edges"]), root, "r1")
    report_store.activate(spark, root, "r1")
    fresh = ask()
    assert fresh.status == "fresh" and fresh.items[0]["snippet"] == "Community 0: w/camera.md, w/radar.md" and fresh.exit_code() == 0
    report_store.mark_stale(spark, root, "graph", "rebuilt")
    assert ask().status == "stale" and ask().reasons == ["rebuilt"]


def test_evaluation_end_to_end(spark, tmp_path):
    from loamweave.plans import answering
    from loamweave.plans.planner import Planner

    gold = spark.createDataFrame([("E4001", "lookup", ["camera.md"], ["shutter is hot", "nowhere"]), ("calibration", "procedure", ["RADAR.md"], [])], "query string, intent string, relevant_pages array<string>, required_facts array<string>")
    figures, detail = answering.evaluate(spark, gold, Planner(), _small_index(spark))
    assert figures["page_recall"] == 1.0 and figures["evidence_recall"] == 0.75 and figures["mrr"] == 1.0 and figures["hit"] == 1.0 and figures["overflow"] == figures["budget_violations"] == figures["unsupported"] == 0
    folder = str(tmp_path)
    assert answering.save_evaluation(spark, folder, figures, detail, 3) == [] and answering.save_evaluation(spark, folder, figures, detail, 3, baseline=True) == []
    assert answering.save_evaluation(spark, folder, figures | {"mrr": 0.5}, detail, 3) == ["mrr fell from 1.0 to 0.5"] and answering.save_evaluation(spark, folder, figures, detail, 4)[0].startswith("chunk schema")


def test_counters_and_assets(spark, tmp_path):
    import os

    from loamweave.functions.tokens import DEFAULT, vocabulary
    from loamweave.sources import vault

    df = spark.createDataFrame([("x" * 9,), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(DEFAULT.column(df.t)).collect()] == [2, 1, None] and DEFAULT("") == 1
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if os.path.exists(path):
        assert 1 <= vocabulary(path, "v")("The camera keeps the frame.") <= 12
    (tmp_path / "assets").mkdir()
    (tmp_path / "assets" / "a.png").write_bytes(b"x")
    (tmp_path / "secret").write_bytes(b"x")
    (tmp_path / "assets" / "link.png").symlink_to(tmp_path / "secret")
    root = str(tmp_path)
    assert vault.safe_asset(root, "assets/a.png") and not vault.safe_asset(root, "assets/link.png") and not vault.safe_asset(root, "assets/../secret") and not vault.safe_asset(root, "assets/gone.png") and not vault.safe_asset(root, None)
    (tmp_path / "p.md").write_text("---\nsources: raw/x.pdf\n---\n[[A|b]]")
    assert [(r.sources, r.links) for r in vault.graph_pages(spark, root).collect()] == [(["raw/x.pdf"], ["A"])]

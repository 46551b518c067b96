import io
import json
import threading
import zipfile
from pathlib import Path

import numpy as np
import pytest

from loamweave.operators import fulltext, indexing
from loamweave.sources import documents, files, journal, report_store, store, vault, vault_files
from loamweave.streaming import ingest


def test_pages(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: \"T\"\nsources: [raw/x.pdf, raw/y.pdf]\naliases:\n  - q\n---\nBody [[B|b]] [[C]]\n")
    (tmp_path / "b.md").write_text("no head [[A]]")
    (tmp_path / "c.md").write_text("---\nsources: raw/z.pdf\n---\n")
    got = {r.title: r for r in vault.pages(spark, str(tmp_path)).collect()}
    assert set(got) == {"T", "c"} and got["T"].links == ["B", "C"] and got["T"].aliases == ["q"] and got["c"].sources == ["raw/z.pdf"] and got["c"].page_type == "concept"


def test_raw_sources_and_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "d.DOCX").write_bytes(data.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"x")
    (tmp_path / "~$d.docx").write_bytes(b"x")
    (tmp_path / "n.txt").write_text("intro\n# Title\n")
    raw = vault.raw_sources(spark, str(tmp_path))
    assert sorted(r.doc_type for r in raw.collect()) == ["docx", "docx", "txt"]
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.parse(raw).collect()}
    assert got["d.DOCX"].text.strip() == "# Head\nText\n\n| 1 | 2 |\n| --- | --- |" and got["d.DOCX"].doc_tables == [[["1", "2"]]] and got["d.DOCX"].title == "Head"
    assert got["bad.docx"].text == "" and got["n.txt"].title == "Title" and not any(r.fault for r in got.values())
    assert vault.parsed_text(raw).first().title == "Title"


def test_html_tables():
    assert vault.html_tables("<table><tr><th>a</th><td>b <b>c</b></td></tr><tr></tr></table><table></table>") == [[["a", "b c"]]]
    assert vault.html_tables(None) == vault.html_tables("plain") == []


def _chunks(spark, bad=False):
    sparse = spark.createDataFrame([("s1", "a b"), ("d1", "c")], "chunk_id string, fts_text string")
    return sparse, spark.createDataFrame([("d1", [float("nan") if bad else 1.0, 2.0])], "chunk_id string, vector array<double>")


def test_publication(spark, tmp_path):
    root = str(tmp_path / "idx")
    first = store.publish(*_chunks(spark), root, 2)
    assert store.pointer(root)["build_id"] == first
    with pytest.raises(store.BuildError, match="unusable"):
        store.publish(*_chunks(spark, bad=True), root, 2)
    assert store.pointer(root)["build_id"] == first
    second = store.publish(*_chunks(spark), root, 2)
    assert second > first and json.loads((Path(root) / first / "generation.json").read_text())["state"] == "superseded"
    (Path(root) / "active.json").write_text("{")
    assert store.pointer(root)["build_id"] == second and store.load(spark, root)[0].count() == 2


def test_one_writer(tmp_path):
    seen = []

    def other(wait):
        try:
            with store.lock(tmp_path, wait):
                seen.append("got")
        except store.BuildError:
            seen.append("refused")

    with store.lock(tmp_path), store.lock(tmp_path):
        for wait in (0.0, 0.1):
            t = threading.Thread(target=other, args=(wait,))
            t.start()
            t.join()
    t = threading.Thread(target=other, args=(0.0,))
    t.start()
    t.join()
    assert seen == ["refused", "refused", "got"]


def test_head_fields():
    head = """title: "A: \\"b\\" # no"
sources: [raw/x.pdf, "raw/y, z.pdf"]
aliases:
  - q
  - 'it''s'
flag: true
note: |
  one

  two
meta:
  a: 1
  b: [x]
multi: [a,
  b]
none:
updated: 2024-01-01 # day"""
    got = vault.yaml_fields(head)
    assert got == {
        "title": 'A: "b" # no', "sources": ["raw/x.pdf", "raw/y, z.pdf"], "aliases": ["q", "it's"], "flag": True, "note": "one\n\ntwo", "meta": {"a": "1", "b": ["x"]}, "multi": ["a", "b"], "none": None, "updated": "2024-01-01",
    }
    assert vault.raw_sources_of("---\nsources: ['Raw/a.pdf', notes/b.md]\n---\nx") == ["Raw/a.pdf"] and vault.raw_sources_of("---\nsources: raw/b.md\n---\n") == ["raw/b.md"]
    assert vault.loose_head("--- \ntype: a\n--- \nx") == {"type": "a"} and vault.loose_head("x") == {} and vault.front_matter("--- \na: b\n---\n") is None
    assert vault.body_of("---\na: b\n---\n body ") == "body" and vault.body_of("abc", 2) == "ab\n...[truncated]"
    assert vault.synonyms("# c\ncam: [camera, 'lens']\nx\nb: d, e\n") == {"cam": ("camera", "lens"), "b": ("d", "e")}
    assert vault.environment("A=1\nexport B='2'\n# C=3\n", {"A": "0"}) == {"A": "0", "B": "2"}


def _word_file(paragraphs, media=None, rels=""):
    data = io.BytesIO()
    names = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {names}><w:body>{paragraphs}</w:body></w:document>")
        if rels:
            z.writestr("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>")
        for name, body in (media or {}).items():
            z.writestr(name, body)
    return data.getvalue()


def test_word_files_with_images():
    said = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    shown = lambda i: f'<w:p><w:r><pic:pic><a:blip r:embed="{i}"/></pic:pic></w:r></w:p>'
    rels = '<Relationship Id="r1" Target="media/a.png"/><Relationship Id="r2" Target="media/b.png"/><Relationship Id="r3" Target="other.xml"/>'
    got = documents.docx("Raw/My Doc.docx", _word_file(shown("r1") + said("Figure 1 Wiring") + said("text") + shown("r2") + shown("r3") + said("end"), {"word/media/a.png": b"1", "word/media/b.png": b"1"}, rels))
    assert got.text == "![[my-doc_img01.png]]  \nFigure 1 Wiring\ntext\n![[my-doc_img02.png]]\nend"
    assert [(i.filename, i.caption, i.source_media_name) for i in got.images] == [("my-doc_img01.png", "Figure 1 Wiring", "a.png"), ("my-doc_img02.png", "", "b.png")]
    assert [i.filename for i in documents.first_names(got.images)] == ["my-doc_img01.png"] * 2


def test_parser_markdown_routes_and_parts():
    got = documents.parser_markdown('![old](images/x.jpg)\n\nFig. 2 Case\n<table><tr><td><img src="images/y.png" alt="Y"></td><td></td></tr></table>', "doc", {"x.jpg": b"1"})
    assert got.text.startswith("![[doc_img01.jpg]]  \nFig. 2 Case") and "![[y.png]]  \nY" in got.text and got.tables == [[["![[y.png]] Y", ""]]]
    assert [(i.filename, i.caption, i.sha256 == "unknown") for i in got.images] == [("doc_img01.jpg", "Fig. 2 Case", False), ("y.png", "Y", True)]
    assert [documents.route(p) for p in ("a.MD", "b.docx", "c.pdf")] == ["text", "docx", "remote"] and documents.route("c.pdf", sensitive=True) == "local"
    for bad in (("a.zip", True), ("a.pdf", False)):
        with pytest.raises(ValueError):
            documents.route(*bad)
    assert documents.page_parts(200) == [("", 0, 200)] and documents.page_parts(401)[-1] == ("chunk_003.pdf", 400, 401) and documents.joined_parts(["a", "b"]) == "a\n\n---\n\nb"
    assert documents.strip_tables("a<table><tr></tr></table>b") == "a\n[table 1]\nb" and documents.embeds("{{IMG|assets/x.png|图注: $g _ { r }$}}") == "![[x.png]]  \n$g _ { r }$"


def test_parsers_plug_in_and_failures_are_noted(spark, tmp_path):
    for name, body in (("a.pdf", b"A"), ("b.pdf", b"!"), ("c.zip", b"z"), ("d.txt", "é".encode())):
        (tmp_path / name).write_bytes(body)
    raw = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path", "regexp_extract(path, '[.]([a-z]+)$', 1) as doc_type", "sha2(content, 256) as sha256", "content")

    def remote(name, data):
        if data == b"!":
            raise RuntimeError("down")
        return documents.Parsed("# T\n" + data.decode(), [documents.Image(f"i{n}.png", f"assets/i{n}.png", "", "m", "same", "", b"x") for n in (1, 2)])

    (tmp_path / "assets").mkdir()
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.parse(raw, {"remote": remote}, str(tmp_path / "assets")).collect()}
    assert got["a.pdf"].title == "T" and [i.filename for i in got["a.pdf"].images] == ["i1.png", "i1.png"] and (tmp_path / "assets" / "i1.png").read_bytes() == b"x"
    assert "down" in got["b.pdf"].fault and "UnsupportedFormat" in got["c.zip"].fault and got["d.txt"].text == "é"
    assert [r.rel_path for r in documents.asset_files(spark, str(tmp_path)).collect()] == ["assets/i1.png"]


def test_from_a_folder_to_a_hit(spark, tmp_path):
    wiki, root = tmp_path / "Wiki", str(tmp_path / "index")
    wiki.mkdir()
    (wiki / "a.md").write_text("---\ntitle: Camera\n---\n# Camera\n\nThe shutter uses code E4001 for overheating.\n")
    (wiki / "b.md").write_text("---\ntitle: Radar\n---\nThe radar head needs calibration.\n")
    (wiki / "no_head.md").write_text("skipped")
    calls = []

    def encode(texts):
        calls.append(len(texts))
        from loamweave.functions.embedding import hashed

        return hashed(texts, 16)

    done = []
    first = indexing.build_vault(spark, str(wiki), root, dim=16, work={"reports": done.append})
    sparse, dense = store.load(spark, root)
    asked = spark.createDataFrame([(1, "E4001")], "query_id int, query string")
    hits = fulltext.search(sparse, asked, 5, "chunk_id", "fts_text").join(sparse, "chunk_id").collect()
    assert {r.title for r in hits} == {"Camera"} and {r.chunk_kind for r in hits} == {"sparse", "dense"} and len(done) == 1
    assert store.stats(spark, root)["unindexed"] == 0 and dense.count() == sparse.where("chunk_kind = 'dense'").count()
    fulltext.write_index(sparse, "idx_test", "chunk_id", "fts_text", 2)
    stored = fulltext.search_index(spark.table("idx_test_postings"), spark.table("idx_test_lengths"), asked, 5, "chunk_id").collect()
    assert sorted((r.chunk_id, round(r.score, 9)) for r in stored) == sorted((r.chunk_id, round(r.score, 9)) for r in hits)
    spark.sql("drop table idx_test_postings")
    spark.sql("drop table idx_test_lengths")
    (wiki / "c.md").write_text("---\ntitle: Only\n---\n# Heading only\n")
    with pytest.raises(indexing.IncompletePages):
        indexing.build_vault(spark, str(wiki), root, dim=16)
    assert store.pointer(root)["build_id"] == first
    second = indexing.build_vault(spark, str(wiki), root, dim=16, fail_fast=False)
    assert second != first and store.load(spark, root)[0].where("title = 'Only'").count() == 0


def test_vectors_are_made_once_a_text(spark):
    from loamweave.functions import embedding

    chunks = spark.createDataFrame([("a", "h1", "camera"), ("b", "h1", "camera"), ("c", "h2", "radar"), ("d", None, "x")], "chunk_id string, content_hash string, text string")
    cached = spark.createDataFrame([("h1", [9.0] * 8), ("h9", [1.0] * 8)], "content_hash string, vector array<float>")
    got = {r.chunk_id: list(r.vector) for r in embedding.embedded(chunks, cached, lambda t: embedding.hashed(t, 8)).collect()}
    assert got["a"] == got["b"] == [9.0] * 8 and np.allclose(got["c"], embedding.hashed(["radar"], 8)[0]) and set(got) == {"a", "b", "c"}


def test_states_after_a_crash(spark, tmp_path):
    root = str(tmp_path / "idx")
    first = store.publish(*_chunks(spark), root, 2)
    second = store.publish(*_chunks(spark), root, 2)
    (Path(root) / first / "generation.json").write_text(json.dumps(json.loads((Path(root) / first / "generation.json").read_text()) | {"state": "published"}))
    (Path(root) / "build_x").mkdir()
    (Path(root) / "build_x" / "generation.json").write_text(json.dumps({"state": "building", "generation": 9, "build_id": "build_x"}))
    assert sorted(store.reconcile(root)) == sorted([first, "build_x"]) and store.reconcile(root) == [] and store.pointer(root)["build_id"] == second
    assert store.short_hash(None) == "" and len(store.short_hash("x")) == 12 and store.seal(root) > 0
    sparse, dense = _chunks(spark)
    assert "lacks" in store.faults(sparse.drop("fts_text"), dense, 2)[0] and store.faults(sparse, dense.selectExpr("'zz' as chunk_id", "vector"), 2) == ["1 vectors without a chunk"]


def test_tasks_are_tried_again(spark, tmp_path):
    root, calls = str(tmp_path), []

    def work(task):
        calls.append(task["task_id"])
        if len(calls) == 1:
            raise OSError("disk")

    journal.prepare(spark, root, "reports", "b1", 1)
    journal.prepare(spark, root, "reports", "b1", 1)
    journal.prepare(spark, root, "reports", "b2", 5)
    assert [t["state"] for t in journal.retry(spark, root, 1, {"reports": work})] == ["pending"]
    assert [t["state"] for t in journal.retry(spark, root, 1, {"reports": work})] == ["done"] and journal.retry(spark, root, 1, {"reports": work}) == []
    with pytest.raises(ValueError):
        journal.prepare(spark, root, "../x", "b", 1)


def test_report_sets(spark, tmp_path):
    from loamweave.operators import reports

    root = str(tmp_path)
    members = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "node string, community_id long")
    pages = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "page_id string, sha256 string")
    edges = spark.createDataFrame([("b", "a", 1.0, ["x"])], "source_id string, target_id string, weight double, edge_signals array<string>")
    made = reports.build(members, pages, edges)
    assert report_store.read_active(spark, root) is None and not report_store.mark_stale(spark, root, "graph", "new")
    manifest = report_store.stage_set(made, root, "r1")
    report_store.activate(spark, root, "r1")
    got, about = report_store.read_active(spark, root)
    assert about == manifest and about["report_count"] == 2 and [r.text for r in got.orderBy("community_id").collect()] == ["Community 0: a, b", "Community 1: c"]
    why = lambda **k: sorted((r.community_id, r.reason) for r in reports.stale_reasons(got, **({"assigned": members, "pages": pages, "edges": edges} | k)).collect())
    assert why() == [] and reports.status_of([]) == "fresh" and reports.status_of(None) == "missing"
    assert why(pages=pages.where("page_id != 'c'")) == [(1, "source_missing")] and why(edges=edges.limit(0)) == [(0, "edges")]
    assert why(assigned=members.where("node != 'b'")) == [(0, "membership")] and why(pages=pages.selectExpr("page_id", "'9' as sha256")) == [(0, "members"), (1, "members")]
    assert why(counter="other") == [(0, "counter"), (1, "counter")] and reports.status_of(["counter"]) == "token_counter_unavailable" and reports.status_of(["count"]) == "schema_unsupported"
    assert reports.stale_reasons(got, members, pages, edges, 3).collect()[0].reason == "count"
    asked = spark.createDataFrame([(1, ["A,", "COMMUNITY 1"]), (2, ["zzz", " "])], "query_id int, terms array<string>")
    chosen = sorted(tuple(r) for r in reports.select(got, asked, 5, 6).select("query_id", "community_id", "matches").collect())
    assert chosen == [(1, 0, 1), (2, 0, 0)] or chosen[0][0] == 1
    assert report_store.mark_stale(spark, root, "graph", "new") and report_store.read_active(spark, root)[1]["stale_producer"] == "graph"
    with pytest.raises(RuntimeError):
        report_store.stage_set(made, root, "r1")
    with pytest.raises(ValueError):
        report_store.build_path(root, "../x")


def test_vault_files(spark, tmp_path):
    page = vault_files.with_fulltext(None, "raw/a b_C.docx", "T", "body C:\\path", "2024-01-02")
    assert vault_files.page_name("raw/a b_C.docx") == "a-b-c.md" and "C:\\path" in page and vault.front_matter(page)[0]["sources"] == ["raw/a b_C.docx"]
    again = vault_files.with_fulltext(page.replace("<!-- TODO -->", "summary\n\n\n\n## 文档内嵌图片\n\n![[x.png]]\n"), "raw/a.docx", "T", "new \\1", "2025-03-04")
    assert "new \\1" in again and "body" not in again and "summary" in again and "文档内嵌图片" not in again and "updated: 2025-03-04" in again
    assert vault_files.clean_tags('---\ntags: [Euro NCAP, "#ok", c-ncap]\n---\nx')[0].startswith("---\ntags: [Euro-NCAP, ok, C-NCAP]") and vault_files.clean_tags("x") == ("x", 0)
    assert vault_files.contents_page([("s", "a", "A"), ("s", "b", "B"), ("t", "c", "C")], "2024-01-01").count("## ") == 2
    assert vault_files.project_title("x\n# Name \n", "dir") == "Name" and vault_files.project_title(None, "dir") == "dir"
    html = vault_files.graph_page([("a", "<A>", "x", 2), ("b", "B", "y", 0)], [("a", "b", 1.0), ("a", "zz", 1.0)], "T")
    assert html.count("<circle") == 2 and html.count("<line") == 1 and "&lt;A&gt;" in html
    graph = {"nodes": [{"id": "a", "title": "A"}, {"id": "b"}], "edges": [{"source": "a", "target": "b", "weight": 1, "signals": ["y", "x", "x"]}], "communities": [["a"], ["b"]]}
    files.write(spark, f"{tmp_path}/graph.json", json.dumps(graph))
    nodes, edges, members = vault_files.read_graph(spark, f"{tmp_path}/graph.json")
    assert edges.first().edge_signals == ["x", "y"] and nodes.count() == 2 and {(r.node, r.community_id) for r in members.collect()} == {("a", 0), ("b", 1)}
    files.write(spark, f"{tmp_path}/graph.json", "{")
    with pytest.raises(RuntimeError):
        vault_files.read_graph(spark, f"{tmp_path}/graph.json")
    vault_files.write_graph(nodes, spark.createDataFrame([("a", "b", 0.123456, ["z", "m"])], "u string, v string, weight double, signals array<string>"), f"{tmp_path}/g")
    assert spark.read.json(f"{tmp_path}/g/edges").first().signal == "m"


def test_stream_ingest_only_chunks_changes(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    Path(src).mkdir()
    write = lambda name, rows: (Path(src) / name).write_text("\n".join(json.dumps(r) for r in rows))
    page = lambda p, c: {"page_id": p, "title": p, "content": c, "updated_at": "2024-01-01T00:00:00"}
    write("1.json", [page("a", "one two"), page("b", "three")])
    ingest.ingest(ingest.page_stream(spark, src), out, cp).awaitTermination(120)
    write("2.json", [page("a", "one two"), page("b", "changed"), page("c", "new")])
    ingest.ingest(ingest.page_stream(spark, src), out, cp).awaitTermination(120)
    assert {r.page_id for r in spark.read.parquet(f"{out}/chunks/batch_1").collect()} == {"b", "c"}


def test_stream_folders_are_put_together_and_failures_are_raised(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "COMPACT", 2)
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    Path(src).mkdir()
    page = lambda p, c: {"page_id": p, "title": p, "content": c, "updated_at": "2024-01-01T00:00:00"}
    for n in range(4):
        (Path(src) / f"{n}.json").write_text("\n".join(json.dumps(r) for r in [page("a", "same"), page(f"p{n}", "new")]))
        ingest.ingest(ingest.page_stream(spark, src), out, cp).awaitTermination(120)
    assert sorted(p.name for p in (Path(out) / "manifest").iterdir() if p.is_dir()) == ["batch_2", "batch_3"]
    assert {r.page_id for r in spark.read.parquet(f"{out}/chunks/batch_3").collect()} == {"p3"}
    for f in (Path(out) / "manifest" / "batch_3").glob("*.parquet"):
        f.write_bytes(b"broken")
    (Path(src) / "9.json").write_text(json.dumps(page("z", "x")))
    with pytest.raises(Exception):  # noqa: B017  a manifest that can't be read is no empty one
        ingest.ingest(ingest.page_stream(spark, src), out, cp).awaitTermination(120)

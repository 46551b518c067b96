"""Small tests of the operators for training data: brute force, round trips, and the defined results of odd input."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamweave.llm import language, markup, mixing, neighbours, packing, ranking, scanrepair, splitting, truncation
from loamweave.llm.boosting import Boosting


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# language

EN = "The camera keeps the last valid frame. Tighten the four screws evenly. The sensor is clean and the cable is long."
DE = "Die Kamera behält das letzte Bild. Ziehen Sie die vier Schrauben gleichmäßig an. Der Sensor ist sauber und das Kabel ist lang."
ZH = "相机保留最后一帧有效图像。均匀拧紧四颗螺钉。传感器很干净，线缆很长。"


@pytest.fixture(scope="module")
def model():
    return language.fit([(s, language.LANGUAGES.index(c)) for c, t in (("en", EN), ("de", DE), ("zh", ZH)) for _, s, _ in language.sentences(t)] * 3)


def test_forward_sums_all_segmentations(model):
    word = " frame"

    def brute(rest):
        if not rest:
            return 1.0
        return sum(model.table[model.pieces.index[rest[:j]], 0] * brute(rest[j:]) for j in range(1, len(rest) + 1) if rest[:j] in model.pieces.index)

    assert np.isclose(model.forward(word)[0], np.log(brute(word)))


def test_words_of_any_length_are_scored_whole(model):
    word = "rindfleischetikettierungsüberwachungsaufgabenübertragungsgesetz"
    got = model.forward(" " + word)

    def brute(col):
        alpha = [1.0] + [0.0] * (len(word) + 1)
        for i, j, piece in model.pieces.spans(" " + word):
            alpha[j] += alpha[i] * model.table[piece, col]
        return np.log(alpha[-1])

    assert np.allclose(got[[0, 2]], [brute(0), brute(2)]) and len(word) > 24
    assert (np.diff([model.forward("相机" * n)[1] for n in (5, 50, 500, 5000)]) < 0).all() and np.isfinite(model.forward(" " + "ab" * 20_000)).all()
    longest = max((p for p in model.pieces.index if p.strip().isalpha()), key=len)
    assert any(j - i == len(longest) for i, j, _ in model.pieces.spans(longest)) and len(longest) > 12


def test_long_tags_are_no_prose(model):
    tag = "<div " + "data-x='the camera keeps the frame.' " * 40 + ">"
    assert [s.strip() for _, s, _ in language.sentences(f"{tag} Clean it. 3 < 5 and 7 > 2.")] == ["Clean it", "3 < 5 and 7 > 2"]


def test_main_language_and_paragraphs(model):
    got = language.identify_all([EN, f"{EN}\n\nDer Sensor ist sauber und lang. {EN}\n\n```\nDie Kamera behält das Bild.\n\nx\n```\n\n{ZH}", ZH, None, "", "12 | 34", DE * 200], model)
    assert [g[0] for g in got] == ["en", "en", "zh", None, None, None, "de"]
    assert [(p, lang) for p, lang, _ in got[1][2]] == [(2, "de"), (5, "zh")]
    assert all(0 <= g[1] <= 1 for g in got)


def test_confidence_is_about_the_share_of_right_answers(model):
    rng = random.Random(3)
    vocab = {c: language.words(t) for c, t in (("en", EN), ("de", DE))}
    docs = []
    for _ in range(60):
        lang = rng.choice(["en", "de"])
        other = "de" if lang == "en" else "en"
        docs.append((" ".join(" ".join(rng.choice(vocab[lang] if rng.random() < 0.6 else vocab[other]) for _ in range(4)) + "." for _ in range(9)), language.LANGUAGES.index(lang)))
    import copy

    own = copy.copy(model)
    own.calibrate(docs[:40])
    found = [(language.words(s), lang) for t, lang in docs[40:] for _, s, _ in language.sentences(t)]
    scores, weights = own.score_all([f for f, _ in found])
    posterior = own.posterior(scores, weights)
    right = np.mean(scores.argmax(1) == [lang for _, lang in found])
    assert abs(posterior.max(1).mean() - right) < 0.12


def test_unknown_languages_are_not_trusted(model):
    import copy

    own = copy.copy(model)
    own.usual, own.spread = model.usual.copy(), model.spread.copy()
    own.calibrate([(" ".join([t] * 3), language.LANGUAGES.index(c)) for c, t in (("en", EN), ("de", DE)) for _ in range(6)])
    sure = lambda t: language.identify_all([t], own)[0][1]
    assert sure(EN) > 0.9 and sure("Kamera zachowuje ostatnią poprawną klatkę. Równomiernie dokręć cztery śruby. Czujnik jest czysty.") < 0.5


def test_labels_and_detection_in_spark(spark, model):
    df = spark.createDataFrame([("EN-us",), ("Chinese",), (" ",), ("n/a",), (None,), ("deu",)], "lang string")
    assert [r[0] for r in df.select(language.label_code(F.col("lang"))).collect()] == ["en", "zh", None, None, None, "de"]
    texts = spark.createDataFrame([("t", "1", EN, 0.5), ("t", "1", EN, 0.5), ("t", "2", None, 0.1)], "src_table string, rec_key string, text string, confidence double")
    got = language.detect(texts, model).collect()
    assert sorted((r.rec_key, r.lang) for r in got if r.lang) == [("1", "en"), ("1", "en")] and len(got) == 3
    assert language.detect(texts.limit(0), model).count() == 0


# neighbours


def _vectors(n=400, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    return centres[rng.integers(0, 20, n)] + 0.4 * rng.standard_normal((n, dim))


def test_recall_against_brute_force(spark):
    x = _vectors()
    df = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<float>")
    got = {}
    for r in neighbours.similar(df).collect():
        got.setdefault(r.id, set()).add(r.other)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    want = {f"v{i:04d}": {f"v{j:04d}" for j in np.argsort(-s[i])[:5]} for i in range(len(x))}
    assert all(len(v) == 5 for v in got.values()) and np.mean([len(got[k] & want[k]) / 5 for k in want]) >= 0.9


def test_recall_without_clusters(spark):
    x = np.random.default_rng(3).standard_normal((1500, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    found = {}
    for r in neighbours.similar(df).collect():
        found.setdefault(r.id, set()).add(r.other)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    assert np.mean([len(found[i] & set(np.argsort(-s[i])[:5].tolist())) / 5 for i in range(0, 1500, 20)]) >= 0.9


def test_a_cell_with_a_third_of_all_vectors_is_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "DATA_BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 50)
    rng = np.random.default_rng(4)
    x = np.concatenate([_vectors(300), np.eye(64)[0] + 0.01 * rng.standard_normal((200, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    found = {}
    for r in neighbours.similar(df).collect():
        found.setdefault(r.id, set()).add(r.other)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    assert np.mean([len(found[i] & set(np.argsort(-s[i])[:5].tolist())) / 5 for i in range(500)]) >= 0.97


def test_groups_cover_all_cells_once():
    rng = np.random.default_rng(5)
    held = rng.integers(0, 50, 90).astype(float)
    held[7] = 900
    group = neighbours.grouped(rng.standard_normal((90, 8)), held, 120)
    assert sorted(set(group)) == list(range(max(group) + 1))
    assert all(held[group == g].sum() <= 120 or (group == g).sum() == 1 for g in set(group))


def test_counts_of_common_bits_estimate_within_the_bound():
    x = _vectors(300)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c, turn = x[:50].mean(0), neighbours.rotation(64)
    bits, length, fit = neighbours.encode(x, c, turn)
    guess, bound = neighbours.estimates((x[:20] - c) @ turn, bits, length, fit)
    assert (np.abs(guess - (x[:20] - c) @ (x - c).T) <= bound + 1e-5).mean() > 0.99


def test_estimates_lie_within_their_bounds():
    x = _vectors(300)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c, turn = x[:50].mean(0), neighbours.rotation(64)
    bits, length, fit = neighbours.encode(x, c, turn)
    signs = (np.unpackbits(bits, axis=1).astype(float) * 2 - 1) / 8
    guess = ((x[:20] - c) @ turn) @ signs.T * (length / fit)
    bound = neighbours.EPSILON * np.linalg.norm(x[:20] - c, axis=1)[:, None] * length * np.sqrt(1 - fit**2) / (fit * np.sqrt(63))
    assert (np.abs(guess - (x[:20] - c) @ (x - c).T) <= bound + 1e-5).mean() > 0.99


def test_copies_and_unusable_vectors(spark):
    one, two = [1.0] * 64, [1.0] * 63 + [-9.0]
    bad = [None, [], [1.0], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63]
    data = [(f"c{i}", one, "x") for i in range(9)] + [("c0", one, "x"), ("z", two, "y"), (None, one, "q")] + [(f"b{i}", v, "k") for i, v in enumerate(bad)]
    got = neighbours.similar(spark.createDataFrame(data, "id string, vector array<float>, key string")).collect()
    of = lambda i: [r.other for r in sorted(got, key=lambda r: r.place) if r.id == i]
    assert of("c8") == ["c0", "c1", "c2", "c3", "c4"] and of("c0") == ["c1", "c2", "c3", "c4", "c5"] and of("z") == ["c0", "c1", "c2", "c3", "c4"]
    assert not {r.id for r in got} & {f"b{i}" for i in range(6)}
    assert neighbours.similar(spark.createDataFrame([], "id string, vector array<float>")).count() == 0


# ranking

HITS = "query_id long, page_id string, score double, retrieval_method string, distance double, seed_page_id string, retrieved_at timestamp, fused double"


def _condorcet(table):
    out = {}
    for q, pages in table.items():
        lead = lambda a, b: sum((x > y) - (x < y) for x, y in zip(pages[a], pages[b]))
        best = [p for p in pages if all(lead(p, o) > 0 for o in pages if o != p)]
        if best:
            out[q] = best[0]
    return out


def test_leaders_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FOLD", 4)
    rng = random.Random(4)
    data, table = [], {}
    for q in range(40):
        for p in range(rng.randint(1, 14)):
            vals = [rng.choice([None, round(rng.random(), 1)]) for _ in range(3)]
            if all(v is None for v in vals):
                continue
            table.setdefault(q, {})[f"p{p}"] = [float("-inf") if v is None else v for v in vals]
            for m, v in zip(("bm25", "fused", "vector"), vals):
                if v is not None:
                    data.append((q, f"p{p}", v * (1000 if m == "bm25" else 1) if m != "vector" else None, m, -v if m == "vector" else None, None, datetime(2024, 1, 2), 7.0))
                    data.append((q, f"p{p}", 99.0, m, -99.0, None, datetime(2024, 1, 1), 7.0))
    edges = spark.createDataFrame([], "source_id string, target_id string, weight double")
    got = ranking.leaders(ranking.fuse(spark.createDataFrame(data, HITS), edges))
    assert dict(r[:2] for r in rows(got)) == _condorcet(table)


def test_ranking_of_odd_rows(spark):
    t = datetime(2024, 1, 1)
    hits = spark.createDataFrame([(1, "a", None, "graph", None, "s", t, 0.0), (1, "b", None, "graph", None, "s", t, 0.0), (1, "b", float("nan"), "bm25", None, None, t, 0.0), (None, "c", 1.0, "bm25", None, None, t, 0.0), (2, "d", 1.0, "odd", None, None, t, 0.0), (3, "e", 0.5, "vector", None, None, None, 0.0)], HITS)
    edges = spark.createDataFrame([("a", "s", 2.0, "x"), ("s", "b", 1.0, "x"), ("b", "s", None, "x")], "source_id string, target_id string, weight double, value string")
    assert [r[:2] for r in rows(ranking.leaders(ranking.fuse(hits, edges)))] == [(1, "a"), (3, "e")]
    assert ranking.fuse(hits.limit(0), edges).count() == 0


def test_no_method_outweighs_by_range(spark):
    t = datetime(2024, 1, 1)
    data = [(1, f"p{i}", s, m, None, None, t, 0.0) for m, k in (("bm25", 1.0), ("fused", 0.001)) for i, s in enumerate(k * x for x in (5, 4, 3, 2, 1))]
    edges = spark.createDataFrame([], "source_id string, target_id string, weight double")
    a = rows(ranking.bounded_scores(ranking.counted_values(spark.createDataFrame(data, HITS), edges)).select("retrieval_method", "page_id", F.round("bounded", 9)))
    assert [x[2] for x in a if x[0] == "bm25"] == [x[2] for x in a if x[0] == "fused"]


def test_outliers_do_not_tie_and_half_equal_values_still_rank(spark):
    t = datetime(2024, 1, 1)
    data = [(1, f"p{i}", s, "bm25", None, None, t, 0.0) for i, s in enumerate((1.0, 2.0, 3.0, 4.0, 5.0, 1e3, 1e6, 1e9))] + [(2, f"p{i}", s, "bm25", None, None, t, 0.0) for i, s in enumerate((1.0, 1.0, 1.0, 1.0, 2.0, 3.0))]
    data += [(3, "p0", 4.0, "bm25", None, None, t, 0.0), (3, "p1", 4.0, "bm25", None, None, t, 0.0)]
    edges = spark.createDataFrame([], "source_id string, target_id string, weight double")
    got = {(r.query_id, r.page_id): r.bounded for r in ranking.bounded_scores(ranking.counted_values(spark.createDataFrame(data, HITS), edges)).collect()}
    assert [got[1, f"p{i}"] for i in range(8)] == sorted({got[1, f"p{i}"] for i in range(8)}) and 0 < got[1, "p0"] and got[1, "p7"] < 1
    assert got[2, "p0"] == got[2, "p3"] < got[2, "p4"] < got[2, "p5"] and got[3, "p0"] == got[3, "p1"] == 0.5


# markup


@pytest.mark.parametrize("text, kinds", [
    ("# A\n\n- x\n", ["heading", "list"]), ("A\n---\n\ntext", ["heading"]), ("== A ==\n* x", ["heading", "list"]), ("\\section{A} \\begin{itemize}\n\\item x\n\\end{itemize}", ["heading", "list"]),
    ("<H2 class=a>\nA\n</H2>\n<ul><li>x</ul>", ["heading", "list"]), ("```\n# no\n- no\n```", ["code"]), ("<pre># no &amp; - no</pre>", ["code"]), ("\\begin{verbatim}\n# no\n\\end{verbatim}", ["code"]),
    ("text\n\n    # no\n    - no\n", ["code"]), ("<source lang=sh>\nx\n</source>", ["code"]), ("a $x_1 = 2$ b", ["formula"]), ("\\[ x \\]", ["formula"]), ("<math>x</math>", ["formula"]), ("$$\nx\n$$", ["formula"]),
    ("<!-- # no -->", []), ("\\# no \\$1 a\\$", []), ("`# no`", []), ("costs $5 and $6 there", []), ("Label:", []), ("5 * 9 * 2", []), ("a = 3 == b", []), ("&lt;h1&gt;no&lt;/h1&gt;", []), ("", []), (None, []), ("• x\n• y", ["list"]), ("see #60", []),
])
def test_elements(text, kinds):
    assert markup.convert(text)[1] == kinds


def test_clean_text_keeps_structure_and_drops_navigation():
    html = "<nav><a href=1>Home</a><a href=2>Next</a></nav>\n<h1>Head</h1>\n<p>" + "Long body text. " * 10 + "</p>\n<ul><li>one<li>two</ul>\n<pre>x = 1</pre>\n<p>E = <math>m c^2</math></p>"
    got = markup.convert(html)[0]
    assert "# Head" in got and "- one" in got and "```\nx = 1\n```" in got and "$m c^2$" in got and "Home" not in got
    assert markup.convert("a **b** [c](d) [[e|f]] ''g''")[0] == "a b c f g"
    assert len(markup.convert("word " * 50_000)[0]) > 200_000


@pytest.mark.parametrize("text", ["\\[" + "x^2 + " * 2000 + "1\\]", "\\(" + "x^2 + " * 2000 + "1\\)", "$$" + "x^2 + " * 2000 + "1$$", "$" + "x^2 + " * 2000 + "1$", "$$a = b\n\nc = d$$", "\\[a = b\n\nc = d\\]"])
def test_formulas_of_any_length(text):
    assert markup.convert(f"before {text} after")[1] == ["formula"] and markup.hold(text)[1][0].end == len(text)


def test_navigation_is_no_content_region():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Page {i}</a></li>" for i in range(8)) + "</ul>\n"
    body = "<p>" + "The camera keeps the last valid frame. " * 12 + "</p>\n"
    assert markup.convert(menu + body)[1] == [] and "Page 3" not in markup.convert(menu + body)[0]
    assert markup.convert(menu + body + "<ul><li>Clean the <a href=x>lens</a> with a soft cloth</ul>")[1] == ["list"]
    inline = "<p>See the <a href=x>manual</a> for the long list of all values.</p>\n" + body
    assert "See the manual" in markup.convert(inline)[0]


def test_clean_in_spark(spark):
    df = spark.createDataFrame([("t", "1", "# A", "x"), ("t", "2", None, "x"), ("t", "3", "", "x")], "src_table string, rec_key string, text string, kinds string")
    assert rows(markup.clean(df)) == [("t", "1", "# A", ["heading"]), ("t", "2", "", []), ("t", "3", "", [])]


# splitting


@pytest.mark.parametrize("seed", range(30))
def test_pieces_cover_the_text_within_the_limit(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "词", "句。", "end. ", "\n", "\n\n", "| ", "x" * rng.randint(1, 300), "  ", "\n# h\n"]) for _ in range(rng.randint(0, 400)))
    limit = rng.choice([8, 25, 250])
    pieces = splitting.split_text(text, limit, 5)
    assert "".join(text[f:e] for _, f, e, _ in pieces) == text
    for (a, f, e, _), (_, _, before, _) in zip(pieces[1:], pieces):
        assert f == before and a <= f
    assert all(splitting.tokens(e - a) <= limit for a, _, e, _ in pieces)
    import re

    atoms = re.split(r"(?<=[。！？!?；|\n])|(?<=[.;])(?=\s)", text)
    assert any(p[3] for p in pieces) == (len(text) >= 4 * limit + 4 and any(len(x.strip()) >= 4 * (limit + 1) for x in atoms))


@pytest.mark.parametrize("text", ["x" * 5000, "见传感器" * 900, "word. " * 900, ("y" * 300 + ". ") * 20, "z" * 1500 + " " + "w " * 900, ("v" * 950 + "\n") * 5, "a b\n" + "u" * 940 + "\n" + "t" * 400])
def test_every_later_piece_has_the_overlap(text):
    pieces = splitting.split_text(text)
    assert len(pieces) > 1 and all(splitting.tokens(e - a) <= 250 for a, _, e, _ in pieces)
    for (start, _, before, _), (a, f, e, _) in zip(pieces, pieces[1:]):
        tight = any(len(x) > 923 for x in text[f:e].split("\n")) and len(set(text[f:e].strip())) == 1 and e - f > 923
        assert f == before and a >= start and f - a <= 80
        assert f - a >= (min(40, 1003 - (e - f)) if tight else min(40, before - start))


def test_the_overlap_starts_at_the_best_boundary():
    text = "这是一句话。" * 400
    assert all(text[a - 1] == "。" for a, _, _, _ in splitting.split_text(text)[1:])
    text = "plain words only " * 300
    assert all(text[a - 1] == " " for a, _, _, _ in splitting.split_text(text)[1:])


def test_split_in_spark(spark):
    df = spark.createDataFrame([("a", "[]", "x" * 1100, 1), ("a", "[]", "x" * 1100, 2), ("b", None, "word. " * 300, 0), ("c", "[]", None, 0), ("d", "[]", "", 0)], "chunk_id string, section_path string, text string, piece_no int")
    got = splitting.split_chunks(df)
    assert rows(got.groupBy("chunk_id", "must_force").count()) == [("a", 1, 2), ("b", 0, 2)]
    assert got.where("overlap_chars > 0").count() >= 1 and splitting.split_chunks(df.limit(0)).count() == 0


# packing


@pytest.mark.parametrize("seed", range(10))
def test_plan_places_everything_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 64, 1000])
    counts = {s: rng.randint(1, 9) for s in rng.sample(range(1, cap + 1), min(cap, 60) // 2)}
    boxes, seen = {}, {}
    for size, first, last, each, at in packing.plan_containers(counts, cap):
        for o in range(first, last + 1):
            seen.setdefault(size, []).append(o)
            boxes[at + (o - first) // each] = boxes.get(at + (o - first) // each, 0) + size
    assert {s: sorted(v) for s, v in seen.items()} == {s: list(range(n)) for s, n in counts.items()}
    total = sum(s * n for s, n in counts.items())
    assert max(boxes.values()) <= cap and sorted(boxes) == list(range(len(boxes))) and len(boxes) <= 1.4 * -(-total // cap) + 1


def test_exact_complements_fill():
    assert len({r[4] for r in packing.plan_containers({7: 4, 3: 4}, 10)}) == 1 and packing.plan_containers({7: 4, 3: 4}, 10)[-1][2] == 3
    assert packing.plan_containers({5: 3, 1: 1, 4: 1}, 10) and packing.plan_containers({}, 10) == []


def test_pack_in_spark(spark):
    texts = spark.createDataFrame([(i, 7 if i % 3 else 3, "x") for i in range(30)] + [(100, 25, "x"), (101, 20, "x"), (102, None, "x")], "id long, size long, container string")
    profiles = spark.createDataFrame([("p", 10), ("p", 9), ("q", None)], "profile string, capacity_tokens long")
    got = packing.pack(texts, profiles)
    assert rows(got.groupBy("id").agg(F.sum("piece_size")).where("id >= 100")) == [(100, 25), (101, 20)]
    assert got.groupBy("container").agg(F.sum("piece_size").alias("s")).where("s > 10").count() == 0
    assert {r.id for r in got.where("oversized").collect()} == {100, 101} and got.select("id", "piece_no").distinct().count() == got.count()
    assert packing.pack(texts.limit(0), profiles).count() == 0 and packing.pack(texts, profiles.limit(0)).count() == 0


def test_a_size_of_a_third_of_all_texts_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 7)
    texts = spark.createDataFrame([(i, 4 if i % 3 else 1 + i % 10) for i in range(300)], "id long, size long")
    got = packing.pack(texts, spark.createDataFrame([("p", 10)], "profile string, capacity_tokens long"))
    assert got.count() == got.select("id").distinct().count() == 300
    filled = [r[0] for r in got.groupBy("container").agg(F.sum("piece_size").alias("s")).select("s").collect()]
    assert max(filled) <= 10 and len(filled) <= sum(filled) / 10 * 1.2 + 1


# mixing


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.997, "b": 0.003}, {"a": 1.0}, {chr(97 + i): 1.0 for i in range(7)}, {"a": 1.0, "b": 1e-9}])
def test_pfair_stays_within_one_block(weights):
    slots = mixing.pfair_period(weights)
    order = sorted((at, s) for s, x in slots.items() for at in x)
    assert [at for at, _ in order] == list(range(len(order)))
    share = {s: len(x) / len(order) for s, x in slots.items()}
    have = dict.fromkeys(slots, 0)
    for n, (_, s) in enumerate(order, 1):
        have[s] += 1
        assert all(abs(have[o] - n * share[o]) < 1 for o in have)
    assert all(x for x in slots.values())


def test_mix_in_spark(spark):
    docs = spark.createDataFrame([(i, " A " if i % 2 else "a", 10, "x") for i in range(10)] + [(100 + i, "b", 10, "x") for i in range(2)] + [(200, None, 9, "x"), (201, "c", None, "x")], "id long, source string, size long, tokens string")
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "B", 0.5, 2), ("m", "none", 0.0, 1), (None, "a", 1.0, 1)], "mix string, source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets, 20)
    sizes = docs.where("size is not null").withColumn("source", F.lower(F.trim("source")))
    got = {r.source: r for r in mixing.reached_shares(mixed, mixing.mix_plan(sizes, targets)).collect()}
    assert (got["a"].placed_tokens, got["a"].copies, got["a"].short) == (60, 1, False)
    assert (got["b"].placed_tokens, got["b"].copies, got["b"].short) == (40, 2, True) and got["none"].placed_tokens == 0
    assert mixing.mix(docs.limit(0), targets).count() == 0


def test_small_shares_keep_their_weight():
    slots = mixing.pfair_period({"a": 0.997, "b": 0.0026, "c": 0.0004})
    assert {s: len(x) / sum(map(len, slots.values())) for s, x in slots.items()} == {"a": 0.997, "b": 0.0026, "c": 0.0004}
    assert mixing.pfair_period({"a": 0.0, "b": -1.0}) == {"a": [], "b": []} and mixing.pfair_period({}) == {}


def test_order_stays_within_a_block_and_a_document(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, "abc"[i % 3], rng.randint(1, 300)) for i in range(600)], "id long, source string, size long")
    targets = spark.createDataFrame([("m", "a", 0.2, 3), ("m", "b", 0.5, 3), ("m", "c", 0.3, 3)], "mix string, source string, target_share double, max_repeats int")
    got = mixing.deviations(mixing.mix(docs, targets, 100), 100).collect()
    assert {r.source for r in got} == set("abc") and all(r.behind < 100 and r.ahead < 100 + r.longest for r in got)


# truncation

SENTENCES = ["The camera keeps the last valid frame.", "Tighten the four screws evenly.", "Wait 5 seconds for the relay to settle.", "用干布清洁视窗。", "Send the log to the service desk."]


def _texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        paras = [" ".join(rng.choices(SENTENCES, k=rng.randint(2, 5))) if rng.random() < 0.7 else "\n".join("- " + s.rstrip(".。") for s in rng.choices(SENTENCES, k=3)) for _ in range(rng.randint(2, 5))]
        out.append("\n\n".join(paras) + rng.choice(["", "", "\n\nKind regards", "\n\n— QA 7"]))
    return out


def test_held_out_accuracy():
    model = truncation.train([(t, False, -1) for t in _texts(600, 1)])
    rng = random.Random(2)
    good = _texts(300, 3)
    cut = [c for t in _texts(300, 4) for c in truncation._cuts(t, rng, 1)]
    score = lambda ts: model.scores(np.array([truncation.features(t, False, -1) for t in ts]))
    assert (score(good) < 0.5).mean() > 0.97 and (score(cut) >= 0.5).mean() > 0.9


def test_truncated_in_spark(spark):
    texts = _texts(200, 5)
    data = [(i, "s", t, 1.0) for i, t in enumerate(texts)] + [(900 + i, "lim", (t * 3)[:150], 1.0) for i, t in enumerate(_texts(40, 6))] + [(1000, None, None, 0.0), (1001, "s", "  ", 0.0), (1002, None, "ok. " * 20_000, 0.0)]
    df = spark.createDataFrame(data, "id long, source string, text string, score double")
    got = {r.id: r for r in truncation.truncated(df).collect()}
    assert set(got) == set(range(200)) | set(range(900, 940)) | {1002} and got[1002].source == "" and not got[1002].cut
    assert np.mean([got[i].cut for i in range(900, 940)]) > 0.6 and np.mean([got[i].cut for i in range(200)]) < 0.05
    assert truncation.truncated(df.limit(0)).count() == 0


def test_footers_and_marks_come_off(spark):
    data = [(i, "lab", f"Text {i} is cu\n\n-- lab export {i}") for i in range(20)] + [(50, "x", "It was cut he…"), (51, "x", "It was cut he [...]")]
    df = spark.createDataFrame(data, "id long, source string, text string")
    got = {r.id: (r.own, r.marked) for r in truncation.own_texts(df, truncation.endings(df)).collect()}
    assert got[3] == ("Text 3 is cu", False) and got[50] == ("It was cut he", True) and got[51] == ("It was cut he", True)


def test_long_footers_come_off(spark):
    foot = "-- exported by the laboratory information system of the northern plant, sheet {} of the yearly collection of reports"
    data = [(i, "lab", f"Text {i} is cu\n\n{foot.format(i)}") for i in range(20)]
    df = spark.createDataFrame(data, "id long, source string, text string")
    assert {r.own for r in truncation.own_texts(df, truncation.endings(df)).collect()} == {f"Text {i} is cu" for i in range(20)}


# scans


def _scan(seed):
    rng = random.Random(seed)
    base = "the shutter driver keeps the last valid frame because the temperature upper limit of this controller was reached and the operator confirms it"
    lines = []
    for page in range(1, 4):
        lines.append("Brand | Overview")
        for _ in range(6):
            lines.append(" ".join(rng.sample(base.split(), 9)))
        lines += [f"- {page} -"]
    return lines


def test_furniture_hyphens_and_misreadings(spark):
    clean_text = " ".join(["the shutter driver keeps the last valid frame because the temperature upper limit of this controller was reached and the operator confirms it read-only self-test"] * 5)
    data = []
    for i in range(20):
        lines = _scan(i)
        lines[2:4] = ["the last valid frame because the tem-", "perature limit of this controller is read-"]
        lines[4] = "only and the c0ntroller was reached"
        data.append(("t", str(i), "\n".join(lines), "x"))
    data += [("t", "null", None, "x"), ("t", "empty", "", "x"), ("t", "prose", "One line.\n\nAnother line.", "x")]
    texts = spark.createDataFrame(data, "src_table string, rec_key string, text string, noise string")
    noise, scanned = scanrepair.scan_noise(texts, spark.createDataFrame([(clean_text,)], "text string"))
    got = noise.where("rec_key = '3'").collect()
    of = lambda n: sorted(r.line_no for r in got if r.noise == n)
    assert [(r.was, r.becomes) for r in got if r.noise == "misread"] == [("c0ntroller", "controller")]
    assert of("header") == [1, 9, 17] and of("page_number") == [8, 16, 24] and of("hyphen") == [3] and of("misread") == [5]
    assert [(r.was, r.becomes) for r in got if r.noise == "misread"] == [("c0ntroller", "controller")] and scanned.count() == 20
    fixed = scanrepair.rebuild(data[3][2], [(r.line_no, r.noise, r.was, r.becomes) for r in got])
    assert "temperature limit" in fixed and "controller was reached" in fixed and "Brand" not in fixed and "- 2 -" not in fixed


def test_nothing_is_furniture_against_the_classifier():
    model = scanrepair.train_furniture(["\n".join(_scan(i)) for i in range(12)])
    assert scanrepair.furniture(_scan(50), model)
    model.weights[:] = -9.0
    assert scanrepair.furniture(_scan(50), model) == {}


def test_page_numbers_of_any_language_by_their_counting():
    lines = lambda word: [x.replace("- ", f"{word} ").replace(" -", "") if x.startswith("- ") else x for x in _scan(7)]
    assert sorted(i for i, yes in scanrepair.counting(lines("Strana")).items() if yes) == [7, 15, 23]
    assert not any(scanrepair.counting(["Kit 4", "x", "Kit 9", "x", "Kit 2"]).values())


def test_confusions_are_learned(spark):
    names = ["controller", "operator", "connector", "monitor", "sensor port", "protocol"]
    near = [(w.replace("o", "0", 1), False, 3, w, 9, 1) for w in names] + [("Danzeka", True, 5, "Danze", 9, 2), ("timers", False, 4, "timer", 9, 1)]
    df = spark.createDataFrame(near, "read string, capital boolean, n_read long, word string, n_clean long, edits int")
    assert scanrepair.learn_confusions(df).pairs == [("o", "0")]
    assert scanrepair.difference("modem", "modern") == ("rn", "m") and scanrepair.difference("bare", "bar") == ("r", "re") and scanrepair.difference("abcdefgh", "xyz") is None


def test_near_words_equal_brute_force(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("aeiknrst") for _ in range(rng.randint(2, 14))) for _ in range(150)})
    reads = sorted({w[: k] + rng.choice("aeiknrst") + w[k + rng.randint(0, 1) :] for w in words for k in [rng.randrange(len(w))]} - set(words))
    left = spark.createDataFrame([(r, False, 1) for r in reads], "read string, capital boolean, n_read long")
    got = {(r.read, r.word): r.edits for r in scanrepair.near_words(left, spark.createDataFrame([(w, 5) for w in words], "word string, n_clean long")).collect()}
    grams = lambda w: {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)}
    for r in reads:
        most = 2 if len(r) <= 4 else max(3, len(r) // 5)
        for w in words:
            e = scanrepair._edits(r, w)
            if e <= most and abs(len(r) - len(w)) <= 2 and len(r) + 1 - 2 * e > 0 and len(w) + 1 - 2 * e > 0 and grams(r) & grams(w):
                assert got.get((r, w)) == e
    assert all(scanrepair._edits(r, w) == e for (r, w), e in got.items())


def test_no_scans_give_no_rows(spark):
    texts = spark.createDataFrame([("t", "1", "Plain text.")], "src_table string, rec_key string, text string")
    noise, _ = scanrepair.scan_noise(texts, texts.select("text").limit(0))
    assert noise.count() == 0


def test_distance_and_page_numbers():
    known = scanrepair.Confusions([("o", "0"), ("u", "ii")])
    assert scanrepair.distance("c0ntroller", "controller", known) == pytest.approx(0.2) and scanrepair.distance("c0ntroiler", "controller", known) < 1.3
    assert scanrepair.distance("defaiilt", "default", known) == pytest.approx(0.2) and scanrepair.distance("frame", "frame", known) == 0
    assert scanrepair._in_step(["4", "x", "99", "5", "6"], [0, 2, 3, 4]) == [0, 3, 4]


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((Boosting().fit(x, y).scores(x) > 0.5) == (y > 0.5)).mean() > 0.95

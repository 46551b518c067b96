"""Language of documents and of stretches in another language, with a confidence.

Each language has probabilities for the pieces of a fixed public vocabulary. A word is
scored by the forward algorithm, which sums the probabilities of all its segmentations
into pieces; the pieces' probabilities are fitted by expectation-maximisation on a
bounded sample of labelled documents whose sentences are relabelled once by the model
itself, so wrong labels do not last. How sure a score makes, and how well a text of each
language fits it, is measured on further documents, so a confidence is about the share of
right answers, and text of a language the model has not learned gets a low one.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.llm.markup import hold
from loamweave.operators.stage import newest
from loamweave.sources.tables import table

VOCABULARY = os.environ.get("LOAMWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "ja")
#: Spellings of the languages in labels.
SPELLINGS = {
    "en": "en eng english", "zh": "zh zho chi cmn chinese mandarin", "de": "de deu ger german", "fr": "fr fra fre french",
    "es": "es spa spanish castilian", "pt": "pt por portuguese", "ja": "ja jpn jp japanese",
}
#: Labelled documents the model is fitted on, for each language, at most.
SAMPLE = 120
#: Further labelled documents the confidence is measured on, for each language, at most.
CALIBRATION = 40
ROUNDS = 3
#: Share of one character among those of its script without a piece, and weight of a piece never seen.
UNKNOWN, UNSEEN = 1e-3, 0.02
SCRIPTS = 3
#: Nats by which a sentence must favour another language over the main one.
MARGIN = 8.0

_WORD = re.compile(r"[぀-ヿ㐀-䶿一-鿿]+|(?:(?![぀-ヿ㐀-䶿一-鿿])\w)+")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_STOP = re.compile(r"[。！？]+|[.!?]+(?=[\s\"'»”)\]*_]|$|[぀-ヿ一-鿿])")
MASK = "\ue000"
_PARAGRAPH = re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<![^<>]*>|&[a-z#0-9]{2,8};|\\(?:begin|end)\{[^{}]*\}")
_OWN_LINE = re.compile(r"^\s*(?:[-+•◦▪‣*]+\s|\d{1,3}[.)]\s|\\item\b|#{1,6}\s|=+[^=]|<li\b|<h[1-6]\b|\\(?:sub)*section)", re.I)
_CELL = re.compile(r"<t[dhr]\b", re.I)


def _table_row(line: str) -> bool:
    start = line.lstrip()[:1]
    return start in ("|", "!", "{") or line.endswith("\\\\") or "<" in line and _CELL.search(line) is not None


def words(text: str) -> list[str]:
    """Lower-case words; runs of Chinese or Japanese count as one."""
    return _WORD.findall(text.lower())


def weight(word: str) -> float:
    """What a word adds to a sentence's length; a whole sentence has 1 at least: three words or four Chinese or Japanese characters."""
    return len(word) / 4 if _CJK.match(word) else (1 / 3 + 1e-9) if word.isalpha() else 0.0


def scored(word: str) -> str:
    """What is scored of a word: Chinese or Japanese runs as they are, other words with a leading blank, nothing of words with digits."""
    return word if _CJK.match(word) else " " + word if word.isalpha() else ""


def _no_piece(char: str) -> int:
    return -2 if "\u3040" <= char <= "\u30ff" else -3 if "\u3400" <= char <= "\u9fff" else -1


class Pieces:
    """The vocabulary's pieces that are whole characters, by text: of a file, or as they are given."""

    def __init__(self, path: str = VOCABULARY, pieces: list[str] | None = None) -> None:
        self.index: dict[str, int] = {}
        for piece in pieces if pieces is not None else self._read(path):
            self.index.setdefault(piece, len(self.index))
        self.longest: dict[str, int] = {}  # by the first two characters
        for piece in self.index:
            self.longest[piece[:2]] = max(self.longest.get(piece[:2], 0), len(piece))

    @staticmethod
    def _read(path: str) -> Iterator[str]:
        with open(path, "rb") as lines:
            for line in lines:
                try:
                    yield base64.b64decode(line.split()[0]).decode().lower()
                except UnicodeDecodeError:
                    continue

    def spans(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) of every piece inside the word, by start; a negative number for a character without a piece, by script."""
        get, longest, out = self.index.get, self.longest.get, []
        for i in range(len(word)):
            one = get(word[i])
            out.append((i, i + 1, _no_piece(word[i]) if one is None else one))
            for j in range(i + 2, min(len(word), i + longest(word[i : i + 2], 0)) + 1):
                piece = get(word[i:j])
                if piece is not None:
                    out.append((i, j, piece))
        return out


def _forward(spans: list[tuple[int, int, int]], n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, scale): exp(scale[i]) * alpha[i] is the probability of the first i characters, summed over all segmentations.

    Each position is scaled as it is left, so words of any length neither run out of range
    nor have to be cut.
    """
    alpha, scale = np.zeros((n + 1, table.shape[1])), np.zeros((n + 1, table.shape[1]))
    alpha[0] = 1
    reach = max((j - i for i, j, _ in spans), default=1)
    at, shift = -1, np.zeros(table.shape[1])  # what is written ahead of ``at`` is in units of exp(shift)
    for i, j, piece in spans:
        while at < i:
            at += 1
            scale[at] = shift
            low = alpha[at]
            if at and (low < 1e-100).any():
                by = np.maximum(low, 1e-280)
                alpha[at : at + reach + 1] /= by
                shift = shift + np.log(by)
                scale[at] = shift
        alpha[j] += alpha[i] * table[piece]
    scale[at + 1 :] = shift
    return alpha, scale


class Model:
    """Piece probabilities, one column a language; the last rows are characters without a piece, by script."""

    def __init__(self, table_: np.ndarray, pieces: Pieces) -> None:
        self.table, self.pieces = table_, pieces
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((4096, table_.shape[1]), dtype=np.float32)
        self.weights = np.zeros(4096)
        #: Heat of the posterior, and mean and deviation of a sentence's score for its length, by language.
        self.heat, self.usual, self.spread = 1.0, np.full(table_.shape[1], -1e9), np.ones(table_.shape[1])

    def posterior(self, scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Probabilities of the languages of sentences; they add up to less than 1 where no language fits."""
        top = scores.max(1, keepdims=True)
        out = np.exp((scores - top) / (self.heat * np.sqrt(np.maximum(1, 3 * weights))[:, None]))
        out /= out.sum(1, keepdims=True)
        best = scores.argmax(1)
        z = (scores.max(1) / np.maximum(weights, 1e-9) - self.usual[best]) / self.spread[best]
        return out / (1 + np.exp(-np.clip(z + 6, -50, 50)))[:, None]

    def calibrate(self, texts: list[tuple[str, int]]) -> None:
        """Fit heat, usual score and spread on (text, language number) of documents the model was not fitted on; whole texts that clearly are in another language than labelled are left out."""
        held = []
        for text, lang in texts:
            found = [w for _, s, whole in sentences(text) if whole and (w := words(s))]
            if not found:
                continue
            scores, weights = self.score_all(found)
            good = weights >= 1
            if good.any() and np.bincount(scores[good].argmax(1), minlength=len(LANGUAGES)).argmax() == lang:
                held.append((scores[good], weights[good], np.full(int(good.sum()), lang)))
        if not held:
            return
        scores, weights, truth = (np.concatenate(x) for x in zip(*held))
        own = scores[np.arange(len(truth)), truth] / weights
        for lang in np.unique(truth):
            mine = own[(truth == lang) & (scores.argmax(1) == lang)]
            if len(mine) > 20:
                self.usual[lang], self.spread[lang] = mine.mean(), max(mine.std(), 1e-3)
        rest = self.spread[self.usual > -1e8]
        right = (scores.argmax(1) == truth).mean()
        best = []
        for heat in np.geomspace(0.2, 8, 24):
            self.heat = heat
            best.append((abs(self.posterior(scores, weights).max(1).mean() - right), heat))
        self.heat = min(best)[1] if len(rest) else 1.0

    def forward(self, word: str) -> np.ndarray:
        """Log probability of the word, summed over all segmentations."""
        alpha, scale = _forward(self.pieces.spans(word), len(word), self.table)
        return np.log(np.maximum(alpha[-1], 1e-280)) + scale[-1]

    def row(self, word: str) -> int:
        at = self.rows.get(word)
        if at is None:
            at = self.rows[word] = len(self.rows)
            if at >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
            self.scores[at] = self.forward(x) if (x := scored(word)) else 0
            self.weights[at] = weight(word)
        return at

    def score_all(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and weights of many non-empty word lists."""
        if len(self.rows) >= 400_000:
            self.rows.clear()
        flat = [w for f in found for w in f]
        at = list(map(self.rows.get, flat))
        if None in at:
            for w in {w for w, a in zip(flat, at) if a is None}:
                self.row(w)
            at = list(map(self.rows.get, flat))
        starts = np.cumsum([0, *map(len, found)])[:-1]
        at = np.array(at, dtype=np.int64)
        return np.add.reduceat(self.scores[at], starts, axis=0), np.add.reduceat(self.weights[at], starts)


def fit(texts: list[tuple[str, int]], pieces: Pieces | None = None) -> Model:
    """Fit on (sentence, language number) pairs."""
    pieces = pieces or Pieces()
    n, langs = len(pieces.index) + SCRIPTS, len(LANGUAGES)
    found = [(w, lang) for t, lang in texts if (w := words(t))]
    model = None
    for relabel in (False, True):
        if relabel:
            found = list(zip((w for w, _ in found), model.score_all([w for w, _ in found])[0].argmax(1).tolist()))
        counts: dict[str, np.ndarray] = {}
        for w, lang in found:
            for x, c in Counter(x for y in w if (x := scored(y))).items():
                counts.setdefault(x, np.zeros(langs))[lang] += c
        if model is None:
            expected = np.zeros((n, langs))
            for x, c in counts.items():
                for _, _, piece in pieces.spans(x):
                    expected[piece] += c
            model = Model(_probabilities(expected), pieces)
        for _ in range(ROUNDS if relabel else 1):
            expected = np.zeros((n, langs))
            for x, c in counts.items():
                spans, size = pieces.spans(x), len(x)
                alpha, up = _forward(spans, size, model.table)
                beta, down = _forward(sorted((size - j, size - i, piece) for i, j, piece in spans), size, model.table)
                whole = np.log(np.maximum(alpha[-1], 1e-280)) + up[-1]
                for i, j, piece in spans:
                    expected[piece] += c * alpha[i] * model.table[piece] * beta[size - j] * np.exp(up[i] + down[size - j] - whole)
            model = Model(_probabilities(expected), pieces)
    return model


def _probabilities(expected: np.ndarray) -> np.ndarray:
    known = expected + UNSEEN
    out = known / known.sum(0)
    out[-SCRIPTS:] *= UNKNOWN
    return out


def sentences(text: str) -> Iterator[tuple[int, str, bool]]:
    """(paragraph, sentence, whole) outside code, formulas, comments and table cells.

    Paragraphs count from 1 between blank lines. Items and headings stand alone and are
    whole only if they end like a sentence.
    """
    _, held = hold(text)
    if held:
        parts, at = [], 0
        for h in held:  # keep the held lines' blank lines, which part paragraphs, and fill the rest
            parts += [text[at : h.start], re.sub(r"[^\s]", MASK, text[h.start : h.end])]
            at = h.end
        text = "".join([*parts, text[at:]])
    number = 0
    for paragraph in _PARAGRAPH.split(text):
        if not paragraph.strip():
            continue
        number += 1
        if "\n" not in paragraph:
            units = [paragraph] if not _table_row(paragraph) else []
        else:
            prose: list[str] = []
            units = []
            for line in paragraph.split("\n"):
                if _OWN_LINE.match(line):
                    units.append(line)
                elif not _table_row(line):
                    prose.append(line)
            if prose:
                units.append(" ".join(prose))
        for unit in units:
            if "<" in unit or "&" in unit or "\\" in unit:
                unit = _TAG.sub(" ", unit)
            at = 0
            for m in _STOP.finditer(unit):
                yield number, unit[at : m.start()], True
                at = m.end()
            if at < len(unit):
                yield number, unit[at:], False


def identify_all(texts: list[str | None], model: Model) -> list[tuple[str | None, float, list[tuple[int, str, float]]]]:
    """(main language, confidence, [(paragraph, other language, confidence)]) of each text.

    The main language is that of most sentences, parts of sentences counting only where
    there are no whole ones; its confidence is the mean posterior over them. Null, empty
    and wordless texts give (None, 0, []).
    """
    found, paras, wholes, ends = [], [], [], []
    for text in texts:
        for para, sentence, whole in sentences(text) if text else ():
            w = words(sentence)
            if w and (len(w) < 6 or 2 * sum(map(str.isalpha, w)) >= len(w)):  # else a list of codes
                found.append(w)
                paras.append(para)
                wholes.append(whole)
        ends.append(len(found))
    if not found:
        return [(None, 0.0, [])] * len(texts)
    scores, weights = model.score_all(found)
    best = scores.argmax(1)
    top = scores.max(1)
    posterior = model.posterior(scores, weights)
    whole = np.array(wholes) & (weights >= 1)
    out, start = [], 0
    for end in ends:
        usable = [i for i in range(start, end) if whole[i]] or [i for i in range(start, end) if weights[i] > 0]
        if not usable:
            out.append((None, 0.0, []))
        else:
            sure = posterior[usable].mean(0)
            main = int(np.lexsort((sure, np.bincount(best[usable], minlength=len(LANGUAGES))))[-1])
            others: dict[tuple[int, str], float] = {}
            for i in range(start, end):
                if whole[i] and best[i] != main and top[i] - scores[i, main] >= MARGIN:
                    key = (paras[i], LANGUAGES[best[i]])
                    others[key] = max(others.get(key, 0.0), float(posterior[i, best[i]]))
            out.append((LANGUAGES[main], float(sure[main]), [(p, lang, c) for (p, lang), c in sorted(others.items())]))
        start = end
    return out


def label_code(label: Column) -> Column:
    """Two-letter code of a label, however spelled; null for blank labels, placeholders and unknown languages."""
    stem = F.regexp_replace(F.lower(F.trim(label)), r"[-_ ].*$", "")
    pairs = [F.lit(x) for code, names in SPELLINGS.items() for n in names.split() for x in (n, code)]
    return F.try_element_at(F.create_map(*pairs), stem)


def fit_on(documents: DataFrame, per_language: int = SAMPLE, calibration: int = CALIBRATION) -> Model:
    """Fit on at most ``per_language`` documents (key, text, lang) of each stated language, chosen by hash, and calibrate on the next ``calibration``."""
    by = Window.partitionBy("code").orderBy(F.xxhash64("key"), "key")
    rows = (
        documents.select("key", label_code(F.col("lang")).alias("code")).where("code is not null")
        .withColumn("n", F.row_number().over(by)).where(F.col("n") <= per_language + calibration).select("key", "code", "n")
    )
    drawn = documents.select("key", "text").join(F.broadcast(rows), "key").select("key", "code", "n", "text").collect()  # 7 x (per_language + calibration) rows
    drawn.sort(key=lambda r: str(r["key"]))
    model = fit([(s, LANGUAGES.index(r["code"])) for r in drawn if r["text"] and r["n"] <= per_language for _, s, _ in sentences(r["text"])])
    model.calibrate([(r["text"], LANGUAGES.index(r["code"])) for r in drawn if r["text"] and r["n"] > per_language])
    return model


#: The model last used in this Python worker, with the scores of the words it has met.
_LAST: dict[str, Model] = {}


def _model(name: str, parts: tuple) -> Model:
    if name not in _LAST:
        used, values, least, shape, pieces, heat, usual, spread = parts
        whole = np.broadcast_to(least, shape).copy()
        whole[used] = values
        _LAST.clear()
        _LAST[name] = Model(whole, Pieces(pieces=pieces))
        _LAST[name].heat, _LAST[name].usual, _LAST[name].spread = heat, usual, spread
    return _LAST[name]


def detect(texts: DataFrame, model: Model) -> DataFrame:
    """(src_table, rec_key, lang, confidence, segments) of (src_table, rec_key, text); null texts get a null language."""
    name = uuid.uuid4().hex
    least = model.table[:-SCRIPTS].min(0)
    used = np.flatnonzero((np.abs(model.table / least - 1) > 1e-4).any(1))  # the sample's pieces
    shared = texts.sparkSession.sparkContext.broadcast((used, model.table[used], least, model.table.shape, list(model.pieces.index), model.heat, model.usual, model.spread))  # bounded by the vocabulary

    def run(batches):
        own = _model(name, shared.value)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                got = identify_all(part["text"].tolist(), own)
                yield pd.DataFrame({
                    "src_table": part["src_table"].tolist(), "rec_key": part["rec_key"].tolist(), "lang": [g[0] for g in got], "confidence": [round(g[1], 4) for g in got],
                    "segments": [[{"para_no": p, "lang": lang, "confidence": round(c, 4)} for p, lang, c in g[2]] for g in got],
                })

    return texts.mapInPandas(run, "src_table string, rec_key string, lang string, confidence double, segments array<struct<para_no int, lang string, confidence double>>")


def _texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    of = lambda df, name, key: df.select(F.lit(name).alias("src_table"), F.col(key).cast("string").alias("rec_key"), "text")
    texts = (
        of(docs, "documents", "doc_id").unionByName(of(table(spark, folder, "parsed_docs", "path", "text"), "parsed_docs", "path"))
        .unionByName(of(table(spark, folder, "sparse_chunks", "chunk_id", "text", "chunk_kind").where("chunk_kind = 'dense'"), "sparse_chunks", "chunk_id"))
    )
    stated = newest(table(spark, folder, "lang_labels"), ["src_table", "rec_key"], "labelled_at", ["src_table", "rec_key", "labelled_at", "lang"])
    labels = docs.select(F.lit("documents").alias("src_table"), F.col("doc_id").cast("string").alias("rec_key"), "lang").unionByName(stated.select("src_table", "rec_key", "lang"))
    return docs.withColumnRenamed("doc_id", "key"), texts, labels.select("src_table", "rec_key", label_code(F.col("lang")).alias("stated"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """para_no 0: the language of records whose label is missing or wrong; else paragraphs with sentences in another language."""
    docs, texts, labels = _texts(spark, folder)
    got = detect(texts, fit_on(docs)).where("lang is not null").join(labels, ["src_table", "rec_key"], "left")
    main = F.when(F.col("stated").isNull() | (F.col("stated") != F.col("lang")), F.array(F.struct(F.lit(0).alias("para_no"), "lang"))).otherwise(F.array().cast("array<struct<para_no int, lang string>>"))
    parts = F.transform("segments", lambda s: F.struct(s["para_no"].alias("para_no"), s["lang"].alias("lang")))
    return got.select("src_table", "rec_key", F.explode(F.concat(main, parts)).alias("x")).select("src_table", "rec_key", "x.para_no", "x.lang").distinct()


def p1_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every text, and of each stretch in another language."""
    docs, texts, _ = _texts(spark, folder)
    return detect(texts, fit_on(docs)).distinct()

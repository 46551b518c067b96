"""Texts that were cut off, and how often each source cuts.

Intact paragraphs of a bounded sample are cut at random places to make positives; texts
and paragraphs as they are make negatives. A logistic regression over hashed features of
the closing characters, words, punctuation and open structure, and of how many texts of
the source have nearly the same length (a field limit shows as a peak there), scores
every text. Exporters' footers and marks of omission are taken off first.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.llm.sizes import source_name
from loamweave.operators.stage import stage
from loamweave.sources.tables import table

#: Texts the model is trained on, at most.
SAMPLE = 5000
BITS = 16
#: A last line's shape is a source's footer if it ends at least this share of its texts and at least so many.
FOOTER_SHARE, FOOTER_LEAST = 0.1, 5
_MARK = r"\s*(?:…|\.{3,}|\[\s*(?:\.{3}|…|truncated|cut|more)\s*\]|\(\s*(?:truncated|cut|more|continued)\s*\)|<\s*(?:truncated|cut|more)\s*>)\s*$"
_END = re.compile(r"[.!?。！？:：;；…][\"'»”)\]*_}]*(?:</\w+\s*>)*$")
_ITEM = re.compile(r"^\s*(?:[-+*•◦▪]+|\d{1,3}[.)]|\\item\b|<li\b[^>]*>)\s*(?:\[[ xX]\]\s*)?")
_SENTENCE_END = re.compile(r"[.!?](?=[\s\"'»”)*_<])|[。！？]|\n")
_TOKEN = re.compile(r"[぀-ヿ一-鿿]|[^\W\d_]+|\d+|[^\w\s]")


def shape_of(line: Column) -> Column:
    """Hash of a last line of any length with digits, capitalised and other words replaced; null for a blank line, an item and the end of a sentence."""
    s = F.regexp_replace(F.trim(line), r"\d+", "9")
    s = F.regexp_replace(F.regexp_replace(s, r"\p{Lu}\p{Ll}+", "X"), r"\p{Ll}{2,}", "w")
    return F.when((s != "") & ~s.rlike(r"^[-*+•|`]\s|[.!?。！？]$"), F.xxhash64(s))


def _stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \n\r\t\u3000"))


def _without_footer(text: Column) -> Column:
    return _stripped(F.substr(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, "\n", -1))))


def _without_mark(text: Column) -> Column:
    return _stripped(F.substr(text, F.lit(1), F.length(text) - F.length(F.regexp_extract(F.right(text, F.lit(40)), _MARK, 0))))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.coalesce(source_name(F.col("source")), F.lit("")).alias("source"), _stripped(F.col("text")).alias("text")).where("text != ''")


def endings(docs: DataFrame) -> DataFrame:
    """(id, footed, peak) of (id, source, text) with a non-blank text; only lengths and shapes are shuffled.

    footed: the last line is one the source's exporter adds, or any exporter's where the
    source is null. peak: how much more often
    than by chance texts of the source come this close in length, in characters or
    bytes, footers and marks of omission not counted, as a power of two from -1 to 6.
    """
    text, above = F.col("text"), F.col("above")
    sizes = lambda c, n: [F.length(c).cast("int").alias(f"chars_{n}"), F.octet_length(c).cast("int").alias(f"bytes_{n}")]
    rows = stage(
        _named(docs).withColumn("above", _without_footer(text))
        .select("id", "source", shape_of(F.substring_index("text", "\n", -1)).alias("shape"), *sizes(_without_mark(text), "all"), *sizes(_without_mark(above), "above"))
    )
    whole = rows.groupBy("source").agg(F.count("*").alias("n_source"))
    shapes = rows.where("shape is not null").groupBy("source", "shape").agg(F.count("*").alias("n_shape"))
    everywhere = shapes.groupBy("shape").agg(F.sum("n_shape").alias("n_everywhere"))
    footers = (
        shapes.join(whole, "source").join(everywhere, "shape")
        .where((F.col("n_shape") >= FOOTER_LEAST) & (F.col("n_shape") >= FOOTER_SHARE * F.col("n_source")) & (F.col("n_everywhere") <= 2 * F.col("n_shape")))
        .select("source", "shape", F.lit(True).alias("footer"))
    )
    footers = footers.unionByName(footers.withColumn("source", F.lit(""))).distinct()  # also where the source is not known
    size = lambda n: F.when(F.col("footer"), F.col(f"{n}_above")).otherwise(F.col(f"{n}_all")).alias(n)
    own = stage(rows.join(footers, ["source", "shape"], "left").select("id", "source", F.col("footer").isNotNull().alias("footed"), size("chars"), size("bytes")).where("chars > 0"))
    got = own
    for unit, reach in (("chars", 5), ("bytes", 3)):
        near = Window.partitionBy("source").orderBy(unit).rangeBetween(-reach, reach)
        counts = (
            own.groupBy("source", unit).agg(F.count("*").alias("n_same")).withColumn("n_near", F.sum("n_same").over(near))
            .join(own.groupBy("source").agg(F.count("*").alias("n_own"), F.avg(unit).alias("mean")), "source")
            .select("source", unit, F.greatest(
                F.col("n_same") / (1 + 2 * F.col("n_own") / F.col("mean")), F.col("n_near") / (1 + 2 * (2 * reach + 1) * F.col("n_own") / F.col("mean")),
            ).alias(f"over_{unit}"))
        )
        got = got.join(counts, ["source", unit])
    peak = F.floor(F.log2(F.greatest("over_chars", "over_bytes", F.lit(0.5))))
    return got.select("id", "footed", F.least(peak, F.lit(6)).cast("int").alias("peak"))


def own_texts(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, source, own, marked, peak): each text without footer and mark, in one shuffle of the texts."""
    rows = _named(docs).join(ends, "id").withColumn("bare", F.when(F.col("footed"), _without_footer(F.col("text"))).otherwise(F.col("text")))
    own = rows.withColumn("own", _without_mark(F.col("bare")))
    return own.select("id", "source", "own", (F.length("own") < F.length("bare")).alias("marked"), "peak")


def features(text: str, marked: bool, peak: int) -> list[int]:
    """Hashed features of how a text ends."""
    cut = text.rfind("\n") + 1
    line, before = text[cut:][-400:], text[max(0, cut - 200) : cut]
    item = _ITEM.match(line)
    fences = len(re.findall(r"^\s*(?:```|~~~)", text, re.M)) % 2
    kind = (
        "code" if fences or line.startswith(("    ", "\t")) else "table" if line.startswith(("|", "!")) or "<td" in line else "item" if item else "blank" if before.endswith("\n\n") or not before else "more"
    )
    tokens = _TOKEN.findall(line[-120:])
    norm = ["9" if t.isdigit() else t.lower() for t in tokens]
    tail = re.sub(r"\d+", "9", line[-24:])
    end = "end" if _END.search(line) else "word" if line[-1:].isalpha() else "digit" if line[-1:].isdigit() else "sign"
    length = min(12, len(norm))
    body = " ".join(norm[-14:])
    out = [
        "bias", f"kind={kind}", f"end={end}", f"{kind}|{end}", f"peak={peak}", f"peak={peak}|{end}", f"marked={marked}", f"marked={marked}|{end}",
        f"{kind}|len={length}", f"{kind}|{end}|{length // 3}",
        *(f"c{n}={tail[-n:]}" for n in (1, 2, 3, 4, 6)), *(f"{kind}|w{n}={' '.join(norm[-n:])}" for n in (1, 2, 3)), f"w1={' '.join(norm[-1:])}",
        f"line={body}" if len(tokens) <= 14 else "line=long", f"{kind}|close={line[-1:]}|{line.count('|') > 1}", f"open={line.count('(') > line.count(')')}|{line.count('[') > line.count(']')}",
        f"tag={line.rfind('<') > line.rfind('>')}", f"dollar={line.count('$') % 2}", f"{kind}|first={norm[0] if norm else ''}", f"case={line[:1].isupper()}|{kind}|{length < 4}",
    ]
    return [zlib.crc32(x.encode()) >> (32 - BITS) for x in out]


def _cuts(text: str, rng: random.Random, n: int) -> list[str]:
    """The text cut inside a sentence, item or table row outside code, up to n times."""
    out = []
    fenced = [m.start() for m in re.finditer(r"^\s*(?:```|~~~)|</?(?:pre|syntaxhighlight|source)\b|\\(?:begin|end)\{verbatim|\$\$|^\s{4}", text, re.M | re.I)]
    for _ in range(3 * n):
        if len(out) == n:
            break
        at = rng.randrange(1, len(text))
        head = text[:at].rstrip()
        start = max((m.end() for m in _SENTENCE_END.finditer(text, max(0, at - 400), at)), default=0)
        stop = _SENTENCE_END.search(text, at)
        rest = text[at : stop.start() if stop else len(text)].strip(" \t*_|`")
        piece = _ITEM.sub("", text[start:at]).strip()
        line = text[text.rfind("\n", 0, at) + 1 : at]
        if _END.search(head) and not text[len(head) : len(head) + 1].isalnum():
            continue
        if not rest or len(piece) < 2 or sum(f < at for f in fenced) % 2 or line.startswith(("#", "=", "    ", "|-", "\\", "</")) or re.match(r"^<h\d", line):
            continue
        out.append(head)
    return out


class Regression:
    """Logistic regression on hashed indicators, fitted with AdaGrad and a light L2 penalty."""

    def __init__(self, bits: int = BITS) -> None:
        self.weights = np.zeros(1 << bits)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[rows].sum(1), -30, 30)))

    def fit(self, rows: np.ndarray, target: np.ndarray, rounds: int = 12, rate: float = 0.15, seed: int = 5) -> Regression:
        rng = np.random.default_rng(seed)
        square = np.full(len(self.weights), 1e-3)
        for _ in range(rounds):
            for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
                x = rows[at]
                error = self.scores(x) - target[at]
                step = np.bincount(x.ravel(), np.repeat(error, x.shape[1]), len(self.weights)) / np.sqrt(len(at)) + 1e-5 * self.weights
                square += step**2
                self.weights -= rate * step / np.sqrt(square)
        return self


def train(sample: list[tuple[str, bool, int]], seed: int = 3) -> Regression:
    """Fit on (own text, marked, peak).

    The ends of texts away from any field limit are negatives at first; then each half of
    all ends is scored by a model fitted without it, and what looks cut is left out.
    """
    rng = random.Random(seed)
    peaks = [p for _, _, p in sample] or [0]
    ends: list[list[int]] = []
    inner: list[list[int]] = []
    cut: list[list[int]] = []
    for text, marked, peak in sample:
        ends.append(features(text, marked, peak))
        stops = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text) if text[: m.start()].strip()]
        inner += [features(text[:at].rstrip(), False, rng.choice(peaks)) for at in rng.sample(stops, min(2, len(stops)))]
        body = text[: stops[-1]] if stops else text
        if len(body) > 20:
            cut += [features(x, rng.random() < 0.15, rng.choice(peaks) if rng.random() < 0.4 else rng.randint(2, 6)) for x in _cuts(body, rng, 3)]
    if not cut:
        return Regression()

    def model_of(part: int | None, good: list[list[int]]) -> Regression:
        some = lambda x: x if part is None else x[part::2]
        no, yes = [*good, *some(inner)], some(cut)
        return Regression().fit(np.array([*no, *yes]), np.repeat([0.0, 1.0], [len(no), len(yes)]))

    good = [p < 2 for p in peaks[: len(ends)]]
    for _ in range(2):
        score = np.ones(len(ends))
        for part in (0, 1):
            other = model_of(part, [e for e, g in zip(ends[part::2], good[part::2]) if g])
            if len(ends) > 1 - part:
                score[1 - part :: 2] = other.scores(np.array(ends[1 - part :: 2]))
        good = list(score < 0.5)
    return model_of(None, [e for e, g in zip(ends, good) if g])


def truncated(docs: DataFrame) -> DataFrame:
    """(id, source, score, cut) of every non-blank text of (id, source, text).

    Null and blank texts give no row; a null source counts as the source ''.
    """
    ends = stage(endings(docs))
    own = own_texts(docs, ends)
    cell = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 20))
    some = docs.where(cell < int((1 << 20) * min(1.0, 1.2 * SAMPLE / max(1, ends.count()))) + 1)
    drawn = own_texts(some, ends).orderBy(F.xxhash64(F.col("id"), F.lit(17)), "id").limit(SAMPLE).select("own", "marked", "peak").collect()
    model = docs.sparkSession.sparkContext.broadcast(train([tuple(r) for r in drawn]).weights)

    def run(batches):
        scorer = Regression()
        scorer.weights = model.value
        for pdf in batches:
            if len(pdf):
                score = scorer.scores(np.array([features(*r) for r in zip(pdf["own"], pdf["marked"], pdf["peak"])]))
                yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "score": score, "cut": score >= 0.5})

    return own.mapInPandas(run, f"id {dict(docs.dtypes)['id']}, source string, score double, cut boolean")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "source", "text").withColumnRenamed("doc_id", "id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(_documents(spark, folder)).where("cut").select(F.col("id").alias("doc_id")).distinct()


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Texts, cut texts and their share for every source."""
    got = truncated(_documents(spark, folder))
    return got.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("cut").cast("int")).alias("n_cut"), F.round(F.avg(F.col("cut").cast("int")), 6).alias("cut_rate"))

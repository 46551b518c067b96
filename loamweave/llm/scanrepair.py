"""Repair of text from scanned pages: furniture, broken words, misread characters.

Words no clean text has are candidates for misreadings. Their corrections are retrieved
by a join of character q-grams with the words of clean texts. Which characters are misread
as which is learned from the words that have one nearest clean word only; with these
confusions gradient-boosted trees, trained on clean words that were misread on purpose,
rank the corrections. A classifier over pairs of lines, trained on lines that repeat
within a text and on numbers that count up through it, finds running headers and page
numbers; another, trained on clean words and compounds broken on purpose, tells words
broken to fit the line from compounds broken at their own hyphen.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.llm.boosting import Boosting
from loamweave.llm.truncation import Regression
from loamweave.operators.stage import stage
from loamweave.sources.tables import table

#: Scanned texts the line classifier is trained on, clean words for the classifiers of words, and those misread on purpose, at most.
TEXT_SAMPLE, WORD_SAMPLE, MISREAD_SAMPLE = 400, 4000, 1500
#: Confusions of characters kept, at most, and the least share of all words aligned that have one.
CONFUSIONS, CONFUSION_SHARE = 200, 0.001
HYPHENS = "-­¬‐"
_LATIN_WORD = re.compile(r"[^\W\d_][\w!|ﬁﬂ]*[^\W_]|[^\W\d_]+", re.U)
#: A line that may be a page number: one or two numbers, a word before and a short one between, and signs that end no sentence.
_PAGE = re.compile(r"^\W*(?:[^\W\d_]+\W+)?(\d{1,4})(?:\W*(?:\b[^\W\d_]{1,4}\b)?\W*\d{1,4})?[^\w.!?,;:%°]*$")
_BARE = re.compile(r"^\s*\d+\s*$")
_PLACEHOLDER = re.compile(r"^\s*(?:\{\{|!\[|<img)|^\s*\[\[")
_CJK = re.compile(r"[぀-ヿ一-鿿]")


def is_scan(text: str | None) -> bool:
    """Latin text in lines broken at a fixed width: most long lines run on into the next one."""
    if not text:
        return False
    lines = [x.strip() for x in text.split("\n")]
    long = [(a, b) for a, b in zip(lines, lines[1:]) if len(a) > 30]
    run_on = sum(1 for a, b in long if b and a[-1] not in ".!?:;|" and not a.startswith(("|", "<", "\\", "- ", "* ", "+ ")))
    return len(long) >= 3 and run_on > 0.35 * len(long) and len(_CJK.findall(text)) < 0.2 * len(text)


def _shape(line: str) -> str:
    s = re.sub(r"\d+", "9", " ".join(line.split()))
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "X" if m[0][0].isupper() else "w", s)
    return re.sub(r"\b(\w)(?: \1\b)+", r"\1+", s)


def _folded(line: str) -> str:
    """A line as it may repeat: without digits, case, blanks and often misread characters."""
    return re.sub(r"[^a-z]", "", unicodedata.normalize("NFKD", line.lower()).replace("rn", "m").replace("ii", "u").replace("cl", "d").translate(str.maketrans("0156!lfqcy", "oisbiitgev")))


def _hashed(token: str) -> int:
    return zlib.crc32(token.encode()) >> 16


#: In the place of how often a line repeats: not to be looked at.
UNSEEN = _hashed("repeats=?")


def line_features(lines: list[str]) -> tuple[list[int], list[list[int]], list[int]]:
    """Numbers of the non-empty lines, their hashed features, of which the last is how often it repeats, and how often each repeats in the text."""
    real = [i for i, x in enumerate(lines) if x.strip()]
    width = max((len(lines[i].strip()) for i in real), default=1)
    folded = [_folded(lines[i]) for i in real]
    folds = Counter(folded)
    often = [len(f) > 4 and folds[f] > 1 for f in folded]
    rows, repeats = [], []
    for k, i in enumerate(real):
        x = lines[i].strip()
        before = lines[real[k - 1]].strip() if k else ""
        after = lines[real[k + 1]].strip() if k + 1 < len(real) else ""
        bare, number = bool(_BARE.match(x)), bool(_PAGE.match(x))
        stop = before[-1:] in ".!?:" or not before
        splits = not stop and after[:1].islower()
        fold = folded[k]
        near = k > 0 and often[k - 1] or k + 1 < len(real) and often[k + 1]
        tokens = [
            "bias", f"shape={_shape(x)}" if not number else f"page={re.sub(r'[0-9]+', '9', x.lower())}", f"width={8 * len(' '.join(x.split())) // max(1, width)}",
            f"first={k == 0}|{number}", f"gap={i == 0 or not lines[i - 1].strip()}|{i + 1 >= len(lines) or not lines[i + 1].strip()}|{number}",
            f"splits={splits}|{number}", f"end={x[-1:] if not x[-1:].isalnum() else 'a'}", f"lower={x[0].islower()}", f"sign={'|' in x}|{'©' in x}|{' / ' in x}",
            f"spaced={bool(re.search(r'   *[0-9]+$|^[0-9]+   *', x))}", f"caps={x.isupper() and not number}", f"bare={bare}|{bool(_BARE.match(before))}|{bool(_BARE.match(after))}|{before[-1:] == ':'}",
            f"near={near}|{number}|{bare}", f"title={sum(w[0].isupper() or not w[0].isalpha() for w in x.split()) * 4 // max(1, len(x.split()))}|{x[-1:] in '.!?,;'}", f"code={bool(re.search(r'[A-Z][0-9]{4,}', x))}|{len(x.split()) < 6}",
            f"number={number}",
        ]
        repeats.append(folds[fold] if len(fold) > 4 else 0)
        rows.append([_hashed(t) for t in (*tokens, f"repeats={min(repeats[-1], 4)}|{len(x.split()) <= 9}")])
    return real, rows, repeats


def counting(lines: list[str]) -> dict[int, bool]:
    """Lines that may be page numbers, by index: whether they are one of at least two of one shape that count up by one through the text; others of a shape that repeats do not. Shapes met once are left out."""
    shapes: dict[str, list[int]] = {}
    for i, line in enumerate(lines):
        if m := _PAGE.match(line.strip()):
            shapes.setdefault(re.sub(r"\d+", "9", line.strip().lower()), []).append(i)
    out = {}
    for at in shapes.values():
        numbers = {i: int(_PAGE.match(lines[i].strip())[1]) for i in at}
        if len(at) > 1:
            steps = _in_step(numbers, at)
            up = numbers[steps[1]] == numbers[steps[0]] + 1
            out.update({i: up and i in steps for i in at})
    return out


def train_furniture(texts: list[str]) -> Regression:
    """Positives: short lines that repeat in their text, and numbers that count up through it. Negatives: lines of running text, columns of numbers, headings.

    Every line is shown twice, with and without how often it repeats, so that lines that
    repeat are known by that and others by what repeated lines look like.
    """
    rows, target = [], []
    for text in texts:
        lines = text.replace("\r", "").split("\n")
        real, feats, repeats = line_features(lines)
        counts = counting(lines)
        width = max((len(lines[i].strip()) for i in real), default=1)
        for k, i in enumerate(real):
            x = lines[i].strip()
            before = lines[real[k - 1]].strip() if k else ""
            after = lines[real[k + 1]].strip() if k + 1 < len(real) else ""
            if _PAGE.match(x):
                column = _BARE.match(x) and (_BARE.match(before) or _BARE.match(after) or before[-1:] == ":")
                if i not in counts and not column:
                    continue
                label = 0.0 if column or not counts[i] else 1.0
            elif _PLACEHOLDER.match(x) or x[-1:] == ":":
                label = 0.0
            elif repeats[k] > 1 and len(x.split()) <= 9 and x[-1:] not in ".!?,":
                if repeats[k] == 2 and after[:1].islower():
                    continue  # a sentence met twice
                label = 1.0
            elif len(x) > 0.75 * width and repeats[k] == 1:
                label = 0.0
            elif x[-1:] in ".!?" or x[:1].islower():
                label = 0.0
            else:
                continue
            rows += [feats[k], [*feats[k][:-1], UNSEEN]]
            target += [label, label]
    return Regression().fit(np.array(rows), np.array(target), rounds=8) if rows else Regression()


def furniture(lines: list[str], model: Regression) -> dict[int, str]:
    """header or page_number by line index."""
    real, feats, repeats = line_features(lines)
    if not real:
        return {}
    seen = np.array(feats)
    unseen = seen.copy()
    unseen[:, -1] = UNSEEN
    score = np.maximum(model.scores(seen), model.scores(unseen))
    out = {}
    for k, i in enumerate(real):
        x = lines[i].strip()
        if score[k] >= 0.5 and not _PLACEHOLDER.match(x):
            out[i] = "page_number" if _PAGE.match(x) else "header"
    pages = [i for i, noise in out.items() if noise == "page_number"]
    bare = [i for i in pages if _BARE.match(lines[i])]
    for i in set(bare) - set(_in_step(lines, bare) if len(bare) == len(pages) else []):
        del out[i]
    return out


def _in_step(lines: list[str] | dict[int, int], bare: list[int]) -> list[int]:
    """The longest row of bare numbers that count up by one; all of them where no two do."""
    best: dict[int, list[int]] = {}
    for i in bare:
        n = int(lines[i])
        row = [*best.get(n - 1, []), i]
        if len(row) > len(best.get(n, [])):
            best[n] = row
    longest = max(best.values(), key=len, default=[])
    return longest if len(longest) > 1 else bare


def breaks(lines: list[str], out: dict[int, str]) -> list[tuple[int, int, str, str, str]]:
    """(line, next body line, left part, right part, mark) where a body line ends in a hyphen after a letter."""
    body = [i for i, x in enumerate(lines) if x.strip() and i not in out and not _PLACEHOLDER.match(x)]
    found = []
    for i, j in zip(body, body[1:]):
        m = re.search(rf"([^\W\d_][\w'’!|-]*|\w*[^\W\d_])([{HYPHENS}])\s*$", lines[i])
        n = re.match(r"\s*([^\W_][\w'’!|-]*)", lines[j])
        if m and n:
            found.append((i, j, m[1], n[1], m[2]))
    return found


def difference(read: str, word: str) -> tuple[str, str] | None:
    """(true, seen): what is left of both without their common beginning and end, with a neighbour where one is empty; None if longer than three characters."""
    a = 0
    while a < min(len(read), len(word)) and read[a] == word[a]:
        a += 1
    b = 0
    while b < min(len(read), len(word)) - a and read[-1 - b] == word[-1 - b]:
        b += 1
    true, seen = word[a : len(word) - b], read[a : len(read) - b]
    if not true or not seen:
        if not a:
            return None
        true, seen = word[a - 1] + true, read[a - 1] + seen
    return (true, seen) if len(true) <= 3 and len(seen) <= 3 else None


class Confusions:
    """Characters and what they are misread as."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.pairs = sorted(set(pairs))
        self.by_end: dict[str, list[tuple[str, str]]] = {}
        for true, seen in self.pairs:
            self.by_end.setdefault(seen[-1], []).append((true, seen))


def distance(read: str, word: str, known: Confusions) -> float:
    """Edit distance in which a known confusion costs 0.2."""
    table_ = [[float(j) for j in range(len(word) + 1)]]
    for i, c in enumerate(read, 1):
        above = table_[-1]
        row = [float(i)]
        options = [(t, x) for t, x in known.by_end.get(c, ()) if read.endswith(x, 0, i)]
        for j, d in enumerate(word, 1):
            best = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != d))
            for t, x in options:
                if word.endswith(t, 0, j):
                    best = min(best, table_[i - len(x)][j - len(t)] + 0.2)
            row.append(best)
        table_.append(row)
    return table_[-1][-1]


def pair_features(read: str, word: str, n_word: int, edits: int, capital: bool, known: Confusions) -> list[float]:
    a, b = ({f"^{w}$"[i : i + 2] for i in range(len(w) + 1)} for w in (read, word))
    return [
        distance(read, word, known), edits, np.log1p(n_word), len(read), len(word) - len(read), float(not read.isalpha()), float(capital),
        2 * len(a & b) / max(1, len(a) + len(b)), float(read[:1] == word[:1]), float(read[-1:] == word[-1:]),
    ]


def train_ranker(words: list[tuple[str, int]], known: Confusions, seed: int = 9) -> Boosting:
    """Trained on clean words (word, count): those misread by known confusions with their true word, against other near words and unharmed words."""
    rng = random.Random(seed)
    words = [(w, n) for w, n in words if len(w) >= 2]
    grams: dict[str, list[int]] = {}
    for i, (w, _) in enumerate(words):
        for g in {f"^{w}$"[k : k + 2] for k in range(len(w) + 1)}:
            grams.setdefault(g, []).append(i)

    def near(w: str, most: int = 3) -> list[int]:
        shared = Counter(i for g in {f"^{w}$"[k : k + 2] for k in range(len(w) + 1)} for i in grams.get(g, ()))
        return [i for i, _ in shared.most_common(most + 1) if words[i][0] != w][:most]

    x, y = [], []
    for w, n in words[:MISREAD_SAMPLE]:
        capital = rng.random() < 0.3
        read = w
        for _ in range(1 + (rng.random() < 0.15)):
            options = [(m.start(), t, s) for t, s in known.pairs for m in re.finditer(re.escape(t), read)]
            if options:
                at, t, s = rng.choice(options)
                read = read[:at] + s + read[at + len(t) :]
        if read != w:
            x.append(pair_features(read, w, n, _edits(read, w), capital, known))
            y.append(1.0)
            for i in near(read):
                if words[i][0] != w:
                    x.append(pair_features(read, words[i][0], words[i][1], _edits(read, words[i][0]), capital, known))
                    y.append(0.0)
        letters = list(w)
        for _ in range(rng.randint(1, 2)):  # another word that only looks alike
            letters[rng.randrange(len(letters))] = rng.choice("abdeghiklmnoprstuvz")
        other = "".join(letters)
        for q in (w, other):
            for i in [*near(q, 2)]:
                x.append(pair_features(q, words[i][0], words[i][1], _edits(q, words[i][0]), rng.random() < 0.6, known))
                y.append(0.0)
        if other != w and distance(other, w, known) >= 0.9:
            x.append(pair_features(other, w, n, _edits(other, w), rng.random() < 0.6, known))
            y.append(0.0)
    return Boosting().fit(np.array(x), np.array(y)) if x else Boosting(trees=0).fit(np.zeros((2, 10)), np.zeros(2))


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, cb in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (ca != cb))
    return row[-1]


def join_features(n_joined: int, n_compound: int, n_left: int, n_right: int, left: str, right: str, mark: str) -> list[float]:
    return [np.log1p(n_joined), np.log1p(n_compound), np.log1p(n_left), np.log1p(n_right), len(left), len(right), float(right[:1].isupper()), float(mark != "-"), float(right[:1].isdigit() or left[-1:].isdigit())]


def train_joins(words: list[tuple[str, int]], seed: int = 13) -> Boosting:
    """Trained on clean words broken anywhere against compounds broken at their own hyphen, both also as if never seen whole."""
    rng = random.Random(seed)
    count = dict(words)
    x, y = [], []
    for w, n in words:
        parts = w.split("-")
        known = rng.random() < 0.6
        if len(parts) == 1 and len(w) >= 5:
            at = rng.randint(2, len(w) - 2)
            a, b = w[:at], w[at:]
            for mark in ("-", rng.choice(HYPHENS)):
                x.append(join_features(n if known else 0, 0, count.get(a, 0), count.get(b, 0), a, b, mark))
                y.append(1.0)
        elif len(parts) >= 2 and all(parts):
            at = rng.randint(1, len(parts) - 1)
            a, b = "-".join(parts[:at]), "-".join(parts[at:])
            b = b.capitalize() if rng.random() < 0.2 else b
            for _ in range(6):
                x.append(join_features(0, n if rng.random() < 0.6 else 0, count.get(a, 0), count.get(b.lower(), 0), a, b, "-"))
                y.append(0.0)
    return Boosting().fit(np.array(x), np.array(y)) if len(set(y)) > 1 else Boosting(trees=0).fit(np.zeros((2, 9)), np.ones(2))


def clean_words(texts: DataFrame) -> DataFrame:
    """(word, n_clean) of clean texts in lower case: words, compounds with hyphens, and their parts."""
    tokens = texts.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\-]+")).alias("token")).select(F.regexp_replace("token", r"^-+|-+$", "").alias("token")).where("token != ''")
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"))
    parts = counted.where("token like '%-%'").select(F.explode(F.split("token", "-")).alias("token"), "n").where("token != ''")
    return counted.unionByName(parts).groupBy(F.col("token").alias("word")).agg(F.sum("n").alias("n_clean"))


def _edits_allowed(read: Column) -> Column:
    """Two edits in words of up to four letters, else three, and more in words of over 19."""
    return F.when(F.length(read) <= 4, 2).otherwise(F.greatest(F.lit(3), F.floor(F.length(read) / 5).cast("int")))


def _rare_grams(words: DataFrame, name: str, seen: DataFrame, allowed: Column) -> DataFrame:
    """(columns of words, gram): as many of the rarest bigrams of each word as edits can spoil, and one more.

    An edit spoils two bigrams at most, so two words within the allowed edits share one of
    these wherever they must share any.
    """
    padded = F.concat(F.lit("^"), F.col(name), F.lit("$"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2)))
    by = Window.partitionBy(name).orderBy("n_gram", "gram")
    rows = words.withColumn("gram", F.explode(grams)).join(seen, "gram").withColumn("nth", F.row_number().over(by))
    return rows.where(F.col("nth") <= 2 * allowed + 1).drop("nth", "n_gram")


def near_words(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """(read, capital, n_read, word, n_clean, edits) of unknown words and clean words within the allowed edits, by a join of rare q-grams.

    unknown: (read, capital, n_read); words: (word, n_clean), of which those met twice and without
    a hyphen count. Both sides are distinct words. A pair is verified where it is met,
    before anything is shuffled again.
    """
    known = words.where((F.length("word") >= 2) & (F.col("n_clean") >= 2) & ~F.col("word").contains("-")).select("word", "n_clean")
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    seen = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n_gram"))
    most = F.greatest(_edits_allowed(F.col("word")), _edits_allowed(F.concat("word", F.lit("xx"))))  # of any word it may be read as
    right = _rare_grams(known, "word", seen, most).withColumn("len", F.length("word"))
    left = _rare_grams(unknown, "read", seen, _edits_allowed(F.col("read")))
    reach = F.greatest(F.lit(2), F.floor(F.length("read") / 8).cast("int"))
    left = left.withColumn("len", F.explode(F.sequence(F.greatest(F.length("read") - reach, F.lit(2)), F.length("read") + reach)))
    met = left.join(right, ["len", "gram"]).where("read != word").withColumn("edits", F.levenshtein("read", "word"))
    return met.where(F.col("edits") <= _edits_allowed(F.col("read"))).groupBy("read", "word").agg(F.first("capital").alias("capital"), F.first("n_read").alias("n_read"), F.first("n_clean").alias("n_clean"), F.first("edits").alias("edits"))


def learn_confusions(near: DataFrame) -> Confusions:
    """What unknown words with one nearest clean word differ in, as often as it is met; at most ``CONFUSIONS`` of at least ``CONFUSION_SHARE``.

    Words only met with a capital are mostly names, and words of up to four letters are
    near to others by chance: both teach nothing, nor do characters that are merely added
    or lost.
    """

    def run(batches):
        for pdf in batches:
            found = [(*d, n) for r, w, n in zip(pdf["read"], pdf["word"], pdf["n_read"]) if (d := difference(r, w)) and d[0] not in d[1] and d[1] not in d[0]]
            yield pd.DataFrame({"true": [f[0] for f in found], "seen": [f[1] for f in found], "n": [f[2] for f in found]})

    only = near.where("edits <= 2 and not capital and length(read) > 4").groupBy("read", "n_read", "edits").agg(F.count("*").alias("n"), F.first("word").alias("word")).groupBy("read", "n_read").agg(F.min(F.struct("edits", "n", "word")).alias("m")).where("m.n = 1")
    counts = only.select("read", "m.word", "n_read").mapInPandas(run, "true string, seen string, n long").groupBy("true", "seen").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.where(F.col("n") >= CONFUSION_SHARE * total).orderBy(F.desc("n"), "true", "seen").limit(CONFUSIONS).collect()
    return Confusions([(r["true"], r["seen"]) for r in kept])


def corrections(near: DataFrame, ranker) -> DataFrame:
    """(read, word, score): the best correction of each unknown word of ``near_words``, by the broadcast (ranker, confusions).

    Any two words of two letters are near, so there known confusions have to explain the difference.
    """

    def rank(batches):
        model, known = ranker.value
        for pdf in batches:
            x = np.array([pair_features(*r, known) for r in zip(pdf["read"], pdf["word"], pdf["n_clean"], pdf["edits"], pdf["capital"])]).reshape(len(pdf), 10)
            explained = (x[:, 3] > 2) | (x[:, 0] < 1)
            yield pd.DataFrame({"read": pdf["read"], "word": pdf["word"], "score": np.where(explained, model.scores(x), 0.0)})

    scored = near.mapInPandas(rank, "read string, word string, score double")
    return scored.groupBy("read").agg(F.max(F.struct("score", "word")).alias("best")).select("read", "best.word", "best.score").where("score >= 0.5")


def _words_of(line: str) -> list[str]:
    return [w for w in _LATIN_WORD.findall(line)]


def scan_noise(texts: DataFrame, clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src_table, rec_key, line_no, noise, was, becomes) and the scanned texts themselves.

    texts: (src_table, rec_key, text), of which only Latin scans give rows; null and
    empty texts give none. clean: (text) of documents that are not scans.
    """
    spark: SparkSession = texts.sparkSession
    texts = texts.select("src_table", "rec_key", "text")
    scanned = stage(texts.where("text is not null").distinct().mapInPandas(lambda batches: (b[[is_scan(t) for t in b["text"]]] for b in batches), texts.schema))
    words = stage(clean_words(clean))
    part = min(1.0, 1.5 * TEXT_SAMPLE / max(1, scanned.count()))
    some = scanned.where(F.pmod(F.xxhash64("rec_key"), F.lit(1 << 20)) < int((1 << 20) * part) + 1)
    drawn = some.orderBy(F.xxhash64("rec_key"), "src_table", "rec_key").limit(TEXT_SAMPLE).select("text").collect()
    vocabulary = [tuple(r) for r in words.where("n_clean >= 2").orderBy(F.xxhash64("word"), "word").limit(WORD_SAMPLE).collect()]
    weights = spark.sparkContext.broadcast(train_furniture([r[0] for r in drawn]).weights)
    joiner = spark.sparkContext.broadcast(train_joins(vocabulary))

    def analyse(batches):
        model = Regression()
        model.weights = weights.value
        for pdf in batches:
            rows = []
            for src, key, text in zip(pdf["src_table"], pdf["rec_key"], pdf["text"]):
                lines = text.replace("\r", "").split("\n")
                out = furniture(lines, model)
                rows += [(src, key, i + 1, noise, "", "", "", False) for i, noise in out.items()]
                cut = breaks(lines, out)
                starts, ends = {j: r for _, j, _, r, _ in cut}, {i: a for i, _, a, _, _ in cut}
                rows += [(src, key, i + 1, "break", a, r, mark, False) for i, _, a, r, mark in cut]
                for i, line in enumerate(lines):
                    if i in out or not line.strip() or _PLACEHOLDER.match(line):
                        continue
                    body = line.strip()
                    if i in starts and body.startswith(starts[i]):
                        body = body[len(starts[i]) :]
                    if i in ends:
                        body = body[: len(body) - len(ends[i]) - 1]
                    rows += [(src, key, i + 1, "word", w, "", "", w[0].isupper()) for w in set(_words_of(body)) if len(w) > 1]
            yield pd.DataFrame(rows, columns=["src_table", "rec_key", "line_no", "kind", "a", "b", "mark", "capital"])

    found = stage(scanned.mapInPandas(analyse, "src_table string, rec_key string, line_no int, kind string, a string, b string, mark string, capital boolean"))
    cuts = found.where("kind = 'break'").withColumn("at", F.monotonically_increasing_id())
    cuts = stage(cuts)
    joined = F.lower(F.concat("a", "b"))
    asked = cuts.select("at", F.explode(F.array(
        F.struct(F.lit("joined").alias("role"), joined.alias("word")), F.struct(F.lit("compound").alias("role"), F.lower(F.concat_ws("-", "a", "b")).alias("word")),
        F.struct(F.lit("left").alias("role"), F.lower("a").alias("word")), F.struct(F.lit("right").alias("role"), F.lower("b").alias("word")),
    )).alias("x")).select("at", "x.role", "x.word").join(words, "word")
    counts = asked.groupBy("at").agg(*(F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n_clean"))), F.lit(0)).alias(f"n_{r}") for r in ("joined", "compound", "left", "right")))

    def judge(batches):
        for pdf in batches:
            x = [join_features(*r) for r in zip(pdf["n_joined"], pdf["n_compound"], pdf["n_left"], pdf["n_right"], pdf["a"], pdf["b"], pdf["mark"])]
            s = joiner.value.scores(np.array(x).reshape(len(x), 9))
            yield pdf[["src_table", "rec_key", "line_no", "a", "b"]].assign(broken=s >= 0.5)

    judged = stage(cuts.join(counts, "at", "left").fillna(0, [f"n_{r}" for r in ("joined", "compound", "left", "right")]).mapInPandas(
        judge, "src_table string, rec_key string, line_no int, a string, b string, broken boolean"))
    tokens = (
        found.where("kind = 'word'").select("src_table", "rec_key", "line_no", F.col("a").alias("was"), "capital", F.lit(0).alias("split"))
        .unionByName(judged.where("broken").select("src_table", "rec_key", "line_no", F.concat("a", "b").alias("was"), F.col("a").rlike(r"^\p{Lu}").alias("capital"), F.length("a").alias("split")))
        .unionByName(judged.where("not broken").select("src_table", "rec_key", "line_no", F.explode(F.array("a", "b")).alias("was"), F.lit(False).alias("capital"), F.lit(0).alias("split")))
        .withColumn("read", F.lower("was"))
    )
    plain = (F.length(F.regexp_replace("read", r"[^\p{L}]", "")) >= 2) & ~F.col("read").rlike(r"^\p{L}\d+$")
    unknown = tokens.where(plain).groupBy("read").agg(F.min("capital").alias("capital"), F.count("*").alias("n_read")).join(words.where("n_clean >= 2").select(F.col("word").alias("read")), "read", "left_anti")
    near = stage(near_words(unknown, words))
    known = learn_confusions(near)
    fixes = corrections(near, spark.sparkContext.broadcast((train_ranker(vocabulary, known), known)))
    same = F.length(F.regexp_extract(F.concat_ws("\n", "read", "word"), r"^(.*)[^\n]*\n\1", 1))
    misread = tokens.join(fixes, "read").select(
        "src_table", "rec_key", (F.col("line_no") + F.when((F.col("split") > 0) & (same >= F.col("split")), 1).otherwise(0)).cast("int").alias("line_no"), F.lit("misread").alias("noise"), "was", F.col("word").alias("becomes"),
    )
    furniture_rows = found.where("kind in ('header', 'page_number')").select("src_table", "rec_key", "line_no", F.col("kind").alias("noise"), F.lit("").alias("was"), F.lit("").alias("becomes"))
    hyphens = judged.where("broken").select("src_table", "rec_key", "line_no", F.lit("hyphen").alias("noise"), F.col("a").alias("was"), F.concat("a", "b").alias("becomes"))
    return furniture_rows.unionByName(hyphens).unionByName(misread), scanned


def rebuild(text: str, noise: list[tuple[int, str, str, str]]) -> str:
    """The text in paragraphs without furniture, broken words joined and misread words replaced; a replacement keeps a capital."""
    drop, joined = set(), {}
    swaps: dict[int, list[tuple[str, str]]] = {}
    for line, kind, was, becomes in noise:
        if kind in ("header", "page_number"):
            drop.add(line)
        elif kind == "hyphen":
            joined[line] = was
        else:
            swaps.setdefault(line, []).append((was, becomes))
    every = [s for x in swaps.values() for s in x]
    paragraphs, current, glue = [], "", False
    for i, line in enumerate(text.replace("\r", "").split("\n"), 1):
        if i in drop:
            continue
        line = line.strip()
        if not line:
            if current and current.rstrip()[-1:] in ".!?:;”\"'" and not glue:
                paragraphs.append(current)
                current = ""
            continue
        current += line if glue or not current else " " + line
        glue = i in joined
        if glue:
            current = current.rstrip()[:-1]
        if line.endswith(":") or _PLACEHOLDER.match(line):
            paragraphs.append(current)
            current, glue = "", False
    if current:
        paragraphs.append(current)
    whole = "\n\n".join(paragraphs)
    for was, becomes in sorted(set(every), key=lambda s: -len(s[0])):
        new = becomes.capitalize() if was[:1].isupper() else becomes
        whole = re.sub(rf"(?<!\w){re.escape(was)}(?!\w)", new, whole)
    return whole


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "parsed_docs", "path", "text", "doc_type").where("text is not null")
    results = table(spark, folder, "parse_results", "result_id", "text")
    texts = results.select(F.lit("parse_results").alias("src_table"), F.col("result_id").cast("string").alias("rec_key"), "text").unionByName(
        docs.where(F.lower("doc_type") == "pdf").select(F.lit("parsed_docs").alias("src_table"), F.col("path").alias("rec_key"), "text")
    )
    return texts, docs.where("lower(doc_type) != 'pdf' or doc_type is null").select("text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    noise, _ = scan_noise(*_inputs(spark, folder))
    return noise.select("src_table", "rec_key", "line_no", "noise").distinct()


def p7_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned texts as continuous paragraphs."""
    noise, scanned = scan_noise(*_inputs(spark, folder))
    per = noise.groupBy("src_table", "rec_key").agg(F.sort_array(F.collect_set(F.struct("line_no", "noise", "was", "becomes"))).alias("noise"))  # of one text

    def run(batches):
        for pdf in batches:
            fixed = [rebuild(t, [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in (n if n is not None else [])]) for t, n in zip(pdf["text"], pdf["noise"])]
            yield pd.DataFrame({"src_table": pdf["src_table"], "rec_key": pdf["rec_key"], "repaired": fixed})

    return scanned.join(per, ["src_table", "rec_key"], "left").mapInPandas(run, "src_table string, rec_key string, repaired string")

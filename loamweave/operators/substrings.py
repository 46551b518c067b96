"""Which texts contain which words, without comparing each with each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of letters and digits, and what lies between them; longest piece of a run that is looked up, the rest is left to the check.
RUN, LONGEST = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+", 64
LETTERS = r"^[\p{L}\p{N}]"
SIZES = [1 << i for i in range(LONGEST.bit_length())]


def _runs(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(RUN), 0)


def _key(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def _inside(run: Column, size: int) -> Column:
    """All pieces of a run of ``size`` characters."""
    return F.when(F.length(run) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - (size - 1), F.lit(1))), lambda i: F.substring(run, i, size))).otherwise(F.array().cast("array<string>"))


def _keys_of_run(run: Column) -> Column:
    """What a run of a text can be met by: (kind, key)."""
    most = F.sequence(F.lit(1), F.least(F.length(run), F.lit(LONGEST)))
    pieces = F.array_distinct(F.flatten(F.array(*(_inside(run, n) for n in SIZES))))
    return F.concat(
        F.array(_key("whole", run)), F.transform(most, lambda n: _key("start", F.substring(run, F.lit(1), n))), F.transform(most, lambda n: _key("end", F.right(run, n))),
        F.transform(pieces, lambda p: _key("inside", p)),
    )


def _keys_of_word(runs: Column) -> Column:
    """What must be met by the runs of any text with the word: (kind, key), one for each of the word's runs.

    A run within the word is a whole run of the text, the first ends one, the last starts
    one, the only one lies inside one. Runs of other than letters and digits count only
    in a word of nothing else.
    """
    n = F.size(runs)
    size = F.greatest(*(F.when(F.length(runs[0]) >= s, s).otherwise(1) for s in SIZES))
    cut = lambda r: F.substring(r, 1, LONGEST)
    part = lambda r, i: F.when(i == 0, _key("end", F.right(r, F.lit(LONGEST)))).when(i == n - 1, _key("start", cut(r))).otherwise(_key("whole", r))
    many = F.transform(runs, lambda r, i: F.struct(part(r, i).alias("k"), r.alias("r")))
    telling = F.filter(many, lambda x: x["r"].rlike(LETTERS))
    one = F.array(_key("inside", F.substring(runs[0], F.lit(1), size)), _key("inside", F.right(runs[0], size)))
    return F.when(n == 1, one).otherwise(F.transform(F.when(F.size(telling) > 0, telling).otherwise(many), lambda x: x["k"]))


def candidates(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(h, word): distinct words (word) and the texts (h, body) that may contain them, all those that do among them.

    Texts and words are cut into runs of letters and digits and what lies between. Each
    word is looked up by that run of it which the fewest texts have (whole, or their start,
    end or inside), in the distinct runs of all texts.
    """
    held = texts.select("h", F.explode(F.array_distinct(_runs("body"))).alias("run"))
    keys = held.groupBy("run").agg(F.count("*").alias("n")).select("run", "n", F.explode(_keys_of_run(F.col("run"))).alias("k")).select("run", "n", "k.kind", "k.key")
    totals = keys.groupBy("kind", "key").agg(F.sum("n").alias("total"))
    asked = words.select("word", F.explode(_keys_of_word(_runs("word"))).alias("k")).select("word", "k.kind", "k.key")
    rarest = asked.join(totals.hint("merge"), ["kind", "key"], "left").groupBy("word").agg(F.min(F.struct(F.coalesce("total", F.lit(0)).alias("total"), "kind", "key")).alias("r")).where("r.total > 0")
    runs = rarest.select("word", "r.kind", "r.key").join(keys.hint("merge"), ["kind", "key"]).select("word", "run")
    return runs.join(held.hint("merge"), "run").select("h", "word").distinct()


def containing(bodies: DataFrame, words: DataFrame) -> DataFrame:
    """bodies (.., body) joined with the distinct words (word) each contains, case as it is; null and empty ones meet nothing.

    Texts are known by a hash until they are checked, so none is shuffled once a run.
    """
    hashed = bodies.where("body is not null").withColumn("h", F.xxhash64("body"))
    met = candidates(hashed.select("h", "body").distinct(), words.where("word is not null and word != ''").select("word").distinct())
    return hashed.join(met.hint("merge"), "h").where(F.col("body").contains(F.col("word"))).drop("h")

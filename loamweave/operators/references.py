"""References to records that do not exist.

Parent keys are read as (template, integer): the first run of digits of a key is its
integer, the text around it (and the number of digits) its template. The sorted
integers of a template are compressed into contiguous runs, and a reference is matched
as-of to the run that starts last before it: it is an orphan if there is none or its
integer lies beyond the run's end. A key without digits is a template of its own with
integer 0, so any string key is covered exactly.

Runs are cut at every multiple of ``SPAN``, hence a match never needs more than one
(template, integer / SPAN) cell and no template has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamweave.operators.stage import newest
from loamweave.sources.tables import table

SPAN = 4096
_KEY = r"^(\D*)(\d{1,18})([\s\S]*)$"


def _cell(key: Column) -> list[Column]:
    digits = F.regexp_extract(key, _KEY, 2)
    number = F.when(digits != "", digits.cast("long")).otherwise(F.lit(0).cast("long"))
    template = F.when(
        digits != "",
        F.concat_ws("\x01", F.regexp_extract(key, _KEY, 1), F.length(digits).cast("string"), F.regexp_extract(key, _KEY, 3)),
    ).otherwise(key)
    return [template.alias("template"), F.floor(number / SPAN).cast("long").alias("cell"), number.alias("number")]


def key_runs(parents: DataFrame, key: str = "key") -> DataFrame:
    """Contiguous runs (template, cell, first, last) of the parent keys; null keys name nothing."""
    keys = parents.where(F.col(key).isNotNull()).select(*_cell(F.col(key))).distinct()
    by = Window.partitionBy("template", "cell").orderBy("number")
    return (
        keys.withColumn("island", F.col("number") - F.row_number().over(by))
        .groupBy("template", "cell", "island")
        .agg(F.min("number").alias("first"), F.max("number").alias("last"))
        .drop("island")
    )


def orphan_keys(references: DataFrame, parents: DataFrame, key: str = "key") -> DataFrame:
    """Distinct non-null reference keys without a parent key, by an as-of match on key runs.

    Repeated references cost one row; an empty parent table makes every key an orphan.
    """
    runs = key_runs(parents, key).select(
        "template", "cell", F.col("first").alias("number"), F.lit(0).alias("is_ref"), F.col("last"), F.lit(None).cast("string").alias(key)
    )
    wanted = references.where(F.col(key).isNotNull()).select(key).distinct().select(
        *_cell(F.col(key)), F.lit(1).alias("is_ref"), F.lit(None).cast("long").alias("last"), key
    )
    by = Window.partitionBy("template", "cell").orderBy("number", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    matched = runs.unionByName(wanted).withColumn("run_end", F.last("last", ignorenulls=True).over(by))
    return matched.where((F.col("is_ref") == 1) & (F.col("run_end").isNull() | (F.col("number") > F.col("run_end")))).select(key)


def check_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References with a fault.

    references: (src_table, rec_key, ref_kind, ref_value, key, at, month); key null: the
    value can name nothing. parents: (key, deleted, since), one or more rows a key.
    fault: ``missing``, else ``deleted`` if every parent of the key is deleted, else
    ``late`` if the earliest parent that is not deleted is younger than the referrer.
    A null time never makes a reference late.
    """
    known = parents.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min(F.col("deleted").cast("int")).alias("gone"),
        F.min(F.when(~F.col("deleted"), F.coalesce("since", F.lit("0001-01-01").cast("timestamp_ntz")))).alias("since"),
    )
    orphans = orphan_keys(references, parents).withColumn("orphan", F.lit(True))
    state = orphans.unionByName(known, allowMissingColumns=True)
    fault = (
        F.when(F.col("key").isNull() | F.col("orphan"), "missing")
        .when(F.col("gone") == 1, "deleted")
        .when(F.col("since") > F.col("at"), "late")
    )
    columns = ["src_table", "rec_key", "ref_kind", "ref_value", "key", "at", "month"]
    return references.select(*columns).join(state, "key", "left").withColumn("fault", fault).where("fault is not null").drop("orphan", "gone", "since", "key")


def _folded(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")))


def name_key(value: Column) -> Column:
    """A page's title, file name or alias without outer blanks and letter case; null if empty."""
    name = _folded(value)
    return F.when(name != "", name)


def link_key(value: Column) -> Column:
    """Page name of a link: up to ``|`` or ``#``."""
    return name_key(F.regexp_replace(value, r"[|#][\s\S]*$", ""))


def path_key(value: Column) -> Column:
    """Source path: slashes, no leading ``./``."""
    path = F.regexp_replace(F.translate(_folded(value), "\\", "/"), r"^(\./)+", "")
    return F.when(path != "", path)


def asset_key(value: Column) -> Column:
    """Image path below ``assets/``; null for an absolute path or one with ``..``."""
    path = F.regexp_replace(F.regexp_replace(F.translate(_folded(value), "\\", "/"), r"^(\./)+", ""), r"^wiki/", "")
    bad = path.rlike(r"^/|^[a-z]:|(^|/)\.\.(/|$)") | (path == "")
    return F.when(~bad, F.when(path.startswith("assets/"), path).otherwise(F.concat(F.lit("assets/"), path)))


def _month(at: str) -> Column:
    return F.date_format(at, "yyyy-MM").alias("month")


def _ref(src: str, key: str, kind: str, at: str, normal) -> list[Column]:
    value = F.col("value")
    return [
        F.lit(src).alias("src_table"), F.col(key).alias("rec_key"), F.lit(kind).alias("ref_kind"),
        value.alias("ref_value"), F.concat(F.lit(kind + ":"), normal(value)).alias("key"), F.col(at).alias("at"), _month(at),
    ]


def vault_references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """References of the newest live wiki pages and of parsed documents, and the records they may name."""
    pages = newest(
        table(spark, folder, "wiki_pages"), ["page_id"], "updated_at",
        ["page_id", "updated_at", "path", "title", "aliases", "sources", "links", "created_at", "deleted_at"],
    )
    live = pages.where("deleted_at is null")
    docs = table(spark, folder, "parsed_docs", "path", "images", "parsed_at")
    refs = (
        live.select("page_id", "updated_at", F.explode("links").alias("value")).select(*_ref("wiki_pages", "page_id", "link", "updated_at", link_key))
        .unionByName(live.select("page_id", "updated_at", F.explode("sources").alias("value")).select(*_ref("wiki_pages", "page_id", "source", "updated_at", path_key)))
        .unionByName(docs.select("path", "parsed_at", F.explode("images.rel_path").alias("value")).select(*_ref("parsed_docs", "path", "image", "parsed_at", asset_key)))
        .where(F.regexp_replace("ref_value", r"(?U)\s", "") != "")
        .distinct()
    )
    names = F.array_union(
        F.array(name_key(F.col("title")), name_key(F.regexp_replace(F.regexp_replace("path", r"^[\s\S]*[/\\]", ""), r"(?i)\.md\s*$", ""))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), name_key),
    )
    sources = newest(table(spark, folder, "source_manifest"), ["path"], "last_processed", ["path", "last_processed", "status", "first_seen"])
    images = newest(table(spark, folder, "image_manifest"), ["rel_path"], "registered_at", ["rel_path", "registered_at", "status"])
    gone = F.coalesce(F.lower(F.trim("status")) == "deleted", F.lit(False))
    parents = (
        pages.select(F.explode(names).alias("name"), F.col("deleted_at").isNotNull().alias("deleted"), F.col("created_at").alias("since"))
        .select(F.concat(F.lit("link:"), "name").alias("key"), "deleted", "since")
        .unionByName(sources.select(F.concat(F.lit("source:"), path_key(F.col("path"))).alias("key"), gone.alias("deleted"), F.col("first_seen").alias("since")))
        .unionByName(images.select(F.concat(F.lit("image:"), asset_key(F.col("rel_path"))).alias("key"), gone.alias("deleted"), F.col("registered_at").alias("since")))
    )
    return refs, parents


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(src_table, rec_key, ref_kind, ref_value, fault) of every faulty reference."""
    return check_references(*vault_references(spark, folder)).select("src_table", "rec_key", "ref_kind", "ref_value", "fault").distinct()


def p6_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """Faulty references per table and month."""
    faults = check_references(*vault_references(spark, folder))
    return faults.groupBy("src_table", "month", "ref_kind", "fault").agg(F.count("*").alias("n"), F.countDistinct("rec_key").alias("n_records"))

"""Incremental ingest: source diffs, manifests, images, captions, tags and the map of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamweave.functions.text import embed_key
from loamweave.operators.stage import newest

#: Sections of the map of contents in their order; types without one are last.
SECTIONS = (("product", "产品实体"), ("source-summary", "源摘要"), ("concept", "概念知识"), ("comparison", "对比分析"), ("overview", "元信息"), ("log", "元信息"))
OTHER_SECTION = "其他"


def diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, sha256, state) of current documents (path, sha256) against manifest rows (path, sha256, status).

    state: new, modified, unchanged, or deleted for a processed entry that is gone.
    Repeated documents count once, null paths not at all.
    """
    now = current.where("path is not null").groupBy("path").agg(F.max("sha256").alias("now"), F.lit(True).alias("here"))
    was = manifest.where("path is not null").groupBy("path").agg(F.max(F.struct("sha256", "status")).alias("m")).select("path", F.col("m.sha256").alias("was"), F.col("m.status").alias("status"), F.lit(True).alias("known"))
    state = (
        F.when(F.col("known").isNull(), "new").when(F.col("here").isNull() & (F.col("status") == "processed"), "deleted")
        .when(F.col("here").isNull(), None).when(F.col("now").eqNullSafe(F.col("was")), "unchanged").otherwise("modified")
    )
    return now.join(was, "path", "full_outer").select("path", F.coalesce("now", "was").alias("sha256"), state.alias("state")).where("state is not null")


def upsert(manifest: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Manifest (path, sha256, status) after a diff: new and modified become processed, deleted ones deleted, the rest stay."""
    status = F.when(F.col("state") == "deleted", "deleted").otherwise("processed")
    new = changes.where("state != 'unchanged'").select("path", "sha256", status.alias("status"), at.alias("last_processed"), F.lit(1).alias("fresh"))
    old = manifest.select("path", "sha256", "status", "last_processed", F.lit(0).alias("fresh"))
    return newest(old.unionByName(new), ["path"], "fresh", ["path", "fresh", "last_processed", "sha256", "status"]).drop("fresh")


def cache_misses(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Distinct content hashes that have no vector yet."""
    return wanted.where("content_hash is not null").select("content_hash").distinct().join(cached.select("content_hash"), "content_hash", "left_anti")


def cache_stale(cached: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cached vectors no chunk has any more: what a build prunes."""
    return cached.where("content_hash is not null").select("content_hash").distinct().join(wanted.select("content_hash"), "content_hash", "left_anti")


def page_cache_keys(chunks: DataFrame) -> DataFrame:
    """(page_id, cache_key, n_chunks): the hash of a page's content hashes in the order of its chunks."""
    once = chunks.select("page_id", "chunk_index", "content_hash").distinct()
    packed = once.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content_hash"))).alias("parts"))  # hashes of one page
    joined = F.array_join(F.transform("parts", lambda p: F.concat(p["content_hash"], F.lit("\x1f"))), "")
    return packed.select("page_id", F.sha2(joined, 256).alias("cache_key"), F.size("parts").alias("n_chunks"))


def dedup_bytes(images: DataFrame, order: str | None = None) -> DataFrame:
    """(filename, sha256, kept): the file name kept for each image content is the first by ``order``, ties and without it the least."""
    first = F.min(F.struct(F.col(order) if order else F.lit(0), "filename"))
    kept = images.where("sha256 is not null").groupBy("sha256").agg(first.alias("k")).select("sha256", F.col("k.filename").alias("kept"))
    return images.select("filename", "sha256").distinct().join(kept, "sha256", "left")


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.\w+$", "")


def carry_captions(new: DataFrame, old: DataFrame) -> DataFrame:
    """New images (source_doc, filename) with the caption of an old image of the same document and stem: of captioned rows the latest, else none."""
    had = old.where(F.length(F.trim("caption_text")) > 0).groupBy("source_doc", stem(F.col("filename")).alias("stem")).agg(F.max_by("caption_text", F.struct("registered_at", "caption_text")).alias("caption_text"))
    return new.withColumn("stem", stem(F.col("filename"))).join(had, ["source_doc", "stem"], "left").withColumn("status", F.when(F.col("caption_text").isNotNull(), "captioned").otherwise("pending_vlm"))


def caption_pages(images: DataFrame) -> DataFrame:
    """(page_id, title, content, page_type) of images with a caption: the caption text, else the model's description."""
    text = F.coalesce(F.nullif(F.trim("caption_text"), F.lit("")), F.nullif(F.trim("vlm_caption.description"), F.lit("")))
    rows = images.select(F.col("rel_path").alias("page_id"), F.col("filename").alias("title"), text.alias("content"), F.lit("image_caption").alias("page_type"))
    return rows.where("content is not null and page_id is not null").distinct()


def pending(images: DataFrame, limit: int | None = None) -> DataFrame:
    """(source_doc, n_pending) of images without a caption, most first; ``limit`` documents if given."""
    rows = images.where("coalesce(status, '') not in ('captioned', 'deleted')").groupBy("source_doc").agg(F.countDistinct("rel_path").alias("n_pending")).orderBy(F.desc("n_pending"), "source_doc")
    return rows.limit(limit) if limit else rows


def apply_captions(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Images with the captions (filename, caption_text, vlm_caption, position) of their file name, of repeated ones the last.

    An empty caption text is filled from the model's description and key values; the
    status follows the text. Images without a caption stay as they are.
    """
    last = captions.where("filename is not null").groupBy("filename").agg(F.max(F.struct("position", "caption_text", "vlm_caption")).alias("c"))
    said = F.trim(F.coalesce("c.caption_text", F.lit("")))
    described = F.trim(F.coalesce("c.vlm_caption.description", F.lit("")))
    keys = F.when(F.size(F.coalesce("c.vlm_caption.key_values", F.array().cast("array<string>"))) > 0, F.concat(F.lit("\n关键词: "), F.array_join("c.vlm_caption.key_values", ", "))).otherwise("")
    text = F.when(said != "", said).when(described != "", F.concat(described, keys)).otherwise("")
    both = images.join(last, "filename", "left")
    has = F.col("c").isNotNull()
    return both.withColumns({
        "caption_text": F.when(has, text).otherwise(F.col("caption_text")), "vlm_caption": F.when(has, F.col("c.vlm_caption")).otherwise(F.col("vlm_caption")),
        "status": F.when(has, F.when(text != "", "captioned").otherwise("pending_vlm")).otherwise(F.col("status")),
    }).drop("c")


def deduplicated(images: DataFrame, order: str) -> DataFrame:
    """One image a document and stem: the last with a caption, else the first; at the place of the first (column place)."""
    keyed = images.withColumn("stem", stem(F.coalesce("filename", F.regexp_extract("rel_path", r"([^/]+)$", 1))))
    row = F.struct(*[c for c in images.columns])
    has = F.length(F.trim(F.coalesce("caption_text", F.lit("")))) > 0
    picked = keyed.groupBy("source_doc", "stem").agg(
        F.coalesce(F.max_by(F.when(has, row), F.when(has, F.col(order))), F.min_by(row, F.col(order))).alias("r"), F.min(order).alias("place"),
    )
    return picked.select("r.*", "place")


def collapsed_entries(entries: DataFrame, order: str) -> DataFrame:
    """One manifest row a path (letter case of a drive and kind of slash aside): the first processed one, else the first."""
    path = F.translate("path", "\\", "/")
    key = F.when(path.rlike(r"^[a-z]:"), F.concat(F.upper(F.substring(path, 1, 1)), F.substring(path, 2, 1 << 20))).otherwise(path)
    row = F.struct(*entries.columns)
    first = F.min_by(row, F.struct(F.coalesce(F.col("status") != "processed", F.lit(True)), order))
    return entries.where("path is not null").groupBy(key.alias("key")).agg(first.alias("r")).select("key", "r.*")


def heal(references: DataFrame, images: DataFrame, disk: DataFrame) -> DataFrame:
    """Rows (filename, rel_path, sha256, parent_page_id, referring_wiki_pages, status) for images that pages (page_id, value) show, that lie on disk (rel_path, sha256) and that are not registered (filename, rel_path), letter case aside."""
    refs = references.select("page_id", embed_key(F.col("value")).alias("rel_path")).where("rel_path is not null")
    name = lambda c: F.lower(F.regexp_extract(c, r"([^/]+)$", 1))
    known = images.select(F.lower(F.coalesce("filename", F.regexp_extract("rel_path", r"([^/]+)$", 1))).alias("name")).distinct()
    real = disk.groupBy(F.lower("rel_path").alias("low")).agg(F.min("sha256").alias("sha256"))
    new = refs.withColumn("name", name("rel_path")).join(known, "name", "left_anti").withColumn("low", F.lower("rel_path")).join(real, "low")
    one = new.groupBy("name").agg(F.min("rel_path").alias("rel_path"), F.min("sha256").alias("sha256"), F.array_sort(F.collect_set("page_id")).alias("referring_wiki_pages"))
    return one.select(
        F.regexp_extract("rel_path", r"([^/]+)$", 1).alias("filename"), "rel_path", "sha256", F.element_at("referring_wiki_pages", 1).alias("parent_page_id"), "referring_wiki_pages", F.lit("pending_vlm").alias("status"),
    )


def provenance(references: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, parent_page_id, n_pages, source_doc, n_sources, status) of the images that pages show.

    references: (page_id, value); the candidates are the sources below raw/ of the pages
    (page_id, sources). status is the registered image's own (rel_path, status), else
    resolved, ambiguous_provenance or unresolved_provenance by their number.
    """
    refs = references.select("page_id", embed_key(F.col("value")).alias("key")).where("key is not null").distinct()
    source = pages.select("page_id", F.explode("sources").alias("s")).select("page_id", F.translate("s", "\\", "/").alias("source")).where(F.lower("source").startswith("raw/")).distinct()
    per = refs.groupBy("key").agg(F.min("page_id").alias("parent_page_id"), F.count("*").alias("n_pages"))
    found = refs.join(source, "page_id").groupBy("key").agg(F.countDistinct("source").alias("n_sources"), F.min("source").alias("source"))
    known = images.select(embed_key(F.col("rel_path")).alias("key"), "status").where("key is not null").groupBy("key").agg(F.max(F.coalesce("status", F.lit("registered"))).alias("registered"))
    both = per.join(found, "key", "left").join(known, "key", "left").fillna(0, ["n_sources"])
    state = F.when(F.col("n_sources") == 1, "resolved").when(F.col("n_sources") > 1, "ambiguous_provenance").otherwise("unresolved_provenance")
    return both.select("key", "parent_page_id", "n_pages", F.when(F.col("n_sources") == 1, F.col("source")).otherwise("").alias("source_doc"), "n_sources", F.coalesce("registered", state).alias("status"))


def audit(references: DataFrame, images: DataFrame, disk: DataFrame) -> DataFrame:
    """One row of counters over images that pages show (value), registered ones (rel_path, status) and those on disk (rel_path).

    referenced; of these registered, unregistered (on disk), missing (not on disk) and
    case_mismatch (on disk in another letter case only); orphan: on disk, neither shown nor
    registered; pending_vlm and captioned images.
    """
    refs = references.select(embed_key(F.col("value")).alias("ref")).where("ref is not null").distinct()
    by = lambda df, name: df.groupBy(F.lower(name).alias("low"))
    reg = images.select(embed_key(F.col("rel_path")).alias("reg")).where("reg is not null")
    real = disk.where("rel_path is not null").select(F.col("rel_path").alias("file")).distinct()
    shown = by(refs, "ref").agg(F.count("*").alias("n_refs"), F.collect_set("ref").alias("refs"))  # spellings of one path
    both = shown.join(by(reg, "reg").agg(F.lit(True).alias("is_registered")), "low", "full_outer").join(by(real, "file").agg(F.max("file").alias("file")), "low", "full_outer")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    has, registered, there = F.col("n_refs").isNotNull(), F.coalesce("is_registered", F.lit(False)), F.col("file").isNotNull()
    refs_n = F.coalesce("n_refs", F.lit(0))
    counted = both.agg(
        n(refs_n).alias("referenced"), n((has & registered).cast("int")).alias("registered"), n(F.when(~registered & there, refs_n)).alias("unregistered"), n(F.when(~there, refs_n)).alias("missing"),
        n(F.when(there, F.size(F.filter(F.coalesce("refs", F.array().cast("array<string>")), lambda r: r != F.col("file"))))).alias("case_mismatch"), n((there & ~registered & ~has).cast("int")).alias("orphan"),
    )
    states = images.agg(n((F.col("status") == "pending_vlm").cast("int")).alias("pending_vlm"), n((F.col("status") == "captioned").cast("int")).alias("captioned"))
    return counted.crossJoin(states)  # one row each


def pages_of_sources(pages: DataFrame) -> DataFrame:
    """(source, n_pages, first_page) from the pages' source lists."""
    return pages.select("page_id", F.explode("sources").alias("source")).where(F.trim("source") != "").groupBy("source").agg(F.countDistinct("page_id").alias("n_pages"), F.min("page_id").alias("first_page"))


def contents(pages: DataFrame) -> DataFrame:
    """(section_no, section, slug, title, n_section) lines of the map of contents: sections in their fixed order, types without one last, lines by slug; index pages are left out."""
    slug = F.regexp_replace(F.regexp_replace("path", r"^.*[/\\]", ""), r"\.md$", "")
    number, name = F.lit(len(SECTIONS)), F.lit(OTHER_SECTION)
    first = {}
    for n, (kind, label) in enumerate(SECTIONS):
        first.setdefault(label, n)
        number, name = F.when(F.col("page_type") == kind, first[label]).otherwise(number), F.when(F.col("page_type") == kind, label).otherwise(name)
    rows = pages.select(number.alias("section_no"), name.alias("section"), slug.alias("slug"), F.coalesce("title", slug).alias("title")).where("slug != 'index'")
    sizes = rows.groupBy("section_no", "section").agg(F.count("*").alias("n_section"))
    return rows.join(sizes, ["section_no", "section"]).select("section_no", "section", "slug", "title", "n_section").orderBy("section_no", F.lower("slug"), "slug")


def image_meta(wanted: DataFrame, images: DataFrame) -> DataFrame:
    """(path, rel_path) of wanted paths, slashes either way: the registered path that equals it, else the longest one it ends in, null without one."""
    known = images.where("rel_path is not null and rel_path != ''").select("rel_path").distinct()
    asked = wanted.where("path is not null").select("path").distinct().withColumn("body", F.translate("path", "\\", "/"))
    tail = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("body", "/"))), lambda i: F.array_join(F.slice(F.split("body", "/"), i, F.size(F.split("body", "/"))), "/")))
    cut = asked.select("path", tail.alias("rel_path")).join(known, "rel_path")
    best = cut.groupBy("path").agg(F.max(F.struct(F.length("rel_path"), "rel_path")).alias("b"))
    return asked.select("path").join(best, "path", "left").select("path", F.col("b.rel_path").alias("rel_path"))


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, fault): missing for keys only expected, extra for keys only there."""
    a, b = expected.select(key).where(F.col(key).isNotNull()).distinct().withColumn("e", F.lit(1)), actual.select(key).where(F.col(key).isNotNull()).distinct().withColumn("a", F.lit(1))
    return a.join(b, key, "full_outer").where("e is null or a is null").select(key, F.when(F.col("e").isNull(), "extra").otherwise("missing").alias("fault"))

"""Column functions on text. All return null for null; empty input gives an empty result unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of exact terms, in the order they are looked for.
EXACT_CLASSES = {
    "url": r"https?://[^\s)\]]+",
    "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b",
    "drive_path": r"[A-Za-z]:[\\/][^\s]+",
    "path": r"(?<![A-Za-z0-9/])(?:/[\w.\-]+){2,}",
    "flag": r"--?[A-Za-z][\w\-]*",
    "quantity": r"\b\d+(?:\.\d+)?\s?(?:mm|cm|m|km|kg|g|mg|s|ms|µs|Hz|kHz|MHz|GHz|Mbps|Gbps|Mbps|V|mV|A|mA|W|kW|°C|%|fps|rpm|px)\b",
    "code": r"\b(?:0x)?[A-Z]{1,4}-?\d{2,}(?:\.\d+)*\b",
    "hex": r"(?:0[xX])[0-9A-Fa-f]+\b",
    "number": r"\b\d{2,}(?:\.\d+)?\b",
}
#: Identifiers, their sub-words, and runs of Chinese characters.
IDENTIFIER = r"[A-Za-z][A-Za-z0-9]*(?:[_\-][A-Za-z0-9]+)*"
SUBWORD = r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])"
CJK_RUN = r"[一-鿿]+"
#: Tag spellings.
TAG_ALIASES = {"c-ncap": "C-NCAP", "euro-ncap": "Euro-NCAP"}


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def exact_terms(text: Column) -> Column:
    """URLs, addresses, paths, flags, quantities, codes and numbers, in the order of their classes, without repeats."""
    return F.array_distinct(F.concat(*(found(text, "(?U)" + p) for p in EXACT_CLASSES.values())))


def identifiers(text: Column) -> Column:
    return F.array_distinct(found(text, IDENTIFIER))


def cjk_bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters of each run of Chinese characters; a run of one gives nothing."""
    pairs = lambda run: F.when(F.length(run) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, 2))
    )
    return F.flatten(F.transform(found(text, CJK_RUN), pairs))


def fts_terms(text: Column, lexicon: list[str] | None = None) -> Column:
    """Sorted set of lexicon terms, identifiers, lower-case sub-words and bigrams."""
    subwords = F.transform(found(text, SUBWORD), F.lower)
    words = F.array(*(F.lit(x) for x in lexicon or [])).cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(words, found(text, IDENTIFIER), subwords, cjk_bigrams(text))))


def unicode_terms(text: Column) -> Column:
    """Lower-case words of letters and digits of any script, Chinese characters in pairs; repeats stay."""
    plain = F.lower(F.regexp_replace(text, CJK_RUN, " "))
    return F.concat(found(plain, r"[\p{L}\p{N}_]+"), cjk_bigrams(text))


def search_text(text: Column, lexicon: list[str] | None = None) -> Column:
    """What the full-text index holds of a text: its terms and exact terms, joined by blanks."""
    return F.array_join(F.concat(fts_terms(text, lexicon), exact_terms(text)), " ")


def collapsed(text: Column) -> Column:
    """White space of any kind as single blanks, without outer ones."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Parts that end with one of 。！？!?； ; an ASCII semicolon parts without being kept, line feeds and full stops do not part."""
    return F.filter(F.transform(found(text, r"[^。！？!?；;]+[。！？!?；]?"), lambda s: F.trim(s)), lambda s: s != "")


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w]+", "-"), r"^-+|-+$", ""))


def image_name(doc_slug: Column, number: Column, extension: Column) -> Column:
    return F.format_string("%s_img%02d.%s", doc_slug, number, extension)


def first_heading(text: Column, otherwise: Column) -> Column:
    """The first level-one heading, else another value."""
    head = F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+)$", 1))
    return F.when(head != "", head).otherwise(otherwise)


def wikilinks(text: Column) -> Column:
    """Targets of [[target|shown]] links, embeds included, blanks trimmed."""
    return F.transform(found(text, r"\[\[([^\]]+)\]\]", 1), lambda x: F.trim(F.substring_index(x, "|", 1)))


def token_count(text: Column) -> Column:
    """max(1, characters // 4)."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def cut_to_budget(text: Column, budget: Column | int) -> Column:
    """The longest prefix within a budget of tokens, without trailing blanks; '' for a budget below 1."""
    n = F.lit(budget) if isinstance(budget, int) else budget
    return F.when(n < 1, F.lit("")).otherwise(F.rtrim(F.substr(text, F.lit(1), (4 * n + 3).cast("int"))))


def tag(value: Column) -> Column:
    """Tags as they may be written: blanks as hyphens, no #, known spellings."""
    plain = F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", "-"), "#", "")
    known = F.create_map(*(F.lit(x) for pair in TAG_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, plain), plain)


def embed_key(reference: Column) -> Column:
    """Vault path below ``assets/`` of an image reference, its letter case kept: cut at | and #, slashes, no leading ./ and wiki/; null for an absolute path or one with ``..``."""
    path = F.translate(F.trim(F.regexp_replace(reference, r"[|#][\s\S]*$", "")), "\\", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), r"^(?i)wiki/", "")
    bad = path.rlike(r"^/|^[A-Za-z]:/|(^|/)\.\.(/|$)") | (path == "")
    full = F.when(path.rlike(r"^(?i)assets/"), path).otherwise(F.concat(F.lit("assets/"), path))
    parts = F.filter(F.split(full, "/"), lambda p: ~p.isin("", "."))
    return F.when(~bad, F.array_join(parts, "/"))


def image_placeholders(text: Column) -> Column:
    """Placeholders {{IMG|path|图注: caption}} as embeds of the file name, the caption on the next line unless it is empty or [无图注]."""
    bare = F.regexp_replace(text, r"(?s)\{\{IMG\|(?:[^|]*/)?([^|/]+)\|图注: (?:\[无图注\])?\}\}", "![[$1]]")
    return F.regexp_replace(bare, r"(?s)\{\{IMG\|(?:[^|]*/)?([^|/]+)\|图注: (.*?)\}\}", "![[$1]]  \n$2")


def embeds(text: Column) -> Column:
    """What stands in ![[...]]."""
    return found(text, r"!\[\[([^\]]+)\]\]", 1)


def utc_fault(value: Column) -> Column:
    """Why a value is no UTC time stamp in ISO 8601: missing, malformed or not_utc; null if it is one."""
    shape = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$") & F.try_to_timestamp(F.substring(value, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    return F.when(value.isNull() | (value == ""), "missing").when(~shape, "malformed").when(~value.rlike(r"(Z|[+-]00:00)$"), "not_utc")


def caption_line(lines: Column, at: Column, reach: int = 5) -> Column:
    """The first figure caption among the ``reach`` lines after line ``at`` (from 1); null without one."""
    near = F.slice(lines, at + 1, reach)
    return F.try_element_at(F.filter(near, lambda x: x.rlike(r"^\s*(?:图|Figure|Fig\.?)\s*\d+")), F.lit(1))

"""Lexical functions as column expressions, all evaluated by Spark's built-ins.

Null inputs count as empty texts unless said otherwise. White space is ASCII white space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic. Fixed values.
STOPWORDS = """a an the and or but if then else of for to in on at by with from as is
are was were be been being it its this that these those there here i you
he she they we us our your their his her hers not no nor so too very can
will just should now do does did doing have has had having than s t don t
re ve ll m d o y ain aren couldn didn doesn hadn hasn haven isn ma mightn
mustn needn shan shouldn wasn weren won wouldn also into about over under
between during without within upon whether while because however therefore
thus hence among across per via vs etc eg ie both each few more most other
some such only own same when where why how all any both what which who whom
let get got go goes going make made use used using one two three first
second new like well may might must shall would could""".split()

#: Words that open no entity. Fixed values.
ENTITY_STOP = """The This That These Those We Our It Its Figure Table Section Chapter Note Source However
When Where While Because Their There Then Thus First Second Next Finally Such Some Each Every""".split()
#: Capitals that name nothing, and references that point nowhere. Fixed values.
ACRONYM_STOP = ["II", "III", "IV", "OK", "ID"]
REF_STOP = ["below", "above", "next", "figure"]

#: Patterns whose results must agree wherever they are used. Fixed values.
TOKEN = r"[a-z][a-z0-9]*|\d+(?:,\d{3})*(?:\.\d+)?"
SENTENCE_GAP = r"""(?<=[.!?])\s+(?=[A-Z0-9"'(])"""
PHRASE = r"\b([A-Z][a-zA-Z0-9]*(?:\s+(?:of|de|for|and|in)?\s*[A-Z][a-zA-Z0-9]*)+)\b"
ACRONYM = r"\b[A-Z]{2,6}\b"
LINK = r"\[([^\]]{3,60})\]\(([^)\s]+)\)"
SEE = r"(?i)(?:see|cf\.?|ref(?:er)?\.?|discussed in)\s+(?:the\s+)?(?:section\s+|chapter\s+|figure\s+|table\s+|doc(?:ument)?\s+)?([A-Za-z0-9][\w \-:/]{2,48})"
CLAIM = r"([A-Za-z][A-Za-z0-9-]{2,})[^.\n]{0,60}?(\d[\d,]*(?:\.\d+)?)"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
TAG = r"\[S(\d+)\]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once; a bare expression inside a lambda would be evaluated for every element."""
    return F.transform(F.array(value), use)[0]


def text_of(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def tokenize(col: Column) -> Column:
    """Lower-case word and number tokens, without stop words and single characters; repeats and order stay."""
    found = F.regexp_extract_all(F.lower(text_of(col)), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))


def token_set(col: Column) -> Column:
    return F.array_distinct(tokenize(col))


def sentence_split(col: Column) -> Column:
    """Sentences: cut at white space behind . ! ? in front of a capital, digit, quote or bracket."""
    parts = F.split(strip(text_of(col)), SENTENCE_GAP)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by an underscore."""
    return let(tokens, lambda t: F.when(F.size(t) >= 2, F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))).otherwise(F.array().cast("array<string>")))


def lexical_overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Shared tokens over sqrt(query tokens) + 1, at most 1; both are distinct arrays; 0 for an empty query."""
    shared = F.size(F.array_intersect(query_tokens, text_tokens))
    return F.when(F.size(query_tokens) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), shared / (F.sqrt(F.size(query_tokens).cast("double")) + 1)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared over the smaller of two distinct arrays."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def slugify(col: Column, most: int = 60) -> Column:
    """Lower-case letters and digits joined by "-", at most `most` characters; "x" where nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text_of(col)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(slug, 1, most), "-+$", ""), F.lit("")), F.lit("x"))


def truncate(col: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where something was cut."""
    whole = strip(text_of(col))
    return F.when(F.length(whole) <= n, whole).otherwise(F.concat(F.regexp_replace(F.substring(whole, 1, n - 1), r"\s+$", ""), F.lit("…")))


def extract_entities(col: Column, most: int = 8) -> Column:
    """Capitalised phrases, then acronyms, then capitalised link labels; distinct, the first `most`."""
    text = text_of(col)
    phrases = F.transform(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(1)), strip)
    phrases = F.filter(phrases, lambda p: ~F.split(p, " ")[0].isin(ENTITY_STOP))
    acronyms = F.filter(F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(0)), lambda a: ~a.isin(ACRONYM_STOP))
    labels = F.filter(F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), strip), lambda x: x.rlike("^[A-Z]"))
    return F.slice(F.array_distinct(F.concat(phrases, acronyms, labels)), 1, most)


def extract_refs(col: Column, most: int = 6) -> Column:
    """What a text refers to: names behind "see", "cf." and the like, and anchors of links; distinct, the first `most`."""
    text = text_of(col)
    names = F.transform(F.regexp_extract_all(text, F.lit(SEE), F.lit(1)), lambda r: F.regexp_replace(r, "^[ .,;:]+|[ .,;:]+$", ""))
    names = F.filter(names, lambda r: (r != "") & ~F.lower(r).isin(REF_STOP))
    targets = F.filter(F.regexp_extract_all(text, F.lit(LINK), F.lit(2)), lambda t: F.startswith(t, F.lit("#")))
    anchors = F.filter(F.transform(targets, lambda t: F.regexp_replace(F.substring(t, 2, 1000), "-", " ")), lambda t: t != "")
    return F.slice(F.array_distinct(F.concat(names, anchors)), 1, most)


def word_count(col: Column) -> Column:
    return F.size(F.filter(F.split(text_of(col), r"\s+"), lambda w: w != ""))


def token_estimate(col: Column) -> Column:
    return (F.floor(word_count(col) * 1.3) + 1).cast("int")


def claims(col: Column) -> Column:
    """array<struct<key, value>>: a word and the number that follows it within its sentence, in order of the text."""
    text = text_of(col)
    keys, values = F.regexp_extract_all(text, F.lit(CLAIM), F.lit(1)), F.regexp_extract_all(text, F.lit(CLAIM), F.lit(2))
    return F.zip_with(keys, values, lambda k, v: F.struct(F.lower(k).alias("key"), F.regexp_replace(v, ",", "").cast("double").alias("value")))


def claim_map(col: Column) -> Column:
    """Claims by key, the last of each key: earlier ones are dropped, so no duplicate key reaches the map."""
    return let(
        claims(col),
        lambda all_: F.map_from_entries(F.filter(all_, lambda c, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == c["key"]))),
    )


def split_row(col: Column) -> Column:
    """The cells of a table row written with bars."""
    return F.transform(F.split(F.regexp_replace(strip(col), r"^\|+|\|+$", ""), r"\|"), strip)


def table_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def embed_text(title: Column, path: Column, text: Column) -> Column:
    return F.concat(F.array_join(F.filter(F.concat(F.array(title), path), lambda p: p.isNotNull() & (p != "")), " › "), F.lit(". "), text_of(text))


def extract_tags(answer: Column, fired: Column) -> Column:
    """Distinct citation tags with a number from 1 to the number of sources."""
    numbers = F.transform(F.regexp_extract_all(text_of(answer), F.lit(TAG), F.lit(1)), lambda n: n.try_cast("int"))
    return F.transform(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= fired))), lambda n: F.concat(F.lit("S"), n.cast("string")))


def context_block(tag: Column, title: Column, section: Column, text: Column) -> Column:
    return F.concat(F.lit("["), tag, F.lit("] "), title, F.lit(" › "), section, F.lit("\n"), text)


def source_kind(path: Column, head: Column) -> Column:
    """What a source is read as: by its name's extension, else by its first characters."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    start = F.lower(F.substring(text_of(head), 1, 512))
    return (
        F.when(ext.isin("md", "markdown"), "markdown")
        .when(ext.isin("txt", "text", "log"), "text")
        .when(ext == "csv", "csv")
        .when(ext == "json", "json")
        .when(ext == "pdf", "pdf")
        .when(ext.isin("html", "htm"), "html")
        .when(start.contains("<!doctype html") | start.contains("<html"), "html")
        .when(F.startswith(F.ltrim(start), F.lit("%pdf")), "pdf")
        .otherwise("text")
    )

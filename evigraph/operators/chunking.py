"""Sections and chunks: from plain texts or parsed blocks to addressable chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import hashing
from evigraph.functions import text as T

#: A line that opens a section by its number or word. Fixed value.
NUMBERED = r"^(?:(?:chapter|section|part|appendix)\s+[\dIVXivx]+\b.*|\d+(?:\.\d+)*\.?\s+\S.*)$"


def is_heading(line: Column) -> Column:
    """Short lines in capitals or with a section number."""
    return (F.length(line) <= 80) & (((line == F.upper(line)) & (line != F.lower(line))) | line.rlike(NUMBERED))


def text_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, path, level, text): the paragraphs of plain texts under their headings, in order.

    path has the last heading of level 1 (capitals) and the last of level 2 (numbered) behind it. Everything happens
    within a row by higher-order functions: the lines of a text never shuffle, so a long text or a hot key costs no task
    more than its own row. Null and blank texts have no blocks.
    """
    lines = F.transform(F.split(T.text_of(F.col(text)), r"\r\n|\n|\r"), T.strip)
    zero = F.struct(F.lit("").alias("one"), F.lit("").alias("two"), F.array().cast("array<string>").alias("para"), F.array().cast("array<struct<one:string,two:string,text:string>>").alias("out"))

    def flush(s: Column) -> Column:
        joined = F.array_join(s["para"], " ")
        return F.when(F.size(s["para"]) > 0, F.concat(s["out"], F.array(F.struct(s["one"].alias("one"), s["two"].alias("two"), joined.alias("text"))))).otherwise(s["out"])

    def step(s: Column, line: Column) -> Column:
        none = F.array().cast("array<string>")
        title = F.regexp_replace(line, r"\.+$", "")
        numbered = line.rlike(NUMBERED)
        head = is_heading(line)
        return F.struct(
            F.when(head & ~numbered, title).otherwise(s["one"]).alias("one"),
            F.when(head, F.when(numbered, title).otherwise("")).otherwise(s["two"]).alias("two"),
            F.when((line == "") | head, none).otherwise(F.concat(s["para"], F.array(line))).alias("para"),
            F.when((line == "") | head, flush(s)).otherwise(s["out"]).alias("out"),
        )

    blocks = df.select(key, F.aggregate(F.concat(lines, F.array(F.lit(""))), zero, step, lambda s: s["out"]).alias("_b"))
    path = F.filter(F.array("b.one", "b.two"), lambda t: t != "")
    return blocks.select(key, F.posexplode("_b").alias("block", "b")).select(key, "block", path.alias("path"), F.size(path).alias("level"), F.col("b.text").alias("text"))


def sentence_windows(text: Column, most: Column, overlap: Column) -> Column:
    """Sentences packed greedily into windows of `most` characters, each opening with the last `overlap` of the one before.

    A sentence longer than a window stays whole; separators aren't counted until a window carries sentences over, as the
    sizes are defined. A text without sentences gives its first `most` characters, an empty one nothing.
    """
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("windows"), none.alias("cur"), F.lit(0).alias("size"))

    def step(s: Column, x: Column) -> Column:
        full = (F.size(s["cur"]) > 0) & (s["size"] + F.length(x) > most)
        tail = F.when(overlap > 0, F.slice(s["cur"], F.greatest(F.size(s["cur"]) - overlap + 1, F.lit(1)), F.greatest(overlap, F.lit(1)))).otherwise(none)
        cur = F.when(full, F.concat(tail, F.array(x))).otherwise(F.concat(s["cur"], F.array(x)))
        size = F.when(full, F.aggregate(F.concat(tail, F.array(x)), F.lit(0), lambda n, y: n + F.length(y) + 1)).otherwise(s["size"] + F.length(x))
        return F.struct(F.when(full, F.concat(s["windows"], F.array(F.array_join(s["cur"], " ")))).otherwise(s["windows"]).alias("windows"), cur.alias("cur"), size.alias("size"))

    def finish(s: Column) -> Column:
        return F.when(F.size(s["cur"]) > 0, F.concat(s["windows"], F.array(F.array_join(s["cur"], " ")))).otherwise(s["windows"])

    packed = F.aggregate(T.sentence_split(text), zero, step, finish)
    whole = T.text_of(text)
    return F.when(F.size(packed) > 0, packed).when(whole != "", F.array(F.substring(whole, F.lit(1), most))).otherwise(none)


def chunk_blocks(blocks: DataFrame, titles: str = "title", most: int = 1000, overlap: int = 1, hash_kind: str = "md5") -> DataFrame:
    """Chunks (id, doc_id, doc_title, section_path, section_title, text, kind, token_estimate, entities, refs, hub, chunk_order, content_hash).

    `blocks` has (doc_id, title, block, path, kind, text), `block` counting within a document. Tables stay whole up to
    twice `most`, lists and code up to one and a half, texts up to `most`; what is longer is packed by sentences, with
    `overlap` for texts only. Blank pieces are left out. Numbering a document's chunks is the only shuffle, by document.
    """
    size = F.length("text")
    limit = F.when(F.col("kind") == "table", 2.0 * most).when(F.col("kind").isin("list", "code"), 1.5 * most).otherwise(1.0 * most)
    carry = F.when(F.col("kind").isin("table", "list", "code"), 0).otherwise(overlap)
    windows = F.when(size <= limit, F.array("text")).otherwise(sentence_windows(F.col("text"), F.lit(most), carry))
    rows = blocks.where(F.col("text").isNotNull()).select("doc_id", F.col(titles).alias("doc_title"), "block", "path", "kind", F.posexplode(windows).alias("window", "raw"))
    rows = rows.withColumn("text", T.strip(F.col("raw"))).where(F.col("text") != "")
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "window")) - 1).cast("int")
    rows = rows.withColumn("chunk_order", number)
    return rows.select(
        F.concat(F.lit("chunk:"), F.col("doc_id").cast("string"), F.lit(":"), F.format_string("%04d", "chunk_order")).alias("id"),
        "doc_id", "doc_title", F.col("path").alias("section_path"),
        F.coalesce(F.try_element_at("path", F.lit(-1)), F.col("doc_title")).alias("section_title"),
        "text", "kind", T.token_estimate(F.col("text")).alias("token_estimate"),
        T.extract_entities(F.col("text")).alias("entities"), T.extract_refs(F.col("text")).alias("refs"),
        F.lit("").alias("hub"), "chunk_order", hashing.content_hash(F.col("text"), hash_kind).alias("content_hash"),
    )

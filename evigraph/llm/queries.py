"""The queries of the training-data problems over the tables of a data folder, each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import boilerplate, bpe, cooccur, distinctive, markup, neardup, neighbours, packing, splitting, subjects
from evigraph.llm.tables import chunk_kind, once, web_pages
from evigraph.runtime import cut, table


def web_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of web pages, rows as they come."""
    chunks = table(spark, d, "chunks").select("id", "doc_id", "text", "section_path", "entities")
    return chunks.join(web_pages(spark, d).select("doc_id"), "doc_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.find_boilerplate(once(web_chunks(spark, d)), "id", "doc_id", "text", "section_path", "entities")


def p1_content(spark: SparkSession, d: str) -> DataFrame:
    """(id, text) of the chunks of web pages with their content lines only."""
    return boilerplate.keep_content(once(web_chunks(spark, d)), p1_found(spark, d), "id", "text")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk once, those beyond the limit of their kind as several pieces, numbered on within their document."""
    limits = F.broadcast(table(spark, d, "size_limits"))  # a fixed table of one row per kind
    chunks = once(table(spark, d, "chunks").select("id", "doc_id", chunk_kind(F.col("kind")).alias("kind"), "section_path", "chunk_order", "text"))
    pieces = splitting.split_oversized(chunks.join(limits, "kind", "left"), "id", "text", "max_chars", "overlap_sentences", "chunk_order")
    numbered = splitting.renumbered(cut(pieces), "id", "doc_id", "chunk_order")
    return numbered.select("id", "doc_id", "kind", "piece", "n_pieces", "section_path", "chunk_order", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    limits = F.broadcast(table(spark, d, "size_limits"))
    chunks = table(spark, d, "chunks").select("id", chunk_kind(F.col("kind")).alias("kind"), "chunk_order", "text")
    pieces = splitting.split_oversized(chunks.join(limits, "kind", "left"), "id", "text", "max_chars", "overlap_sentences", "chunk_order")
    return pieces.where(F.col("n_pieces") > 1).select("id").distinct()


def p3_terms(spark: SparkSession, d: str, least: int = 1, few: int = 1, many: int | None = None) -> DataFrame:
    """(id, field, term, score) of the words and entities of each chunk."""
    chunks = table(spark, d, "chunks").select("id", "text", cooccur.entity_set(F.col("entities")).alias("entities"))
    words = distinctive.text_terms(once(chunks.select("id", "text")), "id", "text", least, few, many)
    names = distinctive.value_terms(once(chunks.select("id", "entities")), "id", "entities", few, many)
    both = words.select("id", F.lit("text").alias("field"), "term", "score").union(names.select("id", F.lit("entity").alias("field"), "term", "score"))
    return both.withColumn("score", F.round("score", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d, least=3, few=2, many=8).select("id", "field", "term")


def p4_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Links and members among text chunks that aren't of a web page.

    Pages are taken out of the members, by the document, when texts have become small rows.
    """
    chunks = table(spark, d, "chunks").where(chunk_kind(F.col("kind")) == "text")
    links, members = neardup.near_duplicates(chunks, "id", "text", words=3, similarity=0.6, least=30, kept=("doc_id",))
    return links, members.join(web_pages(spark, d).select("doc_id"), "doc_id", "left_anti")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.record_pairs(*p4_parts(spark, d), "id")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """(id, group, n_links) of every such chunk, in the form for large groups."""
    links, members = p4_parts(spark, d)
    own = members.select("class").distinct()
    links = links.join(own.withColumnRenamed("class", "class_a"), "class_a", "left_semi").join(own.withColumnRenamed("class", "class_b"), "class_b", "left_semi")
    return neardup.groups(links, members.select("id", "class"), "id")


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.most_similar(table(spark, d, "vectors"), "id", "embedding", 5, 64)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p5_neighbours(spark, d).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
    return pairs.distinct()


def p6_together(spark: SparkSession, d: str, least: int = 1) -> DataFrame:
    chunks = table(spark, d, "chunks").select("id", cooccur.entity_set(F.col("entities")).alias("entities")).where(F.size("entities") > 0)
    return cooccur.together(once(chunks), "entities", least)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p6_together(spark, d, 10).where(F.col("n_ab") * F.col("n") >= 5 * F.col("n_a") * F.col("n_b"))
    return pairs.select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").where(chunk_kind(F.col("kind")) != "code")
    return markup.markup_left(chunks, "id", "text").distinct()


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """(id, text, structure) of every chunk; code stays as it is."""
    chunks = table(spark, d, "chunks").select("id", "doc_id", "text", chunk_kind(F.col("kind")).alias("kind"))
    rows = once(chunks).join(web_pages(spark, d), "doc_id", "left")
    cleaned = markup.clean(rows.where(F.col("kind") != "code"), "id", "text", "host", "doc_id")
    code = rows.where(F.col("kind") == "code").select("id", "text", F.array().cast("array<struct<line:int,type:string>>").alias("structure"))
    return cleaned.unionByName(code)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, part, size, container) of every document with tokens."""
    sizes = bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text", only_count=True)
    return packing.pack(sizes, "doc_id", "n_tokens")


def p10_subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """(subject, n_documents): the make-up of the corpus."""
    return p10_subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_content": p1_content, "p7_found": p7_found, "p7_clean": p7_clean,
        "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_terms": p3_terms, "p4_found": p4_found, "p4_groups": p4_groups,
        "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p6_found": p6_found, "p6_together": p6_together, "p8_ids": p8_ids, "p9_containers": p9_containers,
        "p10_found": p10_found, "p10_composition": p10_composition,
    }


_ENTITY = r"trim(regexp_replace(lower(e), '[\s\-_]+', ' ', 'g'))"
_ENTITIES = f"""e AS (SELECT DISTINCT id, {_ENTITY} AS e FROM (SELECT id, unnest(entities) AS e FROM chunks WHERE id IS NOT NULL) WHERE e IS NOT NULL AND {_ENTITY} <> '')"""
_CHUNKS = "c AS (SELECT DISTINCT ON (id) id, text FROM chunks WHERE id IS NOT NULL)"
_KIND = "coalesce(lower(trim(kind)), 'text')"
_WEB = "(SELECT doc_id FROM parsed_documents WHERE doc_id IS NOT NULL AND regexp_matches(lower(ltrim(source)), '^https?://'))"
#: DuckDB SQL of the queries whose rows SQL can state; blanks at the ends are blanks, tabs and line ends.
SQL = {
    "p2_found": f"SELECT DISTINCT id FROM (SELECT id, text, {_KIND} AS kind FROM chunks) c JOIN size_limits USING (kind) WHERE length(trim(text, chr(9) || chr(10) || chr(13) || ' ')) > max_chars",
    "p3_found": f"""WITH {_CHUNKS}, {_ENTITIES}, w AS (SELECT id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}'))) AS term FROM c), t AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL),
        d AS (SELECT term FROM t GROUP BY term HAVING count(*) BETWEEN 2 AND 8), f AS (SELECT e FROM e GROUP BY e HAVING count(*) BETWEEN 2 AND 8)
        SELECT id, 'text' AS field, term FROM t JOIN d USING (term) WHERE tf >= 3 UNION ALL SELECT id, 'entity', e FROM e JOIN f USING (e)""",
    "p3_terms": f"""WITH {_CHUNKS}, {_ENTITIES}, t AS (SELECT id, regexp_extract_all(text, '[A-Za-z]{{4,}}') AS t FROM c), w AS (SELECT id, generate_subscripts(t, 1) AS i, lower(unnest(t)) AS term FROM t),
        g AS (SELECT a.id, a.term, count(DISTINCT b.term) FILTER (b.term <> a.term) AS degree FROM w a JOIN w b ON a.id = b.id AND b.i BETWEEN a.i - 3 AND a.i + 3 GROUP BY 1, 2), d AS (SELECT term, count(*) AS n FROM g GROUP BY term), m AS (SELECT count(*) AS n FROM c),
        s AS (SELECT id, count(*) - 1 AS degree FROM e GROUP BY id), f AS (SELECT e, count(*) AS n FROM e GROUP BY e)
        SELECT id, 'text' AS field, term, round(degree * ln((SELECT n FROM m) / d.n), 6) AS score FROM g JOIN d USING (term) UNION ALL SELECT id, 'entity', e, round(degree * ln((SELECT n FROM m) / f.n), 6) FROM e JOIN f USING (e) JOIN s USING (id)""",
    "p6_together": f"""WITH {_ENTITIES}, n AS (SELECT e, count(*) AS n FROM e GROUP BY e), m AS (SELECT count(DISTINCT id) AS n FROM e), p AS (SELECT a.e AS item_a, b.e AS item_b, count(*) AS n_ab FROM e a JOIN e b ON a.id = b.id AND a.e < b.e GROUP BY 1, 2)
        SELECT item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, m.n, n_ab * m.n / (x.n::DOUBLE * y.n) AS lift, CASE WHEN n_ab < x.n THEN (1 - y.n / m.n) / (1 - n_ab / x.n) END AS conviction FROM p JOIN n x ON x.e = item_a JOIN n y ON y.e = item_b, m""",
    "p4_found": f"""WITH c AS (SELECT DISTINCT ON (id) id, text FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL AND {_KIND} = 'text' AND doc_id NOT IN {_WEB}),
        t AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM c), s AS (SELECT id, unnest(list_distinct(list_transform(list_zip(t[:-3], t[2:-2], t[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3]))) AS s FROM t WHERE len(t) >= 3),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id HAVING count(*) >= 30), p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE shared / (x.n + y.n - shared) >= 0.6""",
    "p6_found": f"""WITH {_ENTITIES}, n AS (SELECT e, count(*) AS n FROM e GROUP BY e), p AS (SELECT a.e AS entity_a, b.e AS entity_b, count(*) AS ab FROM e a JOIN e b ON a.id = b.id AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 10)
        SELECT entity_a, entity_b FROM p JOIN n x ON x.e = entity_a JOIN n y ON y.e = entity_b WHERE ab * (SELECT count(DISTINCT id) FROM e) >= 5 * x.n * y.n""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

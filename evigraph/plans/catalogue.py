"""Queries of the core over the driver's tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.config import Settings
from evigraph.functions import gate, hashing
from evigraph.functions import text as T
from evigraph.operators import chunking, embedding, graph, retrieval, stats, vectors
from evigraph.plans import oracle as O
from evigraph.runtime import cut, table
from evigraph.sources import web
from evigraph.sources.parse import parse_files
from evigraph.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Questions that the query stages are shown with.
QUESTIONS = [
    ("q1", "How does the motion detector shape the receptive field?"),
    ("q2", "Which retriever splits the query embedding?"),
    ("q3", "What does the worker pool do under load?"),
    ("q4", "quantum chess openings in zero gravity"),
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table, a row for each id."""
    rows = table(spark, d, "chunks").where(F.col("id").isNotNull()).dropDuplicates(["id"])
    return graph.known(rows)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id string, query string")


# ── lexical functions ──────────────────────────────────────────────────────


@query("tokenize_docs", f"SELECT doc_id, array_to_string({O.tokens('text')}, ' ') AS tokens FROM documents")
def tokenize_docs(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


@query("token_set_docs", f"SELECT doc_id, len(list_distinct({O.tokens('text')}))::INT AS n, array_to_string(list_sort(list_distinct({O.tokens('text')})), ' ') AS tokens FROM documents")
def token_set_docs(spark, d):
    return docs(spark, d).select("doc_id", T.let(T.token_set(F.col("text")), lambda t: F.struct(F.size(t).alias("n"), F.array_join(F.array_sort(t), " ").alias("tokens"))).alias("x")).select("doc_id", "x.n", "x.tokens")


@query("sentence_split_docs", f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS idx, unnest(s) AS sentence FROM (SELECT doc_id, {O.sentences('text')} AS s FROM documents)")
def sentence_split_docs(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.sentence_split(F.col("text"))).alias("idx", "sentence"))


@query("slugify_text", f"SELECT doc_id, {O.slug('title', 60)} AS slug FROM documents")
def slugify_text(spark, d):
    return docs(spark, d).select("doc_id", T.slugify(F.col("title")).alias("slug"))


@query("truncate_text", f"SELECT doc_id, {O.truncated('text', 56)} AS label FROM documents")
def truncate_text(spark, d):
    return docs(spark, d).select("doc_id", T.truncate(F.col("text"), 56).alias("label"))


@query("token_estimate", f"SELECT doc_id, (floor(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) * 1.3) + 1)::INT AS token_estimate FROM documents")
def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("token_estimate"))


@query(
    "lexical_overlap_topk",
    f"""WITH q AS ({O.questions(QUESTIONS)}), qt AS (SELECT query_id, list_distinct({O.tokens('query')}) AS q FROM q),
    t AS (SELECT doc_id, list_distinct({O.tokens('text')}) AS t FROM documents),
    s AS (SELECT query_id, doc_id, round(least(1.0, len(list_intersect(q, t)) / (sqrt(len(q)) + 1)), 6) AS score FROM qt, t WHERE len(list_intersect(q, t)) > 0)
    SELECT query_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20""",
)
def lexical_overlap_topk(spark, d):
    """The 20 documents of highest overlap with each of a few questions."""
    asked = F.broadcast(questions(spark).select("query_id", T.token_set(F.col("query")).alias("q")))  # the questions above
    scored = docs(spark, d).select("doc_id", T.token_set(F.col("text")).alias("t")).join(asked, F.arrays_overlap("q", "t"))
    scored = scored.select("query_id", "doc_id", F.round(T.lexical_overlap(F.col("q"), F.col("t")), 6).alias("score"))
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))).where("r <= 20").drop("r")


@query("doc_freq", f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({O.tokens('text')})) AS token FROM documents) GROUP BY token")
def doc_freq(spark, d):
    return embedding.document_frequency(docs(spark, d), "text")


@query("idf_table", f"WITH t AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({O.tokens('text')})) AS token FROM documents) GROUP BY token) SELECT token, round(ln(1 + (SELECT count(*) FROM documents) / (df + 0.5)), 6) AS idf FROM t")
def idf_table(spark, d):
    total = docs(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return embedding.document_frequency(docs(spark, d), "text").crossJoin(F.broadcast(total)).select("token", F.round(embedding.idf(F.col("df"), F.col("n")), 6).alias("idf"))  # one row


@query("tf_bigrams", f"WITH f AS (SELECT doc_id, {O.tokens('text')} AS t FROM documents) SELECT doc_id, feature, count(*) AS tf FROM (SELECT doc_id, unnest({O.features('t')}) AS feature FROM f) GROUP BY ALL")
def tf_bigrams(spark, d):
    return embedding.feature_counts(docs(spark, d), "doc_id", "text")


@query("entities_docs", f"SELECT doc_id, array_to_string({O.entities("coalesce(text, '')")}, '|') AS entities FROM documents")
def entities_docs(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.extract_entities(T.text_of(F.col("text"))), "|").alias("entities"))


@query("refs_docs", f"SELECT doc_id, array_to_string({O.refs("coalesce(text, '')")}, '|') AS refs FROM documents")
def refs_docs(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.extract_refs(T.text_of(F.col("text"))), "|").alias("refs"))


@query("numeric_claims", f"SELECT doc_id, (generate_subscripts(k, 1) - 1)::INT AS idx, lower(unnest(k)) AS key, replace(unnest(v), ',', '')::DOUBLE AS value FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {O.q(T.CLAIM)}, 1) AS k, regexp_extract_all(coalesce(text, ''), {O.q(T.CLAIM)}, 2) AS v FROM documents)")
def numeric_claims(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.claims(F.col("text"))).alias("idx", "c")).select("doc_id", "idx", "c.key", "c.value")


@query("table_rows", "SELECT id, (generate_subscripts(l, 1) - 1)::INT AS line, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g'), '^\\|+|\\|+$', '', 'g'), '|'), lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), ' | ') AS cells FROM (SELECT DISTINCT ON (id) id, string_split(text, chr(10)) AS l FROM chunks WHERE lower(trim(kind)) = 'table' AND text IS NOT NULL)")
def table_rows(spark, d):
    """The cells of the lines of table chunks, joined again."""
    rows = chunks(spark, d).where(F.lower(F.btrim("kind")) == "table").where(F.col("text") != "")
    return rows.select("id", F.posexplode(F.split("text", "\n")).alias("line", "row")).select("id", "line", T.table_text(F.array(T.split_row(F.col("row")))).alias("cells"))


@query("embed_text", "SELECT id, array_to_string(list_filter(list_concat([coalesce(doc_title, '')], list_filter(coalesce(section_path, []), lambda p: p IS NOT NULL)), lambda p: p <> ''), ' › ') || '. ' || coalesce(text, '') AS embed_text FROM (SELECT DISTINCT ON (id) * FROM chunks)")
def embed_text(spark, d):
    return chunks(spark, d).select("id", T.embed_text(F.col("doc_title"), F.col("section_path"), F.col("text")).alias("embed_text"))


@query("content_hashes", "SELECT id, substr(md5(coalesce(text, '')), 1, 16) AS content_hash FROM (SELECT DISTINCT ON (id) id, text FROM chunks)")
def content_hashes(spark, d):
    return chunks(spark, d).select("id", hashing.content_hash(F.col("text")).alias("content_hash"))


@query("duplicate_docs", "WITH h AS (SELECT doc_id, 'd' || substr(md5(coalesce(title, '') || '|' || substr(coalesce(text, ''), 1, 2000)), 1, 12) AS key FROM documents) SELECT key, min(doc_id) AS doc_id, count(*) AS n FROM h GROUP BY key")
def duplicate_docs(spark, d):
    """Documents by the id that ingest would give them; of each id the first is taken in."""
    keyed = docs(spark, d).select("doc_id", hashing.doc_id(F.col("title"), F.col("text")).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


# ── sources ────────────────────────────────────────────────────────────────


@query(
    "source_dispatch",
    """WITH s AS (SELECT DISTINCT source FROM parsed_documents WHERE source IS NOT NULL), e AS (SELECT source, lower(regexp_extract(source, '\\.([A-Za-z0-9]+)$', 1)) AS x FROM s)
    SELECT source, CASE WHEN x IN ('md', 'markdown') THEN 'markdown' WHEN x IN ('txt', 'text', 'log') THEN 'text' WHEN x = 'csv' THEN 'csv' WHEN x = 'json' THEN 'json' WHEN x = 'pdf' THEN 'pdf' WHEN x IN ('html', 'htm') THEN 'html' ELSE 'text' END AS kind FROM e""",
)
def source_dispatch(spark, d):
    sources = table(spark, d, "parsed_documents").select("source").where(F.col("source").isNotNull()).distinct()
    return sources.select("source", T.source_kind(F.col("source"), F.lit("")).alias("kind"))


@query("url_filter", "SELECT DISTINCT source FROM parsed_documents WHERE regexp_matches(lower(trim(source)), '^https?://[^/]')")
def url_filter(spark, d):
    return table(spark, d, "parsed_documents").where(web.fetchable(F.col("source"))).select("source").distinct()


@query("upload_filter", "SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents WHERE strlen(text) > 0 AND strlen(text) <= 15000000 AND trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''")
def upload_filter(spark, d):
    s = Settings()
    size = F.octet_length("text")
    return docs(spark, d).where((size > 0) & (size <= s.max_upload_bytes) & (T.strip(F.col("text")) != "")).select("doc_id", size.cast("long").alias("bytes"))


@query("parse_files")
def parse_every_file(spark, d):
    """Documents as files of several kinds, read by the parsers."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*(F.lit(x) for x in ("md", "txt", "csv", "json", "html"))), (F.col("doc_id") % 5 + 1).cast("int")))
    return parse_files(docs(spark, d).where(F.col("text").isNotNull()).select(name.alias("name"), F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("string").alias("url")))


@query("parse_text_sections", O.TEXT_BLOCKS)
def parse_text_sections(spark, d):
    blocks = chunking.text_blocks(docs(spark, d), "doc_id", "text")
    return blocks.select("doc_id", "block", F.array_join("path", " › ").alias("path"), "text")


@query("flatten_docs", O.FLATTENED)
def flatten_docs(spark, d):
    """Each document's blocks joined again in order."""
    blocks = chunking.text_blocks(docs(spark, d), "doc_id", "text")
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n").alias("flat"), F.count(F.lit(1)).alias("blocks"))


# ── chunks and embeddings ──────────────────────────────────────────────────


@query("chunk_windows", O.WINDOWS)
def chunk_windows(spark, d):
    windows = chunking.sentence_windows(F.col("text"), F.lit(300), F.lit(1))
    return docs(spark, d).select("doc_id", F.posexplode(windows).alias("w", "text"))


@query("chunk_documents")
def chunk_documents(spark, d):
    """Documents to chunks with entities, references and hashes."""
    from evigraph.plans.engine import chunk_texts

    return chunk_texts(docs(spark, d).where(F.col("text").isNotNull()), "doc_id", "text", "title", Settings())


@query("chunk_order", "SELECT id, doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(chunk_order, 0), id) - 1)::INT AS n FROM (SELECT DISTINCT ON (id) * FROM chunks) WHERE doc_id IS NOT NULL")
def chunk_order(spark, d):
    order = Window.partitionBy("doc_id").orderBy("chunk_order", "id")
    return chunks(spark, d).select("id", "doc_id", (F.row_number().over(order) - 1).cast("int").alias("n"))


@query("hash_embed_md5", O.EMBEDDED)
def hash_embed_md5(spark, d):
    return embedding.bucket_weights(docs(spark, d), "doc_id", "text", 512).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("hash_embed_blake2b")
def hash_embed_blake2b(spark, d):
    return embedding.embed(docs(spark, d), "doc_id", "text", 512, "blake2b")


@query("embed_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings")
def embed_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(embedding.norm(F.col("embedding")), 5).alias("norm"))


@query("vector_topk", "WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]), 5) AS score FROM q, embeddings) SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 24")
def vector_topk(spark, d):
    """The queries are the vectors with an id divisible by 100, held against all."""
    rows = table(spark, d, "embeddings")
    asked = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.top_k(rows, asked, 24, key="vec_id").select("query_id", "vec_id", F.round("score", 5).alias("score"))


@query(
    "vector_relates_top2",
    """WITH p AS (SELECT a.vec_id AS k, b.vec_id AS o, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
    t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, o) <= 2)
    SELECT least(k, o) AS u, greatest(k, o) AS v, round(max(s), 5) AS weight FROM t WHERE s >= 0.32 GROUP BY ALL""",
)
def vector_relates_top2(spark, d):
    return vectors.relates(table(spark, d, "embeddings"), "label", 0.32, key="vec_id").select("u", "v", F.round("weight", 5).alias("weight"))


@query("vector_upsert", "WITH n AS (SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 3 = 0) SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT vec_id, label FROM n")
def vector_upsert(spark, d):
    old = table(spark, d, "embeddings").select("vec_id", "label")
    return vectors.upsert(old, old.where(F.col("vec_id") % 3 == 0).select("vec_id", (F.col("label") + 100).alias("label")), "vec_id")


@query("vector_delete", "SELECT vec_id, label FROM embeddings WHERE label IS DISTINCT FROM 3")
def vector_delete(spark, d):
    return vectors.remove(table(spark, d, "embeddings").select("vec_id", "label"), 3, "label")


@query("vector_reembed", f"WITH {O.CHUNKS} SELECT c.id, len(v.embedding) <> 64 OR v.embedding IS NULL AS stale, 64 AS dim, 1.0 AS norm FROM c JOIN (SELECT DISTINCT ON (id) id, embedding FROM vectors WHERE id IS NOT NULL) v USING (id)")
def vector_reembed(spark, d):
    """The vector table brought to one kind and length: those of other lengths are made anew from their chunks."""
    held = table(spark, d, "vectors").where(F.col("id").isNotNull()).dropDuplicates(["id"])
    of = chunks(spark, d)
    old = held.join(of.select("id", "doc_id"), "id").withColumn("embed_kind", F.lit("md5"))
    stale = old.select("id", F.coalesce(F.size("embedding") != 64, F.lit(True)).alias("stale"))
    made = embedding.reembed(of, old, 64, "md5").join(stale, "id")
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x))
    return made.select("id", "stale", F.size("embedding").alias("dim"), F.when(F.col("stale"), F.round(norm, 5)).otherwise(1.0).alias("norm"))


@query("vector_store_scan", "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM vectors WHERE embedding IS NOT NULL")
def vector_store_scan(spark, d):
    return table(spark, d, "vectors").where(F.col("embedding").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("hit_join", "SELECT h.query_id, h.id, c.doc_id, h.hit_no FROM (SELECT DISTINCT query_id, id, hit_no FROM search_hits) h JOIN (SELECT DISTINCT id, doc_id FROM chunks) c USING (id) WHERE h.id IS NOT NULL")
def hit_join(spark, d):
    hits = table(spark, d, "search_hits").select("query_id", "id", "hit_no").distinct()
    return hits.join(table(spark, d, "chunks").select("id", "doc_id").distinct(), "id").select("query_id", "id", "doc_id", "hit_no")


@query("recovered_candidates", "WITH a AS (SELECT DISTINCT query_id, id FROM search_hits WHERE hit_no <= 3), b AS (SELECT DISTINCT query_id, id FROM search_hits WHERE hit_no > 3) SELECT query_id, id FROM b EXCEPT SELECT query_id, id FROM a")
def recovered_candidates(spark, d):
    """What a second search adds to the first."""
    hits = table(spark, d, "search_hits").where(F.col("query_id").isNotNull() & F.col("id").isNotNull())
    first = hits.where("hit_no <= 3").select("query_id", "id").distinct()
    return hits.where("hit_no > 3").select("query_id", "id").distinct().join(first, ["query_id", "id"], "left_anti")


# ── graph ──────────────────────────────────────────────────────────────────


def fine_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    rows = table(spark, d, "vectors").where((F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return rows.select("id", "embedding").dropDuplicates(["id"])


def whole_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = chunks(spark, d)
    return cut(graph.build_nodes(rows)), cut(graph.build_edges(rows, fine_vectors(spark, d)))


@query("section_chain", f"WITH {O.CHUNKS},{O.CHAIN} SELECT id, depth::INT AS depth, node, parent FROM chain")
def section_chain(spark, d):
    return graph.section_chain(chunks(spark, d)).select("id", "depth", "node", "parent")


@query("section_counts", f"WITH {O.CHUNKS},{O.CHAIN} SELECT doc_id, count(DISTINCT array_to_string(path, chr(1))) AS sections FROM chain GROUP BY doc_id")
def section_counts(spark, d):
    return graph.section_chain(chunks(spark, d)).groupBy("doc_id").agg(F.countDistinct(F.array_join("path", "\x01")).alias("sections"))


@query("graph_nodes", f"WITH {O.CHUNKS},{O.CHAIN},{O.NODES} SELECT id, type, label, doc_id, section FROM nodes")
def graph_nodes(spark, d):
    return graph.build_nodes(chunks(spark, d)).select("id", "type", "label", "doc_id", "section")


@query("reference_resolution", f"WITH {O.CHUNKS},{O.REFERENCES} SELECT u, v FROM referenced")
def reference_resolution(spark, d):
    return graph.references(chunks(spark, d)).select("u", "v")


@query("graph_edges", f"WITH {O.GRAPH} SELECT u, v, kind, round(weight, 5) AS weight FROM edges")
def graph_edges(spark, d):
    return graph.build_edges(chunks(spark, d), fine_vectors(spark, d)).select("u", "v", "kind", F.round("weight", 5).alias("weight"))


@query("degree", f"WITH {O.GRAPH} SELECT u AS id, count(*) AS degree FROM ends GROUP BY u")
def degree(spark, d):
    return graph.degrees(graph.build_edges(chunks(spark, d), fine_vectors(spark, d)))


@query("neighbors", f"WITH {O.GRAPH} SELECT u AS id, v AS neighbor, kind FROM ends WHERE u LIKE 'ent:%'")
def neighbors(spark, d):
    """What mentions each entity."""
    edges = graph.build_edges(chunks(spark, d), fine_vectors(spark, d))
    return graph.both_ways(edges).where(F.startswith("u", F.lit("ent:"))).select(F.col("u").alias("id"), F.col("v").alias("neighbor"), "kind")


@query("graph_counts", f"WITH {O.GRAPH} SELECT count(*) AS nodes, count(*) FILTER (type = 'doc') AS documents, count(*) FILTER (type = 'section') AS sections, count(*) FILTER (type = 'chunk') AS chunks, count(*) FILTER (type = 'entity') AS entities, count(*) FILTER (type = 'hub') AS hubs, count(*) FILTER (type = 'agent') AS agents, (SELECT count(*) FROM edges) AS edges FROM nodes")
def graph_counts(spark, d):
    return graph.counts(*whole_graph(spark, d))


@query(
    "edge_upsert",
    """WITH r AS (SELECT least(query_id, id) AS u, greatest(query_id, id) AS v, CASE WHEN hit_no <= 2 THEN 'NEAR' ELSE 'FAR' END AS kind, coalesce(CASE WHEN isfinite(score) THEN score END, 0.5) AS weight, hit_no AS seq FROM search_hits WHERE query_id <> id)
    SELECT u, v, arg_min(kind, seq) AS kind, round(max(weight), 6) AS weight FROM r GROUP BY u, v""",
)
def edge_upsert(spark, d):
    """Edges from the log of searches: the kind written first and the largest weight of each pair."""
    score = F.when((F.abs("score") < F.lit(float("inf"))) & ~F.isnan("score"), F.col("score"))
    raw = table(spark, d, "search_hits").where(F.col("query_id").isNotNull() & F.col("id").isNotNull()).select(F.col("query_id").alias("u"), F.col("id").alias("v"), F.when(F.col("hit_no") <= 2, "NEAR").otherwise("FAR").alias("kind"), F.coalesce(score, F.lit(0.5)).alias("weight"), F.col("hit_no").alias("_seq"))
    return graph.upsert_edges(raw).select("u", "v", "kind", F.round("weight", 6).alias("weight"))


@query("documents_inventory", f"WITH {O.GRAPH} SELECT n.doc_id, n.label AS title, count(*) FILTER (m.type = 'section') AS sections, count(*) FILTER (m.type = 'chunk') AS chunks FROM nodes n LEFT JOIN ends e ON e.u = n.id LEFT JOIN nodes m ON m.id = e.v WHERE n.type = 'doc' GROUP BY 1, 2")
def documents_inventory(spark, d):
    return graph.inventory(*whole_graph(spark, d))


@query("documents_inventory_whole", f"WITH {O.GRAPH} SELECT n.doc_id, n.label AS title, count(*) FILTER (m.type = 'section') AS sections, count(*) FILTER (m.type = 'chunk') AS chunks FROM nodes n LEFT JOIN nodes m ON m.doc_id = n.doc_id AND m.type IN ('section', 'chunk') WHERE n.type = 'doc' GROUP BY 1, 2")
def documents_inventory_whole(spark, d):
    return graph.inventory(*whole_graph(spark, d), direct=False)


_DRAWN = "deg AS (SELECT u AS id, count(*) AS degree FROM ends GROUP BY u), top AS (SELECT n.id FROM nodes n LEFT JOIN deg USING (id) WHERE type = 'chunk' ORDER BY coalesce(degree, 0) DESC, n.id LIMIT 180), drawn AS (SELECT id, type FROM nodes WHERE type IN ('doc', 'section') UNION ALL SELECT id, 'chunk' FROM top)"


@query("snapshot_nodes", f"WITH {O.GRAPH}, {_DRAWN} SELECT id, type FROM drawn")
def snapshot_nodes(spark, d):
    return graph.snapshot(*whole_graph(spark, d), types=["doc", "section", "chunk"])[0].select("id", "type")


@query("snapshot_edges", f"WITH {O.GRAPH}, {_DRAWN} SELECT u, v, kind, round(weight, 3) AS weight FROM edges WHERE u IN (SELECT id FROM drawn) AND v IN (SELECT id FROM drawn)")
def snapshot_edges(spark, d):
    return graph.snapshot(*whole_graph(spark, d), types=["doc", "section", "chunk"])[1]


@query(
    "delete_document_prune",
    f"""WITH {O.GRAPH}, gone AS (SELECT min(doc_id) AS doc_id FROM c), l AS (SELECT * FROM nodes WHERE doc_id IS DISTINCT FROM (SELECT doc_id FROM gone)),
    e AS (SELECT * FROM edges WHERE u IN (SELECT id FROM l) AND v IN (SELECT id FROM l)), t AS (SELECT u AS id FROM e UNION SELECT v FROM e)
    SELECT id, type FROM l WHERE type <> 'entity' OR id IN (SELECT id FROM t)""",
)
def delete_document_prune(spark, d):
    """The nodes that stay when the first document is removed."""
    nodes, edges = whole_graph(spark, d)
    first = nodes.agg(F.min("doc_id")).first()[0]
    return graph.remove_document(nodes, edges, first)[0].select("id", "type")


_SEEDS = "s AS (SELECT query_id, id AS node, greatest(0.05, coalesce(max(CASE WHEN isfinite(score) THEN score END), 0)) AS energy FROM search_hits WHERE query_id IS NOT NULL AND id IS NOT NULL AND hit_no <= 3 GROUP BY 1, 2)"
_SPREAD = f"{_SEEDS}, w AS (SELECT * FROM ends WHERE kind NOT IN ('CONTAINS', 'BELONGS')), h1 AS (SELECT query_id, w.v AS node, sum(energy * weight) AS energy FROM s JOIN w ON w.u = s.node WHERE energy * weight >= 0.02 GROUP BY 1, 2), h2 AS (SELECT query_id, w.v AS node, sum(energy * weight * 0.6) AS energy FROM h1 JOIN w ON w.u = h1.node WHERE energy * weight * 0.6 >= 0.02 GROUP BY 1, 2), p AS (SELECT query_id, node, round(sum(energy), 4) AS potential FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2)"


def seeds(spark: SparkSession, d: str) -> DataFrame:
    score = F.when((F.abs("score") < F.lit(float("inf"))) & ~F.isnan("score"), F.col("score"))
    hits = table(spark, d, "search_hits").where(F.col("query_id").isNotNull() & F.col("id").isNotNull() & (F.col("hit_no") <= 3))
    return hits.groupBy("query_id", F.col("id").alias("node")).agg(F.greatest(F.lit(0.05), F.coalesce(F.max(score), F.lit(0.0))).alias("energy"))


@query("spread_2hop", f"WITH {O.GRAPH}, {_SPREAD} SELECT query_id, node, potential FROM p")
def spread_2hop(spark, d):
    """Energy of the first three hits of each logged search over the graph."""
    edges = cut(graph.build_edges(chunks(spark, d), fine_vectors(spark, d)))
    return graph.spread_many(edges, seeds(spark, d), digits=4)


@query("potentials_top12", f"WITH {O.GRAPH}, {_SPREAD} SELECT query_id, node, potential FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY potential DESC, node) <= 12")
def potentials_top12(spark, d):
    order = Window.partitionBy("query_id").orderBy(F.col("potential").desc(), "node")
    edges = cut(graph.build_edges(chunks(spark, d), fine_vectors(spark, d)))
    return graph.spread_many(edges, seeds(spark, d), digits=4, top=12).withColumn("r", F.row_number().over(order)).where("r <= 12").drop("r")


@query("hubs")
def hubs(spark, d):
    return graph.hubs(*whole_graph(spark, d))


@query("hub_sizes", "SELECT hub AS hub_id, count(DISTINCT id) AS size FROM chunks WHERE hub IS NOT NULL GROUP BY hub ORDER BY size DESC, hub LIMIT 24")
def hub_sizes(spark, d):
    """The largest hubs that the chunk table names."""
    rows = chunks(spark, d).where(F.col("hub").isNotNull()).groupBy(F.col("hub").alias("hub_id")).agg(F.count(F.lit(1)).alias("size"))
    return rows.orderBy(F.col("size").desc(), "hub_id").limit(24)


@query("hub_wiring", "WITH h AS (SELECT DISTINCT hub FROM chunks WHERE hub IS NOT NULL) SELECT u, v, kind, weight::DOUBLE AS weight FROM (SELECT least('agent:sensory', hub) AS u, greatest('agent:sensory', hub) AS v, 'SENSES' AS kind, 0.6 AS weight FROM h UNION ALL SELECT least('agent:circuits', hub), greatest('agent:circuits', hub), 'GATES', 0.6 FROM h UNION ALL SELECT * FROM (VALUES ('agent:circuits', 'agent:synthesist', 'DRIVES', 0.9), ('agent:critic', 'agent:synthesist', 'REFLECTS', 0.9)))")
def hub_wiring(spark, d):
    members = chunks(spark, d).where(F.col("hub").isNotNull()).select(F.col("hub").alias("hub_id"), F.col("id").alias("chunk_id"))
    return graph.hub_edges(members).where(F.col("kind") != "BELONGS")


@query("layout")
def layout(spark, d):
    return graph.positions(*whole_graph(spark, d))


# ── stages of a question, over the log of searches ─────────────────────────


def candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and questions from the log of searches: a query is a chunk's id, its document's title the question."""
    rows = chunks(spark, d)
    score = F.when((F.abs("score") < F.lit(float("inf"))) & ~F.isnan("score"), F.col("score"))
    hits = table(spark, d, "search_hits").where(F.col("query_id").isNotNull() & F.col("id").isNotNull())
    hits = hits.groupBy("query_id", "id").agg(F.min("hit_no").alias("rank"), F.coalesce(F.max(score), F.lit(0.0)).alias("sim"))
    asked = rows.select(F.col("id").alias("query_id"), F.col("doc_title").alias("query")).join(hits.select("query_id").distinct(), "query_id")
    tokens = asked.select("query_id", T.token_set(F.col("query")).alias("query_tokens"))
    joined = hits.join(rows.select(*retrieval.CANDIDATE), "id").join(tokens, "query_id")
    return joined.withColumn("lexical", T.lexical_overlap(F.col("query_tokens"), T.token_set(F.col("text")))).withColumn("graph_boost", F.lit(0.0)).drop("query_tokens"), asked


def sourced(found: DataFrame) -> DataFrame:
    """The first six hits of each search as its sources."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    path = F.array_join("section_path", " › ")
    return found.withColumn("n", n.cast("int")).where("n <= 6").select("query_id", "n", F.concat(F.lit("S"), F.col("n").cast("string")).alias("tag"), "id", "text", "doc_title", F.when(path == "", F.col("doc_title")).otherwise(path).alias("section"), "kind", "chunk_order", F.round("sim", 3).alias("score"))


_SOURCED = f"{O.CANDIDATES}, src AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS n, round(sim, 3) AS score FROM k QUALIFY n <= 6)"


@query("candidate_features", f"WITH {O.CANDIDATES} SELECT query_id, id, round(sim, 6) AS sim, round(lexical, 6) AS lexical, round(entity, 6) AS entity FROM k")
def candidate_features(spark, d):
    found, asked = candidates(spark, d)
    tokens = asked.select("query_id", T.token_set(F.col("query")).alias("q"))
    return found.join(tokens, "query_id").select("query_id", "id", F.round("sim", 6).alias("sim"), F.round("lexical", 6).alias("lexical"), F.round(gate.entity_congruence(F.col("entities"), F.col("q")), 6).alias("entity"))


@query(
    "membrane_potential",
    f"WITH {O.CANDIDATES}, p AS (SELECT *, 0.55 * greatest(0.0, sim) + 0.25 * greatest(0.0, lexical) + 0.2 * greatest(0.0, entity) - 0.35 * 0.4 AS v FROM k) SELECT query_id, id, round(v, 4) AS potential, v >= 0.3 AS fired, round(0.55 * greatest(0.0, sim), 3) AS semantic, CASE WHEN v >= 0.3 THEN '' ELSE 'suppressed: lateral inhibition (redundant context)' END AS reason FROM p",
)
def membrane_potential(spark, d):
    found, asked = candidates(spark, d)
    tokens = asked.select("query_id", T.token_set(F.col("query")).alias("q"))
    v = gate.verdict(F.col("sim"), F.col("lexical"), gate.entity_congruence(F.col("entities"), F.col("q")), F.lit(0.4), F.lit(0.0), 0.35, 0.3)
    rows = found.join(tokens, "query_id").select("query_id", "id", v.alias("v"))
    return rows.select("query_id", "id", "v.potential", "v.fired", F.col("v.components")["semantic"].alias("semantic"), "v.reason")


@query("gate_fold", O.GATE)
def gate_fold(spark, d):
    found, asked = candidates(spark, d)
    verdicts = retrieval.fire(found, asked.select("query_id", T.token_set(F.col("query")).alias("query_tokens")), Settings(gating_threshold=0.3))
    return verdicts.select("query_id", F.posexplode("verdicts").alias("n", "v")).select("query_id", "v.id", (F.col("n") + 1).alias("n"), "v.potential", "v.fired", "v.reason")


@query("claim_maps", f"WITH m AS (SELECT doc_id, generate_subscripts(k, 1) AS i, lower(unnest(k)) AS key, replace(unnest(v), ',', '')::DOUBLE AS value FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {O.q(T.CLAIM)}, 1) AS k, regexp_extract_all(coalesce(text, ''), {O.q(T.CLAIM)}, 2) AS v FROM documents)) SELECT doc_id, key, arg_max(value, i) AS value FROM m GROUP BY doc_id, key")
def claim_maps(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.claim_map(F.col("text"))).alias("key", "value"))


@query(
    "claim_conflicts",
    f"WITH {O.CHUNKS}, m AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, {O.q(T.CLAIM)}, 1))) AS key, replace(unnest(regexp_extract_all(text, {O.q(T.CLAIM)}, 2)), ',', '')::DOUBLE AS value FROM c) SELECT doc_id, key, count(*) AS claims, min(value) AS lowest, max(value) AS highest FROM m WHERE value <> 0 GROUP BY doc_id, key HAVING abs(max(value) - min(value)) / greatest(abs(min(value)), abs(max(value))) > 0.15",
)
def claim_conflicts(spark, d):
    """Keys whose numbers contradict within a document, zeros aside: by their extremes, so no pairs are made."""
    m = chunks(spark, d).select("doc_id", F.explode(T.claims(F.col("text"))).alias("c")).where(F.col("c.value") != 0).groupBy("doc_id", F.col("c.key").alias("key"))
    rows = m.agg(F.count(F.lit(1)).alias("claims"), F.min("c.value").alias("lowest"), F.max("c.value").alias("highest"))
    return rows.where(F.abs(F.col("highest") - F.col("lowest")) / F.greatest(F.abs("lowest"), F.abs("highest")) > 0.15)


@query(
    "sentence_relevance",
    f"""WITH {_SOURCED}, s0 AS (SELECT query_id, n, qt, score, generate_subscripts(s, 1) - 1 AS idx, unnest(s) AS sentence FROM (SELECT query_id, n, qt, score, {O.sentences('text')} AS s FROM src)),
    s1 AS (SELECT *, {O.tokens('sentence')} AS t FROM s0 WHERE length(sentence) BETWEEN 30 AND 400), s2 AS (SELECT * FROM s1 WHERE len(t) >= 3),
    df AS (SELECT query_id, w, count(*) AS df FROM (SELECT query_id, unnest(list_distinct(t)) AS w FROM s2) GROUP BY 1, 2), nn AS (SELECT query_id, count(*) AS total FROM s2 GROUP BY 1),
    ov AS (SELECT query_id, n, idx, unnest(list_intersect(list_distinct(t), qt)) AS w FROM s2), i AS (SELECT query_id, n, idx, sum(ln(1 + total / (df + 0.5))) AS idf FROM ov JOIN df USING (query_id, w) JOIN nn USING (query_id) GROUP BY 1, 2, 3)
    SELECT s2.query_id, 'S' || s2.n AS tag, s2.idx::INT AS idx, round(coalesce(idf, 0) / (sqrt(len(t)) + 1) + 0.35 * score + CASE WHEN idf IS NULL THEN 0 ELSE 0.2 END, 5) AS relevance FROM s2 LEFT JOIN i ON i.query_id = s2.query_id AND i.n = s2.n AND i.idx = s2.idx""",
)
def sentence_relevance(spark, d):
    found, asked = candidates(spark, d)
    return retrieval.sentence_relevance(sourced(found), asked).select("query_id", "tag", "idx", F.round("relevance", 5).alias("relevance"))


@query("reflex_answer")
def reflex_answer(spark, d):
    found, asked = candidates(spark, d)
    return retrieval.compose(retrieval.sentence_relevance(sourced(found), asked))


@query(
    "prf_expand",
    f"""WITH {O.CANDIDATES}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, rank, id) AS n FROM k QUALIFY n <= 8),
    x AS (SELECT query_id, n, {O.distinct_in_order(O.tokens('text'))} AS t, qt FROM s), y AS (SELECT query_id, n, list_filter(t, lambda w: NOT list_contains(qt, w)) AS t FROM x),
    z AS (SELECT query_id, n, generate_subscripts(t, 1) AS p, unnest(t) AS term FROM y), g AS (SELECT query_id, term, count(*) AS c, min(n * 100000 + p) AS place FROM z GROUP BY 1, 2),
    m AS (SELECT *, max(c) OVER (PARTITION BY query_id) AS most FROM g), b AS (SELECT * FROM m WHERE c >= 2 OR most < 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, place) <= 5)
    SELECT query_id, string_agg(term, ' ' ORDER BY c DESC, place) AS expansion FROM b GROUP BY query_id""",
)
def prf_expand(spark, d):
    found, asked = candidates(spark, d)
    return retrieval.expand(found, asked).select("query_id", F.array_join("expansion", " ").alias("expansion"))


@query(
    "context_budget",
    f"""WITH {_SOURCED}, b AS (SELECT query_id, n, '[S' || n || '] ' || doc_title || ' › ' || CASE WHEN len(path) = 0 OR array_to_string(path, ' › ') = '' THEN doc_title ELSE array_to_string(path, ' › ') END || chr(10) || text AS block FROM src),
    r AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY n) AS used FROM b) SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY n) AS context, count(*) AS blocks FROM r WHERE used <= 2000 GROUP BY query_id""",
)
def context_budget(spark, d):
    return retrieval.context(sourced(candidates(spark, d)[0]), 2000)


@query("citation_tags", f"WITH {O.CHUNKS}, t AS (SELECT id, list_transform(regexp_extract_all(text, '\\[S(\\d+)\\]', 1), lambda x: try_cast(x AS INT)) AS n FROM c), u AS (SELECT id, list_filter(n, lambda x: x BETWEEN 1 AND 6) AS n FROM t) SELECT id, array_to_string(list_transform({O.distinct_in_order('n')}, lambda x: 'S' || x), ' ') AS tags FROM u WHERE len(n) > 0")
def citation_tags(spark, d):
    tags = chunks(spark, d).select("id", T.extract_tags(F.col("text"), F.lit(6)).alias("t"))
    return tags.where(F.size("t") > 0).select("id", F.array_join("t", " ").alias("tags"))


@query("citations", f"WITH {_SOURCED} SELECT query_id, 'S' || n AS tag, id, doc_title, {O.truncated('text', 220)} AS text, score FROM src")
def citations(spark, d):
    from evigraph.plans.engine import citations as gather

    rows = gather(sourced(candidates(spark, d)[0])).select("query_id", F.explode("citations").alias("c"))
    return rows.select("query_id", "c.tag", "c.id", "c.doc_title", "c.text", "c.score")


@query(
    "grounding_score",
    f"""WITH {_SOURCED}, e AS (SELECT query_id, string_agg(text, ' ' ORDER BY n) AS j, list_distinct(flatten(list({O.tokens('text')}))) AS k FROM src GROUP BY query_id),
    a AS (SELECT id AS query_id, text AS answer, regexp_replace(text, '\\[S(\\d+)\\]', ' ', 'g') AS bare FROM c), x AS (SELECT query_id, answer, {O.sentences('answer')} AS s, list_distinct({O.tokens('bare')}) AS t, k, j, list_distinct(regexp_extract_all(bare, '\\d[\\d,]*(?:\\.\\d+)?')) AS nums FROM a JOIN e USING (query_id)),
    y AS (SELECT query_id, answer, s, nums, j, len(list_filter(s, lambda z: regexp_matches(z, '\\[S(\\d+)\\]'))) / greatest(len(s), 1) AS cite, CASE WHEN len(t) > 0 THEN len(list_intersect(t, k)) / len(t) ELSE 0.0 END AS support FROM x)
    SELECT query_id, answer = '' OR (len(s) > 0 AND len(list_filter(nums, lambda n: NOT contains(j, n) AND NOT contains(replace(j, ',', ''), replace(n, ',', '')))) = 0 AND 0.5 * cite + 0.5 * support >= 0.55) AS grounded, round(0.5 * cite + 0.5 * support, 6) AS score FROM y""",
)
def grounding_score(spark, d):
    """The text of the asking chunk judged as an answer against its sources."""
    found, _ = candidates(spark, d)
    fired = sourced(found)
    answers = chunks(spark, d).select(F.col("id").alias("query_id"), F.col("text").alias("answer")).join(fired.select("query_id").distinct(), "query_id")
    return retrieval.criticise(answers, fired).select("query_id", "grounded", "score")


@query("tokens_saved", f"WITH {O.CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS n FROM k) SELECT query_id, greatest(0, sum(CASE WHEN n > 2 THEN coalesce(token_estimate, 0) ELSE 0 END))::BIGINT AS tokens_saved FROM r GROUP BY query_id")
def tokens_saved(spark, d):
    """Tokens kept out where the first two hits fire."""
    found = candidates(spark, d)[0].withColumn("token_estimate", F.coalesce("token_estimate", F.lit(0)))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).where("n <= 2")
    verdicts = first.groupBy("query_id").agg(F.collect_list(F.struct("id", F.lit(True).alias("fired"))).alias("verdicts"))
    return retrieval.tokens_saved(found, verdicts)


@query("rag_answer")
def rag_answer(spark, d):
    """Questions answered over the chunk table: search, spreading, gate, extractive answer, grounding and loop."""
    from evigraph.plans.engine import answer

    s = Settings(gating_threshold=0.25)
    rows = cut(chunks(spark, d))
    embedded = cut(embedding.embed(rows.select("id", T.embed_text(F.col("doc_title"), F.col("section_path"), F.col("text")).alias("t")), "id", "t", s.dim))
    edges = cut(graph.build_edges(rows, embedded, s.relate_threshold))
    done = answer(questions(spark), rows, embedded, edges, s)
    return done.select("query_id", "answer", F.array_join("tags", " ").alias("tags"), "grounded", "fired", "suppressed", "tokens_saved", "loops", F.array_join("expansion", " ").alias("expansion"), "error")


# ── events and figures ─────────────────────────────────────────────────────


@query("events_recent", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def events_recent(spark, d):
    return ev.recent(table(spark, d, "events"), 30).select("event_id", "event_type")


@query("events_run_cap", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5")
def events_run_cap(spark, d):
    return ev.run_cap(table(spark, d, "events"), "user_id", most=5).select("event_id", "user_id")


@query("events_active_window", "WITH t AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 40), m AS (SELECT max(ts) AS now FROM events) SELECT user_id, max(ts) AS last_ts FROM t GROUP BY user_id HAVING max(ts) >= (SELECT now FROM m) - INTERVAL 2600 SECOND")
def events_active_window(spark, d):
    """Users active within 2,600 seconds of the last event, among the last 40 events."""
    rows = table(spark, d, "events")
    now = rows.agg(F.max("ts")).first()[0]
    return ev.active(rows, "user_id", F.lit(now), seconds=2600)


@query("events_ring", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1200")
def events_ring(spark, d):
    rows = table(spark, d, "events")
    return ev.ring(rows.where(F.col("event_id") % 2 == 0), rows.where(F.col("event_id") % 2 == 1)).select("event_id")


@query("events_queue", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 800")
def events_queue(spark, d):
    """What a subscriber with 100 waiting events takes."""
    return ev.offered(100, table(spark, d, "events")).select("event_id")


@query("events_json", "SELECT event_id, event_type FROM events")
def events_json(spark, d):
    """Events as JSON and back; null fields are left out."""
    rows = table(spark, d, "events")
    packed = rows.select("event_id", ev.make_event(F.col("event_type"), None, F.unix_timestamp("ts"), nothing=F.lit(None).cast("string")).alias("j"))
    return packed.where(~F.contains("j", F.lit("nothing"))).select("event_id", F.get_json_object("j", "$.type").alias("event_type"))


@query("events_windowed", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_windowed(spark, d):
    return ev.windowed(table(spark, d, "events")).select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("events_feed", "SELECT substr(regexp_replace('user:' || user_id || '-' || event_type, '^[a-z]+:', ''), 1, 34) AS label, ts FROM events")
def events_feed(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("node"), F.col("event_type").alias("type"), "ts")
    return ev.line(rows, "node").select("label", "ts")


@query(
    "stats_rollup",
    "SELECT count(*) FILTER (event_type <> 'signup') AS queries, count(*) FILTER (event_type = 'signup') AS ingestions, (sum(event_id % 7) FILTER (event_type <> 'signup'))::BIGINT AS spikes_emitted, round(avg(event_id % 1000) FILTER (event_type <> 'signup'), 1) AS avg_latency_ms, arg_max(event_id % 1000, ts) FILTER (event_type <> 'signup') AS last_latency_ms FROM events",
)
def stats_rollup(spark, d):
    """Events read as runs and ingests."""
    rows = table(spark, d, "events")
    runs = rows.where(F.col("event_type") != "signup").select((F.col("event_id") % 7).alias("spikes"), F.lit(0).alias("suppressed"), F.lit(0).alias("tokens_saved"), F.lit(0).alias("loops"), (F.col("event_id") % 1000).alias("latency_ms"), "ts")
    return stats.rollup(runs, rows.where(F.col("event_type") == "signup")).select("queries", "ingestions", "spikes_emitted", "avg_latency_ms", "last_latency_ms")

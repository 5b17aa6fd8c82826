"""The engine: ingest, graph upkeep and answers over tables in a folder, or over given DataFrames.

Tables are parquet in versioned folders; a pointer file names the version in force, so that readers never see half a
write. Names: chunks, vectors, nodes, edges, hub_members, runs, ingests, events.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.config import Settings
from evigraph.functions import hashing
from evigraph.functions import text as T
from evigraph.operators import graph as G
from evigraph.operators import retrieval as R
from evigraph.operators.chunking import chunk_blocks, text_blocks
from evigraph.operators.embedding import embed, reembed
from evigraph.operators.stats import rollup
from evigraph.runtime import cut
from evigraph.sources.parse import parse_files
from evigraph.sources.store import Store

NO_EVIDENCE = "no signal crossed the firing threshold: nothing held is close enough to the question"
NO_STATEMENT = "Sources passed the gate, but none of their sentences bears on the question."

CHUNK = "id string, doc_id string, doc_title string, section_path array<string>, section_title string, text string, kind string, token_estimate int, entities array<string>, refs array<string>, hub string, chunk_order int, content_hash string"
SCHEMAS = {
    "chunks": CHUNK,
    "vectors": "id string, doc_id string, embedding array<float>, embed_kind string",
    "nodes": "id string, type string, label string, " + ", ".join(f"{c} {t}" for c, t in G.ATTRIBUTES.items()),
    "edges": "u string, v string, kind string, weight double",
    "hub_members": "hub_id string, chunk_id string",
    "runs": "run_id string, query string, grounded boolean, loops int, fired int, suppressed int, tokens_saved long, latency_ms long, spikes int, ts timestamp",
    "ingests": "doc_id string, title string, chunks long, sections long, entities long, warnings array<string>, ms long, ts timestamp",
    "refusals": "name string, reason string, ts timestamp",
    "events": "type string, polarity string, ts double, run_id string, payload string",
}


def chunk_texts(df: DataFrame, key: str, text: str, title: str, s: Settings) -> DataFrame:
    """Chunks of plain texts."""
    blocks = text_blocks(df, key, text).join(df.select(key, F.col(title).alias("title")), key)
    return chunk_blocks(blocks.select(F.col(key).alias("doc_id"), "title", "block", "path", F.lit("text").alias("kind"), "text"), "title", s.chunk_max_chars, s.chunk_overlap_sentences, s.hash_kind)


def answer(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, edges: DataFrame, s: Settings, synthesise: Callable[[DataFrame], DataFrame] | None = None, audit: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row for each question (query_id, query): answer, tags, citations, grounding, fired, suppressed, candidates,
    tokens_saved, loops, expansion, verdicts, potentials, error.

    The loop ends after max_reflection_loops passes, one at least; loops counts the failed ones, up to that setting.

    All questions go through the stages together; only those whose answer isn't grounded are taken through the loop
    again, sharpened by frequent terms of their candidates and with what a second search recovers. `synthesise` takes
    (query_id, query, context) and gives (query_id, answer) in place of the extractive answer; `audit` takes answers and
    sources and gives (query_id, answer, grounded, score, note) in place of the heuristic.
    """
    valid = cut(R.valid_queries(queries))
    tokens = valid.select("query_id", T.token_set(F.col("query")).alias("query_tokens"))
    candidates = cut(R.sense(valid, chunks, vectors, s))
    reached = cut(R.reached(candidates, edges, s))
    candidates = cut(R.boosted(candidates, reached))
    done: DataFrame | None = None
    left, expansion = valid, valid.select("query_id", F.array().cast("array<string>").alias("expansion"))
    passes = max(1, s.max_reflection_loops)
    for loop in range(passes):
        verdicts = cut(R.fire(candidates, tokens, s))
        fired = cut(R.sources(verdicts, candidates))
        extracted = R.compose(R.sentence_relevance(fired, left))
        has = fired.select("query_id").distinct().withColumn("any", F.lit(True))
        drafted = left.join(has, "query_id", "left").join(extracted, "query_id", "left")
        answers = drafted.select("query_id", F.when(F.col("any").isNull(), "").otherwise(F.coalesce("answer", F.lit(NO_STATEMENT))).alias("answer"))
        if synthesise is not None:
            written = synthesise(left.join(R.context(fired, s.context_chars), "query_id"))
            answers = answers.withColumnRenamed("answer", "_a").join(written, "query_id", "left").select("query_id", F.coalesce("answer", "_a").alias("answer"))
        judged = (audit if s.critic_mode == "llm" and audit is not None else R.criticise)(answers, fired)
        votes = verdicts.select("query_id", F.size(F.filter("verdicts", lambda v: v["fired"])).alias("fired"), F.size(F.filter("verdicts", lambda v: ~v["fired"])).alias("suppressed"))
        last = loop == passes - 1
        loops = F.when(F.col("grounded"), loop).otherwise(min(loop + 1, s.max_reflection_loops))
        rows = left.join(judged, "query_id").join(votes, "query_id", "left").join(R.tokens_saved(candidates, verdicts), "query_id", "left").join(expansion, "query_id", "left")
        own = verdicts.select("query_id", "verdicts").join(citations(fired), "query_id", "left").join(R.top_potentials(reached), "query_id", "left")
        rows = rows.join(own, "query_id", "left").join(candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates")), "query_id", "left")
        zero = F.lit(0)
        rows = cut(
            rows.select(
                "query_id", "query", "answer",
                T.extract_tags(F.col("answer"), F.coalesce("fired", zero)).alias("tags"),
                "grounded", "score", "note",
                F.coalesce("fired", zero).alias("fired"), F.coalesce("suppressed", zero).alias("suppressed"),
                F.coalesce("tokens_saved", zero.cast("long")).alias("tokens_saved"), loops.alias("loops"),
                F.coalesce("expansion", F.array().cast("array<string>")).alias("expansion"),
                F.when(F.coalesce("fired", zero) == 0, NO_EVIDENCE).otherwise("").alias("error"),
                "citations", "verdicts", "potentials", F.coalesce("candidates", zero.cast("long")).alias("candidates"),
            )
        )
        settled = rows if last else rows.where(F.col("grounded"))
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        left = cut(rows.where(~F.col("grounded")).select("query_id", "query"))
        if left.isEmpty():
            break
        candidates = candidates.join(left.select("query_id"), "query_id", "left_semi")
        expansion = cut(R.expand(candidates, left))
        sharp = left.join(expansion, "query_id").select("query_id", F.concat_ws(" ", F.col("query"), F.array_join("expansion", " ")).alias("query"))
        more = R.sense(sharp, chunks, vectors, s).join(candidates.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("rank", F.col("rank") + 1000)
        tokens = sharp.select("query_id", T.token_set(F.col("query")).alias("query_tokens"))
        reached = cut(R.reached(candidates, edges, s))
        candidates = cut(R.boosted(candidates, reached).unionByName(more.select(*candidates.columns)))
    return done


def citations(fired: DataFrame) -> DataFrame:
    """(query_id, citations): array<struct<tag,id,doc_title,section,kind,score,text>> in order of the tags."""
    one = F.struct("n", "tag", "id", "doc_title", "section", "kind", "score", T.truncate(F.col("text"), 220).alias("text"))
    return fired.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("n")).alias("citations"))


class Engine:
    """The public surface: health, system, graph, documents, delete, ingest, ingest_url, refusals, query, reset, events.

    `synthesise` and `audit` are given on to `answer`; `provider` names who writes the answers.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, synthesise: Callable | None = None, audit: Callable | None = None, provider: str = "extractive"):
        self.spark, self.s = spark, settings or Settings.from_env()
        self.synthesise, self.audit, self.provider = synthesise, audit, provider
        self.waiting: list[tuple] = []
        self.store = Store(spark, folder, SCHEMAS)
        self.started = time.time()

    def health(self) -> dict:
        return {"status": "ok", "embed_kind": self.s.hash_kind, "uptime_s": round(time.time() - self.started, 1)}

    def system(self) -> dict:
        counts = G.counts(self.store.read("nodes"), self.store.read("edges")).first().asDict()
        return {"counts": counts, "stats": rollup(self.store.read("runs"), self.store.read("ingests")).first().asDict(), "settings": self.s}

    def ingest(self, files: DataFrame) -> DataFrame:
        """(doc_id, title, chunks, sections, entities, warnings, ms) of each new document of (name, content, url).

        Empty and oversized files are refused before parsing, those without text after it; see `refusals`. Files of one
        name are documents of their own. A document whose id is known is passed over; the chunks and vectors of new ones
        are appended, and the graph is rewired once for the batch.
        """
        began = time.time()
        if self.s.max_documents and self.store.read("chunks").select("doc_id").distinct().count() >= self.s.max_documents:
            raise ValueError(f"{self.s.max_documents} documents are held already")
        size = F.coalesce(F.length("content"), F.lit(0))
        own_name = F.concat(F.hex(F.xxhash64("name", "content")), F.lit("/"), F.coalesce("name", F.lit("")))  # a path, whose last part is the name
        fine = files.where((size > 0) & (size <= self.s.max_upload_bytes)).withColumn("name", own_name)
        blocks = cut(parse_files(fine).dropDuplicates(["name", "block"]))
        reason = F.when(size == 0, "empty file").when(size > self.s.max_upload_bytes, f"larger than {self.s.max_upload_bytes} bytes")
        refused = files.select("name", reason.alias("reason")).where(F.col("reason").isNotNull())
        raw = blocks.groupBy("name").agg(F.first("title").alias("title"), F.first("warnings").alias("warnings"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n").alias("raw"))
        docs = raw.where(T.strip(F.col("raw")) != "").select("name", "title", "warnings", hashing.doc_id(F.col("title"), F.col("raw"), self.s.hash_kind).alias("doc_id"))
        docs = docs.dropDuplicates(["doc_id"]).join(self.store.read("chunks").select("doc_id").distinct(), "doc_id", "left_anti")
        docs = cut(docs)
        without = fine.select("name").join(raw.where(T.strip(F.col("raw")) != ""), "name", "left_anti").select(F.substring_index("name", "/", -1).alias("name"), F.lit("no text in it").alias("reason"))
        self.store.append("refusals", refused.unionByName(without).withColumn("ts", F.current_timestamp()))
        chunks = cut(chunk_blocks(blocks.drop("title", "warnings").join(docs.select("name", "doc_id", "title"), "name"), "title", self.s.chunk_max_chars, self.s.chunk_overlap_sentences, self.s.hash_kind))
        embedded = embed(chunks.select("id", T.embed_text(F.col("doc_title"), F.col("section_path"), F.col("text")).alias("t")), "id", "t", self.s.dim, self.s.hash_kind)
        vectors = cut(embedded.join(chunks.select("id", "doc_id"), "id").select("id", "doc_id", "embedding", F.lit(self.s.hash_kind).alias("embed_kind")))
        self.store.append("chunks", chunks)
        self.store.append("vectors", vectors)
        nodes = G.build_nodes(chunks)
        edges = G.build_edges(chunks, vectors.select("id", "embedding"), self.s.relate_threshold)
        self._wire(self.store.read("nodes"), self.store.read("edges"), nodes, edges)
        # every section above a chunk, not only the ones that hold chunks themselves
        sections = G.section_chain(G.known(chunks)).groupBy("doc_id").agg(F.countDistinct("path").alias("sections"))
        named = chunks.select("doc_id", F.explode("entities").alias("e")).groupBy("doc_id").agg(F.countDistinct("e").alias("entities"))
        zero = F.lit(0).cast("long")
        per_doc = docs.join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks")), "doc_id").join(sections, "doc_id", "left").join(named, "doc_id", "left")
        result = per_doc.select("doc_id", "title", "chunks", F.coalesce("sections", zero).alias("sections"), F.coalesce("entities", zero).alias("entities"), "warnings", F.lit(int((time.time() - began) * 1000)).cast("long").alias("ms"), F.current_timestamp().alias("ts"))
        result = cut(result)
        self.store.append("ingests", result)
        self._emit("ingest", "excitatory", None, {"documents": result.count()})
        self._flush()
        return result

    def refusals(self) -> DataFrame:
        """(name, reason, ts) of the files that ingest refused."""
        return self.store.read("refusals")

    def reembed(self) -> None:
        """Make vectors of another kind or length than the settings' anew; to be called after the kind was changed."""
        self.store.write("vectors", reembed(self.store.read("chunks"), self.store.read("vectors"), self.s.dim, self.s.hash_kind))

    def _wire(self, old_nodes: DataFrame, old_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
        """Merge new nodes and edges into the graph, then hubs and agents anew."""
        stay_n = old_nodes.where(~F.col("type").isin("hub", "agent"))
        stay_e = old_edges.where(~F.col("kind").isin("BELONGS", "SENSES", "GATES", "DRIVES", "REFLECTS"))
        cols = nodes.columns
        all_n = G.upsert_nodes(stay_n.select(*cols).withColumn("_seq", F.lit(0)).unionByName(nodes.withColumn("_seq", F.lit(1))))
        all_e = G.upsert_edges(stay_e.withColumn("_seq", F.lit(0)).unionByName(edges.withColumn("_seq", F.lit(1))))
        all_n, all_e = cut(all_n), cut(all_e)
        members = cut(G.hubs(all_n, all_e))
        self.store.write("hub_members", members)
        self.store.write("nodes", all_n.unionByName(G.hub_nodes(members)).unionByName(G.agents(self.spark)))
        self.store.write("edges", all_e.unionByName(G.hub_edges(members)))

    def ingest_url(self, url: str, preview_only: bool = False) -> DataFrame:
        from evigraph.sources.web import fetch, preview

        page = fetch(url)
        files = self.spark.createDataFrame([(url, bytearray(page), url)], "name string, content binary, url string")
        return preview(files) if preview_only else self.ingest(files)

    def query(self, query: str) -> dict:
        """One question answered, with citations; blank and overlong questions are errors."""
        began = time.time()
        if not query or not query.strip() or len(query) > 2000:
            raise ValueError("a question of 1 to 2000 characters is needed")
        run_id = uuid.uuid4().hex[:12]
        self._emit("run_start", "excitatory", run_id, {"query": query[:60]})
        asked = self.spark.createDataFrame([(run_id, query)], "query_id string, query string")
        row = self.answers(asked).first().asDict(recursive=True)
        ms = int((time.time() - began) * 1000)
        run = [(run_id, query, row["grounded"], row["loops"], row["fired"], row["suppressed"], row["tokens_saved"], ms, row["fired"] + row["suppressed"])]
        self.store.append("runs", self.spark.createDataFrame(run, SCHEMAS["runs"].rpartition(",")[0]).withColumn("ts", F.current_timestamp()))
        for hit in row["potentials"] or []:
            self._emit("spike", "excitatory", run_id, {"node": hit["node"], "potential": hit["potential"]})
        for v in row["verdicts"] or []:
            self._emit("gate", "excitatory" if v["fired"] else "inhibitory", run_id, {"node": v["id"], "potential": v["potential"], "fired": v["fired"], "reason": v["reason"]})
        self._emit("run_end", "excitatory" if row["grounded"] else "signal", run_id, {"grounded": row["grounded"], "loops": row["loops"]}, True)
        self._flush()
        return row | {"run_id": run_id, "latency_ms": ms, "provider": self.provider}

    def answers(self, queries: DataFrame) -> DataFrame:
        """Answers to (query_id, query) from the store."""
        edges = self.store.read("edges")
        vectors = self.store.read("vectors").where(F.col("embed_kind") == self.s.hash_kind).select("id", "embedding")
        return answer(queries, self.store.read("chunks"), vectors, edges, self.s, self.synthesise, self.audit)

    def documents(self) -> DataFrame:
        return G.inventory(self.store.read("nodes"), self.store.read("edges"))

    def graph(self, types: list[str] | None = None, max_chunks: int = 180, hub: str | None = None) -> dict:
        nodes, edges = G.snapshot(self.store.read("nodes"), self.store.read("edges"), types, min(600, max(20, max_chunks)), hub)
        return {"nodes": nodes, "edges": edges, "hubs": self.store.read("hub_members"), "counts": G.counts(self.store.read("nodes"), self.store.read("edges"))}

    def delete(self, doc_id: str) -> bool:
        """Remove a document everywhere; False where it isn't known."""
        if self.store.read("chunks").where(F.col("doc_id") == doc_id).isEmpty():
            return False
        for name in ("chunks", "vectors"):
            self.store.write(name, self.store.read(name).where(F.col("doc_id") != doc_id))
        nodes, edges = G.remove_document(self.store.read("nodes"), self.store.read("edges"), doc_id)
        nodes, edges = cut(nodes), cut(edges)
        self._wire(nodes, edges, nodes.limit(0), edges.limit(0))
        return True

    def reset(self) -> None:
        """Empty every table but the agents of the graph."""
        for name in ("chunks", "vectors", "edges", "hub_members", "runs", "ingests", "refusals"):
            self.store.write(name, self.store.empty(name))
        self.store.write("nodes", G.agents(self.spark))

    def events(self, n: int = 30) -> DataFrame:
        return self.store.read("events").orderBy(F.col("ts").desc()).limit(n)

    def _emit(self, kind: str, polarity: str, run_id: str | None, payload: dict, always: bool = False) -> None:
        """Hold an event until the next flush; a run holds at most max_events, its end always."""
        if always or run_id is None or sum(e[3] == run_id for e in self.waiting) < self.s.max_events:
            self.waiting.append((kind, polarity, time.time(), run_id, json.dumps({k: v for k, v in payload.items() if v is not None})))

    def _flush(self) -> None:
        """Write the events held, in one append."""
        if self.waiting:
            self.store.append("events", self.spark.createDataFrame(self.waiting, SCHEMAS["events"]))
            self.waiting = []

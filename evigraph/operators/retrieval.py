"""Stages of answering questions, each for many questions at once: rows are keyed by query_id.

What is gathered in arrays is bounded by settings: the candidates of a question (at most 2 * recall_k), its fired
sources (top_k) and their sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.config import Settings
from evigraph.functions import gate, text as T
from evigraph.operators import graph as G
from evigraph.operators.embedding import embed
from evigraph.operators.vectors import top_k

CANDIDATE = ["id", "doc_id", "doc_title", "section_path", "section_title", "text", "kind", "token_estimate", "entities", "chunk_order"]


def valid_queries(queries: DataFrame, most: int = 2000) -> DataFrame:
    """(query_id, query) of questions that aren't blank nor longer than `most`."""
    return queries.where((T.strip(T.text_of(F.col("query"))) != "") & (F.length("query") <= most)).select("query_id", "query")


def sense(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """Candidates (query_id, rank, sim, lexical, graph_boost, chunk columns): the top k of the store joined with its chunks.

    Hits without a chunk are left out. lexical is the overlap with the question's tokens.
    """
    asked = embed(queries, "query_id", "query", s.dim, s.hash_kind).withColumnRenamed("embedding", "query_vector")
    hits = top_k(vectors, asked, max(6, s.recall_k))
    tokens = queries.select("query_id", T.token_set(F.col("query")).alias("query_tokens"))
    joined = chunks.select(*CANDIDATE).join(hits, "id").join(tokens, "query_id")
    lexical = T.lexical_overlap(F.col("query_tokens"), T.token_set(F.col("text")))
    return joined.select("query_id", F.col("rank").alias("rank"), F.col("score").alias("sim"), lexical.alias("lexical"), F.lit(0.0).alias("graph_boost"), *CANDIDATE)


def boost(candidates: DataFrame, edges: DataFrame, s: Settings) -> DataFrame:
    """Candidates with the energy that reaches them over the graph from all candidates of their question."""
    return boosted(candidates, reached(candidates, edges, s))


def reached(candidates: DataFrame, edges: DataFrame, s: Settings) -> DataFrame:
    """(query_id, node, potential): what the candidates of each question excite in the graph."""
    seeds = candidates.select("query_id", F.col("id").alias("node"), F.greatest(F.lit(0.05), "sim").alias("energy"))
    return G.spread(edges, seeds, s.propagation_decay)


def top_potentials(potentials: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, potentials): array<struct<node,potential>> of the strongest nodes of each question, ties by the node."""
    order = Window.partitionBy("query_id").orderBy(F.col("potential").desc(), "node")
    kept = potentials.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_n", "node", F.round("potential", 4).alias("potential"))))
    return kept.groupBy("query_id").agg(F.transform(listed, lambda x: x.dropFields("_n")).alias("potentials"))


def boosted(candidates: DataFrame, potentials: DataFrame) -> DataFrame:
    """Candidates with their share of the potentials; 0 where none reaches them."""
    potential = potentials.withColumnRenamed("node", "id")
    return candidates.drop("graph_boost").join(potential, ["query_id", "id"], "left").withColumn("graph_boost", F.coalesce("potential", F.lit(0.0))).drop("potential")


def expand(candidates: DataFrame, queries: DataFrame, seeds: int = 8, most: int = 5) -> DataFrame:
    """(query_id, expansion): frequent terms of the first candidates that the question lacks.

    Terms in two or more of the first `seeds` candidates, else all; by count, ties by first appearance.
    """
    order = Window.partitionBy("query_id").orderBy((F.col("sim") + F.col("graph_boost")).desc(), "rank", "id")
    first = candidates.withColumn("n", F.row_number().over(order)).where(F.col("n") <= seeds)
    known = queries.select("query_id", T.token_set(F.col("query")).alias("q"))
    terms = first.join(known, "query_id").select("query_id", "n", F.posexplode(F.array_except(T.token_set(F.col("text")), F.col("q"))).alias("p", "term"))
    counted = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("n", "p")).alias("at"))
    again = F.max("c").over(Window.partitionBy("query_id"))
    kept = counted.withColumn("most", again).where((F.col("c") >= 2) | (F.col("most") < 2))
    ranked = kept.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("c").desc(), "at"))).where(F.col("r") <= most)
    return ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("expansion"))


def fire(candidates: DataFrame, query_tokens: DataFrame, s: Settings) -> DataFrame:
    """(query_id, verdicts, fired): the gate over each question's candidates, strongest first.

    A fold, because a verdict depends on those before: the best similarity fired so far inhibits, the last four fired
    texts may contradict (with conflict_against_fired), and once top_k have fired the rest is out of capacity.
    verdicts are structs in order; fired are the sources S1.. with their texts.
    """
    scored = candidates.join(query_tokens, "query_id").select(
        "query_id",
        F.struct(
            (-(F.col("sim") + F.col("graph_boost"))).alias("o"), "rank", "id", "sim", "lexical",
            gate.entity_congruence(F.coalesce("entities", F.array().cast("array<string>")), F.col("query_tokens")).alias("entity"),
            T.claim_map(F.col("text")).alias("claims"),
        ).alias("c"),
    )
    # maps can't be compared, so the order is taken from the leading numbers alone
    lists = scored.groupBy("query_id").agg(F.collect_list("c").alias("cs"))
    by_order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)
    ordered = F.array_sort("cs", by_order)
    verdict_type = "array<struct<id:string,potential:double,fired:boolean,components:map<string,double>,threshold:double,reason:string,tag:string>>"
    zero = F.struct(F.lit(0.0).alias("lat"), F.lit(0).alias("n"), F.array().cast("array<map<string,double>>").alias("claims"), F.array().cast(verdict_type).alias("out"))

    def step(state: Column, c: Column) -> Column:
        conflict = gate.numeric_conflict(c["claims"], state["claims"]) if s.conflict_against_fired else F.lit(0.0)
        voted = gate.verdict(c["sim"], c["lexical"], c["entity"], state["lat"], conflict, s.lateral_inhibition, s.gating_threshold)
        full = state["n"] >= s.top_k

        def add(v: Column) -> Column:
            fired = ~full & v["fired"]
            row = F.struct(
                c["id"].alias("id"),
                F.when(full, 0.0).otherwise(v["potential"]).alias("potential"),
                fired.alias("fired"),
                F.when(full, F.create_map().cast("map<string,double>")).otherwise(v["components"]).alias("components"),
                v["threshold"].alias("threshold"),
                F.when(full, "suppressed: context capacity reached").otherwise(v["reason"]).alias("reason"),
                F.when(fired, F.concat(F.lit("S"), (state["n"] + 1).cast("string"))).otherwise("").alias("tag"),
            )
            return F.struct(
                F.when(fired, F.greatest(state["lat"], c["sim"])).otherwise(state["lat"]).alias("lat"),
                (state["n"] + fired.cast("int")).alias("n"),
                F.when(fired, F.concat(state["claims"], F.array(c["claims"]))).otherwise(state["claims"]).alias("claims"),
                F.concat(state["out"], F.array(row)).alias("out"),
            )

        return T.let(voted, add)

    return lists.select("query_id", F.aggregate(ordered, zero, step, lambda state: state["out"]).alias("verdicts"))


def sources(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, n, tag, id, text, doc_title, section, kind, chunk_order, score, sim) of what fired."""
    fired = verdicts.select("query_id", F.posexplode("verdicts").alias("at", "v")).where("v.fired")
    rows = fired.select("query_id", F.col("v.id").alias("id"), F.col("v.tag").alias("tag"), F.substring("v.tag", 2, 9).cast("int").alias("n"), F.round("v.potential", 3).alias("score"))
    path = F.array_join("section_path", " › ")
    kept = candidates.select("query_id", "id", "text", "doc_title", F.when(path == "", F.col("doc_title")).otherwise(path).alias("section"), "kind", "chunk_order", F.round("sim", 3).alias("sim"))
    return rows.join(kept, ["query_id", "id"])


def sentence_relevance(fired: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, tag, n, idx, sentence, tokens, chunk_order, relevance) of the sentences of 30 to 400 characters and 3 tokens or more."""
    known = queries.select("query_id", T.token_set(F.col("query")).alias("q"))
    rows = fired.select("query_id", "tag", "n", "chunk_order", "score", F.posexplode(T.sentence_split(F.col("text"))).alias("idx", "sentence")).where(F.length("sentence").between(30, 400))
    rows = rows.withColumn("tokens", T.tokenize(F.col("sentence"))).where(F.size("tokens") >= 3)
    terms = rows.select("query_id", F.explode(F.array_distinct("tokens")).alias("t")).groupBy("query_id", "t").agg(F.count(F.lit(1)).alias("df"))
    total = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("N"))
    hit = rows.join(known, "query_id").select("query_id", "tag", "idx", F.explode(F.array_intersect(F.array_distinct("tokens"), F.col("q"))).alias("t"))
    idf = hit.join(terms, ["query_id", "t"]).join(total, "query_id").groupBy("query_id", "tag", "idx").agg(F.sum(F.log(1 + F.col("N") / (F.col("df") + 0.5))).alias("idf"))
    joined = rows.join(idf, ["query_id", "tag", "idx"], "left")
    relevance = F.coalesce("idf", F.lit(0.0)) / (F.sqrt(F.size("tokens").cast("double")) + 1) + 0.35 * F.col("score") + F.when(F.col("idf").isNotNull(), 0.2).otherwise(0.0)
    return joined.select("query_id", "tag", "n", "idx", "sentence", "tokens", "chunk_order", relevance.alias("relevance"))


def compose(relevance: DataFrame, most: int = 5, alike: float = 0.7) -> DataFrame:
    """(query_id, answer, used_tags): up to `most` sentences, first the best of each source, then the best left.

    A sentence whose tokens overlap a chosen one by `alike` or more is passed over. The answer is in order of the
    chunks; each sentence carries its source's tag.
    """
    item = F.struct((-F.col("relevance")).alias("r"), "n", "idx", "tag", F.col("sentence").alias("s"), F.array_distinct("tokens").alias("t"), F.col("chunk_order").alias("o"))
    lists = relevance.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("ranked"))
    kind = "array<struct<r:double,n:int,idx:int,tag:string,s:string,t:array<string>,o:int>>"
    none = F.array().cast(kind)

    def fresh(x: Column, chosen: Column) -> Column:
        return ~F.exists(chosen, lambda c: T.overlap_coefficient(x["t"], c["t"]) >= alike)

    def per_source(chosen: Column, tag: Column) -> Column:
        best = F.filter("ranked", lambda x: (x["tag"] == tag) & fresh(x, chosen))
        return F.when((F.size(chosen) < most) & (F.size(best) > 0), F.concat(chosen, F.slice(best, 1, 1))).otherwise(chosen)

    tags = F.array_distinct(F.transform("ranked", lambda x: x["tag"]))
    first = lists.withColumn("chosen", F.aggregate(tags, none, per_source))
    rest = F.aggregate("ranked", F.col("chosen"), lambda chosen, x: F.when((F.size(chosen) < most) & fresh(x, chosen), F.concat(chosen, F.array(x))).otherwise(chosen))
    story = F.array_sort(F.transform(rest, lambda x: F.struct(x["o"].alias("o"), x["s"].alias("s"), x["tag"].alias("tag"))))
    told = first.select("query_id", story.alias("story"))
    return told.select(
        "query_id",
        F.array_join(F.transform("story", lambda x: F.concat(x["s"], F.lit(" ["), x["tag"], F.lit("]"))), " ").alias("answer"),
        F.array_distinct(F.transform("story", lambda x: x["tag"])).alias("used_tags"),
    )


def context(fired: DataFrame, chars: int = 6000) -> DataFrame:
    """(query_id, context, blocks): source blocks in order of their tags while they fit in `chars`, the separators uncounted."""
    block = T.context_block(F.col("tag"), F.col("doc_title"), F.col("section"), F.col("text"))
    running = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    kept = fired.withColumn("block", block).withColumn("used", running).where(F.col("used") <= chars)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("blocks"))


def criticise(answers: DataFrame, fired: DataFrame) -> DataFrame:
    """(query_id, answer, grounded, score, note): an empty answer counts as grounded."""
    evidence = fired.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("evidence"))
    judged = answers.join(evidence, "query_id", "left").select("query_id", "answer", gate.grounding(F.col("answer"), F.coalesce("evidence", F.array().cast("array<string>"))).alias("g"))
    empty = F.col("answer") == ""
    return judged.select("query_id", "answer", (empty | F.col("g.grounded")).alias("grounded"), F.round("g.score", 6).alias("score"), F.when(empty, "").otherwise(F.col("g.note")).alias("note"))


def tokens_saved(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(query_id, tokens_saved): token estimates of the candidates that didn't fire."""
    fired = verdicts.select("query_id", F.explode("verdicts").alias("v")).where("v.fired").select("query_id", F.col("v.id").alias("id"), F.lit(1).alias("hit"))
    joined = candidates.join(fired, ["query_id", "id"], "left")
    return joined.groupBy("query_id").agg(F.greatest(F.lit(0).cast("long"), F.sum(F.when(F.col("hit").isNull(), F.col("token_estimate")).otherwise(0))).alias("tokens_saved"))

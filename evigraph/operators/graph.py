"""The evidence graph as two DataFrames: nodes (id, type, label, ...) and edges (u, v, kind, weight), u < v."""

from __future__ import annotations

import heapq
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evigraph.config import MIN_GAIN
from evigraph.functions import text as T
from evigraph.operators.vectors import relates
from evigraph.runtime import cut, parallelism, shared_folder

#: The engine's own nodes, the Greek names of hubs, and their number at most. Fixed values.
AGENTS = [("agent:sensory", "Sensory Neuron", "⚡"), ("agent:circuits", "Local Circuits", "◈"), ("agent:synthesist", "Synthesist", "✦"), ("agent:critic", "Reflex Critic", "⟳")]
GREEK = "α β γ δ ε ζ η θ ι κ λ μ ν ξ ο π ρ σ τ υ φ χ ψ ω".split()
MAX_HUBS = 24
#: Links of a component that one task looks for communities in; in larger ones labels spread between tasks.
COMPONENT_LINKS = 20_000
#: Edges of a part that a task holds, queries of a task, and rows that it passes on at once, when energy spreads for many queries.
BLOCK_EDGES, QUERY_ROWS, WAITING_ROWS = 1 << 20, 1024, 1 << 15
#: What nodes may say of themselves besides id, type and label.
ATTRIBUTES = {"doc_id": "string", "doc_title": "string", "kind": "string", "glyph": "string", "hub": "string", "section": "string", "chunk_order": "int", "size": "int"}
EDGE_PHASE = {"CONTAINS": 0, "MENTIONS": 1, "RELATES_TO": 2, "REFERENCES": 3}


def as_nodes(df: DataFrame) -> DataFrame:
    """df with every attribute of a node, null where it has none, and the order it was written in."""
    return df.select("id", "type", "label", *(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in ATTRIBUTES.items()), "_seq")


def upsert_nodes(df: DataFrame) -> DataFrame:
    """One row per id: the attributes of the row written last (largest _seq)."""
    rest = [c for c in df.columns if c not in ("id", "_seq")]
    last = df.groupBy("id").agg(F.max_by(F.struct(*rest), "_seq").alias("_n"))
    return last.select("id", "_n.*")


def upsert_edges(df: DataFrame) -> DataFrame:
    """One edge per unordered pair: the kind written first (smallest _seq) and the largest weight; loops are left out."""
    pairs = df.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "kind", "weight", "_seq")
    return pairs.groupBy("u", "v").agg(F.min_by("kind", F.struct("_seq", "kind")).alias("kind"), F.max("weight").alias("weight"))


def section_id(doc: Column, depth: Column, path: Column) -> Column:
    return F.concat(F.lit("sec:"), doc, F.lit(":"), depth.cast("string"), F.lit(":"), T.slugify(F.array_join(path, " "), 50))


def section_chain(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk id, chunk_order, depth, path, node, parent) of each section above each chunk."""
    deep = chunks.where(F.size("section_path") > 0).select("doc_id", "id", "chunk_order", "section_path", F.explode(F.sequence(F.lit(1), F.size("section_path"))).alias("depth"))
    path = F.slice("section_path", F.lit(1), F.col("depth"))
    above = F.slice("section_path", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))
    parent = F.when(F.col("depth") == 1, F.concat(F.lit("doc:"), "doc_id")).otherwise(section_id(F.col("doc_id"), F.col("depth") - 1, above))
    return deep.select("doc_id", "id", "chunk_order", "depth", path.alias("path"), section_id(F.col("doc_id"), F.col("depth"), path).alias("node"), parent.alias("parent"))


def build_nodes(chunks: DataFrame) -> DataFrame:
    """Document, section, chunk and entity nodes of chunks; of equal ids the one written last stays.

    Null doc_ids and ids make no nodes; null titles, paths and entities count as empty.
    """
    c = known(chunks)
    docs = c.groupBy("doc_id").agg(F.min_by("doc_title", "chunk_order").alias("label")).select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.lit("doc").alias("type"), "label", "doc_id", F.struct(F.col("doc_id").alias("d"), F.lit(0).alias("o"), F.lit(0).alias("p")).alias("_seq"))
    sections = section_chain(c).select(F.col("node").alias("id"), F.lit("section").alias("type"), F.element_at("path", -1).alias("label"), "doc_id", F.array_join("path", " › ").alias("section"), F.struct(F.col("doc_id").alias("d"), F.col("chunk_order").alias("o"), F.col("depth").alias("p")).alias("_seq"))
    own = c.select("id", F.lit("chunk").alias("type"), T.truncate(F.col("text"), 56).alias("label"), "doc_id", "doc_title", "kind", F.array_join("section_path", " › ").alias("section"), "chunk_order", F.struct(F.col("doc_id").alias("d"), F.col("chunk_order").alias("o"), F.lit(0).alias("p")).alias("_seq"))
    named = c.select("doc_id", "chunk_order", F.posexplode("entities").alias("p", "label"))
    entities = named.select(F.concat(F.lit("ent:"), T.slugify(F.col("label"), 50)).alias("id"), F.lit("entity").alias("type"), "label", F.struct(F.col("doc_id").alias("d"), F.col("chunk_order").alias("o"), "p").alias("_seq"))
    every = as_nodes(docs).unionByName(as_nodes(sections)).unionByName(as_nodes(own)).unionByName(as_nodes(entities))
    return upsert_nodes(every)


def known(chunks: DataFrame) -> DataFrame:
    """Chunks with ids, null strings and arrays made empty."""
    none = F.array().cast("array<string>")
    arrays = {c: F.filter(F.coalesce(F.col(c), none), lambda x: x.isNotNull()) for c in ("section_path", "entities", "refs")}
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("doc_title", "section_title", "text")}
    return chunks.where(F.col("id").isNotNull() & F.col("doc_id").isNotNull()).withColumns({**arrays, **texts, "doc_id": F.col("doc_id").cast("string"), "chunk_order": F.coalesce(F.col("chunk_order"), F.lit(0))})


def references(chunks: DataFrame) -> DataFrame:
    """(u, v, weight) of chunks to what they refer to within their document, at most two targets a reference.

    A reference meets chunks of the section of exactly that title, else those of the first section whose title contains
    it, else the document whose title contains it.
    """
    c = known(chunks)
    refs = c.select("doc_id", "id", F.explode("refs").alias("ref")).select("doc_id", "id", F.lower(T.strip(F.col("ref"))).alias("key")).where(F.col("key") != "").distinct()
    titled = c.select("doc_id", F.lower(T.strip(F.col("section_title"))).alias("title"), F.col("id").alias("target"), F.col("chunk_order").alias("o")).where(F.col("title") != "")
    first = titled.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "title").orderBy("o", "target"))).where(F.col("n") <= 2)
    titles = first.groupBy("doc_id", "title").agg(F.min("o").alias("o"), F.sort_array(F.collect_list(F.struct("n", "target"))).alias("targets"))
    exact = refs.join(titles.withColumnRenamed("title", "key"), ["doc_id", "key"]).select("doc_id", "id", "key", "targets")
    rest = refs.join(exact.select("doc_id", "id", "key"), ["doc_id", "id", "key"], "left_anti")
    inside = rest.join(titles, "doc_id").where(F.contains("title", "key"))
    inside = inside.groupBy("doc_id", "id", "key").agg(F.min_by("targets", F.struct("o", "title")).alias("targets"))
    rest = rest.join(inside.select("doc_id", "id", "key"), ["doc_id", "id", "key"], "left_anti")
    docs = c.groupBy("doc_id").agg(F.lower(T.strip(F.min_by("doc_title", "chunk_order"))).alias("title"))
    whole = rest.join(docs, "doc_id").where(F.contains("title", "key")).select("doc_id", "id", "key", F.array(F.struct(F.lit(1).alias("n"), F.concat(F.lit("doc:"), "doc_id").alias("target"))).alias("targets"))
    found = exact.unionByName(inside).unionByName(whole).select("id", F.explode("targets.target").alias("target")).where(F.col("id") != F.col("target"))
    return found.select(F.col("id").alias("u"), F.col("target").alias("v"), F.lit(0.6).alias("weight")).distinct()


def build_edges(chunks: DataFrame, vectors: DataFrame | None = None, least: float = 0.32) -> DataFrame:
    """CONTAINS, MENTIONS, RELATES_TO and REFERENCES edges of chunks; vectors are (id, embedding), related within a document."""
    # read by every branch below: once, without the texts
    c = cut(known(chunks).select("id", "doc_id", "doc_title", "section_path", "section_title", "entities", "refs", "chunk_order", F.lit("").alias("text")))
    chain = section_chain(c)
    leaf = F.when(F.size("section_path") == 0, F.concat(F.lit("doc:"), "doc_id")).otherwise(section_id(F.col("doc_id"), F.size("section_path"), F.col("section_path")))
    contains = chain.select(F.col("parent").alias("u"), F.col("node").alias("v")).union(c.select(leaf, "id")).withColumn("weight", F.lit(1.0))
    mentions = c.select(F.col("id").alias("u"), F.explode("entities").alias("e")).select("u", F.concat(F.lit("ent:"), T.slugify(F.col("e"), 50)).alias("v"), F.lit(1.0).alias("weight"))
    parts = {"CONTAINS": contains, "MENTIONS": mentions, "REFERENCES": references(c)}
    if vectors is not None:
        parts["RELATES_TO"] = relates(vectors.join(c.select("id", "doc_id"), "id"), "doc_id", least)
    tagged = [df.select("u", "v", F.lit(kind).alias("kind"), "weight", F.lit(EDGE_PHASE[kind]).alias("_seq")) for kind, df in parts.items()]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df)
    return upsert_edges(every)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "kind", "weight").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "kind", "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree)."""
    return both_ways(edges).groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def spread(edges: DataFrame, seeds: DataFrame, decay: float = 0.6, hops: int = 2, least: float = MIN_GAIN, skip: tuple[str, ...] = ("CONTAINS", "BELONGS")) -> DataFrame:
    """(query_id, node, potential): energy of the seeds (query_id, node, energy) spread over the edges.

    A contribution is energy * weight * decay^hop, the first hop undecayed; one below `least` dies before it is summed.
    The next hop starts from this hop's sums. Null weights count as 0.5. The kinds to skip are filtered before any join.
    """
    carrying = carried(edges, skip)
    parts = hops_of(carrying, seeds, decay, hops, least)
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("query_id", "node").agg(F.sum("energy").alias("potential"))


def carried(edges: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    """(node, v, weight): the edges that carry energy, from either end."""
    return both_ways(edges.where(~F.coalesce("kind", F.lit("")).isin(*skip))).select(F.col("u").alias("node"), "v", F.coalesce("weight", F.lit(0.5)).alias("weight"))


def hops_of(carrying: DataFrame, seeds: DataFrame, decay: float, hops: int, least: float) -> list[DataFrame]:
    """What each of the first hops brings: (query_id, node, energy)."""
    strongest = F.broadcast(carrying.agg(F.max("weight").alias("_most")))  # one row
    frontier, parts = seeds.select("query_id", "node", "energy"), []
    for hop in range(hops):
        # what no edge could carry over the least gain doesn't fan out
        frontier = frontier.crossJoin(strongest).where(F.col("energy") * F.col("_most") * float(decay**hop) >= least).drop("_most")
        gain = F.col("energy") * F.col("weight") * float(decay**hop)
        frontier = frontier.join(carrying, "node").select("query_id", F.col("v").alias("node"), gain.alias("energy")).where(F.col("energy") >= least)
        frontier = frontier.groupBy("query_id", "node").agg(F.sum("energy").alias("energy"))
        parts.append(frontier)
    return parts


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x >= 0 rounded half up by its shortest decimal form, as Spark's round does."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    values, at = np.unique(x[near], return_inverse=True)
    out[near] = np.array([float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values.tolist()])[at] if len(near) else 0.0
    return out


def best_of(values: np.ndarray, top: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and rounded values of the `top` largest rounded values, ties by position."""
    at = np.arange(len(values))
    if len(values) > top:
        at = np.flatnonzero(values >= np.partition(values, -top)[-top] - 10.0**-digits)
    r = rounded(values[at], digits)
    first = np.lexsort((at, -r))[:top]
    return at[first], r[first]


def spread_many(edges: DataFrame, seeds: DataFrame, decay: float = 0.6, hops: int = 2, least: float = MIN_GAIN, skip: tuple[str, ...] = ("CONTAINS", "BELONGS"), digits: int = 4, top: int | None = None) -> DataFrame:
    """`spread` for many queries (least > 0), potentials rounded; with `top` at least the `top` highest of each query.

    The last hop fans out over hot nodes: its contributions are as many as queries times what a hot node is linked with.
    They are neither joined nor shuffled but summed in the task of their queries. The edges lie in the shared checkpoint
    folder once, parted by their targets; a task goes through the parts, and holds one of them and one query's sums of
    it. With `top` each part gives the `top` highest of a query, ties by node, so that the caller's ranking of what
    comes out is that of all nodes.
    """
    spark = edges.sparkSession
    carrying = carried(edges, skip)
    parts = [p.select("query_id", "node", F.lit(0.0).alias("energy"), F.col("energy").alias("potential")) for p in hops_of(carrying, seeds, decay, hops - 1, least)]
    given = parts[-1].withColumn("energy", F.col("potential")) if parts else seeds.select("query_id", "node", "energy", F.lit(0.0).alias("potential"))
    for p in parts[:-1]:
        given = given.unionByName(p)
    given = cut(given)
    n, asked = max(1, -(-carrying.count() // BLOCK_EDGES)), given.select("query_id").distinct().count()
    root = shared_folder(spark, "spread")
    factor, kind = float(decay ** (hops - 1)), StructType([given.schema["query_id"], given.schema["node"], StructField("potential", DoubleType())])

    def block(b: int, base: str, store: pa.fs.FileSystem, nodes: pa.Array) -> tuple[np.ndarray, ...] | None:
        """Targets and weights of the edges of each of the nodes, where they begin and end, the nodes as targets, the targets' sorted names."""
        if store.get_file_info(f"{base}/block={b}").type == pa.fs.FileType.NotFound:
            return None
        held = pq.read_table(f"{base}/block={b}", filesystem=store, partitioning=None, read_dictionary=["node", "v"], use_threads=False).unify_dictionaries().combine_chunks()
        node, v = (held.column(c).chunk(0) for c in ("node", "v"))
        order = pc.sort_indices(v.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        names = v.dictionary.take(pa.array(order))
        source = pc.fill_null(pc.index_in(node.dictionary, value_set=nodes), -1).to_numpy()[node.indices.to_numpy()]
        kept = np.flatnonzero(source >= 0)
        kept = kept[np.argsort(source[kept], kind="stable")]
        ends = np.searchsorted(source[kept], np.arange(len(nodes) + 1))
        own = pc.fill_null(pc.index_in(nodes, value_set=names), -1).to_numpy()
        return rank[v.indices.to_numpy()[kept]], held.column("weight").to_numpy()[kept], ends, own, names

    def work(batches):
        rows = [batch for batch in batches if batch.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows).combine_chunks()
        query, node = (rows.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "node"))
        order = np.argsort(query.indices.to_numpy(), kind="stable")
        at, energy, potential = node.indices.to_numpy()[order], rows.column("energy").to_numpy()[order], rows.column("potential").to_numpy()[order]
        firsts = np.searchsorted(query.indices.to_numpy()[order], np.arange(len(query.dictionary) + 1)).tolist()
        store, base = pa.fs.FileSystem.from_uri(root)
        for b in range(n):
            if (found := block(b, base, store, node.dictionary)) is None:
                continue
            targets, weights, ends, own, names = found
            waiting, size = [], 0
            for i in range(len(query.dictionary)):
                mine = slice(firsts[i], firsts[i + 1])
                here = own[at[mine]]
                to, gain = [here[here >= 0]], [potential[mine][here >= 0]]
                for j, e in zip(at[mine].tolist(), energy[mine].tolist()):
                    if ends[j] < ends[j + 1] and e > 0:
                        g = e * weights[ends[j] : ends[j + 1]] * factor
                        fine = g >= least
                        to.append(targets[ends[j] : ends[j + 1]][fine])
                        gain.append(g[fine])
                sums = np.bincount(np.concatenate(to), np.concatenate(gain), len(names))
                met = np.flatnonzero(sums)
                if top is None:
                    values = rounded(sums[met], digits)
                else:
                    best, values = best_of(sums[met], top, digits)
                    met = met[best]
                waiting.append((np.full(len(met), i), met, values))
                size += len(met)
                if size >= WAITING_ROWS or i + 1 == len(query.dictionary):
                    q, m, x = (np.concatenate(c) for c in zip(*waiting))
                    waiting, size = [], 0
                    for a in range(0, len(q), WAITING_ROWS):
                        s = slice(a, a + WAITING_ROWS)
                        yield pa.RecordBatch.from_arrays([query.dictionary.take(pa.array(q[s])), names.take(pa.array(m[s])), pa.array(x[s])], ["query_id", "node", "potential"])

    carrying.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")).repartition("block").write.partitionBy("block").parquet(root)
    return given.repartition(max(parallelism(spark), -(-asked // QUERY_ROWS)), "query_id").mapInArrow(work, kind)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, documents, sections, chunks, entities, hubs, agents."""
    of = {"documents": "doc", "sections": "section", "chunks": "chunk", "entities": "entity", "hubs": "hub", "agents": "agent"}
    by_type = nodes.agg(F.count(F.lit(1)).alias("nodes"), *(F.count_if(F.col("type") == t).alias(name) for name, t in of.items()))
    return by_type.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def inventory(nodes: DataFrame, edges: DataFrame, direct: bool = True) -> DataFrame:
    """(doc_id, title, sections, chunks) of each document, by lower-case title.

    With `direct` only what hangs on the document node itself is counted, as the listing is defined; else all of it.
    """
    docs = nodes.where(F.col("type") == "doc").select(F.col("id").alias("u"), "doc_id", F.col("label").alias("title"))
    if direct:
        near = both_ways(edges).select("u", F.col("v").alias("id")).join(nodes.select("id", "type"), "id")
        held = near.groupBy("u").agg(F.count_if(F.col("type") == "section").alias("sections"), F.count_if(F.col("type") == "chunk").alias("chunks"))
        joined = docs.join(held, "u", "left")
    else:
        held = nodes.where(F.col("type").isin("section", "chunk")).groupBy("doc_id").agg(F.count_if(F.col("type") == "section").alias("sections"), F.count_if(F.col("type") == "chunk").alias("chunks"))
        joined = docs.join(held, "doc_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "title", F.coalesce("sections", zero).alias("sections"), F.coalesce("chunks", zero).alias("chunks")).orderBy(F.lower("title"), "doc_id")


def snapshot(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, max_chunks: int = 180, hub: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to be drawn: of chunks the `max_chunks` of highest degree, then those of `hub`; edges with both ends drawn."""
    own = nodes.where(F.col("type").isin(*types)) if types else nodes
    ranked = own.where(F.col("type") == "chunk").join(degrees(edges), "id", "left").orderBy(F.coalesce("degree", F.lit(0)).desc(), "id").limit(max_chunks).drop("degree")
    drawn = own.where(F.col("type") != "chunk").unionByName(ranked.where(F.col("hub") == hub) if hub else ranked)
    ids = drawn.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi")
    return drawn, kept.select("u", "v", "kind", F.round("weight", 3).alias("weight"))


def remove_document(nodes: DataFrame, edges: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """The graph without a document's nodes, their edges, and entities nothing mentions any more."""
    left = nodes.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))
    ids = left.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi").select(*edges.columns)
    alone = left.where(F.col("type") == "entity").join(both_ways(kept).select(F.col("u").alias("id")).distinct(), "id", "left_anti").select("id")
    return left.join(alone, "id", "left_anti").select(*nodes.columns), kept


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id each node is connected with; labels spread and jump until none changes."""
    ends = cut(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    label = ends.select(F.col("u").alias("id")).distinct().withColumn("l", F.col("id"))
    while True:
        near = ends.join(label.select(F.col("id").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        lower = label.join(near.withColumnRenamed("u", "id"), "id").select("id", F.least("l", "m").alias("n"), "l")
        new = cut(lower.join(lower.select(F.col("id").alias("n"), F.col("n").alias("j")), "n").select("id", F.least("n", "j").alias("n"), "l"))
        done = new.where(F.col("n") < F.col("l")).limit(1).count() == 0
        label = new.select("id", F.col("n").alias("l"))
        if done:
            return label.select("id", F.col("l").alias("component"))


def greedy_modularity(links: list[tuple[str, str, float]], total: float) -> list[list[str]]:
    """Communities of one component: the adjacent pair of largest gain is merged while a merge gains; ties by the smaller names."""
    members: dict[str, list[str]] = {}
    near: dict[str, dict[str, float]] = {}
    for u, v, w in links:
        for a, b in ((u, v), (v, u)):
            members.setdefault(a, [a])
            near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + w
    strength = {n: sum(near[n].values()) for n in near}

    def gain(a: str, b: str) -> float:
        return near[a][b] / total - strength[a] * strength[b] / (2 * total * total)

    def entry(a: str, b: str) -> tuple[float, str, str]:
        return (-gain(a, b), min(a, b), max(a, b))

    heap = [entry(a, b) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    while heap and heap[0][0] < -1e-12:
        value, a, b = heapq.heappop(heap)
        if a not in near or b not in near[a] or entry(a, b)[0] != value:
            continue  # one of the two has changed since; its new entry is on the heap
        if len(near[a]) < len(near[b]):
            a, b = b, a
        members[a] += members.pop(b)
        strength[a] += strength.pop(b)
        for n, w in near.pop(b).items():
            near[n].pop(b)
            if n != a:
                near[a][n] = near[n][a] = near[a].get(n, 0.0) + w
        for n in near[a]:
            heapq.heappush(heap, entry(a, n))
    return [sorted(m) for m in members.values()]


def communities(links: DataFrame) -> DataFrame:
    """(id, community) of the nodes of (u, v, weight), by greedy modularity in each component.

    Components are found by spreading labels. One of at most COMPONENT_LINKS links is a task of its own; in a larger one
    each node takes the label of most weight around it, round by round, so that it never gathers in one task.
    """
    total = float(links.agg(F.sum("weight")).first()[0] or 1.0)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        found = greedy_modularity(list(zip(pdf["u"], pdf["v"], pdf["weight"])), total)
        return pd.DataFrame([(n, m[0]) for m in found for n in m], columns=["id", "community"])

    links = cut(links)
    if links.count() <= COMPONENT_LINKS:  # as small as a component may be: no need to part it
        return links.groupBy(F.lit(0).alias("component")).applyInPandas(work, "id string, community string")
    comp = cut(components(links))
    tagged = links.join(comp.withColumnRenamed("id", "u"), "u").select("component", "u", "v", "weight")
    size = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = tagged.join(size.where(F.col("n") <= COMPONENT_LINKS).select("component"), "component", "left_semi")
    large = cut(tagged.join(size.where(F.col("n") > COMPONENT_LINKS).select("component"), "component", "left_semi"))
    label = small.groupBy("component").applyInPandas(work, "id string, community string")
    return label.unionByName(spread_labels(large))


def spread_labels(links: DataFrame) -> DataFrame:
    """(id, community): each node takes the label with most weight around it and its own, ties to its own, then the smaller.

    In each round a half of the nodes that want another label take it, so that neighbours don't swap for ever; it ends
    when none wants one.
    """
    ends = cut(links.select("u", "v", "weight").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")))
    label, turn = cut(ends.select(F.col("u").alias("id")).distinct().withColumn("community", F.col("id"))), 0
    while True:
        votes = ends.join(label.select(F.col("id").alias("v"), "community"), "v").select(F.col("u").alias("id"), "community", "weight", F.lit(False).alias("own"))
        votes = votes.unionByName(label.select("id", "community", F.lit(0.5).alias("weight"), F.lit(True).alias("own")))
        votes = votes.groupBy("id", "community").agg(F.sum("weight").alias("w"), F.max("own").alias("own"))
        wanted = cut(votes.groupBy("id").agg(F.min_by("community", F.struct(-F.round("w", 9), ~F.col("own"), "community")).alias("wanted"), F.max(F.when(F.col("own"), F.col("community"))).alias("community")))
        if wanted.where(F.col("wanted") != F.col("community")).isEmpty():
            return label
        now = (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0) | (F.lit(turn) == 0)
        label, turn = cut(wanted.select("id", F.when(now, F.col("wanted")).otherwise(F.col("community")).alias("community"))), turn + 1


def hubs(nodes: DataFrame, edges: DataFrame, most: int = MAX_HUBS) -> DataFrame:
    """(hub_id, chunk_id): chunks by community over chunks and entities, at most `most` hubs, the largest first.

    Chunks without a link are communities of their own. While there are more than `most`, the smallest ones go to the
    community before them, by size and name, that they have most links with, and to the largest where they have none;
    links are counted anew after each round, which takes those of up to twice the least size.
    """
    chunks = nodes.where(F.col("type") == "chunk").select(F.col("id").alias("chunk_id"))
    ids = nodes.where(F.col("type").isin("chunk", "entity")).select("id")
    inner = edges.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v", "weight")
    inner = cut(inner)
    if inner.isEmpty():
        member = chunks.withColumn("community", F.col("chunk_id"))
    else:
        member = chunks.join(communities(inner).withColumnRenamed("id", "chunk_id"), "chunk_id", "left").select("chunk_id", F.coalesce("community", "chunk_id").alias("community"))
    member = cut(member)
    held = chunks.select(F.col("chunk_id").alias("u"))
    links = cut(inner.select("u", "v").join(held, "u", "left_semi").join(held.withColumnRenamed("u", "v"), "v", "left_semi"))  # only chunks are members
    while True:
        sizes = cut(member.groupBy("community").agg(F.count(F.lit(1)).alias("n")))
        if sizes.count() <= most:
            break
        member = cut(merge_small(member, sizes, links, most))
    ranks = sizes.select("community", F.row_number().over(Window.orderBy(F.col("n").desc(), "community")).alias("rank"))  # at most `most` rows
    return member.join(F.broadcast(ranks), "community").select(F.concat(F.lit("hub:"), F.col("rank").cast("string")).alias("hub_id"), "chunk_id")


def merge_small(member: DataFrame, sizes: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(chunk_id, community) with the smallest communities beyond the first `most` merged into others."""
    first = sizes.orderBy(F.col("n").desc(), "community").limit(most).collect()  # at most `most` rows
    last, top = first[-1], first[0]["community"]
    behind = (F.col("n") < last["n"]) | (F.col("n") == last["n"]) & (F.col("community") > last["community"])
    least = sizes.where(behind).agg(F.min("n")).first()[0]
    going = behind & (F.col("n") <= 2 * least)
    of = member.join(sizes, "community")
    a = of.select(F.col("chunk_id").alias("u"), F.col("community").alias("ca"), F.col("n").alias("na"), going.alias("goes"))
    b = of.select(F.col("chunk_id").alias("v"), F.col("community").alias("cb"), F.col("n").alias("nb"))
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    before = (F.col("nb") > F.col("na")) | (F.col("nb") == F.col("na")) & (F.col("cb") < F.col("ca"))
    scores = both.join(a.where("goes"), "u").join(b, "v").where(before).groupBy("ca", "cb", "nb").agg(F.count(F.lit(1)).alias("score"))
    best = scores.groupBy("ca").agg(F.min_by("cb", F.struct(-F.col("score"), -F.col("nb"), "cb")).alias("to"))
    to = cut(sizes.where(going).select(F.col("community").alias("ca")).join(best, "ca", "left").select("ca", F.coalesce("to", F.lit(top)).alias("to")))
    while True:  # where a target goes itself, on to its own target
        on = to.select(F.col("ca").alias("to"), F.col("to").alias("on"))
        joined = to.join(on, "to", "left")
        if joined.where(F.col("on").isNotNull()).isEmpty():
            break
        to = cut(joined.select("ca", F.coalesce("on", "to").alias("to")))
    return member.join(to.withColumnRenamed("ca", "community"), "community", "left").select("chunk_id", F.coalesce("to", "community").alias("community"))


def agents(spark: SparkSession) -> DataFrame:
    rows = [(i, "agent", label, glyph) for i, label, glyph in AGENTS]
    df = spark.createDataFrame(rows, "id string, type string, label string, glyph string").withColumn("_seq", F.lit(0))
    return as_nodes(df).drop("_seq")


def hub_nodes(members: DataFrame) -> DataFrame:
    number = F.substring("hub_id", 5, 10).cast("int")
    names = F.array(*(F.lit(g) for g in GREEK))
    own = members.groupBy("hub_id").agg(F.count(F.lit(1)).cast("int").alias("size"))
    rows = own.select(F.col("hub_id").alias("id"), F.lit("hub").alias("type"), F.concat(F.lit("Neuropil Hub "), F.element_at(names, (number - 1) % len(GREEK) + 1)).alias("label"), "size", F.lit(0).alias("_seq"))
    return as_nodes(rows).drop("_seq")


def hub_edges(members: DataFrame) -> DataFrame:
    """BELONGS of chunks, SENSES and GATES of hubs, DRIVES and REFLECTS between agents."""
    spark = members.sparkSession
    belongs = members.select(F.col("chunk_id").alias("u"), F.col("hub_id").alias("v"), F.lit("BELONGS").alias("kind"), F.lit(1.0).alias("weight"))
    wired = members.select("hub_id").distinct()
    ends = F.explode(F.array(F.struct(F.lit("agent:sensory").alias("a"), F.lit("SENSES").alias("k")), F.struct(F.lit("agent:circuits").alias("a"), F.lit("GATES").alias("k"))))
    sensed = wired.select("hub_id", ends.alias("e")).select(F.col("e.a").alias("u"), F.col("hub_id").alias("v"), F.col("e.k").alias("kind"), F.lit(0.6).alias("weight"))
    fixed = spark.createDataFrame([("agent:circuits", "agent:synthesist", "DRIVES", 0.9), ("agent:synthesist", "agent:critic", "REFLECTS", 0.9)], "u string, v string, kind string, weight double")
    every = belongs.unionByName(sensed).unionByName(fixed).withColumn("_seq", F.lit(0))
    return upsert_edges(every)


def positions(nodes: DataFrame, edges: DataFrame, width: float = 640.0, height: float = 440.0, rounds: int = 6) -> DataFrame:
    """(id, x, y): a layout for drawing. Places start from a hash of the id and move to the mean of their neighbours.

    Presentation only: seeded, the same for the same graph, scaled to the largest distance, rounded to one decimal.
    """
    h = F.xxhash64("id", F.lit(42))
    place = nodes.select("id", (F.pmod(h, F.lit(20011)) / 10005.0 - 1).alias("x"), (F.pmod(F.shiftright(h, 20), F.lit(20011)) / 10005.0 - 1).alias("y"))
    ends = both_ways(edges).select(F.col("u").alias("id"), F.col("v").alias("o"))
    for _ in range(rounds):
        around = ends.join(place.withColumnRenamed("id", "o"), "o").groupBy("id").agg(F.avg("x").alias("ax"), F.avg("y").alias("ay"))
        moved = place.join(around, "id", "left")
        place = cut(moved.select("id", F.coalesce((F.col("x") + F.col("ax")) / 2, "x").alias("x"), F.coalesce((F.col("y") + F.col("ay")) / 2, "y").alias("y")))
    box = place.agg(F.greatest(F.max(F.abs("x")), F.lit(1e-9)).alias("mx"), F.greatest(F.max(F.abs("y")), F.lit(1e-9)).alias("my"))
    return place.crossJoin(F.broadcast(box)).select("id", F.round(F.col("x") / F.col("mx") * width, 1).alias("x"), F.round(F.col("y") / F.col("my") * height, 1).alias("y"))  # box: one row

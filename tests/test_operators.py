"""Parsers, chunks, vectors, graph and gate against their definitions on small inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from evigraph.config import Settings
from evigraph.operators import chunking, embedding, graph, retrieval, vectors
from evigraph.sources import connectors, web
from evigraph.sources.parse import parse_files, parse_source, read_html, read_markdown, read_text

MD = """# Fly Brain

## Motion
T4 neurons detect motion. They are fast.

| Cell | Role |
| --- | --- |
| T4 | motion |

## Odor
```python
x = 1
```
- one
- two
"""


def test_markdown():
    doc = read_markdown(MD, "stem")
    assert doc.title == "Fly Brain"
    assert [(b[2], b[0][-1]) for b in doc.blocks] == [("text", "Motion"), ("table", "Motion"), ("code", "Odor"), ("list", "Odor")]
    assert doc.blocks[1][3] == "Cell | Role\nT4 | motion"


def test_text_blocks_agree_with_the_parser(spark):
    texts = ["INTRO\nfirst line\nsecond\n\n1. Methods\npara one\n\npara two\nRESULTS.\nend", "", "no heading here\n\n\nat all", "\r\nA B\r\nx"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = chunking.text_blocks(df, "k", "t").orderBy("k", "block").collect()
    for k, t in enumerate(texts):
        want = [(b[0], b[3]) for b in read_text(t, "s").blocks]
        assert [(r["path"], r["text"]) for r in rows if r["k"] == k] == want


def test_html_skips_furniture_and_merges_lists():
    doc = read_html("<html><title>T</title><body><nav><p>menu</p></nav><h1>Head</h1><p>Some <b>text</b></p><ul><li>a<li>b</ul><table><tr><td>1</td><th>2</th></tr></table></body></html>", "s")
    assert doc.title == "T" and [(b[2], b[3]) for b in doc.blocks] == [("text", "Some text"), ("list", "a\nb"), ("table", "1 | 2")]
    assert doc.blocks[0][0] == ["Head"]


def test_dispatch_and_fallback():
    assert parse_source("a.csv", b"a,b\n1,2\n").kind == "csv"
    assert parse_source("a.json", b'{"k":[1,2]}').blocks[0][0] == ["k", "k (list, 2 items)"]
    assert parse_source("a.json", b"{bad").warnings
    assert parse_source("plain", b"A sentence.").kind == "text"
    assert parse_source("x.pdf", b"not a pdf").kind == "raw"


def test_parse_files_null_and_empty(spark):
    df = spark.createDataFrame([("a.md", None, None), ("b.txt", bytearray(b""), None), ("c.txt", bytearray(b"hi"), None)], "name string, content binary, url string")
    assert [r["text"] for r in parse_files(df).collect()] == ["hi"]


def windows(sentences, most, overlap):
    out, cur, size = [], [], 0
    for s in sentences:
        if cur and size + len(s) > most:
            out.append(" ".join(cur))
            cur = (cur[-overlap:] if overlap else []) + [s]
            size = sum(map(len, cur)) + len(cur)
        else:
            cur.append(s)
            size += len(s)
    return out + [" ".join(cur)] if cur else out


def test_sentence_windows(spark):
    rng = random.Random(3)
    lists = [[f"S{'x' * rng.randint(1, 60)}." for _ in range(rng.randint(1, 15))] for _ in range(30)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lists)], "k int, t string")
    for overlap in (0, 1, 2):
        got = {r["k"]: r["w"] for r in df.select("k", chunking.sentence_windows(F.col("t"), F.lit(100), F.lit(overlap)).alias("w")).collect()}
        assert all(got[i] == windows(x, 100, overlap) for i, x in enumerate(lists))


def test_chunks(spark):
    blocks = parse_files(spark.createDataFrame([("a.md", bytearray(MD.encode()), None)], "name string, content binary, url string")).withColumn("doc_id", F.lit("d1"))
    rows = chunking.chunk_blocks(blocks).orderBy("chunk_order").collect()
    assert [r["kind"] for r in rows] == ["text", "table", "code", "list"]
    assert rows[0]["id"] == "chunk:d1:0000" and rows[0]["section_path"] == ["Fly Brain", "Motion"]
    assert len({r["content_hash"] for r in rows}) == 4


def test_embedding_modes_agree(spark):
    df = spark.createDataFrame([(1, "fly optic lobe motion motion"), (2, ""), (3, None)], "k int, t string")
    dense = {r["k"]: np.array(r["embedding"]) for r in embedding.embed(df, "k", "t", 64).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in dense.values()) and len(dense) == 3
    sparse = np.zeros(64)
    for r in embedding.bucket_weights(df, "k", "t", 64).collect():
        sparse[r["bucket"]] = r["weight"]
    assert np.allclose(sparse, dense[1], atol=1e-6)


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(50, 8))
    m[7] = m[3]
    rows = [(f"v{i:02d}", m[i].tolist()) for i in range(50)] + [("null", None), ("short", [1.0])]
    v = spark.createDataFrame(rows, "id string, embedding array<double>")
    q = spark.createDataFrame([("a", m[3].tolist()), ("b", m[9].tolist()), ("c", None)], "query_id string, query_vector array<double>")
    got = vectors.top_k(v, q, 5).orderBy("query_id", "rank").collect()
    for name, i in (("a", 3), ("b", 9)):
        want = sorted(range(50), key=lambda j: (-(m[i] @ m[j]), j))[:5]
        assert [r["id"] for r in got if r["query_id"] == name] == [f"v{j:02d}" for j in want]
    assert vectors.top_k(v.limit(0), q, 5).count() == 0 and vectors.top_k(v, q.limit(0), 5).count() == 0


def test_relates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "RELATE_BLOCK", 7)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"c{i:02d}", "d" if i < 30 else "e", m[i].tolist()) for i in range(40)], "id string, doc string, embedding array<double>")
    got = {(r["u"], r["v"]) for r in vectors.relates(df, "doc", 0.2).collect()}
    want = set()
    for i in range(40):
        same = [j for j in range(40) if j != i and (j < 30) == (i < 30)]
        for j in sorted(same, key=lambda j: (-(m[i] @ m[j]), j))[:2]:
            if m[i] @ m[j] >= 0.2:
                want.add((f"c{min(i, j):02d}", f"c{max(i, j):02d}"))
    assert got == want


def test_upsert_and_remove(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 4)], "id string, x int")
    assert sorted(tuple(r) for r in vectors.upsert(old, new).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_spread(spark):
    edges = spark.createDataFrame([("a", "b", "RELATES_TO", 0.9), ("b", "c", "RELATES_TO", 0.9), ("a", "z", "CONTAINS", 1.0)], "u string, v string, kind string, weight double")
    seeds = spark.createDataFrame([("q", "a", 1.0)], "query_id string, node string, energy double")
    got = {r["node"]: r["potential"] for r in graph.spread(edges, seeds, 0.5).collect()}
    assert abs(got["b"] - 0.9) < 1e-9 and abs(got["c"] - 0.405) < 1e-9 and "z" not in got
    weak = seeds.withColumn("energy", F.lit(0.02))
    assert graph.spread(edges, weak, 0.5).count() == 0


def chunk_rows(spark):
    rows = [("c1", "d1", "Doc", ["A"], "A", "text one", "text", 3, ["Lobula Plate"], ["B"], "", 0, "h"), ("c2", "d1", "Doc", ["B"], "B", "text two", "text", 3, ["Lobula Plate", None], None, "", 1, "h"), ("c3", "d2", "Other", None, None, None, None, None, None, ["doc"], "", None, None)]
    from evigraph.plans.engine import CHUNK

    return spark.createDataFrame(rows, CHUNK)


def test_graph_of_chunks_with_nulls(spark):
    chunks = chunk_rows(spark)
    nodes, edges = graph.build_nodes(chunks), graph.build_edges(chunks)
    by_type = {r["type"]: r["count"] for r in nodes.groupBy("type").count().collect()}
    assert by_type == {"doc": 2, "section": 2, "chunk": 3, "entity": 1}
    kinds = {(r["u"], r["v"]): r["kind"] for r in edges.collect()}
    assert kinds[("c1", "c2")] == "REFERENCES" and kinds[("c1", "ent:lobula-plate")] == "MENTIONS"
    left, kept = graph.remove_document(nodes, edges, "d1")
    assert {r["id"] for r in left.collect()} == {"doc:d2", "c3"} and kept.count() == 1


def test_edge_upsert_keeps_first_kind_and_largest_weight(spark):
    raw = spark.createDataFrame([("b", "a", "X", 0.2, 1), ("a", "b", "Y", 0.9, 2), ("a", "a", "Z", 1.0, 0)], "u string, v string, kind string, weight double, _seq int")
    assert [tuple(r) for r in graph.upsert_edges(raw).collect()] == [("a", "b", "X", 0.9)]


def test_communities(spark, monkeypatch):
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0", 0.1), ("c0", "c1", 1.0)]
    links = spark.createDataFrame([(min(u, v), max(u, v), w) for u, v, w in rows], "u string, v string, weight double")
    for limit in (20_000, 5):
        monkeypatch.setattr(graph, "COMPONENT_LINKS", limit)
        groups = {}
        for r in graph.communities(links).collect():
            groups.setdefault(r["community"], set()).add(r["id"])
        assert {frozenset(g) for g in groups.values()} == {frozenset(f"a{i}" for i in range(4)), frozenset(f"b{i}" for i in range(4)), frozenset({"c0", "c1"})}


def test_hubs_are_a_partition_within_the_limit(spark):
    n = [(f"k{i}", "chunk", "") for i in range(30)] + [("ent:x", "entity", "")]
    nodes = spark.createDataFrame(n, "id string, type string, label string")
    edges = spark.createDataFrame([("ent:x", f"k{i}", "MENTIONS", 1.0) for i in range(5)], "u string, v string, kind string, weight double")
    rows = graph.hubs(nodes, edges, 4).collect()
    assert sorted(r["chunk_id"] for r in rows) == sorted(f"k{i}" for i in range(30)) and len({r["hub_id"] for r in rows}) <= 4


def test_gate_fold_capacity_and_inhibition(spark):
    c = [("q", f"c{i}", i + 1, 0.9 - 0.1 * i, 1.0, 0.0, [], "T4 fires at 120 Hz.") for i in range(5)]
    df = spark.createDataFrame(c, "query_id string, id string, rank int, sim double, lexical double, graph_boost double, entities array<string>, text string")
    tokens = spark.createDataFrame([("q", ["t4"])], "query_id string, query_tokens array<string>")
    out = retrieval.fire(df, tokens, Settings(gating_threshold=0.2, top_k=2)).first()["verdicts"]
    assert [v["fired"] for v in out] == [True, True, False, False, False]
    assert out[2]["reason"] == "suppressed: context capacity reached" and out[1]["tag"] == "S2"


def test_contradiction_is_suppressed_only_when_asked(spark):
    c = [("q", "a", 1, 0.9, 0.0, 0.0, [], "the rate is 120 spikes"), ("q", "b", 2, 0.8, 0.0, 0.0, [], "the rate is 80 spikes")]
    df = spark.createDataFrame(c, "query_id string, id string, rank int, sim double, lexical double, graph_boost double, entities array<string>, text string")
    tokens = spark.createDataFrame([("q", ["rate"])], "query_id string, query_tokens array<string>")
    s = Settings(gating_threshold=0.1, lateral_inhibition=0.0)
    fired = lambda s: [v["fired"] for v in retrieval.fire(df, tokens, s).first()["verdicts"]]
    assert fired(s) == [True, True]
    conflicted = retrieval.fire(df, tokens, Settings(gating_threshold=0.2, lateral_inhibition=0.0, conflict_against_fired=True)).first()["verdicts"]
    assert conflicted[1]["components"]["conflict"] == -0.3


def test_loose_json_and_batches():
    assert connectors.loose_json('say {bad} then {"a": "}", "b": 1} end') == {"a": "}", "b": 1}
    assert connectors.loose_json("none") is None and connectors.loose_json(None) is None
    assert [len(b) for b in connectors.batches(range(130), 64)] == [64, 64, 2]
    pages = {None: ([{"id": 1}], "c"), "c": ([{"id": 2}], None)}
    assert [r["id"] for r in connectors.scroll(lambda cur, n: pages[cur])] == [1, 2]


def test_scheme(spark):
    df = spark.createDataFrame([("http://a.b",), ("HTTPS://x/y",), ("ftp://a",), (None,), ("file.md",)], "u string")
    assert [r[0] for r in df.select(web.fetchable(F.col("u"))).collect()] == [True, True, False, False, False]
    try:
        web.fetch("ftp://a")
        raise AssertionError
    except ValueError:
        pass


def test_small_hubs_go_to_the_largest_or_where_their_links_are(spark):
    big = [(f"a{i}", f"a{i + 1}", 1.0) for i in range(5)] + [("b0", "b1", 1.0), ("b1", "b2", 1.0)]
    nodes = spark.createDataFrame([(n, "chunk") for n in sorted({x for u, v, _ in big for x in (u, v)} | {"x", "y"})], "id string, type string")
    edges = spark.createDataFrame([(u, v, "RELATES_TO", w) for u, v, w in big], "u string, v string, kind string, weight double")
    found = {r["chunk_id"]: r["hub_id"] for r in graph.hubs(nodes, edges, 2).collect()}
    assert found["x"] == found["y"] and len(set(found.values())) == 2
    sizes = sorted((list(found.values()).count(h) for h in set(found.values())), reverse=True)
    assert found["x"] == "hub:1" and sizes[0] >= 5 and found["b0"] == found["b1"] == found["b2"]


def test_labels_settle(spark):
    ring = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i in range(5) for j in range(i)] + [("a0", "b0", 0.1), ("b1", "c1", 0.1)]
    found = {r["id"]: r["community"] for r in graph.spread_labels(spark.createDataFrame(ring, "u string, v string, weight double")).collect()}
    assert len(set(found.values())) == 3 and all(len({found[f"{g}{i}"] for i in range(5)}) == 1 for g in "abc")


def test_spread_of_many_queries_shuffles_no_contribution(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_EDGES", 1500)
    monkeypatch.setattr(graph, "WAITING_ROWS", 700)
    links = [(f"c{i:04d}", "ent:hot", "MENTIONS", 1.0) for i in range(3000)] + [(f"c{i:04d}", f"ent:{i % 40}", "MENTIONS", 0.9) for i in range(3000)]
    links += [(f"c{i:04d}", f"c{i * 7 % 3000:04d}", "RELATES_TO", 0.4 + i % 50 / 100) for i in range(500)] + [("a", "b", "CONTAINS", 1.0), ("c0001", "d", None, None)]
    edges = spark.createDataFrame(links, "u string, v string, kind string, weight double").cache()
    seeds = spark.createDataFrame([(f"q{i}", f"c{i * j % 3000:04d}", 0.05 + j / 3.7) for i in range(200) for j in (1, 2, 3)] + [("none", "nowhere", 1.0), ("weak", "c0000", 0.01)], "query_id string, node string, energy double").cache()
    want = {(r["query_id"], r["node"]): r["potential"] for r in graph.spread(edges, seeds).collect()}
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    rows = graph.spread_many(edges, seeds).collect()
    assert written() - before < 2_000_000 and len(want) > 500_000
    got = {(r["query_id"], r["node"]): r["potential"] for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.0001 for k in want)
    ranked = lambda found: {q: sorted((-p, n) for (a, n), p in found.items() if a == q)[:12] for q in ("q0", "q1", "q77", "q199")}
    assert ranked({(r["query_id"], r["node"]): r["potential"] for r in graph.spread_many(edges, seeds, top=12).collect()}) == ranked(got)


def test_highest_of_many_queries_are_few_rows_with_ties_by_node(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_EDGES", 3000)
    edges = spark.createDataFrame([(f"c{i:04d}", "ent:hot", "MENTIONS", 1.0) for i in range(4000)], "u string, v string, kind string, weight double")
    seeds = spark.createDataFrame([(f"q{i}", f"c{i * 9:04d}", 0.5) for i in range(50)], "query_id string, node string, energy double")
    rows = [(r["query_id"], r["node"], r["potential"]) for r in graph.spread_many(edges, seeds, top=12).collect()]
    assert len(rows) <= 50 * 12 * 3
    for q in ("q0", "q49"):
        assert sorted((-p, n) for a, n, p in rows if a == q)[:12] == [(-0.5, "ent:hot"), *((-0.3, f"c{i:04d}") for i in range(11))]


def test_rounding_is_that_of_spark(spark):
    x = [0.00005, 0.12345, 0.56695, 1.00015, 2.5, 0.1 + 0.2, 0.00014999999999, 1.0000499999999999, 0.61475 * 0.6]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 4)).collect()]
    assert graph.rounded(np.array(x), 4).tolist() == want


def test_relation_of_batches_cut_by_arrow(spark, monkeypatch):
    monkeypatch.setattr(vectors, "RELATE_BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(f"k{i:03d}", f"d{int(i ** 0.5)}" if i < 300 else "large", rng.normal(size=8).tolist()) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r["u"], r["v"]): r["weight"] for r in vectors.relates(spark.createDataFrame(rows, "id string, doc string, embedding array<double>"), "doc", -100.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, d, v in rows:
        near = sorted((-float(np.dot(v, w)), o) for o, e, w in rows if e == d and o != k)[:2]
        want |= {(min(k, o), max(k, o)): -s for s, o in near}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)

"""The engine end to end, and streams."""

import time

import pytest
from pyspark.sql import functions as F

from evigraph.config import Settings
from evigraph.plans.engine import Engine
from evigraph.streaming import events as ev

SAMPLE = b"""# Fly Optic Lobe

## Motion Pathway
T4 neurons detect motion in the optic lobe of the fly. The Lobula Plate combines signals from T4 neurons at 120 spikes per second.

## Odor Pathway
Kenyon cells in the Mushroom Body encode odor identity sparsely. See section Motion Pathway.
"""


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), Settings(gating_threshold=0.40, recall_k=12, top_k=4, embed_dim=256))
    e.files = spark.createDataFrame([("a.md", bytearray(SAMPLE), None), ("empty.txt", bytearray(b""), None)], "name string, content binary, url string")
    e.first = e.ingest(e.files).collect()
    return e


def test_ingest_is_idempotent(engine):
    assert len(engine.first) == 1 and engine.first[0]["chunks"] == 2 and engine.first[0]["sections"] == 3
    assert engine.ingest(engine.files).count() == 0
    assert engine.store.read("chunks").count() == 2


def test_grounded_answer(engine):
    r = engine.query("How do T4 neurons detect motion in the optic lobe?")
    assert r["grounded"] and r["fired"] >= 1 and r["tags"] and all(int(t[1:]) <= r["fired"] for t in r["tags"])
    assert {e["type"] for e in engine.events(30).collect()} >= {"run_start", "gate", "run_end", "ingest"}


def test_the_record_of_a_question(engine):
    r = engine.query("How do T4 neurons detect motion in the optic lobe?")
    assert [c["tag"] for c in r["citations"]] == [f"S{i + 1}" for i in range(r["fired"])] and all(c["text"] and c["section"] for c in r["citations"])
    assert len(r["verdicts"]) == r["fired"] + r["suppressed"] == r["candidates"] and r["provider"] == "extractive"
    assert 0 < len(r["potentials"]) <= 12 and r["potentials"][0]["potential"] == max(p["potential"] for p in r["potentials"])
    own = [e["type"] for e in engine.events(300).collect() if e["run_id"] == r["run_id"]]
    assert own.count("gate") == r["candidates"] and own.count("run_end") == 1 and "spike" in own


def test_refusals_and_files_of_one_name(spark, tmp_path):
    e = Engine(spark, str(tmp_path), Settings(embed_dim=64, max_upload_bytes=100))
    files = [("readme.md", b"# A\nThe retina adapts."), ("readme.md", b"# B\nThe antenna rests."), ("none.txt", b""), ("big.txt", b"x" * 101), ("blank.txt", b" \n ")]
    done = e.ingest(spark.createDataFrame([(n, bytearray(c), None) for n, c in files], "name string, content binary, url string")).collect()
    assert {r["title"] for r in done} == {"A", "B"} and all(r["chunks"] == 1 for r in done)
    assert {(r["name"], r["reason"]) for r in e.refusals().collect()} == {("none.txt", "empty file"), ("big.txt", "larger than 100 bytes"), ("blank.txt", "no text in it")}
    assert {r["text"] for r in e.store.read("chunks").collect()} == {"The retina adapts.", "The antenna rests."}


def test_vectors_of_another_kind_are_made_anew(spark, tmp_path):
    files = spark.createDataFrame([("a.md", bytearray(SAMPLE), None)], "name string, content binary, url string")
    Engine(spark, str(tmp_path), Settings(embed_dim=64)).ingest(files)
    e = Engine(spark, str(tmp_path), Settings(embed_dim=96, hash_kind="blake2b"))
    e.reembed()
    rows = e.store.read("vectors").collect()
    assert len(rows) == 2 and {(len(r["embedding"]), r["embed_kind"]) for r in rows} == {(96, "blake2b")}


def test_the_loop_ends_by_its_setting(spark, engine):
    wrong = lambda answers, fired: answers.select("query_id", "answer", F.lit(False).alias("grounded"), F.lit(0.0).alias("score"), F.lit("no").alias("note"))
    asked = spark.createDataFrame([("q", "How do T4 neurons detect motion in the optic lobe?")], "query_id string, query string")
    for most in (0, 1, 3):
        s = Settings(gating_threshold=0.40, recall_k=12, top_k=4, embed_dim=256, critic_mode="llm", max_reflection_loops=most)
        e = Engine(spark, engine.store.folder, s, audit=wrong)
        r = e.answers(asked).first()
        assert r["loops"] == most and not r["grounded"]


def test_no_evidence(engine):
    r = engine.query("quantum chess openings in zero gravity")
    assert r["answer"] == "" and r["grounded"] and "no signal crossed the firing threshold" in r["error"]


def test_blank_question(engine):
    for q in ("", "   ", "x" * 2001):
        with pytest.raises(ValueError):
            engine.query(q)


def test_graph_and_delete(engine):
    drawn = engine.graph(["doc", "chunk"])
    assert drawn["nodes"].count() == 3
    assert engine.system()["counts"]["documents"] == 1
    assert not engine.delete("nothing")
    assert engine.delete(engine.first[0]["doc_id"]) and engine.documents().count() == 0
    engine.reset()
    assert engine.system()["counts"]["nodes"] == 4


def test_capped_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(20).select(F.col("id").alias("event_id"), (F.col("id") % 2).alias("run"), F.lit("spike").alias("type")).write.parquet(str(src))
    stream = spark.readStream.schema("event_id long, run long, type string").parquet(str(src))
    q = ev.capped_stream(stream, "run", 3).writeStream.format("memory").queryName("capped").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(60):  # state with a timer keeps the query running, so it is never idle
        if spark.table("capped").count() >= 6:
            break
        time.sleep(1)
    q.stop()
    assert spark.table("capped").groupBy("run").count().collect() and all(r["count"] == 3 for r in spark.table("capped").groupBy("run").count().collect())


def test_windowed_stream_equals_batch(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ev.windowed(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {r["window"]["start"]: r["n"] for r in ev.windowed(rows).collect()}
    assert {r["window"]["start"]: r["n"] for r in spark.table("windowed").collect()} == batch

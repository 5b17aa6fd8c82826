"""Golden values of the lexical functions and the gate."""

import math

from pyspark.sql import functions as F

from evigraph.functions import gate
from evigraph.functions import text as T


def one(spark, col, **given):
    row = spark.createDataFrame([tuple(given.values()) or ("x",)], list(given) or ["x"])
    return row.select(col.alias("r")).first()["r"]


def test_tokenize(spark):
    assert one(spark, T.tokenize(F.col("t")), t="T4 neurons fire 120 spikes") == ["t4", "neurons", "fire", "120", "spikes"]
    assert one(spark, T.tokenize(F.col("t")), t="the a of 1,200.5 x") == ["1,200.5"]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",)], "t string")
    for f in (T.tokenize, T.sentence_split, T.extract_entities, T.extract_refs, T.claims):
        assert [r[0] for r in df.select(f(F.col("t"))).collect()] == [[], [], []]
    assert [r[0] for r in df.select(T.slugify(F.col("t"))).collect()] == ["x", "x", "x"]


def test_sentences(spark):
    assert one(spark, T.sentence_split(F.col("t")), t=" Motion flows. T4 neurons fire. Then what? ") == ["Motion flows.", "T4 neurons fire.", "Then what?"]


def test_slug_and_truncate(spark):
    assert one(spark, T.slugify(F.col("t")), t="Optic Lobe Circuits!") == "optic-lobe-circuits"
    cut = one(spark, T.truncate(F.col("t"), 10), t="x" * 50)
    assert len(cut) == 10 and cut.endswith("…")


def test_overlap(spark):
    q = F.array(F.lit("motion"), F.lit("detector"))
    assert abs(one(spark, T.lexical_overlap(q, T.token_set(F.col("t"))), t="a motion detector circuit") - 2 / (math.sqrt(2) + 1)) < 1e-9
    none = F.array().cast("array<string>")
    assert one(spark, T.lexical_overlap(none, T.token_set(F.col("t"))), t="motion") == 0.0


def test_entities_and_refs(spark):
    text = "The Lobula Plate responds. GABA and OK. See section Odor Pathway, and [Kenyon Cells](#odor-coding)."
    found = one(spark, T.extract_entities(F.col("t")), t=text)
    assert "GABA" in found and "Kenyon Cells" in found and "OK" not in found
    refs = one(spark, T.extract_refs(F.col("t")), t=text)
    assert any("Odor" in r for r in refs) and "odor coding" in refs


def test_gate(spark):
    def v(sim, lex, ent, lat=0.0, conflict=0.0):
        return one(spark, gate.verdict(*(F.lit(x) for x in (sim, lex, ent, lat, conflict)), 0.35, 0.55))

    assert v(0.9, 0.6, 0.5)["fired"] and abs(v(0.9, 0.6, 0.5)["potential"] - 0.745) < 1e-9
    assert abs(v(0.8, 0.6, 0.5)["potential"] - 0.69) < 1e-9
    low = v(0.8, 0.6, 0.5, 0.8)
    assert not low["fired"] and abs(low["potential"] - 0.41) < 1e-9 and "lateral" in low["reason"]
    assert "sub-threshold" in v(0.1, 0.0, 0.0)["reason"]
    assert "contradiction" in v(0.0, 0.0, 0.0, 0.0, 2.0)["reason"]


def test_numeric_conflict(spark):
    def c(a, b):
        return one(spark, gate.numeric_conflict(T.claim_map(F.col("a")), F.array(T.claim_map(F.col("b")))), a=a, b=b)

    assert c("the rate is 80 spikes", "the rate is 120 spikes") == 1.0
    assert c("the rate is 120 spikes", "the rate is 120 spikes") == 0.0
    assert c("no numbers here", "none at all") == 0.0


def test_grounding(spark):
    def g(answer, *texts):
        return one(spark, gate.grounding(F.col("a"), F.array(*(F.lit(t) for t in texts))), a=answer)

    good = g("T4 neurons detect motion. [S1]", "T4 neurons detect motion.")
    assert good["grounded"] and good["support"] == 1.0
    assert "numeric hallucination" in g("T4 fires at 999 Hz. [S1]", "T4 fires at 120 Hz.")["note"]
    assert not g("", "anything")["grounded"]


def test_tags_need_a_source(spark):
    assert one(spark, T.extract_tags(F.col("t"), F.lit(2)), t="a [S1] b [S2] c [S1] d [S9] [S99999999999]") == ["S1", "S2"]


def test_source_kinds(spark):
    names = {"a.md": "markdown", "a.LOG": "text", "a.csv": "csv", "a.json": "json", "a.pdf": "pdf", "a.htm": "html", "a": "text"}
    for n, k in names.items():
        assert one(spark, T.source_kind(F.col("n"), F.lit("x")), n=n) == k
    assert one(spark, T.source_kind(F.col("n"), F.lit("<!DOCTYPE html><p>")), n="page") == "html"


def test_zero_contradicts_nothing(spark):
    def conflict(a, b):
        return one(spark, gate.numeric_conflict(T.claim_map(F.col("a")), F.array(T.claim_map(F.col("b")))), a=a, b=b)

    assert conflict("rate near 0", "rate near 5") == 0.0 and conflict("rate near 4", "rate near 5") == 1.0

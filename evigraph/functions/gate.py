"""The gate's vote and the numeric checks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.config import W_CONFLICT, W_ENTITY, W_LEXICAL, W_SEMANTIC
from evigraph.functions import text as T


def positive(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x.cast("double"))


def potential(sim: Column, lexical: Column, entity: Column, lateral: Column, conflict: Column, inhibition: float) -> Column:
    """The unrounded membrane potential: what excites less what inhibits."""
    return W_SEMANTIC * positive(sim) + W_LEXICAL * positive(lexical) + W_ENTITY * positive(entity) - inhibition * positive(lateral) - W_CONFLICT * positive(conflict)


def verdict(sim: Column, lexical: Column, entity: Column, lateral: Column, conflict: Column, inhibition: float, threshold: float) -> Column:
    """struct<potential, fired, components, threshold, reason>; fired by the unrounded potential."""
    v = potential(sim, lexical, entity, lateral, conflict, inhibition)
    parts = {"semantic": W_SEMANTIC * positive(sim), "lexical": W_LEXICAL * positive(lexical), "entity": W_ENTITY * positive(entity), "lateral_inhibition": -(inhibition * positive(lateral)), "conflict": -(W_CONFLICT * positive(conflict))}
    contradicted = (conflict > 0) & (W_CONFLICT * conflict >= F.greatest(inhibition * lateral, F.lit(0.0))) & (W_CONFLICT * conflict >= v + threshold)
    reason = (
        F.when(v >= threshold, "")
        .when(contradicted, "suppressed: numeric contradiction with fired evidence")
        .when(lateral > 0, "suppressed: lateral inhibition (redundant context)")
        .otherwise("suppressed: sub-threshold potential")
    )
    return F.struct(
        F.round(v, 4).alias("potential"),
        (v >= threshold).alias("fired"),
        F.create_map(*[x for k, p in parts.items() for x in (F.lit(k), F.round(p, 3))]).alias("components"),
        F.lit(threshold).alias("threshold"),
        reason.alias("reason"),
    )


def contradicts(mine: Column, other: Column) -> Column:
    """Whether two claim maps give a key values that differ by more than 15 % of the larger; a zero contradicts nothing."""
    shared = F.array_intersect(F.map_keys(mine), F.map_keys(other))
    apart = lambda k: F.abs(mine[k] - other[k]) / F.greatest(F.abs(mine[k]), F.abs(other[k]), F.lit(1e-9)) > 0.15
    return F.exists(shared, lambda k: (mine[k] != 0) & (other[k] != 0) & apart(k))


def numeric_conflict(mine: Column, fired: Column) -> Column:
    """1.0 if a claim map contradicts one of the last four of an array of claim maps, else 0.0."""
    last = F.slice(fired, F.greatest(F.size(fired) - 3, F.lit(1)), F.lit(4))
    return F.when(F.exists(last, lambda o: contradicts(mine, o)), 1.0).otherwise(0.0)


def entity_congruence(entities: Column, query_tokens: Column) -> Column:
    """Entities with a token of the query over the root of all, at most 1; both sides never null."""
    hits = F.size(F.filter(entities, lambda e: F.arrays_overlap(T.tokenize(e), query_tokens)))
    return F.when((hits == 0) | (F.size(query_tokens) == 0), 0.0).otherwise(F.least(F.lit(1.0), hits / F.sqrt(F.size(entities).cast("double"))))


def grounding(answer: Column, evidence: Column) -> Column:
    """struct<grounded, cite_ratio, support, score, fabricated, note> of an answer against an array of evidence texts."""
    bare = F.regexp_replace(T.text_of(answer), T.TAG, " ")
    joined = F.array_join(evidence, " ")

    def judged(x: Column) -> Column:
        sentences, tokens, known, numbers = x["s"], x["t"], x["k"], x["n"]
        cite = F.size(F.filter(sentences, lambda s: s.rlike(T.TAG))) / F.greatest(F.size(sentences), F.lit(1))
        support = F.when(F.size(tokens) > 0, F.size(F.array_intersect(tokens, known)) / F.size(tokens)).otherwise(0.0)
        made_up = F.filter(numbers, lambda n: ~F.contains(x["j"], n) & ~F.contains(F.regexp_replace(x["j"], ",", ""), F.regexp_replace(n, ",", "")))
        score = 0.5 * cite + 0.5 * support
        empty = F.size(sentences) == 0
        note = (
            F.when(empty, "motor output has no content")
            .when(F.size(made_up) > 0, F.concat(F.lit("numeric hallucination: "), F.array_join(F.slice(made_up, 1, 4), ", "), F.lit(" not present in evidence")))
            .otherwise(F.format_string("citation coverage %.0f%% · lexical support %.0f%% · grounding score %.2f", cite * 100, support * 100, score))
        )
        return F.struct((~empty & (F.size(made_up) == 0) & (score >= 0.55)).alias("grounded"), cite.alias("cite_ratio"), support.alias("support"), score.alias("score"), made_up.alias("fabricated"), note.alias("note"))

    once = F.struct(
        T.sentence_split(answer).alias("s"),
        T.token_set(bare).alias("t"),
        F.array_distinct(F.flatten(F.transform(evidence, T.tokenize))).alias("k"),
        F.array_distinct(F.regexp_extract_all(bare, F.lit(T.NUMBER), F.lit(0))).alias("n"),
        joined.alias("j"),
    )
    return T.let(once, judged)

"""Figures of use, recomputed from the tables of runs and ingests instead of counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(runs: DataFrame, ingests: DataFrame) -> DataFrame:
    """One row: queries, ingestions, spikes_emitted, gates_suppressed, tokens_saved, reflection_loops, total, average and last latency."""
    zero = F.lit(0).cast("long")
    r = runs.agg(
        F.count(F.lit(1)).alias("queries"),
        *(F.coalesce(F.sum(F.col(c).cast("long")), zero).alias(n) for c, n in (("spikes", "spikes_emitted"), ("suppressed", "gates_suppressed"), ("tokens_saved", "tokens_saved"), ("loops", "reflection_loops"), ("latency_ms", "total_latency_ms"))),
        F.coalesce(F.round(F.avg("latency_ms"), 1), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.max_by("latency_ms", "ts"), zero).alias("last_latency_ms"),
    )
    return r.crossJoin(ingests.agg(F.count(F.lit(1)).alias("ingestions")))  # one row each

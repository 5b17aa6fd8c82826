"""Hashed bag-of-features embeddings."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.functions.hashing import bucket, bucket_of


def features(text: Column) -> Column:
    """Tokens and bigrams, with repeats."""
    return T.let(T.tokenize(text), lambda t: F.concat(t, T.bigrams(t)))


def feature_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, feature, tf)."""
    return df.select(key, F.explode(features(F.col(text))).alias("feature")).groupBy(key, "feature").agg(F.count(F.lit(1)).alias("tf"))


def bucket_weights(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, bucket, weight) of the unit vectors in md5 mode, in built-in functions; rows without a token have none."""
    weight = (1 + F.log(F.col("tf").cast("double"))) * F.when(F.col("feature").contains("_"), 1.5).otherwise(1.0)
    sums = feature_counts(df, key, text).groupBy(key, bucket(F.col("feature"), dim).alias("bucket")).agg(F.sum(weight).alias("w"))
    norm = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return sums.join(norm, key).select(key, "bucket", (F.col("w") / F.col("_norm")).alias("weight"))


def embed(df: DataFrame, key: str, text: str, dim: int = 512, kind: str = "md5") -> DataFrame:
    """(key, embedding): unit vectors, one narrow pass; tokens are made in the JVM, only hashing is in Python.

    A text without tokens gets the one bucket of its own hash, so that no vector is zero; null counts as "empty".
    """

    def work(batches):
        buckets: dict[str, int] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, dim), np.float32)
            for i, (feats, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for f, n in Counter(feats).items():
                    if (b := buckets.get(f)) is None:
                        if len(buckets) > 500_000:
                            buckets.clear()
                        b = buckets[f] = bucket_of(f, dim, kind)
                    out[i, b] += (1 + math.log(n)) * (1.5 if "_" in f else 1.0)
                norm = float(np.linalg.norm(out[i]))
                if norm < 1e-9:
                    out[i, bucket_of(raw or "empty", dim, kind)] = norm = 1.0
                out[i] /= norm
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * dim + 1, dim, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], [key, "embedding"])

    fed = df.select(key, features(F.col(text)).alias("_f"), F.col(text).alias("_t"))
    return fed.mapInArrow(work, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")


def dot(a: Column, b: Column) -> Column:
    """The dot product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def document_frequency(df: DataFrame, text: str) -> DataFrame:
    """(token, df)."""
    return df.select(F.explode(T.token_set(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def idf(df_col: Column, n: Column) -> Column:
    return F.log(1 + n / (F.coalesce(df_col, F.lit(0)) + 0.5))


def reembed(chunks: DataFrame, vectors: DataFrame, dim: int, kind: str) -> DataFrame:
    """The vectors (id, doc_id, embedding, embed_kind) with those of another kind or length made anew from their chunks.

    Vectors of two kinds must not mix. Those in force pass through; a stale one whose chunk is gone is left out.
    """
    fine = (F.col("embed_kind") == kind) & (F.size("embedding") == dim)
    stale = vectors.where(~F.coalesce(fine, F.lit(False))).select("id", "doc_id")
    texts = chunks.select("id", T.embed_text(F.col("doc_title"), F.col("section_path"), F.col("text")).alias("_t")).join(stale, "id", "left_semi")
    made = embed(texts, "id", "_t", dim, kind).join(stale, "id").select("id", "doc_id", "embedding", F.lit(kind).alias("embed_kind"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select("id", "doc_id", "embedding", "embed_kind").unionByName(made)

"""A vector store as a DataFrame (key, vector, ...): search, relation of neighbours, upsert and delete."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries held by a task at once; more are searched in further passes.
QUERY_BLOCK = 4096
#: Rows of one batch that are held against each other in a task.
RELATE_BLOCK = 2048


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding", query: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query, key, score, rank) of the k rows of highest dot product for each query, ties by the smaller key.

    A stated set of queries against all rows: each pass sends at most QUERY_BLOCK queries to the tasks, whose vectors
    are scored by matrix products, and each Arrow batch passes on k rows a query. Null vectors match nothing; vectors
    of another length than the query's are left out; fewer rows than k give fewer hits.
    """
    asked = queries.where(F.col(query).isNotNull() & F.col(query_vector).isNotNull()).select(query, query_vector)
    rows = asked.orderBy(query).collect()
    schema = f"{query} {queries.schema[query].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    parts = []
    for first in range(0, max(1, len(rows)), QUERY_BLOCK):
        some = rows[first : first + QUERY_BLOCK]
        names = [r[0] for r in some]
        matrix = np.array([r[1] for r in some], np.float64)
        held = vectors.sparkSession.sparkContext.broadcast((names, matrix))

        def work(batches, held=held):
            names, matrix = held.value
            for batch in batches:
                lists = batch.column(1)
                keep = [i for i, n in enumerate(lists.value_lengths().to_pylist()) if len(names) and n == matrix.shape[1]]
                if not keep:
                    continue
                ids = batch.column(0).take(pa.array(keep))
                data = lists.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keep), -1)
                scores = data @ matrix.T
                order = np.argsort(np.array(ids.to_pylist(), dtype=object), kind="stable")  # ties by key
                q, at, s = [], [], []
                for j in range(scores.shape[1]):
                    best = order[np.argsort(-scores[order, j], kind="stable")[:k]]
                    q += [names[j]] * len(best)
                    at += best.tolist()
                    s += scores[best, j].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(q), ids.take(pa.array(at)), pa.array(s)], [query, key, "score"])

        parts.append(vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector).mapInArrow(work, schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def relates(vectors: DataFrame, batch: str, least: float, key: str = "id", vector: str = "embedding", top: int = 2) -> DataFrame:
    """(u, v, weight), u < v: for each row its `top` most similar others of the same batch, where the dot product is `least` or more.

    Batches are compared in blocks of RELATE_BLOCK rows, each pair of blocks by a task, so that a batch with a third of
    all rows is spread; a pair that both rows choose comes once. Null vectors and batches take no part.
    """
    rows = vectors.where(F.col(vector).isNotNull() & F.col(batch).isNotNull() & F.col(key).isNotNull()).select(F.col(batch).alias("_b"), F.col(key).alias("_k"), F.col(vector).alias("_v"))
    blocks = rows.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / RELATE_BLOCK).cast("int").alias("_n"))
    placed = rows.join(blocks, "_b").withColumn("_own", F.pmod(F.xxhash64("_k"), F.col("_n")).cast("int"))
    # a row asks (1) in the pairs of its block with every block, and is asked about (2) in those of every block with its own
    rest = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: i != F.col("_own"))
    part = lambda q, d, side: F.struct(q.alias("_q"), d.alias("_d"), F.lit(side).alias("_side"))
    own = F.col("_own")
    each = F.concat(F.array(part(own, own, 3)), F.transform(rest, lambda i: part(own, i, 1)), F.transform(rest, lambda i: part(i, own, 2)))
    parted = placed.select("_b", F.explode(each).alias("_p"), "_k", "_v").select("_b", "_p.*", "_k", "_v")
    parted = parted.repartition("_b", "_q", "_d").sortWithinPartitions("_b", "_q", "_d", "_k")
    kind = vectors.schema[key].dataType.simpleString()

    def best(names: pa.Array, side: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asking, other, score) by position, of one pair of blocks sorted by key."""
        asking, data = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        s = x[asking] @ x[data].T
        s[names[asking][:, None] == names[data][None, :]] = -np.inf
        near = np.argsort(-s, axis=1, kind="stable")[:, :top]
        at = np.repeat(np.arange(len(asking)), near.shape[1])
        score = s[at, near.ravel()]
        fine = np.isfinite(score)
        return asking[at[fine]], data[near.ravel()[fine]], score[fine]

    def work(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks() if held is not None or batch is not None else None
            if rows is None or not rows.num_rows:
                continue
            b, q, d, side, k, v = (c.chunk(0) for c in rows.columns)
            keys = [b.dictionary_encode().indices.to_numpy(), q.to_numpy(), d.to_numpy()]
            starts = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in keys], axis=0), [batch is None]])).tolist()
            held = None if batch is None else rows.slice(starts[-1]).to_batches()[0]  # may go on in the next batch
            if len(starts) < 2:
                continue
            sizes = v.slice(0, starts[-1]).value_lengths().to_numpy()
            if (sizes != np.repeat(sizes[starts[:-1]], np.diff(starts))).any():
                raise ValueError("vectors of a batch differ in length")
            x, ends, sides, names = v.slice(0, starts[-1]).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], sizes.cumsum()]), side.to_numpy(), k.dictionary_encode().indices.to_numpy()
            parts = []
            for i, j in zip(starts, starts[1:]):
                asking, other, score = best(names[i:j], sides[i:j], x[ends[i] : ends[j]].reshape(j - i, -1))
                parts.append((asking + i, other + i, score))
            asking, other, score = (np.concatenate(p) for p in zip(*parts))
            yield pa.RecordBatch.from_arrays([k.take(pa.array(asking)), k.take(pa.array(other)), pa.array(score)], ["_k", "_o", "_s"])

    pairs = parted.mapInArrow(work, f"_k {kind}, _o {kind}, _s double")
    order = Window.partitionBy("_k").orderBy(F.col("_s").desc(), "_o")
    chosen = pairs.withColumn("_r", F.row_number().over(order)).where((F.col("_r") <= top) & (F.col("_s") >= least))
    return chosen.groupBy(F.least("_k", "_o").alias("u"), F.greatest("_k", "_o").alias("v")).agg(F.max("_s").alias("weight"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new in place of those of the same key; of equal keys in new any one stays."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]))


def remove(df: DataFrame, doc_id: str, column: str = "doc_id") -> DataFrame:
    """Rows of other documents; null documents stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(doc_id)))

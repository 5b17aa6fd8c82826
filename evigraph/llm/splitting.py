"""Problem 2: oversized items cut at natural boundaries by content-defined chunking.

A rolling hash of the last WINDOW characters marks landmarks: within the sizes allowed for a piece, the place of the
smallest hash. The cut snaps to the nearest natural boundary (end of a paragraph, else of a line, a sentence, a word)
in that range. As landmarks depend on nearby characters only, an edit alters the pieces around it and no others.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.runtime import extended

WINDOW = 16
#: A piece's own text is at least this share of what it may have.
LEAST = 0.4
#: Share of the limit that an overlap leaves to a piece's own text at least.
OWN = 0.25
#: Chunks of a document that are numbered in one task, at the mean.
BLOCK = 4096
BLANK = " \t\r\n"
#: Natural boundaries, strongest first: each match ends where the next piece may begin. Fixed values.
BOUNDARIES = [r"\r?\n[ \t]*\r?\n\s*", r"\r?\n[ \t]*", r"(?<=[.!?])[\"')\]]*[ \t]+|(?<=[。！？])[」』”’）]*[ \t]*", r"[ \t]+"]
SENTENCE_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])[」』”’）]*\s*|\r?\n\s*")


def rolling(text: str) -> np.ndarray:
    """A hash of the WINDOW characters before each place."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = np.zeros(len(points) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for back in range(min(WINDOW, len(points))):
            h[back + 1 :] += (points[: len(points) - back] + np.uint64(1)) * np.uint64(pow(0x9E3779B97F4A7C15, back + 1, 1 << 64))
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, own start, end) of each piece of `text`, at most `limit` characters each; own start is behind the overlap.

    The overlap is the last `overlap` sentences of the text before the piece; where they would leave less than OWN of the
    limit to the piece itself, it is shortened to the sentences that fit, to none if none does. Where no boundary is
    within the sizes allowed, the cut is at the landmark itself.
    """
    n = len(text)
    if limit < 1 or n <= limit:
        return [(0, 0, n)]
    h = rolling(text)
    ends = [np.array([m.end() for m in re.finditer(p, text) if 0 < m.end() < n], np.int64) for p in BOUNDARIES]
    sentences = np.array(sorted({0, *(m.end() for m in SENTENCE_END.finditer(text) if m.end() < n)}), np.int64)
    pieces, own = [], 0
    while True:
        start = own
        if own and overlap > 0:
            k = int(np.searchsorted(sentences, own))
            for first in sentences[max(0, k - overlap) : k].tolist():
                if own - first <= limit * (1 - OWN) and first > pieces[-1][1] - 1:
                    start = first
                    break
        last = start + limit
        if last >= n:
            pieces.append((start, own, n))
            return pieces
        least = min(own + max(1, int((last - own) * LEAST)), last)
        mark = least + int(np.argmin(h[least : last + 1]))
        end = mark
        for places in ends:
            a, b = np.searchsorted(places, [least, last + 1])
            if a < b:
                near = places[a:b]
                end = int(near[np.argmin(np.abs(near - mark))])
                break
        pieces.append((start, own, end))
        own = end


def renumbered(pieces: DataFrame, key: str, page: str, order: str) -> DataFrame:
    """`pieces` with `order` counted on within each document, so that no two pieces of a document share a number.

    An item keeps its distance to the one before it; each piece before it moves it on by one. Items of one number follow
    each other by their keys. A document's items are numbered in blocks of its own numbers, and the blocks by their
    sums, so that one with a third of all items doesn't go through one task. Null documents are one document.
    """
    heads = pieces.where(F.col("piece") == 0).select(F.col(key).alias("_key"), F.col(page).alias("_page"), F.col(order).alias("_order"), (F.col("n_pieces") - 1).alias("_more")).withColumn("_block", F.floor(F.col("_order") / BLOCK))
    same = F.row_number().over(Window.partitionBy("_page", "_block", "_order").orderBy("_key"))
    heads = heads.withColumn("_step", F.col("_more") + (same > 1).cast("int"))
    before = F.coalesce(F.sum("_step").over(Window.partitionBy("_page", "_block").orderBy("_order", "_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = heads.withColumn("_before", before + (same > 1).cast("int"))
    sums = heads.groupBy("_page", "_block").agg(F.sum("_step").alias("_s"))
    offsets = sums.select("_page", "_block", (F.sum("_s").over(Window.partitionBy("_page").orderBy("_block")) - F.col("_s")).alias("_offset"))
    same_page = F.col("a._page").eqNullSafe(F.col("b._page")) & (F.col("a._block") == F.col("b._block"))
    moved = local.alias("a").join(offsets.alias("b"), same_page).select("_key", (F.col("_before") + F.col("_offset")).alias("_moved"))
    joined = pieces.join(moved, F.col(key) == F.col("_key"))
    return joined.withColumn(order, (F.col(order) + F.col("_moved")).cast(pieces.schema[order].dataType)).drop("_key", "_moved")


def split_oversized(df: DataFrame, key: str, text: str, limit: str, overlap: str, order: str) -> DataFrame:
    """(key, piece, n_pieces, text, order) of each row, pieces within the row's own `limit`, trimmed, never empty.

    `limit`, `overlap` are integer columns: a null limit means none, a null overlap 0. Texts are read without blanks,
    tabs and line ends at both ends; one within its limit is one piece. Null and blank texts give one piece as they
    are, so that no row is lost. `order` numbers the pieces on from the row's own number (null counts as 0): an item's
    later pieces have order + 1, + 2, ...; see `renumbered` for the items behind it. Rows may
    repeat; other columns of `df` stay, except those named piece and n_pieces, which are replaced.

    Only rows beyond their limit go to Python; each is cut alone, so hot documents can't load one task.
    """
    keep = [c for c in df.columns if c not in (text, order, "piece", "n_pieces", "_at")]
    trimmed = df.withColumn(text, F.coalesce(F.nullif(F.btrim(F.col(text), F.lit(BLANK)), F.lit("")), F.col(text)))
    too_long = F.coalesce(F.length(F.btrim(F.col(text), F.lit(BLANK))) > F.col(limit), F.lit(False))
    number = F.coalesce(F.col(order), F.lit(0)).cast(df.schema[order].dataType).alias(order)
    whole = trimmed.where(~too_long).select(*keep, F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.col(text), number)
    schema = extended(trimmed.select(*keep).schema, f"piece int, n_pieces int, {text} string, {order} {df.schema[order].dataType.simpleString()}")

    def work(batches):
        for batch in batches:
            at, no, many, out, places = [], [], [], [], []
            names = batch.schema.names
            texts, limits, overlaps, orders = (batch.column(names.index(c)).to_pylist() for c in (text, limit, overlap, order))
            for i, t in enumerate(texts):
                parts = [p for s, _, e in split(t, limits[i], overlaps[i] or 0) if (p := t[s:e].strip(BLANK))]
                for k, p in enumerate(parts):
                    at.append(i)
                    no.append(k)
                    many.append(len(parts))
                    out.append(p)
                    places.append((orders[i] or 0) + k)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(names.index(c)) for c in keep), pa.array(no, pa.int32()), pa.array(many, pa.int32()), pa.array(out, pa.string()), pa.array(places, batch.schema.field(order).type)], [*keep, "piece", "n_pieces", text, order])

    return whole.unionByName(trimmed.where(too_long).mapInArrow(work, schema))

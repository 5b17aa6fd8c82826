"""Problem 3: how distinctive a term is of its record, by graph-of-words weighting.

Within a record the words are linked to those at most WINDOW - 1 places on; a term's weight is its number of distinct
neighbours instead of its frequency, times ln(records / records with the term). Values of an array field have no
order: each value's neighbours are the other values of its record.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import extended

WINDOW = 4
WORD = "[A-Za-z]{4,}"
#: Distinct words a task counts before it passes its counts on.
HELD = 200_000


def degrees(words: list[str], wanted: set[str], window: int = WINDOW) -> dict[str, int]:
    """The number of distinct neighbours of each wanted word."""
    near: dict[str, set[str]] = defaultdict(set)
    for i, w in enumerate(words):
        if w in wanted:
            near[w].update(words[max(0, i - window + 1) : i])
            near[w].update(words[i + 1 : i + window])
    return {w: len(near[w] - {w}) for w in wanted}


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(term, n_records): records with each word, counted over all rows; a task passes on one row for each word it met."""

    def work(batches):
        counts: Counter[str] = Counter()
        find = re.compile(WORD).findall
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update({w.lower() for w in find(t)})
            if len(counts) > HELD:
                yield out(counts)
                counts.clear()
        yield out(counts)

    def out(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return df.select(text).mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_records"))


def text_terms(df: DataFrame, key: str, text: str, least: int = 1, few: int = 1, many: int | None = None) -> DataFrame:
    """(key, term, tf, degree, n_records, score) of the words said at least `least` times in a record and found in
    `few` to `many` records (no upper end if None).

    `df` has one row per record. A word is an unbroken run of at least 4 letters A-Z or a-z, in lower case. Null, empty
    and wordless texts give no rows but count as records. Ties keep equal scores; an empty table gives no rows; other
    columns are dropped. The word counts stay a table: they are joined, never collected.
    """
    counts = word_counts(df, text)
    many_or_all = F.lit(True) if many is None else F.col("n_records") <= many
    counts = counts.where((F.col("n_records") >= few) & many_or_all)
    total = df.agg(F.count(F.lit(1)).alias("_n"))

    def work(batches):
        find = re.compile(WORD).findall
        for batch in batches:
            rows, terms, tfs, degs = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = [w.lower() for w in find(t or "")]
                tf = {w: n for w, n in Counter(words).items() if n >= least}
                if tf:
                    for w, d in degrees(words, set(tf)).items():
                        rows.append(i)
                        terms.append(w)
                        tfs.append(tf[w])
                        degs.append(d)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int32()), pa.array(degs, pa.int32())], [key, "term", "tf", "degree"])

    schema = extended(df.select(key).schema, "term string, tf int, degree int")
    terms = df.select(key, text).mapInArrow(work, schema)
    return scored(counted(terms, counts, total, many), total, key, "tf", "degree")


def value_terms(df: DataFrame, key: str, values: str, few: int = 1, many: int | None = None) -> DataFrame:
    """(key, term, degree, n_records, score) of the distinct values of an array field found in `few` to `many` records.

    `values` is a deduplicated array without nulls; null and empty arrays give no rows but count as records.
    """
    exploded = df.select(key, (F.size(values) - 1).alias("degree"), F.explode(values).alias("term"))
    counts = exploded.groupBy("term").agg(F.count(F.lit(1)).alias("n_records"))
    many_or_all = F.lit(True) if many is None else F.col("n_records") <= many
    counts = counts.where((F.col("n_records") >= few) & many_or_all)
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return scored(counted(exploded, counts, total, many), total, key, "degree")


def counted(terms: DataFrame, counts: DataFrame, total: DataFrame, many: int | None) -> DataFrame:
    """`terms` with the counts of their terms.

    Terms of a thousandth of all records or more go by broadcast, so that no key of the join is hot; there are at most
    a thousand times as many of them as a record has terms at the mean. With an upper end there are none.
    """
    if many is not None:
        return terms.join(counts, "term")
    share = counts.crossJoin(F.broadcast(total)).withColumn("_hot", F.col("n_records") * 1000 >= F.col("_n")).drop("_n")  # total: one row
    hot = share.where("_hot").drop("_hot")
    rare = terms.join(F.broadcast(hot.select("term")), "term", "left_anti").join(share.where(~F.col("_hot")).drop("_hot"), "term")
    return terms.join(F.broadcast(hot), "term").unionByName(rare)


def scored(terms: DataFrame, total: DataFrame, key: str, *kept: str) -> DataFrame:
    score = F.col("degree") * F.log(F.col("_n") / F.col("n_records"))
    return terms.crossJoin(F.broadcast(total)).select(key, "term", *kept, "n_records", score.alias("score"))  # one row

"""Problem 6: items that appear together, by collapsed baskets.

Equal deduplicated item arrays become one weighted basket, so that a basket shared by a third of all records is
enumerated once. Everything stays in built-in functions; counts are combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import cut


def entity(name: Column) -> Column:
    """An entity's one spelling: lower case, runs of white space, "-" and "_" as one blank, trimmed; blank gives ""."""
    return F.btrim(F.regexp_replace(F.lower(name), r"[\s\-_]+", " "))


def entity_set(names: Column) -> Column:
    """The distinct entities of an array, sorted; null arrays, null and blank entries give none."""
    spelt = F.transform(F.coalesce(names, F.array().cast("array<string>")), entity)
    return F.array_sort(F.array_distinct(F.filter(spelt, lambda x: x.isNotNull() & (x != ""))))


def baskets(df: DataFrame, items: str) -> DataFrame:
    """(items, weight) of each distinct basket of one item or more; `items` holds sorted distinct arrays."""
    return df.where(F.size(items) > 0).groupBy(F.col(items).alias("items")).agg(F.count(F.lit(1)).alias("weight"))


def together(df: DataFrame, items: str, least: int = 1) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, conviction) of each pair of items in at least `least` baskets together.

    `items` is an array<string> of one record: null, empty, repeated and null entries count as described in entity_set,
    apart from the spelling, which is left alone. n is the number of baskets with an item. lift is n_ab*n/(n_a*n_b);
    conviction of a -> b is (1 - n_b/n)/(1 - n_ab/n_a), null where a never occurs without b. item_a < item_b by code
    point. Ties don't arise; an empty table gives no rows; other columns are dropped.

    Pairs are enumerated within a basket only, once for each distinct basket. A basket of m items has m(m-1)/2 pairs,
    which the result needs.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(items), F.array().cast("array<string>")), lambda x: x.isNotNull())))
    weighted = cut(baskets(df.select(clean.alias("items")), "items"))  # read three times
    single = weighted.select(F.explode("items").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("n"))
    total = weighted.agg(F.sum("weight").alias("n"))
    size = F.size("items")
    pairs = (
        weighted.where(size > 1)
        .select("items", "weight", F.posexplode("items").alias("at", "item_a"))
        .where(F.col("at") < size - 1)
        .select("item_a", F.explode(F.slice("items", F.col("at") + 2, size)).alias("item_b"), "weight")
        .groupBy("item_a", "item_b")
        .agg(F.sum("weight").alias("n_ab"))
        .where(F.col("n_ab") >= least)
    )
    a = single.select(F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = single.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    both = pairs.join(a, "item_a").join(b, "item_b").crossJoin(F.broadcast(total))  # one row
    n, na, nb, nab = (F.col(c).cast("double") for c in ("n", "n_a", "n_b", "n_ab"))
    return both.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n",
        (nab * n / (na * nb)).alias("lift"),
        F.when(F.col("n_ab") < F.col("n_a"), (1 - nb / n) / (1 - nab / na)).alias("conviction"),
    )

"""Readers that apply the common rules of the tables: one row per id, kinds in one spelling, web pages by their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.runtime import table


def chunk_kind(kind: Column) -> Column:
    """A chunk's kind as it is read: trimmed, lower case, null is text."""
    return F.coalesce(F.lower(F.btrim(kind)), F.lit("text"))


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per non-null key; rows delivered again are equal in what is kept of them, so any of them will do."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def is_web(source: Column) -> Column:
    return F.lower(F.ltrim(source)).rlike("^https?://")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, host) of each parsed document whose source is a web address, whatever its kind says."""
    pages = table(spark, sf_dir, "parsed_documents").where(F.col("doc_id").isNotNull() & is_web(F.col("source")))
    host = F.lower(F.regexp_extract(F.ltrim("source"), r"(?i)^https?://(?:www\.)?([^/?#:]*)", 1))
    return pages.groupBy("doc_id").agg(F.min(host).alias("host"))

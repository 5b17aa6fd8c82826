"""Pages fetched from the web, as a function and as a Spark data source; and what is refused."""

from __future__ import annotations

import urllib.request

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evigraph.functions import text as T
from evigraph.sources.parse import parse_files

#: Bytes of a page that are read at most, and what isn't read. Fixed values.
MOST_BYTES = 3_000_000
REFUSED = ("image/", "video/", "audio/", "application/zip", "application/octet-stream")


def fetchable(url: Column) -> Column:
    """Whether an address has a scheme that is fetched."""
    return F.coalesce(F.lower(F.btrim(url)).rlike("^https?://[^/]"), F.lit(False))


def fetch(url: str, timeout: float = 20.0) -> bytes:
    """The body of a page; other schemes, refused types and empty bodies are errors."""
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError("only http and https addresses are fetched")
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310 - the scheme was checked
        if (r.headers.get("content-type") or "").lower().startswith(REFUSED):
            raise ValueError("this kind of content isn't read")
        body = r.read(MOST_BYTES)
    if not body:
        raise ValueError("the page is empty")
    return body


def preview(files: DataFrame) -> DataFrame:
    """(url, title, kind, chars, preview, warnings) of pages that aren't stored."""
    blocks = parse_files(files)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n")
    per = blocks.groupBy("name").agg(F.first("title").alias("title"), F.first("doc_kind").alias("kind"), F.first("warnings").alias("warnings"), joined.alias("raw"))
    return per.select(F.col("name").alias("url"), F.substring("title", 1, 120).alias("title"), "kind", F.length("raw").alias("chars"), T.truncate(F.col("raw"), 400).alias("preview"), "warnings")


class _Url(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float):
        self.urls, self.timeout = urls, timeout

    def partitions(self):
        return [_Url(u) for u in self.urls]

    def read(self, partition):
        try:
            yield partition.value, fetch(partition.value, self.timeout), partition.value, None
        except Exception as e:  # noqa: BLE001 - one page's failure is that page's row
            yield partition.value, None, partition.value, str(e)


class WebSource(DataSource):
    """spark.read.format("evigraph_web").option("urls", "a,b").load(): (name, content, url, error), a task for each address."""

    @classmethod
    def name(cls):
        return "evigraph_web"

    def schema(self):
        return "name string, content binary, url string, error string"

    def reader(self, schema):
        return _Reader([u.strip() for u in self.options.get("urls", "").split(",") if u.strip()], float(self.options.get("timeout", "20")))

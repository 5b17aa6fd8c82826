"""Content hashes and ids. md5 stays in the JVM and in SQL; blake2b needs Arrow-batched Python."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.text import text_of


def _blake(size: int):
    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.blake2b((t or "").encode("utf-8"), digest_size=size).hexdigest())

    return digest


def content_hash(text: Column, kind: str = "md5") -> Column:
    """16 hexadecimal digits of a text; null counts as empty."""
    return F.substring(F.md5(text_of(text)), 1, 16) if kind == "md5" else _blake(8)(text)


def doc_id(title: Column, raw: Column, kind: str = "md5") -> Column:
    """A document's id, from its title and first 2,000 characters, as ids are defined; whole texts are never cut by it."""
    head = F.concat(text_of(title), F.lit("|"), F.substring(text_of(raw), 1, 2000))
    return F.concat(F.lit("d"), F.substring(F.md5(head), 1, 12) if kind == "md5" else _blake(6)(head))


def bucket(feature: Column, dim: int) -> Column:
    """A feature's bucket by the first 8 hexadecimal digits of its md5."""
    return (F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("long") % dim).cast("int")


def bucket_of(feature: str, dim: int, kind: str) -> int:
    data = feature.encode("utf-8")
    if kind == "md5":
        return int(hashlib.md5(data).hexdigest()[:8], 16) % dim
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big") % dim

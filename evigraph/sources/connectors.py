"""Optional outside stores, behind plain callables so that no client library is needed.

A mirror or a vector service is given as functions; rows are sent in batches by foreachPartition, and a failing batch
of a mirror is passed over, since the tables are the truth.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a vector service gets at once, and rows of a page that is read from it. Fixed values.
UPSERT_BATCH, SCROLL_PAGE = 64, 256


def point_id(key: str) -> str:
    """The same identifier for the same key, so that sending twice changes nothing."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, key))


def batches(rows: Iterable, size: int) -> Iterable[list]:
    some: list = []
    for r in rows:
        some.append(r)
        if len(some) == size:
            yield some
            some = []
    if some:
        yield some


def send_points(df: DataFrame, send: Callable[[list[dict]], None], key: str = "id", vector: str = "embedding") -> None:
    """Send (key, vector, other columns as payload) to a vector service."""

    def work(rows):
        for some in batches(rows, UPSERT_BATCH):
            send([{"id": point_id(r[key]), "vector": list(r[vector]), "payload": {k: v for k, v in r.asDict(recursive=True).items() if k != vector}} for r in some])

    df.foreachPartition(work)


def scroll(pages: Callable[[object, int], tuple[list[dict], object]]) -> Iterable[dict]:
    """All rows of a service that is read page by page; `pages` takes (cursor, size) and gives (rows, next cursor or None)."""
    cursor = None
    while True:
        rows, cursor = pages(cursor, SCROLL_PAGE)
        yield from rows
        if cursor is None:
            return


def plain_value(value: Column) -> Column:
    """A value as a mirror takes it: text."""
    return value.cast("string")


def mirror(nodes: DataFrame, edges: DataFrame, write: Callable[[str, dict], None] | None = None) -> None:
    """Send nodes and edges to a graph service; without one nothing happens, and what fails is passed over."""
    if write is None:
        return

    def work(kind):
        def each(rows):
            for r in rows:
                try:
                    write(kind, json.loads(r["j"]))
                except Exception:  # noqa: BLE001, S110 - a mirror never fails the engine
                    pass

        return each

    nodes.select(F.to_json(F.struct("*")).alias("j")).foreachPartition(work("node"))
    edges.select(F.to_json(F.struct("*")).alias("j")).foreachPartition(work("edge"))


def loose_json(text: str | None) -> dict | None:
    """The first balanced {...} of a text that is valid JSON; braces inside strings don't count."""
    decoder, at = json.JSONDecoder(), 0
    while text and (at := text.find("{", at)) >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return value
        except ValueError:
            pass
        at += 1
    return None

"""Events of the engine: batch views, and streams with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Kinds of events, and sizes of buffers. Fixed values.
KINDS = ["run_start", "run_end", "spike", "gate", "ingest", "heartbeat", "hello"]
RING, RUN_CAP, CLIENT_BUFFER, HEARTBEAT_S, ACTIVE_S, ACTIVE_EVENTS = 1200, 240, 220, 15, 2.6, 40


def make_event(kind: Column, polarity: Column | None, ts: Column, **payload: Column) -> Column:
    """An event as JSON; null fields are left out."""
    return F.to_json(F.struct(kind.alias("type"), F.coalesce(polarity if polarity is not None else F.lit(None).cast("string"), F.lit("excitatory")).alias("polarity"), ts.alias("ts"), *(c.alias(n) for n, c in payload.items())))


def recent(events: DataFrame, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last n events."""
    return events.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def run_cap(events: DataFrame, run: str, ts: str = "ts", tie: str = "event_id", most: int = RUN_CAP) -> DataFrame:
    """The first `most` events of each run."""
    order = Window.partitionBy(run).orderBy(ts, tie)
    return events.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def active(events: DataFrame, node: str, now: Column, ts: str = "ts", tie: str = "event_id", last: int = ACTIVE_EVENTS, seconds: float = ACTIVE_S) -> DataFrame:
    """(node, last_ts) of the nodes that fired within `seconds` before `now`, among the last events."""
    tail = recent(events.where(F.col(ts) <= now), last, ts, tie)
    return tail.groupBy(node).agg(F.max(ts).alias("last_ts")).where(F.col("last_ts") >= now - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")))


def line(events: DataFrame, node: str, ts: str = "ts") -> DataFrame:
    """(label, glyph, ts): a feed's lines, newest first: the node without its prefix, 34 characters at most."""
    glyph = F.when(F.col("type") == "gate", "◈").when(F.col("type") == "run_end", "✦").otherwise("⚡")
    return events.select(F.substring(F.regexp_replace(node, "^[a-z]+:", ""), 1, 34).alias("label"), glyph.alias("glyph"), ts).orderBy(F.col(ts).desc())


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(window, event_type, n, total) of a stream or a table; a stream drops what is later than `late`."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def capped_stream(events: DataFrame, run: str, most: int = RUN_CAP) -> DataFrame:
    """The first `most` events of each run of a stream, by a counter per run that is dropped after an hour of silence.

    Returns (run, event_id, type); within a micro-batch events count in order of event_id.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        for pdf in frames:
            room = max(0, most - seen)
            seen += len(pdf)
            if room:
                yield pdf.sort_values("event_id").head(room)[[run, "event_id", "type"]]
        state.update((seen,))
        state.setTimeoutDuration(3_600_000)

    kind = events.schema[run].dataType.simpleString()
    return events.select(run, "event_id", "type").groupBy(run).applyInPandasWithState(work, f"{run} {kind}, event_id long, type string", "seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def heartbeats(events: DataFrame, subscriber: str, silence_s: int = HEARTBEAT_S) -> DataFrame:
    """(subscriber, type): the events of each subscriber, and a heartbeat after each `silence_s` seconds without one."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame({subscriber: [key[0]], "type": ["heartbeat"]})
        else:
            for pdf in frames:
                yield pdf[[subscriber, "type"]]
        state.update((0,))
        state.setTimeoutDuration(silence_s * 1000)

    kind = events.schema[subscriber].dataType.simpleString()
    return events.select(subscriber, "type").groupBy(subscriber).applyInPandasWithState(work, f"{subscriber} {kind}, type string", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ring(buffer: DataFrame, batch: DataFrame, size: int = RING, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """A bounded buffer after a batch: the newest `size` of both."""
    return recent(buffer.unionByName(batch), size, ts, tie)


def offered(queue: int, batch: DataFrame, room: int = 900, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """What a subscriber with `queue` waiting events takes of a batch: the oldest that fit, the newest are dropped."""
    return batch.orderBy(ts, tie).limit(max(0, room - queue))


def ingest_stream(engine, folder: str, checkpoint: str):
    """A query that ingests files as they arrive in a folder; documents already known are passed over, so replays are safe."""
    files = engine.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", 200).load(folder)
    named = files.select(F.col("path").alias("name"), "content", F.lit(None).cast("string").alias("url"))
    return named.writeStream.foreachBatch(lambda df, _: engine.ingest(df) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

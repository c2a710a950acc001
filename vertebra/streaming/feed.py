"""Structured Streaming: edges as they come, adjacency segments per batch, late data and running degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vertebra.operators import adjacency


def ingest_edges(edges: DataFrame, session, graph_id: int, label_id: int, checkpoint: str) -> StreamingQuery:
    """Appends each batch of a stream of edges as one committed version, so its members land in open segments.

    A batch's number is kept with the catalog: one that is replayed after a failure is not applied twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        counter = f"stream/{graph_id}/{label_id}"
        if session.catalog.counters.get(counter, 0) > number or not batch.limit(1).count():
            return
        with session.transaction():
            session.insert_edges(graph_id, label_id, batch)
            session.catalog.counters[counter] = number + 1

    return edges.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_degrees(edges: DataFrame) -> DataFrame:
    """Degrees of every owner over a stream of edges, updated with each batch."""
    return adjacency.degrees(adjacency.both_ways(edges))


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Watermarks take timestamps with a zone only; those without one are in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, time: str, key: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows per key and window of event time; rows later than `late` are dropped. slide makes windows overlap."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.window(time, length, slide), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Rows per key and session of event time, ended by a gap."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))

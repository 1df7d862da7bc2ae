"""The decision log as an append stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_decisions(log: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The decision in force for each candidate of a stream (candidate_id, at, seq, decision), in update mode.

    Rows may come late and out of order: the greatest (at, seq) wins, so state
    is one row a candidate whatever the order of arrival.
    """
    rows = log.withWatermark("at", watermark) if log.isStreaming else log
    newest = rows.groupBy("candidate_id").agg(F.max(F.struct("at", "seq", "decision")).alias("last"))
    return newest.select("candidate_id", "last.at", "last.seq", "last.decision")


def activity(log: DataFrame, window: str = "1 hour", watermark: str = "1 day") -> DataFrame:
    """Decisions of each kind in tumbling windows of a stream (at, decision)."""
    rows = log.withWatermark("at", watermark) if log.isStreaming else log
    return rows.groupBy(F.window("at", window).alias("w"), "decision").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "decision", "n")

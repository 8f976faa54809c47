"""The edit log as a stream: the last value of each record's fields, kept as state.

The store this replaces has no stream; this is an extension for logs that grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_values(log: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """log(seq, ts, rec_id, field, value), streaming or not -> (rec_id, field, value, n).
    One state row for each record and field; write it in update mode."""
    return log.where(F.col("field").isin(*fields)).groupBy("rec_id", "field").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("n"))


def windowed_counts(log: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Edits of each field in tumbling windows; rows later than `late` are dropped with their state."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", size), "field").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "field", "n")

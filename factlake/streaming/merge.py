"""Incremental set merge of a stream of (key, value) rows into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def merge_stream(rows: DataFrame, path: str, key: str, value: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the (key, value) rows that the Parquet table at `path` doesn't have yet; rows with a null are left out.

    Which rows are there is kept in the query's state store, split by (key, value), so a batch costs what it brings and
    not what the table holds. The file sink's log and the checkpoint make a restart repeat nothing.
    """
    fresh = rows.select(key, value).dropna().dropDuplicates([key, value])
    writer = fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()

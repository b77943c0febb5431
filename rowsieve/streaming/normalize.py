"""Normalization of rows that arrive as a stream. It keeps no state, so batches and streams share it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rowsieve.config import NormalizeConfig
from rowsieve.operators.normalize import normalize_rows


def normalize_stream(rows: DataFrame, path: str, checkpoint: str, cfg: NormalizeConfig = NormalizeConfig()) -> StreamingQuery:
    """Append the normalized form of a stream of rows (row_id, cells) to a Parquet table, until no more is there."""
    out = normalize_rows(rows, cfg).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(availableNow=True).start()

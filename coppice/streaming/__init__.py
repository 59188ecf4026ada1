"""Scoring of streams: prediction is a projection, so it needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import Model


def score_stream(model: Model, stream: DataFrame, out: str = "prediction") -> DataFrame:
    """The stream with the model's prediction as a column; late rows need no care."""
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return model.predict(stream, out)


def write_scores(model: Model, stream: DataFrame, path: str, checkpoint: str, out: str = "prediction", **trigger) -> StreamingQuery:
    """Writes scored rows to Parquet, exactly once by the sink's log and the checkpoint."""
    return score_stream(model, stream, out).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()

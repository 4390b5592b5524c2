"""Trimming a stream: every step is stateless per row, so the batch plan runs as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_text
from ..plans.trim import SIMILARITY_THRESHOLD, trim_against, trim_vectors


def trim_stream(
    stream: DataFrame,
    bank: DataFrame,
    encoder=None,
    threshold: float = SIMILARITY_THRESHOLD,
    text: str = "content",
    vector: str = "embedding",
) -> DataFrame:
    """A streaming DataFrame of the matched rows against a static table of filters.

    With an encoder the stream carries text, which is normalised first; without one
    it carries vectors.  The filters are read once, when the stream is defined.
    """
    if encoder is None:
        return trim_vectors(stream, bank, threshold, vector)
    return trim_against(stream.withColumn(text, normalize_text(F.col(text))), bank, encoder, threshold, text)


def write_stream(matches: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the matches to a parquet folder, exactly once per input row."""
    writer = matches.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)

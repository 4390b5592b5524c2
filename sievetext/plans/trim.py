"""The whole job: keep the rows of a corpus that are close to one of the filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.encoders import VectorTable
from ..functions.text import column_index_from_name
from ..operators.matching import best_match_texts, best_match_vectors
from ..operators.vectors import embed_filters
from ..sources import filter_files, jobs, sinks

# Fixed value: a row is kept when its score is strictly above this.
SIMILARITY_THRESHOLD = 0.65


def trim_corpus(
    docs: DataFrame,
    filters: DataFrame,
    encoder,
    threshold: float = SIMILARITY_THRESHOLD,
    text: str = "content",
    key: str | None = None,
) -> DataFrame:
    """Rows of ``docs`` whose nearest filter scores above the threshold.

    ``filters`` is a filter table (ord, category, anchors).  Adds ord, category,
    dist, dim and score; a row goes to at most one category.  With a ``VectorTable``
    encoder, ``key`` names the column of ``docs`` to join the vectors on (by default
    the text itself).
    """
    return trim_against(docs, embed_filters(filters, encoder), encoder, threshold, text, key)


def observed(rows: DataFrame, counts: Observation | None) -> DataFrame:
    """Count the rows that pass here while the job runs: ``counts.get["rows"]`` afterwards."""
    return rows if counts is None else rows.observe(counts, F.count(F.lit(1)).alias("rows"))


def trim_against(
    docs: DataFrame,
    bank: DataFrame,
    encoder,
    threshold: float = SIMILARITY_THRESHOLD,
    text: str = "content",
    key: str | None = None,
) -> DataFrame:
    """``trim_corpus`` for filters that are embedded already (ord, category, dim, bits)."""
    if isinstance(encoder, VectorTable):
        rows = encoder.attach(docs, key or text, "__embedding")
        matched = best_match_vectors(rows, bank, "__embedding", threshold).drop("__embedding")
    else:
        matched = best_match_texts(docs, bank, encoder, text, threshold)
    return matched


def trim_vectors(
    rows: DataFrame, bank: DataFrame, threshold: float = SIMILARITY_THRESHOLD, vector: str = "embedding"
) -> DataFrame:
    """The same for rows that carry their vector."""
    return best_match_vectors(rows, bank, vector, threshold)


def match_archive(
    spark: SparkSession,
    path: str,
    encoder,
    threshold: float = SIMILARITY_THRESHOLD,
    index: int | None = None,
    strict: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """The matching job on one archive that holds a filter CSV and a data CSV.

    Gives the matched rows (filename, content, ord, category, dist, dim, score).  Both members come from
    one reading of the central directory; the data is streamed.  ``index`` is the text's column, by
    default the digit that the archive's name ends in, else 0.
    """
    inputs = jobs.archive_inputs(spark, path)
    if index is None:
        index = spark.range(1).select(F.coalesce(column_index_from_name(F.lit(path)), F.lit(0))).first()[0]
    filters = jobs.filters_of_records(filter_files.read_filter_records(inputs["filters"])).drop("filename")
    return trim_corpus(jobs.scan_data_member(inputs["data"], index, strict, tasks), filters, encoder, threshold)


def match_archive_to_lines(spark: SparkSession, path: str, into: str, encoder, **options) -> None:
    """``match_archive`` written as result lines, ``filename : category : "text"``."""
    sinks.write_lines(match_archive(spark, path, encoder, **options), into)

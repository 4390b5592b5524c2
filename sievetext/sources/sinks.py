"""Writers.  Every task writes its own files; nothing is gathered first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_output_text, render_line


def result_lines(matches: DataFrame, text: str = "content") -> DataFrame:
    """One column ``line``: ``filename : category : "text"``."""
    return matches.select(render_line(F.col("filename"), F.col("category"), F.col(text)).alias("line"))


def write_lines(matches: DataFrame, path: str, text: str = "content", compression: str = "gzip") -> None:
    """One matched row per line, no header."""
    result_lines(matches, text).write.text(path, compression=compression)


#: The folder column of a table written by category; the file has the category itself, also where it is empty.
FOLDER = "of_category"


def write_matches(matches: DataFrame, path: str, text: str = "content", fmt: str = "parquet", by_category: bool = False) -> None:
    """The result table (category, score, data, filename, dist), as many files as tasks.

    Values are written as they are, also with blanks at their ends.  With ``by_category`` there is a
    folder for each category (``of_category=...``): rows are dealt out by category first, so that a small
    category is one file however many tasks found its rows, and a large one is as many files as it
    has parts of the advisory partition size, which adaptive execution splits it into.
    """
    table = matches.select("category", "score", clean_output_text(F.col(text)).alias("data"), "filename", "dist")
    folders = []
    if by_category:
        table, folders = table.hint("rebalance", "category").withColumn(FOLDER, F.col("category")), [FOLDER]
    if fmt == "csv":
        _as_csv(table, *folders).csv(path)
    else:
        table.write.partitionBy(*folders).format(fmt).save(path)


def _as_csv(table: DataFrame, *folders: str):
    writer = table.write.partitionBy(*folders).option("header", "true").option("escape", '"').option("emptyValue", "")
    return writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")


def write_normalized(corpus: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The normalised corpus; as CSV it has the two cells (filename, content) and a header."""
    if fmt == "csv":
        _as_csv(corpus.select("filename", "content")).csv(path)
    else:
        corpus.write.format(fmt).save(path)


def write_filters(filters: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A filter table (ord, category, anchors, request_id if there is one), as parquet or JSON."""
    names = [c for c in ("request_id", "ord", "category", "anchors") if c in filters.columns]
    filters.select(*names).write.format(fmt).save(path)

"""Text values of one file's content, as array columns.

Each function maps a content column to an array of values in file order, so that a
table of files stays one scan and one projection whatever kinds it mixes.
"""

from __future__ import annotations

import csv
import io
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import let
from ..functions.text import is_blank, normalize_text, split_lines

JSON_OPTIONS = {"allowSingleQuotes": "false"}
JSON_SPACE = " \t\n\r"


# ---------------------------------------------------------------- csv
def longest_csv_values(lines):
    """Yield the values of the field that is longest in the first data row.

    ``lines`` is an iterable of text lines.  The header is skipped, rows too short
    to have the field are skipped, empty values are kept.  Raises ``csv.Error`` where
    no field can be chosen or the text cannot be parsed.
    """
    csv.field_size_limit(sys.maxsize)
    records = csv.reader(lines)
    next(records, None)
    first = next(records, None)
    if first is None:
        return
    if not first:
        raise csv.Error("the first data row is blank")
    sizes = [len(cell) for cell in first]
    field = sizes.index(max(sizes))
    yield first[field]
    for record in records:
        if len(record) > field:
            yield record[field]


def _csv_values_or_none(content: str | None) -> list[str] | None:
    """The values up to where the text breaks off; null if there is none before that."""
    if content is None:
        return None
    values: list[str] = []
    try:
        for value in longest_csv_values(io.StringIO(content)):
            values.append(value)
    except csv.Error:
        return values or None
    return values


@F.arrow_udf(T.ArrayType(T.StringType()))
def _csv_longest(contents: pa.Array) -> pa.Array:
    return pa.array([_csv_values_or_none(c) for c in contents.to_pylist()], type=pa.list_(pa.string()))


def csv_values(text: Column) -> Column:
    """Values of the longest CSV column; null for a file from which none can be chosen."""
    return _csv_longest.asNondeterministic()(text)


# ---------------------------------------------------------------- json
def _longest_key(first_object: Column) -> Column:
    """Key of the longest value; the first one wins ties; a null counts as its four letters."""
    sized = F.transform(
        F.map_entries(first_object),
        lambda entry, i: F.struct(
            F.length(F.coalesce(entry["value"], F.lit("null"))).alias("size"),
            (-i).alias("back"),
            entry["key"].alias("key"),
        ),
    )
    return F.array_max(sized)["key"]


def _last_values(parsed: Column) -> Column:
    """An object that repeats a key keeps the key's first place and its last value."""

    def last_value(key: Column) -> Column:
        return F.element_at(F.filter(F.map_entries(parsed), lambda entry: entry["key"] == key), -1)["value"]

    keys = F.array_distinct(F.map_keys(parsed))
    return F.when(F.size(keys) == F.size(parsed), parsed).otherwise(
        F.map_from_arrays(keys, F.transform(keys, last_value))
    )


def json_values(text: Column) -> Column:
    """Values of one key of a JSON list of objects, or the longest value of one object.

    For a list the key is the one whose value is longest in the first object, and
    every object that has it gives its value.  Anything else gives null.  Nested
    values come as JSON text, nulls are left out.
    """
    def document(kind: str) -> Column:
        # First of a list of two, so that text after the document makes that list malformed, longer or shorter.
        second = "[]" if kind.startswith("array") else "{}"
        wrapped = F.concat(F.lit("["), text, F.lit(f",{second}]"))
        parsed = F.from_json(wrapped, f"array<{kind}>", JSON_OPTIONS)
        return let(parsed, lambda roots: F.when(F.size(roots) == 2, F.get(roots, F.lit(0))))

    def object_or_null(item: Column) -> Column:
        return F.when(item.startswith("{"), F.from_json(item, "map<string,string>", JSON_OPTIONS))

    # A list that mixes objects with other items: the other items are passed over.
    mixed = let(
        document("array<string>"),
        lambda items: F.when(
            F.get(items, F.lit(0)).startswith("{"),
            F.filter(F.transform(items, object_or_null), lambda item: item.isNotNull()),
        ),
    )

    def of_list(items: Column) -> Column:
        first = let(F.get(items, F.lit(0)), _last_values)
        return let(
            let(first, _longest_key),
            lambda key: F.filter(
                F.transform(items, lambda item: F.try_element_at(_last_values(item), key)),
                lambda value: value.isNotNull(),
            ),
        )

    def of_object(single: Column) -> Column:
        return F.filter(F.array(F.try_element_at(single, _longest_key(single))), lambda value: value.isNotNull())

    opening = F.substring(F.ltrim(text, F.lit(JSON_SPACE)), 1, 1)
    return F.when(
        opening == "[", let(F.coalesce(document("array<map<string,string>>"), mixed), of_list)
    ).when(opening == "{", let(document("map<string,string>"), lambda parsed: let(_last_values(parsed), of_object)))


# ---------------------------------------------------------------- whole files
def _exploded(files: DataFrame, values: Column, keep: Column) -> DataFrame:
    """(filename, row_no, content): normalised values of a table (filename, content)."""
    rows = files.select("filename", F.posexplode(values).alias("row_no", "value")).filter(keep)
    return rows.select(
        "filename", F.col("row_no").cast("long").alias("row_no"), normalize_text(F.col("value")).alias("content")
    )


def extract_txt_lines(files: DataFrame) -> DataFrame:
    """Non-blank lines of text files given as (filename, content)."""
    return _exploded(files, split_lines(F.col("content")), ~is_blank(F.col("value")))


def extract_csv_longest(files: DataFrame) -> DataFrame:
    """The longest column of CSV files given as (filename, content)."""
    parsed = files.select("filename", csv_values(F.col("content")).alias("values"))
    return _exploded(parsed, F.col("values"), F.lit(True))


def extract_json(files: DataFrame) -> DataFrame:
    """The longest key of JSON files given as (filename, content)."""
    return _exploded(files, json_values(F.col("content")), F.lit(True))


def union_extracts(*extracts: DataFrame) -> DataFrame:
    """All rows of all extracts, duplicates kept."""
    result = extracts[0]
    for extract in extracts[1:]:
        result = result.unionByName(extract)
    return result

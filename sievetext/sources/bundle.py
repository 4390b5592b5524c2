"""Mixed bundles: a zip, or a folder of zips and .txt / .csv / .json files.

Plain text files go through Spark's own splittable reader and plain CSV files are split at
record boundaries (``csv_splits``).  For everything else the executors first list the members
(central directories only, no content) and then stream them: text members come in blocks cut at
line ends, CSV members row by row and JSON lists item by item, so these pass through a bounded
buffer whatever their size (a JSON document that is one object is held whole).  A zip member itself
is read by one task, since deflate cannot be entered in the middle.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import let
from ..functions.text import decode_lossy, is_blank, normalize_text, split_lines, strip_bom
from . import csv_splits, json_items
from .extract import json_values, longest_csv_values

BLOCK_BYTES = 4 << 20
ROWS_PER_BATCH = 4096
# The extensions read (case matters) and the folder that is passed over.
EXTENSIONS = (".txt", ".json", ".csv")
IGNORED_PREFIX = "__MACOSX"

NOT_READABLE = "neither an archive nor a file with a known extension"
NO_JSON_VALUE = "no value can be taken from this JSON document"

MEMBER_SCHEMA = "path string, filename string, member_no long, size long"
PIECE_SCHEMA = "filename string, kind string, block long, row_no long, value string, head string, error string"


def filesystem_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the place in it of a Spark path (``file:/x``, ``hdfs://``, ``s3a://``...)."""
    if re.match(r"^file:/", path):
        return pafs.LocalFileSystem(), "/" + path.split(":", 1)[1].lstrip("/")
    if urlsplit(path).scheme:
        return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return pafs.LocalFileSystem(), path


def open_path(path: str):
    """A seekable file for a Spark path."""
    files, inner = filesystem_of(path)
    return files.open_input_file(inner)


def _below(root: str) -> str:
    """The part of a root path that every path below it has, whatever its scheme."""
    return re.sub(r"^[a-z0-9]+:/{0,2}(?=/)|^[a-z0-9]+://", "", root).rstrip("/") + "/"


def relative_name(path: Column, root: str) -> Column:
    """A file's name below the folder that was read; a single file keeps its base name."""
    inner = _below(root)
    at = F.instr(path, inner)
    below = path.substr(at + F.lit(len(inner)), F.length(path))
    return F.when(at > 0, below).otherwise(F.substring_index(path, "/", -1))


def _ignored(path: Column, root: str) -> Column:
    return relative_name(path, root).startswith(IGNORED_PREFIX)


def _kind(filename: Column) -> Column:
    return F.regexp_extract(filename, r"\.(txt|json|csv)$", 1)


def _has_extension(path: Column) -> Column:
    return F.substring_index(path, "/", -1).contains(".")


def _wanted(filename: Column) -> Column:
    return ~filename.startswith(IGNORED_PREFIX) & (_kind(filename) != "")


MEMBER_ARROW = pa.schema([("path", pa.string()), ("filename", pa.string()), ("member_no", pa.int64()), ("size", pa.int64())])


def archive_members(path: str) -> list[dict]:
    """The files in an archive, from its central directory; one unreadable row (size -1) if it is no archive."""
    try:
        with open_path(path) as raw, zipfile.ZipFile(raw) as archive:
            return [
                {"path": path, "filename": info.filename, "member_no": i, "size": info.file_size}
                for i, info in enumerate(archive.infolist())
                if not info.is_dir()
            ]
    except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter: shorter than a directory's end
        return [{"path": path, "filename": None, "member_no": -1, "size": -1}]


def _list_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch["path"].to_pylist():
            yield pa.RecordBatch.from_pylist(archive_members(path), schema=MEMBER_ARROW)


def _plain_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path`` as members, none of them opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = relative_name(F.col("path"), path)
    return files.select("path", name.alias("filename"), F.lit(-1).cast("long").alias("member_no"), F.col("length").alias("size"))


def archived_files(spark: SparkSession, path: str) -> DataFrame:
    """The members of all archives below ``path``; a file that should be an archive and is not has size -1.

    An archive is what ends in .zip, in any case, and what has no extension at all.
    """
    files = _plain_files(spark, path).filter(
        F.lower("path").endswith(".zip") | ~_has_extension(F.col("path")) & ~F.col("filename").startswith(IGNORED_PREFIX)
    )
    members = files.select("path").mapInArrow(_list_archives, MEMBER_SCHEMA)
    return members.withColumn("filename", F.coalesce("filename", relative_name(F.col("path"), path)))


def scan_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Members to read: (path, filename, member_no, size), without any content.

    Folders and ``__MACOSX`` entries are left out; only the three extensions give
    rows, and their case matters.  ``path`` is the archive or the file itself;
    ``member_no`` is the place in the archive, -1 for a plain file.  A file without any extension
    is read as an archive; ``bundle_errors`` lists those that are none.
    """
    files = _plain_files(spark, path).unionByName(archived_files(spark, path))
    return files.filter(_wanted(F.col("filename")) & (F.col("size") >= 0))


class _Batches:
    """Collects output rows and hands them on in record batches."""

    schema = pa.schema(
        [
            ("filename", pa.string()), ("kind", pa.string()), ("block", pa.int64()),
            ("row_no", pa.int64()), ("value", pa.string()), ("head", pa.string()), ("error", pa.string()),
        ]
    )

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, filename, kind, block, row_no, value, error=None, head=None):
        self.rows.append((filename, kind, block, row_no, value, head, error))
        self.size += len(value or "") + len(head or "")

    def full(self) -> bool:
        return len(self.rows) >= ROWS_PER_BATCH or self.size >= BLOCK_BYTES

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows)
        arrays = [pa.array(column, type=field.type) for column, field in zip(columns, self.schema)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _line_blocks(stream) -> Iterator[bytes]:
    """Whole lines in blocks of a few megabytes, cut at any one-byte line break.

    A carriage return at the end of what was read may belong to a pair, so no cut is made there.
    """
    held: list[bytes] = []
    while chunk := stream.read(BLOCK_BYTES):
        cut = max(chunk.rfind(b"\n"), *(chunk.rfind(b, 0, len(chunk) - 1) for b in (b"\r", b"\x0b", b"\x0c"))) + 1
        if cut:
            yield b"".join([*held, chunk[:cut]])
            held = []
        held.append(chunk[cut:])
    if rest := b"".join(held):
        yield rest


def _read_json(open_member: Callable, filename: str, out: _Batches, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """A short document as it is; a longer list as lists of about ``block_bytes``, each with the list's first item.

    A list is read twice, so that one which turns out to be broken gives no rows, as a short one does.
    """
    with open_member() as stream:
        start = stream.read(block_bytes)
        rest = stream.read(1)
        if not rest or not start.lstrip(json_items.SPACE.encode()).startswith(b"["):
            out.add(filename, "json", 0, 0, (start + rest + stream.read()).decode("utf-8", errors="replace"))
            return
    try:
        with open_member() as stream:
            first = None
            for item in json_items.checked_items(json_items.decoded(stream)):
                first = first or item
        if not first or not first.startswith("{"):
            raise ValueError(NO_JSON_VALUE)
    except ValueError as problem:
        out.add(filename, "json", 0, -1, None, str(problem))
        return
    with open_member() as stream:
        items = json_items.list_items(json_items.decoded(stream))
        for block, (head, text) in enumerate(json_items.item_blocks(items, block_bytes)):
            out.add(filename, "json", block, 0, text, head=head)
            if out.full():
                yield out.take()


def _read_member(open_member: Callable, filename: str, out: _Batches, block_bytes: int) -> Iterator[pa.RecordBatch]:
    kind = filename.rsplit(".", 1)[1]
    if kind == "json":
        yield from _read_json(open_member, filename, out, block_bytes)
    elif kind == "txt":
        with open_member() as stream:
            for block, data in enumerate(_line_blocks(stream)):
                out.add(filename, kind, block, 0, data.decode("utf-8", errors="replace"))
                if out.full():
                    yield out.take()
    else:
        with open_member() as stream:
            lines = io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n")
            try:
                for row_no, value in enumerate(longest_csv_values(lines)):
                    out.add(filename, kind, 0, row_no, value)
                    if out.full():
                        yield out.take()
            except csv.Error as problem:
                out.add(filename, kind, 0, -1, None, str(problem))
    if out.full():
        yield out.take()


@contextmanager
def open_buffered(path: str):
    with open_path(path) as raw, io.BufferedReader(raw) as stream:
        yield stream


@contextmanager
def member_stream(path: str, member_no: int):
    """A stream of one member of ``scan_bundle``: of the file itself if ``member_no`` is -1."""
    if member_no < 0:
        with open_buffered(path) as stream:
            yield stream
        return
    with open_path(path) as raw, zipfile.ZipFile(raw) as archive, archive.open(archive.infolist()[member_no]) as stream:
        yield stream


def read_member_batches(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    out = _Batches()
    archive_path, archive, raw = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["size"] < 0:
                out.add(row["filename"], "", 0, -1, None, NOT_READABLE)
                continue
            if row["member_no"] < 0:
                yield from _read_member(lambda: open_buffered(row["path"]), row["filename"], out, block_bytes)
                continue
            if row["path"] != archive_path:
                if archive is not None:
                    archive.close()
                    raw.close()
                raw = open_path(row["path"])
                archive_path, archive = row["path"], zipfile.ZipFile(raw)
            info = archive.infolist()[row["member_no"]]
            yield from _read_member(lambda: archive.open(info), row["filename"], out, block_bytes)
    if archive is not None:
        archive.close()
        raw.close()
    if out.rows:
        yield out.take()


def _default_tasks(df: DataFrame, tasks: int | None) -> int:
    return tasks or 4 * df.sparkSession.sparkContext.defaultParallelism


def read_members(members: DataFrame, tasks: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stream the members of ``scan_bundle`` as pieces.

    Only the member list is shuffled, to spread members over tasks; the number of
    tasks is explicit because the list's own size says nothing about the work.
    """
    spread = members.repartition(_default_tasks(members, tasks), "path", "member_no").sortWithinPartitions("path", "member_no")
    return spread.mapInArrow(lambda batches: read_member_batches(batches, block_bytes), PIECE_SCHEMA)


def _read_csv_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Batches()
    for batch in batches:
        for row in batch.to_pylist():
            name, block = row["filename"], row["split_no"]
            if row["problem"] is not None:
                out.add(name, "csv", block, -1, None, row["problem"])
                continue
            with open_buffered(row["path"]) as stream:
                try:
                    for row_no, value in csv_splits.split_values(row, stream):
                        out.add(name, "csv", block, row_no, value)
                        if out.full():
                            yield out.take()
                except csv.Error as problem:
                    out.add(name, "csv", block, -1, None, str(problem))
    if out.rows:
        yield out.take()


def read_csv_files(members: DataFrame, tasks: int | None = None, split_bytes: int = csv_splits.SPLIT_BYTES) -> DataFrame:
    """Plain CSV files as pieces, each file by as many tasks as it has splits; ``block`` is the split's number."""
    parts = csv_splits.parse_tasks(members, open_buffered, _default_tasks(members, tasks), split_bytes)
    return parts.mapInArrow(_read_csv_splits, PIECE_SCHEMA)


def _json_part(text: Column, head: Column) -> Column:
    """The values of one part of a list; ``head`` is the list's first item, whose key counts, if it is not in the part."""
    whole = F.concat(F.lit("["), head, F.lit(","), F.substring(text, 2, 2147483647))
    of_head = F.size(json_values(F.concat(F.lit("["), head, F.lit("]"))))
    rest = let(json_values(whole), lambda values: F.slice(values, of_head + 1, F.greatest(F.size(values) - of_head, F.lit(0))))
    return F.when(head.isNull(), json_values(text)).otherwise(rest)


def found_in(pieces: DataFrame) -> DataFrame:
    """(filename, block, row_no, content, error): a value that was found, or why a member gives none or no more."""
    text = F.col("value")
    first_block = F.when(F.col("block") == 0, strip_bom(text)).otherwise(text)
    values = (
        F.when(F.col("kind") == "txt", split_lines(first_block))
        .when(F.col("kind") == "json", _json_part(text, F.col("head")))
        .otherwise(F.array(text))
    )
    # a member's problem is one row without a value
    none = (F.col("kind") == "json") & F.col("head").isNull() & (F.coalesce(F.size("values"), F.lit(0)) <= 0)
    problem = F.coalesce("error", F.when(none, F.lit(NO_JSON_VALUE)))
    named = pieces.select("filename", "kind", "block", "row_no", "head", "error", values.alias("values"))
    named = named.withColumn("error", problem)
    kept = F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(F.col("values"))
    found = named.select("filename", "kind", "block", "row_no", "error", F.posexplode(kept).alias("pos", "value"))
    return found.filter(F.col("error").isNotNull() | (F.col("kind") != "txt") | ~is_blank(F.col("value"))).select(
        "filename",
        "block",
        (F.col("row_no") + F.col("pos")).alias("row_no"),
        normalize_text(F.col("value")).alias("content"),
        "error",
    )


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the plain .txt files below a folder, with Spark's splittable reader.

    ``block`` is the start of the file split and ``row_no`` grows within it, so
    (block, row_no) orders the lines of a file; row numbers have gaps.
    """
    encoded = F.col("_metadata.file_path")
    decoded = F.when(
        encoded.contains("%"), F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    ).otherwise(encoded)
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
        .filter(~encoded.contains("/" + IGNORED_PREFIX) | ~_ignored(decoded, path))
        .select(
            relative_name(decoded, path).alias("filename"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line_no"),
            decode_lossy(F.col("value")).alias("value"),
        )
    )
    parts = lines.select("filename", "block", "line_no", F.posexplode(split_lines(F.col("value"))).alias("pos", "value"))
    return parts.filter(~is_blank(F.col("value"))).select(
        "filename",
        "block",
        F.col("line_no").alias("row_no"),
        F.col("pos").cast("long").alias("part_no"),
        normalize_text(F.col("value")).alias("content"),
    )


def _rows_and_errors(spark: SparkSession, path: str, tasks: int | None, split_bytes: int, block_bytes: int) -> DataFrame:
    """(filename, block, row_no, part_no, content, error) of everything below ``path``, each byte read once."""
    files = _plain_files(spark, path).filter(_wanted(F.col("filename")))
    in_archives = archived_files(spark, path).filter(_wanted(F.col("filename")) | (F.col("size") < 0))
    streamed = read_members(files.filter(F.col("filename").endswith(".json")).unionByName(in_archives), tasks, block_bytes)
    split = read_csv_files(files.filter(F.col("filename").endswith(".csv")), tasks, split_bytes)
    rows = found_in(streamed.unionByName(split)).withColumn("part_no", F.lit(0).cast("long"))
    lines = read_text_folder(spark, path).withColumn("error", F.lit(None).cast("string"))
    return lines.unionByName(rows)


def read_bundle(
    spark: SparkSession,
    path: str,
    tasks: int | None = None,
    split_bytes: int = csv_splits.SPLIT_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The whole bundle as (filename, block, row_no, part_no, content), normalised.

    (block, row_no, part_no) orders the rows of a file.  Plain CSV files are read by splits of
    ``split_bytes``, JSON lists above ``block_bytes`` item by item.
    """
    found = _rows_and_errors(spark, path, tasks, split_bytes, block_bytes)
    return found.filter(F.col("error").isNull()).drop("error")


def bundle_errors(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """(filename, error) of CSV files that broke off, whose rows before that are kept, of JSON
    documents that give no value, and of files without an extension that are no archives.

    This reads the bundle for the errors alone; ``write_bundle`` gives rows and errors of one run.
    """
    found = _rows_and_errors(spark, path, tasks, csv_splits.SPLIT_BYTES, BLOCK_BYTES)
    return found.filter(F.col("error").isNotNull()).select("filename", "error")


@dataclass(frozen=True)
class BundleRun:
    """What one reading of a bundle gave: its rows, its errors, and how many of each were counted on the way."""

    rows: DataFrame
    errors: DataFrame
    counts: dict[str, int]


def write_bundle(
    spark: SparkSession, path: str, into: str, tasks: int | None = None, split_bytes: int = csv_splits.SPLIT_BYTES
) -> BundleRun:
    """Read a bundle once and write its rows and its errors side by side below ``into``.

    ``counts`` are taken while the job runs: rows, errors and the characters of the rows.
    """
    counts = Observation()
    found = _rows_and_errors(spark, path, tasks, split_bytes, BLOCK_BYTES)
    good = F.col("error").isNull()
    found = found.observe(
        counts,
        F.count_if(good).alias("rows"),
        F.count_if(~good).alias("errors"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("characters"),
    )
    found.withColumn("part", F.when(good, F.lit("rows")).otherwise(F.lit("errors"))).write.partitionBy("part").parquet(into)
    written = spark.read.schema(found.schema.add("part", "string")).parquet(into)
    rows = written.filter("part = 'rows'").drop("part", "error")
    errors = written.filter("part = 'errors'").select("filename", "error")
    return BundleRun(rows, errors, {name: int(n) for name, n in counts.get.items()})

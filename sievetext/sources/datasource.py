"""Bundles as a Spark data source, in batches and as a stream of arriving archives.

    register_bundle_source(spark)
    pieces = spark.read.format("sievetext_bundle").load(folder)
    arriving = spark.readStream.format("sievetext_bundle").load(folder)
    rows = bundle_rows(pieces)          # the rows of read_bundle, for either

A piece is what a member's stream gives before Spark splits, parses and normalises it, so the same
expressions make rows of both.  An input partition is one member, or several small ones.  Their list
is made by one Python process, which opens every archive's directory: meant for folders whose listing
one process can make; ``read_bundle`` lists on the executors and splits plain text and CSV files.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import bundle

FORMAT = "sievetext_bundle"
#: Seconds after its last change from which a file counts as arrived.
SETTLE_SECONDS = 2.0


#: A partition takes further members up to these.
PARTITION_BYTES, PARTITION_MEMBERS = 8 << 20, 256


@dataclass(frozen=True)
class Member:
    """One member of an archive, or a file of its own."""

    path: str
    filename: str
    member_no: int
    size: int


@dataclass
class Members(InputPartition):
    """One large member, or some that follow each other."""

    members: list[Member]


def packed(members: list[Member]) -> list[Members]:
    """The members in their order, as partitions."""
    parts: list[Members] = []
    size = 0
    for member in members:
        if not parts or size + member.size > PARTITION_BYTES or len(parts[-1].members) >= PARTITION_MEMBERS:
            parts.append(Members([]))
            size = 0
        parts[-1].members.append(member)
        size += max(member.size, 0)
    return parts


def _files(root: str) -> list[pafs.FileInfo]:
    files, inner = bundle.filesystem_of(root)
    info = files.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.type == pafs.FileType.File:
        return [info]
    return [f for f in files.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.type == pafs.FileType.File]


def _address(root: str, inner: str) -> str:
    """The Spark path of a file that a listing of ``root`` named ``inner``."""
    scheme, mark, rest = root.partition("://")
    return f"{scheme}://{rest.split('/', 1)[0]}/{inner.lstrip('/')}" if mark and scheme == "hdfs" else f"{scheme}://{inner}" if mark else inner


def _name_below(root: str, inner: str) -> str:
    folder = bundle.filesystem_of(root)[1].rstrip("/") + "/"
    return inner[len(folder) :] if inner.startswith(folder) else inner.rsplit("/", 1)[-1]


def members_of(root: str, files: list[pafs.FileInfo]) -> list[Member]:
    """The members to read among ``files``, by the rules of ``scan_bundle``; those that can't be read come with size -1."""
    found = []
    for info in files:
        name, path = _name_below(root, info.path), _address(root, info.path)
        base = info.base_name
        if base.startswith((".", "_")):  # as Spark's own readers do
            continue
        if base.lower().endswith(".zip") or "." not in base and not name.startswith(bundle.IGNORED_PREFIX):
            listed = bundle.archive_members(path)
            found += [Member(path, m["filename"] or name, m["member_no"], m["size"]) for m in listed]
        else:
            found.append(Member(path, name, -1, info.size))
    wanted = lambda m: m.size < 0 or m.filename.endswith(bundle.EXTENSIONS) and not m.filename.startswith(bundle.IGNORED_PREFIX)
    return [m for m in found if wanted(m)]


def _read(partition: Members) -> Iterator[pa.RecordBatch]:
    rows = pa.RecordBatch.from_pylist([asdict(m) for m in partition.members], schema=bundle.MEMBER_ARROW)
    return bundle.read_member_batches(iter([rows]), bundle.BLOCK_BYTES)


class BundleReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Members]:
        return packed(members_of(self.root, _files(self.root)))

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class ArrivingBundles(DataSourceStreamReader):
    """Files by the time of their last change: an offset is the time up to which they have been read.

    A file counts once that time lies ``settle`` seconds back, so that none arrives unnoticed within the
    clock's resolution.  A file put there with an earlier time than the last offset is not read.
    """

    def __init__(self, root: str, settle: float):
        self.root, self.settle = root, settle

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        limit = time.time_ns() - int(self.settle * 1e9)
        return {"until": max((f.mtime_ns for f in _files(self.root) if f.mtime_ns <= limit), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Members]:
        arrived = [f for f in _files(self.root) if start["until"] < f.mtime_ns <= end["until"]]
        return packed(members_of(self.root, arrived))

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch."""


class BundleSource(DataSource):
    """Options: ``path`` and, for streams, ``settle`` (seconds)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return bundle.PIECE_SCHEMA

    def reader(self, schema) -> BundleReader:
        return BundleReader(self.options["path"])

    def streamReader(self, schema) -> ArrivingBundles:
        return ArrivingBundles(self.options["path"], float(self.options.get("settle", SETTLE_SECONDS)))


def register_bundle_source(spark: SparkSession) -> None:
    spark.dataSource.register(BundleSource)


def bundle_rows(pieces: DataFrame) -> DataFrame:
    """(filename, block, row_no, content) of pieces, batch or stream: what ``read_bundle`` gives."""
    return bundle.found_in(pieces).filter(F.col("error").isNull()).drop("error")


def bundle_problems(pieces: DataFrame) -> DataFrame:
    """(filename, error) of pieces: what ``bundle_errors`` gives."""
    return bundle.found_in(pieces).filter(F.col("error").isNotNull()).select("filename", "error")

"""Token ids in binary files with a minimal perfect hash index.

Payload: one file per range of doc_id, raw little-endian ids behind a 16-byte header, two bytes
each where the vocabulary fits, else four.  Index: documents' keys are dealt into buckets; a
bucket's hash (hash and displace: one seed for every few keys) sends its keys one to one onto
its slots, and a slot holds a fingerprint of its key, the shard, the place in it, the count and
the ids before.  A lookup reads one seed and one slot; a foreign key fails the fingerprint.

Every file's name holds a token of the task attempt that wrote it, and only names that
successful tasks return are used, so retried and doubled tasks do no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_folder, lean, stored, text_of
from .encoding import encoder, tokenizer_path

MAGIC = b"SIDS"
HEADER = "<4sIQ"  # magic, bytes per id, count
HEADER_BYTES = struct.calcsize(HEADER)
BUCKET_KEYS = 1000
FILE_KEYS = 50_000
#: Keys per seed, about.
GROUP = 4
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("count", "<u8"), ("before", "<u8")])


def _mix(x: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over x and a salt."""
    with np.errstate(over="ignore"):
        x = x ^ (np.asarray(salt, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def key_print(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes, 1 << 40) >> np.uint64(32)).astype(np.uint32)


def build_hash(hashes: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash of distinct 64-bit keys: ``slots`` is then one to one.

    Groups of keys get seeds, largest group first; a group of one key is given a free slot
    outright, written as a negative seed.
    """
    n = len(hashes)
    if len(np.unique(hashes)) != n:
        raise ValueError("two keys have the same 64-bit hash")
    groups = -(-n // GROUP)
    group = (_mix(hashes, 1 << 41) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    seeds, taken = np.zeros(groups, np.int32), np.zeros(n, bool)
    single: list[int] = []
    for g in np.argsort(-sizes, kind="stable").tolist():
        members = hashes[order[starts[g] : starts[g + 1]]]
        if len(members) < 2:
            single += [g] * len(members)
            continue
        first, tries = 0, 16
        while True:
            slots = (_mix(members[None, :], np.arange(first, first + tries)[:, None]) % np.uint64(n)).astype(np.int64)
            slots.sort(axis=1)
            fits = ~taken[slots].any(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1)
            if fits.any():
                at = int(np.argmax(fits))
                seeds[g], taken[slots[at]] = first + at, True
                break
            first, tries = first + tries, min(4096, tries * 2)
    free = np.flatnonzero(~taken)
    seeds[single] = -free - 1
    return seeds


def slots(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    group = (_mix(hashes, 1 << 41) % np.uint64(len(seeds))).astype(np.int64)
    seed = seeds[group].astype(np.int64)
    tried = (_mix(hashes, np.maximum(seed, 0)) % np.uint64(n)).astype(np.int64)
    return np.where(seed < 0, -seed - 1, tried)


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _write_shard(folder: str, path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path("byte_bpe_50k.json"))
        files, root = _open(folder)
        shard, name = TaskContext.get().partitionId(), f"ids-{uuid.uuid4().hex}.bin"
        at, last, nth, out = 0, object(), 0, None
        end = np.array([end_id], encode.kind).tobytes()
        for batch in batches:
            if out is None:
                out = files.open_output_stream(f"{root}/{name}")
                out.write(struct.pack(HEADER, MAGIC, encode.kind.itemsize, 0))
            keys = batch.column("doc_id").to_pylist()
            rows = []
            for key, ids in zip(keys, encode.ids(batch.column("text").to_pylist()), strict=True):
                nth = nth + 1 if key == last else 0
                last = key
                out.write(ids.tobytes() + end)
                rows.append((key, nth, shard, name, at, len(ids) + 1))
                at += len(ids) + 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "nth", "shard", "file", "at", "n"])
        if out is not None:
            out.close()

    return run


def _write_index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        held: list[pa.RecordBatch] = []

        def flush(part: pa.Table) -> pa.RecordBatch:
            """One index file: bucket directory, seeds, slots."""
            name = f"index-{uuid.uuid4().hex}.bin"
            bucket = part["bucket"].to_numpy()
            hashes = part["hash"].to_numpy().view(np.uint64)
            numbers, starts = np.unique(bucket, return_index=True)
            edges = [*starts.tolist(), len(bucket)]
            seeds, records = [], []
            columns = {c: part[c].to_numpy() for c in ("shard", "at", "n", "before")}
            for s, e in zip(edges, edges[1:]):
                own = hashes[s:e]
                seeds.append(build_hash(own))
                place = slots(own, seeds[-1], len(own))
                record = np.zeros(len(own), SLOT)
                record["print"][place] = key_print(own)
                for field, column in (("shard", "shard"), ("at", "at"), ("count", "n"), ("before", "before")):
                    record[field][place] = columns[column][s:e]
                records.append(record)
            counts = np.array([len(r) for r in records], "<u8")
            groups = np.array([len(s) for s in seeds], "<u8")
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(struct.pack(HEADER, b"SIDX", 1, len(numbers)))
                for array in (numbers.astype("<u8"), counts, groups):
                    out.write(array.tobytes())
                out.write(np.concatenate(seeds).astype("<i4").tobytes())
                out.write(np.concatenate(records).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([part["part"][0].as_py()], pa.int64()), pa.array([name])], names=["part", "index"])

        for batch in batches:  # sorted by part: a part is complete once the next begins
            parts = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for s, e in zip(edges, edges[1:]):
                if held and held[-1].column("part")[0].as_py() != parts[s]:
                    yield flush(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


class Index:
    """One index file in memory; ``find`` looks keys up."""

    def __init__(self, folder: str, name: str):
        files, root = _open(folder)
        with files.open_input_stream(f"{root}/{name}") as file:
            data = file.read()
        _, _, n = struct.unpack_from(HEADER, data)
        self.numbers, self.counts, self.groups = (np.frombuffer(data, "<u8", n, HEADER_BYTES + 8 * n * i).astype(np.int64) for i in range(3))
        at = HEADER_BYTES + 24 * n
        self.seeds = np.frombuffer(data, "<i4", int(self.groups.sum()), at)
        self.records = np.frombuffer(data, SLOT, int(self.counts.sum()), at + 4 * len(self.seeds))
        self.first_seed = np.concatenate(([0], np.cumsum(self.groups)))
        self.first_slot = np.concatenate(([0], np.cumsum(self.counts)))

    def find(self, buckets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the slots of all (of no meaning where they aren't)."""
        place = np.minimum(np.searchsorted(self.numbers, buckets), len(self.numbers) - 1)
        group = (_mix(hashes, 1 << 41) % self.groups[place].astype(np.uint64)).astype(np.int64)
        seed = self.seeds[self.first_seed[place] + group].astype(np.int64)
        tried = (_mix(hashes, np.maximum(seed, 0)) % self.counts[place].astype(np.uint64)).astype(np.int64)
        found = self.records[self.first_slot[place] + np.where(seed < 0, -seed - 1, tried)]
        return (self.numbers[place] == buckets) & (found["print"] == key_print(hashes)), found


class TokenFiles:
    """Written token files; ``lookup`` gives documents by key, ``ids`` their ids."""

    def __init__(self, folder: str, buckets: int, parts: DataFrame, shards: DataFrame):
        self.folder, self.buckets, self.parts, self.shards = folder, buckets, parts, shards

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(doc_id, nth, file, at, n, before) of keys (doc_id, nth); unknown keys are left out."""
        asked = keyed(keys, self.buckets).select("doc_id", "nth", "hash", "bucket", "part")
        asked = asked.join(F.broadcast(self.parts), "part")  # a row per FILE_KEYS documents
        asked = asked.repartition("index").sortWithinPartitions("index")
        schema = "doc_id long, nth long, shard int, at long, n long, before long"
        return asked.mapInArrow(_find(self.folder), schema).join(F.broadcast(self.shards), "shard")

    def ids(self, places: DataFrame) -> DataFrame:
        """(doc_id, nth, before, ids array<long>) read from the payload at what ``lookup`` gave."""
        kind = "doc_id long, nth long, before long, ids array<long>"
        return self._read(places).mapInArrow(_ids(self.folder), kind)

    def digests(self, places: DataFrame) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, read from the payload at what ``lookup`` gave."""
        return self._read(places).mapInArrow(lean(_digests(self.folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")

    @staticmethod
    def _read(places: DataFrame) -> DataFrame:
        return places.repartition("file").sortWithinPartitions("file", "at")


def keyed(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (doc_id, nth) with their key's hash, bucket and index part."""
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "nth"))
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    return rows.withColumn("part", F.floor(F.col("bucket") / (FILE_KEYS // BUCKET_KEYS)))


def _find(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, index = None, None
        for batch in batches:
            names = batch.column("index").to_pylist()
            edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                if names[s] != name:
                    name, index = names[s], Index(folder, names[s])
                known, found = index.find(part.column("bucket").to_numpy(), part.column("hash").to_numpy().view(np.uint64))
                mask = pa.array(known)
                arrays = [part.column("doc_id").filter(mask), part.column("nth").filter(mask)]
                arrays += [pa.array(found[f][known].astype(k)) for f, k in (("shard", "<i4"), ("at", "<i8"), ("count", "<i8"), ("before", "<i8"))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "nth", "shard", "at", "n", "before"])

    return run


def _payload(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    files, root = _open(folder)
    name, file, kind = None, None, None
    for batch in batches:
        found = []
        for own, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n")), strict=True):
            if own != name:
                if file is not None:
                    file.close()
                name, file = own, files.open_input_file(f"{root}/{own}")
                magic, width, _ = struct.unpack(HEADER, file.read_at(HEADER_BYTES, 0))
                if magic != MAGIC:
                    raise ValueError(f"{own} is no file of token ids")
                kind = np.dtype(f"<u{width}")
            data = file.read_at(n * kind.itemsize, HEADER_BYTES + at * kind.itemsize)
            if len(data) != n * kind.itemsize:
                raise ValueError(f"{own} ends early")
            found.append(np.frombuffer(data, kind))
        yield batch, found
    if file is not None:
        file.close()


def _digests(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _payload(folder, batches):
            sums = pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in found], pa.int64())
            arrays = [batch.column("doc_id"), batch.column("before"), batch.column("n"), sums]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _ids(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _payload(folder, batches):
            ids = pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))
            arrays = [batch.column("doc_id"), batch.column("nth"), batch.column("before"), ids]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "nth", "before", "ids"])

    return run


def write(docs: DataFrame, end_id: int = 2, path: str | None = None, folder: str | None = None) -> TokenFiles:
    """Encode every row once and write payload and index in ascending doc_id order.

    Each document ends with ``end_id``.  Null ids come first; rows with the same id lie together, by
    text, and are told apart by ``nth`` from 0.  A null text is empty; no rows give no files.
    """
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "tokens")
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "doc_id long, nth long, shard int, file string, at long, n long"
    entries = stored(ranged.mapInArrow(lean(_write_shard(folder, path, end_id)), schema), "entries")
    totals = entries.groupBy("shard", "file").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).orderBy("shard").collect()
    before, shards, count = 0, [], 0  # one row per file
    for row in totals:
        shards.append((row["shard"], row["file"], before))
        before, count = before + row["n"], count + row["rows"]
    bases = spark.createDataFrame(shards, "shard int, file string, base long")
    buckets = max(1, count // BUCKET_KEYS)
    placed = keyed(entries, buckets).join(F.broadcast(bases.select("shard", "base")), "shard")
    placed = placed.select("part", "bucket", "hash", "shard", "at", "n", (F.col("base") + F.col("at")).alias("before"))
    parts = placed.repartition("part").sortWithinPartitions("part", "bucket").mapInArrow(_write_index(folder), "part long, index string")
    return TokenFiles(folder, buckets, stored(parts, "parts"), bases.select("shard", "file"))


def written_and_read(docs: DataFrame, end_id: int = 2, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, looked up by key in files just written."""
    tokens = write(docs, end_id, path)
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    keys = counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth"))
    return tokens.digests(tokens.lookup(keys))

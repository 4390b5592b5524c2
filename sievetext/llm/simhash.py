"""SimHash near-duplicates by covering locality-sensitive hashing.

Every pair of fingerprints that differ in at most ``radius`` bits shares a table:
bit i gets a nonzero vector m(i) of radius + 1 bits, table v (any nonzero vector) keeps
the bits with <m(i), v> odd.  The vectors of the differing bits span at most ``radius``
dimensions, so some v is orthogonal to all of them and its table drops just those bits.
A bucket too large for one comparison is split by a second such family over the bits its
table dropped, which again keeps every pair; what is left then differs in so few bits that
a bucket can hold no more than 2^(dropped bits) fingerprints, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, row_key, spare, stored, text_of

BITS = 64
#: Shingles whose bits are counted at once, so that a text of any length needs little memory.
CHUNK = 1 << 15


def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of a text as an unsigned number; 0 if it has no word.

    A-Z are lower-cased, words are runs without ASCII white space, shingles of ``width``
    words keep repeats; a text of fewer words is one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)
        hashes = np.array([digest(line[s:e], 42) for s, e in part], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def masks(radius: int, bits: list[int]) -> list[int]:
    """The masks of the covering family over the given bit places."""
    count = (1 << (radius + 1)) - 1
    kept = []
    for v in range(1, count + 1):
        mask = 0
        for place, bit in enumerate(bits):
            if ((place % count + 1) & v).bit_count() % 2:
                mask |= 1 << bit
        kept.append(mask)
    return kept


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keys(masks_: list[int], column: str) -> F.Column:
    found = [F.struct(F.lit(i).alias("t"), F.col(column).bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks_)]
    return F.array(*found)


def near_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the fingerprints of a bucket just as all its near pairs would.

    Breadth first: a fingerprint is compared with those not reached yet only, so a bucket
    of near copies costs little more than one comparison each.
    """
    rest = values.astype(np.uint64)
    ends: list[np.ndarray] = []
    seeds: list[np.ndarray] = []
    while len(rest):
        seed, rest = rest[0], rest[1:]
        front = [seed]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                reached, rest = rest[near], rest[~near]
                ends.append(reached)
                seeds.append(np.full(len(reached), seed, np.uint64))
                front.extend(reached)
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(seeds).view(np.int64), np.concatenate(ends).view(np.int64)


def _bucket_links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            found = [near_links(values[s:e], radius) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            a = np.concatenate([x for x, _ in found] or [np.zeros(0, np.int64)])
            b = np.concatenate([x for _, x in found] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


def fingerprint_links(prints: DataFrame, radius: int = 3, bucket: int = 2048) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``fp`` within ``radius`` bits.

    ``prints``: distinct fingerprints ``fp`` (signed long).  Buckets of up to ``bucket`` fingerprints
    are compared as they are, larger ones after a second split; neither loses a pair.
    """
    first = masks(radius, list(range(BITS)))
    keyed = prints.select("fp", F.explode(_keys(first, "fp")).alias("x")).select("fp", "x.t", "x.k")
    counts = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keyed.join(counts, ["t", "k"]), "buckets")
    small = met.where(F.col("n") <= bucket).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    again = []
    for i, mask in enumerate(first):
        dropped = [b for b in range(BITS) if not mask >> b & 1]
        again += [(i, j, _signed(mask | m)) for j, m in enumerate(masks(radius, dropped))]
    table = prints.sparkSession.createDataFrame(again, "t int, t2 int, mask long")
    hot = met.where(F.col("n") > bucket).join(F.broadcast(table), "t")  # a fixed number of masks
    hot = hot.select("fp", "t", "t2", F.col("fp").bitwiseAND(F.col("mask")).alias("k"))
    large = hot.groupBy("t", "t2", "k").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    lists = small.select("fps").union(large.select("fps"))
    return lists.mapInArrow(_bucket_links(radius), "a long, b long")


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(text, width)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return run


def _keyed_prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(text, width)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(found, pa.int64())], names=["id", "key", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, in one pass over the texts and without a shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_prints(width), "doc_id long, fp long")


def fingerprint_classes(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, root) of distinct fingerprints ``fp`` (a stored table): the smallest fingerprint reachable."""
    roots = components(fingerprint_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    return distinct.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    Two documents are linked if their fingerprints differ in ``radius`` bits or fewer;
    component_id is the smallest doc_id reachable.  A null text is empty, texts without
    words have fingerprint zero and are linked like any other.  Repeated rows stay, each
    with the same values; a null doc_id gets the component of its fingerprint, and null if
    all its members have none.  Other columns of ``docs`` are ignored; no rows give no rows.
    """
    prints = stored(fingerprints(docs, width), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    rooted = distinct.join(fingerprint_classes(distinct, radius), "fp")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(lowest, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(classes, "fp").select("doc_id", shown, "component_id")


def keep_first(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of the smallest doc_id.

    Rows with one id and different texts are documents of their own, of which a group keeps one by its
    key; of equal rows one stays.  Rows with a null id stay, as they can't be told apart.
    """
    key, best = spare(docs, "_key"), spare(docs, "_best")
    named = docs.where("doc_id is not null").withColumn(key, row_key())
    rows = named.select(F.col("doc_id").cast("long").alias("id"), F.col(key).alias("key"), text_of().alias("text"))
    prints = stored(rows.mapInArrow(_keyed_prints(width), "id long, key long, fp long"), "prints")
    distinct = stored(prints.select("fp").distinct(), "distinct")
    grouped = prints.join(fingerprint_classes(distinct, radius), "fp").groupBy("root")
    kept = grouped.agg(F.min(F.struct("id", "key")).alias("m")).select(F.col("m.key").alias(best))
    stays = named.join(kept, F.col(key) == F.col(best), "left_semi").dropDuplicates([key]).drop(key)
    return stays.unionByName(docs.where("doc_id is null"))

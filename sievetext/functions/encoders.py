"""Encoders: the pluggable step that turns texts into vectors.

An encoder runs inside executor tasks on Arrow batches.  It has a ``dim`` and a
``raw(texts)`` method that maps a ``pyarrow`` string array to an ``(n, dim)``
matrix whose rows are defined up to a positive factor; unit vectors are the rows
divided by their norm.  Bits do not depend on that factor, so the matching path
uses the raw rows and skips the division.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import embed_text

TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"
DIGEST_BITS = 128
TOKENS_PER_BLOCK = 1 << 16
CACHED_TOKENS = 1 << 18

# Per Python worker: token -> packed sign bits, one dictionary per digest count.
_digests: dict[int, dict[str, bytes]] = {}


def _sign_bits(tokens: Sequence[str], digests_per_token: int) -> np.ndarray:
    """One row of 0/1 per token: the bits of md5(token#0), md5(token#1), ..."""
    known = _digests.setdefault(digests_per_token, {})
    if len(known) + len(tokens) > CACHED_TOKENS:
        known.clear()
    suffixes = [b"#%d" % k for k in range(digests_per_token)]
    rows = []
    for token in tokens:
        row = known.get(token)
        if row is None:
            data = token.encode()
            row = known[token] = b"".join([hashlib.md5(data + suffix).digest() for suffix in suffixes])
        rows.append(row)
    packed = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
    return np.unpackbits(packed, axis=1)


@dataclass(frozen=True)
class HashEncoder:
    """Deterministic, lexical encoder: it compares words, not meaning.

    Each token gets a dense +1/-1 vector from md5; a text is the sum over its
    tokens.  It stands in for a neural sentence model, which is not shipped.
    """

    dim: int = 384

    def __post_init__(self):
        if self.dim <= 0 or self.dim % DIGEST_BITS:
            raise ValueError(f"dim must be a positive multiple of {DIGEST_BITS}, got {self.dim}")

    def raw(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        words = pc.split_pattern_regex(pc.utf8_lower(texts), TOKEN_SEPARATOR)
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
        flat = words.flatten()
        # A token counts +1 or -1 per entry, so a sum is 2 * (number of ones) - (number of tokens).
        ones = np.zeros((len(texts), self.dim), dtype=np.int64)
        tokens = np.zeros(len(texts), dtype=np.int64)
        # Blocks bound the memory of one step whatever the batch or text length.
        for start in range(0, len(flat), TOKENS_PER_BLOCK):
            block = flat.slice(start, TOKENS_PER_BLOCK).dictionary_encode()
            distinct = block.dictionary
            codes = block.indices.to_numpy()
            bits = _sign_bits(distinct.to_pylist(), self.dim // DIGEST_BITS)
            empty = pc.index(distinct, "").as_py()  # the split leaves empty strings at the ends
            if empty >= 0:
                bits[empty] = 0
            real = np.concatenate([[0], np.cumsum(codes != empty)])
            first = int(np.searchsorted(bounds, start, side="right")) - 1
            last = int(np.searchsorted(bounds, start + len(codes), side="left"))
            cuts = np.clip(bounds[first : last + 1] - start, 0, len(codes))
            tokens[first:last] += np.diff(real[cuts])
            _add_segments(ones[first:last], bits, codes, cuts)
        return 2 * ones - tokens[:, None]


def _add_segments(sums: np.ndarray, bits: np.ndarray, codes: np.ndarray, cuts: np.ndarray) -> None:
    """Add ``bits[codes[cuts[i]:cuts[i + 1]]]``, summed, to row i of ``sums``."""
    for row, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if hi > lo:
            sums[row] += bits[codes[lo:hi]].sum(axis=0, dtype=np.int32)


_models: dict[str, Callable[[list[str]], np.ndarray]] = {}


def _worker_model(token: str, factory: Callable[[], Callable[[list[str]], np.ndarray]]):
    """The model of an encoder; a worker keeps the latest one."""
    if token not in _models:
        _models.clear()
        _models[token] = factory()
    return _models[token]


@dataclass(frozen=True)
class ModelEncoder:
    """A caller's own model.

    ``factory`` is called once per Python worker and returns a function from a
    list of texts to an ``(n, dim)`` array; it gets ``batch_size`` texts at a time.
    With ``parameters``, a broadcast variable, it is called with their value: they come to an executor
    once and not with every task (``ModelEncoder.sharing`` makes one).
    """

    factory: Callable[..., Callable[[list[str]], np.ndarray]]
    dim: int = 384
    batch_size: int = 1024
    parameters: Broadcast | None = None
    #: Names this encoder in workers, where the factory itself arrives as a new object with every task.
    token: str = field(default_factory=lambda: uuid.uuid4().hex, compare=False)

    @classmethod
    def sharing(cls, spark: SparkSession, factory: Callable, parameters, dim: int = 384, batch_size: int = 1024) -> ModelEncoder:
        """An encoder whose model is ``factory(parameters)``, the parameters broadcast."""
        return cls(factory, dim, batch_size, spark.sparkContext.broadcast(parameters))

    def raw(self, texts: pa.Array) -> np.ndarray:
        factory = self.factory if self.parameters is None else partial(self.factory, self.parameters.value)
        model = _worker_model(self.token, factory)
        texts = pc.fill_null(texts, "")
        parts = [
            np.asarray(model(texts.slice(i, self.batch_size).to_pylist()), dtype=np.float64)
            for i in range(0, len(texts), self.batch_size)
        ]
        vectors = np.concatenate(parts) if parts else np.zeros((0, self.dim))
        if vectors.shape != (len(texts), self.dim):
            raise ValueError(f"model returned shape {vectors.shape}, expected {(len(texts), self.dim)}")
        return vectors


@dataclass(frozen=True)
class VectorTable:
    """Precomputed vectors: an equi join on the text's key instead of a model.

    ``vectors`` has one row per ``key``; a second one raises where the key is used.  Rows of the other side may repeat a key
    any number of times; adaptive execution splits a hot key's partition.
    """

    vectors: DataFrame
    key: str
    vector: str

    def attach(self, rows: DataFrame, key: str, into: str) -> DataFrame:
        table = self.vectors.groupBy(F.col(self.key).alias("__key")).agg(
            F.any_value(self.vector).alias("__vector"), F.count("*").alias("__n")
        )
        kind = table.schema["__vector"].dataType
        twice = F.raise_error(F.concat(F.lit("more than one vector for key "), F.col(key).cast("string")))
        missing = F.raise_error(F.concat(F.lit("no vector for key "), F.col(key).cast("string")))
        return (
            rows.join(table, F.col(key) == F.col("__key"), "left")
            .withColumn(into, F.coalesce(F.when(F.col("__n") > 1, twice.cast(kind)).otherwise(F.col("__vector")), missing.cast(kind)))
            .drop("__key", "__vector", "__n")
        )


def register_encoder(spark: SparkSession, name: str, encoder) -> None:
    """Make an encoder a SQL function of that name: text to unit vector."""
    spark.udf.register(name, embed_text(encoder))

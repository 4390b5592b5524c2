"""Byte-pair encoding and decoding with forced boundaries.

Two neighbouring bytes that stand together in no vocabulary token can never end up in one
token, so every place between such a pair is a certain cut.  The fragments between cuts are
encoded on their own and their ids put together; the same fragment is merged once per worker.
Decoding puts the tokens' strings together, by single spaces, as a file without a decoder asks.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_of
from .encoding import Memory, groups, tokenizer_path

#: Rank of a pair that is not merged; the multiplier and size of the table of ranks.
NONE = 1 << 40
MIX = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 18

_CONTROL = regex.compile("[\x1c-\x1f]")
_GAP = regex.compile(r"\p{White_Space}+")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_LOADED: dict[str, BytePairs] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class BytePairs:
    """Encoder and decoder of a word-end BPE file (lower case, NFC, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        place = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters])
        self.last = np.array([vocab[c + end] for c in letters])
        self.made = np.array([vocab[a + b] for a, b in model["merges"]])
        self._fill([(vocab[a], vocab[b]) for a, b in model["merges"]])
        self.inside = np.zeros((256, 256), bool)
        for token in vocab:
            codes = [place[c] for c in token.removesuffix(end) if c in place]
            for a, b in zip(codes, codes[1:]):
                self.inside[a, b] = True
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in self.added) + ")") if self.added else None
        self.names = {i: t.encode() + b" " for t, i in (vocab | self.added).items()}
        self.fragments = Memory(self._find_fragments, f"pairs {path}")
        self.memory = Memory(self._find, f"pairs {path}")

    def merge(self, fragments: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of fragments in a row, where each one's begin and the last one's end).

        A fragment comes with whether it is the last of its word.  All fragments take a step together: each merges its leftmost pair of lowest rank, until none can.
        """
        lengths = np.array([len(x) for x, _ in fragments], np.int64)
        codes = np.frombuffer(b"".join(x for x, _ in fragments), np.uint8)
        ids = self.first[codes]
        owner = np.repeat(np.arange(len(fragments)), lengths)
        ends = np.flatnonzero([e for _, e in fragments])
        last = np.cumsum(lengths)[ends] - 1
        ids[last] = self.last[codes[last]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank = np.full(len(ids), NONE, np.int64)
            same = owner[1:] == owner[:-1]
            rank[:-1][same] = self._rank(ids[:-1][same], ids[1:][same])
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            open_ = lowest < NONE
            if not open_.all():
                done.append((owner[~open_], ids[~open_]))
                ids, owner, rank, lowest = ids[open_], owner[open_], rank[open_], lowest[open_]
            best = np.flatnonzero(rank == lowest)
            if not len(best):
                break
            best = best[np.concatenate(([True], owner[best][1:] != owner[best][:-1]))]
            ids[best] = self.made[rank[best]]
            ids, owner = np.delete(ids, best + 1), np.delete(owner, best + 1)
        owner = np.concatenate([x for x, _ in done] or [np.zeros(0, np.int64)])
        ids = np.concatenate([x for _, x in done] or [np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(fragments)))))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        slot = (key.astype(np.uint64) * MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        found = np.full(len(key), NONE, np.int64)
        rest = np.arange(len(key))
        while len(rest):
            at = slot[rest]
            held = self.slot_key[at]
            hit = held == key[rest]
            found[rest[hit]] = self.slot_rank[at[hit]]
            rest = rest[~hit & (held >= 0)]
            slot[rest] = slot[rest] + 1 & (1 << SLOT_BITS) - 1
        return found

    def _fill(self, merges: list[tuple[int, int]]) -> None:
        """An open-addressed table of the merges' ranks."""
        self.slot_key = np.full(1 << SLOT_BITS, -1, np.int64)
        self.slot_rank = np.zeros(1 << SLOT_BITS, np.int64)
        for rank, (a, b) in enumerate(merges):
            key = a << 32 | b
            at = (key * int(MIX) & (1 << 64) - 1) >> 64 - SLOT_BITS
            while self.slot_key[at] >= 0 and self.slot_key[at] != key:
                at = at + 1 & (1 << SLOT_BITS) - 1
            if self.slot_key[at] < 0:
                self.slot_key[at], self.slot_rank[at] = key, rank

    def cut(self, words: list[bytes]) -> list[list[bytes]]:
        """Words' bytes, cut where no token can reach across; all words at once."""
        ends = np.cumsum([len(w) for w in words])
        codes = np.frombuffer(b"".join(words), np.uint8)
        certain = ~self.inside[codes[:-1], codes[1:]]
        certain[ends[:-1] - 1] = False
        places = np.flatnonzero(certain) + 1
        owners = np.searchsorted(ends, places, side="right")
        found = [[w] for w in words]
        firsts = np.flatnonzero(np.concatenate(([True], np.diff(owners) > 0))).tolist() if len(owners) else []
        for s, e in zip(firsts, [*firsts[1:], len(owners)]):
            i = int(owners[s])
            edges = [0, *(places[s:e] - (ends[i] - len(words[i]))).tolist(), len(words[i])]
            found[i] = [words[i][x:y] for x, y in zip(edges, edges[1:])]
        return found

    def _find(self, chunks: list[str]) -> list[tuple[bytes, bytes, int]]:
        """(ids, their strings each followed by a space, count) of runs without white space."""
        words: list[bytes] = []
        sizes: list[int] = []
        for chunk in chunks:
            if chunk.isascii():
                chunk = chunk.lower()
            else:
                chunk = unicodedata.normalize("NFC", chunk)
                chunk = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
            if chunk.isalpha():
                words.append(chunk.encode("utf-8", "surrogatepass"))
                sizes.append(1)
            else:
                found = _WORDS.findall(chunk)
                words += [w.encode("utf-8", "surrogatepass") for w in found]
                sizes.append(len(found))
        if not words:
            return [(b"", b"", 0)] * len(chunks)
        cuts = self.cut(words)
        parts = []
        for own in cuts:
            if len(own) > 1:
                parts += [(part, False) for part in own[:-1]]
            parts.append((own[-1], True))
        self.fragments.learn([parts])
        known = self.fragments.look(parts)
        found, at, word = [], 0, 0
        for size in sizes:
            n = len(cuts[word]) if size == 1 else sum(map(len, cuts[word : word + size]))
            word += size
            found.append(known[at] if n == 1 else _joined(known[at : at + n]))
            at += n
        return found

    def _find_fragments(self, fragments: list[tuple[bytes, bool]]) -> list[tuple[bytes, bytes, int]]:
        ids, edges = self.merge(fragments)
        data, names, edges = ids.astype("<u4").tobytes(), list(map(self.names.__getitem__, ids.tolist())), edges.tolist()
        return [(data[4 * a : 4 * b], names[a] if b - a == 1 else b"".join(names[a:b]), b - a) for a, b in zip(edges, edges[1:])]

    def pieces(self, texts: list[str]) -> Iterator[list[tuple[bytes, bytes, int]]]:
        """For each text, (ids, their strings each followed by a space, count) of its parts in order."""
        for group in groups(texts):
            marked = [any(map(text.__contains__, self.added)) for text in group]
            lists = [self._chunks(text, has) for text, has in zip(group, marked)]
            self.memory.learn([[x for x in chunks if x not in self.added] if has else chunks for chunks, has in zip(lists, marked)])
            for chunks, has in zip(lists, marked):
                yield [self._added(x) if x in self.added else self.memory.young[x] for x in chunks] if has else self.memory.look(chunks)

    def _chunks(self, text: str, marked: bool) -> list[str]:
        """Runs without white space, and added tokens by themselves if the text has any (``marked``)."""
        found: list[str] = []
        for run in self.split.split(text) if marked else [text]:
            if marked and run in self.added:
                found.append(run)
            elif _CONTROL.search(run):
                found += [w for w in _GAP.split(run) if w]
            else:
                found += run.split()
        return found

    def _added(self, name: str) -> tuple[bytes, bytes, int]:
        return np.array([self.added[name]], "<u4").tobytes(), name.encode() + b" ", 1

    def encode(self, text: str) -> list[int]:
        (found,) = self.pieces([text])
        return np.frombuffer(b"".join(x[0] for x in found), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.names[i] for i in ids)[:-1].decode("utf-8", "surrogatepass")


def _joined(parts: list[tuple[bytes, bytes, int]]) -> tuple[bytes, bytes, int]:
    """Parts in a row as one."""
    ids, names, counts = zip(*parts) if parts else ((), (), ())
    return b"".join(ids), b"".join(names), sum(counts)


def byte_pairs(path: str) -> BytePairs:
    """The encoder of a file, loaded once per worker."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def _digests(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path or tokenizer_path("word_bpe_49k.json"))
        for batch in batches:
            counts, ids, texts = [], [], []
            for found in pairs.pieces(batch.column("text").to_pylist()):
                own, names, n = _joined(found)
                counts.append(n)
                ids.append(hashlib.sha256(own).hexdigest())
                texts.append(hashlib.sha256(names[:-1]).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path or tokenizer_path("word_bpe_49k.json"))
        for batch in batches:
            found = pairs.pieces(batch.column("text").to_pylist())
            ids = [np.frombuffer(b"".join(x[0] for x in parts), "<i4") for parts in found]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, kind)], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null text is empty, an empty text has no ids.

    Rows stay as they are, repeated or with a null id; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(lean(_encoded(path)), "doc_id long, ids array<int>")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: ``encode`` and ``decode`` by their digests.

    One pass without a shuffle.  Nulls, empty texts and repeated rows as in ``encode``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(lean(_digests(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

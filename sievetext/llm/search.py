"""Exact top-k search by BM25: sharded inverted indexes with block-max WAND dynamic pruning.

Each shard holds the postings of its documents, a list for each term with the list's largest impact.
The ``HEADS`` longest lists stand also by document, with the largest impact of each block of ``BLOCK``
documents; documents lie in an order that brings texts of a kind together, which makes the maxima tight.

Many queries go through a shard at once.  A query whose lists' maxima do not reach its k-th score
passes the shard over.  Of the others the shorter lists, which have few documents, are added up; then
blocks whose maxima of the longest lists do not bring that to the score to beat are skipped unopened,
and in the opened ones the longest lists are added by products of matrices.  These are bounds in
single precision; the documents, in their order, whose bounds reach the score to beat are the pivots.
They are scored exactly, those with the k highest bounds first, which raises the score to beat.

Term weights come from counts over all documents, so scores of shards compare.  Index and queries
are files in the shared folder.  Texts are read once: shards hold counts and lengths, from which the
documents a term has are counted; impacts are worked out when a shard is read, as they need the mean
length of all.  A task takes one file of queries through all shards, one shard in memory at a time,
and brings the score to beat along: what a shard has found limits all later ones, and a query's k best
are all that leaves the task.  No text or posting is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bundle import filesystem_of
from .common import fresh_folder, stored, text_of

K1, B = 1.2, 0.75
#: A shard is closed at so many documents or (document, term) pairs; building one takes about 60 bytes a pair.
SHARD_DOCS, SHARD_PAIRS = 1 << 13, 4_000_000
#: Documents of a block, and blocks that are opened together and share a bound of what the shorter lists add.
BLOCK, NEIGHBOURS = 64, 4
#: Queries of a file at most, and their terms; fewer queries are dealt out to so many files for each core, not to files of less than some.
QUERY_BLOCK, QUERY_TERMS, CORE_FILES, QUERY_FEW = 8192, 4_000_000, 2, 1024
#: Queries taken through a shard at once.
BOUNDS = 512
#: A shard's longest lists, whose bounds are by document.
HEADS = 768
#: Postings looked at in one go.
RUN = 1 << 16
#: Scores count to this many decimals, so that equal texts tie exactly.
DECIMALS = 6


#: Bytes hashed in one go, and the longest word hashed along with all others.
PIECE, LONG = 1 << 21, 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers, for hashes (the last steps of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space, A-Z lower-cased) of all texts in order; text i has those from ends[i] to ends[i + 1]."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = (data[offsets[0] : offsets[-1]].to_pybytes() if data is not None else b"").translate(_LOWER)
    offsets = offsets - offsets[0]
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    begin = 0
    while begin < len(raw):
        end = begin + PIECE  # not in a word
        if end < len(raw):
            end = raw.rfind(b" ", begin, end) + 1 or raw.find(b" ", end) + 1 or len(raw)
        own, at = _word_hashes(raw[begin:end], offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end)] - begin)
        hashes.append(own)
        starts.append(at + begin)
        begin = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _word_hashes(raw: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between spaces or edges, and their starts.  Eight bytes are one step; up to that, no two words are alike."""
    padded = np.frombuffer(raw + b" " * 8, np.uint8)
    word = padded[: len(raw) + 1] != 32
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[edges] = word[edges]
    last = word[:-1] & ~word[1:]
    last[edges[edges > 0] - 1] = word[edges[edges > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = ends - starts
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    hashes = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = mixed(hashes ^ (eights[starts] & _BYTES[np.minimum(sizes, 8)]))
    left = np.flatnonzero(sizes > 8)
    long = left[sizes[left] > LONG]
    left, step = left[sizes[left] <= LONG], 8
    while len(left):
        hashes[left] = mixed(hashes[left] ^ (eights[starts[left] + step] & _BYTES[np.minimum(sizes[left] - step, 8)]))
        step += 8
        left = left[sizes[left] > step]
    for i in long.tolist():
        hashes[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return hashes, starts


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and how often each stands."""
    hashes = np.sort(hashes)
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)])
    return hashes[first], np.diff(np.append(first, len(hashes)))


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of runs given by their starts and lengths."""
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)


def batches_of(counts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbours whose counts are ``RUN`` together, about, or that have one member."""
    ends = np.cumsum(counts)
    if not len(ends) or ends[-1] <= RUN:
        return [(0, len(ends))] if len(ends) else []
    cuts = np.unique(np.searchsorted(ends, np.arange(RUN, ends[-1], RUN)) + 1)
    edges = [0, *[int(c) for c in cuts if c < len(ends)], len(ends)]
    return [(x, y) for x, y in zip(edges, edges[1:]) if y > x]


def indexed(ids: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The index arrays, as they are stored, of documents given by their distinct terms and how often each stands."""
    n = len(ids)
    lengths = np.array([c.sum() for c in counts], np.float64)
    sizes = np.array([len(t) for t in terms], np.int64)
    term = np.concatenate(terms) if n else np.zeros(0, np.uint64)
    by_term = np.argsort(term)
    term = term[by_term]
    new = np.concatenate(([True], term[1:] != term[:-1]))[: len(term)]
    first, term = np.flatnonzero(new), term[new]
    df = np.diff(np.append(first, len(by_term)))
    place = np.empty(len(by_term), np.int32)
    place[by_term] = np.cumsum(new, dtype=np.int32) - 1
    del by_term, new
    # texts of a kind together: by the term of theirs that most documents of the shard have but half do not
    telling = np.where(df * 2 > n, 0, df) << 32 | np.arange(len(df))
    key = np.zeros(n, np.int64)
    if len(place):
        key[sizes > 0] = np.maximum.reduceat(telling[place], (np.cumsum(sizes) - sizes)[sizes > 0]) & 0xFFFFFFFF
    order = np.lexsort((lengths, key))
    tf = np.concatenate(counts) if n else np.zeros(0, np.uint32)
    by_doc = spans((np.cumsum(sizes) - sizes)[order], sizes[order])
    place, tf, sizes = place[by_doc], tf[by_doc].astype(np.uint16 if tf.max(initial=0) < 1 << 16 else np.uint32), sizes[order]
    del by_doc
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    by_place = np.argsort(place * np.int64(n) + doc)  # no two alike
    return {
        "ids": ids[order], "lengths": lengths[order], "terms": term, "docs": doc[by_place].astype(np.uint16), "tf": tf[by_place],
        "doc_post": np.concatenate(([0], np.cumsum(sizes))), "doc_terms": place, "doc_tf": tf,
        "entry_post": np.append(first, len(place)).astype(np.uint32),
    }


def rated(index: dict[str, np.ndarray], mean_length: float) -> dict[str, np.ndarray]:
    """The index with each posting's impact, rounded up, and the largest one of each list."""
    norms = K1 * (1 - B + B * index["lengths"] / mean_length)
    tf, first = index["tf"].astype(np.float32), index["entry_post"][:-1].astype(np.int64)
    impacts = tf * np.float32(K1 + 1) / (tf + norms.astype(np.float32)[index["docs"]])
    impacts *= np.float32(1 + 2.0**-21)  # above what the steps before lose
    return index | {"norms": norms, "impacts": impacts, "entry_max": np.maximum.reduceat(impacts, first) if len(first) else impacts}


def build(ids: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], mean_length: float) -> dict[str, np.ndarray]:
    """The index of documents given by their distinct terms and how often each stands."""
    return rated(indexed(ids, terms, counts), mean_length)


Room = dict[str, np.ndarray]


def zeros(room: Room | None, name: str, size: int) -> np.ndarray:
    """Zeros in single precision, in memory of ``room`` that was used before and is no longer."""
    if room is None:
        return np.zeros(size, np.float32)
    if name not in room or len(room[name]) < size:
        room[name] = np.zeros(size, np.float32)
    room[name][:size] = 0
    return room[name][:size]


_POST, _ASKED = np.dtype([("doc", "<i4"), ("impact", "<f4")]), np.dtype([("row", "<i4"), ("weight", "<f4")])


def with_heads(index: dict[str, np.ndarray], room: Room | None = None) -> dict[str, np.ndarray]:
    """The index as it is searched: its longest lists by document, with each block's maxima, and all postings as pairs.

    ``head`` is each term's row among the longest lists (-1: none).
    """
    if "head" in index:
        return index
    post, n = index["entry_post"].astype(np.int64), len(index["ids"])
    sizes = np.diff(post)
    longest = np.sort(np.argpartition(-sizes, HEADS)[:HEADS]) if len(sizes) > HEADS else np.arange(len(sizes))
    head = np.full(len(sizes), -1, np.int32)
    head[longest] = np.arange(len(longest))
    blocks = -(-n // BLOCK)
    bounds = zeros(room, "heads", len(longest) * blocks * BLOCK).reshape(len(longest), blocks * BLOCK)
    maxima = np.zeros((len(longest), blocks), np.float32)
    posts = spans(post[longest], sizes[longest])
    docs, impacts = index["docs"][posts], index["impacts"][posts]
    place = np.repeat(np.arange(len(longest)) * (blocks * BLOCK), sizes[longest]) + docs
    bounds.ravel()[place] = impacts
    block = place // BLOCK
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))[: len(block)]
    if len(first):
        maxima.ravel()[block[first]] = np.maximum.reduceat(impacts, first)
    pairs = np.empty(len(index["docs"]), _POST)
    pairs["doc"], pairs["impact"] = index["docs"], index["impacts"]
    more = {"entry_post": post, "sizes": sizes, "head": head, "head_bounds": bounds, "head_maxima": maxima, "pairs": pairs.view(np.int64)}
    return index | more | {"asked": np.zeros(len(sizes))}


def placed(index: dict[str, np.ndarray], queries: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query (terms, weights): where its terms stand in the index, and the weights of those that do."""
    terms, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t for t, _ in queries]]), return_inverse=True)
    at = places(index, terms)
    ends = np.cumsum([len(t) for t, _ in queries])
    found = [(at[place[end - len(own) : end]], own) for end, (_, own) in zip(ends.tolist(), queries, strict=True)]
    return [(x[x >= 0], own[x >= 0]) for x, own in found]


def places(index: dict[str, np.ndarray], terms: np.ndarray) -> np.ndarray:
    """Where each of the ordered terms stands in the index; -1: nowhere."""
    at = np.full(len(terms), -1, np.int64)
    if len(terms):
        where = np.minimum(np.searchsorted(terms, index["terms"]), len(terms) - 1)
        known = np.flatnonzero(terms[where] == index["terms"])
        at[where[known]] = known
    return at


def head_weights(index: dict[str, np.ndarray], owner: np.ndarray, at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """(queries, longest lists): weights of n queries given by (query, term's place, weight)."""
    rows = index["head"][at]
    known = rows >= 0
    found = np.zeros((n, len(index["head_bounds"])), np.float32)
    found[owner[known], rows[known]] = weights[known]
    return found


def head_bounds(index: dict[str, np.ndarray], queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(queries, documents): what the longest lists add to each score of queries as ``placed``, impacts rounded up."""
    owner = np.repeat(np.arange(len(queries)), [len(x) for x, _ in queries])
    at, weights = (np.concatenate([np.zeros(0, np.int64 if j == 0 else np.float64), *[q[j] for q in queries]]) for j in range(2))
    return head_weights(index, owner, at.astype(np.int64), weights, len(queries)) @ index["head_bounds"]


def exact(index: dict[str, np.ndarray], at: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """A query's scores of documents: sums over the terms in the order of the index, so that equal texts of all shards tie."""
    asked = index["asked"]
    asked[at] = weights
    ptr = index["doc_post"]
    counts = ptr[docs + 1] - ptr[docs]
    scores = np.zeros(len(docs))
    for a, b in batches_of(counts):
        posts = spans(ptr[docs[a:b]], counts[a:b])
        weight = asked[index["doc_terms"][posts]]
        known = np.flatnonzero(weight)
        doc, tf = np.repeat(np.arange(a, b), counts[a:b])[known], index["doc_tf"][posts[known]].astype(np.float64)
        scores += np.bincount(doc, weight[known] * tf * (K1 + 1) / (tf + index["norms"][docs[doc]]), len(docs))
    asked[at] = 0
    return scores


Best = tuple[np.ndarray, np.ndarray]


def advance(
    index: dict[str, np.ndarray], at: np.ndarray, weights: np.ndarray, ptr: np.ndarray, k: int, best: list[Best], above: np.ndarray | None = None, room: Room | None = None
) -> tuple[int, int]:
    """Takes queries through a shard: ``best``, the k best (ids, scores) of each so far, is brought up to date.

    A query's terms are places in the index, those from ptr[i] to ptr[i + 1].  ``above``: the queries' ``head_bounds``
    if they are known.  Returns the numbers of blocks opened and of pivots scored.
    """
    opened, pivots = 0, 0
    n, n_docs = len(best), len(index["ids"])
    sizes = np.diff(ptr)
    owner = np.repeat(np.arange(n), sizes)
    # single precision loses less than this over a sum; nothing is left out on a tie
    exactness = 1 - (sizes + 16) * 2.0**-23
    least = np.array([s[-1] - 10.0**-DECIMALS if len(s) == k else 0.0 for _, s in best]) * exactness
    # queries whose lists' maxima do not reach the score to beat
    most = np.bincount(owner, weights * index["entry_max"][at], n)
    live = (most > 0) & (most >= least)
    if not live.any():
        return 0, 0
    blocks = -(-n_docs // BLOCK)
    width = blocks * BLOCK
    # what the lists in postings add
    bound = zeros(room, "bound", n * width)
    rest = np.flatnonzero((index["head"][at] < 0) & live[owner])
    start, size = index["entry_post"][at[rest]], index["sizes"][at[rest]]
    asked = np.empty(len(rest), _ASKED)
    asked["row"], asked["weight"] = owner[rest] * width, weights[rest]
    asked = asked.view(np.int64)
    for a, b in batches_of(size):
        posting = index["pairs"].take(spans(start[a:b], size[a:b]))
        whose = np.repeat(asked[a:b], size[a:b])
        place = np.add(posting.view(np.int32)[::2], whose.view(np.int32)[::2], dtype=np.int64)
        np.add.at(bound, place, posting.view(np.float32)[1::2] * whose.view(np.float32)[1::2])
    bound = bound.reshape(n, width)
    # and the longest lists, in blocks whose maxima reach the score to beat
    heads = head_weights(index, owner, at, weights, n)
    tops = np.maximum.reduceat(bound, np.arange(0, width, BLOCK * NEIGHBOURS), axis=1)
    tops = np.repeat(tops, NEIGHBOURS, axis=1)[:, :blocks] + heads @ index["head_maxima"]
    unskipped = (tops > 0) & (tops >= least[:, None]) & live[:, None]
    opened = int(unskipped.sum())
    if not opened:
        return 0, 0
    open_ended = np.flatnonzero(live & (least <= 0))
    reach = np.maximum(least, np.finfo(np.float32).tiny).astype(np.float32)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for a in range(0, blocks, NEIGHBOURS):
        rows, cols = np.flatnonzero(unskipped[:, a : a + NEIGHBOURS].any(1)), slice(a * BLOCK, (a + NEIGHBOURS) * BLOCK)
        if not len(rows):
            continue
        if rows[-1] - rows[0] < len(rows) * 9 // 8:  # nearly all of a run, which needs no copy
            rows = slice(rows[0], rows[-1] + 1)
        sums = heads[rows] @ index["head_bounds"][:, cols] if above is None else above[rows, cols].copy()
        sums += bound[rows, cols]
        if len(open_ended):
            bound[rows, cols] = sums
        else:
            place = np.flatnonzero(sums >= reach[rows, None])
            of, docs = np.divmod(place, sums.shape[1])
            found.append((of + rows.start if isinstance(rows, slice) else rows[of], docs + cols.start, sums.ravel()[place]))

    def score(of: np.ndarray, docs: np.ndarray) -> None:
        nonlocal pivots
        pivots += len(of)
        edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))).tolist() if len(of) else []
        for a, b in zip(edges, edges[1:]):
            q = of[a]
            own = slice(ptr[q], ptr[q + 1])
            total = exact(index, at[own], weights[own], docs[a:b])
            found = total > 0
            held = np.concatenate([best[q][0], index["ids"][docs[a:b][found]]]), np.concatenate([best[q][1], np.round(total[found], DECIMALS)])
            first = np.lexsort((held[0], -held[1]))[:k]
            best[q] = held[0][first], held[1][first]
            if len(first) == k:
                least[q] = (best[q][1][-1] - 10.0**-DECIMALS) * exactness[q]

    # without a score to beat, the documents that the bounds rate highest are the first pivots
    if len(open_ended):
        if width > k:
            docs = np.argpartition(bound[open_ended], width - k, axis=1)[:, -k:].ravel()
            of = np.repeat(open_ended, k)
            likely = bound[of, docs] > 0
            score(of[likely], docs[likely])
            bound[of, docs] = 0  # not again
        reach = np.maximum(least, np.finfo(np.float32).tiny).astype(np.float32)
        of, docs = np.divmod(np.flatnonzero(bound >= reach[:, None]), width)
        found.append((of, docs, bound[of, docs]))
    of, docs, rated = (np.concatenate(x) for x in zip(*found))
    # best bounds first: the k highest raise the score that the others have to beat
    order = np.lexsort((-rated, of))
    of, docs, rated = of[order], docs[order], rated[order]
    ahead = np.arange(len(of)) - np.searchsorted(of, of) < k
    score(of[ahead], docs[ahead])
    others = np.flatnonzero(~ahead & (rated >= least[of].astype(np.float32)))
    score(of[others], docs[others])
    return opened, pivots


def top_k(
    index: dict[str, np.ndarray], terms: np.ndarray, weights: np.ndarray, k: int,
    held: Best | None = None, above: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(doc ids, scores, blocks opened, pivots scored) of the k best documents; ties go to the smaller id.

    They are the best of a shard and of what is ``held`` from others (ids, scores).  ``above``: the
    query's row of ``head_bounds``.
    """
    index = with_heads(index)
    return best_of(index, *placed(index, [(terms, weights)])[0], k, held, above)


def best_of(
    index: dict[str, np.ndarray], at: np.ndarray, weights: np.ndarray, k: int, held: Best | None, above: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, int, int]:
    """``top_k`` of a query as ``placed`` in an index ``with_heads``."""
    best = [held or (np.zeros(0, np.int64), np.zeros(0))]
    numbers = advance(index, at, weights, np.array([0, len(at)]), k, best, None if above is None else above[None])
    return *best[0], *numbers


def _save(folder: str, kind: str, arrays: dict[str, np.ndarray]) -> str:
    files, root = filesystem_of(folder)
    name = f"{kind}-{uuid.uuid4().hex}.arrow"  # of this attempt alone; only returned names are used
    held = pa.array([a.tobytes() for a in arrays.values()], pa.large_binary())
    batch = pa.RecordBatch.from_arrays([pa.array(list(arrays)), pa.array([a.dtype.str for a in arrays.values()]), held], names=["name", "kind", "bytes"])
    with files.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return name


def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, as they lie in what was read."""
    files, root = filesystem_of(folder)
    with files.open_input_stream(f"{root}/{name}") as file, pa.ipc.open_stream(file) as stream:
        names, kinds, held = stream.read_next_batch().columns
    return {n: np.frombuffer(x.as_buffer(), k) for n, k, x in zip(names.to_pylist(), kinds.to_pylist(), held, strict=True)}


def _document_counts(folder: str, shards: Broadcast):
    """(term, documents that have it) of each shard; rows are the shards' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                index = _load(folder, shards.value[number])
                terms, sizes = index["terms"].view(np.int64), np.diff(index["entry_post"].astype(np.int64))
                del index
                for a in range(0, len(terms), RUN):
                    yield pa.RecordBatch.from_arrays([pa.array(terms[a : a + RUN]), pa.array(sizes[a : a + RUN])], names=["term", "n"])

    return run


def _write_shards(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, counts, pairs = [], [], [], 0

        def flush(n: int) -> pa.RecordBatch:
            index = indexed(np.array(ids[:n], np.int64), terms[:n], counts[:n])
            del ids[:n], terms[:n], counts[:n]
            words = int(index["lengths"].sum())
            return pa.RecordBatch.from_arrays([pa.array([_save(folder, "shard", index)]), pa.array([words], pa.int64())], names=["shard", "words"])

        for batch in batches:
            hashes, ends = term_hashes(batch.column("text"))
            edges = ends.tolist()
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), edges, edges[1:]):
                own, n = counted(hashes[a:b])
                ids.append(doc_id)
                terms.append(own)
                counts.append(n.astype(np.uint32))
                pairs += len(own)
                if len(ids) >= SHARD_DOCS + SHARD_DOCS // 4 or pairs >= SHARD_PAIRS:  # few more than a shard are one
                    yield flush(SHARD_DOCS)
                    pairs = sum(map(len, terms))
        if ids:
            yield flush(len(ids))

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            hashes, ends = term_hashes(batch.column("text"))
            edges = ends.tolist()
            found = [counted(hashes[a:b]) for a, b in zip(edges, edges[1:])]
            queries = np.repeat(batch.column("query_id").to_numpy(), [len(own) for own, _ in found])
            arrays = [pa.array(x) for x in (queries, np.concatenate([own for own, _ in found]).view(np.int64), np.concatenate([n for _, n in found]))]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "term", "qtf"])


def _write_queries(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            ids, sizes, terms, weights = (np.concatenate([x[j] for x in held]) for j in range(4))
            arrays = {"ids": ids, "ptr": np.concatenate(([0], np.cumsum(sizes))), "terms": terms.view(np.uint64), "weights": weights}
            return pa.RecordBatch.from_arrays([pa.array([_save(folder, "queries", arrays)])], names=["queries"])

        for batch in batches:
            lists = batch.column("terms")
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            terms, weights = lists.flatten().to_numpy(), batch.column("weights").flatten().to_numpy()
            ids, ends = batch.column("query_id").to_numpy(), np.cumsum(sizes)
            at = 0
            while at < len(ids):  # a file is closed at so many queries or terms
                before = ends[at] - sizes[at]
                own = sum(len(x[2]) for x in held)
                stop = int(np.searchsorted(ends, before + QUERY_TERMS - own, "right"))
                stop = max(min(stop, at + QUERY_BLOCK - n, len(ids)), at + (not held))
                if stop > at:
                    part = slice(before, ends[stop - 1])
                    held.append((ids[at:stop].copy(), sizes[at:stop], terms[part].copy(), weights[part].copy()))
                    n += stop - at
                    at = stop
                if at < len(ids):
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


def kinds(index: dict[str, np.ndarray], at: np.ndarray, weights: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """An order of queries (as for ``advance``) that brings those of a kind together: by the block that suits them best, like blocks together."""
    means = index["head_bounds"].reshape(*index["head_maxima"].shape, BLOCK).mean(2)
    near = means / np.maximum(np.linalg.norm(means, axis=0), np.finfo(np.float32).tiny)
    near = near.T @ near
    chain, left, last = np.zeros(len(near), np.int64), np.ones(len(near), bool), 0
    for i in range(len(near)):
        chain[last], left[last] = i, False
        last = int(np.where(left, near[last], -1).argmax())
    found = []
    for a in range(0, len(ptr) - 1, BOUNDS):
        own = ptr[a : a + BOUNDS + 1]
        owner, part = np.repeat(np.arange(len(own) - 1), np.diff(own)), slice(own[0], own[-1])
        found.append(chain[(head_weights(index, owner, at[part], weights[part], len(own) - 1) @ means).argmax(1)])
    return np.argsort(np.concatenate(found), kind="stable")


def found_by(at: np.ndarray, weights: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, weights and ends of queries' terms without those that stand nowhere."""
    known = np.flatnonzero(at >= 0)
    return at[known], weights[known], np.searchsorted(known, ptr)


def _search(folder: str, files: Broadcast, shards: Broadcast, mean_length: float, k: int):
    """The k best of all shards for the queries of each file; rows are the files' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                asked = _load(folder, files.value[number])
                ids, ptr, weights = asked["ids"], asked["ptr"], asked["weights"]
                terms, place = np.unique(asked["terms"], return_inverse=True)
                best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
                room, order = {}, None
                for name in shards.value:
                    index = _load(folder, name)
                    if not len(index["terms"]):
                        continue
                    index = with_heads(rated(index, mean_length), room)
                    where = places(index, terms)
                    if order is None:
                        order = kinds(index, *found_by(where[place], weights, ptr))
                        sizes = np.diff(ptr)[order]
                        term = spans(ptr[order], sizes)
                        ids, ptr, place, weights = ids[order], np.concatenate(([0], np.cumsum(sizes))), place[term], weights[term]
                    at, own, ends = found_by(where[place], weights, ptr)
                    for a in range(0, len(ids), BOUNDS):
                        edges = ends[a : a + BOUNDS + 1]
                        part, held = slice(edges[0], edges[-1]), best[a : a + BOUNDS]
                        advance(index, at[part], own[part], edges - edges[0], k, held, room=room)
                        best[a : a + BOUNDS] = held
                    del index
                sizes = [len(found) for found, _ in best]
                arrays = [np.repeat(ids, sizes), np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32)]
                arrays += [np.concatenate([x[j] for x in best]) for j in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["query_id", "rank", "doc_id", "score"])

    return run


FOUND = "query_id long, rank int, doc_id long, score double"


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents of ``docs`` (doc_id, text) of highest BM25 for each query.

    ``queries``: (query_id, text); rows of one id are one query of all their words, and a term counts as
    often as the query has it.  Ties go to the smaller doc_id.  Documents without a common term are no results, so a null or empty query has
    none; rows with a null id are left out on both sides; repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "search")
    files, root = filesystem_of(folder)
    files.create_dir(root, recursive=True)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n_docs, send = docs.count(), spark.sparkContext.broadcast
    built = docs.coalesce(-(-n_docs // SHARD_DOCS) or 1).mapInArrow(_write_shards(folder), "shard string, words long")
    built = stored(built, "shards").orderBy("shard").collect()  # a row per shard
    shards = send([r["shard"] for r in built])
    mean_length = max(sum(r["words"] for r in built), 1) / max(n_docs, 1)
    counts = spark.range(0, len(built), 1, max(len(built), 1)).mapInArrow(_document_counts(folder, shards), "term long, n long")
    # terms of a shard are distinct, so they are added up where they come together only
    counts = stored(counts.repartition("term").groupBy("term").agg(F.sum("n").alias("df")), "document-counts")
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), text_of().alias("text"))
    asked = asked.mapInArrow(_query_terms, "query_id long, term long, qtf long").groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))
    asked = asked.join(counts, "term")
    idf = F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.select("query_id", F.struct("term", (idf * F.col("qtf")).alias("weight")).alias("t"))
    asked = asked.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("t"))  # at most the vocabulary
    blocks = stored(asked.select("query_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "queries")
    n = blocks.count()
    parts = max(1, -(-n // QUERY_BLOCK), min(CORE_FILES * spark.sparkContext.defaultParallelism, -(-n // QUERY_FEW)))
    written = stored(blocks.repartition(parts).mapInArrow(_write_queries(folder), "queries string"), "query-blocks")
    asked = [r["queries"] for r in written.orderBy("queries").collect()]  # a row per file
    found = spark.range(0, len(asked), 1, max(len(asked), 1)).mapInArrow(_search(folder, send(asked), shards, mean_length, k), FOUND)
    return stored(found, "found")

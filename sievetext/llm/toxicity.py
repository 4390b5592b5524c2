"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own hashed vector beside the mean of its hashed character n-grams' vectors;
both are learned.  Two gated recurrent layers read a window of words in both directions, attention
pools their states, and a logistic unit scores the window.  A text is read in windows that overlap
by half; its score is that of its worst window, as a few words are enough to make a text toxic.

Labels are of whole texts, so training alternates: find each training text's worst windows by the
net so far, then take a pass of gradient steps on these.  It runs on a bounded sample of labelled
rows; scoring runs on executors, one pass over all texts without a shuffle.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, lean, spare, text_of
from .encoding import Memory, groups

WINDOW, STEP = 64, 32
WORDS, GRAMS = 1 << 13, 1 << 14
EMBED, HIDDEN = 8, 8
#: Labelled rows per class at most in training; all windows of their texts count.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 2400
#: Rounds of training, and batches of a round at least, however few the windows are.
ROUNDS, ROUND_STEPS, BATCH, RATE = 5, 60, 128, 0.01
THRESHOLD = 0.3
#: Windows scored at once.
CHUNK = 2048
#: Texts whose scores a worker remembers.
KNOWN_TEXTS = 200_000

#: What crc32 makes of a state whose last byte is so and so.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)

_WORD = re.compile(r"\w+")
EMPTY = ""


def split_words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; a text without any has the one word ''."""
    return _WORD.findall(text.lower()) or [EMPTY]


@dataclass
class Codes:
    """Hash places of words and of their character 3- to 5-grams, ends marked, as flat arrays."""

    words: np.ndarray
    grams: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Codes:
        """crc32 of each word and, the n-grams of all words at once, of each n-gram; a shorter word is its only n-gram."""
        data = [f"<{word}>".encode("utf-8", "surrogatepass") for word in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data) + bytes(5), np.uint8)
        firsts = np.cumsum(sizes) - sizes
        n_bytes = len(flat) - 5
        state = np.full(n_bytes, 0xFFFFFFFF, np.uint32)
        codes, before = [], None
        for n in range(1, 6):
            own = flat[n - 1 : n - 1 + n_bytes]
            state = _CRC[(state ^ own) & 255] ^ state >> np.uint32(8)
            found = (~state & np.uint32(GRAMS - 1)).astype(np.int32)
            if before is not None:
                short = firsts[sizes < n]
                found[short] = before[short]
            before = found
            if n > 2:
                codes.append(found)
        counts = np.maximum(1, sizes[:, None] - np.arange(3, 6) + 1)
        starts = (firsts[:, None] + np.arange(3) * n_bytes).ravel()
        ends = np.cumsum(counts)
        at = np.repeat(starts - (ends - counts.ravel()), counts.ravel()) + np.arange(ends[-1] if len(ends) else 0)
        own = np.fromiter(map(zlib.crc32, data), np.uint32, len(data)) % np.uint32(WORDS)
        return Codes(own.astype(np.int32), np.concatenate(codes)[at], counts.sum(axis=1).astype(np.int32))

    def take(self, places: np.ndarray) -> Codes:
        ends = np.cumsum(self.counts)
        counts = self.counts[places]
        total = np.cumsum(counts)
        at = np.repeat(ends[places] - total, counts) + np.arange(total[-1] if len(total) else 0)
        return Codes(self.words[places], self.grams[at], counts)


def window_starts(n: int) -> range:
    """Starts of windows that cover n words, each overlapping the one before by half."""
    return range(0, max(1, n - (WINDOW - STEP)), STEP)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Net:
    """Parameters by name; all float32."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        shapes = {
            "word": (WORDS, EMBED), "gram": (GRAMS, EMBED), "wx": (2 * EMBED, 6 * HIDDEN), "bx": (6 * HIDDEN,),
            "uf": (HIDDEN, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN), "attend": (2 * HIDDEN,), "out": (2 * HIDDEN,), "bias": (1,),
        }
        p = {k: (rng.standard_normal(s) * (0.1 if k in ("word", "gram") else 0.3)).astype(np.float32) for k, s in shapes.items()}
        p["bx"][:] = 0
        p["bias"][:] = -1
        return Net(p)

    def inputs(self, codes: Codes) -> np.ndarray:
        """Input vectors of words given by their codes."""
        found = np.empty((len(codes.words), 2 * EMBED), np.float32)
        found[:, :EMBED] = self.p["word"][codes.words]
        ends = np.cumsum(codes.counts)
        for at in range(0, len(ends), 1 << 14):  # by parts, as a word has many n-grams
            own = codes.counts[at : at + (1 << 14)]
            first = int(ends[at] - own[0])
            grams = self.p["gram"][codes.grams[first : int(ends[at + len(own) - 1])]]
            found[at : at + len(own), EMBED:] = np.add.reduceat(grams, np.cumsum(own) - own) / own[:, None]
        return found

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        return inputs @ self.p["wx"] + self.p["bx"]

    def logits(self, gates: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Logits of windows: ``places`` (windows, steps) into ``gates``, of which ``lengths`` count.

        ``_forward`` without its tape, a unit a row, so that each operation runs over all windows at once.
        """
        n, steps = places.shape
        h3 = 3 * HIDDEN
        states = np.empty((steps, 2 * HIDDEN, n), np.float32)
        full = lengths.min() == steps
        mask = np.arange(steps)[:, None] < lengths[None, :]
        for side, u in ((0, self.p["uf"]), (1, self.p["ub"])):
            own = np.ascontiguousarray(gates[:, side * h3 : (side + 1) * h3].T)
            back = np.ascontiguousarray(u.T)
            h = np.zeros((HIDDEN, n), np.float32)
            hu, gx = np.empty((h3, n), np.float32), np.empty((h3, n), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                np.take(own, places[:, t], axis=1, out=gx, mode="clip")
                np.matmul(back, h, out=hu)
                rz, new = hu[: 2 * HIDDEN], hu[2 * HIDDEN :]
                rz += gx[: 2 * HIDDEN]
                rz *= 0.5
                np.tanh(rz, out=rz)
                rz += 1
                rz *= 0.5
                new *= rz[:HIDDEN]
                new += gx[2 * HIDDEN :]
                np.tanh(new, out=new)
                after = states[t, side * HIDDEN : (side + 1) * HIDDEN]
                np.subtract(h, new, out=after)
                after *= rz[HIDDEN:]
                after += new
                if not full:
                    np.copyto(after, h, where=~mask[t])
                h = after
        weight = self.p["attend"] @ states
        if not full:
            weight[~mask] = -1e9
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tkn->kn", weight, states)
        return self.p["out"] @ pooled + self.p["bias"][0]

    def _forward(self, gates, places, lengths, tape):
        n, steps = places.shape
        h3 = 3 * HIDDEN
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        mask = np.arange(steps)[:, None] < lengths[None, :]
        for side, u in ((0, self.p["uf"]), (1, self.p["ub"])):
            own = np.ascontiguousarray(gates[:, side * h3 : (side + 1) * h3])
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                gx = own[places[:, t]]
                hu = h @ u
                rz = _sigmoid(gx[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                new = np.tanh(gx[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                m = mask[t][:, None]
                if tape is not None:
                    tape[side, t] = (h, r, z, new, hu[:, 2 * HIDDEN :], m)
                h = np.where(m, new + z * (h - new), h)
                states[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
        weight = np.where(mask, states @ self.p["attend"], np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        return pooled @ self.p["out"] + self.p["bias"][0], states, weight, pooled

    def gradients(self, codes, places, lengths, labels) -> dict[str, np.ndarray | tuple]:
        """Gradients of the mean logistic loss; those of the tables as (rows, values)."""
        inputs = self.inputs(codes)
        tape: dict = {}
        logit, states, weight, pooled = self._forward(self.gates(inputs), places, lengths, tape)
        n, steps = places.shape
        d = ((_sigmoid(logit) - labels) / n).astype(np.float32)
        g: dict = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * self.p["out"]
        d_weight = (states * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["attend"] = np.tensordot(d_score, states, axes=([0, 1], [0, 1]))
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * self.p["attend"]
        d_gx = np.zeros((n, steps, 6 * HIDDEN), np.float32)
        for side, name in ((0, "uf"), (1, "ub")):
            u, du = self.p[name], np.zeros_like(self.p[name])
            carry = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if side == 0 else range(steps):
                h, r, z, new, hun, m = tape[side, t]
                dh = d_states[t, :, side * HIDDEN : (side + 1) * HIDDEN] + carry
                own = np.where(m, dh, 0)
                da_n = own * (1 - z) * (1 - new * new)
                da_z = own * (h - new) * z * (1 - z)
                da_r = da_n * hun * r * (1 - r)
                d_hu = np.concatenate([da_r, da_z, da_n * r], axis=1)
                du += h.T @ d_hu
                carry = np.where(m, own * z + d_hu @ u.T, dh)
                d_gx[:, t, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN] = np.concatenate([da_r, da_z, da_n], axis=1)
            g[name] = du
        flat = places.ravel()
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) > 0)))
        d_gates = np.zeros((len(codes.words), 6 * HIDDEN), np.float32)
        d_gates[flat[order][starts]] = np.add.reduceat(d_gx.reshape(-1, 6 * HIDDEN)[order], starts)
        g["wx"], g["bx"] = inputs.T @ d_gates, d_gates.sum(axis=0)
        d_inputs = d_gates @ self.p["wx"].T
        g["word"] = _rows(codes.words, d_inputs[:, :EMBED])
        g["gram"] = _rows(codes.grams, np.repeat(d_inputs[:, EMBED:] / codes.counts[:, None], codes.counts, axis=0))
        return g


def _rows(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(places, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(places[order]) > 0)))
    return places[order][starts], np.add.reduceat(values[order], starts)


class Adam:
    def __init__(self, net: Net, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def apply(self, gradients: dict) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for name, g in gradients.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            self.m[name][at] = 0.9 * self.m[name][at] + 0.1 * g
            self.v[name][at] = 0.999 * self.v[name][at] + 0.001 * g * g
            self.net.p[name][at] -= scale * self.m[name][at] / (np.sqrt(self.v[name][at]) + 1e-8)


def fit(texts: Iterable[tuple[int, list[str]]], seed: int = 7) -> Net | None:
    """Train on (label, windows of words joined by spaces) of texts; None if a class has no text."""
    place: dict[str, int] = {}
    parts, lengths, owner, labels = [], [], [], []
    for own, windows in texts:
        for window in windows:
            words = window.split(" ")
            parts.append(np.array([place.setdefault(w, len(place)) for w in words], np.int32))
            lengths.append(len(words))
            owner.append(len(labels))
        labels.append(own)
    if len(set(labels)) < 2:
        return None
    codes = Codes.of(list(place))
    place.clear()
    lengths, owner = np.array(lengths), np.array(owner)
    places = np.zeros((len(parts), WINDOW), np.int32)
    for i, part in enumerate(parts):
        places[i, : len(part)] = part
    label = np.array(labels, np.float32)[owner]
    net, rng = Net.fresh(seed), np.random.default_rng(seed)
    adam = Adam(net, RATE)
    for round_ in range(ROUNDS):
        if round_:
            score = _all_logits(net, net.gates(net.inputs(codes)), places, lengths)
        else:
            score = rng.random(len(parts))
        worst = np.lexsort((-score, owner))
        rank = np.arange(len(parts)) - np.searchsorted(owner[worst], owner[worst])
        taken = worst[rank < (6 if round_ == 0 else 2)]
        if round_ >= 2:  # of a toxic text the worst window alone is sure to be toxic
            taken = worst[rank < np.where(label[worst] > 0, 1, 2)]
        passes = max(1, -(-ROUND_STEPS * BATCH // len(taken)))
        taken = np.concatenate([rng.permutation(taken) for _ in range(passes)])
        for at in range(0, len(taken), BATCH):
            own = taken[at : at + BATCH]
            used, local = np.unique(places[own], return_inverse=True)
            adam.apply(net.gradients(codes.take(used), local.reshape(len(own), WINDOW), lengths[own], label[own]))
    return net


def _all_logits(net: Net, gates: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logits in chunks of windows of about the same length."""
    found = np.empty(len(places), np.float32)
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(order), CHUNK):
        own = order[at : at + CHUNK]
        found[own] = net.logits(gates, places[own, : lengths[own].max()], lengths[own])
    return found


class Scorer:
    """Scores texts by a trained net; words' gate inputs and scores of texts are kept in bounded memory."""

    def __init__(self, net: Net):
        self.net = net
        self.memory = Memory(lambda words: list(net.gates(net.inputs(Codes.of(words)))), "toxicity", 60_000)
        self.known: dict[bytes, float] = {}

    def scores(self, texts: list[str]) -> Iterator[float]:
        """The score of each text; equal texts are read once, as long as they are remembered."""
        for group in groups(texts):
            if len(self.known) > KNOWN_TEXTS:
                self.known.clear()
            names = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in group]
            new = {name: text for name, text in zip(names, group) if name not in self.known}
            if new:
                self.known.update(zip(new, self._worst(list(new.values()))))
            yield from map(self.known.__getitem__, names)

    def _worst(self, group: list[str]) -> list[float]:
        lists = [split_words(t) for t in group]
        flat = [w for words in lists for w in words]
        names = list(set(flat))
        self.memory.learn([names])
        gates = np.stack(self.memory.look(names))
        place = {w: i for i, w in enumerate(names)}
        codes = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        sizes = [len(x) for x in lists]
        firsts = np.concatenate(([0], np.cumsum(sizes)))
        starts = [np.array(window_starts(n)) for n in sizes]
        owner = np.repeat(np.arange(len(group)), [len(s) for s in starts])
        worst = np.full(len(group), -np.inf, np.float32)
        start = np.concatenate(starts)
        lengths = np.minimum(WINDOW, np.array(sizes)[owner] - start)
        begin = firsts[owner] + start
        for at in range(0, len(owner), 16 * CHUNK):
            part = slice(at, at + 16 * CHUNK)
            places = np.minimum(begin[part, None] + np.arange(WINDOW), len(codes) - 1)
            found = _all_logits(self.net, gates, codes[places], lengths[part])
            np.maximum.at(worst, owner[part], found)
        return _sigmoid(worst.astype(np.float64)).tolist()


def _windows(text: str) -> list[str]:
    words = split_words(text)
    return [" ".join(words[s : s + WINDOW]) for s in window_starts(len(words))]


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the fitted parameters, or none."""
    rows = (row for batch in batches for row in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()))
    net = fit((label, _windows(text)) for label, text in rows)
    if net is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])


def train(docs: DataFrame, labels: DataFrame) -> Net | None:
    """Fit on labelled documents that are not held out (crc32(doc_id) mod 4 is 2).

    At most SAMPLE_TOXIC and SAMPLE_CLEAN labelled ids, the first by hash, with all windows of their
    texts.  Rows without a label, id or text teach nothing.  One task fits the net on that sample; the
    driver gets its parameters, under a megabyte.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(crc_bucket("doc_id", 4) != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for value, limit in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id")  # no more ids than the sample's bound
    first = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = first.repartition(1).sortWithinPartitions("doc_id").select("toxic", "text")  # no larger than the sample's bound
    fitted = sample.mapInArrow(lean(_fit_sample), "net binary").first()
    return pickle.loads(fitted["net"]) if fitted else None


def _score(net, text: str, score: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net.value) if net is not None else None
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = list(scorer.scores(texts)) if scorer else [0.0] * len(texts)
            names = [n for n in batch.schema.names if n != text]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], names=[*names, score])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Only the text is an input of a score.  A null text is empty and scored like one; repeated rows
    get equal scores; a null id counts as empty text for the fold; without labels of both classes
    all scores are 0.  Other columns are ignored; no rows give no rows.
    """
    net = train(docs, labels)
    net = docs.sparkSession.sparkContext.broadcast(net) if net is not None else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    found = rows.mapInArrow(lean(_score(net, "_text", "_score")), "doc_id long, _score double")
    predicted = (F.col("_score") >= THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), F.col("_score").alias("score"), predicted)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored THRESHOLD or more; one pass, all columns kept."""
    net = train(docs, labels)
    net = docs.sparkSession.sparkContext.broadcast(net) if net is not None else None
    text, score_ = spare(docs, "_text"), spare(docs, "_score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {score_} double"
    rows = docs.withColumn(text, text_of()).mapInArrow(lean(_score(net, text, score_)), schema)
    return rows.where(F.col(score_) < THRESHOLD).drop(score_)

"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions.  A decision's place in its byte and the last d bytes, for d from
0 to DEPTH, name a node of the context tree; a node estimates its decision by Krichevsky and Trofimov's
rule, and its weighted probability is the mean of its own estimate's and of the product of its
children's.  A trained tree then mixes the estimates of all depths along a context, deepest last, by
weights that follow from the counts alone, so nothing depends on the order of the training texts.

What the tree says of a byte depends on DEPTH + 1 bytes.  Tasks count these grams, one shuffle adds
them up, and tasks weigh the subtrees of grams that share their last TOP context bytes, many small ones at
once.  What these subtrees say of their roots is added up to the root of the tree by grouped sums, and
what the nodes above say comes back to them by joins.  Scoring looks the grams up: the commonest in a table of fixed size that
every task has, the rest by an equi join on (document, gram) rows.  Words of the base model go the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, lean, stored, text_of
from .encoding import groups

DEPTH = 5
#: Stands before a text's first byte and after its last; it is in no UTF-8 text.
EDGE = 0xFF
#: Entries of the tables of the commonest grams and words that every task has.
COMMON_GRAMS, COMMON_WORDS = 1 << 20, 1 << 16
GRAM, WORD = 0, 1
#: Last context bytes that a task's grams share in groups, and about how many grams it weighs at once.
TOP, PART_GRAMS = 3, 1 << 17
#: Counted units of a kind at which a task adds up what it holds, and passes it on if half as many are left.
PENDING = 1 << 21
_HALF = np.log(0.5)


def text_grams(text: bytes) -> np.ndarray:
    """The grams of a text and its end: the last DEPTH bytes, latest first, then the byte."""
    data = np.frombuffer(bytes([EDGE]) * DEPTH + text + bytes([EDGE]), np.uint8).astype(np.uint64)
    n = len(text) + 1
    gram = data[DEPTH : DEPTH + n].copy()
    for back in range(1, DEPTH + 1):
        gram |= data[DEPTH - back : DEPTH - back + n] << np.uint64(8 * (DEPTH + 1 - back))
    return gram


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x of 0.5 or more, by Stirling's series moved up by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / y**2) / y**2) / y**2) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the estimator's probability of any sequence of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


class Tree:
    """Nodes above a set of grams that share their last ``top`` context bytes, for one place in the byte.

    ``grams`` are distinct and sorted, so every context's grams lie together.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, bit: int, top: int):
        self.bit, self.top = bit, top
        symbol = (grams & np.uint64(255)).astype(np.int64)
        prefix = symbol >> (8 - bit)
        self.ones = (symbol >> (7 - bit)) & 1
        self.place, self.kt, self.log_e, self.weighted, self.nodes = {}, {}, {}, {}, {}
        below = None
        for depth in range(DEPTH, top - 1, -1):
            context = grams >> np.uint64(8 * (DEPTH + 1 - depth))
            name = context << np.uint64(8) | prefix.astype(np.uint64)
            self.nodes[depth], self.place[depth] = np.unique(name, return_inverse=True)
            size = len(self.nodes[depth])
            ones = np.bincount(self.place[depth], counts * self.ones, size)
            zeros = np.bincount(self.place[depth], counts * (1 - self.ones), size)
            self.log_e[depth] = log_kt(zeros, ones)
            self.kt[depth] = (zeros, ones)
            if depth == DEPTH:
                self.weighted[depth] = self.log_e[depth]
            else:
                parent = np.zeros(len(self.nodes[depth + 1]), np.int64)
                parent[below] = self.place[depth]
                children = np.bincount(parent, self.weighted[depth + 1], size)
                self.weighted[depth] = _HALF + np.logaddexp(self.log_e[depth], children)
            below = self.place[depth]

    def probability(self) -> np.ndarray:
        """Of each gram's own bit, mixed from depth ``top`` to DEPTH."""
        found = None
        for depth in range(DEPTH, self.top - 1, -1):
            zeros, ones = self.kt[depth]
            own = ((np.where(self.ones == 1, ones[self.place[depth]], zeros[self.place[depth]])) + 0.5) / ((zeros + ones)[self.place[depth]] + 1)
            found = own if found is None else found + np.exp(_HALF + self.log_e[depth] - self.weighted[depth])[self.place[depth]] * (own - found)
        return found


def root_rows(grams: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(bit, prefix, zeros, ones, ln weighted) of the depth-1 nodes of one last byte."""
    rows = []
    for bit in range(8):
        tree = Tree(grams, counts, bit, 1)
        zeros, ones = tree.kt[1]
        for i, name in enumerate(tree.nodes[1].tolist()):
            rows.append((bit, name & 255, float(zeros[i]), float(ones[i]), float(tree.weighted[1][i])))
    return rows


def root_nodes(rows) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(bit, prefix) -> (zeros, ones, weight of the own estimate) of the root's nodes."""
    summed: dict[tuple[int, int], list[float]] = {}
    for bit, prefix, zeros, ones, weighted in rows:
        own = summed.setdefault((bit, prefix), [0.0, 0.0, 0.0])
        for i, x in enumerate((zeros, ones, weighted)):
            own[i] += x
    found = {}
    for name, (zeros, ones, children) in summed.items():
        log_e = float(log_kt(np.array([zeros]), np.array([ones]))[0])
        found[name] = (zeros, ones, float(np.exp(_HALF + log_e - (_HALF + np.logaddexp(log_e, children)))))
    return found


def gram_scores(grams: np.ndarray, counts: np.ndarray, root) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context."""
    total = np.zeros(len(grams))
    symbol = (grams & np.uint64(255)).astype(np.int64)
    for bit in range(8):
        tree = Tree(grams, counts, bit, 1)
        deeper = tree.probability()
        prefix = symbol >> (8 - bit)
        table = np.array([root.get((bit, p), (0.0, 0.0, 0.5)) for p in range(1 << bit)])
        zeros, ones, weight = table[prefix].T
        own = (np.where(tree.ones == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
        total += np.log10(deeper + weight * (own - deeper))
    return total


def lower_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, unit, count in training texts) of each part of a task; 0 for units of held-out texts alone."""
    pending: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAM: [], WORD: []}

    def add(kind: int, units: list[np.ndarray], weight: int) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(units), return_counts=True)
        if len(found):
            pending[kind].append((found, n * weight))
        if sum(len(x) for x, _ in pending[kind]) >= PENDING:
            pending[kind] = [_added(pending[kind])]
            if len(pending[kind][0][0]) >= PENDING // 2:
                yield _counted(kind, pending[kind].pop())

    for batch in batches:
        held = np.array(batch.column("held_out").to_pylist(), bool)
        for is_held in (False, True):
            texts = batch.column("text").take(pa.array(np.flatnonzero(held == is_held))).to_pylist()
            for own in groups(texts):
                own = [t.encode("utf-8", "surrogatepass") for t in own]
                yield from add(GRAM, [text_grams(t) for t in own], not is_held)
                if not is_held:
                    yield from add(WORD, [word_hashes(lower_words(t)) for t in own], 1)
    for kind, parts in pending.items():
        if parts:
            yield _counted(kind, _added(parts))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct units of these parts and their counts; the parts are let go."""
    units, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(units, kind="stable")  # runs in order are merged
    units = units[order]
    first = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1])))
    return units[first], np.add.reduceat(counts[order], first)


def _counted(kind: int, counted: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    units, counts = counted
    arrays = [pa.array(np.full(len(units), kind, np.int32)), pa.array(units.view(np.int64)), pa.array(counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "unit", "c"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    held = list(batches)
    units = np.concatenate([b.column("unit").to_numpy() for b in held]).view(np.uint64)
    counts = np.concatenate([b.column("c").to_numpy() for b in held]).astype(np.float64)
    order = np.argsort(units)
    return units[order], counts[order]


def parted(grams: DataFrame) -> DataFrame:
    """The grams (unit, c) with the part that weighs them; a subtree below TOP context bytes is in one part."""
    parts = grams.count() // PART_GRAMS + 1
    return grams.withColumn("part", F.pmod(F.xxhash64(F.shiftrightunsigned("unit", 8 * (DEPTH + 1 - TOP))), F.lit(parts)))


NODES = "part long, bit int, name long, zeros double, ones double, weighted double"


def _subtrees(table: pa.Table) -> pa.Table:
    """The roots of a part's subtrees; a node's name is its context, then the bits before in its byte."""
    part = table.column("part")[0].as_py()
    grams, counts = _arrays(iter(table.to_batches()))
    found = []
    for bit in range(8):
        tree = Tree(grams, counts, bit, TOP)
        names = tree.nodes[TOP].view(np.int64)
        found.append((np.full(len(names), part), np.full(len(names), bit, np.int32), names, *tree.kt[TOP], tree.weighted[TOP]))
    columns = [np.concatenate([x[k] for x in found]) for k in range(6)]
    return pa.table([pa.array(c) for c in columns], names=["part", "bit", "name", "zeros", "ones", "weighted"])


LEVEL = "bit int, name long, one double, zero double, rest double, weighted double"


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of nodes (bit, name, zeros, ones, children): shares of the own estimates, what is left to the children, ln weighted."""
    for batch in batches:
        zeros, ones, children = (batch.column(c).to_numpy() for c in ("zeros", "ones", "children"))
        log_e = log_kt(zeros, ones)
        weighted = _HALF + np.logaddexp(log_e, children)
        own, below = np.exp(_HALF + log_e - weighted), np.exp(_HALF + children - weighted)
        each = own / (zeros + ones + 1)
        arrays = [pa.array(x) for x in (each * (ones + 0.5), each * (zeros + 0.5), below, weighted)]
        yield pa.RecordBatch.from_arrays([batch.column("bit"), batch.column("name"), *arrays], names=["bit", "name", "one", "zero", "rest", "weighted"])


def _parent(name: str) -> Column:
    """The name of the node of one context byte less."""
    return F.shiftleft(F.shiftright(name, 16), 8).bitwiseOR(F.col(name).bitwiseAND(F.lit(255)))


def shares_above(subtrees: DataFrame) -> DataFrame:
    """(part, bit, name, one, zero, rest) of the subtrees' roots: what all nodes above give to either bit, and what they leave."""
    sums = subtrees.select("bit", "name", "zeros", "ones", "weighted")
    levels = []
    for depth in range(TOP - 1, -1, -1):
        sums = sums.groupBy("bit", _parent("name").alias("name")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("children"))
        sums = stored(sums, f"sums{depth}")
        level = stored(sums.mapInArrow(_level, LEVEL), f"level{depth}")
        levels.append(level)
        sums = sums.join(level.select("bit", "name", "weighted"), ["bit", "name"])
    above = levels.pop().drop("weighted")  # the root's 255 nodes
    outer = lambda frame: frame.select(F.col("bit"), F.col("name").alias("parent"), *[F.col(c).alias(f"o_{c}") for c in ("one", "zero", "rest")])
    while levels:
        level = levels.pop().withColumn("parent", _parent("name")).join(outer(above), ["bit", "parent"])
        mixed = [(F.col(f"o_{c}") + F.col("o_rest") * F.col(c)).alias(c) for c in ("one", "zero")]
        above = level.select("bit", "name", *mixed, (F.col("o_rest") * F.col("rest")).alias("rest"))
    roots = subtrees.select("part", "bit", "name", _parent("name").alias("parent")).join(outer(above), ["bit", "parent"])
    return roots.select("part", "bit", "name", *[F.col(f"o_{c}").alias(c) for c in ("one", "zero", "rest")])


def _part_scores(table: pa.Table, above: pa.Table) -> pa.Table:
    """log10 of the probability of each gram's byte, from a part's grams and the shares above its subtrees."""
    grams, counts = _arrays(iter(table.to_batches()))
    bits, names, *shares = (above.column(c).to_numpy() for c in ("bit", "name", "one", "zero", "rest"))
    total = np.zeros(len(grams))
    for bit in range(8):
        tree = Tree(grams, counts, bit, TOP)
        mine = np.flatnonzero(bits == bit)
        mine = mine[np.argsort(names[mine])][tree.place[TOP]]  # the names are those of tree.nodes
        one, zero, rest = (x[mine] for x in shares)
        total += np.log10(np.where(tree.ones == 1, one, zero) + rest * tree.probability())
    return pa.table([pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(total)], names=["unit", "c", "value"])


def gram_values(grams: DataFrame) -> DataFrame:
    """(unit, c, value) of the counted grams (unit, c)."""
    grams = parted(grams)
    subtrees = stored(grams.groupBy("part").applyInArrow(_subtrees, NODES), "subtrees")
    above = shares_above(subtrees).groupBy("part")
    return grams.groupBy("part").cogroup(above).applyInArrow(_part_scores, "unit long, c long, value double")


class Table:
    """Sorted units and their values."""

    def __init__(self, units: np.ndarray, values: np.ndarray):
        order = np.argsort(units)
        self.units, self.values = units[order], values[order]

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.units):
            return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
        place = np.minimum(np.searchsorted(self.units, asked), len(self.units) - 1)
        return self.units[place] == asked, place


def _score_texts(shared):
    """Per document one row of what the common tables give, and a row per unit that they lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = shared.value
        for batch in batches:
            rids, kinds, units, ns, sums, knowns = [], [], [], [], [], []
            place = 0
            all_rids = batch.column("rid").to_numpy()
            for own in groups(batch.column("text").to_pylist()):
                texts = [t.encode("utf-8", "surrogatepass") for t in own]
                rid = all_rids[place : place + len(own)]
                place += len(own)
                tokens = [lower_words(t) for t in texts]
                n_tokens = np.array([len(t) + 1 for t in tokens])
                total, known, base = np.zeros(len(own)), np.zeros(len(own), np.int64), np.zeros(len(own))
                for kind, table, parts in ((GRAM, grams, [text_grams(t) for t in texts]), (WORD, words, [word_hashes(t) for t in tokens])):
                    sizes = [len(p) for p in parts]
                    distinct, where = np.unique(np.concatenate(parts), return_inverse=True)
                    hit, at = table.find(distinct)
                    value = np.where(hit, table.values[at], 0.0) if len(table.values) else np.zeros(len(distinct))
                    owner = np.repeat(np.arange(len(own)), sizes)
                    added = np.bincount(owner, value[where], len(own))
                    if kind == GRAM:
                        total = added
                    else:
                        base, known = added, np.bincount(owner, hit[where], len(own)).astype(np.int64)
                    miss = ~hit[where]
                    if miss.any():
                        pairs, n = np.unique(owner[miss] * len(distinct) + where[miss], return_counts=True)
                        rids.append(rid[pairs // len(distinct)])
                        kinds.append(np.full(len(n), kind, np.int32))
                        units.append(distinct[pairs % len(distinct)].view(np.int64))
                        ns.append(n)
                        sums.append(np.zeros((len(n), 2)))
                        knowns.append(np.zeros(len(n), np.int64))
                rids.append(rid)
                kinds.append(np.full(len(own), -1, np.int32))
                units.append(np.zeros(len(own), np.int64))
                ns.append(n_tokens)
                sums.append(np.stack([total, base], axis=1))
                knowns.append(known)
            if rids:
                both = np.concatenate(sums)
                arrays = [np.concatenate(x) for x in (rids, kinds, units, ns)] + [both[:, 0].copy(), both[:, 1].copy(), np.concatenate(knowns)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["rid", "kind", "unit", "n", "total", "base", "known"])

    return run


def commonest(table: DataFrame, limit: int) -> DataFrame:
    """Rows of ``table`` whose count ``c`` is over a bar that at most ``limit`` rows pass; nothing is sorted.

    The bar is found from how many rows each sixteenth of a power of two has.
    """
    step = F.floor(F.log2("c") * 16)
    sizes = table.where("c > 0").groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect()  # 1,024 at most
    total, bar = 0, None
    for row in sizes:
        total += row["n"]
        if total > limit:
            break
        bar = row["s"]
    return table.where((F.col("c") > 0) & (step >= bar)) if bar is not None else table.limit(0)


PARTS = "rid long, kind int, unit long, n long, total double, base double, known long"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    Texts with crc32(doc_id) mod 10 not 0 teach the model; all are scored.  A null text is empty and
    scored for its end alone, a null id counts as empty text; repeated rows teach as often as they stand
    and each gets its row.  Without training texts every estimate is even.  Other columns are ignored.
    """
    spark = docs.sparkSession
    held = (crc_bucket("doc_id", 10) == 0).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), held)
    counts = rows.mapInArrow(lean(_count), "kind int, unit long, c long").groupBy("kind", "unit").agg(F.sum("c").alias("c"))
    counts = stored(counts, "unit-counts")
    grams = counts.where(F.col("kind") == GRAM).select("unit", "c")
    valued = stored(gram_values(grams), "gram-scores")
    words = counts.where(F.col("kind") == WORD)
    sums = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = rows.agg(F.count_if(~F.col("held_out"))).first()[0]
    train_tokens, distinct = sums["n"] + ends, sums["v"] + bool(ends)
    below = train_tokens + 0.1 * (distinct + 1)
    valued_words = words.select("unit", "c", F.log10((F.col("c") + 0.1) / F.lit(below)).alias("value"))
    common = []
    for table, limit in ((valued, COMMON_GRAMS), (valued_words, COMMON_WORDS)):
        top = commonest(table, limit).select("unit", "value").toArrow()  # no more rows than the limit
        common.append(Table(top["unit"].to_numpy().view(np.uint64), top["value"].to_numpy()))
    shared = spark.sparkContext.broadcast(tuple(common))
    keyed = stored(rows.select("doc_id", "held_out", F.monotonically_increasing_id().alias("rid"), "text"), "texts")
    parts = stored(keyed.select("rid", "text").mapInArrow(lean(_score_texts(shared)), PARTS), "score-parts")
    values = valued.select(F.lit(GRAM).alias("kind"), "unit", "value", F.lit(0).cast("long").alias("hit"))
    values = values.union(valued_words.select(F.lit(WORD).alias("kind"), "unit", "value", F.lit(1).cast("long").alias("hit")))
    unseen = float(np.log10(0.1 / below))
    met = parts.where("kind >= 0").join(values, ["kind", "unit"], "left")
    value = F.coalesce("value", F.lit(unseen)) * F.col("n")
    is_gram = F.col("kind") == GRAM
    rest = met.select("rid", F.when(is_gram, value).otherwise(0.0).alias("total"), F.when(is_gram, 0.0).otherwise(value).alias("base"), (F.coalesce("hit", F.lit(0)) * F.col("n")).alias("known"), F.lit(0).cast("long").alias("n"))
    own = parts.where("kind < 0").select("rid", "total", "base", "known", "n")
    summed = own.union(rest).groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("total", "base", "known", "n")])
    end = float(np.log10((ends + 0.1) / below))
    facts = keyed.select("rid", "doc_id", "held_out", (F.octet_length("text") + 1).alias("bytes"))
    done = facts.join(summed, "rid")
    bits = (-F.col("total") * F.lit(float(np.log2(10))) / F.col("bytes")).alias("bits_per_byte")
    base = (F.col("base") + F.lit(end)).alias("base_score")
    known = (F.col("known") + F.lit(int(ends > 0))).alias("n_known")
    return done.select("doc_id", "held_out", F.col("n").alias("n_tokens"), known, F.lit(train_tokens).cast("long").alias("train_tokens"), base, F.col("total").alias("score"), bits)

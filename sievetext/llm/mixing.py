"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Every source has a line: its documents one after the other in shuffled order, cut into blocks of
equally many words (the last may be shorter).  A schedule says which source each slot takes its next
block from: slot k has the van der Corput point of k (its bits reversed), and the source in whose
part of the cumulative weights the point lies gets the slot.  Parts are whole numbers of slots and
the points of 2^m slots are the numbers below 2^m, each once, so a source gets exactly the slots
that its target needs, spread over the schedule; points beyond the last source are idle.  A source's
r-th slot takes the r-th block of its line, from the start again once the line is used up, and the
last one only what the target still lacks.

Running totals (places on lines, ranks of slots) are made in two steps, sums of chunks and then
rows inside a chunk, so that a source with a third of all rows is no task of its own.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, stored, text_of

#: Weights of the sources in code-point order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: The mix has SHARE times all words; no source is taken more than ROUNDS times.
SHARE, ROUNDS = Fraction(3, 2), 2
#: Words of a block.
BLOCK_WORDS = 512
#: Rows of a chunk of running totals, about.
CHUNK_ROWS = 4096


def running(df: DataFrame, group: list[str], chunk: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same group that come before.

    Rows come by chunk, then by ``order``.  ``df`` should be a stored table, as it is read twice.
    """
    chunks = df.groupBy(*group, chunk).agg(F.sum(value).alias("_of_chunk"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*group, chunk, F.coalesce(F.sum("_of_chunk").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.join(chunks, [*group, chunk]).withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.drop("_before")


def shuffled_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a shuffle key of every row; the texts are read once."""
    size = F.size(F.array_remove(F.split(text_of(), WORD_GAP), "")).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"), F.xxhash64(text_of()).alias("tie"))
    return stored(rows, "mix-sizes")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, place): place is the number of sources that sort before, null last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sorted_ = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    sorted_ = stored(sorted_.withColumn("row", F.monotonically_increasing_id()), "mix-sources")
    # the id has the partition above its 33rd bit and counts rows from 0 below it
    sorted_ = sorted_.withColumns({"part": F.shiftright("row", 33), "row": F.col("row").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_.groupBy("part").agg(F.count("*").alias("rows"))  # a row a partition that has any
    parts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    return sorted_.join(parts, "part").select("source", "source_size", "n_docs", (F.col("before") + F.col("row")).alias("place"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """``sources`` with weight and target: shares by weight, none above ``rounds`` times its size.

    What a full source can't take is shared again by weight among the others, until none is above:
    one sum over the sources a step, and every step fills one more source at least (a few steps, as a
    rule).  Sums are whole numbers; the share is rounded to a double once.
    """
    by_place = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", by_place), "mix-weights")
    limit = F.col("source_size") * rounds
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    a_weight, full = 0.0, F.lit(False)
    while total:
        words, left = sources.agg(F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not left:
            break
        new = float((share * total - words) / left)
        if new == a_weight:
            break
        a_weight, full = new, limit <= F.lit(new) * F.col("weight")
    target = F.least(limit.cast("double"), F.lit(a_weight) * F.col("weight"))
    return sources.withColumn("target", target)


def _reversed_bits(number: str, bits: int) -> Column:
    return F.expr(f"cast(conv(reverse(lpad(bin({number}), {bits}, '0')), 2, 10) as bigint)") if bits else F.lit(0).cast("long")


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots: (slot, place, rank, round, block, taken), with the words that each takes.

    ``sources`` has place, source_size and target.  Slots are numbered in the order of the mix, with
    gaps where a point is idle.
    """
    wanted = F.least(F.round("target").cast("long"), ROUNDS * F.col("source_size"))
    sources = sources.select("place", "source_size", wanted.alias("wanted")).where("wanted > 0")
    blocks = f"((source_size + {block_words - 1}) div {block_words})"
    slots = f"(wanted div source_size) * {blocks} + (wanted % source_size + {block_words - 1}) div {block_words}"
    sources = sources.withColumns({"blocks": F.expr(blocks), "slots": F.expr(slots)})
    sources = sources.withColumns({"part": F.expr(f"place div {CHUNK_ROWS}"), "all": F.lit(0)})
    sources = stored(running(sources, ["all"], "part", [F.col("place")], F.col("slots"), "lowest"), "mix-intervals")
    total = sources.agg(F.sum("slots")).first()[0] or 0
    bits = max(total - 1, 0).bit_length()
    # a source's points are its interval; chunks of them first, so that one row never becomes a third of all slots
    chunks = sources.withColumn("first", F.explode(F.expr(f"sequence(0L, slots - 1, {CHUNK_ROWS}L)")))
    chunks = chunks.repartition("place", "first")
    points = chunks.withColumn("i", F.explode(F.expr(f"sequence(first, least(first + {CHUNK_ROWS}, slots) - 1)")))
    points = points.withColumn("slot", _reversed_bits("lowest + i", bits))
    points = points.select("place", "source_size", "wanted", "blocks", "slot", F.expr(f"slot div {CHUNK_ROWS}").alias("part"))
    points = stored(points, "mix-points")
    ranked = running(points, ["place"], "part", [F.col("slot")], F.lit(1), "rank")
    ranked = ranked.withColumns({"round": F.expr("rank div blocks"), "block": F.expr("rank % blocks")})
    start = f"block * {block_words}L"
    taken = f"least(least({block_words}L, source_size - {start}), wanted - round * source_size - {start})"
    return ranked.select("slot", "place", "rank", "round", "block", F.expr(taken).alias("taken"))


def lines(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with its place's ``start`` on the line of its source, in shuffled order."""
    rows = sizes.join(sources.select("source", "place", "source_size", "target", "n_docs"), sizes.source.eqNullSafe(sources.source))
    chunks = F.expr(f"greatest(1L, n_docs div {CHUNK_ROWS})")
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * chunks / F.lit(1 << 32)).cast("long")
    rows = stored(rows.select("doc_id", "place", "source_size", "target", "size", "key", "tie", part.alias("part")), "mix-lines")
    order = [F.col("key"), F.col("doc_id"), F.col("tie"), F.col("size")]
    return running(rows, ["place"], "part", order, F.col("size"), "start").drop("part")


def pieces(placed: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: (slot, doc_id, place, start, round, first_word, words), words of documents that a slot takes.

    ``start`` is the document's place on its source's line and tells repeated rows apart.
    """
    spans = placed.where("size > 0").select("doc_id", "place", "start", "size", F.expr("start + size").alias("end"))
    spans = spans.withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (end - 1) div {block_words})")))
    joined = spans.join(slots.where("taken > 0"), ["place", "block"])
    first = f"greatest(start, block * {block_words}L)"
    last = f"least(end, block * {block_words}L + taken)"
    joined = joined.withColumns({"first_word": F.expr(f"{first} - start"), "words": F.expr(f"{last} - {first}")})
    return joined.where("words > 0").select("slot", "doc_id", "place", "start", "round", "first_word", "words")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The documents placed on the lines of their sources, and the mix as pieces of them in slots.

    A null text is empty; a null source is a source, the last one.  Empty texts take part in no slot.
    Repeated rows are documents of their own, a null id sorts as an empty one; other columns are
    ignored.  Order is by the id's md5, so a rerun gives the same mix.  No rows give no pieces.
    """
    sizes = shuffled_sizes(docs)
    sources = with_targets(ranked_sources(sizes))
    placed = stored(lines(sizes, sources), "mix-placed")
    return placed, pieces(placed, schedule(sources, block_words), block_words)


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: its size, its source's size and target, and how many words the mix takes of it."""
    placed, parts = mix(docs, block_words)
    named = placed.select("doc_id", "place", "start", "size", "source_size", "target", F.lit(0).cast("long").alias("words"))
    sums = parts.groupBy("place", "start").agg(F.sum("words").alias("taken"))
    rows = named.where("size > 0").join(sums, ["place", "start"], "left")
    rows = rows.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).unionByName(named.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return rows.select("doc_id", "size", "source_size", "target", "taken")

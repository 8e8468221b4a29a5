"""Temperature mixing of sources to target weights, as DataFrame operations only.

Source i with n_i tokens gets the weight n_i^a / sum n^a. The exponent a in [0, 1] is found by bisection: the largest at
which the entropy of the weights reaches ``min_entropy`` (a share of the highest possible), raised where that would repeat
a source more than ``max_repeats`` times. Without an entropy target, the exponent is the smallest that keeps to the
repetition limit. One Spark job evaluates the inner points of ``HALVINGS`` steps of the bisection at once.

Weights become documents by budgeted block permutations: the documents of a source are dealt into blocks of about
``block_docs`` by a hash, and each pass over a source takes its blocks in another permutation. A source has
weight * budget tokens: whole passes, then blocks of the next pass in its order until the budget is reached, the
last block cut between documents. Blocks, not sources, are the unit of work, so a source that holds a third of all rows
is spread over as many blocks as it needs. The default budget is the smallest that takes every source at least once, so no
document is lost and small sources are repeated.

All of this is worked out on narrow rows (source, hash, tokens), written once. Where the budget ends is found in three steps, each over
sums that are made first: in which of ``RANGES`` ranges of the permutation, in which block, at which document. The outcome is
one row for each source, the place where it ends, and a document is taken or not by comparing its own place with that; so
whole texts are read once more and joined with one row for each source, never with blocks. That join is a broadcast up to
50,000 sources and a shuffle beyond.

Defined results: a null source is a source of its own; null texts and texts without words count one token, so every
source has a weight; very long texts are one document each, however many tokens they have; rows with equal doc_id and text
(also repeated rows) have one place and are taken or left together; an empty table gives an empty table; other columns are
kept as they are, but for those that ``mix`` adds, which replace columns of their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.common import broadcast_if_small, checkpointed

MAX_REPEATS = 1.5
BLOCK_DOCS = 512
HALVINGS, ROUNDS = 5, 7
RANGES = 1024
SPAN = 1 << 40  #: hashes are cut to this range; products with it are exact in a double


def word_tokens(text: Column) -> Column:
    """Words of a text, 1 at least: the share of a source in tokens needs no tokenizer."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)), F.lit(1)).cast("long")


def _hash(seed: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(SPAN))


def _measures(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, int]]:
    """For each exponent: entropy of the weights, largest ratio of passes between two sources, number of sources."""
    rows = sources.withColumn("a", F.explode(F.array(*[F.lit(float(a)) for a in exponents])))
    log = F.log(F.col("tokens").cast("double"))
    peak = rows.groupBy("a").agg(F.max(F.col("a") * log).alias("peak"))
    rows = rows.join(F.broadcast(peak), "a")  # as many rows as exponents
    z, lw = F.sum("w"), F.sum(F.col("w") * (F.col("a") * log - F.col("peak")))
    out = rows.withColumn("w", F.exp(F.col("a") * log - F.col("peak"))).groupBy("a").agg(
        (F.log(z) - lw / z).alias("entropy"), ((F.max((F.col("a") - 1) * log)) - F.min((F.col("a") - 1) * log)).alias("spread"), F.count("*").alias("n")
    )
    return {r["a"]: (r["entropy"], math.exp(min(r["spread"], 700)), r["n"]) for r in out.collect()}


def _bisect(sources: DataFrame, low_side) -> float:
    """The point of [0, 1] where ``low_side(measures)`` turns from true to false, to 2^-35."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / (1 << HALVINGS)
        points = [low + step * i for i in range(1, 1 << HALVINGS)]
        seen = _measures(sources, points)
        a, b = 0, 1 << HALVINGS
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (middle, b) if low_side(*seen[points[middle - 1]]) else (a, middle)
        low, high = low + step * a, low + step * b
    return (low + high) / 2


def exponent(sources: DataFrame, max_repeats: float = MAX_REPEATS, min_entropy: float | None = None) -> float:
    """The exponent for sources(source, tokens)."""
    ends = _measures(sources, [0.0, 1.0])
    if not ends:
        return 1.0
    least = 0.0 if ends[0.0][1] <= max_repeats else _bisect(sources, lambda _, repeats, __: repeats > max_repeats)
    if min_entropy is None:
        return least
    reaches = lambda h, _, n: h >= min_entropy * math.log(max(n, 2))
    wanted = 1.0 if reaches(*ends[1.0]) else _bisect(sources, reaches)
    return max(least, wanted)


def _block(key: str, blocks: str) -> Column:
    return F.floor(F.col(key) / F.lit(float(SPAN)) * F.col(blocks))


def _place(seed: int) -> Column:
    """Where a block of ``_source`` stands in the permutation of its partial pass."""
    return _hash(seed + 1, "_source", "block", "_whole")


def _ends(narrow: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """For each source, where its partial pass ends: a row is taken if (place of its block, block, key) is before the end."""
    same = F.col("source").eqNullSafe(F.col("_source"))
    own = narrow.join(broadcast_if_small(sources), same).withColumn("block", _block("_key", "_blocks"))
    own = own.groupBy("_source", "block", "_whole", "_room").agg(F.sum("n_tokens").alias("n")).withColumn("place", _place(seed))
    own = checkpointed(own.withColumn("range", F.floor(F.col("place") / F.lit(SPAN // RANGES))))

    def reached(rows: DataFrame, *order: str) -> DataFrame:
        """The first of the rows of each source that does not fit into what room is left, and the room before it."""
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        full = rows.withColumn("before", before).where(F.col("before") + F.col("n") > F.col("_room"))
        first = F.min(F.struct(*order, (F.col("_room") - F.col("before")).alias("left")))
        return full.groupBy("_source").agg(first.alias("first")).select("_source", "first.*")

    ranges = own.groupBy("_source", "range", "_room").agg(F.sum("n").alias("n"))
    at_range = reached(ranges, "range").select(F.col("_source").alias("s"), F.col("range").alias("r"), "left")
    same_range = F.col("_source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))
    blocks = own.join(broadcast_if_small(checkpointed(at_range)), same_range).withColumn("_room", F.col("left")).drop("s", "r", "left")
    at_block = checkpointed(reached(blocks, "place", "block"))
    ends = sources.join(broadcast_if_small(at_block.select(F.col("_source").alias("s"), F.col("place").alias("_end_place"), F.col("block").alias("_end_block"), "left")), F.col("_source").eqNullSafe(F.col("s")), "left").drop("s")

    # The documents of the block where the budget ends, those of one key together.
    cut = narrow.join(broadcast_if_small(ends.where("left is not null")), same).withColumn("block", _block("_key", "_blocks")).where(F.col("block") == F.col("_end_block"))
    cut = cut.groupBy("_source", "_key", F.col("left").alias("_room")).agg(F.sum("n_tokens").alias("n"))
    at_key = reached(cut, "_key").select(F.col("_source").alias("s"), F.col("_key").alias("_end_key"))
    return checkpointed(ends.drop("left").join(at_key, F.col("_source").eqNullSafe(F.col("s")), "left").drop("s"))


def _mixture(docs: DataFrame, max_repeats: float, min_entropy: float | None, budget: int | None, block_docs: int, seed: int) -> DataFrame:
    """row (a struct of the columns of docs), weight, pass, block, position."""
    key = _hash(seed, "doc_id", "text")
    narrow = checkpointed(docs.select("source", key.alias("_key"), word_tokens(F.col("text")).alias("n_tokens")))
    counts = checkpointed(narrow.groupBy("source").agg(F.count("*").alias("_docs"), F.sum("n_tokens").alias("tokens")))
    a = exponent(counts, max_repeats, min_entropy)
    log = F.log(F.col("tokens").cast("double"))
    ends = counts.agg(F.max(log).alias("peak"), F.min((a - 1) * log).alias("least")).first()
    peak, least = ends["peak"] or 0.0, ends["least"] or 0.0
    z = counts.agg(F.sum(F.exp(a * (log - peak))).alias("z")).first()["z"] or 1.0
    weight = F.exp(a * (log - peak)) / z
    # Without a budget the source with the fewest passes gets exactly one: passes are in proportion to tokens^(a - 1).
    passes = weight * F.lit(float(budget)) / F.col("tokens") if budget is not None else F.exp((a - 1) * log - least)
    sources = counts.select(F.col("source").alias("_source"), "tokens", weight.alias("weight"), F.round(passes, 9).alias("_passes"), F.ceil(F.col("_docs") / block_docs).alias("_blocks"))
    room = F.floor((F.col("_passes") - F.col("_whole")) * F.col("tokens") + 1e-6)
    sources = checkpointed(sources.withColumn("_whole", F.floor("_passes")).withColumn("_room", room))
    plan = _ends(narrow, sources, seed)

    # There is room for less than all of a source in its partial pass, so each source has an end.
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), key.alias("_key"))
    rows = rows.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("_source"))).withColumn("block", _block("_key", "_blocks"))
    more = F.struct(_place(seed), "block", "_key") < F.struct("_end_place", "_end_block", "_end_key")
    times = (F.col("_whole") + more.cast("int")).cast("int")
    rows = rows.withColumn("_times", times).where("_times > 0")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    spot = (F.col("pass") + _hash(seed + 2, "source", "block", "pass") / F.lit(float(SPAN))) / F.greatest("_passes", F.lit(1e-9))
    return rows.select("row", "weight", "pass", "block", F.round(spot, 9).alias("position"))


ADDED = ("n_tokens", "weight", "pass", "block", "position")


def mix(docs: DataFrame, max_repeats: float = MAX_REPEATS, min_entropy: float | None = None, budget: int | None = None, block_docs: int = BLOCK_DOCS, seed: int = 5) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...), each as often as the mixture takes it, with the columns n_tokens, weight
    (of the source), pass (from 0), block and position (the share of the source's budget that is used up before the row's
    block: ordering by it interleaves the sources by weight). These replace columns of docs with their names."""
    rows = _mixture(docs, max_repeats, min_entropy, budget, block_docs, seed).withColumn("n_tokens", word_tokens(F.col("row.text")))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def repeated(docs: DataFrame, max_repeats: float = MAX_REPEATS, min_entropy: float | None = None, budget: int | None = None, block_docs: int = BLOCK_DOCS, seed: int = 5) -> DataFrame:
    """As ``mix``, with the columns of docs only, in the order of position: partitions follow each other, and rows in them."""
    rows = _mixture(docs, max_repeats, min_entropy, budget, block_docs, seed)
    return rows.repartitionByRange("position").sortWithinPartitions("position", "pass", "block").select("row.*")

"""Sharding by histogram sort: equal-byte shards from splitters found by counting, then one exchange.

Every row gets a 64-bit order key: 40 bits of the text's hash, then 24 bits of the identifier's hash.  Equal texts are
therefore neighbours in the order, and a group of copies of any size can still be cut inside.  The splitters between
shards are key values.  Each round sums the exact bytes below candidate boundaries (one Spark aggregation over a
fixed number of buckets), keeps for every splitter the one bucket that holds its target, and probes only inside it
in the next round, until the bucket's bytes are within the tolerance or it holds one row.  Then rows are exchanged once,
by (shard, piece of the key range), to number the slots.

Nothing is sampled, and the driver sees only histograms of bounded size (at most 65,536 buckets in the first round and
4,096 for each splitter later).
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

#: Bits of the key that each round resolves; together 64.
ROUNDS = (16, 12, 12, 12, 12)
LOW_BITS = 24


def order_key(text: Column, ident: Column) -> Column:
    """40 bits of the text's hash above 24 bits of the identifier's hash, as a signed long."""
    high = F.shiftleft(F.shiftright(F.xxhash64(text), LOW_BITS), LOW_BITS)
    return high.bitwiseOR(F.xxhash64(ident).bitwiseAND(F.lit((1 << LOW_BITS) - 1)))


def _histogram(keyed: DataFrame, shift: int) -> list[tuple[int, int, int]]:
    rows = (
        keyed.groupBy(F.shiftright("_key", shift).alias("b"))
        .agg(F.sum("_weight").alias("w"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    return sorted((r["b"], r["w"], r["n"]) for r in rows)


def find_splitters(
    keyed: DataFrame, n_shards: int, tolerance: float = 0.0005
) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Key values at which shards 1, 2, ... begin, and the first round's histogram.

    ``keyed`` has the columns ``_key`` and ``_weight``.  A splitter is settled when the bucket around its target weighs at
    most ``tolerance`` of a shard, or holds a single row or key; the nearer end of the bucket is taken.
    """
    first = _histogram(keyed, 64 - ROUNDS[0])
    total = sum(w for _, w, _ in first)
    if not total:
        return [], first
    enough = tolerance * total / n_shards
    targets = [total * i / n_shards for i in range(1, n_shards)]
    splitters: dict[int, int] = {}

    def place(hist: list[tuple[int, int, int]], base: float, wanted: list[int], shift: int) -> dict[int, list]:
        """Settle what can be settled among ``wanted``; return the buckets to open with their splitters and base."""
        ends, run = [], base
        for _, w, _ in hist:
            run += w
            ends.append(run)
        todo: dict[int, list] = {}
        for i in wanted:
            at = min(bisect_left(ends, targets[i]), len(hist) - 1)
            bucket, w, n = hist[at]
            below = ends[at] - w
            if w <= enough or n == 1 or shift == 0:
                up = ends[at] - targets[i] < targets[i] - below
                splitters[i] = (bucket + up) << shift
            else:
                todo.setdefault(bucket, [below, []])[1].append(i)
        return todo

    shift = 64 - ROUNDS[0]
    todo = place(first, 0, list(range(n_shards - 1)), shift)
    for bits in ROUNDS[1:]:
        if not todo:
            break
        inside = F.shiftright("_key", shift).isin(list(todo))
        hist = _histogram(keyed.where(inside), shift - bits)
        deeper: dict[int, list] = {}
        for bucket, (below, wanted) in todo.items():
            own = [x for x in hist if x[0] >> bits == bucket]
            deeper.update(place(own, below, wanted, shift - bits))
        todo, shift = deeper, shift - bits
    return [splitters[i] for i in range(n_shards - 1)], first


def assign(keyed: DataFrame, n_shards: int, tie: list[str], tolerance: float = 0.0005) -> DataFrame:
    """``keyed`` with ``shard`` and ``slot``; ``keyed`` is read several times, so it should be a stored table.

    Slots follow the key's order and are gapless from 0 in each shard.  They are numbered inside pieces of the key range,
    a piece being a first-round bucket, or a 4,096th of the part of the bucket that one text fills where the bucket is large;
    a piece's first slot is the sum of the counts before it.
    """
    splitters, first = find_splitters(keyed, n_shards, tolerance)
    shard = F.lit(0)
    for s in splitters:
        if s < 1 << 63:
            shard = shard + (F.col("_key") >= F.lit(s)).cast("int")
    rows = sum(n for _, _, n in first)
    large = max(256, 4 * rows >> ROUNDS[0])
    hot = [b for b, _, n in first if n > large]
    top, fine = F.shiftright("_key", 64 - ROUNDS[0]), F.shiftright("_key", LOW_BITS // 2)
    piece = F.shiftleft(top, 64 - ROUNDS[0] - LOW_BITS // 2)
    if hot:
        piece = F.when(top.isin(hot), fine).otherwise(piece)
    placed = keyed.withColumns({"shard": shard, "_piece": piece})
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy("shard", "_piece").orderBy("_key", *tie)
    numbered = placed.withColumn("_rank", F.row_number().over(within) - 1)
    return (
        numbered.join(starts, ["shard", "_piece"])
        .withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long"))
        .drop("_piece", "_start", "_rank")
    )


def shard_texts(
    docs: DataFrame,
    n_shards: int = 40,
    text: str = "text",
    ident: str = "doc_id",
    overhead: int = 16,
    tolerance: float = 0.0005,
) -> DataFrame:
    """Identifier, size, checksum, shard and slot of every row of ``docs``.

    A row's size is the UTF-8 bytes of its text plus ``overhead``; a null text counts as empty.  Repeated rows each keep
    their own slot; rows with equal keys lie together.  An empty table gives an empty result.  Other columns of ``docs``,
    whatever their names, take no part; join the result to the rows on the identifier to write the shards.
    """
    body = F.col(text)
    keyed = docs.select(
        F.col(ident).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
        order_key(body, F.col(ident)).alias("_key"),
    )
    keyed = durable(keyed.withColumn("_weight", F.col("size")), "shard-keys")
    return assign(keyed, n_shards, ["doc_id", "size", "text_crc32"], tolerance).drop("_key", "_weight")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_texts(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op1_sharding": op1_sharding}

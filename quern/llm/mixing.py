"""Mixing sources to target weights by hash-threshold histograms.

Every document hashes to a 60-bit number that depends on its identifier alone.  A source's mix is: as many whole epochs as
its target holds, and of the last, partial epoch the documents whose hash lies below a threshold.  Thresholds are nested:
a smaller budget takes a subset of what a larger one takes.  The threshold is found by summing sizes per source and hash
bucket, and by opening only the one bucket of each source that holds its budget, until the hash is resolved.
Documents are then filtered by comparing numbers; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, table

#: Bits of the hash that each round resolves.
ROUNDS = (12, 12, 12, 12, 12)
BITS = sum(ROUNDS)
WEIGHTS = (1, 2, 3)
#: A per-source table of up to so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000


def unit_hash(ident: Column) -> Column:
    """60 bits of the MD5 of the identifier's decimal text; a null identifier hashes like an empty text."""
    digest = F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """Target of each source: its share by weight, at most ``epochs`` times its size, the excess reshared by weight.

    ``sizes`` has ``source`` and ``source_size``.  Resharing until none is above has a closed form: targets are
    min(cap, level * weight) for one level, and with sources in order of cap / weight the capped ones come first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    order = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    rows = rows.withColumns(
        {
            "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # a source is capped if, with all before it capped, its share of what is left is above its cap
    level = F.col("left") / F.col("open")
    free = F.when(F.col("cap") >= level * F.col("weight"), level)
    rows = rows.withColumn("level", F.max(free).over(every))
    target = F.when(free.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def _keyed(docs: DataFrame, size: Column | None, source: str, ident: str) -> list[Column]:
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)) if size is None else size
    return [F.col(ident).alias("doc_id"), F.col(source).alias("source"), words.cast("long").alias("size"), unit_hash(F.col(ident)).alias("h")]


def thresholds(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> tuple[DataFrame, int]:
    """Whole epochs and hash threshold of each source, and the number of sources; ``rows`` is a stored table of source, size, h."""
    plan = durable(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), "mix-plan")
    n = plan.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole.cast("long"))
    # what is still wanted in the bucket `at` of the hash's first bits; at the start all hashes are one bucket
    state = plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("at"))
    shift = BITS
    for bits in ROUNDS:
        own = F.shiftright("h", shift) == F.col("at")
        inside = rows.alias("r").join(_small(state, n).alias("s"), F.expr("r.source <=> s.source") & own)
        shift -= bits
        hist = inside.groupBy("r.source", F.shiftright("h", shift).alias("b")).agg(
            F.sum("size").alias("w"), F.first("budget").alias("budget")
        )
        order = Window.partitionBy("source").orderBy("b")
        upto = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("before", upto - F.col("w"))
        # the bucket that holds the budget: the last one with less than the budget before it
        last = hist.where("before < budget or before = 0").groupBy("source").agg(F.max_by(F.struct("b", "before", "budget", "w"), "b").alias("x"))
        found = last.select("source", (F.col("x.budget") - F.col("x.before")).alias("budget"), F.col("x.b").alias("at"), F.col("x.w").alias("w"))
        state = durable(found, "mix-state").drop("w") if shift else durable(found, "mix-state")
    # at full resolution the bucket is one document (or rows of one identifier): taken if that comes nearer to the target
    cut = state.select(
        "source", (F.col("at") + (2 * F.col("budget") >= F.col("w")).cast("long")).alias("threshold")
    )
    plan = plan.join(cut.withColumnRenamed("source", "_s"), F.expr("source <=> _s"), "left").drop("_s")
    plan = durable(plan.select(F.col("source").alias("_s"), "source_size", "target", "whole", "threshold"), "mix-thresholds")
    return plan, n


def _copies(rows: DataFrame, plan: DataFrame, n: int, source: Column, h: Column, epochs: int) -> DataFrame:
    """``rows`` with the source's size and target and the number of copies that the mix takes of each."""
    part = (h < F.coalesce("threshold", F.lit(0).cast("long"))).cast("long")
    out = rows.join(_small(plan, n), source.eqNullSafe(F.col("_s")), "left")
    return out.withColumn("_copies", F.least(F.col("whole") + part, F.lit(epochs).cast("long")))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    source: str = "source",
    ident: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = 3,
) -> DataFrame:
    """Per document: identifier, size, its source's size and target, and how many of its words the mix takes.

    The default size is the number of words.  A null source is a source of its own, named last; a null text has size 0.
    Repeated rows hash alike and are taken together.  A source of size 0 has target 0.  An empty table gives an empty result.
    Columns other than the three named take no part.
    """
    rows = durable(docs.select(_keyed(docs, size, source, ident)), "mix-keys")
    plan, n = thresholds(rows, weights, epochs)
    out = _copies(rows, plan, n, F.col("source"), F.col("h"), epochs)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


def mixed(docs: DataFrame, source: str = "source", ident: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns; texts are not shuffled."""
    rows = durable(docs.select(_keyed(docs, None, source, ident)), "mix-keys")
    plan, n = thresholds(rows, weights, epochs)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = _copies(whole, plan, n, F.col("row")[source], unit_hash(F.col("row")[ident]), epochs).where("_copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_mixing": op10_mixing}

"""Near-duplicates by SimHash, linked through pivot distance tables.

Fingerprints that differ in at most three bits are linked.  Only distinct fingerprints are compared.  Two of them can be linked
only if they agree in all but three of the blocks that the 64 bits are cut into, so each fingerprint goes to one bucket for
each choice of the agreeing blocks, and linked pairs always meet in a bucket.  Inside a bucket the pivot table decides: the Hamming
distances of each fingerprint to sixteen reference fingerprints, worked out once for each distinct fingerprint, stored, and carried into
its buckets.  By the triangle inequality the tables of a
linked pair differ by at most three in every coordinate.  The bucket is sorted by the first coordinate, pairs further
apart than three there are never formed, those that differ by more in another coordinate are discarded, and the survivors are
verified.  A bucket of many fingerprints is cut into tiles in which every two of its members still meet.

Each task emits a spanning forest of the links it has found, not the links, and components are found from these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RECORDS, durable, table, with_place
from .components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Reference fingerprints: hashes of the numbers 0 to 15.
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(16)], dtype=np.uint64)
#: Blocks of 16 bits up to so many distinct fingerprints; beyond, five blocks and keys of two of them.
FEW = 1 << 22
#: Members of a bucket, or of a part of one, before it is cut.
PART = 2048


def fingerprint(data: bytes) -> int:
    """SimHash of a text's UTF-8 bytes: A-Z lower-cased, words, three-word shingles with repeats."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = (ends[: -SHINGLE + 1] - np.fromiter(map(len, words), dtype=np.int64, count=len(words))[: -SHINGLE + 1] - 1).tolist()
        stops = (ends[SHINGLE - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), dtype=np.uint64, count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    data = texts.cast(pa.large_binary())
    out = np.fromiter((fingerprint(x.as_py() or b"") for x in data), dtype=np.uint64, count=len(data))
    return pa.array(out.view(np.int64))


@F.arrow_udf(T.BinaryType())
def pivot_distances(prints: pa.Array) -> pa.Array:
    """Hamming distances of each fingerprint to the reference fingerprints, a byte each."""
    x = prints.to_numpy(zero_copy_only=False).view(np.uint64)
    rows = np.bitwise_count(x[:, None] ^ PIVOTS[None, :]).astype(np.uint8)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _forest(bucket: np.ndarray, prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints of equal bucket, as pairs of fingerprints; ``table`` has their pivot distances."""
    order = np.lexsort((table[:, 0], bucket))
    bucket, prints = bucket[order], prints[order]
    pivot = table[order].astype(np.int8)
    first = pivot[:, 0].astype(np.int16)
    parent = np.arange(len(prints))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    i, step = np.arange(len(prints)), 0
    while True:
        step += 1
        i = i[i + step < len(prints)]
        i = i[(bucket[i] == bucket[i + step]) & (first[i + step] - first[i] <= RADIUS)]
        if not len(i):
            break
        near = i[parent[i] != parent[i + step]]
        near = near[(np.abs(pivot[near] - pivot[near + step]) <= RADIUS).all(axis=1)]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= RADIUS]
        for x in near.tolist():
            a, b = find(x), find(x + step)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(near):
            while not np.array_equal(up := parent[parent], parent):
                parent[:] = up
    child = np.nonzero(parent != np.arange(len(prints)))[0]
    return prints[child], prints[parent[child]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets; the partition comes sorted by bucket, and only the bucket at its end is carried over."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def emit(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        whole, tables = np.concatenate([r for r, _ in rows], axis=1), np.concatenate([x for _, x in rows])
        a, b = _forest(whole[0].view(np.int64), whole[1], tables)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64)])
        if not rows.shape[1]:
            continue
        tables = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, len(PIVOTS))
        start = int(np.argmax(rows[0] == rows[0][-1]))
        if kept and (start or kept[0][0][0][0] != rows[0][-1]):
            yield emit([*kept, (rows[:, :start], tables[:start])])
            kept = []
        elif start:
            yield emit([(rows[:, :start], tables[:start])])
        kept.append((rows[:, start:], tables[start:]))
    if kept:
        yield emit(kept)


def _masks(n: int) -> list[int]:
    """Bit masks of the choices of agreeing blocks, as signed longs."""
    blocks = RADIUS + 1 if n <= FEW else RADIUS + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(x) for x in combinations(each, blocks - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked(prints: DataFrame) -> DataFrame:
    """Spanning links (``a``, ``b``) among the distinct fingerprints ``fp`` with their ``pivots``; ``prints`` is a stored table."""
    masks = _masks(prints.count())
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]))
    keyed = prints.select("fp", "pivots", keys.alias("bucket"))
    large = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
    large = durable(large.select("bucket", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "simhash-large")
    if large.isEmpty():
        tiled = keyed
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("own"))
        tiles = F.transform(others, lambda j: F.xxhash64("bucket", F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
        tiled = keyed.join(large, "bucket", "left").withColumn("own", own)
        tiled = tiled.select("fp", "pivots", F.explode(F.when(F.col("parts").isNull(), F.array("bucket")).otherwise(tiles)).alias("bucket"))
    dealt = tiled.select("bucket", "fp", "pivots").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_links, "a long, b long")


def _named(rows: DataFrame) -> DataFrame:
    """The distinct fingerprints of stored rows (``doc_id``, ``fp``), the least identifier of each and its component's ``root``."""
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    prints = durable(least.withColumn("pivots", pivot_distances(F.col("fp"))), "simhash-prints")
    roots = connected_components(linked(prints), "simhash")
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return durable(named.select("fp", "least", "root"), "simhash-named")


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Identifier, ``fingerprint`` and ``component_id`` of every row: the least identifier that links reach.

    A null or empty text, or one of white space, has fingerprint zero, which links like any other.  A text of one or two words
    is one shingle.  Repeated rows are rows of one component.  Null identifiers never name a component unless it has no other.
    An empty table gives an empty result; other columns take no part.
    """
    rows = durable(docs.select(F.col(ident).alias("doc_id"), fingerprints(F.col(text)).alias("fp")), "simhash-rows", records=RECORDS)
    named = _named(rows)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = named.join(ids, "root").select("fp", "component_id")
    return rows.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that of the least identifier, null last.

    Of rows that share the least identifier, or have none, the first by its place in the stored files is kept, so neither null nor repeated
    identifiers nor repeated rows leave two of a group.  An empty table gives an empty result.  Only fingerprints, identifiers and places are
    shuffled: the rows to leave out are an anti-join, which Spark broadcasts while their table is small, and sorts by place beyond.
    The names ``_file`` and ``_row`` must be free.
    """
    placed = with_place(docs)
    rows = placed.select(F.col(ident).alias("doc_id"), fingerprints(F.col(text)).alias("fp"), "_file", "_row")
    rows = durable(rows, "simhash-rows", records=RECORDS)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_file", "_row")
    kept = rows.join(_named(rows).select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("m"))
    kept = durable(kept.select("m._file", "m._row"), "simhash-kept")
    rest = durable(rows.select("_file", "_row").join(kept, ["_file", "_row"], "left_anti"), "simhash-rest")
    return placed.join(rest, ["_file", "_row"], "left_anti").select(*docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}

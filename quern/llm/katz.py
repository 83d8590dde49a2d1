"""Katz back-off model of words, counted and evaluated over the whole corpus.

Tokens are the lower-cased words of a text and one end token, which also stands for the missing words before the first one.

    P(w | h) = d(C) C(h w) / (c(h) + 1/2)        if C(h w) > 0
             = alpha(h) P(w | h')                 otherwise, h' is h without its first word; alpha(h) = 1 where h was never seen
    P(w)     = d'(c) c(w) / N                     if c(w) > 0, else the mass that discounting frees, as one unknown word

The recursion goes from ``order`` - 1 words of history down to none.  d and d' are Good-Turing discounts (Katz, 1987), for each
order from the counts of counts over the corpus.  The half keeps something for unseen words also after a history whose continuations are
all too frequent to be discounted.  alpha(h) makes the probabilities after h sum to one; it is computed from all continuations
of h in the training documents.

Words and n-grams are known by 64-bit hashes, which are not verified against the words: of a billion distinct n-grams some
0.03 pairs are expected to be counted together.  Documents are encoded in blocks of a million tokens.  A block sends its distinct
n-grams with their training counts to the partition that owns their hash range, packed as sorted arrays; the partition holds
the n-gram counts there, and returns to each block the totals of what that block named.  One of the blocks
that name an n-gram is told that it speaks for it, and adds it to its history's sums.  So the count tables stay
partitioned by hash range, and a block receives no more than it names.  Back-off weights are joined, by history, to the tokens that
need them; those before a document's first word, which all documents need, are a few numbers in the plan.

Blocks and hash ranges keep their size at every input; what grows is their number.  Messages number blocks times ranges, while that is less
than the n-grams that blocks name; beyond some tens of terabytes a message tends to a single n-gram.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Words of an n-gram; tokens of a block; tokens of the corpus for each hash range; rows of a batch that leaves a worker.
ORDER, BLOCK_TOKENS, RANGE_TOKENS, ROWS = 2, 1 << 20, 1 << 20, 1 << 16
#: Counts up to this are discounted.
CUT = 5
HALF = 0.5
END = b""
_U64 = np.uint64


def _pack(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed; sorted keys are given as differences by the caller."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def _pack_keys(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=_U64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, _U64), dtype=_U64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes, in order."""
    x = a * _U64(0x9E3779B97F4A7C15) + (b ^ (b >> _U64(31))) * _U64(0xD6E8FEB86659FD93)
    x ^= x >> _U64(32)
    x *= _U64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U64(29))


def pads(order: int) -> list[int]:
    """Hashes of the histories of 1 to ``order`` - 1 end tokens, which stand before a first word."""
    end = np.array([xxhash.xxh64_intdigest(END)], dtype=_U64)
    out = [end]
    while len(out) < order - 1:
        out.append(_mix(out[-1], end))
    return [int(x[0]) for x in out[: order - 1]]


@dataclass
class Level:
    """The n-grams of one length in a block: which one ends at each token, and which history is before it."""

    ids: np.ndarray
    keys: np.ndarray
    before: np.ndarray | None = None
    head: np.ndarray | None = None
    lower: np.ndarray | None = None


@dataclass
class Block:
    """Some documents as tokens; a token is an index into the sorted hashes of the block's words."""

    vocab: np.ndarray
    tokens: np.ndarray
    starts: np.ndarray
    train: np.ndarray

    def levels(self, order: int) -> Iterator[Level]:
        """Levels 1 to ``order``.  A history's number past those of its level is that of end tokens only."""
        level = Level(self.tokens, self.vocab)
        yield level
        for pad in pads(order):
            before = np.empty(len(self.tokens), dtype=np.int64)
            before[1:] = level.ids[:-1]
            before[self.starts] = len(level.keys)
            codes = before * len(self.vocab) + self.tokens
            each, first, ids = np.unique(codes, return_index=True, return_inverse=True)
            del codes
            head, last = np.divmod(each, len(self.vocab))
            keys = _mix(np.append(level.keys, _U64(pad))[head], self.vocab[last])
            level = Level(ids, keys, before, head, level.ids[first])
            yield level

    def in_training(self) -> np.ndarray:
        return np.repeat(self.train, np.diff(np.append(self.starts, len(self.tokens))))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of identifier, whether it is for training, and text, to blocks."""
    part, number = TaskContext.get().partitionId(), count()

    def fresh():
        return defaultdict(count().__next__), [], [], []

    def emit() -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), dtype=_U64, count=len(ids))
        order = np.argsort(hashes)
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        lengths = np.array([len(x) for x in docs], dtype=np.int64)
        columns = [
            pa.array([part << 32 | next(number)], pa.int64()),
            pa.array([idents], pa.list_(pa.int64())),
            pa.array([train], pa.list_(pa.bool_())),
            pa.array([lengths.tolist()], pa.list_(pa.int64())),
            pa.array([_pack_keys(hashes[order])], pa.binary()),
            pa.array([_pack(rank[np.concatenate(docs)])], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "idents", "train", "lengths", "vocab", "tokens"])

    ids, docs, idents, train = fresh()
    held = 0
    for batch in batches:
        for i, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
            words = (text.as_py() or b"").lower().split()
            words.append(END)
            docs.append(np.fromiter(map(ids.__getitem__, words), dtype=np.uint32, count=len(words)))
            idents.append(i)
            train.append(bool(t))
            held += len(words)
            if held >= BLOCK_TOKENS:
                yield emit()
                ids, docs, idents, train = fresh()
                held = 0
    if docs:
        yield emit()


BLOCKS = "block long, idents array<long>, train array<boolean>, lengths array<long>, vocab binary, tokens binary"


def _block(vocab: bytes, tokens: bytes, lengths, train) -> Block:
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    return Block(_unpack_keys(vocab), _unpack(tokens, np.uint32), np.append(0, ends[:-1]), np.asarray(train, dtype=bool))


def _asking(ranges: int, order: int):
    """Blocks to messages: the n-grams that a block names in one hash range, with their counts in training."""
    width = _U64(min((1 << 64) - 1, (1 << 64) // ranges + 1))
    schema = pa.schema([("n", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("block", "vocab", "tokens", "lengths", "train")}
                b = _block(row["vocab"], row["tokens"], row["lengths"], row["train"])
                training = b.in_training()
                for n, level in enumerate(b.levels(order), 1):
                    by_key = np.argsort(level.keys)
                    keys = level.keys[by_key]
                    counts = np.bincount(level.ids[training], minlength=len(keys))[by_key].astype(np.uint32)
                    part = (keys // width).astype(np.int64)
                    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(keys)).tolist()
                    for at in range(0, len(cuts) - 1, 64):
                        spans = list(zip(cuts[at : at + 64], cuts[at + 1 : at + 65], strict=False))
                        rows = [{"n": n, "part": int(part[a]), "block": row["block"], "keys": _pack_keys(keys[a:z]), "counts": _pack(counts[a:z])} for a, z in spans]
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return ask


ANSWERS = "n int, part long, block long, answer binary, stats array<long>"


def _answer(asked: pa.Table) -> pa.Table:
    """Totals for what each block named in one hash range, and the range's counts of counts (as block -1)."""
    asked = asked.sort_by("block")
    keys = [_unpack_keys(x.as_py()) for x in asked["keys"]]
    ends = np.cumsum([len(k) for k in keys])
    each, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    del keys
    counts = np.concatenate([_unpack(x.as_py(), np.uint32) for x in asked["counts"]])
    totals = np.bincount(where, weights=counts, minlength=len(each)).astype(np.int64)
    out = (totals << 1)[where].astype(_U64)
    out[first] |= _U64(1)  # the first block that names an n-gram speaks for it
    seen = totals[totals > 0]
    stats = np.append(np.bincount(np.minimum(seen, CUT + 2), minlength=CUT + 3), [seen.sum(), len(seen)]).tolist()
    n, size = asked["n"][0].as_py(), len(ends) + 1
    columns = [
        pa.array([n] * size, pa.int32()),
        pa.array([asked["part"][0].as_py()] * size, pa.int64()),
        pa.array([*asked["block"].to_pylist(), -1], pa.int64()),
        pa.array([*(_pack(x) for x in np.split(out, ends[:-1])), None], pa.binary()),
        pa.array([None] * len(ends) + [stats], pa.list_(pa.int64())),
    ]
    return pa.table(columns, names=["n", "part", "block", "answer", "stats"])


@dataclass(frozen=True)
class Discounts:
    """Discounts of counts 0 to CUT + 1 (the last stands for all larger), tokens and types in training."""

    of: np.ndarray
    tokens: int
    types: int
    free: float

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return self.of[np.minimum(counts, CUT + 1)] * counts


def discounts(stats: np.ndarray) -> Discounts:
    """Good-Turing discounts from counts of counts; where these don't give values in (0, 1), absolute ones."""
    n, tokens, types = stats[: CUT + 2].astype(float), int(stats[-2]), int(stats[-1])
    of = np.ones(CUT + 2)
    share = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    for r in range(1, CUT + 1):
        star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 1.0
        d = (star - share) / (1 - share) if share < 1 else 0.0
        of[r] = d if 0 < d < 1 else (r - flat) / r
    freed = sum((1 - of[r]) * r * n[r] for r in range(1, CUT + 1))
    if tokens and not freed:  # every type is frequent: take one token's worth from all
        of *= tokens / (tokens + 1)
        freed = tokens / (tokens + 1)
    return Discounts(of, tokens, types, freed / tokens if tokens else 1.0)


#: What blocks find.  Kind 0, a document: counts, base score, score but for back-off weights, and the longest n-gram known at its first
#: token.  Kind 1, a history: probability of what was seen after it, and of the same one word shorter.  Kind 2: weights that a document needs.
FOUND = "kind int, block long, at long, doc_id long, train boolean, n_tokens long, n_known long, pad int, x double, y double, h long"
_FOUND = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64())]
    + [("n_known", pa.int64()), ("pad", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("h", pa.int64())]
)


def _rows(kind: int, block: int, **columns) -> Iterator[pa.RecordBatch]:
    """Rows of one kind, some at a time; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    for at in range(0, n, ROWS):
        size = min(ROWS, n - at)
        fixed = {"kind": pa.array(np.full(size, kind), pa.int32()), "block": pa.array(np.full(size, block), pa.int64())}
        given = {k: pa.array(v[at : at + size], _FOUND.field(k).type) for k, v in columns.items()}
        yield pa.RecordBatch.from_arrays([(fixed | given).get(f.name, pa.nulls(size, f.type)) for f in _FOUND], schema=_FOUND)


def _evaluate(block: int, idents: list, b: Block, answers: dict[int, list[bytes]], models: list[Discounts]) -> Iterator[pa.RecordBatch]:
    """All rows that one block finds; ``answers`` has, for each level, what the hash ranges returned, in their order."""
    size = len(b.tokens)
    one = models[0]
    known = np.ones(size, dtype=np.int32)
    starts = np.zeros(size, dtype=bool)
    starts[b.starts] = True
    end_count, logs, needs = 0, None, []
    counts = given = keys = None
    for n, level in enumerate(b.levels(len(models)), 1):
        packed = np.concatenate([_unpack(a, _U64) for a in answers.pop(n)])
        found = np.empty(len(packed), dtype=_U64)
        found[np.argsort(level.keys)] = packed
        del packed
        c, mine = (found >> _U64(1)).astype(np.int64), (found & _U64(1)).astype(bool)
        if n == 1:
            given = np.where(c > 0, one.discounted(c) / max(1, one.tokens), one.free)
            with np.errstate(divide="ignore"):
                logs = np.log10(given)[level.ids]
            base = np.add.reduceat(np.log10((c + 0.5) / (one.tokens + 0.5 * (one.types + 1)))[level.ids], b.starts)
            n_known = np.add.reduceat((c > 0)[level.ids].astype(np.int64), b.starts)
            end_count = int(c[np.searchsorted(b.vocab, _U64(xxhash.xxh64_intdigest(END)))])
        else:
            history, history_keys = np.append(counts, end_count), np.append(keys, _U64(pads(n)[-1]))
            shorter, given = given[level.lower], models[n - 1].discounted(c) / (history[level.head] + HALF)
            # sums for each history, over the n-grams that this block speaks for
            own = mine & (c > 0)
            h = level.head[own]
            named = np.unique(h)
            seen, freed = np.bincount(h, given[own], len(history)), np.bincount(h, shorter[own], len(history))
            yield from _rows(1, block, h=history_keys[named].view(np.int64), x=seen[named], y=freed[named])
            hit = (c > 0)[level.ids]
            logs[hit] = np.log10(given[level.ids[hit]])
            known[hit] = n
            needs.append((n, np.flatnonzero(~hit & ~starts & (history[level.before] > 0)), level.before, history_keys))
        counts, keys = c, level.keys
    yield from _rows(
        0, block, at=np.arange(len(b.starts)), doc_id=idents, train=b.train, n_tokens=np.diff(np.append(b.starts, size)),
        n_known=n_known, pad=known[b.starts], x=base, y=np.add.reduceat(logs, b.starts),
    )
    for n, need, before, history_keys in needs:
        need = need[known[need] < n]
        doc = np.searchsorted(b.starts, need, side="right") - 1
        wanted, times = np.unique(doc * len(history_keys) + before[need], return_counts=True)
        doc, h = np.divmod(wanted, len(history_keys))
        yield from _rows(2, block, at=doc, h=history_keys[h].view(np.int64), x=times.astype(np.float64))


def _evaluating(models: list[Discounts]):
    """A partition sorted by block, level and range: the block itself comes first, as level 0, then its answers."""

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        answers: dict[int, list[bytes]] = defaultdict(list)
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda name, i=i, batch=batch: batch.column(name)[i].as_py()
                n = value("n")
                if n:
                    answers[n].append(value("answer"))
                    continue
                if held:
                    yield from _evaluate(*held, answers, models)
                b = _block(value("vocab"), value("tokens"), value("lengths"), value("train"))
                held, answers = (value("block"), value("idents"), b), defaultdict(list)
        if held:
            yield from _evaluate(*held, answers, models)

    return evaluate


def katz_scores(docs: DataFrame, training: Column, text: str = "text", ident: str = "doc_id", order: int = ORDER) -> DataFrame:
    """Each document's counts, add-half unigram score and Katz score; the model learns where ``training`` is true.

    A null or empty text is its end token.  A document whose ``training`` is null is held out.  Repeated rows count as
    often as they occur and are scored each.  Without training documents every probability is one, and scores are 0.  An empty
    table gives an empty result.  Other columns take no part.
    """
    rows = docs.select(F.col(ident).cast("long").alias("i"), F.coalesce(training, F.lit(False)).alias("t"), F.col(text).alias("x"))
    blocks = durable(rows.mapInArrow(_encode, BLOCKS), "katz-blocks")
    tokens = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0]
    ranges = max(1, -(-(tokens or 0) // RANGE_TOKENS))
    asked = blocks.mapInArrow(_asking(ranges, order), "n int, part long, block long, keys binary, counts binary")
    answers = durable(asked.groupBy("n", "part").applyInArrow(_answer, ANSWERS), "katz-answers", records=1)
    stats = {n: np.zeros(CUT + 5, dtype=np.int64) for n in range(1, order + 1)}
    each = answers.where("block = -1").select("n", F.posexplode("stats").alias("i", "x"))
    for r in each.groupBy("n", "i").agg(F.sum("x").alias("x")).collect():
        stats[r["n"]][r["i"]] = r["x"]
    models = [discounts(stats[n]) for n in range(1, order + 1)]
    told = answers.where("block <> -1").select("block", "n", "part", "answer")
    both = blocks.withColumns({"n": F.lit(0), "part": F.lit(0).cast("long")}).unionByName(told, allowMissingColumns=True)
    dealt = both.repartition("block").sortWithinPartitions("block", "n", "part")
    found = durable(dealt.mapInArrow(_evaluating(models), FOUND), "katz-found", ["kind"], records=16)
    weight = F.log10((1 - F.sum("x")) / (1 - F.sum("y")))
    sums = found.where("kind = 1")
    signed = [p - (1 << 64) if p >> 63 else p for p in pads(order)]
    at_start = {r["h"]: r["alpha"] for r in sums.where(F.col("h").isin(signed)).groupBy("h").agg(weight.alias("alpha")).collect()}
    before_first = [sum(at_start.get(h, 0.0) for h in signed[k:]) for k in range(order)]  # by the longest n-gram known there, less one
    alpha = sums.groupBy("h").agg(weight.alias("alpha"))
    backed = found.where("kind = 2").select("block", "at", "h", "x").join(alpha, "h")
    backed = backed.groupBy("block", "at").agg(F.sum(F.col("x") * F.col("alpha")).alias("backed"))
    scored = found.where("kind = 0").join(backed, ["block", "at"], "left")
    first = F.element_at(F.array(*[F.lit(float(x)) for x in before_first]), F.col("pad"))
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(models[0].tokens).cast("long").alias("train_tokens"),
        F.col("x").alias("base_score"),
        (F.col("y") + first + F.coalesce("backed", F.lit(0.0))).alias("score"),
    )


def op9_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return katz_scores(docs, ~held_out)


QUERIES = {"op9_katz_scoring": op9_katz_scoring}

"""Quality by nearest-neighbour voting in a latent semantic space.

A text becomes counts of hashed terms: the shapes of its words, its short words, and terms for its length and its share
of repeated words and lines.  Damped and normalised, these are projected to a few latent dimensions, found by a singular value
decomposition of a bounded sample of labelled documents.  The sample's own vectors go to every task; each document's cosines
with all of them are one matrix product per block of documents, and the labels of its nearest neighbours vote, weighted by
similarity.

The fit uses at most ``sample`` labelled documents, half of them of either label where there are enough, chosen by the hash of the
identifier; every document is scored, over its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Hashed terms, latent dimensions, labelled documents at most, neighbours, and the threshold of ``predicted``.
TERMS, DIMENSIONS, SAMPLE, NEIGHBOURS, THRESHOLD = 1024, 48, 4096, 15, 0.7
#: Rows of one block of the matrix product.
BLOCK = 512
SHAPE = bytes(
    97 if 97 <= i <= 122 else 65 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else 117 if i >= 128 else i for i in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class Terms:
    """Hashed term counts of texts; remembers the terms of the words it has met, up to a bound."""

    def __init__(self, terms: int = TERMS, remembered: int = 1 << 16):
        self.terms, self.remembered = terms, remembered
        self.known: dict[bytes, tuple[int, int]] = {}

    def _of_word(self, word: bytes) -> tuple[int, int]:
        shape = _RUN.sub(rb"\1", word.translate(SHAPE))[:12]
        a = xxhash.xxh32_intdigest(shape, 1) % self.terms
        b = xxhash.xxh32_intdigest(word.lower(), 2) % self.terms if len(word) <= 4 else a
        return a, b

    def counts(self, text: bytes) -> np.ndarray:
        out = np.zeros(self.terms, dtype=np.float32)
        words = text.split()
        if not words:
            return out
        found = Counter(words)
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        at, n = [], []
        for word, k in found.items():
            pair = known.get(word)
            if pair is None:
                pair = self._of_word(word)
                if len(word) <= 32:
                    known[word] = pair
            at += pair
            n += (k, k)
        out += np.bincount(at, weights=n, minlength=self.terms).astype(np.float32)
        np.sqrt(out, out=out)
        lines = text.split(b"\n")
        whole = {
            b"length": min(12, int(math.log2(len(words)))),
            b"echo": min(9, math.ceil(20 * sum(map(eq, words, words[1:])) / len(words))),
            b"distinct": int(10 * len(found) / len(words)),
            b"lines": int(10 * len(set(lines)) / len(lines)),
            b"line length": min(12, int(math.log2(1 + len(words) / len(lines)))),
        }
        scale = 0.3 * float(np.linalg.norm(out))
        for name, level in whole.items():
            out[xxhash.xxh32_intdigest(name + str(level).encode(), 3) % self.terms] += scale
        return out / float(np.linalg.norm(out))


@dataclass(frozen=True)
class Model:
    """Mean and axes of the latent space, and the labelled vectors with their labels; of bounded size."""

    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = (counts - self.mean) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Share of the weight of the ``k`` nearest labelled vectors that label 1 has."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.project(counts) @ self.vectors.T
        k = min(k, len(self.labels))
        top = np.argpartition(near, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 1e-6) ** 4 * self.weights[top]
        return np.clip((weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        x = [terms.counts(t.as_py() or b"").astype("<f4").tobytes() for t in batch.column(2).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["i", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, text: str = "text", ident: str = "doc_id") -> Model:
    """Fit on at most ``sample`` documents that ``labels`` (``doc_id``, ``label``) names.

    Null and other labels than 0 and 1 don't count, nor do null identifiers; of a repeated identifier one row counts.
    The sample is chosen by identifiers alone and then looked up, so that texts are not shuffled.
    """
    named = labels.select(F.col("doc_id").alias("i"), F.col("label").cast("int").alias("label")).where("label in (0, 1) and i is not null")
    named = named.groupBy("i").agg(F.max("label").alias("label"))
    ids = docs.select(F.col(ident).alias("i")).distinct().join(named, "i")
    halves = [ids.where(F.col("label") == v).orderBy(F.xxhash64("i"), "i").limit(sample // 2) for v in (0, 1)]
    chosen = F.broadcast(halves[0].union(halves[1]))  # ``sample`` rows at most
    rows = docs.select(F.col(ident).alias("i"), F.col(text).alias("text")).join(chosen, "i").select("i", "label", "text")
    rows = rows.mapInArrow(_vectors, "i long, label int, x binary").groupBy("i").agg(F.min_by(F.struct("label", "x"), "x").alias("r"))
    got = [r["r"] for r in rows.orderBy("i").collect()]
    if not got:
        none = np.zeros((0, dimensions), dtype=np.float32)
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, dimensions), np.float32), none, np.zeros(0), np.zeros(0))
    x = np.stack([np.frombuffer(r["x"], dtype="<f4") for r in got])
    y = np.array([r["label"] for r in got], dtype=np.float32)
    mean = x.mean(axis=0)
    _, _, right = np.linalg.svd(x - mean, full_matrices=False)
    axes = np.ascontiguousarray(right[:dimensions].T.astype(np.float32))
    latent = (x - mean) @ axes
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return Model(mean, axes, latent.astype(np.float32), y, np.ones(len(y), dtype=np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the model's score in a column; a null text, or one without words, scores 0."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            data = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            for i in range(0, batch.num_rows, BLOCK):  # blocks go back as they are ready, not a batch at a time
                x = np.stack([terms.counts(t.as_py() or b"") for t in data[i : i + BLOCK]])
                out = pa.array(np.where(x.any(axis=1), model.score(x), 0.0).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, BLOCK).columns, out], names=[*batch.schema.names, name])

    if name in docs.columns:
        raise ValueError(f"a column {name} exists already")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(scored, schema)


def remainder(ident: Column, divisor: int) -> Column:
    """crc32 of the identifier's decimal text modulo ``divisor``; null identifiers count as empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % divisor


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Model:
    """The model of ``labels.quality``, from documents whose remainder modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return fit(docs.where(remainder(F.col("doc_id"), 4) != 2), labels)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text")
    out = score(rows, quality_model(spark, sf_dir, docs)).select("doc_id", "score")
    return out.select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op8_quality_classifier": op8_quality_classifier}

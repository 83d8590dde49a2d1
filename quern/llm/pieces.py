"""SentencePiece encoding and decoding with a public model file.

Text is cut into words (spaces go with the word after them); no piece crosses such a cut, so a word's pieces depend on the word
alone.

The relational lattice works on tables of distinct words: bounded-length substrings are exploded and joined to the piece table, the
edges are grouped by word, and a Spark higher-order fold picks the path.  For a merge (BPE) model, :func:`merged`, the fold's state is the
set of cuts in the word, and each step takes out the cut inside the edge of least rank, leftmost first, that spans two neighbouring pieces.  For a
unigram model, :func:`viterbi`, it is the best score at each place.

Documents are encoded by :func:`encode`.  The words of all documents are counted, the frequent ones, a table of bounded size, go through the lattice and
are broadcast with their ids; the rest, each of them in few documents, get the same merges beside their documents: a batch's new words become matrices of
symbols, and all words of a matrix are merged side by side.  So no text and no ids are shuffled.  README has the figures of the lattice for all
words.  The ids are exactly those of the SentencePiece library.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from copy import copy
from heapq import heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RECORDS, durable, table

SPACE = "▁"
#: White space that cuts words where no piece joins it to anything.
BREAKS = "\t\n\x0b\f\r"
#: Words of up to so many characters go through the lattice, whose cuts are the bits of a long.
LONGEST = 62
#: The lattice's words are the most frequent, up to so many: some 10 MB with their ids.
FREQUENT = 1 << 17
#: Other words of up to so many characters are merged in matrices, longer ones by a queue.
WIDE = 32
#: What a task holds at most: words remembered besides the frequent, words counted before they are handed on, words merged side by side, and documents
#: and characters (of one document at least) cut into words at a time.
REMEMBERED, COUNTED, SIDE_BY_SIDE, TEXTS, CHARACTERS = 1 << 16, 1 << 17, 1 << 13, 256, 1 << 20
#: SentencePiece's penalty of an unknown character below the least score of a unigram model.
UNKNOWN_PENALTY = 10.0


def read_model(path: str) -> tuple[list[tuple[str, float, int]], int, int]:
    """Pieces (text, score, type) of a model file, its type (1 unigram, 2 BPE), and the id of the unknown piece."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
        raise ValueError("only models that leave the text as it is and put a space before it")
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    normal = [p for p, _, t in pieces if t in (1, 4)]
    if any(SPACE in p.lstrip(SPACE) for p in normal):
        raise ValueError("pieces of this model cross words")
    return pieces, model.trainer_spec.model_type, next(i for i, p in enumerate(pieces) if p[2] == 2)


def _cuts(joined: list[str]) -> str:
    """The pattern of words, given the pieces of several characters: no such piece may cross from one word to the next.

    White space that no piece joins to anything is a word, spaces go with what follows them.  Where the pieces allow it, digits are words
    of their own, and words of ASCII letters are cut from ASCII signs beside them; a run with other characters is left whole.
    """
    inside = set("".join(joined))
    cuts = "".join(c for c in BREAKS if c not in inside)
    coarse = f"[{cuts}]| *[^ {cuts}]+| +" if cuts else " *[^ ]+| +"
    letter = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    sign = {chr(c) for c in range(128)} - letter - set("0123456789 ") - set(cuts)
    crossed = any((a in letter and b in sign) or (a in sign and b in letter) for p in joined for a, b in zip(p, p[1:], strict=False))
    if crossed or inside & set("0123456789"):
        return coarse
    signs = "".join(re.escape(c) for c in sorted(sign))
    alone = "(?![^\\x00-\\x7f])"
    return (f"[{cuts}]|" if cuts else "") + f"[0-9]| *+[a-zA-Z]++{alone}| *+[{signs}]++{alone}| *+[^ 0-9{cuts}]+| +"


class Merger:
    """Words of a BPE model with byte fallback: where texts are cut, the ids of words too long for the lattice, and ids read back."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str):
        self.pieces, kind, self.unknown = read_model(path)
        if kind != 2:
            raise ValueError("not a merge model")
        usable = [(p, s, i) for i, (p, s, t) in enumerate(self.pieces) if t in (1, 4, 5)]
        symbol = {p: i for p, _, i in usable}
        bytes_ = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == 6}
        self.byte = [bytes_.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.n = len(self.pieces)
        for p, _, _ in usable:  # characters that only occur inside pieces
            for c in p:
                symbol.setdefault(c, len(symbol) + self.n)
        self.of_char = np.full(0x110000, -1, dtype=np.int64)
        for p, i in symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        order = sorted({s for _, s, _ in usable}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        self.base = max(symbol.values()) + 2
        pairs: dict[int, tuple[int, int]] = {}
        for p, s, i in usable:
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (place[s], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.words = re.compile(_cuts([p for p, _, _ in usable if len(p) > 1]))
        self.inside = {i: c for c, i in symbol.items() if i >= self.n}
        self.frequent: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; NONE where they make no piece."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], self.NONE), self.made[at]

    def _matrix(self, chars: np.ndarray) -> np.ndarray:
        """Merge rows of symbols side by side; -1 pads at the end, unknown characters are -2 - code point."""
        rows = chars.copy()
        rank, made = self._look(rows[:, :-1], rows[:, 1:])
        live = np.arange(len(rows))
        while len(live):
            r = rank[live]
            best = r.argmin(axis=1)
            on = r[np.arange(len(live)), best] != self.NONE
            live, best = live[on], best[on]
            if not len(live):
                break
            x, k, m = rows[live], rank[live], made[live]
            i = np.arange(len(live))
            x[i, best] = m[i, best]
            width = x.shape[1]
            step = np.arange(width - 1)[None, :]
            x = np.concatenate([np.take_along_axis(x, step + (step > best[:, None]), axis=1), np.full((len(x), 1), -1)], axis=1)
            step = np.arange(width - 1)[None, :]
            keep = np.minimum(step + (step > best[:, None]), width - 2)
            k, m = np.take_along_axis(k, keep, axis=1), np.take_along_axis(m, keep, axis=1)
            k[:, -1] = self.NONE
            for at in (best - 1, best):
                ok = (at >= 0) & (at < width - 1)
                j, c = i[ok], at[ok]
                k[j, c], m[j, c] = self._look(x[j, c], x[j, c + 1])
            rows[live], rank[live], made[live] = x, k, m
        return rows

    def _queue(self, chars: list[int]) -> list[int]:
        """Merge one word with a queue of pairs, in the order of the lattice."""
        left, right = list(range(-1, len(chars) - 1)), [*range(1, len(chars)), -1]
        queue: list[tuple] = []

        def ask(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and chars[i] >= 0 and chars[j] >= 0 and (p := self.pairs.get(chars[i] * self.base + chars[j])):
                heappush(queue, (p[0], i, j, chars[i], chars[j], p[1]))

        for i in range(len(chars) - 1):
            ask(i, i + 1)
        gone = [False] * len(chars)
        while queue:
            _, i, j, a, b, made = heappop(queue)
            if gone[i] or gone[j] or right[i] != j or chars[i] != a or chars[j] != b:
                continue
            chars[i], gone[j] = made, True
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            ask(left[i], i)
            ask(i, right[i])
        return [c for c, g in zip(chars, gone, strict=True) if not g]

    def _ids(self, symbols: list[int]) -> bytes:
        out: list[int] = []
        for s in symbols:
            if 0 <= s < self.n:
                out.append(s)
            else:  # a character that is no piece
                out += [self.byte[b] for b in (chr(-s - 2) if s < 0 else self.inside[s]).encode()]
        return np.array(out, dtype=np.int32).tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Remember the ids of new words; those too long to remember are returned."""
        extra: dict[str, bytes] = {}
        groups: dict[int, list[str]] = {}
        for w in words:
            groups.setdefault(next((n for n in (8, 12, 16, WIDE) if len(w) <= n), 0), []).append(w)
        for width, group in groups.items():
            text = "".join(group).replace(" ", SPACE)
            points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            symbols = self.of_char[points]
            symbols = np.where(symbols < 0, -2 - points, symbols)
            sizes = np.fromiter(map(len, group), dtype=np.int64, count=len(group))
            ends = np.cumsum(sizes)
            if not width:
                for w, a, z in zip(group, (ends - sizes).tolist(), ends.tolist(), strict=True):
                    (self.known if len(w) <= LONGEST else extra)[w] = self._ids(self._queue(symbols[a:z].tolist()))
                continue
            rows = np.full((len(group), width), -1, dtype=np.int64)
            where = np.repeat(np.arange(len(group)), sizes)
            rows[where, np.arange(len(symbols)) - np.repeat(ends - sizes, sizes)] = symbols
            rows = self._matrix(rows)
            plain = ((rows >= -1) & (rows < self.n)).all(axis=1)
            counts = (rows != -1).sum(axis=1)
            flat = rows[rows != -1]
            stops = np.cumsum(counts)
            ids = flat.astype(np.int32).tobytes()
            for w, a, z, fine in zip(group, (stops - counts).tolist(), stops.tolist(), plain.tolist(), strict=True):
                self.known[w] = ids[4 * a : 4 * z] if fine else self._ids(flat[a:z].tolist())
        return extra

    def cut(self, text: str | None) -> list[str]:
        """The words of a text, with the space that the library puts before it; a space mark in the text is a space to it."""
        return self.words.findall(" " + text.replace(SPACE, " ")) if text else []

    def batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in turn."""
        for group in _groups(texts):
            words = [self.cut(t) for t in group]
            new = [w for w in set().union(*words) if w not in self.frequent]
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
            unknown = [w for w in new if w not in self.known]
            extra: dict[str, bytes] = {}
            for at in range(0, len(unknown), SIDE_BY_SIDE):
                extra |= self.learn(unknown[at : at + SIDE_BY_SIDE])
            tables = (self.frequent, self.known, extra)
            ids = {w: next(t[w] for t in tables[1:] if w in t) for w in new}
            for w in words:
                yield np.frombuffer(b"".join([self.frequent[x] if x in self.frequent else ids[x] for x in w]), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined, the space mark read as a space, the space before the text removed."""
        text = b"".join(self._spelt()[i] for i in ids.tolist()).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text

    def _spelt(self) -> list[bytes]:
        if not hasattr(self, "spelt"):
            byte = {i: bytes([b]) for b, i in enumerate(self.byte) if i != self.unknown}
            self.spelt = [byte.get(i, b"" if t == 3 else p.replace(SPACE, " ").encode()) for i, (p, _, t) in enumerate(self.pieces)]
        return self.spelt


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in turn, so many together as a task may cut into words at a time."""
    group: list[str] = []
    size = 0
    for t in texts:
        if group and (len(group) == TEXTS or size + len(t) > CHARACTERS):
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


_MERGERS: dict[str, Merger] = {}


def merger(path: str, frequent: Broadcast | None = None) -> Merger:
    """A merger for one task, with the ids of frequent words where these are given.

    A worker keeps the model's tables; the words a merger remembers go with it, so they don't stay beside the work of later stages.
    """
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    m = copy(_MERGERS[path])
    m.frequent, m.known = {} if frequent is None else frequent.value, {}
    return m


def _counting(model: str):
    """How often documents have each word that the lattice can take; counts are handed on, to be summed, whenever there are ``COUNTED`` words."""

    def told(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["asked", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model)
        counts: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                counts.update(w for w in m.cut(t.as_py()) if len(w) <= LONGEST)
                if len(counts) >= COUNTED:
                    yield told(counts)
                    counts = Counter()
        if counts:
            yield told(counts)

    return run


def frequent_words(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """The most frequent words of a text column, at most ``FREQUENT``, and their piece ids by the lattice: ``asked``, ``ids``.

    Counts are exact and cover all rows.  Words are taken by classes of nearly equal counts while all of a class still fits, so nothing is sorted.
    """
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_counting(model), "asked string, n long").groupBy("asked").agg(F.sum("n").alias("n"))
    counts = durable(counts.withColumn("class", F.floor(8 * F.log2("n"))), "pieces-words", records=RECORDS)
    classes = sorted(counts.groupBy("class").count().collect(), reverse=True)
    fits = [c["class"] for c, total in zip(classes, accumulate(c["count"] for c in classes), strict=True) if total <= FREQUENT]
    taken = counts.where(F.col("class") >= (fits[-1] if fits else float("inf")))
    taken = taken.select("asked", F.translate("asked", " ", SPACE).alias("word"))
    ids = _lattice(taken.repartition(64, "word"), model)
    return taken.join(ids, "word").select("asked", "ids")


def _frequent(docs: DataFrame, model: str, text: str) -> Broadcast:
    """The ids of frequent words, at most ``FREQUENT``, on every executor."""
    found = frequent_words(docs, model, text).toArrow()
    ids = found.column("ids").combine_chunks()
    flat = np.asarray(ids.flatten(), dtype=np.int32).tobytes()
    ends = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths(), dtype=np.int64))]) * 4
    told = {w: flat[a:z] for w, a, z in zip(found.column("asked").to_pylist(), ends.tolist(), ends[1:].tolist(), strict=False)}
    return docs.sparkSession.sparkContext.broadcast(told)


def encode(docs: DataFrame, model: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of a text in a column, by a BPE model file that every executor has.

    A null or empty text has no ids.  Repeated rows are encoded each.  Very long words are merged with a queue, in time that
    grows little faster than their length.  A column of that name in ``docs`` is an error.
    """
    if name in docs.columns:
        raise ValueError(f"a column {name} exists already")
    frequent = _frequent(docs, model, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model, frequent)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):  # a worker holds the ids of a few documents, not of a batch
                batch = whole.slice(at, TEXTS)
                texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                ids = list(m.batch(texts))
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids; null ids give null."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = merger(model)
        for column in columns:
            yield pa.array([None if x is None else m.decode(np.array(x, dtype=np.int64)) for x in column.to_pylist()], pa.string())

    return rows.withColumn(name, F.arrow_udf(run, T.StringType())(F.col(ids)))


def digest(docs: DataFrame, model: str) -> DataFrame:
    """Count and checksum of each document's ids (unsigned 32-bit, little-endian), and whether they decode to its text.

    A null or empty text has no ids and the checksum 0.  Repeated rows are encoded each; an empty table gives an empty result; columns but
    ``doc_id`` and ``text`` take no part.
    """

    frequent = _frequent(docs, model, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model, frequent)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                counts, sums, same = [], [], []
                for t, ids in zip(texts, m.batch(texts), strict=True):
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    same.append(m.decode(ids) == t.replace(SPACE, " "))
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """The pieces of a model file that text can match: ``piece``, ``id``, ``score``."""
    pieces, _, _ = read_model(model)
    return _local(spark, [(p, i, float(s)) for i, (p, s, t) in enumerate(pieces) if t in (1, 4)], [pa.string(), pa.int32(), pa.float64()], ["piece", "id", "score"])


def _local(spark: SparkSession, rows: list[tuple], types: list[pa.DataType], names: list[str]) -> DataFrame:
    """Rows of the driver by Arrow; as plain Python rows they would start a second daemon with workers beside those of the stages on every executor."""
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names))


def _spans(words: DataFrame, longest: int) -> DataFrame:
    """The substrings of each distinct word of up to ``longest`` characters: ``word``, ``i``, ``k`` (start and length), ``piece``."""
    rows = words.select("word").where(F.length("word") > 0).distinct()
    starts = rows.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i"))
    ends = starts.select("word", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("i")))).alias("k"))
    return ends.select("word", "i", "k", F.substring("word", F.col("i") + 1, F.col("k")).alias("piece"))


def merged(words: DataFrame, model: str) -> DataFrame:
    """The pieces of each distinct ``word``, by merging, as the array ``ids``; words carry their space marks.

    The piece table, at most some hundred thousand rows as models have, is broadcast.  A character that is no piece gives the pieces of its
    bytes.  Words of more than 62 characters, for whose cuts a long has no bits, have null ids.  Null and empty words are left out; an empty
    table gives an empty result.
    """
    long = words.where(F.length("word") > LONGEST).select("word").distinct()
    return _lattice(words.where(F.length("word") <= LONGEST), model).unionByName(long.withColumn("ids", F.lit(None).cast("array<int>")))


def _lattice(words: DataFrame, model: str) -> DataFrame:
    """:func:`merged` for words of up to 62 characters."""
    spark = words.sparkSession
    pieces, kind, unknown = read_model(model)
    if kind != 2:
        raise ValueError("not a merge model")
    usable = [(p, i, s) for i, (p, s, t) in enumerate(pieces) if t in (1, 4)]
    place = {s: r for r, s in enumerate(sorted({s for _, _, s in usable}, reverse=True))}
    table_ = _local(spark, [(p, i, place[s]) for p, i, s in usable], [pa.string(), pa.int32(), pa.int32()], ["piece", "id", "rank"])
    bytes_ = {p: i for i, (p, _, t) in enumerate(pieces) if t == 6}
    of_byte = F.array(*[F.lit(bytes_.get(f"<0x{b:02X}>", unknown)) for b in range(256)])
    found = _spans(words, max(len(p) for p, _, _ in usable)).join(F.broadcast(table_), "piece", "left").where(F.col("id").isNotNull() | (F.col("k") == 1))
    shift = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    inside = shift(F.col("i") + F.col("k")) - shift(F.col("i") + 1)
    edge = F.struct(F.coalesce("rank", F.lit(-1)).alias("rank"), "i", "k", "id", inside.alias("inside"), F.when(F.col("id").isNull(), F.col("piece")).alias("char"))
    edges = found.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    edges = edges.withColumn("joins", F.transform(F.filter("edges", lambda e: e["k"] > 1), lambda e: e["inside"]))

    def step(cuts, _):
        """The least edge that both ends and just one place inside are cuts of loses that cut."""

        def fits(m):
            at = cuts.bitwiseAND(m.bitwiseOR(F.shiftleft(m, 1)).bitwiseOR(F.shiftright(m, 1)))
            return (F.bit_count(at) == 3) & (F.bit_count(at.bitwiseAND(m)) == 1)

        return cuts.bitwiseAND(F.bitwise_not(F.coalesce(F.get(F.filter("joins", fits), 0), F.lit(0).cast("long"))))

    n = F.length("word")
    cuts = F.aggregate(F.sequence(F.lit(1), n), shift(n + 1) - 1, step)
    cut = lambda at: F.call_function("getbit", F.col("cuts"), at) == 1
    chosen = F.filter("edges", lambda e: (F.col("cuts").bitwiseAND(e["inside"]) == 0) & cut(e["i"]) & cut(e["i"] + e["k"]))
    spelt = lambda c: F.transform(F.regexp_extract_all(F.hex(F.encode(c, "utf-8")), F.lit(".."), 0), lambda h: F.element_at(of_byte, F.conv(h, 16, 10).cast("int") + 1))
    ordered = F.array_sort(F.transform(chosen, lambda e: F.struct(e["i"].alias("i"), e["id"].alias("id"), e["char"].alias("char"))))
    ids = F.flatten(F.transform(ordered, lambda e: F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(spelt(e["char"]))))
    return edges.withColumn("cuts", cuts).select("word", ids.alias("ids"))


def viterbi(words: DataFrame, pieces: DataFrame, longest: int, unknown: int, least: float) -> DataFrame:
    """The best path of each distinct ``word`` through its lattice, as the array ``ids``; words carry their space marks.

    ``pieces`` has ``piece``, ``id``, ``score``, at most some hundred thousand rows as models have, and is broadcast.  A
    character that is no piece gets the id ``unknown`` and the score ``least`` less the library's penalty.  Null and empty words are left out.
    """
    n = F.length("word")
    spread = _spans(words, longest).withColumn("j", F.col("i") + F.col("k"))
    found = spread.join(F.broadcast(pieces), "piece", "left")
    single = F.col("j") == F.col("i") + 1
    edge = F.struct("i", "j", F.coalesce("score", F.lit(least - UNKNOWN_PENALTY)).alias("score"), F.coalesce("id", F.lit(unknown)).alias("id"))
    edges = found.where(F.col("id").isNotNull() | single).groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    state = "struct<score:double,back:int,id:int>"
    blank = F.lit(None).cast(state)
    begin = F.concat(F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("back"), F.lit(-1).alias("id")).cast(state)), F.array_repeat(blank, n))

    def fold(acc, e):
        score = F.get(acc, e["i"])["score"] + e["score"]
        here = F.get(acc, e["j"])
        better = here.isNull() | (score > here["score"])
        new = F.struct(score.alias("score"), e["i"].alias("back"), e["id"].alias("id")).cast(state)
        return F.transform(acc, lambda s, k: F.when((k == e["j"]) & better, new).otherwise(s))

    best = edges.select("word", F.aggregate("edges", begin, fold).alias("best"))
    walk = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids")),
        lambda a, _: F.when(a["at"] <= 0, a).otherwise(
            F.struct(F.get("best", a["at"])["back"].alias("at"), F.concat(F.array(F.get("best", a["at"])["id"]), a["ids"]).alias("ids"))
        ),
    )
    return best.select("word", walk["ids"].alias("ids"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}

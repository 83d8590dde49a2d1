"""Token ids in sorted-string-table shards.

A shard is one file of documents in ascending identifier order:

    block*      zstd of entries: varint shared, varint unshared, varint value length, key suffix, value
    index       zstd of entries of the same form: last key of a block -> varint offset, varint length
    bloom       bit array of a Bloom filter over the keys
    footer      fixed size: offsets and lengths of index and bloom, documents, ids, bytes of an id, hashes of the filter, magic

A key is one byte (0: null identifier, 1: present) and the identifier as eight big-endian bytes with the sign bit flipped, so keys
compare as bytes as identifiers do.  Within a block each key gives only what differs from the key before.  A value is the
document's ids as little-endian unsigned integers of two bytes, or four where the vocabulary needs them.  A lookup
reads the footer, asks the Bloom filter, bisects the sparse index and scans one block.

Shards are the partitions of one range exchange on the identifier; a task encodes its documents and streams them into its
file, so no task holds more than a block and the index.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, shared_dir, table

MAGIC = b"QRNSST01"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES = 1 << 16
SHARD_TEXT_BYTES = 24 << 20
BITS_PER_KEY, BLOOM_HASHES = 10, 7
#: Shards up to which their key ranges go to the tasks of a lookup.
MANIFEST_ROWS = 100_000
#: Words whose ids a worker remembers, and the longest of them; forgotten all at once when there are more.
REMEMBERED, LONGEST = 800_000, 64
#: Words of these letters have no composed form that differs, and their lower case has as many letters.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def key_of(ident: int | None) -> bytes:
    return b"\0" if ident is None else b"\1" + struct.pack(">Q", (ident + (1 << 63)) & (1 << 64) - 1)


def ident_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack_entries(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    out, before = [], b""
    for key, value in entries:
        same = 0
        while same < min(len(key), len(before)) and key[same] == before[same]:
            same += 1
        out += [_varint(same), _varint(len(key) - same), _varint(len(value)), key[same:], value]
        before = key
    return b"".join(out)


def unpack_entries(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at, key = 0, b""
    while at < len(data):
        same, at = _read_varint(data, at)
        more, at = _read_varint(data, at)
        n, at = _read_varint(data, at)
        key = key[:same] + data[at : at + more]
        at += more
        yield key, data[at : at + n]
        at += n


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard to a binary stream; keys come in ascending order, equal keys in the order given."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at, self.ids, self.docs = out, width, 0, 0, 0
        self.block: list[tuple[bytes, bytes]] = []
        self.index: list[tuple[bytes, bytes]] = []
        self.keys: list[bytes] = []
        self.held = 0

    def add(self, ident: int | None, value: bytes) -> None:
        key = key_of(ident)
        self.block.append((key, value))
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // self.width
        self.held += len(value)
        if self.held >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block:
            where = self._put(zstandard.compress(pack_entries(self.block), 1))
            self.index.append((self.block[-1][0], _varint(where[0]) + _varint(where[1])))
            self.block, self.held = [], 0

    def finish(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = self._put(zstandard.compress(pack_entries(self.index), 1))
        filt = self._put(struct.pack("<Q", bits) + bytes(bloom))
        self._put(FOOTER.pack(*index, *filt, self.docs, self.ids, self.width, BLOOM_HASHES, MAGIC))


class Reader:
    """Reads a shard; ``read(offset, length)`` gives bytes, so a lookup touches footer, filter, index and one block."""

    def __init__(self, read, size: int):
        self.read = read
        i, n, b, m, self.docs, self.ids, self.width, _, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        entries = list(unpack_entries(zstandard.decompress(read(i, n)))) if n else []
        self.last = [k for k, _ in entries]
        self.where = []
        for _, v in entries:
            offset, at = _read_varint(v, 0)
            self.where.append((offset, _read_varint(v, at)[0]))
        self.bloom_at = (b, m)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        return unpack_entries(zstandard.decompress(self.read(*self.where[i])))

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.where)):
            for key, value in self._block(i):
                yield ident_of(key), value

    def get(self, ident: int | None) -> list[bytes]:
        """The values of an identifier: none, one, or those of all rows that repeat it."""
        key, raw = key_of(ident), self.read(*self.bloom_at)
        bits = struct.unpack_from("<Q", raw)[0]
        if not all(raw[8 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits)):
            return []
        found = []
        for i in range(bisect_left(self.last, key), len(self.last)):
            found += [v for k, v in self._block(i) if k == key]
            if self.last[i] > key:
                break
        return found

    def ids_of(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype=f"<u{self.width}")


_TOKENIZERS: dict = {}


class Encoder:
    """Ids of texts as bytes, by a tokenizer that drops white space between words, so that a text's ids are those of its words.

    A worker remembers the ids of words it has met.  Where the tokenizer is seen to ignore case and to cut a comma or a full stop
    off a word of Latin letters, the word without them is looked up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        if suffix:
            self.is_end[[i for p, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if p.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.plain: dict[str, bytes] = {}
        ids = dict(zip(("Ab,", "ab", ",", "\u00c9b.", "\u00e9b", "."), self._ask(["Ab,", "ab", ",", "\u00c9b.", "\u00e9b", "."]), strict=True))
        self.cuts = ids["Ab,"] == ids["ab"] + ids[","] and ids["\u00c9b."] == ids["\u00e9b"] + ids["."]
        self.ends = {"": b"", ",": ids[","], ".": ids["."]}

    def _ask(self, words: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype=f"<u{self.width}").tobytes() for e in got]

    def _ask_plain(self, cores: list[str]) -> list[bytes]:
        """Ids of words of letters, many in one text, cut after the pieces that end a word where the vocabulary marks these."""
        if not self.is_end.any():
            return self._ask(cores)
        texts = [" ".join(cores[i : i + 64]) for i in range(0, len(cores), 64)]
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.array([i for e in got for i in e.ids], dtype=f"<u{self.width}")
        stops = (np.nonzero(self.is_end[ids])[0] + 1) * self.width
        if len(stops) != len(cores):
            return self._ask(cores)
        data, starts = ids.tobytes(), [0, *stops[:-1].tolist()]
        return [data[a:z] for a, z in zip(starts, stops.tolist(), strict=True)]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not met before; those too long to remember are returned."""
        # plain lists of strings: tuples in these loops would keep Python's collector busy
        together = b"\n".join(words).decode()
        cores, ends, cut, rest, whole = [], [], [], [], []
        for w, text, low in zip(words, together.split("\n"), together.lower().split("\n"), strict=True):
            end = text[-1] if text[-1] in ",." else ""
            if self.cuts and LATIN.fullmatch(text, 0, len(text) - len(end)):
                cut.append(w)
                cores.append(low[:-1] if end else low)
                ends.append(end)
            else:
                rest.append(w)
                whole.append(text)
        new = [core for core in set(cores) if core not in self.plain]
        if len(self.plain) + len(new) > REMEMBERED:
            self.plain.clear()
            new = list(set(cores))
        if new:
            self.plain.update(zip(new, self._ask_plain(new), strict=True))
        extra: dict[bytes, bytes] = {}
        for w, core, end in zip(cut, cores, ends, strict=True):
            (self.known if len(w) <= LONGEST else extra)[w] = self.plain[core] + self.ends[end]
        for w, ids in zip(rest, self._ask(whole), strict=True):
            (self.known if len(w) <= LONGEST else extra)[w] = ids
        return extra

    def batch(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, in turn; the texts' new words are encoded together."""
        for at in range(0, len(texts), 256):
            words = [t.split() for t in texts[at : at + 256]]
            met = set().union(*words)
            new = [w for w in met if w not in self.known]
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = list(met)
            extra = self._learn(new) if new else {}
            ids = (self.known | extra) if extra and len(self.known) < 1 << 12 else self.known
            for w in words:
                if extra and ids is self.known:
                    yield b"".join([ids[x] if x in ids else extra[x] for x in w])
                else:
                    yield b"".join(map(ids.__getitem__, w))


def encoder(path: str) -> Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Write the shards of ``docs`` under ``folder`` and return their manifest: shard, file, documents, ids.

    ``folder`` is a URI that pyarrow and Spark both reach; ``tokenizer`` is a file that every executor has.  A null text is
    empty: its document holds only the end id.  Null identifiers come first.  Repeated rows are all written.  An empty table
    gives no shard.  A retried task replaces its own file whole.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-size // SHARD_TEXT_BYTES))
    rows = docs.select(F.col(ident).cast("long").alias("i"), F.col(text).alias("t"))
    rows = rows.repartitionByRange(shards, "i").sortWithinPartitions("i", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"shard-{shard:06d}.sst"
        encode = encoder(tokenizer)
        end = np.array([end_id], dtype=f"<u{encode.width}").tobytes()
        with fs.open_output_stream(f"{root}/.{name}.{attempt}") as out:
            writer = Writer(out, encode.width)
            for batch in batches:
                texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.large_binary())]
                for i, ids in zip(batch.column(0).to_pylist(), encode.batch(texts), strict=True):
                    writer.add(i, ids + end)
            writer.finish()
        fs.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
        last = ident_of(writer.keys[-1]) if writer.keys else None
        row = {"shard": [shard], "file": [name], "n_docs": [writer.docs], "n_ids": [writer.ids]}
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(v, t) for v, t in zip([*row.values(), [last]], types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, [*row, "last"])

    return durable(rows.mapInArrow(write, "shard long, file string, n_docs long, n_ids long, last long"), "sst-manifest")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _readers(batch: pa.RecordBatch) -> Iterator[tuple[str, Reader]]:
    for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        data = content.as_buffer()
        yield file, Reader(lambda at, n, d=data: d.slice(at, n).to_pybytes(), data.size)


def _values(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's identifier and ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, reader in _readers(batch):
                for ident, value in reader:
                    yield pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), pa.array([reader.ids_of(value).tolist()], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _files(spark, folder).mapInArrow(read, "doc_id long, ids array<long>")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the shards: identifier, start, count and checksum of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, reader in _readers(batch):
                idents, counts, sums = [], [], []
                for ident, value in reader:
                    idents.append(ident)
                    counts.append(len(value) // reader.width)
                    sums.append(zlib.crc32(reader.ids_of(value).astype("<u4").tobytes()))
                ends = np.cumsum(np.array(counts, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * len(idents), pa.string()),
                        pa.array(idents, pa.int64()),
                        pa.array(ends - np.array(counts, dtype=np.int64)),
                        pa.array(counts, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["file", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_start"))
    rows = _files(spark, folder).mapInArrow(read, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "file").select("doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(ids: DataFrame, manifest: DataFrame, folder: str, ident: str = "doc_id") -> DataFrame:
    """The token ids of each identifier in ``ids`` that the shards hold, by the filter and the sparse index of a shard.

    A shard's range of identifiers is in the manifest, which says which file to ask; it goes to the tasks with up to
    ``MANIFEST_ROWS`` shards.  With more, the shards are scanned and joined instead.  Null identifiers ask for nothing.
    """
    asked = ids.select(F.col(ident).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ranges = manifest.where("last is not null").orderBy("last").select("last", "file").limit(MANIFEST_ROWS + 1).collect()
    if len(ranges) > MANIFEST_ROWS:
        return _values(manifest.sparkSession, folder).join(asked, "doc_id", "left_semi")
    last = np.array([r["last"] for r in ranges], dtype=np.int64)
    files = [r["file"] for r in ranges]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        at: tuple = ("", None)
        for batch in batches:
            out: dict = {"doc_id": [], "ids": []}
            for i in np.sort(batch.column(0).to_numpy()).tolist():
                where = int(np.searchsorted(last, i))
                if where == len(files):
                    continue
                if at[0] != files[where]:
                    f = fs.open_input_file(f"{root}/{files[where]}")
                    at = files[where], Reader(lambda o, n, f=f: f.read_at(n, o), f.size())
                for value in at[1].get(i):
                    out["doc_id"].append(i)
                    out["ids"].append(at[1].ids_of(value).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return asked.mapInArrow(find, "doc_id long, ids array<long>")


def op5_sstable_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/quern-sst-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder
    manifest = write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(manifest, folder)


QUERIES = {"op5_sstable_token_ids": op5_sstable_token_ids}

"""Nearest neighbours by a neighbour graph, built with NN-descent joins and searched greedily.

Rows of equal vectors are one node.  Nodes start with the nearest of those that share a leaf, a leaf being the nodes of one sign
pattern under random planes.  Then, round by round, the neighbours and a bounded sample of the reverse neighbours of each node meet, and each
pair with a new member that is nearer than what its ends hold becomes a candidate edge; every node keeps its ``k``
best.  Rounds end when few edges change.

The graph joins nodes of near direction, whatever their norms; the search ranks by inner product, and its start nodes include
the longest vectors, which every query may want.  A query
starts at its own node's neighbours and takes those of some start nodes, the same for all, that its beam has room for beside these; then it expands
the nodes of its beam that it has not expanded yet, along edges of either direction, until the beam no longer changes.  Start nodes are compared with the beam's last in blocks, so that those behind it
are never rows.  Scores in the search are
exact, on the original vectors.  How wide beams are is found on a sample of the queries, which is compared with brute force: while too few of
their nearest are found, beams are doubled, more start nodes are added, and the search goes on.  The other queries then go
through the same widths; as the last is known, they need no score that cannot rank within two beams of it.  A beam of all nodes starts at all of them.

Nodes are dealt to slices and queries to blocks, by hash, and every join is between these: a row (``PACKED``) has, as arrays, all that one slice or
block has for another, so that edges, candidates and scores are numbers in arrays and not rows.  Vectors travel to where they are compared, and no
task needs more than the members of one leaf, one slice or one block.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

#: Edges of a node, reverse neighbours sampled in a round, candidates that a pair's end proposes in one meeting.
EDGES, REVERSE, PROPOSE = 40, 40, 8
#: Nodes of a leaf at most, and of the leaf of a small table at least; leaf tables for each plane of one, and the share of changed edges below which rounds end.
LEAF, LEAST, TABLES, ENOUGH = 16_384, 800, 4, 0.02
#: Nodes that a query keeps in its beam at first, and that it expands at once at most.
BEAM, AT_ONCE = 40, 160
#: Nodes of a slice while the graph is built, and in the search, bytes of a slice's vectors, and slices at least.
MEETING, SLICE, SLICE_BYTES, SLICES = 4096, 16_384, 1 << 23, 16
#: Queries that search together.
ASKING = 64
#: Queries, and start nodes, that are compared in one block.
BLOCK = 1024
#: Queries compared with brute force, and the mean recall below which beams are doubled.
SAMPLE, TARGET = 256, 0.95
SEED = 7

#: What one slice or block has for another (``at``): which part of a join it is, a count, and arrays.
PACKED = "at long, kind int, size long, p array<binary>"
#: Packed rows that a worker is given at once.
RECORDS = 8

Row = tuple[int, int, int, list[np.ndarray]]


def _dealt(ids: np.ndarray, parts: int) -> np.ndarray:
    """The slice or block of each identifier."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.int64) % parts


def _shares(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each value of ``to``."""
    if not len(to):
        return
    order = np.argsort(to.astype(np.uint16) if to.max() < 1 << 16 else to, kind="stable")
    at = to[order]
    cuts = [0, *(np.nonzero(at[1:] != at[:-1])[0] + 1).tolist(), len(at)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        yield int(at[a]), [c[order[a:z]] for c in columns]


def _place_in_group(at: np.ndarray) -> np.ndarray:
    """How many of the same value stand before each, in a sorted array."""
    first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    return np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else np.zeros(0, np.int64)


def _pair(u: np.ndarray, v: np.ndarray, parts: int) -> np.ndarray:
    """One number for a place under ``parts`` and a node; of one place, nodes that agree in the bits left (51 for a slice) count as one."""
    bits = np.uint64(64 - max(1, parts.bit_length()))
    return (u.astype(np.uint64) << bits) | (v.astype(np.uint64) & ((np.uint64(1) << bits) - np.uint64(1)))


def _distinct(key: np.ndarray, known: int = 0) -> np.ndarray:
    """Where one of each value stands, in the order of values; values among the first ``known`` are left out."""
    if not len(key):
        return np.zeros(0, np.int64)
    order = np.argsort(key)
    at = key[order]
    first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
    return order[first] if not known else order[first[~np.logical_or.reduceat(order < known, first)]]


def _batch(rows: Iterable[Row]) -> Iterator[pa.RecordBatch]:
    for at, kind, size, arrays in rows:
        columns = [pa.array([at], pa.int64()), pa.array([kind], pa.int32()), pa.array([size], pa.int64()), pa.array([[a.tobytes() for a in arrays]], pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, ["at", "kind", "size", "p"])


def _steps(step: Callable[[int, Iterator[tuple[int, list[bytes]]]], Iterable[Row]]):
    """``step`` for each ``at`` of rows that come sorted by it, with its rows in the order of their kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True))
        for at, group in itertools.groupby(rows, key=lambda row: row[0]):
            yield from _batch(step(at, ((kind, p) for _, kind, p in group)))

    return run


def _joined(step, places: int, *parts: DataFrame) -> DataFrame:
    """Packed rows of all parts brought together by ``at``, and what ``step`` makes of each; there are no more tasks than ``places`` that ``at`` can be."""
    both = functools.reduce(DataFrame.union, parts)
    return both.repartition("at").coalesce(max(SLICES, places)).sortWithinPartitions("at", "kind").mapInArrow(_steps(step), PACKED)


def _kept(df: DataFrame, name: str) -> DataFrame:
    return durable(df, name, None, RECORDS)


def _columns(rows: Iterable[tuple[int, list[bytes]]], *dtypes) -> list[np.ndarray]:
    """The arrays of all rows, joined."""
    rows = [p for _, p in rows]
    return [np.frombuffer(b"".join(p[i] for p in rows), dtype=t) for i, t in enumerate(dtypes)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(parts: int, kind: int):
    """Identifiers and vectors by slice or block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column(0).to_numpy(), batch.column(1)
                x = _matrix(x) if not pa.types.is_binary(x.type) else np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(len(ids), -1)
                yield from _batch((to, kind, len(p[0]), p) for to, p in _shares(_dealt(ids, parts), ids, x))

    return run


def nodes_of(rows: DataFrame, vector: str = "embedding", ident: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """Nodes (``node``, ``x``: its vector) and members (``node``, ``vec_id``); vectors that can take no part are left out.

    A vector takes no part if it is null, empty, zero, has null or non-finite components, or not the most common length.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = rows.where(x.isNotNull() & (F.size(x) > 0)).where(~bad & F.exists(x, lambda v: v != 0))
    fine = fine.select(F.col(ident).alias("vec_id"), F.transform(x, lambda v: v.cast("double") + F.lit(0.0)).alias("x"))
    length = fine.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    fine = fine.where(F.size("x") == (length["n"] if length else 0)).withColumn("node", F.xxhash64("x"))
    nodes = fine.groupBy("node").agg(F.first("x").alias("x"))
    return durable(nodes, "nn-nodes"), durable(fine.select("node", "vec_id"), "nn-members")


def _sphere(planes: np.ndarray, tables: int):
    """Each node's direction in single precision, and its leaf in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, len(planes)))
            x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)  # squares of very large or small components stay finite
            g = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
            bits = g @ planes > 0
            leaves = [(bits[:, t::tables] @ (1 << np.arange(bits[:, t::tables].shape[1]))).tolist() for t in range(tables)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in g], pa.binary()), pa.array(list(zip(*leaves, strict=True)), pa.list_(pa.int64()))],
                ["node", "g", "leaves"],
            )

    return run


def _leaves(k: int, slices: int):
    """Candidate edges by the slice of their first end: the ``k`` nearest of each member of a leaf (``at``) in it, and few more; rows come sorted: at, node, g."""

    def nearest_in(rows: list[tuple]) -> list[np.ndarray]:
        node, g = (np.concatenate(x) for x in zip(*rows, strict=True))
        few, out = min(k, len(node) - 1), []
        for a in range(0, len(node) if few > 0 else 0, 512):
            s = g[a : a + 512] @ g.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -9.0
            fold = max(1, min(32, len(node) // (4 * few)))  # as many groups' best as edges are wanted: the least of these bounds the edges, and few more pass
            best = s[:, : len(node) // fold * fold].reshape(len(s), fold, -1).max(axis=1)
            i, j = np.divmod(np.flatnonzero(s >= np.partition(best, -few, axis=1)[:, -few, None]), len(node))
            out.append((node[a + i], node[j], s[i, j]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, out = [], None, []

        def emit() -> Iterator[pa.RecordBatch]:
            edges = [np.concatenate(x) for x in zip(*(x for x in out if x), strict=True)]
            out.clear()
            if edges:
                yield from _batch((to, 1, len(p[0]), p) for to, p in _shares(_dealt(edges[0], slices), *edges))

        for batch in batches:
            if not batch.num_rows:
                continue
            at, node, g = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32)
            g = g.reshape(len(node), -1)
            cuts = [0, *(np.nonzero(at[1:] != at[:-1])[0] + 1).tolist(), len(at)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if held and last != at[a]:
                    out.append(nearest_in(held))
                    held = []
                    if sum(len(x[0]) for x in out if x) > 500_000:
                        yield from emit()
                held.append((node[a:z], g[a:z]))
                last = at[a]
        if held:
            out.append(nearest_in(held))
        yield from emit()

    return run


def _merged(k: int):
    """The graph of one slice: its nodes, their directions, and the ``k`` best distinct edges of each; an edge known before is not fresh.

    Comes as nodes and directions, with or without edges, and candidates.  Absent edges have the score -9.
    """

    def step(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
        rows = list(rows)
        stored = [row for row in rows if row[0] == 0]
        node, g = _columns(stored, np.int64, np.float32)
        order = np.argsort(node)
        node, g = node[order], g.reshape(len(node), -1)[order]
        u, v, s = _columns([row for row in rows if row[0] == 1], np.int64, np.int64, np.float32)
        u, known = np.searchsorted(node, u), np.zeros(0, np.uint64)
        if len(stored[0][1]) > 2:  # stored by this step, so in order
            near, old = (np.frombuffer(stored[0][1][i], t).reshape(-1, k) for i, t in ((2, np.int64), (3, np.float32)))
            beats = s > old[u, -1]
            i, j = np.nonzero(old > -9.0)
            u, v, s = (np.concatenate(x) for x in ((i, u[beats]), (near[i, j], v[beats]), (old[i, j], s[beats])))
            known = _pair(u[: len(i)], v[: len(i)], len(node))
        one = _distinct(_pair(u, v, len(node)))
        u, v, s = u[one], v[one], s[one]
        order = np.argsort((u.astype(np.int64) << 32) + (9.0 - s).astype(np.float32).view(np.int32))  # positive numbers stand in the order of their bits
        order = order[_place_in_group(u[order]) < k]
        u, v, s = u[order], v[order], s[order]
        r, fresh = _place_in_group(u), ~np.isin(_pair(u, v, len(node)), known)
        edges = [np.zeros((len(node), k), np.int64), np.full((len(node), k), -9.0, np.float32), np.zeros((len(node), k), bool)]
        for where, what in zip(edges, (v, s, fresh), strict=True):
            where[u, r] = what
        yield at, 0, int(fresh.sum()), [node, g, *edges]

    return step


def _graph(p: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """Nodes, directions, and the ends, scores and freshness of their edges."""
    node = np.frombuffer(p[0], np.int64)
    return node, np.frombuffer(p[1], np.float32).reshape(len(node), -1), *(np.frombuffer(x, t).reshape(-1, k) for x, t in zip(p[2:], (np.int64, np.float32, bool), strict=True))


def _sides(k: int, slices: int):
    """Who meets at which node: the ends of its edges (kind 1), and the nodes whose edges end at it (kind 2)."""

    def step(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
        for _, p in rows:
            node, _, near, s, fresh = _graph(p, k)
            i, j = np.nonzero(s > -9.0)
            u, v, new = node[i], near[i, j], fresh[i, j]
            yield at, 1, len(u), [u, v, new]
            yield from ((to, 2, len(c[0]), c) for to, c in _shares(_dealt(v, slices), v, u, new))

    return step


def _members(turn: int):
    """The members of one slice's meetings: of reverse neighbours a sample; meetings without a fresh edge are left out."""

    def step(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
        rows = list(rows)
        own, other = (_columns([row for row in rows if row[0] == kind], np.int64, np.int64, bool) for kind in (1, 2))
        drawn = np.random.default_rng([SEED, turn, at]).random(len(other[0]))
        order = np.lexsort((drawn, other[0]))
        other = [x[order] for x in other]
        some = _place_in_group(other[0]) < REVERSE
        here, node, fresh = (np.concatenate([x, y[some]]) for x, y in zip(own, other, strict=True))
        order = np.lexsort((~fresh, node, here))
        here, node, fresh = here[order], node[order], fresh[order]
        one = np.concatenate([[True], (here[1:] != here[:-1]) | (node[1:] != node[:-1])]) if len(here) else np.zeros(0, bool)
        here, node, fresh = here[one], node[one], fresh[one]
        _, group = np.unique(here, return_inverse=True)
        live = (np.bincount(group, fresh) > 0)[group]
        yield at, 1, int(live.sum()), [here[live], node[live], fresh[live]]

    return step


def _requests(slices: int):
    """Which vectors one slice's meetings need of another slice."""

    def step(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
        for _, p in rows:
            node = np.unique(np.frombuffer(p[1], np.int64))
            yield from ((to, 1, len(c[0]), [np.array([at]), *c]) for to, c in _shares(_dealt(node, slices), node))

    return step


def _answers(k: int):
    """The directions asked for, each with the score that a new edge must beat."""

    def step(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
        node, g, _, s, _ = _graph(next(rows)[1], k)
        for _, p in rows:
            ids = np.frombuffer(p[1], np.int64)
            i = np.searchsorted(node, ids)
            yield int(np.frombuffer(p[0], np.int64)[0]), 0, len(ids), [ids, g[i], s[i, -1]]

    return step


def _meetings(slices: int):
    """Candidate edges among the members of each meeting, by the slice of their first end."""

    def step(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
        rows = list(rows)
        ids, g, least = _columns([row for row in rows if row[0] == 0], np.int64, np.float32, np.float32)
        order = np.argsort(ids)
        ids, g, least = ids[order], g.reshape(len(ids), -1)[order], least[order]
        here, node, fresh = _columns([row for row in rows if row[0] == 1], np.int64, np.int64, bool)
        if not len(here):
            return
        col, row = _place_in_group(here), np.unique(here, return_inverse=True)[1]
        width = int(col.max()) + 1
        who, new = np.full((row[-1] + 1, width), -1, np.int32), np.zeros((row[-1] + 1, width), bool)
        who[row, col], new[row, col] = np.searchsorted(ids, node), fresh
        out = []
        for a in range(0, len(who), 128):
            w, f = who[a : a + 128], new[a : a + 128]
            x = g[w]
            s = np.matmul(x, x.transpose(0, 2, 1))
            s[~(f[:, :, None] | f[:, None, :])] = -9.0
            s[:, np.arange(width), np.arange(width)] = -9.0
            s[np.broadcast_to((w < 0)[:, None, :], s.shape)] = -9.0
            bar = np.where(w < 0, np.float32(9.0), least[w])
            if width > PROPOSE:
                bar = np.maximum(bar, np.nextafter(np.partition(s, -PROPOSE, axis=2)[:, :, -PROPOSE], np.float32(-10.0)))
            m, i, j = np.nonzero((s > bar[:, :, None]) & (s > -9.0))
            out.append((w[m, i], w[m, j], s[m, i, j]))
        u, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
        order = _distinct(u.astype(np.int64) * len(ids) + v)  # one pair meets at several nodes
        u, v, s = ids[u[order]], ids[v[order]], s[order]
        yield from ((to, 1, len(c[0]), c) for to, c in _shares(_dealt(u, slices), u, v, s))

    return step


def _edge_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (p for batch in batches for p in batch.column(0).to_pylist()):
            node, _, near, s, _ = _graph(p, k)
            i, j = np.nonzero(s > -9.0)
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(near[i, j]), pa.array(s[i, j])], ["u", "v", "s"])

    return run


def build_graph(nodes: DataFrame, k: int = EDGES) -> DataFrame:
    """Edges (``u``, ``v``, ``s``) from each node to its nearest found; ``nodes`` is a stored table."""
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, slices = size["n"], _slices(size["n"], size["d"] or 1, MEETING)
    bits = max(0, math.ceil(math.log2(max(1, n) / min(LEAF, max(LEAST, n // 8)))))  # leaves are compared in blocks, which costs less than as many edges
    tables = TABLES * bits or 1  # the more planes, the fewer near pairs share a leaf; without planes all tables are the same
    planes = np.random.default_rng(SEED).normal(size=(size["d"] or 0, bits * tables)).astype(np.float32)
    placed = durable(nodes.mapInArrow(_sphere(planes, tables), "node long, g binary, leaves array<long>"), "nn-sphere")
    leaf = placed.select("node", "g", F.posexplode("leaves").alias("t", "leaf"))
    sizes = leaf.groupBy("t", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * LEAF)).alias("parts"))
    part = F.xxhash64("t", "leaf", F.pmod(F.xxhash64("node"), F.col("parts")))
    met = leaf.join(sizes, ["t", "leaf"]).select(part.alias("at"), "node", "g")
    found = durable(met.repartition("at").sortWithinPartitions("at").mapInArrow(_leaves(k if tables == 1 else k // 2, slices), PACKED), "nn-leaves")
    own = durable(placed.select("node", "g").mapInArrow(_packed(slices, 0), PACKED), "nn-directions")
    graph = _kept(_joined(_merged(k), slices, own, found), "nn-graph")
    for turn in itertools.count():  # edges only get nearer, so rounds end
        members = _kept(_joined(_members(turn), slices, graph.mapInArrow(_steps(_sides(k, slices)), PACKED)), "nn-meetings")
        answers = _joined(_answers(k), slices, graph, members.mapInArrow(_steps(_requests(slices)), PACKED))
        found = _joined(_meetings(slices), slices, answers, members)
        graph = _kept(_joined(_merged(k), slices, graph, found), "nn-graph")
        if (graph.agg(F.sum("size")).first()[0] or 0) <= ENOUGH * k * n:
            break
    return _kept(graph.select("p").mapInArrow(_edge_rows(k), "u long, v long, s float"), "nn-edges")


def _slices(n: int, d: int, most: int) -> int:
    """Slices of nodes: of ``most`` nodes and ``SLICE_BYTES`` at most, as hashes fall, and enough for tasks."""
    return max(SLICES, -(-n // most), -(-n * d * 8 // SLICE_BYTES))


def _scores(asked: pd.DataFrame | dict, vectors: pd.DataFrame | dict) -> pd.DataFrame:
    """Inner products of queries with the nodes of one slice, from the score ``least`` on (null: all): asked has ``q``, ``x``, ``least`` and the array ``nodes``."""
    if not len(asked["q"]) or not len(vectors["node"]):
        return pd.DataFrame({"q": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "s": pd.Series(dtype="float64")})
    ids, q, least = np.asarray(vectors["node"]), np.asarray(asked["q"]), np.asarray(asked["least"], dtype=np.float64)
    x, y = (side["x"] if isinstance(side["x"], np.ndarray) else np.stack(list(side["x"])) for side in (vectors, asked))
    order = np.argsort(ids) if (ids[1:] < ids[:-1]).any() else slice(None)
    ids, x = ids[order], x[order]
    nodes, who = np.concatenate(list(asked["nodes"])), np.repeat(np.arange(len(q)), [len(v) for v in asked["nodes"]])
    at = np.searchsorted(ids, nodes)
    if 20 * len(nodes) > len(q) * len(ids):  # most of the block is asked for
        s = (y @ x.T)[who, at]
    else:
        s = np.concatenate([np.einsum("ij,ij->i", x[at[a : a + 65536]], y[who[a : a + 65536]]) for a in range(0, len(at), 65536)] or [np.zeros(0)])
    keep = ~(s < least[who])  # null is NaN here, which nothing is below
    return pd.DataFrame({"q": q[who[keep]], "v": nodes[keep], "s": s[keep]})


def _starts(nodes: DataFrame, beam: int) -> DataFrame:
    """Start nodes of every query (``v``): the longest vectors and as many others, a beam of each."""
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    longest = nodes.select(F.col("node").alias("v")).orderBy(norm.desc(), "v").limit(beam)
    return longest.union(nodes.select(F.col("node").alias("v")).orderBy(F.xxhash64(F.lit(SEED), "v"), "v").limit(beam)).distinct()


def _room(asked: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """The start nodes of one block that are not behind the last of a query's beam: asked has ``q``, ``x`` and ``last``, null for a beam with room."""
    if not len(asked) or not len(starts):
        return pd.DataFrame({"q": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
    s = np.stack(asked["x"].to_numpy()) @ np.stack(starts["x"].to_numpy()).T
    i, j = np.nonzero(~(s < asked["last"].to_numpy(dtype=np.float64)[:, None]))  # null is NaN here, which nothing is behind
    return pd.DataFrame({"q": asked["q"].to_numpy()[i], "v": starts["v"].to_numpy()[j]})


def _entering(vectors: DataFrame, last: DataFrame, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The start nodes (``q``, ``v``) that can enter each query's beam, given the score of the ``last`` in it; a query without one takes all.

    Queries and start nodes meet block by block; neither is whole in a task.
    """
    starts = durable(starts.join(nodes, F.col("v") == F.col("node")).select("v", "x"), "nn-starts")
    blocks = [F.lit(max(1, -(-side.count() // BLOCK))).cast("long") for side in (vectors, starts)]
    block = lambda c, n: F.pmod(F.xxhash64(F.lit(SEED), c), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asked = vectors.join(last, "q", "left").select("q", "x", "last", block("q", blocks[0]).alias("a"), every(blocks[1]).alias("b"))
    starts = starts.select("v", "x", block("v", blocks[1]).alias("b"), every(blocks[0]).alias("a"))
    return asked.groupBy("a", "b").cogroup(starts.groupBy("a", "b")).applyInPandas(_room, "q long, v long")


def _exact(names: np.ndarray, asked: np.ndarray, k: int):
    """Of each sampled query the scores of its ``k`` nearest other nodes in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(names), 0), -np.inf)
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                s = asked @ _matrix(part.column(1)).T
                s[names[:, None] == part.column(0).to_numpy()[None, :]] = -np.inf
                best = np.concatenate([best, s], axis=1)
                if best.shape[1] > k:
                    best = np.partition(best, -k, axis=1)[:, -k:]
        q, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(best[q, at])], ["q", "s"])

    return run


def _bars(sampled: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The sampled queries with the number of their ``k`` nearest (``want``) and the least score of these (``bar``), by brute force."""
    sample = sampled.collect()
    names, asked = np.array([r["q"] for r in sample], dtype=np.int64), np.array([r["x"] for r in sample], dtype=np.float64)
    exact = nodes.select("node", "x").mapInArrow(_exact(names, asked, k), "q long, s double") if sample else sampled.selectExpr("q", "0D AS s").limit(0)
    exact = exact.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("_r") <= k)
    return durable(exact.groupBy("q").agg(F.count(F.lit(1)).alias("want"), F.min("s").alias("bar")), "nn-bars")


def _recall(beams: DataFrame, bars: DataFrame) -> float:
    """Mean share of their nearest that the sampled queries have in their beams; 1 without any."""
    near = beams.where("q <> v").join(F.broadcast(bars), "q").where(F.col("s") >= F.col("bar") - 1e-9 * F.abs("bar"))
    found = near.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.coalesce("n", F.lit(0)), F.col("want")) / F.col("want")
    return bars.join(found, "q", "left").agg(F.coalesce(F.avg(share), F.lit(1.0))).first()[0]


def _ways(slices: int):
    """Edges by the slice of either end: along them (kind 1) and back (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch.column(i).to_numpy() for i in (0, 1))
            for kind, here, there in ((1, u, v), (2, v, u)):
                yield from _batch((to, kind, len(c[0]), c) for to, c in _shares(_dealt(here, slices), here, there))

    return run


def _adjacency(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
    """One slice of the search's graph (kind 0): nodes, where the ends of each begin, and the ends, of reverse edges ``REVERSE`` at most."""
    rows = list(rows)
    own, back = (_columns([row for row in rows if row[0] == kind], np.int64, np.int64) for kind in (1, 2))
    order = np.lexsort((np.random.default_rng([SEED, at]).random(len(back[0])), back[0]))
    back = [x[order] for x in back]
    some = _place_in_group(back[0]) < REVERSE
    here, there = (np.concatenate([x, y[some]]) for x, y in zip(own, back, strict=True))
    order = np.lexsort((there, here))
    here, there = here[order], there[order]
    one = np.concatenate([[True], (here[1:] != here[:-1]) | (there[1:] != there[:-1])]) if len(here) else np.zeros(0, bool)
    here, there = here[one], there[one]
    node, first = np.unique(here, return_index=True)
    yield at, 0, len(there), [node, np.append(first, len(here)).astype(np.int64), there]


def _vectors(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
    """One slice of the nodes (kind 1): identifiers in order, and vectors."""
    node, x = _columns(rows, np.int64, np.float64)
    order = np.argsort(node)
    yield at, 1, len(node), [node[order], x.reshape(len(node), -1)[order]]


def _first_beams(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
    """The beams of one block: queries, their vectors, entries of each, and of the entries node, score and whether it is expanded; at first the query itself."""
    q, x = _columns(rows, np.int64, np.float64)
    x = x.reshape(len(q), -1)
    yield at, 0, len(q), [q, x, np.ones(len(q), np.int64), q, np.einsum("ij,ij->i", x, x), np.zeros(len(q), bool)]


class _Beams:
    """The beams of one block of queries, best first; ``who`` and ``r`` are an entry's query and place."""

    def __init__(self, p: list[bytes]):
        self.q, self.count, self.v, self.s, self.done = (np.frombuffer(p[i], t) for i, t in ((0, np.int64), (2, np.int64), (3, np.int64), (4, np.float64), (5, bool)))
        self.x = np.frombuffer(p[1], np.float64).reshape(len(self.q), -1)
        self.who = np.repeat(np.arange(len(self.q)), self.count)
        self.r = _place_in_group(self.who)

    def front(self, beam: int) -> np.ndarray:
        """The entries to expand: the best of the beam that are not expanded yet."""
        at = np.nonzero((self.r < beam) & ~self.done)[0]
        return at[_place_in_group(self.who[at]) < AT_ONCE]

    def score_at(self, r: int) -> np.ndarray:
        """The score at a place of each query's entries; NaN where there are fewer."""
        out = np.full(len(self.q), np.nan)
        at = self.r == r
        out[self.who[at]] = self.s[at]
        return out


def _fronts(beam: int, slices: int):
    """The nodes to expand, by slice."""

    def step(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
        for _, p in rows:
            beams = _Beams(p)
            front = beams.front(beam)
            v, who = beams.v[front], beams.who[front].astype(np.int16)
            yield from ((to, 2, len(c[0]), [np.array([at]), *c]) for to, c in _shares(_dealt(v, slices), who, v))

    return step


def _expanded(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
    """The ends of the edges at one slice's nodes, for the blocks that ask."""
    node = first = near = np.zeros(0, np.int64)
    for kind, p in rows:
        if kind == 0:
            node, first, near = (np.frombuffer(x, np.int64) for x in p)
            continue
        who, v = (np.frombuffer(x, t) for x, t in zip(p[1:], (np.int16, np.int64), strict=True))
        if not len(node):
            continue
        i = np.minimum(np.searchsorted(node, v), len(node) - 1)
        here = node[i] == v  # others have no edges
        i, who = i[here], who[here]
        count = first[i + 1] - first[i]
        ends = np.arange(count.sum()) + np.repeat(first[i] - np.cumsum(count) + count, count)
        yield int(np.frombuffer(p[0], np.int64)[0]), 1, len(ends), [np.repeat(who, count), near[ends]]


def _pairs(blocks: int):
    """Queries and nodes by block (kind 2), the queries by identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, v = (batch.column(i).to_numpy() for i in (0, 1))
            yield from _batch((to, 2, len(c[0]), c) for to, c in _shares(_dealt(q, blocks), q, v))

    return run


def _news(kept: int, slices: int):
    """The nodes that one block's queries have not kept, by slice, with what is needed to score them."""

    def step(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
        beams, rows = _Beams(next(rows)[1]), list(rows)
        who, v = _columns([row for row in rows if row[0] == 1], np.int16, np.int64)
        q, start = _columns([row for row in rows if row[0] == 2], np.int64, np.int64)
        order = np.argsort(beams.q)
        who, v = np.concatenate([who, order[np.searchsorted(beams.q[order], q)]]), np.concatenate([v, start])
        new = _distinct(_pair(np.concatenate([beams.who, who]), np.concatenate([beams.v, v]), len(beams.q)), len(beams.v)) - len(beams.v)
        who, v, least = who[new], v[new], beams.score_at(kept - 1)  # by query
        for to, (i, nodes) in _shares(_dealt(v, slices), who, v):
            asking, count = np.unique(i, return_counts=True)
            yield to, 2, len(nodes), [np.array([at]), asking, beams.x[asking], least[asking], count, nodes]

    return step


def _scored(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
    """Scores with one slice's nodes, for the blocks that ask."""
    node = x = None
    for kind, p in rows:
        if kind == 1:
            node, x = np.frombuffer(p[0], np.int64), np.frombuffer(p[1], np.float64)
            x = x.reshape(len(node), -1)
            continue
        block, q, y, least, count, nodes = (np.frombuffer(a, t) for a, t in zip(p, (np.int64, np.int64, np.float64, np.float64, np.int64, np.int64), strict=True))
        asked = {"q": q, "x": y.reshape(len(q), -1), "least": least, "nodes": np.split(nodes, np.cumsum(count)[:-1])}
        found = _scores(asked, {"node": node, "x": x})
        yield int(block[0]), 1, len(found), [found[c].to_numpy() for c in ("q", "v", "s")]


def _settling(beam: int, kept: int):
    """The ``kept`` best of what one block's queries had and what is new; those that were to be expanded are."""

    def step(at: int, rows: Iterator[tuple[int, list[bytes]]]) -> Iterator[Row]:
        stored = next(rows)[1]
        beams = _Beams(stored)
        done = beams.done.copy()
        done[beams.front(beam)] = True
        who, v, s = _columns(rows, np.int64, np.int64, np.float64)
        who, v, s = (np.concatenate(c) for c in ((beams.who, who), (beams.v, v), (beams.s, s)))
        done = np.concatenate([done, np.zeros(len(v) - len(done), bool)])
        order = np.lexsort((v, -s, who))
        order = order[_place_in_group(who[order]) < kept]
        who = who[order]
        state = [beams.q, beams.x, np.bincount(who, minlength=len(beams.q)), v[order], s[order], done[order]]
        left = (_place_in_group(who) < beam) & ~state[5]
        yield at, 0, int(left.sum()), state

    return step


def _lasts(beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for beams in (_Beams(p) for batch in batches for p in batch.column(0).to_pylist()):
            last = beams.score_at(beam - 1)
            yield pa.RecordBatch.from_arrays([pa.array(beams.q), pa.array(last, mask=np.isnan(last))], ["q", "last"])

    return run


def _best(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for beams in (_Beams(p) for batch in batches for p in batch.column(0).to_pylist()):
            at = beams.r < most
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (beams.q[beams.who[at]], beams.v[at], beams.s[at])], ["q", "v", "s"])

    return run


def _settled(vectors: DataFrame, nodes: DataFrame, around: DataFrame, slices: int, beam: int, kept: int, seen: DataFrame | None = None) -> DataFrame:
    """What greedy search sees, the ``kept`` best of each query in ``vectors``, when their beams no longer change: see :func:`_first_beams`.

    ``around`` has the graph and the nodes by slice.  With ``seen``, what narrower beams have settled on, the search goes on from there.
    """
    blocks = max(1, -(-vectors.count() // ASKING))
    edges, stored = around.where("kind = 0"), around.where("kind = 1")
    last = lambda seen: seen.select("p").mapInArrow(_lasts(beam), "q long, last double")
    entered = lambda seen: durable(_entering(vectors, last(seen), _starts(nodes, beam), nodes).mapInArrow(_pairs(blocks), PACKED), "nn-entering")
    tried, entering = seen is not None, None
    if seen is None:
        asking = durable(vectors.select("q", "x").mapInArrow(_packed(blocks, 1), PACKED), "nn-asking")
        seen = _kept(_joined(_first_beams, blocks, asking), "nn-beams")
    else:
        entering = entered(seen)
    while True:
        found = _joined(_expanded, slices, edges, seen.mapInArrow(_steps(_fronts(beam, slices)), PACKED))
        new = _joined(_news(kept, slices), blocks, seen, found, *([] if entering is None else [entering]))
        seen, entering = _kept(_joined(_settling(beam, kept), blocks, seen, _joined(_scored, slices, stored, new)), "nn-beams"), None
        if not tried:
            entering, tried = entered(seen), True
        elif not seen.agg(F.sum("size")).first()[0]:
            return seen


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 20, beam: int | None = None) -> DataFrame:
    """The ``k`` nearest nodes found (``q``, ``v``, ``s``) of each query node in the column ``q``, itself besides where it is as near, by greedy search.

    Beams are as wide as a sample of the queries needs to have ``TARGET`` of its ``k`` nearest.
    """
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, slices = size["n"], _slices(size["n"], size["d"] or 1, SLICE)
    beam = max(beam or BEAM, k)
    ways = durable(edges.select("u", "v").mapInArrow(_ways(slices), PACKED), "nn-ways")
    placed = durable(nodes.select("node", "x").mapInArrow(_packed(slices, 1), PACKED), "nn-placed")
    around = _kept(_joined(_adjacency, slices, ways).union(_joined(_vectors, slices, placed)), "nn-adjacency")
    vectors = durable(queries.join(nodes, F.col("q") == F.col("node")).select("q", "x"), "nn-queries")
    sampled = durable(vectors.orderBy(F.xxhash64(F.lit(SEED), "q"), "q").limit(SAMPLE), "nn-sample")
    bars = _bars(sampled, nodes, k)
    best = lambda seen: _kept_rows(seen, k + 1)
    widths, seen = [beam], _settled(sampled, nodes, around, slices, beam, 2 * beam)
    while beam < n and _recall(best(seen), bars) < TARGET:
        beam *= 2
        widths, seen = [*widths, beam], _settled(sampled, nodes, around, slices, beam, 2 * beam, seen)
    others = durable(vectors.join(F.broadcast(sampled.select("q")), "q", "left_anti"), "nn-others")
    if others.isEmpty():
        return best(seen)
    rest = None
    for width in widths:  # fewer nodes are expanded than with the widest beam at once
        rest = _settled(others, nodes, around, slices, width, 2 * beam, rest)
    return best(seen).union(best(rest))


def _kept_rows(seen: DataFrame, most: int) -> DataFrame:
    """The best entries of beams as rows."""
    return _kept(seen.select("p").mapInArrow(_best(most), "q long, v long, s double"), "nn-best")


def nearest(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest rows found of each row whose ``vec_id`` is divisible by ``every``, by largest inner product.

    Ties go to the smaller ``vec_id``; equal vectors tie.  Vectors that can take no part (see :func:`nodes_of`) neither ask nor answer.
    Null identifiers take no part.  With ``k`` or fewer candidates all are returned.  An empty table gives an empty result.
    Rows that repeat a ``vec_id`` count once.
    """
    nodes, members = nodes_of(rows.where("vec_id is not null"))
    members = members.distinct()
    asking = members.where(F.col("vec_id") % every == 0)
    edges = build_graph(nodes)
    beams = search(asking.select(F.col("node").alias("q")).distinct(), nodes, edges, k)
    # of equal vectors the k + 1 least identifiers can be among a query's k nearest
    first = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    few = members.withColumn("_r", first).where(F.col("_r") <= k + 1).select(F.col("node").alias("v"), "vec_id")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "vec_id")
    best = beams.join(few, "v").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r", "v")
    pairs = asking.select(F.col("node").alias("q"), F.col("vec_id").alias("query_id")).join(best, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))
    out = pairs.select("query_id", rank.alias("rank"), "vec_id", F.col("s").alias("score"))
    return out.where(F.col("rank") <= k)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_nearest_neighbours": op3_nearest_neighbours}

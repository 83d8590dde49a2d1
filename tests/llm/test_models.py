"""Nearest neighbours by recall, the classifier by held-out accuracy, the pipeline by what each stage must do."""

from __future__ import annotations

import glob
import hashlib
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_tables import WORD, plain_measures, plain_targets
from test_texts import plain_groups, plain_print

from quern.llm import classifier, mixing, nndescent, rules, simhash

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LABELLED = "/root/testdata/sf0.01"


def plain_nearest(ids: list[int], x: np.ndarray, every: int, k: int) -> dict[int, list[int]]:
    at = np.array(ids)
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        row = ids.index(q)
        s = x @ x[row]
        s[row] = -np.inf
        out[q] = at[np.lexsort((at, -s))][: min(k, len(ids) - 1)].tolist()
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "LEAF", 60)
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    found = nndescent.nearest(rows).collect()
    table = rows.orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in table], np.array([r["embedding"] for r in table], dtype=np.float64)
    expected = plain_nearest(ids, x, 20, 20)
    got: dict = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - x[ids.index(r["query_id"])] @ x[ids.index(r["vec_id"])]) < 1e-12
    assert set(got) == set(expected) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(expected[q])) / 20 for q in expected]) >= 0.9


def test_equal_and_unfit_vectors(spark):
    good = [(i, [1.0, float(i % 3), 0.0]) for i in range(30)]
    bad = [(40, None), (60, []), (80, [0.0, 0.0, 0.0]), (100, [1.0, None, 0.0]), (120, [float("nan"), 1.0, 0.0]), (140, [float("inf"), 1.0, 0.0]), (160, [1.0]), (None, [1.0, 1.0, 1.0])]
    rows = spark.createDataFrame([*good, *bad, good[3]], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in nndescent.nearest(rows, every=20, k=12).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == plain_nearest([i for i, _ in good], np.array([v for _, v in good]), 20, 12)
    assert nndescent.nearest(rows.limit(0)).count() == 0
    assert [r["vec_id"] for r in nndescent.nearest(rows.where("vec_id in (0, 1, 2)")).orderBy("rank").collect()] == [1, 2]


def found_share(rows: list, ids: list[int], x: np.ndarray, every: int, k: int) -> float:
    expected, got = plain_nearest(ids, x, every, k), {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len(got[q] & set(expected[q])) / k for q in expected])


def test_search_goes_on_until_enough_is_found(spark):
    """The graph is of two parts without an edge between them, so half of the nearest cannot be reached from a query's own node."""
    x = np.random.default_rng(11).normal(size=(600, 16))
    near = [[j for j in np.argsort(-(x @ x[i])).tolist() if j != i and j % 2 == i % 2][:10] for i in range(len(x))]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>")
    edges = spark.createDataFrame([(i, j, float(x[i] @ x[j])) for i in range(len(x)) for j in near[i]], "u long, v long, s float")
    beams = nndescent.search(nodes.where("node % 10 = 0").selectExpr("node AS q"), nodes, edges).where("q <> v")
    best = beams.selectExpr("q AS query_id", "v AS vec_id", "row_number() OVER (PARTITION BY q ORDER BY s DESC) AS r").where("r <= 20").collect()
    assert found_share(best, list(range(len(x))), x, 10, 20) >= 0.9


def test_start_nodes_enter_by_blocks(spark, monkeypatch):
    """Only start nodes that are not behind the last of a beam become rows, and no step of the search is a cross join."""
    plans, stored = [], nndescent.durable
    monkeypatch.setattr(nndescent, "durable", lambda df, name, *more: (plans.append(df._jdf.queryExecution().toString()), stored(df, name, *more))[1])
    monkeypatch.setattr(nndescent, "BLOCK", 16)
    x = np.random.default_rng(13).normal(size=(300, 8))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>")
    near = [[j for j in np.argsort(-(x @ v)).tolist() if j != i][:10] for i, v in enumerate(x)]
    edges = spark.createDataFrame([(i, j, float(x[i] @ x[j])) for i in range(len(x)) for j in near[i]], "u long, v long, s float")
    asking = nodes.where("node % 6 = 0").select(F.col("node").alias("q"), "x")
    last = {q: float(np.sort(x @ x[q])[-9]) for q in range(0, 300, 12)}
    entering = nndescent._entering(asking, spark.createDataFrame(list(last.items()), "q long, last double"), nodes.where("node % 5 = 0").selectExpr("node AS v"), nodes)
    got = sorted((r["q"], r["v"]) for r in entering.collect())
    assert got == [(q, v) for q in range(0, 300, 6) for v in range(0, 300, 5) if q not in last or x[v] @ x[q] >= last[q] - 1e-12]
    nndescent.search(asking.select("q"), nodes, edges)
    assert len(plans) > 4 and not [p for p in plans if "Cross" in p or "Cartesian" in p]


def test_width_of_beams_is_found_on_the_sample(spark, monkeypatch):
    """The queries that are not sampled go through the sample's widths, and keep two of the widest beams from the first."""
    widths, settled = [], nndescent._settled
    monkeypatch.setattr(nndescent, "_settled", lambda vectors, *more: (widths.append((vectors.count(), more[3], more[4])), settled(vectors, *more))[1])
    monkeypatch.setattr(nndescent, "SAMPLE", 10)
    x = np.random.default_rng(11).normal(size=(600, 16))
    near = [[j for j in np.argsort(-(x @ x[i])).tolist() if j != i and j % 2 == i % 2][:10] for i in range(len(x))]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>")
    edges = spark.createDataFrame([(i, j, float(x[i] @ x[j])) for i in range(len(x)) for j in near[i]], "u long, v long, s float")
    beams = nndescent.search(nodes.where("node % 10 = 0").selectExpr("node AS q"), nodes, edges, beam=20).where("q <> v")
    best = beams.selectExpr("q AS query_id", "v AS vec_id", "row_number() OVER (PARTITION BY q ORDER BY s DESC) AS r").where("r <= 20").collect()
    steps = [20 * 2**i for i in range(len(widths) // 2)]
    assert widths == [(10, b, 2 * b) for b in steps] + [(50, b, 2 * steps[-1]) for b in steps]
    assert found_share(best, list(range(len(x))), x, 10, 20) >= 0.9


def test_search_stores_arrays_not_rows(spark, monkeypatch):
    """What the search goes through for each query is in arrays: no table that it stores has more rows than there are nodes."""
    stored, durable = {}, nndescent.durable

    def counted(df, name, *more):
        out = durable(df, name, *more)
        stored.setdefault(name, []).append(out.count())
        return out

    x = np.random.default_rng(14).normal(size=(1000, 16))
    near = [[j for j in np.argsort(-(x @ v)).tolist() if j != i][:10] for i, v in enumerate(x)]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>")
    edges = spark.createDataFrame([(i, j, float(x[i] @ x[j])) for i in range(len(x)) for j in near[i]], "u long, v long, s float")
    monkeypatch.setattr(nndescent, "durable", counted)
    beams = nndescent.search(nodes.where("node % 5 = 0").selectExpr("node AS q"), nodes, edges)
    stored.pop("nn-best", None)  # the result
    assert len(stored) > 5 and max(map(max, stored.values())) <= len(x)
    best = beams.where("q <> v").selectExpr("q AS query_id", "v AS vec_id", "row_number() OVER (PARTITION BY q ORDER BY s DESC) AS r").where("r <= 20").collect()
    assert found_share(best, list(range(len(x))), x, 5, 20) >= 0.9


def test_leaves_and_dealing():
    """A leaf gives each member its nearest, in parts by the slice of the first end, and equal pairs count once."""
    rng = np.random.default_rng(15)
    g = rng.normal(size=(1300, 8)).astype(np.float32)
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    node = rng.permutation(1300).astype(np.int64)
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(1300, np.int64)), pa.array(node), pa.array([r.tobytes() for r in g], pa.binary())], ["at", "node", "g"])
    edges: dict = {}
    for at, _, _, p in (row for batch in nndescent._leaves(10, 4)([rows.slice(0, 700), rows.slice(700)]) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
        u, v = (np.frombuffer(x, np.int64) for x in p[:2])
        assert (nndescent._dealt(u, 4) == at).all()
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            edges.setdefault(a, set()).add(b)
    s = g @ g.T
    np.fill_diagonal(s, -9.0)
    near = {int(node[i]): set(node[np.argsort(-s[i])[:10]].tolist()) for i in range(len(node))}
    assert all(near[i] <= edges[i] for i in near) and sum(map(len, edges.values())) < 1.3 * 10 * len(node)
    at = nndescent._distinct(nndescent._pair(np.array([1, 0, 1, 1, 2]), np.array([5, 5, 5, -5, 7]), 3), known=1)
    assert sorted(at.tolist()) == [1, 3, 4]


def test_scores_below_the_least_are_left_out():
    asked = pd.DataFrame({"q": [1, 2], "x": [np.array([1.0, 0.0]), np.array([0.0, 1.0])], "least": [0.5, None], "nodes": [np.array([7, 8, 9]), np.array([7, 9])]})
    vectors = pd.DataFrame({"node": [9, 7, 8], "x": [np.array([0.5, 2.0]), np.array([0.4, 1.0]), np.array([3.0, 3.0])]})
    assert nndescent._scores(asked, vectors).values.tolist() == [[1, 8, 3.0], [1, 9, 0.5], [2, 7, 1.0], [2, 9, 2.0]]


def test_recall_of_unequal_norms(spark, monkeypatch):
    """Norms from 0.5 to 1.5, and one vector that is far longer than all."""
    monkeypatch.setattr(nndescent, "LEAF", 200)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 64))
    x *= (rng.uniform(0.5, 1.5, len(x)) / np.linalg.norm(x, axis=1))[:, None]
    x[77] *= 50 / np.linalg.norm(x[77])
    x = x.astype(np.float32).astype(np.float64)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert found_share(nndescent.nearest(rows).collect(), list(range(len(x))), x, 20, 20) >= 0.9


def test_classifier(spark):
    docs = spark.read.parquet(f"{LABELLED}/documents.parquet").select("doc_id", "text")
    model = classifier.quality_model(spark, LABELLED)
    out = classifier.score(docs, model)
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet").select("doc_id", "quality")
    rows = out.join(labels, "doc_id").where(classifier.remainder(out["doc_id"], 4) == 2).collect()
    assert len(rows) > 50
    assert np.mean([(r["score"] >= classifier.THRESHOLD) == (r["quality"] == 1) for r in rows]) >= 0.95
    high, low = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in high for b in low]) >= 0.95


def test_classifier_of_awkward_texts(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 60)] + [(61, 7), (62, None), (None, 1)], "doc_id long, label int")
    model = classifier.fit(docs, labels)
    got = classifier.score(docs.select("doc_id", "text", "lang"), model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if not (r["text"] or "").split())
    with pytest.raises(ValueError):
        classifier.score(docs, model)
    assert classifier.score(none.select("doc_id", "text"), model).count() == 0
    assert {r["score"] for r in classifier.score(docs.where("doc_id = 5").select("doc_id", "text"), classifier.fit(none, labels)).collect()} == {0.5}


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "mixing", "sentencepiece"]
    kept = pipeline.by_quality(spark, docs, SMALL).persist()
    model = classifier.quality_model(spark, SMALL, docs)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in classifier.score(docs, model).where("score >= 0.7").collect()}
    good = pipeline.by_rules(spark, kept, SMALL).persist()
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in rules.judge(rules.measures(kept)).where("kept").collect()}
    single = pipeline.by_fingerprint(spark, good, SMALL).persist()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["component_id"] for r in simhash.near_duplicates(good).collect()})
    mixed = pipeline.by_mixture(spark, single, SMALL).persist()
    assert mixed.selectExpr("sum(size(filter(split(text, '[ \t\n\x0b\f\r]+'), x -> x <> '')))").first()[0] == mixing.mix(single).selectExpr("sum(taken)").first()[0]
    assert all(d.columns == pipeline.COLUMNS for d in (kept, good, single, mixed))
    last = pipeline.to_pieces(spark, mixed, SMALL)
    assert last.columns == ["doc_id", "source", "ids"] and last.count() == mixed.count()


def plain_score(model: classifier.Model, text: str | None) -> float:
    """Votes of the nearest labelled vectors, one cosine at a time."""
    x = classifier.Terms().counts((text or "").encode())
    if not x.any():
        return 0.0
    v = (x.astype(np.float64) - model.mean) @ model.axes.astype(np.float64)
    near = sorted(((float(v @ w) / max(float(np.linalg.norm(v)), 1e-9), float(y)) for w, y in zip(model.vectors.astype(np.float64), model.labels)), reverse=True)
    weights = [(max(c, 1e-6) ** 4, y) for c, y in near[: classifier.NEIGHBOURS]]
    return sum(w * y for w, y in weights) / sum(w for w, _ in weights)


def test_votes_one_by_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = classifier.quality_model(spark, SMALL)
    for r in classifier.score(docs, model).collect():
        assert abs(r["score"] - plain_score(model, r["text"])) < 1e-3, r["doc_id"]


def plain_kept(text: str | None) -> bool:
    n, chars, symbols, repeated, covered = plain_measures(text)
    words = WORD.findall(text or "")
    lines = sum(1 for x in (text or "").split("\n") if WORD.search(x))
    stops = sum(w.lower() in rules.STOP_WORDS for w in words)
    if n < 50 or 100 * covered > 50 * n:
        return False
    return 2.5 <= chars / n <= 15 and symbols / n <= 0.3 and stops >= 2 and stops / n >= 0.02 and repeated / lines <= 0.5


def plain_mix(docs: list) -> list:
    """Documents as often as the mix takes them: whole rounds of a source, and those of its least hashes for what is left of its target."""
    size = lambda d: len(WORD.findall(d["text"] or ""))
    total = Counter()
    for d in docs:
        total[d["source"]] += size(d)
    out = []
    for source, target in plain_targets(dict(total)).items():
        own = sorted((int(hashlib.md5(str(d["doc_id"]).encode()).hexdigest()[:15], 16), size(d), i) for i, d in enumerate(docs) if d["source"] == source)
        whole = math.floor(target / total[source]) if total[source] else 0
        left, run, last = target - whole * total[source], 0, -1
        for at, (_, w, _) in enumerate(own):
            if run < left or run == 0:
                last, before = at, run
            run += w
        part = {own[j][2] for j in range(last + (2 * (left - before) >= own[last][1]))}
        for _, _, i in own:
            out += [docs[i]] * min(3, whole + (i in part))
    return out


def test_pipeline_against_plain_stages(spark):
    """run()'s rows against one plain version of each of the five stages."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert docs.select("doc_id").distinct().count() == docs.count()
    model = classifier.quality_model(spark, SMALL, docs)
    rows = [d for d in docs.collect() if plain_score(model, d["text"]) >= classifier.THRESHOLD]
    rows = [d for d in rows if plain_kept(d["text"])]
    label = plain_groups([plain_print(d["text"]) for d in rows])
    least: dict = {}
    for d, g in zip(rows, label, strict=True):
        if g not in least or d["doc_id"] < least[g]["doc_id"]:
            least[g] = d
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = Counter((d["doc_id"], d["source"], tuple(sp.encode(d["text"] or ""))) for d in plain_mix(list(least.values())))
    got = Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in pipeline.run(spark, SMALL).collect())
    assert len(expected) > 20 and got == expected


def test_stages_of_nothing(spark):
    """Empty documents go through every stage, and columns of other names are left behind."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("root", F.lit(1)).limit(0)
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        assert out.count() == 0 and (i == len(pipeline.STAGES) - 1 or out.columns == pipeline.COLUMNS)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    con = duckdb.connect()
    assert con.execute("SELECT 1").fetchall() and glob.glob(f"{SMALL}/*.parquet")

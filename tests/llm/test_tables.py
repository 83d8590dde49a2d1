"""Sharding, mixing and rules against plain versions."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

from quern.llm import mixing, rules, sharding

WORD = re.compile("[^\x20\x09-\x0D]+")


def test_shards(docs):
    rows = sharding.shard_texts(docs, n_shards=5).collect()
    given = docs.select("doc_id", "text").collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d["doc_id"], len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in given
    )
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)
    assert all(abs(sizes[i] - sum(sizes.values()) / 5) <= largest for i in range(5))


def test_shards_of_one_large_group(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) as text")
    out = sharding.shard_texts(rows, n_shards=8).collect()
    sizes, slots = Counter(), defaultdict(set)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].add(r["slot"])
    assert max(sizes.values()) - min(sizes.values()) <= 60
    assert all(s == set(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 6000


def test_shards_of_nothing(none):
    assert sharding.shard_texts(none).count() == 0


def plain_targets(sizes: dict, epochs: int = 3) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, capped, left = {}, {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        rest = left - sum(capped.values())
        target = capped | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > epochs * sizes[s]]
        if not over:
            return target
        capped |= {s: float(epochs * sizes[s]) for s in over}


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    given = Counter((d["doc_id"], len(WORD.findall(d["text"] or ""))) for d in docs.collect())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == given
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"] and r["source_size"] is not None
    target = plain_targets(dict(sizes))
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 3 * most[s] for s in sizes)
    assert rows and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert sum(r["size"] for r in rows) and mixing.mixed(docs).columns == docs.columns


def test_caps_are_reshared(spark):
    rows = spark.createDataFrame([(1, "a", "w " * 10), (2, "b", "w " * 1000), (3, "c", "w"), (4, "d", "")], "doc_id long, source string, text string")
    got = {r["source"]: r["target"] for r in mixing.mix(rows).collect()}
    expected = plain_targets({"a": 10, "b": 1000, "c": 1, "d": 0})
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in expected)


def test_mix_of_nothing(none):
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def plain_measures(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    n, covered, seen, repeated = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), repeated, len(covered)


def test_rules(docs, none):
    rows = rules.judge(rules.measures(docs)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == Counter(
        (d["doc_id"], *plain_measures(d["text"])) for d in docs.collect()
    )
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert rules.keep(docs).columns == docs.columns and rules.measures(none).count() == 0


def test_rules_of_very_long_texts(spark):
    text = " ".join(f"w{i % 40000}" for i in range(70000))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rules.measures(rows).first()["n_repeat_words"] == plain_measures(text)[4]


def test_rules_where_hashes_clash(spark, monkeypatch):
    """Windows whose hashes are all equal are still told apart by their words."""
    texts = ["a b c d e f a b c x b c d", "a b a b a b a b", "one two three four", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(rules.F, "xxhash64", lambda *_: rules.F.lit(7).cast("long"))
    assert {r["doc_id"]: r["n_repeat_words"] for r in rules.measures(rows).collect()} == {i: plain_measures(t)[4] for i, t in enumerate(texts)}


def test_rules_equal_sql(spark):
    """Every column, the verdict too, against the query's SQL."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    theirs = con.execute(rules.ORACLES["op7_quality_rules"])
    names = [d[0] for d in theirs.description]
    ours = rules.op7_quality_rules(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, ours), key=repr) == sorted(theirs.fetchall(), key=repr)

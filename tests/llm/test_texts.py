"""Near-duplicates, main text, tokens, pieces and language model against plain versions and the public libraries."""

from __future__ import annotations

import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import katz, pieces, simhash, sstable, tagpaths

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_print(text: str | None) -> int:
    w = (text or "").translate(LOWER).encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_groups(prints: list[int]) -> list[int]:
    x = np.array(prints, dtype=np.uint64)
    near, label = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, np.arange(len(x))
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_near_duplicates(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    given = docs.collect()
    prints = [plain_print(d["text"]) for d in given]
    label = plain_groups(prints)
    least = defaultdict(lambda: None)
    for d, g in zip(given, label, strict=True):
        if d["doc_id"] is not None and (least[g] is None or d["doc_id"] < least[g]):
            least[g] = d["doc_id"]
    expected = Counter((d["doc_id"], f"{p:016x}", least[g]) for d, p, g in zip(given, prints, label, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == expected
    assert simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_group(spark):
    """Groups are known by their rows, also where identifiers are null or shared."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = spark.createDataFrame([(None, a), (None, b), (5, b), (7, b), (9, c), (9, c.upper()), (9, c)], "doc_id long, text string")
    got = [(r["doc_id"], r["text"].lower()) for r in simhash.keep_one(rows).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (5, b), (9, c)], key=str)
    rows = spark.createDataFrame([(1, a), (None, a), (None, b), (None, b), (3, c), (3, c), (3, a + " more")], "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(rows).collect()]
    near = (plain_print(a) ^ plain_print(a + " more")).bit_count() <= 3
    assert sorted(got, key=str) == sorted([(1, a), (None, b), (3, c)] + ([] if near else [(3, a + " more")]), key=str)
    assert simhash.keep_one(rows.limit(0)).count() == 0 and simhash.keep_one(rows.withColumn("root", F.lit(1))).columns == ["doc_id", "text", "root"]
    plan = simhash.keep_one(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("== Physical Plan ==")[1]


def test_chains_of_links(spark, monkeypatch):
    """Fingerprints at random small distances, also where buckets are cut into tiles and where five blocks are used."""
    rng = np.random.default_rng(3)
    x = [0, 7, 2**64 - 1]
    for _ in range(400):
        y = int(x[rng.integers(len(x))])
        for b in rng.integers(0, 64, size=rng.integers(1, 6)).tolist():
            y ^= 1 << b
        x.append(y)
    x = sorted(set(x))
    label = plain_groups(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in x]
    rows = spark.createDataFrame([(v,) for v in signed], "fp long").withColumn("pivots", simhash.pivot_distances(F.col("fp")))
    expected = defaultdict(set)
    for v, g in zip(signed, label, strict=True):
        expected[g].add(v)
    for part, few in ((2048, 1 << 22), (20, 1 << 22), (2048, 1)):
        monkeypatch.setattr(simhash, "PART", part)
        monkeypatch.setattr(simhash, "FEW", few)
        found = defaultdict(set)
        for r in simhash.connected_components(simhash.linked(rows)).collect():
            found[r["root"]].add(r["node"])
        assert sorted(map(sorted, found.values())) == sorted(sorted(s) for s in expected.values() if len(s) > 1)


PAGES = {
    "": "",
    "plain &amp; text": "plain & text",
    "<header><h1>Site</h1></header><div class='content'><h2>Title here</h2><p>First para, with text. And more to read.</p><ul><li>item one<li>item two</ul>"
    "<table><tr><td>a<td>b</table><p>Second&nbsp;para <a href=x>link</a>, more.</div><div id=sidebar><p>Side text</p></div>"
    "<div class='comments'><p>great post, thanks a lot!</p></div><form><p>Mail</p></form><footer>c</footer>": (
        "Title here First para, with text. And more to read. item one item two a b Second para link, more."
    ),
    "<body><nav>a b c</nav><article><header><h1>Head</h1></header><p>Short.</p><blockquote>quote</blockquote><aside>no</aside><div class='share-buttons'>x</div>"
    "<section class='comments'>c</section></article><div role=alert>notice</div>": "Head Short. quote",
    "<p>a<b>c<script>if(a<b)x</script>d <!-- x --> e < f": "acd e < f",
    "<article><p>x</p><div style='display: none'>y</div><p hidden>z</p></article>": "x",
    "<" * 2000: "<" * 2000,
    # names that say what an element has beside it, headings and paragraphs of an article, and formulas are content
    "<div class='content has-sidebar'><h1>Head</h1><p>real article</p></div>": "Head real article",
    "<article><h2 id='share-prices'>Share prices</h2><p class='notice'>They fell, again.</p><math><mi>x</mi></math></article>": "Share prices They fell, again. x",
    "<div id='page-wrap' class='page-banner with-nav'><h1>Head</h1><p>All the text, here.</p></div><div class='cookie-note'>We use cookies</div>": "Head All the text, here.",
    "<div class='comments'><main><p>The text.</p></main></div><div class='comments'><article><p>nice!</p></article></div>": "The text.",
    "<form id='page'><nav>a b</nav><h1>Head</h1><p>The page is a form, as some are.</p><fieldset><p>Mail</p></fieldset></form>": "Head The page is a form, as some are.",
    "<p>before</p><!-- never closed <p>after</p>": "before",
    "<p>a</p><!-- open": "a",
    "<div role=main><p>t</p></div><div role=complementary><p>s</p></div>": "t",
    "<table><tr><td><p>a<table><tr><td>b</table><td>c</table>": "a b c",
}


def test_main_text(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([*PAGES, None])], "page_id int, html string")
    got = tagpaths.extract(rows).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [*PAGES.values(), ""]
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got]
    assert tagpaths.extract(rows.limit(0)).count() == 0
    more = tagpaths.extract(rows.selectExpr("page_id", "html", "1 AS text", "2 AS page", "3 AS whole", "4 AS row"))
    assert more.columns == ["page_id", "html", "page", "whole", "row", "text", "n_chars"] and more.count() == rows.count()


class PlainPage(HTMLParser):
    """Blocks of a page without broken markup, by the standard library's parser."""

    def __init__(self, page: str):
        super().__init__()
        self.stack, self.blocks, self.text, self.linked, self.link = [], [], "", 0, False
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join(self.text.split())
        if text and not any(t in tagpaths.NEVER or t in tagpaths.RAW or (t == "header" and "article" not in [x for x, _ in self.stack[:i]]) for i, (t, _) in enumerate(self.stack)):
            depth = next((i + 1 for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] not in tagpaths.INNER), 0)
            self.blocks.append((tuple(self.stack), tuple(self.stack[:depth]), text, max(0, len(text) - self.linked)))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        elif tag in ("br", "hr"):
            self.text += " "
        elif tag in tagpaths.BLOCK or tag in tagpaths.RAW:
            if "p" in [x for x, _ in self.stack] and tag in tagpaths.BLOCK:
                self.handle_endtag("p")
            self.flush()
            self.stack.append((tag, dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        elif tag in [x for x, _ in self.stack]:
            self.flush()
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.text += data
        self.linked += len(data) if self.link else 0

    def main_text(self) -> str:
        whole = sum(b[3] for b in self.blocks) or 1
        inside = lambda b: any(t == "article" for t, _ in b[0])
        factor = lambda b: math.prod(0.0005 for t, c in b[0] if c == "ad" or t == "form")

        def ratio(of: list) -> float:
            chars = sum(b[3] for b in of)
            return chars / len(of) * math.sqrt(1 + sum(len(re.findall("[.,;:!?¿¡…。、，！？；：]", b[2])) for b in of) / len(of)) * chars / whole

        score = {}
        for b in self.blocks:
            own = [x for x in self.blocks if x[0] == b[0]]
            box = [x for x in self.blocks if ((inside(x) and inside(b)) or (x[1] == b[1] and inside(x) == inside(b))) and factor(x) == factor(b)]
            score[b[0]] = (ratio(own) + ratio(box)) / 2 * (25 if inside(b) else 1) * factor(b)
            if factor(b) < 1 and 2 * sum(x[3] for x in box) < whole:
                score[b[0]] = -1
        return " ".join(b[2] for b in self.blocks if 0 <= score[b[0]] >= max(score.values()) * 0.02)


def test_main_text_of_all_pages(spark):
    """Against plain sums over the blocks of another parser, for whole pages."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in tagpaths.extract(pages).collect():
        assert r["text"] == PlainPage(r["html"] or "").main_text(), r["page_id"]


def test_main_text_takes_time_in_proportion():
    heads = "".join(f"<h2 id='h{i}' class='c{i}'>Head {i}</h2><p>Text of {i}, yes.</p>" for i in range(5000))
    deep = ["<div>" * 20000 + "x", "<div>x" * 20000, "<li>a" * 20000, "<p>x</p></section>" * 20000, "<a " * 50000, '<a "' * 5000 + ">"]
    began = time.process_time()
    for page in [f"<article>{heads}</article>", *deep]:
        tagpaths.Scanner(page).row()
    assert time.process_time() - began < 20


def test_token_shards(spark, docs, none, tmp_path):
    tok = Tokenizer.from_file(WORDS)
    folder = f"file://{tmp_path}/a"
    manifest = sstable.write_shards(docs.repartition(3), folder, WORDS)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in sstable.read_shards(manifest, folder).collect())
    given = sorted(docs.collect(), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0))
    at, expected = 0, []
    for d in given:
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        expected.append((at, d["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert got == expected
    asked = spark.createDataFrame([(4,), (25,), (999,), (None,)], "doc_id long")
    found = [(r["doc_id"], r["ids"]) for r in sstable.lookup(asked, manifest, folder).collect()]
    assert Counter(i for i, _ in found) == {4: 1, 25: 3}
    assert all(ids == [*tok.encode(docs.where(F.col("doc_id") == i).first()["text"], add_special_tokens=False).ids, 1] for i, ids in found)
    empty = sstable.write_shards(none, f"file://{tmp_path}/b", WORDS)
    assert sstable.read_shards(empty, f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize("word", ["Hello,", "ÉTÉ.", "don't", "x y", "ﬁ½", "éa", "<|endoftext|>", "a.b,", ",", "..", "İ", "ǅ,", "\x1cx", "1,"])
def test_words_one_by_one(word):
    e = sstable.Encoder(WORDS)
    expected = e.tokenizer.encode(f"a {word} b", add_special_tokens=False).ids
    assert np.frombuffer(next(e.batch([f"a {word} b".encode()])), dtype="<u2").tolist() == expected


HARD = ["", " ", "  a  b ", "\n\n x\ty\r\n", "日本語 テスト 🎉🎉 x", "a" * 500, "abcabc" * 40 + " z", "▁▁ hi", "   ", "\x01é ﬁ ½", "x = {\r\n};\r", "the cat"]


def test_pieces(spark, docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    out = pieces.decode(pieces.encode(rows, PIECES), PIECES).collect()
    for r in out:
        assert r["ids"] == sp.encode(r["text"] or "") and r["decoded"] == (r["text"] or "").replace("▁", " ")
    assert pieces.encode(none.drop("ids"), PIECES).count() == 0


@pytest.mark.parametrize("letters", ["abcXYZ  0189.,-_()'\"{}/\n\té日ñ².½▁\x01\r;", "ab ▁.,é\n", "xyzéñ"])
def test_no_piece_crosses_a_cut(letters):
    """Words merged each for itself give the ids of the whole text."""
    m, sp, pick = pieces.merger(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(7)
    for _ in range(3000):
        text = "".join(pick.choices(letters, k=pick.randint(1, 40)))
        assert next(m.batch([text])).tolist() == sp.encode(text)


@pytest.mark.parametrize("frequent", [0, 20, 1 << 17])
def test_pieces_of_frequent_words(spark, docs, monkeypatch, frequent):
    """No, some or all words by the lattice: the same ids; columns of the names used inside."""
    monkeypatch.setattr(pieces, "FREQUENT", frequent)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = docs.drop("ids").withColumns({"asked": F.lit("x"), "n": F.lit(None).cast("long"), "word": F.lit(1)})
    words = Counter(w for d in docs.collect() for w in pieces.merger(PIECES).cut(d["text"]) if len(w) <= 62)
    told = {r["asked"]: r["ids"] for r in pieces.frequent_words(rows, PIECES).collect()}
    assert len(told) <= frequent and set(told) <= set(words) and (frequent <= 20 or set(told) == set(words))
    assert not told or min(words[w] for w in told) >= max((n for w, n in words.items() if w not in told), default=0)
    out = pieces.encode(rows, PIECES).collect()
    assert Counter((r["doc_id"], r["text"], r["h"]) for r in out) == Counter((r["doc_id"], r["text"], r["h"]) for r in docs.collect())
    assert all(r["ids"] == sp.encode(r["text"] or "") for r in out)
    got = pieces.digest(rows, PIECES)
    assert got.count() == len(out) and got.where("n_pieces IS NULL OR NOT round_trip").count() == 0
    with pytest.raises(ValueError):
        pieces.encode(docs, PIECES)


def test_tasks_hold_few_words(monkeypatch):
    """counts go on before a batch's words are all gathered, and what a task remembers of words ends with it."""
    monkeypatch.setattr(pieces, "COUNTED", 1000, raising=False)
    texts = [" ".join(f"w{i * 50 + j}" for j in range(50)).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(200)]
    texts += [None, "", "wa " * 3000, *texts[:20]]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 150], pa.string())], ["text"]) for i in range(0, len(texts), 150)]
    m, got, most = pieces.merger(PIECES), Counter(), 0
    for b in pieces._counting(PIECES)(iter(batches)):
        most = max(most, b.num_rows)
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got[w] += n
    assert most <= 1100 and got == Counter(w for t in texts for w in m.cut(t))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(pieces, "SIDE_BY_SIDE", 100, raising=False)
    monkeypatch.setattr(pieces, "CHARACTERS", 1000, raising=False)
    assert [x.tolist() for x in m.batch([t or "" for t in texts])] == [sp.encode(t or "") for t in texts]
    assert len(m.known) > 1000 and not pieces.merger(PIECES).known


def test_piece_tables_need_no_workers(spark):
    """the table of pieces is a local relation, not an RDD of Python rows."""
    plan = pieces.piece_table(spark, PIECES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("LocalRelation")


def test_merges_in_the_lattice(spark, docs, none):
    """The relational lattice with its merge fold against the library, for the words of the documents and hard ones."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    real = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    words = {w for t in [*real, *(d["text"] for d in docs.collect())] if t for w in t.split()} | {"日本語", "🎉🎉x", "é", "ﬁ½", "\x01", "aaaaaaaaaaa", "a" * 62}
    rows = spark.createDataFrame([("▁" + w,) for w in words] * 2 + [(None,), ("",), ("▁" + "b" * 62,)], "word string")
    got = {r["word"]: r["ids"] for r in pieces.merged(rows, PIECES).collect()}
    long = {w for w in got if len(w) > 62}
    assert len(got) == len(words) + 1 and "▁" + "b" * 62 in long and all(got[w] is None for w in long)
    assert all(ids == sp.encode(w[1:]) for w, ids in got.items() if w not in long)
    assert pieces.merged(none.select(F.col("text").alias("word")), PIECES).count() == 0


def test_viterbi(spark, tmp_path):
    """The lattice fold against the library, with the public model's pieces read as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = False
    for i, p in enumerate(model.pieces):
        if p.type == 1:  # scores without ties
            p.score = -8.0 - math.log(1 + i) - 0.0001 * (i % 97) if p.score > -1e8 else -40.0
        elif p.type == 6:
            p.type = 5
    path = f"{tmp_path}/unigram.model"
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    words = ["the", "hello", "unbelievable", "straße", "x🎉y", "aaaaaaa", "Ndonouheaining"]
    rows = spark.createDataFrame([("▁" + w,) for w in words], "word string")
    least = min(p.score for p in model.pieces if p.type == 1)
    got = {r["word"]: r["ids"] for r in pieces.viterbi(rows, pieces.piece_table(spark, path), 16, 0, least).collect()}
    assert got == {"▁" + w: sp.encode(w) for w in words}


@pytest.mark.parametrize(("order", "block", "span"), [(2, 1 << 20, 1 << 20), (2, 500, 300), (3, 500, 300), (4, 1 << 20, 1000), (1, 500, 300)])
def test_katz(docs, none, monkeypatch, order, block, span):
    """Scores of every row against a plain model, also over many blocks and hash ranges."""
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "RANGE_TOKENS", span)
    rows = katz.katz_scores(docs, F.col("doc_id") % 4 != 1, order=order).collect()
    tokens = [((d["doc_id"]), [*(d["text"] or "").translate(LOWER).encode().split(), b""]) for d in docs.collect()]
    padded = [(i, [b""] * (order - 1) + t) for i, t in tokens]
    train = [t for i, t in padded if i is not None and i % 4 != 1]
    grams = [Counter(tuple(t[j - n + 1 : j + 1]) for t in train for j in range(order - 1, len(t))) for n in range(1, order + 1)]
    after = [Counter(tuple(t[j - n : j]) for t in train for j in range(order - 1, len(t))) for n in range(order)]

    def stats(n: Counter) -> np.ndarray:
        return np.append(np.bincount(np.minimum(list(n.values()), katz.CUT + 2), minlength=katz.CUT + 3), [sum(n.values()), len(n)])

    models = [katz.discounts(stats(g)) for g in grams]
    follow: dict = defaultdict(list)
    for g in grams[1:]:
        for x in g:
            follow[x[:-1]].append(x)

    def seen(x: tuple) -> float:
        n, d = grams[len(x) - 1][x], models[len(x) - 1]
        return d.of[min(n, katz.CUT + 1)] * n / (d.tokens if len(x) == 1 else after[len(x) - 1][x[:-1]] + 0.5)

    alpha = {h: (1 - sum(map(seen, xs))) / (1 - sum(seen(x[1:]) for x in xs)) for h, xs in follow.items()}

    def probability(x: tuple) -> float:
        if grams[len(x) - 1][x]:
            return seen(x)
        return models[0].free if len(x) == 1 else alpha.get(x[:-1], 1.0) * probability(x[1:])

    for h in list(follow)[:20] + list(follow)[-20:]:  # the model is normalised
        rest = math.prod(alpha[h[k:]] for k in range(len(h))) * models[0].free
        assert abs(sum(probability((*h, *w)) for w in grams[0]) + rest - 1) < 1e-9
    c, n, v = grams[0], sum(grams[0].values()), len(grams[0])
    expected = Counter()
    for i, t in padded:
        own = t[order - 1 :]
        base = sum(math.log10((c[(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        score = sum(math.log10(probability(tuple(t[j - order + 1 : j + 1]))) for j in range(order - 1, len(t)))
        expected[(i, i is None or i % 4 == 1, len(own), sum(c[(w,)] > 0 for w in own), n, f"{base:.5f}", f"{score:.5f}")] += 1
    assert expected == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.5f}", f"{r['score']:.5f}") for r in rows)
    assert katz.katz_scores(none, F.lit(True), order=order).count() == 0
    assert {r["score"] for r in katz.katz_scores(docs.limit(3), F.lit(False), order=order).collect()} == {0.0}

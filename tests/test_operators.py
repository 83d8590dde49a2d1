"""Small cases of the engine's own operators: line ends, level skips, wide characters, lost frames."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import json as json_
from quern.functions import limits, strings, values
from quern.operators import config, documents, packets, protocols, records, streams, transcripts
from quern.sources import readers
from quern.streaming import deltas


def decode(text: str) -> list[tuple]:
    """A plain version of block decoding, a line at a time, for texts without carriage returns."""
    found, stack, held, at = [], [], None, 0
    lines = text.split("\n")
    for line in [*(lines if lines[-1] else lines[:-1]), ""]:
        start, end = at, at + len(line.encode())
        at = end + 1
        bare = line.lstrip()
        level = len(bare) - len(bare.lstrip("#"))
        title = bare[level:].strip()
        head = 1 <= level <= 6 and bare[level : level + 1].isspace() and title
        if held and (head or not line.strip()):
            found.append(("paragraph", text.encode()[held[0] : held[1]].decode(), *held, None))
            held = None
        if head:
            del stack[level - 1 :]
            stack.append(title)
            found.append(("heading", title, start, end, list(stack), level))
        elif line.strip():
            held = (held[0], end, held[2]) if held else (start, end, list(stack))
    return found


DOCS = ["", "# Rye\n\nMill the grain.\n\n## Ovens\n\nHot, please.\n", "### a\n### b\n# c\ntext\nmore\n\n\nlast", "#######x\n # ok \nno#\n", "éü\n\n# ñ\nß", "#\n# \n####### seven\n"]


def test_blocks(spark):
    rows = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    got = {}
    for r in documents.blocks(rows).orderBy("doc_id", "block_ix").collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["text"], r["start"], r["end"], r["heading_path"], r["level"]))
    for i, text in enumerate(DOCS):
        assert got.get(i, []) == decode(text), text


def test_blocks_carriage_returns(spark):
    rows = spark.createDataFrame([(1, "# A\r\nx\r\ny\r\n\r\nz\r")], "doc_id long, text string")
    got = [(r["kind"], r["text"], r["start"], r["end"]) for r in documents.blocks(rows).orderBy("block_ix").collect()]
    assert got == [("heading", "A", 0, 3), ("paragraph", "x\r\ny", 5, 9), ("paragraph", "z\r", 13, 15)]


@pytest.mark.parametrize("most", [1, 2, 3, 4, 7, 100])
def test_windows(spark, most):
    texts = ["abcdef", "é€😀x", "", "😀" * 5]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in documents.chunk_fixed(rows, most).orderBy("doc_id", "chunk_ix").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["start"], r["end"]))
    for i, text in enumerate(texts):
        data, at, expected = text.encode(), 0, []
        while at < len(data):
            to = min(at + most, len(data))
            while at < to < len(data) and data[to] & 0xC0 == 0x80:
                to -= 1
            if to == at:
                to = at + 1
                while to < len(data) and data[to] & 0xC0 == 0x80:
                    to += 1
            expected.append((data[at:to].decode(), at, to))
            at = to
        assert got.get(i, []) == expected
    assert documents.chunk_fixed(rows, 0).count() == 0


def test_recursive_without_paragraphs(spark):
    rows = spark.createDataFrame([(1, "# only a heading\n"), (2, "")], "doc_id long, text string")
    got = documents.chunk_recursive(rows, 6).orderBy("chunk_ix").collect()
    assert "".join(r["text"] for r in got) == "# only a heading\n" and {r["doc_id"] for r in got} == {1}
    assert [r["text"] for r in documents.chunk_heading(rows).collect()] == ["# only a heading\n"]


def test_limits(spark):
    rows = spark.createDataFrame([("abc",), ("éé",), (None,)], "t string")
    got = [r[0] for r in rows.select(limits.first_error(limits.input_bytes(F.col("t"), 3))).collect()]
    assert got == [None, "decode input bytes limit exceeded: 4 > 3", None]


def test_values(spark):
    rows = spark.createDataFrame([('{"a":1.50,"b":"x","c":null,"d":true}',), ("[1]",), ("no",)], "j string")
    got = rows.select(values.object_fields(F.col("j")).alias("f"), values.repeated_keys(F.col("j")).alias("r")).collect()
    assert [(x["key"], x["raw"]) for x in got[0]["f"]] == [("a", "1.5"), ("b", "x"), ("c", None), ("d", "true")]
    assert got[0]["r"] is False and got[1]["f"] is None and got[2]["r"] is None
    tagged = spark.range(1).select(values.tagged_number(F.lit("1.50")), values.tagged_bytes(F.lit(b"\0" * 100)), values.quoted(F.lit('a"\n'))).first()
    assert json.loads(tagged[0])["value"] == "1.50" and "\\r" not in tagged[1] and json.loads(tagged[2]) == 'a"\n'


def test_requests(spark):
    bodies = [
        {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}]},
        {"messages": [{"role": "user", "content": "q"}]},
        {"model": "m", "messages": []},
        {"model": "m", "messages": [{"role": "assistant", "content": "q"}]},
    ]
    rows = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    got = transcripts.decode_request(rows).orderBy("i").collect()
    assert got[0]["task"] == "q" and got[0]["prior"][0]["role"] == "system" and got[0]["error"] is None
    assert [r["error"] is not None for r in got] == [False, True, True, True]


def test_usage_saturates(spark):
    rows = spark.createDataFrame([(1, 2**63 - 1, 5)], "g int, input_tokens long, output_tokens long")
    assert rows.select(transcripts.saturating_total(F.col("input_tokens"), F.col("output_tokens"))).first()[0] == 2**63 - 1


def test_sse_frames(spark):
    body = ": hi\nevent: a\ndata: 1\ndata: 2\n\nevent: b\n\ndata: 3\r\n\r\ndata: 4"
    rows = spark.createDataFrame([(1, body)], "response_id long, body string")
    got = [(r["event"], r["data"]) for r in readers.sse_frames(rows).orderBy("frame_ix").collect()]
    assert got == [("a", "1\n2"), ("b", "3"), ("", "4")]


def test_stream_of_deltas(spark, tmp_path):
    answers = spark.createDataFrame([(1, "hello world"), (2, "é😀")], "response_id long, text string")
    frames = transcripts.stream_frames(answers, 3)
    assert {r["response_id"]: r["text"] for r in transcripts.reassemble(frames).collect()} == {1: "hello world", 2: "é😀"}
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_ix"))
    timed = frames.withColumn("at", at)
    timed.where("frame_ix % 2 = 1").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    timed.where("frame_ix % 3 < 2").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    timed.where("frame_ix % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/in/c")
    late = timed.limit(1).select(F.lit(9).cast("long").alias("response_id"), "frame_ix", "data", F.timestamp_seconds(F.lit(1_800_000_000)).alias("at"))
    late.write.parquet(f"{tmp_path}/in/d")
    stream = spark.readStream.schema(timed.schema).parquet(f"{tmp_path}/in/*")
    writer = deltas.reassemble_stream(stream).writeStream.format("memory").queryName("answers").outputMode("append")
    writer.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    assert {r["response_id"]: (r["text"], r["ended"]) for r in spark.table("answers").collect()} == {1: ("hello world", True), 2: ("é😀", True)}


def test_envelopes(spark):
    wires = ['{"jsonrpc":"2.0","id":null,"method":"m"}', '{"jsonrpc":"2.0"}', "3", '{"jsonrpc":"2.0","id":{},"result":1}']
    rows = spark.createDataFrame([(w,) for w in wires], "w string")
    got = [r[0] for r in rows.select(protocols.classify_envelope(F.col("w"))).collect()]
    assert got == ["request", "invalid: field combination", "invalid: not an object", "invalid: id"]


def test_dangling(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,)], "id int")
    assert [tuple(r) for r in protocols.dangling(a, "k", b, "id", "x").collect()] == [("x", "2", 2)]


def test_edits(spark):
    from quern.operators import edits

    blocks = spark.createDataFrame([(d, i, f"b{i}") for d in range(8) for i in range(3)], "doc_id long, block_ix int, text string")
    made = [(0, "replace", 1, "b1", "x"), (1, "insert", 3, None, "x"), (2, "delete", 0, "b0", None), (3, "replace", 1, "no", "x")]
    made += [(4, "insert", 4, None, "x"), (5, "delete", 7, "b7", None), (6, "swap", 0, None, None), (9, "insert", 0, None, "x")]
    e = spark.createDataFrame(made, edits.SCHEMA)
    got: dict = {}
    for r in edits.apply(blocks, e).orderBy("doc_id", "block_ix").collect():
        got.setdefault(r["doc_id"], []).append((r["block_ix"], r["text"]))
    same = [(0, "b0"), (1, "b1"), (2, "b2")]
    assert got == {0: [(0, "b0"), (1, "x"), (2, "b2")], 1: [*same, (3, "x")], 2: [(0, "b1"), (1, "b2")], **dict.fromkeys((3, 4, 5, 6, 7), same), 9: [(0, "x")]}
    errors = {r["doc_id"]: r["error"] for r in edits.apply(blocks, e).collect()}
    assert errors[3] == "the old text differs" and errors[4] == "no such place" and errors[5] == "no such block" and errors[6] == "unknown edit swap"
    back = edits.apply(edits.apply(blocks, e), edits.invert(e)).where("doc_id < 3")
    assert sorted((r["doc_id"], r["block_ix"], r["text"]) for r in back.collect()) == [(d, i, f"b{i}") for d in range(3) for i in range(3)]


def test_config(spark):
    from quern.operators import config

    text = '# c\ntop = 1\n[a]\nx = "q \\" r"\nx = 2\nd = 2020-01-01\nl = [1, "b", true]\nm = [1,]\n[[r]]\ny = 99999999999999999999\n[[r]]\ny = -5\n[a]\nnonsense\né = 1'
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r["section"], r["key"], r["kind"], r["error"]) for r in config.settings(rows).orderBy("line_ix").collect()]
    assert got == [
        ("", "top", "int", None),
        ("a", "x", "string", None),
        ("a", "x", "int", "key given twice"),
        ("a", "d", None, "no value of a known kind"),
        ("a", "l", "array", None),
        ("a", "m", None, "no value of a known kind"),
        ("r", "y", None, "no value of a known kind"),
        ("r", "y", "int", None),
        ("a", None, None, "section given twice"),
        ("a", None, None, "neither section nor key"),
        ("a", None, None, "not ASCII"),
    ]


FRAMES = {
    "openai": (
        [("", '{"choices":[{"delta":{"content":"ab"}}]}'), ("", '{"choices":[{"delta":{"content":"cé"},"finish_reason":"length"}]}'), ("", '{"choices":[],"usage":{"prompt_tokens":1,"completion_tokens":2}}'), ("", "[DONE]")],
        ("abcé", "length", 3),
    ),
    "ollama": ([("", '{"message":{"content":"a"}}'), ("", '{"response":"b"}'), ("", '{"done":true,"done_reason":"stop","prompt_eval_count":4,"eval_count":5}')], ("ab", "stop", 3)),
    "anthropic": (
        [
            ("content_block_delta", '{"index":1,"delta":{"type":"text_delta","text":"late"}}'),
            ("content_block_start", '{"index":0,"content_block":{"type":"text","text":"so "}}'),
            ("content_block_delta", '{"index":0,"delta":{"type":"text_delta","text":"soon, "}}'),
            ("message_delta", '{"delta":{"stop_reason":"end_turn"}}'),
        ],
        ("so soon, late", "end-turn", 4),
    ),
}


@pytest.mark.parametrize("wire", sorted(FRAMES))
def test_streams_as_batches_and_streams(spark, tmp_path, wire):
    """Frames out of order and sent twice; as a stream, the answer comes once its gap has passed."""
    frames, expected = FRAMES[wire]
    rows = [(1, i, e, d) for i, (e, d) in enumerate(frames)]
    schema = "response_id long, frame_ix int, event string, data string"
    fold = getattr(streams, wire)
    got = [(r["text"], r["stop_reason"], r["n_chunks"]) for r in fold(spark.createDataFrame([*rows[::-1], rows[0]], schema)).collect()]
    assert got == [expected]
    timed = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_ix")))
    timed.where("frame_ix % 2 = 1").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    timed.coalesce(1).write.parquet(f"{tmp_path}/in/b")
    late = timed.limit(1).select(F.lit(9).cast("long").alias("response_id"), "frame_ix", "event", "data", F.timestamp_seconds(F.lit(1_800_000_000)).alias("at"))
    late.write.parquet(f"{tmp_path}/in/c")
    stream = fold(spark.readStream.schema(timed.schema).parquet(f"{tmp_path}/in/*"), gap="1 minute")
    writer = stream.writeStream.format("memory").queryName(f"folded_{wire}").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck")
    writer.trigger(availableNow=True).start().awaitTermination(120)
    assert [(r["text"], r["stop_reason"], r["n_chunks"]) for r in spark.table(f"folded_{wire}").where("response_id = 1").collect()] == [expected]


def test_streams_of_nothing_and_too_much(spark, monkeypatch):
    monkeypatch.setitem(limits.DEFAULTS, "collection length", 2)
    schema = "response_id long, frame_ix int, event string, data string"
    rows = [(1, i, "", '{"response":"x"}') for i in range(3)] + [(2, 0, "", "")]
    got = {r["response_id"]: r["error"] for r in streams.ollama(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "decode collection length limit exceeded: 3 > 2", 2: "ollama stream did not contain any response chunks"}
    assert streams.anthropic(spark.createDataFrame([], schema)).count() == 0


def test_requests_with_parts(spark):
    """A message's content may be a list of parts, and a request with them is as good as one with texts."""
    body = '{"model":"m","messages":[{"role":"system","content":"be kind"},{"role":"user","content":[{"type":"text","text":"a"},{"type":"image_url"},{"type":"text","text":"b"}]}]}'
    r = transcripts.decode_request(spark.createDataFrame([(body,)], "body string")).first()
    assert (r["task"], r["error"], [tuple(m) for m in r["prior"]]) == ("a b", None, [("system", "be kind")])


HARD = ["", "plain", 'a\tb"c\\ \x01\x7fé\u2028😀', "\\u{41}", "\r\n"]


def test_string_literals(spark):
    rows = spark.createDataFrame([(t,) for t in HARD], "t string")
    for r in rows.select("t", strings.literal_value(strings.literal(F.col("t"))).alias("v"), strings.stable_hash(F.col("t")).alias("h")).collect():
        h = 0xCBF29CE484222325
        for b in r["t"].encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        assert (r["v"]["value"], r["v"]["error"], r["h"]) == (r["t"], None, f"{h:016x}")
    bad = {'"a': "invalid string literal", '"\\q"': "unsupported string escape", '"\\u{D800}"': "invalid unicode scalar", '"\\u{}"': "invalid unicode escape", '"\\"': "unterminated string escape"}
    for r in spark.createDataFrame([(t,) for t in bad], "t string").select("t", strings.literal_value(F.col("t")).alias("v")).collect():
        assert r["v"]["error"] == bad[r["t"]] and r["v"]["value"] is None


def test_tagged_json(spark):
    """Nested values against a plain version; text with braces, colons and commas inside."""

    def plain(x):
        if isinstance(x, dict):
            return {"$expr": "map", "entries": [{"key": {"$expr": "symbol", "name": k}, "value": plain(v)} for k, v in x.items()]}
        if isinstance(x, list):
            return {"$expr": "list", "items": [plain(v) for v in x]}
        if isinstance(x, str):
            return {"$expr": "string", "value": x}
        return {"$expr": "nil"} if x is None else {"$expr": "bool", "value": x} if isinstance(x, bool) else {"$expr": "number", "domain": "numbers/f64", "value": str(x)}

    def nodes(x):
        return 1 + sum(map(nodes, x)) if isinstance(x, list) else 1 + sum(1 + nodes(v) for v in x.values()) if isinstance(x, dict) else 1

    values_ = [{}, [], {"a": [{"b,{": "c:\"}]", "d": {}}, [[]], None], "e": [True, -3, "x"]}, "t", 7, [{}, {"k": {"l": 1}}]]
    rows = spark.createDataFrame([(json.dumps(v),) for v in values_] + [("{bad",)], "t string")
    got = rows.select("t", json_.tagged(F.col("t")).alias("j"), json_.node_count(json_.tokens(F.col("t"))).alias("n")).collect()
    assert [json.loads(r["j"]) for r in got[:-1]] == [plain(v) for v in values_] and got[-1]["j"] is None
    assert [r["n"] for r in got[:-1]] == [nodes(v) for v in values_]
    assert [tuple(r[0]) for r in spark.createDataFrame([("a/b/c",), ("x",)], "s string").select(json_.parse_symbol(F.col("s"))).collect()] == [("a", "b/c"), (None, "x")]


def test_configuration_round_trip(spark):
    text = 'x = 1\n[a]\n# note\nk = "v # w"\n[[r]]\nn = 1\n[[r]]\nn = 2\n'
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = config.encode(config.settings(rows))
    assert out.first()["text"] == text.replace("# note\n", "")
    keep = ["section", "section_ix", "key", "kind", "value"]
    assert config.settings(out).select(keep).collect() == config.settings(rows).select(keep).collect()


def test_parts_and_records_of_nothing(spark):
    rows = spark.createDataFrame([(None, None), ("Given", None), ("Frame", "{bad"), ("Patch", '{"parent-cid":"c","target":"t","replacement":null}')], "kind string, payload string")
    got = [r[0] for r in rows.select(packets.part_reason(F.col("kind"), F.col("payload"))).collect()]
    assert got == ["unknown part null", None, "frame must be a map", None]
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), ("[]",)], "t string").select(records.record_reason(F.col("t"))).collect()][2] == "a record is no map"


def test_kinds_without_the_schema_of_containers(spark):
    """Kinds of values at the top and at a path; no list or map is asked for its schema, and keys are dealt out before documents are made."""
    from quern.functions.json import items_at, keys_at, kind_at, parsed
    from quern.plans import wires

    cases = {"[]": "list", '[1,{"a":2}]': "list", "{}": "map", '{"a":[1]}': "map", '"[1]"': "string", "1": "number", "1.5": "number", "1e300": "number", "true": "bool", "null": "nil"}
    rows = spark.createDataFrame([(j, f'{{"x y":{j}}}') for j in cases] + [("{", "{")], "j string, o string")
    top, inner = parsed(F.col("j")), parsed(F.col("o"))
    got = rows.select("j", kind_at(top), kind_at(inner, '$["x y"]'), items_at(top, "$").isNotNull(), keys_at(top).isNotNull()).collect()
    assert [tuple(r) for r in got] == [*((j, k, k, k == "list", k == "map") for j, k in cases.items()), ("{", None, None, False, False)]
    asked = spark.createDataFrame([('[{"a":1}]',)], "j string").select(F.when(kind_at(parsed(F.col("j"))) == "list", 1))._jdf.queryExecution().toString()
    assert "CASE WHEN isnotnull(try_variant_get" in asked
    assert wires.index_fields(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1

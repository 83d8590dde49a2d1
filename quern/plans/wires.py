"""Queries of streams, records, envelopes, index documents, packets and typed values, with their SQL.

The tables hold no such texts, so each query makes them of its table's rows, with faults at places that the keys decide; the SQL says from the
keys alone what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import json, strings
from quern.operators import index, packets, protocols, records, streams


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(by: Column, cases: dict[int, Column | str], other: Column | str) -> Column:
    """The case of a number; texts are literals."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    out = None
    for k, v in cases.items():
        out = F.when(by == k, lit(v)) if out is None else out.when(by == k, lit(v))
    return out.otherwise(lit(other))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    turns = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("response_id"), "conv_id", "turn", F.length("text").alias("n"),
        F.substring("text", F.lit(1), half).alias("a"), F.substring("text", half + 1, F.length("text")).alias("z"),
    )


def _frames(rows: DataFrame, events: list[tuple[str, Column]], keep: Column) -> DataFrame:
    """The events as frames; rows where ``keep`` does not hold have the last frame only."""
    every = F.array(*[F.struct(F.lit(i).alias("frame_ix"), F.lit(e).alias("event"), d.alias("data")) for i, (e, d) in enumerate(events)])
    out = rows.select("response_id", keep.alias("whole"), F.explode(every).alias("x")).where(F.col("whole") | (F.col("x.frame_ix") == len(events) - 1))
    return out.select("response_id", "x.*").where(F.col("data").isNotNull())


STREAMED = ("response_id", "text", "stop_reason", "input_tokens", "output_tokens", "total_tokens", "n_chunks", "error")


def openai_frames(rows: DataFrame) -> DataFrame:
    k = F.col("conv_id") % 7
    delta = lambda c: F.to_json(F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("delta"))).alias("choices")))
    end = _text('{"choices":[{"delta":{},"finish_reason":"', F.when(F.col("turn") % 2 == 0, "length").otherwise("stop"), '"}]}')
    middle = _pick(k, {1: "{bad", 2: '{"error":{"message":"busy","type":"x"}}', 3: "[1]"}, end)
    usage = _text('{"choices":[],"usage":{"prompt_tokens":3,"completion_tokens":', F.col("n"), ',"total_tokens":', F.col("n") + 3, "}}")
    events = [F.lit('{"choices":[{"delta":{"role":"assistant"}}]}'), delta(F.col("a")), delta(F.col("z")), middle, usage, F.lit(" [DONE] ")]
    return _frames(rows, [("", e) for e in events], k != 4)


def openai_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.openai(openai_frames(_answers(spark, sf_dir))).select(*STREAMED)


def compatible_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = openai_frames(_answers(spark, sf_dir))
    both = streams.stamped(streams.openai(frames), "lm-studio").unionByName(streams.stamped(streams.openai(frames), "lemonade"))
    return both.groupBy("provider", "stop_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("total_tokens"))


def ollama_frames(rows: DataFrame) -> DataFrame:
    k = F.col("conv_id") % 7
    first = F.to_json(F.struct(F.struct(F.col("a").alias("content")).alias("message"), F.lit(False).alias("done")))
    second = F.to_json(F.struct(F.col("z").alias("response")))
    end = _text('{"done":true,"done_reason":"', F.when(F.col("turn") % 2 == 0, "length").otherwise("stop"), '","prompt_eval_count":3,"eval_count":', F.col("n"), "}")
    last = _pick(k, {1: "{bad", 2: '{"done":true,"prompt_eval_count":3}', 3: '"text"'}, end)
    return _frames(rows, [("", first), ("", second), ("", last), ("", F.lit(" "))], k != 4)


def ollama_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.ollama(ollama_frames(_answers(spark, sf_dir))).select(*STREAMED)


def anthropic_frames(rows: DataFrame) -> DataFrame:
    k = F.col("conv_id") % 7
    delta = lambda i, kind, field, c: F.to_json(F.struct(F.lit(i).alias("index"), F.struct(F.lit(kind).alias("type"), c.alias(field)).alias("delta")))
    more = F.when(F.col("turn") % 2 == 0, '"input_tokens":3,').otherwise("")
    return _frames(
        rows,
        [
            ("message_start", _text('{"message":{"id":"m', F.col("response_id"), '","model":"m1"}}')),
            ("content_block_start", F.lit('{"index":1,"content_block":{"type":"tool_use","id":"t1","name":"find","input":{}}}')),
            ("content_block_delta", delta(0, "text_delta", "text", F.col("a"))),
            ("content_block_delta", delta(1, "input_json_delta", "partial_json", F.lit('{"turn":'))),
            ("content_block_delta", delta(0, "text_delta", "text", F.col("z"))),
            ("content_block_delta", delta(1, "input_json_delta", "partial_json", _text(F.col("turn"), F.when(k == 1, "").otherwise("}")))),
            ("content_block_stop", F.lit('{"index":1}')),
            ("ping", _pick(k, {2: '{"error":{"type":"overloaded"}}', 5: "{bad"}, "{}")),
            ("content_block_delta", F.when(k == 3, '{"delta":{"type":"text_delta","text":"x"}}').when(k == 6, '{"index":0,"delta":{"type":"input_json_delta","partial_json":"x"}}')),
            ("message_delta", _text('{"delta":{"stop_reason":"tool_use"},"usage":{', more, '"output_tokens":', F.col("n"), "}}")),
            ("message_stop", F.lit("{}")),
            ("content_block_delta", delta(0, "text_delta", "text", F.lit("late"))),
        ],
        F.lit(True),
    )


def anthropic_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.anthropic(anthropic_frames(_answers(spark, sf_dir)))
    tool = F.get("content", 1)
    return out.select(*[c for c in STREAMED if c != "n_chunks"], "model", "span_id", F.size("content").alias("n_blocks"), F.concat_ws(" ", tool["kind"], tool["id"], tool["name"], tool["arguments"]).alias("tool"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id")


def mcp_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    head = '{"jsonrpc":"2.0",'
    wire = _pick(
        e % 12,
        {
            0: _text(head, '"id":', e, ',"method":"m","params":{"id":[1]}}'),
            1: '{"jsonrpc":2.0,"id":1,"method":"m"}',
            2: _text(head, '"id":', e, ',"method":5}'),
            3: _text(head, '"id":"', e, '","error":"x"}'),
            4: _text(head, '"id":', e, ',"error":{"code":-', e, ',"message":"no \\"x\\"","data":[', e, "]}}"),
            5: _text(head, '"id":', e, ',"error":{"code":1.5,"message":"m"}}'),
            6: _text(head, '"id":null,"result":{"n":', e, "}}"),
            7: _text(head, '"id":true,"result":1}'),
            8: _text(head, '"method":"note","params":"', e, '"}'),
            9: _text(head, '"id":', e, ',"error":{"code":1,"message":"m","more":1}}'),
            10: "3",
        },
        _text(head, '"id":', e, "}"),
    )
    rows = _events(spark, sf_dir).select("event_id", wire.alias("t")).select("event_id", protocols.envelope(F.col("t")).alias("e"))
    return rows.select("event_id", "e.kind", "e.id", "e.method", "e.body", "e.code", "e.message", protocols.envelope_json(F.col("e")).alias("again"))


RECORD_FAULTS = (
    None, "a record has exactly one marker", "a message has no role", "text has no text", "tool-call has no arguments", "model-response has no model",
    "span-id", "a field is named twice", "model-card has no locality", "status of tool-result is no string", "no JSON, or a field of a field is named twice", "a message has no content list",
)


def record_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    request = lambda message: _text('{"model-request":true,"task":"', e, '","messages":[{"role":"user","content":[]},', message, "]}")
    part = lambda text: _text('{"model-response":true,"runner":"r","model":"m","stop-reason":"stop","content":[{"type":"x/y"},{"type":"other"},', text, "]}")
    json_ = _pick(
        e % 12,
        {
            0: request('{"role":"user","content":[{"type":"text","text":"a"}]}'),
            1: _text('{"model-request":true,"model-card":true,"task":', e, "}"),
            2: request('{"content":[]}'),
            3: request('{"role":"user","content":[{"type":"text"}]}'),
            4: part('{"type":"tool-call","id":"1","name":"n"}'),
            5: _text('{"model-response":true,"runner":"r","stop-reason":"stop","content":[],"n":', e, "}"),
            6: _text('{"model-event":true,"event":"final","runner":"r","model":"m","span-id":', e, ',"response":{"model-response":true,"runner":"r","model":"m","stop-reason":"s","content":[]}}'),
            7: _text('{"model-card":true,"runner":"r","runner":"', e, '"}'),
            8: _text('{"model-card":true,"runner":"r","model":"m","provider":"', e, '"}'),
            9: part('{"type":"tool-result","tool-call-id":"1","status":1,"output":null}'),
            10: _text("{", e),
        },
        request('{"role":"user","content":"text"}'),
    )
    return _events(spark, sf_dir).select("event_id", json_.alias("t")).select("event_id", records.record_reason(F.col("t")).alias("reason"))


def response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.openai(openai_frames(_answers(spark, sf_dir))).where("error is null")
    usage = records.usage_record(F.col("input_tokens"), F.col("output_tokens"), F.col("total_tokens"))
    failed = F.col("stop_reason") == "error"
    made = F.when(failed, records.error_record(F.lit("r"), F.lit("m"), F.col("text"))).otherwise(records.response_record(F.lit("r"), F.lit("m"), F.col("text"), F.col("stop_reason"), usage))
    rows = out.select("response_id", made.alias("record"), failed.alias("failed"))
    v = json.parsed(F.col("record"))
    total = json.count_at(v, '$.usage["total-tokens"]')
    return rows.select("response_id", records.record_reason(F.col("record")).alias("reason"), records.content_text(v, "$.content").alias("text"), json.string_at(v, '$["stop-reason"]').alias("stop_reason"), total.alias("total_tokens"))


def model_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.when(F.col("s_suppkey") % 2 == 0, "local").otherwise("remote")
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", records.card_record(F.lit("r"), F.col("s_name"), F.lit("p"), local).alias("card"))
    return rows.select("s_suppkey", "card", records.record_reason(F.col("card")).alias("reason"))


def encode_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.openai(openai_frames(_answers(spark, sf_dir))).where("error is null and stop_reason <> 'error'").withColumn("model", F.lit("m"))
    return records.encode_openai_response(out).select("response_id", "body")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    arguments = _pick(e % 6, {0: _text('"{\\"n\\":', e, '}"'), 1: '""', 2: "null", 3: _text('{"n":', e, "}"), 4: '"{bad"'}, '"[1, 2]"')
    body = _text('{"choices":[{"message":{"tool_calls":[{"id":"a","function":{"name":"f","arguments":', arguments, '}},{"id":"b","function":{"name":"g"}}]}}]}')
    return records.decode_tool_response(_events(spark, sf_dir).select("event_id", body.alias("body")))


def _index_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    when = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    json_ = _text(
        '{"schema":"s1","generated-by":"g","visibility":"open","subjects":[{"id":"S', k, '","kind":"unit"', when(13, "", ',"title":"t"'), '}],"anchors":[{"id":"A1","subject":"S', k,
        '","kind":"e"},{"id":"', when(17, "A1", "A2"), '","subject":"S', when(5, F.lit("0x"), k.cast("string")), '","kind":"e"}],"surfaces":[],"specimens":[],"drafts":[],'
        '"features":[{"id":"F1","key":"k","subject":"S', k, '","title":"t","summary":"s","anchors":["A1","', when(3, "A9", "A2"), '"],"surfaces":[],"specimens":[],"grammar-contracts":[]}],'
        '"routes":[{"id":"r","title":"t","steps":[{"kind":"k","id":"i","why":null}]}],"edges":[{"from":"a","rel":"r","to":', when(7, "5", '"b"'), "}]", when(11, ',"more":1', ""), "}",
    )
    # a document is far larger than its key, and one row group of keys is one task: keys are dealt out before documents are made
    keys = _table(spark, sf_dir, "customer").select("c_custkey").repartition(2 * spark.sparkContext.defaultParallelism)
    return keys.select(k.cast("long").alias("doc_id"), json_.alias("json"))


def index_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.check(_index_docs(spark, sf_dir))


def index_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.dangling(_index_docs(spark, sf_dir))


def index_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.repeated(_index_docs(spark, sf_dir))


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets made of orders: the key decides which of thirteen cases each is."""
    k = F.col("o_orderkey")
    part = lambda kind, payload="{}": F.struct(F.lit(kind).alias("kind"), (F.lit(payload) if isinstance(payload, str) else payload).alias("payload"))
    frame = lambda name, slots: part("Frame", _text(f'{{"frame":"{name}","slots":{{', slots, "}}"))
    rule = frame("require", _text('"rule":"r', k, '"'))
    given, back = part("Given"), part("Return")
    review = part("Review", _text('{"target":"t', k, '","body":"fine, it is"}'))
    cases = {
        0: ("request", (), (given, rule, back)),
        1: ("request", (), (frame("produce-artifact", '"what":"w"'), back)),
        2: ("request", (), (given, frame("forbid", '"rule":"two words"'), back)),
        3: ("request", (), (given, part("Poem"), back)),
        4: ("reply", ("c1#move=request",), (given, frame("answer", ""), back)),
        5: ("reply", ("c1",), (frame("answer", ""), back)),
        6: ("reply", ("c1#move=request", "c2#move=vote"), (frame("answer", ""), back)),
        7: ("review", ("c1#move=reply",), (review,)),
        8: ("vote", ("c1#move=offer",), (part("Vote", '{"target":"t","scores":[]}'),)),
        9: ("request", (), (given, back)),
        10: ("request", (), (part("Weave", '{"rows":[{"slot":"a","head":"h","roles":{}},{"slot":"a","head":"h","roles":{}}]}'), back)),
        11: ("request", (), (part("Call", '{"name":"f","args":[{"name":"x","content-id":"c","fenced":"bare"}]}'), back)),
        12: ("request", (), (rule, back, given)),
    }
    kind = k % len(cases)
    return _table(spark, sf_dir, "orders").select(
        k.alias("packet"),
        _pick(kind, {i: c[0] for i, c in cases.items()}, "none").alias("move"),
        _pick(kind, {i: F.array(*[F.lit(x) for x in c[1]]).cast("array<string>") for i, c in cases.items()}, F.array().cast("array<string>")).alias("parents"),
        _pick(kind, {i: F.array(*c[2]) for i, c in cases.items()}, F.array(given)).alias("body"),
    )


PACKET_FAULTS = {
    1: "frame produce-artifact missing hole target", 2: "prose in hole rule", 3: "unknown part Poem", 5: "a parent gives no evidence of its move",
    6: "reply may not answer its parents", 8: "a vote has no score", 9: "request requires Frame or Call or Weave", 10: "a weave''s slot is given twice",
    11: "argument x must be fenced", 12: "the parts match no profile",
}


def packet_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.check(_packets(spark, sf_dir)).select("packet", "move", "reason")


def packet_warrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packets(spark, sf_dir).where("packet % 13 in (0, 7)").withColumn("warrant", packets.warrant_of(F.col("body")))
    given = F.when(F.col("packet") % 2 == 0, F.col("warrant")).when(F.col("packet") % 3 == 0, F.slice("warrant", 1, 1))
    checked = packets.check(rows.withColumn("own", F.col("warrant")).withColumn("warrant", given), verify=True)
    return checked.select("packet", F.array_join(F.transform("own", lambda w: F.concat(w["kind"], F.lit(" "), w["cid"])), ",").alias("warrant"), "reason")


def packet_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets.stamp(_packets(spark, sf_dir).where("packet % 13 = 9"))
    kept = F.col("cid").alias("stamped")
    rows = rows.select("packet", kept, F.when(F.col("packet") % 3 > 0, F.col("cid")).alias("cid"), F.when(F.col("packet") % 2 == 0, F.lit("offer")).otherwise(F.col("move")).alias("move"), "parents", "body")
    return packets.verify_stamp(rows).select("packet", "stamped", "reason")


def packet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    payload = _pick(
        k % 5,
        {
            0: _text('{"frame":"produce-artifact","slots":{"what":"w', k, '","target":"t"}}'),
            1: '{"frame":"check","slots":{"path":["a","b"]}}',
            2: '{"frame":"proposal","slots":{}}',
            3: '{"frame":"explain","slots":{"text":"some prose"}}',
        },
        _text('{"frame":"forbid","slots":{"rule":"r', k, '","more":"x"}}'),
    )
    return _table(spark, sf_dir, "orders").select(k.alias("packet"), packets.render_frame(payload).alias("sentence"), packets.frame_reason(json.parsed(payload)).alias("reason"))


def packet_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.col("c_name")
    spans = F.array(F.lit("Use é "), name, F.when(k % 3 == 0, "!").otherwise("."))
    rendered = F.concat(F.lit("Use é "), name, F.when(k % 5 == 0, ".more").otherwise("."))
    return _table(spark, sf_dir, "customer").select(k.cast("long").alias("doc_id"), packets.ownership_reason(rendered, spans).alias("reason"))


def weave_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = _text('{"rows":[{"slot":"s', F.col("c_custkey"), '","head":"h","roles":{}},{"slot":"b","head":"g","roles":{}}]}')
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), packets.weave_shape(json.parsed(payload)).alias("shape"))


def string_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, "\x01\\").otherwise("\t\"é"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", text.alias("t"), strings.literal(text).alias("literal"))
    back = strings.literal_value(F.col("literal"))
    return rows.select("doc_id", "literal", back["value"].eqNullSafe(F.col("t")).alias("same"), back["error"].alias("error"))


def base64_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    b64 = F.base64(F.lpad(F.col("event_id").cast("string"), 9, "0").cast("binary"))
    wire = _pick(F.col("event_id") % 8, {0: b64, 1: F.concat(F.lit(" "), b64, F.lit("\r\n")), 2: "QUI=", 3: "QUJ=", 4: "QU=D", 5: "QUJ", 6: "QU*D"}, "QQ==QQ==")
    rows = _events(spark, sf_dir).select("event_id", strings.base64_value(wire).alias("v"))
    return rows.select("event_id", F.decode("v.data", "utf-8").alias("text"), "v.error")


def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), strings.stable_hash(F.concat("c_name", F.lit("é"))).alias("hash"))


def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = _text('{"id":', e, ',"list":["', e, '",null, true,1.50],"in":{"x,y":{}},"digits":12345678901234567890123.5}')
    rows, text = _events(spark, sf_dir).select("event_id", text.alias("t"), json.tokens(text).alias("ts")), F.col("t")
    ts = F.col("ts")
    return rows.select("event_id", json.tagged(text).alias("tagged"), json.node_count(ts).cast("long").alias("n_nodes"), json.depth(ts).alias("depth"))


def json_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    items = F.array_join(F.array_repeat(F.lit("1"), (e % 50).cast("int")), ",")
    text = F.when(e % 7 == 0, F.concat(F.repeat(F.lit("["), 9), F.repeat(F.lit("]"), 9))).otherwise(_text("[", items, "]"))
    return _events(spark, sf_dir).select("event_id", json.limits_error(text, 20, 8).alias("error"))


def json_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.functions import values

    e = F.col("event_id")
    text = _text('{"a":"', e, '","b":', e, ',"c":"true","d":true,"e":null,"f":[1],"g":12345678901234567890123.5}')
    rows = _events(spark, sf_dir).select("event_id", F.explode(values.object_fields(text)).alias("f"))
    return rows.select("event_id", "f.key", "f.domain", F.col("f.raw").alias("canonical"))


def json_untag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    item = _pick(
        e % 6,
        {
            0: _text('{"$expr":"number","domain":"numbers/f64","value":"', e, '"}'),
            1: _text('{"$expr":"number","value":"', e, '"}'),
            2: '{"$expr":"what"}',
            3: _text('{"$expr":"string","value":"', e, '"}'),
            4: '{"$expr":"bool","value":true}',
        },
        _text('{"value":', e, "}"),
    )
    text = F.when(e % 2 == 0, _text('{"$expr":"list","items":[', item, ',{"$expr":"nil"}]}')).otherwise(_text('{"$expr":"map","entries":[{"key":{"$expr":"symbol","name":"k"},"value":', item, "}]}"))
    rows = _events(spark, sf_dir).select("event_id", F.posexplode(json.untagged_items(json.parsed(text))).alias("ix", "v"))
    return rows.select("event_id", "ix", "v.*")


QUERIES = {
    f.__name__: f
    for f in (
        openai_stream, compatible_streams, ollama_stream, anthropic_stream, mcp_envelope, record_validate, response_records, model_cards, encode_answers, tool_calls,
        index_fields, index_references, index_repeated, packet_check, packet_warrants, packet_stamps, packet_frames, packet_ownership, weave_shapes,
        string_literals, base64_strict, stable_hashes, json_nested, json_limits, json_domains, json_untag,
    )
}

_TURNS = """SELECT conv_id * 100000 + turn AS response_id, conv_id % 7 AS k, turn, text AS t, length(text) AS n,
  CASE WHEN turn % 2 = 0 THEN 'length' ELSE 'stop' END AS reason FROM conversations WHERE role = 'assistant'"""
_OPENAI = f"""SELECT response_id, CASE WHEN k IN (0, 5, 6) THEN t WHEN k = 2 THEN 'busy' END AS text, CASE WHEN k IN (0, 5, 6) THEN reason WHEN k = 2 THEN 'error' END AS stop_reason,
  CASE WHEN k IN (0, 5, 6) THEN 3::BIGINT END AS input_tokens, CASE WHEN k IN (0, 5, 6) THEN n END AS output_tokens, CASE WHEN k IN (0, 5, 6) THEN n + 3 END AS total_tokens,
  CASE WHEN k = 4 THEN 0::BIGINT ELSE 5 END AS n_chunks, CASE k WHEN 1 THEN 'openai stream returned invalid json' WHEN 3 THEN 'openai stream chunk must be a json object'
  WHEN 4 THEN 'openai stream did not contain any response chunks' END AS error FROM ({_TURNS})"""


def _sql_cases(by: str, cases: dict[int, str], other: str = "NULL") -> str:
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"


_SPEC = "sha256('{{\"part\":\"{0}\",\"shown\":\"{1}\",\"authority\":\"{2}\"}}')"
_CID = lambda name, shown, authority: f"'{name} sha256:' || {_SPEC.format(name, shown, authority)}"
_E = "event_id"

ORACLES = {
    "openai_stream": _OPENAI,
    "compatible_streams": f"""SELECT provider, stop_reason, count(*) AS n, sum(total_tokens)::BIGINT AS total_tokens FROM ({_OPENAI}), (VALUES ('lm-studio'), ('lemonade')) AS p(provider)
  GROUP BY provider, stop_reason""",
    "ollama_stream": f"""SELECT response_id, CASE WHEN k IN (0, 2, 5, 6) THEN t END AS text, CASE WHEN k IN (0, 5, 6) THEN reason WHEN k = 2 THEN 'stop' END AS stop_reason,
  CASE WHEN k IN (0, 2, 5, 6) THEN 3::BIGINT END AS input_tokens, CASE WHEN k IN (0, 5, 6) THEN n END AS output_tokens, CASE WHEN k IN (0, 5, 6) THEN n + 3 END AS total_tokens,
  CASE WHEN k = 4 THEN 0::BIGINT ELSE 3 END AS n_chunks, CASE k WHEN 1 THEN 'ollama stream returned invalid json' WHEN 3 THEN 'ollama stream chunk must be a json object'
  WHEN 4 THEN 'ollama stream did not contain any response chunks' END AS error FROM ({_TURNS})""",
    "anthropic_stream": f"""SELECT response_id, CASE WHEN k IN (0, 4) THEN t WHEN k = 2 THEN 'overloaded' END AS text, CASE WHEN k IN (0, 4) THEN 'tool-use' WHEN k = 2 THEN 'error' END AS stop_reason,
  CASE WHEN k IN (0, 4) AND turn % 2 = 0 THEN 3::BIGINT END AS input_tokens, CASE WHEN k IN (0, 4) THEN n END AS output_tokens, CASE WHEN k IN (0, 4) AND turn % 2 = 0 THEN n + 3 END AS total_tokens,
  CASE k WHEN 1 THEN 'anthropic tool-use partial json invalid' WHEN 3 THEN 'anthropic stream event missing index' WHEN 5 THEN 'anthropic stream returned invalid json'
  WHEN 6 THEN 'anthropic delta of another kind arrived for block of text' END AS error, CASE WHEN k IN (0, 4) THEN 'm1' END AS model, CASE WHEN k IN (0, 4) THEN 'm' || response_id END AS span_id,
  CASE WHEN k IN (0, 4) THEN 2 END AS n_blocks, CASE WHEN k IN (0, 4) THEN 'tool-call t1 find {{"turn":' || turn || '}}' ELSE '' END AS tool FROM ({_TURNS})""",
    "mcp_envelope": f"""SELECT {_E}, kind, CASE WHEN ok AND k <> 8 THEN CASE k WHEN 6 THEN 'null' ELSE {_E}::VARCHAR END END AS id, CASE k WHEN 0 THEN 'm' WHEN 8 THEN 'note' END AS method,
  CASE k WHEN 0 THEN '{{"id":[1]}}' WHEN 4 THEN '[' || {_E} || ']' WHEN 6 THEN '{{"n":' || {_E} || '}}' WHEN 8 THEN '"' || {_E} || '"' END AS body,
  CASE WHEN k = 4 THEN -{_E} END AS code, CASE WHEN k = 4 THEN 'no "x"' END AS message,
  '{{"jsonrpc":"2.0",' || CASE k WHEN 0 THEN '"id":' || {_E} || ',"method":"m","params":{{"id":[1]}}}}'
    WHEN 4 THEN '"id":' || {_E} || ',"error":{{"code":' || -{_E} || ',"message":"no \\"x\\"","data":[' || {_E} || ']}}}}' WHEN 6 THEN '"id":null,"result":{{"n":' || {_E} || '}}}}'
    WHEN 8 THEN '"method":"note","params":"' || {_E} || '"}}' END AS again
  FROM (SELECT {_E}, {_E} % 12 AS k, {_E} % 12 IN (0, 4, 6, 8) AS ok, CASE {_E} % 12 WHEN 0 THEN 'request' WHEN 1 THEN 'invalid: version' WHEN 2 THEN 'invalid: method'
  WHEN 3 THEN 'invalid: error is no object' WHEN 4 THEN 'error' WHEN 5 THEN 'invalid: error code is no integer' WHEN 6 THEN 'response' WHEN 7 THEN 'invalid: id' WHEN 8 THEN 'notification'
  WHEN 9 THEN 'invalid: error has an unknown field' WHEN 10 THEN 'invalid: not an object' ELSE 'invalid: field combination' END AS kind FROM events)""",
    "record_validate": f"SELECT {_E}, " + _sql_cases(f"{_E} % 12", {i: f"'{r}'" for i, r in enumerate(RECORD_FAULTS) if r and i != 6}) + " AS reason FROM events",
    "response_records": f"""SELECT response_id, NULL::VARCHAR AS reason, text, stop_reason, total_tokens FROM ({_OPENAI}) WHERE error IS NULL""",
    "model_cards": """SELECT s_suppkey, '{"model-card":true,"runner":"r","model":"' || s_name || '","provider":"p","locality":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'local' ELSE 'remote' END
  || '","modalities-in":["text"],"modalities-out":["text"],"supports-stream":false,"supports-tools":false,"supports-json":true,"supports-shape":false,"health":"unknown"}' AS card,
  NULL::VARCHAR AS reason FROM supplier""",
    "encode_answers": f"""SELECT response_id, '{{"object":"chat.completion","model":"m","choices":[{{"index":0,"message":{{"role":"assistant","content":' || to_json(text)::VARCHAR || '}},"finish_reason":"' || stop_reason
  || '"}}],"usage":{{"prompt_tokens":3,"completion_tokens":' || output_tokens || ',"total_tokens":' || total_tokens || '}}}}' AS body FROM ({_OPENAI}) WHERE error IS NULL AND stop_reason <> 'error'""",
    "tool_calls": f"""SELECT {_E}, 0 AS call_ix, 'a' AS id, 'f' AS name, CASE {_E} % 6 WHEN 0 THEN '{{"n":' || {_E} || '}}' WHEN 1 THEN '{{}}' WHEN 2 THEN '{{}}' WHEN 3 THEN '{{"n":' || {_E} || '}}'
  WHEN 5 THEN '[1,2]' END AS arguments, CASE WHEN {_E} % 6 = 4 THEN 'tool call arguments must be json' END AS error FROM events
  UNION ALL SELECT {_E}, 1, 'b', 'g', '{{}}', NULL FROM events""",
    "index_fields": """SELECT c_custkey::BIGINT AS doc_id, CASE WHEN c_custkey % 11 = 0 THEN 'index has unknown field more' WHEN c_custkey % 13 = 0 THEN 'subject missing field title'
  WHEN c_custkey % 7 = 0 THEN 'to of edge is no string' END AS reason FROM customer""",
    "index_references": """SELECT c_custkey::BIGINT AS doc_id, 'anchors.subject' AS relation, CASE WHEN c_custkey % 17 = 0 THEN 'A1' ELSE 'A2' END AS id, 'S0x' AS ref FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, 'features.anchors', 'F1', 'A9' FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 'features.anchors', 'F1', 'A2' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 17 = 0""",
    "index_repeated": "SELECT c_custkey::BIGINT AS doc_id, 'anchors' AS section, 'A1' AS id, 2::BIGINT AS n FROM customer WHERE c_custkey % 17 = 0",
    "packet_check": f"""SELECT o_orderkey AS packet, CASE WHEN o_orderkey % 13 IN (4, 5, 6) THEN 'reply' WHEN o_orderkey % 13 = 7 THEN 'review' WHEN o_orderkey % 13 = 8 THEN 'vote' ELSE 'request' END AS move,
  {_sql_cases("o_orderkey % 13", {k: f"'{v}'" for k, v in PACKET_FAULTS.items()})} AS reason FROM orders""",
    "packet_warrants": f"""SELECT o_orderkey AS packet, CASE WHEN o_orderkey % 13 = 7 THEN {_CID("Review", "review", "evidence")}
  ELSE {_CID("Frame", "frame", "normative")} || ',' || {_CID("Given", "data", "data")} || ',' || {_CID("Return", "return", "normative")} END AS warrant,
  CASE WHEN o_orderkey % 2 = 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 13 = 7) THEN NULL WHEN o_orderkey % 3 = 0 THEN 'the warrant does not match the book' ELSE 'a warrant is required' END AS reason
  FROM orders WHERE o_orderkey % 13 IN (0, 7)""",
    "packet_stamps": """SELECT o_orderkey AS packet, 'sha256:' || sha256('{"move":"request","parents":[],"body":[{"kind":"Given","payload":"{}"},{"kind":"Return","payload":"{}"}]}') AS stamped,
  CASE WHEN o_orderkey % 3 = 0 THEN 'no content id to verify' WHEN o_orderkey % 2 = 0 THEN 'content id mismatch' END AS reason FROM orders WHERE o_orderkey % 13 = 9""",
    "packet_frames": """SELECT o_orderkey AS packet, CASE o_orderkey % 5 WHEN 0 THEN 'You MUST produce w' || o_orderkey || ' for t.' WHEN 1 THEN 'Check a/b.'
  WHEN 2 THEN 'You MUST produce the requested proposal.' END AS sentence, CASE WHEN o_orderkey % 5 = 4 THEN 'frame forbid has unknown hole more' END AS reason FROM orders""",
    "packet_ownership": """SELECT c_custkey::BIGINT AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'unowned bytes at ' || (strlen(c_name) + 7) WHEN c_custkey % 5 = 0 THEN 'unowned trailing bytes' END AS reason FROM customer""",
    "weave_shapes": """SELECT c_custkey::BIGINT AS doc_id, '{"shape":"WeaveResult","slots":[{"slot":"s' || c_custkey || '","head":"h"},{"slot":"b","head":"g"}]}' AS shape FROM customer""",
    "string_literals": """SELECT doc_id, '"' || replace(replace(replace(replace(replace(replace(t, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), chr(1), '\\u{1}') || '"' AS literal,
  true AS same, NULL::VARCHAR AS error FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(1) || '\\' ELSE chr(9) || '"é' END AS t FROM documents)""",
    "base64_strict": f"""SELECT {_E}, CASE WHEN {_E} % 8 < 2 THEN lpad({_E}::VARCHAR, 9, '0') WHEN {_E} % 8 = 2 THEN 'AB' END AS text, CASE {_E} % 8 WHEN 3 THEN 'non-zero base64 padding bits'
  WHEN 4 THEN 'invalid base64 padding' WHEN 5 THEN 'invalid base64 length' WHEN 6 THEN 'invalid base64 byte' WHEN 7 THEN 'invalid base64 padding' END AS error FROM events""",
    "stable_hashes": """SELECT doc_id, lower(lpad(hex(h::UBIGINT), 16, '0')) AS hash FROM (SELECT c_custkey::BIGINT AS doc_id,
  list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(strlen(c_name || 'é')), lambda i: ('0x' || substr(hex(encode(c_name || 'é')), 2 * i + 1, 2))::INT::HUGEINT)),
    lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::HUGEINT) AS h FROM customer)""",
    "json_nested": f"""SELECT {_E}, '{{"$expr":"map","entries":[{{"key":{{"$expr":"symbol","name":"id"}},"value":{{"$expr":"number","domain":"numbers/f64","value":"' || {_E}
  || '"}}}},{{"key":{{"$expr":"symbol","name":"list"}},"value":{{"$expr":"list","items":[{{"$expr":"string","value":"' || {_E} || '"}},{{"$expr":"nil"}},{{"$expr":"bool","value":true}},{{"$expr":"number","domain":"numbers/f64","value":"1.50"}}]}}}}'
  || ',{{"key":{{"$expr":"symbol","name":"in"}},"value":{{"$expr":"map","entries":[{{"key":{{"$expr":"symbol","name":"x,y"}},"value":{{"$expr":"map","entries":[]}}}}]}}}}'
  || ',{{"key":{{"$expr":"symbol","name":"digits"}},"value":{{"$expr":"number","domain":"numbers/f64","value":"12345678901234567890123.5"}}}}]}}' AS tagged, 15::BIGINT AS n_nodes, 3 AS depth FROM events""",
    "json_limits": f"""SELECT {_E}, CASE WHEN {_E} % 7 = 0 THEN 'decode depth limit exceeded: 9 > 8' WHEN {_E} % 50 + 1 > 20 THEN 'decode nodes limit exceeded: ' || ({_E} % 50 + 1) || ' > 20' END AS error FROM events""",
    "json_domains": f"""SELECT {_E}, 'a' AS key, 'string' AS domain, {_E}::VARCHAR AS canonical FROM events UNION ALL SELECT {_E}, 'b', 'number', {_E}::VARCHAR FROM events
  UNION ALL SELECT {_E}, 'c', 'string', 'true' FROM events UNION ALL SELECT {_E}, 'd', 'bool', 'true' FROM events UNION ALL SELECT {_E}, 'e', 'nil', NULL FROM events
  UNION ALL SELECT {_E}, 'f', 'list', '[1]' FROM events UNION ALL SELECT {_E}, 'g', 'number', '12345678901234567890123.5' FROM events""",
    "json_untag": f"""WITH i AS (SELECT {_E}, CASE {_E} % 6 WHEN 0 THEN 'number' WHEN 3 THEN 'string' WHEN 4 THEN 'bool' END AS kind, CASE WHEN {_E} % 6 = 0 THEN 'numbers/f64' END AS domain,
  CASE {_E} % 6 WHEN 0 THEN {_E}::VARCHAR WHEN 3 THEN {_E}::VARCHAR WHEN 4 THEN 'true' END AS text, CASE {_E} % 6 WHEN 1 THEN 'number needs domain' WHEN 2 THEN 'unknown $expr what' WHEN 5 THEN 'missing $expr' END AS error FROM events)
  SELECT {_E}, CASE WHEN {_E} % 2 = 0 THEN 0 ELSE 1 END AS ix, kind, domain, text, error FROM i
  UNION ALL SELECT {_E}, 1, 'nil', NULL, NULL, NULL FROM events WHERE {_E} % 2 = 0 UNION ALL SELECT {_E}, 0, 'symbol', NULL, 'k', NULL FROM events WHERE {_E} % 2 = 1""",
}

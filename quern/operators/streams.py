"""Streamed answers of three wires folded into one row each, from frames in any order; as batches or as Structured Streaming.

``frames`` has ``response_id``, ``frame_ix``, ``event`` (of server-sent events) and ``data``.  The first frame, in order, that cannot be read
makes the answer a failure (``error``, nothing else); one that reports an error of the model makes that the answer: its text is the message and
its stop reason ``error``.  Frames that come twice count once.  An answer of more frames than the collection limit is a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.json import bool_at, count_at, kind_at, parsed, string_at
from quern.functions.limits import collection_length

from .transcripts import saturating_total

DONE = "[DONE]"


def _fault(v: Column) -> Column:
    """What a model's error says: its text, its message or its type."""
    return F.coalesce(string_at(v, "$.error"), string_at(v, "$.error.message"), string_at(v, "$.error.type"))


def _unreadable(v: Column, wire: str) -> Column:
    return F.when(v.isNull(), f"{wire} stream returned invalid json").when(kind_at(v) != "map", f"{wire} stream chunk must be a json object")


def _live(frames: DataFrame, gap: str | None, delay: str) -> tuple[DataFrame, list]:
    """Frames and the columns to group them by; with ``gap`` a stream with event time ``at``."""
    if gap is None:
        return frames, [F.col("response_id")]
    rows = frames.withWatermark("at", delay).dropDuplicatesWithinWatermark(["response_id", "frame_ix"])
    return rows, [F.col("response_id"), F.session_window("at", gap)]


def _parsed(frames: DataFrame, data: Column) -> DataFrame:
    """``frames`` with the VARIANT ``v`` of their data, worked out once."""
    return frames.withColumn("v", parsed(data))


def _gather(frames: DataFrame, fields: dict[str, Column], gap: str | None, delay: str) -> DataFrame:
    """One row for each answer with its frames, in order, as the array ``f`` of ``ix`` and the fields."""
    rows, keys = _live(frames, gap, delay)
    rows = rows.select(*[c for c in ("response_id", "at") if c in rows.columns], F.struct(F.col("frame_ix").alias("ix"), *[v.alias(k) for k, v in fields.items()]).alias("x"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set("x")).alias("f")).select("response_id", "f")


def _last(f: Column, name: str) -> Column:
    """The last value of a field that is there."""
    some = F.filter(f, lambda x: x[name].isNotNull())
    return F.get(some, F.size(some) - 1)[name]


def _joined(f: Column, name: str) -> Column:
    return F.array_join(F.transform(f, lambda x: x[name]), "")


def _answers(rows: DataFrame, wire: str, failures: Column, more: dict[str, Column]) -> DataFrame:
    """Answers from ``f`` and what was folded from it; ``failures`` are (``ix``, ``fail``, ``fault``) of frames that end the answer."""
    bad = F.get(F.array_sort(failures), 0)
    rows = rows.withColumns({"bad": bad, **more})
    size = F.size(F.filter("f", lambda x: x["chunk"]))
    failure = F.coalesce(F.col("bad.fail"), collection_length(F.filter("f", lambda x: x["chunk"])))
    failure = F.coalesce(failure, F.when((size == 0) & F.col("bad.fault").isNull(), f"{wire} stream did not contain any response chunks"))
    rows = rows.withColumns({"n_chunks": size.cast("long"), "error": failure, "fault": F.col("bad.fault")})
    ok, well = F.col("error").isNull(), F.col("error").isNull() & F.col("fault").isNull()
    total = F.when(F.col("input").isNotNull() & F.col("output").isNotNull(), saturating_total(F.col("input"), F.col("output")))
    columns = {
        "text": F.when(well, F.col("text")).when(ok, F.col("fault")),
        "stop_reason": F.when(well, F.coalesce("reason", F.lit("stop"))).when(ok, "error"),
        "input_tokens": F.when(well, F.col("input")),
        "output_tokens": F.when(well, F.col("output")),
        "total_tokens": F.when(well, F.col("total") if "total" in more else total),
        "n_chunks": F.col("n_chunks"),
        "error": F.col("error"),
    }
    rest = {k: F.when(well, F.col(k)) for k in more if k not in ("text", "reason", "input", "output", "total")}
    return rows.select("response_id", *[v.alias(k) for k, v in (columns | rest).items()])


def _frame_failures() -> Column:
    bad = F.filter("f", lambda x: x["fail"].isNotNull() | x["fault"].isNotNull())
    return F.transform(bad, lambda x: F.struct(x["ix"].alias("ix"), x["fail"].alias("fail"), x["fault"].alias("fault")))


def openai(frames: DataFrame, gap: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Answers of the chat-completions wire: deltas in order, the last finish reason and the last usage."""
    data = F.trim("data")
    chunk, v = data != DONE, F.col("v")
    usage = kind_at(v, "$.usage") == "map"
    fields = {
        "chunk": chunk,
        "fail": F.when(chunk, _unreadable(v, "openai")),
        "fault": F.when(chunk, _fault(v)),
        "text": string_at(v, "$.choices[0].delta.content"),
        "reason": string_at(v, "$.choices[0].finish_reason"),
        "usage": F.when(usage, F.struct(*[count_at(v, f"$.usage.{k}").alias(a) for k, a in (("prompt_tokens", "i"), ("completion_tokens", "o"), ("total_tokens", "t"))])),
    }
    f = F.col("f")
    last = _last(f, "usage")
    more = {"text": _joined(f, "text"), "reason": _last(f, "reason"), "input": last["i"], "output": last["o"], "total": last["t"]}
    return _answers(_gather(_parsed(frames, data), fields, gap, delay), "openai", _frame_failures(), more)


def ollama(frames: DataFrame, gap: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Answers of the chat wire, a JSON object a line: the texts in order, the last reason and the last counters."""
    data = F.trim("data")
    chunk, v = data != "", F.col("v")
    i, o = count_at(v, "$.prompt_eval_count"), count_at(v, "$.eval_count")
    fields = {
        "chunk": chunk,
        "fail": F.when(chunk, _unreadable(v, "ollama")),
        "fault": F.lit(None).cast("string"),
        "text": F.coalesce(string_at(v, "$.message.content"), string_at(v, "$.response")),
        "reason": F.coalesce(string_at(v, "$.done_reason"), F.when(bool_at(v, "$.done"), "stop")),
        "usage": F.when(i.isNotNull() | o.isNotNull(), F.struct(i.alias("i"), o.alias("o"))),
    }
    f = F.col("f")
    last = _last(f, "usage")
    more = {"text": _joined(f, "text"), "reason": _last(f, "reason"), "input": last["i"], "output": last["o"]}
    return _answers(_gather(_parsed(frames, data), fields, gap, delay), "ollama", _frame_failures(), more)


TOOLS = ("tool_use", "server_tool_use")


def anthropic(frames: DataFrame, gap: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Answers of the messages wire: blocks in the order of their index, of texts or tool calls, with ``model``, ``span_id`` and ``content``.

    ``content`` has (``index``, ``kind``, ``text``, ``id``, ``name``, ``arguments``); ``text`` joins the text blocks.  A block that starts
    anew is another.  A delta of the other kind than its block's is a failure, as is a tool call whose pieces are no JSON when it stops.
    """
    v, event = F.col("v"), F.col("event")
    of_block = F.startswith(event, F.lit("content_block_"))
    start, delta, stop = (event == f"content_block_{x}" for x in ("start", "delta", "stop"))
    index = count_at(v, "$.index")
    kind_of = string_at(v, "$.delta.type")
    fail = (
        F.when(v.isNull(), "anthropic stream returned invalid json")
        .when(_fault(v).isNotNull(), None)
        .when(of_block & index.isNull(), "anthropic stream event missing index")
        .when(start & ~kind_at(v, "$.content_block").eqNullSafe("map"), "anthropic content_block_start missing content_block")
        .when(delta & ~kind_at(v, "$.delta").eqNullSafe("map"), "anthropic content_block_delta missing delta")
    )
    is_tool = F.coalesce(string_at(v, "$.content_block.type").isin(*TOOLS), F.lit(False))
    i, o = count_at(v, "$.usage.input_tokens"), count_at(v, "$.usage.output_tokens")
    fields = {
        "chunk": F.lit(True),
        "fail": fail,
        "fault": _fault(v),
        "event": event,
        "index": F.when(of_block, index),
        "kind": F.when(start, F.when(is_tool, "tool-call").otherwise("text")).when(delta, F.when(kind_of.isin("text_delta", "thinking_delta"), "text").when(kind_of == "input_json_delta", "tool-call")),
        "piece": F.when(start, string_at(v, "$.content_block.text")).when(delta, F.coalesce(string_at(v, "$.delta.text"), string_at(v, "$.delta.thinking"), string_at(v, "$.delta.partial_json"))),
        "id": F.coalesce(string_at(v, "$.content_block.id"), string_at(v, "$.message.id")),
        "name": F.coalesce(string_at(v, "$.content_block.name"), string_at(v, "$.message.model")),
        "input": F.to_json(F.try_variant_get(v, "$.content_block.input", "variant")),
        "reason": F.when(event == "message_delta", F.replace(string_at(v, "$.delta.stop_reason"), F.lit("_"), F.lit("-"))),
        "usage": F.when((event == "message_delta") & (i.isNotNull() | o.isNotNull()), F.struct(i.alias("i"), o.alias("o"))),
    }
    rows = _gather(_parsed(frames, F.col("data")), fields, gap, delay)
    ends = F.filter("f", lambda x: x["event"] == "message_stop")
    end = F.get(ends, F.size(ends) - 1)["ix"]
    rows = rows.withColumn("b", F.filter("f", lambda x: end.isNull() | (x["ix"] <= end)))
    placed = F.filter("b", lambda x: x["index"].isNotNull() & x["kind"].isNotNull())
    rows = rows.withColumn("at", F.array_sort(F.array_distinct(F.transform(placed, lambda x: x["index"]))))

    def block(n: Column) -> Column:
        own = F.filter("b", lambda x: x["index"] == n)
        starts = F.filter(own, lambda x: x["event"] == "content_block_start")
        first = F.get(starts, F.size(starts) - 1)
        after = F.filter(own, lambda x: x["ix"] > F.coalesce(first["ix"], F.lit(-1)))
        deltas = F.filter(after, lambda x: (x["event"] == "content_block_delta") & x["kind"].isNotNull())
        stops = F.filter(after, lambda x: x["event"] == "content_block_stop")
        closed = F.get(stops, F.size(stops) - 1)["ix"]
        kind = F.coalesce(first["kind"], F.get(deltas, 0)["kind"])
        body = _joined(F.filter(deltas, lambda x: (kind == "text") | (x["ix"] < closed)), "piece")
        tool = kind == "tool-call"
        pieces = F.when(tool & (F.trim(body) != ""), body)
        other = F.filter(deltas, lambda x: x["kind"] != kind)
        bad = F.concat(
            F.transform(other, lambda x: F.struct(x["ix"].alias("ix"), F.concat(F.lit("anthropic delta of another kind arrived for block of "), kind).alias("fail"), F.lit(None).cast("string").alias("fault"))),
            F.when(pieces.isNotNull() & parsed(pieces).isNull(), F.array(F.struct(closed.alias("ix"), F.lit("anthropic tool-use partial json invalid").alias("fail"), F.lit(None).cast("string").alias("fault")))).otherwise(
                F.array().cast("array<struct<ix:int,fail:string,fault:string>>")
            ),
        )
        return F.struct(
            n.alias("index"),
            kind.alias("kind"),
            F.when(~tool, F.concat(F.coalesce(first["piece"], F.lit("")), body)).alias("text"),
            F.when(tool, F.coalesce(first["id"], F.lit("toolu_stream"))).alias("id"),
            F.when(tool, F.coalesce(first["name"], F.lit("tool"))).alias("name"),
            F.when(tool, F.coalesce(F.to_json(parsed(pieces)), first["input"], F.lit("{}"))).alias("arguments"),
            bad.alias("bad"),
        )

    rows = rows.withColumn("made", F.transform("at", block))
    failures = F.concat(_frame_failures(), F.flatten(F.transform("made", lambda x: x["bad"])))
    starts = F.filter("b", lambda x: x["event"] == "message_start")
    b = F.col("b")
    last = _last(b, "usage")
    content = F.transform("made", lambda x: F.struct(*[x[k].alias(k) for k in ("index", "kind", "text", "id", "name", "arguments")]))
    more = {
        "text": F.array_join(F.transform(F.filter("made", lambda x: x["kind"] == "text"), lambda x: x["text"]), ""),
        "reason": _last(b, "reason"),
        "input": last["i"],
        "output": last["o"],
        "model": _last(starts, "name"),
        "span_id": _last(starts, "id"),
        "content": content,
    }
    return _answers(rows, "anthropic", failures, more)


def stamped(answers: DataFrame, provider: str) -> DataFrame:
    """Answers with the provider that gave them; a column of that name is replaced.  Providers of the chat-completions wire differ by nothing else."""
    return answers.withColumn("provider", F.lit(provider))

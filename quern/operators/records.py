"""Records of a model transcript as JSON: requests, responses, events and cards; their parts, tool calls, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.json import bool_at, items_at, kind_at, parsed, string_at
from quern.functions.values import bind, repeated_keys

# The markers of the four records, and the fields that each needs with their kinds; "any" is a field of any kind.
RECORDS = {
    "model-request": (("task", "any"), ("messages", "list")),
    "model-response": (("runner", "string"), ("model", "string"), ("stop-reason", "string"), ("content", "list")),
    "model-event": (("event", "string"), ("runner", "string"), ("model", "string"), ("span-id", "any")),
    "model-card": (("runner", "string"), ("model", "string"), ("provider", "string"), ("locality", "string")),
}
# The same for the parts of a content.
PARTS = {
    "text": (("text", "string"),),
    "tool-call": (("id", "string"), ("name", "string"), ("arguments", "any")),
    "tool-result": (("tool-call-id", "string"), ("status", "string"), ("output", "any")),
}


def _path(name: str) -> str:
    return f'$["{name}"]'


def _alone(of):
    """A function of one argument, as lambdas of columns are told apart by how many they take."""
    return lambda x: of(x)


def _fields(v: Column, spec: tuple[tuple[str, str], ...], label: str) -> Column:
    """The first field of the spec that is missing or of another kind, as a reason."""
    reason = F.lit(None).cast("string")
    for name, kind in spec:
        wrong = lambda found, name=name, kind=kind: F.when(found.isNull(), f"{label} has no {name}").when((found != kind) & (kind != "any"), f"{name} of {label} is no {kind}")
        reason = F.coalesce(reason, bind(kind_at(v, _path(name)), _alone(wrong)))
    return reason


def part_reason(part: Column) -> Column:
    """What is wrong with a part of a content, or null; parts of unknown or namespaced types are taken as they are."""
    return bind(string_at(part, "$.type"), lambda kind: _typed_part(part, kind))


def _typed_part(part: Column, kind: Column) -> Column:
    reason = F.when(~kind_at(part).eqNullSafe("map"), "a part is no map").when(kind.isNull(), "a part has no type")
    for name, spec in PARTS.items():
        reason = reason.when(kind == name, _fields(part, spec, name))
    return reason


def _first(items: Column, reason) -> Column:
    """The first reason that an item gives."""
    return F.get(F.array_compact(F.transform(items, reason)), 0)


def _message_reason(m: Column) -> Column:
    content = items_at(m, "$.content")
    reason = F.when(~kind_at(m).eqNullSafe("map"), "a message is no map").when(string_at(m, "$.role").isNull(), "a message has no role")
    return reason.when(content.isNull(), "a message has no content list").otherwise(_first(content, part_reason))


def _one(v: Column, names: tuple[str, ...]) -> Column:
    marked = {name: F.coalesce(bool_at(v, _path(name)), F.lit(False)) for name in RECORDS}
    count = sum((m.cast("int") for m in marked.values()), F.lit(0))
    reason = F.when(~kind_at(v).eqNullSafe("map"), "a record is no map").when(count != 1, "a record has exactly one marker")
    for name in names:
        own = _fields(v, RECORDS[name], name)
        if name == "model-request":
            own = F.coalesce(own, _first(items_at(v, "$.messages"), _message_reason))
        elif name == "model-response":
            own = F.coalesce(own, _first(items_at(v, "$.content"), part_reason))
        elif name == "model-event":
            inner = F.try_variant_get(v, "$.response", "variant")
            own = F.coalesce(own, F.when(kind_at(v, "$.response").isNotNull(), _one(inner, ("model-response",))))
        reason = reason.when(marked[name], own)
    return reason.otherwise("an event holds a response")


def record_reason(json: Column) -> Column:
    """What is wrong with a record, or null.  A field named twice, at any depth, makes it no record."""
    whole = lambda v: F.when(v.isNull(), "no JSON, or a field of a field is named twice").otherwise(_one(v, tuple(RECORDS)))
    return F.when(repeated_keys(json), "a field is named twice").otherwise(bind(parsed(json), whole))


def content_text(value: Column, path: str) -> Column:
    """A content as text: a string as it is, of a list the texts of its parts joined by blanks; null for anything else."""
    texts = F.array_compact(F.transform(items_at(value, path), lambda p: string_at(p, "$.text")))
    return F.coalesce(string_at(value, path), F.array_join(texts, " "))


def tool_calls(value: Column, path: str) -> Column:
    """Calls of the chat-completions wire at the path as (``id``, ``name``, ``arguments``, ``error``).

    Arguments come as JSON in a string; a blank string, null or nothing is an empty map, a value that is no string stays.
    """

    at = "$.function.arguments"

    def one(call: Column) -> Column:
        return bind(string_at(call, at), lambda text: bind(parsed(text), lambda inner: made(call, text, inner)))

    def made(call: Column, text: Column, inner: Column) -> Column:
        blank = kind_at(call, at).isNull() | (kind_at(call, at) == "nil") | (F.trim(text) == "")
        error = F.when(~blank & text.isNotNull() & inner.isNull(), "tool call arguments must be json")
        value_ = F.when(blank, "{}").when(text.isNotNull(), F.to_json(inner)).otherwise(F.to_json(F.try_variant_get(call, at, "variant")))
        return F.struct(string_at(call, "$.id").alias("id"), string_at(call, "$.function.name").alias("name"), value_.alias("arguments"), error.alias("error"))

    return F.transform(items_at(value, path), one)


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"))


def usage_record(input_tokens: Column, output_tokens: Column, total_tokens: Column) -> Column:
    """Counters as a struct whose null fields JSON leaves out."""
    return F.struct(input_tokens.alias("input-tokens"), output_tokens.alias("output-tokens"), total_tokens.alias("total-tokens"))


def response_record(runner: Column, model: Column, text: Column, stop: Column, usage: Column | None = None) -> Column:
    """A response record of one text."""
    fields = [F.lit(True).alias("model-response"), runner.alias("runner"), model.alias("model"), F.array(text_part(text)).alias("content"), stop.alias("stop-reason")]
    return F.to_json(F.struct(*fields, *([usage.alias("usage")] if usage is not None else [])))


def error_record(runner: Column, model: Column, message: Column) -> Column:
    """A response record that says what went wrong, in its content and beside it."""
    fields = [F.lit(True).alias("model-response"), runner.alias("runner"), model.alias("model"), F.array(text_part(message)).alias("content")]
    return F.to_json(F.struct(*fields, F.lit("error").alias("stop-reason"), message.alias("text"), F.lit(False).alias("shape-ok")))


def card_record(runner: Column, model: Column, provider: Column, locality: Column) -> Column:
    """A model's card with what is known of none: texts in and out, JSON, unknown health."""
    flags = {"supports-stream": False, "supports-tools": False, "supports-json": True, "supports-shape": False}
    given = {"runner": runner, "model": model, "provider": provider, "locality": locality}
    return F.to_json(
        F.struct(
            F.lit(True).alias("model-card"),
            *[c.alias(k) for k, c in given.items()],
            F.array(F.lit("text")).alias("modalities-in"),
            F.array(F.lit("text")).alias("modalities-out"),
            *[F.lit(x).alias(k) for k, x in flags.items()],
            F.lit("unknown").alias("health"),
        )
    )


def encode_openai_response(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``body`` of a chat-completions response from ``model``, ``text``, ``stop_reason`` and counters; null fields are left out."""
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.col("stop_reason").alias("finish_reason"))
    usage = F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens"), F.col("total_tokens"))
    body = F.struct(F.lit("chat.completion").alias("object"), "model", F.array(choice).alias("choices"), usage.alias("usage"))
    return rows.withColumn("body", F.to_json(body))


def decode_tool_response(rows: DataFrame) -> DataFrame:
    """The tool calls of a chat-completions response ``body``, a row each: ``call_ix``, ``id``, ``name``, ``arguments``, ``error``."""
    calls = tool_calls(parsed(F.col("body")), "$.choices[0].message.tool_calls")
    kept = [c for c in rows.columns if c != "body"]
    return rows.select(*kept, F.posexplode(calls).alias("call_ix", "c")).select(*kept, "call_ix", "c.*")

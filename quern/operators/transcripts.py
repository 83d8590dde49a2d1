"""Model transcripts: requests of several providers, validation, and streamed answers put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.json import items_at, parsed, string_at

from .records import content_text

PART = "struct<type:string,text:string>"
MESSAGES = "array<struct<role:string,content:string>>"
LONG_MAX = 9223372036854775807

#: Providers and the wire formats of their requests and streams (fixed values).
PROFILES = (
    ("anthropic", "messages", "sse"),
    ("lemonade", "chat-completions", "sse"),
    ("lm-studio", "chat-completions", "sse"),
    ("ollama", "chat", "ndjson"),
    ("openai", "chat-completions", "sse"),
)


def conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation with its messages in turn order."""
    message = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("ms"))
    return rows.select("conv_id", F.transform("ms", lambda x: x["m"]).alias("messages"))


def openai_request(rows: DataFrame, model: str) -> DataFrame:
    """Request body of the chat-completions wire."""
    return rows.withColumn("body", F.to_json(F.struct(F.lit(model).alias("model"), "messages")))


def anthropic_request(rows: DataFrame, model: str, max_tokens: int = 1024) -> DataFrame:
    """Request body of the messages wire: system texts, joined by a blank line, apart from the other messages."""
    system = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n")
    rest = F.filter("messages", lambda m: m["role"] != "system")
    rows = rows.withColumns({"system": F.when(system != "", system), "rest": rest})
    body = F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), "system", F.col("rest").alias("messages"))
    return rows.withColumn("body", F.to_json(body))


def ollama_request(rows: DataFrame, model: str) -> DataFrame:
    """Request body of the chat wire: the same messages, not streamed."""
    return rows.withColumn("body", F.to_json(F.struct(F.lit(model).alias("model"), "messages", F.lit(False).alias("stream"))))


def decode_request(rows: DataFrame, provider: str = "openai") -> DataFrame:
    """Model, task, prior messages and error of a request body: the last message is the task and must be the user's.

    ``rows`` has ``body``.  A content is a text or a list of parts, whose texts are joined.  With an error the other fields are null.
    """
    v = parsed(F.col("body"))
    messages = F.transform(items_at(v, "$.messages"), lambda m: F.struct(string_at(m, "$.role").alias("role"), content_text(m, "$.content").alias("content")))
    rows = rows.withColumn("_r", F.struct(string_at(v, "$.model").alias("model"), content_text(v, "$.system").alias("system"), messages.alias("messages")))
    n = F.coalesce(F.size("_r.messages"), F.lit(0))
    last = F.get("_r.messages", n - 1)
    error = (
        F.when(F.col("_r.model").isNull(), "model is missing")
        .when(n <= 0, "messages are missing")
        .when(~last["role"].eqNullSafe("user"), "the last message must be the user's")
        .when(last["content"].isNull(), "the last message has no content")
    )
    lead = F.when(F.col("_r.system").isNotNull(), F.array(F.struct(F.lit("system").alias("role"), F.col("_r.system").alias("content")))).otherwise(F.array().cast(MESSAGES))
    prior = F.concat(lead, F.slice("_r.messages", F.lit(1), F.greatest(n - 1, F.lit(0))))
    ok = F.col("error").isNull()
    rows = rows.withColumn("error", error)
    return rows.withColumns(
        {"provider": F.lit(provider), "model": F.when(ok, F.col("_r.model")), "task": F.when(ok, last["content"]), "prior": F.when(ok, prior)}
    ).drop("_r")


def validate(rows: DataFrame) -> DataFrame:
    """The first reason why a conversation is no valid transcript, or null."""
    known = F.forall("messages", lambda m: F.coalesce(m["role"].isin("system", "user", "assistant", "tool"), F.lit(False)))
    texts = F.forall("messages", lambda m: m["content"].isNotNull() & (F.length(m["content"]) > 0))
    late = F.exists(F.transform("messages", lambda m, i: F.when(i > 0, m["role"] == "system").otherwise(False)), lambda x: x)
    reason = (
        F.when(F.size("messages") == 0, "no messages")
        .when(~known, "unknown role")
        .when(~texts, "empty content")
        .when(late, "system message after the first")
        .when(F.get("messages", F.size("messages") - 1)["role"] != "user", "no task")
    )
    return rows.withColumn("reason", reason)


def saturating_total(a: Column, b: Column) -> Column:
    """The sum of two counters, at most the largest long."""
    return F.coalesce(F.try_add(a, b), F.lit(LONG_MAX))


def stream_frames(answers: DataFrame, piece: int) -> DataFrame:
    """Frames of a streamed answer: deltas of ``piece`` characters, a usage frame without choices, and the end mark."""
    n = F.ceil(F.length("text") / piece).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    content = lambda i: F.struct(F.substring("text", i * piece + 1, F.lit(piece)).alias("content"))
    delta = lambda i: F.to_json(F.struct(F.array(F.struct(content(i).alias("delta"))).alias("choices")))
    usage = F.to_json(F.struct(F.array().cast("array<string>").alias("choices"), F.struct(F.length("text").alias("completion_tokens")).alias("usage")))
    frames = F.concat(F.transform(at, delta), F.array(usage, F.lit("[DONE]")))
    return answers.select("response_id", F.posexplode(frames).alias("frame_ix", "data"))


def reassemble(frames: DataFrame) -> DataFrame:
    """The answers of streamed frames: text of the deltas in order, last usage, and whether the end mark came."""
    done = F.col("data") == "[DONE]"
    content = F.get_json_object("data", "$.choices[0].delta.content")
    tokens = F.get_json_object("data", "$.usage.completion_tokens").cast("long")
    parts = F.sort_array(F.collect_list(F.when(~done & content.isNotNull(), F.struct("frame_ix", content.alias("c")))))
    rows = frames.groupBy("response_id").agg(
        parts.alias("p"), F.max_by(tokens, F.when(tokens.isNotNull(), F.col("frame_ix"))).alias("output_tokens"), F.bool_or(done).alias("ended"), F.count(F.lit(1)).alias("n_frames")
    )
    return rows.select("response_id", F.array_join(F.transform("p", lambda x: x["c"]), "").alias("text"), "output_tokens", "ended", "n_frames")


def usage_totals(rows: DataFrame, by: str) -> DataFrame:
    """Input, output and total tokens of each group; the total saturates.  ``rows`` has the two counters."""
    sums = rows.groupBy(by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return sums.withColumn("total_tokens", saturating_total(F.col("input_tokens"), F.col("output_tokens")))


#: Where the parts of an answer lie on each wire: text, stop reason, input and output tokens.
ANSWERS = {
    "openai": ("$.choices[0].message.content", "$.choices[0].finish_reason", "$.usage.prompt_tokens", "$.usage.completion_tokens"),
    "anthropic": (None, "$.stop_reason", "$.usage.input_tokens", "$.usage.output_tokens"),
    "ollama": ("$.message.content", "$.done_reason", "$.prompt_eval_count", "$.eval_count"),
}


def decode_response(rows: DataFrame, provider: Column) -> DataFrame:
    """Text, stop reason, usage and error of an answer's ``body`` on the wire of its ``provider``.

    The reason is ``stop`` where none is given.  A body with an ``error`` has only that: its message, its type, or itself.  Text blocks of
    the messages wire are joined; the chat wire may have ``response`` in place of a message.  Unknown providers are errors.
    """
    at = lambda path: F.get_json_object("body", path)
    blocks = F.filter(F.from_json(at("$.content"), "array<struct<type:string,text:string>>"), lambda b: b["type"] == "text")
    pick = lambda i: F.coalesce(*[F.when(provider == p, at(paths[i])) for p, paths in ANSWERS.items() if paths[i]])
    text = F.coalesce(pick(0), F.when(provider == "anthropic", F.array_join(F.transform(blocks, lambda b: b["text"]), "")), F.when(provider == "ollama", at("$.response")))
    failed = F.coalesce(at("$.error.message"), at("$.error.type"), at("$.error"))
    error = F.when(~F.coalesce(provider.isin(*ANSWERS), F.lit(False)), "unknown provider").when(failed.isNotNull(), failed).when(text.isNull(), "no text")
    rows = rows.withColumns({"_text": text, "error": error, "_stop": F.coalesce(pick(1), F.lit("stop")), "_in": pick(2).cast("long"), "_out": pick(3).cast("long")})
    ok = lambda c: F.when(F.col("error").isNull(), c)
    return rows.withColumns(
        {
            "text": ok(F.col("_text")),
            "stop_reason": F.when(F.col("error").isNull(), F.col("_stop")).otherwise("error"),
            "input_tokens": ok(F.col("_in")),
            "output_tokens": ok(F.col("_out")),
            "total_tokens": ok(saturating_total(F.coalesce("_in", F.lit(0).cast("long")), F.coalesce("_out", F.lit(0).cast("long")))),
        }
    ).drop("_text", "_stop", "_in", "_out")

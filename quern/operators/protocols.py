"""Protocol checks: message envelopes, dialogue moves and part profiles, and the integrity of index records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.json import keys_at, kind_at, parsed, string_at
from quern.functions.values import bind, quoted, repeated_keys

# The standard moves with what they may answer, and the parts they require.
MOVES = (
    # intent, rule, answers, required part, any of these parts, ends the dialogue
    ("request", "opens", (), "Return", ("Frame", "Call", "Weave"), False),
    ("offer", "only", ("request",), "Return", (), False),
    ("reply", "only", ("request",), "Return", (), False),
    ("review", "only", ("offer", "reply", "patch"), "Review", (), False),
    ("vote", "only", ("offer", "reply"), "Vote", (), False),
    ("patch", "only", ("receipt", "review", "reply"), "Patch", (), False),
    ("fetch", "any-non-receipt", (), "Fetch", (), False),
    ("receipt", "any-non-receipt", (), "Receipt", (), True),
    ("attest", "only", ("reply", "receipt"), "Attest", (), True),
    ("error", "any", (), "Receipt", (), True),
)
# Profiles as patterns over the initials of part kinds.
PART_LETTERS = {"Given": "G", "Frame": "F", "Return": "R", "Call": "C", "Weave": "W", "Evidence": "E", "Review": "V", "Vote": "O", "Patch": "P", "Receipt": "T", "Attest": "A"}
#: Parts by which collaborators answer each other.
COLLAB = ("Evidence", "Review", "Vote", "Patch", "Receipt", "Attest")
PROFILES = (("ask", "^G*F*C+R$"), ("brief", "^G*F+R?$"), ("collab", "^[EVOPTA]+$"), ("loom", "^G*F*W+R$"))

ENVELOPES = (
    # kind, fields it must have, fields it may have besides
    ("request", ("id", "method"), ("params",)),
    ("notification", ("method",), ("params",)),
    ("response", ("id", "result"), ()),
    ("error", ("id", "error"), ()),
)


def move_book(spark: SparkSession) -> DataFrame:
    """The standard moves, a row each."""
    rows = [(i, r, list(a), p, list(x), e) for i, r, a, p, x, e in MOVES]
    return spark.createDataFrame(rows, "intent string, rule string, answers array<string>, required string, any_of array<string>, terminal boolean")


def legal_replies(dialogues: DataFrame) -> DataFrame:
    """Intents that may follow the ``parents`` of each dialogue, a row for each; the book is a constant in the plan."""
    parents = F.col("parents")

    def legal(rule: str, answers: tuple[str, ...]) -> Column:
        if rule == "opens":
            return F.size(parents) == 0
        some = F.size(parents) > 0
        if rule == "only":
            return some & F.forall(parents, lambda p: p.isin(*answers))
        return some & ~F.array_contains(parents, "receipt") if rule == "any-non-receipt" else some

    intents = F.array(*[F.when(legal(rule, answers), F.lit(i)) for i, rule, answers, *_ in MOVES])
    return dialogues.select("dialogue", F.explode(F.array_compact(intents)).alias("intent"))


def check_parts(packets: DataFrame, moves: DataFrame) -> DataFrame:
    """The first reason why a packet's ``parts`` don't suit its ``intent``, or null."""
    rows = packets.join(F.broadcast(moves), "intent", "left")
    reason = (
        F.when(F.col("rule").isNull(), F.concat(F.lit("unknown move "), F.col("intent")))
        .when(~F.array_contains("parts", F.col("required")), F.concat("intent", F.lit(" requires a "), "required", F.lit(" part")))
        .when((F.size("any_of") > 0) & ~F.arrays_overlap("parts", "any_of"), F.concat("intent", F.lit(" requires "), F.array_join("any_of", " or ")))
    )
    return rows.select(*packets.columns, reason.alias("reason"))


def part_letters(kinds: Column) -> Column:
    letters = F.create_map(*[F.lit(x) for pair in PART_LETTERS.items() for x in pair])
    return F.array_join(F.transform(kinds, lambda k: F.coalesce(F.element_at(letters, k), F.lit("?"))), "")


def matching_profiles(kinds: Column) -> Column:
    """Names of the profiles whose pattern the ordered part kinds match; a packet must match exactly one."""
    letters = part_letters(kinds)
    return F.filter(F.array(*[F.when(letters.rlike(p), F.lit(n)) for n, p in PROFILES]), lambda x: x.isNotNull())


def envelope(json: Column) -> Column:
    """A JSON-RPC envelope as (``kind``, ``id``, ``method``, ``body``, ``code``, ``message``).

    Which of method, id, result and error are present decides the kind; the kind is ``invalid: `` and the first reason where the version is not the
    string 2.0, a field is unknown or named twice, an id is neither string, number nor null, a method no string, or an error no map of an integer
    ``code``, a string ``message`` and perhaps ``data``.  ``id`` is JSON; ``body`` is the JSON of params, result or the error's data.
    """
    return bind(parsed(json), lambda v: bind(keys_at(v), lambda keys: _envelope(json, v, keys)))


def _envelope(json: Column, v: Column, keys: Column) -> Column:
    owned = ("method", "id", "result", "error")
    of = {k: F.coalesce(F.array_contains(keys, k), F.lit(False)) for k in owned}
    bad_id = of["id"] & ~kind_at(v, "$.id").isin("string", "number", "nil")
    bad_method = of["method"] & (kind_at(v, "$.method") != "string")
    error_keys = keys_at(v, "$.error")
    bad_error = (
        F.when(error_keys.isNull(), "error is no object")
        .when(F.size(F.array_except(error_keys, F.array(*[F.lit(x) for x in ("code", "message", "data")]))) > 0, "error has an unknown field")
        .when(~F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.error.code", "variant")) == "BIGINT", F.lit(False)), "error code is no integer")
        .when(~kind_at(v, "$.error.message").eqNullSafe("string"), "error message is no string")
    )
    kind = None
    for name, must, may in ENVELOPES:
        present = [of[k] if k in must else ~of[k] for k in owned]
        extra = F.size(F.array_except(keys, F.array(*[F.lit(x) for x in ("jsonrpc", *must, *may)]))) > 0
        value = F.when(extra, f"invalid: {name} has an unknown field").when(bad_id, "invalid: id").when(bad_method, "invalid: method")
        if name == "error":
            value = value.when(bad_error.isNotNull(), F.concat(F.lit("invalid: "), bad_error))
        test = reduce(lambda a, b: a & b, present)
        kind = F.when(test, value.otherwise(name)) if kind is None else kind.when(test, value.otherwise(name))
    first = (
        F.when(repeated_keys(json), "invalid: a field is named twice")
        .when(v.isNull(), "invalid: no JSON, or a field of a field is named twice")
        .when(kind_at(v) == "list", "invalid: batch")
        .when(kind_at(v) != "map", "invalid: not an object")
        .when(~string_at(v, "$.jsonrpc").eqNullSafe("2.0"), "invalid: version")
    )
    kind = first.otherwise(kind.otherwise("invalid: field combination"))
    part = lambda path: F.to_json(F.try_variant_get(v, path, "variant"))
    body = F.coalesce(part("$.params"), part("$.result"), part("$.error.data"))
    fields = {"id": part("$.id"), "method": string_at(v, "$.method"), "body": body, "code": F.try_variant_get(v, "$.error.code", "long"), "message": string_at(v, "$.error.message")}
    return bind(kind, lambda k: F.struct(k.alias("kind"), *[F.when(~F.startswith(k, F.lit("invalid")), c).alias(n) for n, c in fields.items()]))


def classify_envelope(json: Column) -> Column:
    """The kind of :func:`envelope`."""
    return envelope(json)["kind"]


def envelope_json(e: Column) -> Column:
    """The JSON of an :func:`envelope`, fields in the order of the protocol; null for an invalid one."""
    body = F.coalesce(e["body"], F.lit("null"))
    tail = (
        F.when(e["kind"] == "request", F.concat(F.lit(',"id":'), e["id"], F.lit(',"method":'), quoted(e["method"]), F.lit(',"params":'), body))
        .when(e["kind"] == "notification", F.concat(F.lit(',"method":'), quoted(e["method"]), F.lit(',"params":'), body))
        .when(e["kind"] == "response", F.concat(F.lit(',"id":'), e["id"], F.lit(',"result":'), body))
        .when(e["kind"] == "error", F.concat(F.lit(',"id":'), e["id"], F.lit(',"error":{"code":'), e["code"].cast("string"), F.lit(',"message":'), quoted(e["message"]), F.lit(',"data":'), body, F.lit("}")))
    )
    return F.concat(F.lit('{"jsonrpc":"2.0"'), tail, F.lit("}"))


def dangling(records: DataFrame, key: str, targets: DataFrame, target: str, label: str) -> DataFrame:
    """References of ``records`` to targets that don't exist, with how often each occurs; null references are none."""
    missing = records.where(F.col(key).isNotNull()).join(targets.select(F.col(target).alias(key)).distinct(), key, "left_anti")
    return missing.groupBy(F.col(key).cast("string").alias("ref")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("relation"), "ref", "n")


def integrity(*relations: DataFrame) -> DataFrame:
    """All violations of several relations."""
    return reduce(DataFrame.unionByName, relations)

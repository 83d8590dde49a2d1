"""JSON texts as typed values: what lies at a path and of which kind, tokens, node counts, depth, and nested tagged form.

Kinds come from Spark's VARIANT, so a string is never taken for a number.  Digits of numbers are read from the text itself, token by token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .limits import exceeded, first_error
from .values import bind, kind_of, tagged_number, variant_kind

TOKEN = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null|[\[\]{}:,]'


def parsed(json: Column) -> Column:
    """The text as a VARIANT; null where it is no JSON."""
    return F.try_parse_json(json)


def kind_at(value: Column, path: str = "$") -> Column:
    """``string number bool nil list map`` of what lies at the path, or null where nothing does."""
    return variant_kind(value) if path == "$" else kind_of(lambda as_type: F.try_variant_get(value, path, as_type))


def string_at(value: Column, path: str) -> Column:
    """The string at the path; null for any other kind."""
    return F.when(kind_at(value, path) == "string", F.try_variant_get(value, path, "string"))


def count_at(value: Column, path: str) -> Column:
    """The integer of at least zero at the path; null for anything else, also for 1.0."""
    got = F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "BIGINT", F.try_variant_get(value, path, "long"))
    return F.when(got >= 0, got)


def bool_at(value: Column, path: str) -> Column:
    return F.when(kind_at(value, path) == "bool", F.try_variant_get(value, path, "boolean"))


def items_at(value: Column, path: str) -> Column:
    """The items of the list at the path, as VARIANTs; null for any other kind."""
    return F.try_variant_get(value, path, "array<variant>")


def keys_at(value: Column, path: str = "$") -> Column:
    """The field names of the map at the path, in the order of names; null for any other kind."""
    return F.map_keys(F.try_variant_get(value, path, "map<string,variant>"))


def tokens(json: Column) -> Column:
    """The tokens of a JSON text."""
    return F.regexp_extract_all(json, F.lit(TOKEN), 0)


def _is_key(ts: Column, i: Column) -> Column:
    return F.startswith(F.get(ts, i), F.lit('"')) & F.coalesce(F.get(ts, i + 1) == ":", F.lit(False))


def node_count(ts: Column) -> Column:
    """How many values the tokens hold, the outermost included; names of fields are nodes too."""
    return F.size(F.filter(ts, lambda t: ~t.isin("]", "}", ":", ",")))


def depth(ts: Column) -> Column:
    """How deep the value is nested; a scalar has depth 1, and so has an empty list."""
    move = lambda t: F.when(t.isin("[", "{"), 1).when(t.isin("]", "}"), -1).otherwise(0)
    here = lambda a, t: F.when(t.isin("]", "}", ":", ","), 0).otherwise(a["now"] + 1)
    step = lambda a, t: F.struct((a["now"] + move(t)).alias("now"), F.greatest(a["most"], here(a, t)).alias("most"))
    return F.aggregate(ts, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def limits_error(json: Column, nodes: int | None = None, most: int | None = None) -> Column:
    """The error of a JSON text with too many nodes or nested too deep, or null."""
    return bind(tokens(json), lambda ts: first_error(exceeded("nodes", node_count(ts), nodes), exceeded("depth", depth(ts), most)))


def tagged(json: Column) -> Column:
    """A plain JSON text as tagged JSON, nested: names of fields become symbols, numbers keep their digits, the order of fields stays.

    Works on the tokens, each by its neighbours alone: a comma before a name closes an entry, as does the end of a map.
    Null where the text is no JSON.
    """

    def one(ts: Column, t: Column, i: Column) -> Column:
        before, after = F.get(ts, i - 1), i + 1
        scalar = F.when(F.startswith(t, F.lit('"')), F.concat(F.lit('{"$expr":"string","value":'), t, F.lit("}")))
        scalar = scalar.when(t.isin("true", "false"), F.concat(F.lit('{"$expr":"bool","value":'), t, F.lit("}"))).when(t == "null", '{"$expr":"nil"}')
        return (
            F.when(t == ":", "")
            .when(t == "[", '{"$expr":"list","items":[')
            .when(t == "{", '{"$expr":"map","entries":[')
            .when(t == "]", "]}")
            .when(t == "}", F.when(before == "{", "]}").otherwise("}]}"))
            .when(t == ",", F.when(_is_key(ts, after), "},").otherwise(","))
            .when(_is_key(ts, i), F.concat(F.lit('{"key":{"$expr":"symbol","name":'), t, F.lit('},"value":')))
            .otherwise(scalar.otherwise(tagged_number(t)))
        )

    made = bind(tokens(json), lambda ts: F.array_join(F.transform(ts, lambda t, i: one(ts, t, i)), ""))
    return F.when(parsed(json).isNotNull(), made)


#: The tags of scalar tagged values with the fields that each needs, and the kinds of these.
SCALARS = {"nil": (), "bool": (("value", "bool"),), "number": (("domain", "string"), ("value", "string")), "string": (("value", "string"),),
           "symbol": (("name", "string"),), "bytes": (("base64", "string"),)}
SEQUENCES = ("list", "vector", "set", "block")


def untagged_scalar(value: Column) -> Column:
    """A tagged scalar as (``kind``, ``domain``, ``text``, ``error``): text is what was written, a bool as true or false."""
    return bind(string_at(value, '$["$expr"]'), lambda tag: _scalar(value, tag))


def _scalar(value: Column, tag: Column) -> Column:
    need = [(t, f, k) for t, fields in SCALARS.items() for f, k in fields]
    error = F.when(tag.isNull(), "missing $expr").when(~tag.isin(*SCALARS, *SEQUENCES, "map"), F.concat(F.lit("unknown $expr "), tag))
    for t, f, k in need:
        error = error.when((tag == t) & ~kind_at(value, f"$.{f}").eqNullSafe(k), f"{t} needs {f}")
    for t in SEQUENCES:
        error = error.when((tag == t) & items_at(value, "$.items").isNull(), f"{t} needs items")
    error = error.when((tag == "map") & items_at(value, "$.entries").isNull(), "map needs entries")
    text = F.coalesce(F.try_variant_get(value, "$.value", "string"), string_at(value, "$.name"), string_at(value, "$.base64"))

    def made(error: Column) -> Column:
        ok = error.isNull()
        return F.struct(F.when(ok, tag).alias("kind"), F.when(ok, string_at(value, "$.domain")).alias("domain"), F.when(ok, text).alias("text"), error.alias("error"))

    return bind(error, made)


def untagged_items(value: Column) -> Column:
    """The items of a tagged sequence, or keys and values of a tagged map in turn, each as :func:`untagged_scalar`; null for scalars."""
    entries = F.flatten(F.transform(items_at(value, "$.entries"), lambda e: F.array(F.try_variant_get(e, "$.key", "variant"), F.try_variant_get(e, "$.value", "variant"))))
    return F.transform(F.coalesce(items_at(value, "$.items"), entries), untagged_scalar)


def parse_symbol(text: Column) -> Column:
    """A symbol's text as (``namespace``, ``name``): the first slash parts them, without one there is no namespace."""
    at = F.locate("/", text)
    return F.struct(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).alias("namespace"), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text).alias("name"))

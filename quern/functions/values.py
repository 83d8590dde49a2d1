"""Values as canonical tagged JSON text, and what can be said of a JSON object without decoding it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

F64 = "numbers/f64"


def bind(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), of), 0)


def quoted(text: Column) -> Column:
    """A JSON string literal of the text."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def tagged_number(canonical: Column, domain: str = F64) -> Column:
    """A number as text with its domain; never a machine number."""
    return F.concat(F.lit(f'{{"$expr":"number","domain":"{domain}","value":'), quoted(canonical), F.lit("}"))


def tagged_string(text: Column) -> Column:
    return quoted(text)


def canonical_base64(data: Column) -> Column:
    """Padded base64 without line breaks, which Spark's own has after 76 characters."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def tagged_bytes(data: Column) -> Column:
    return F.concat(F.lit('{"$expr":"bytes","base64":"'), canonical_base64(data), F.lit('"}'))


def tagged_map(entries: Column, key, value) -> Column:
    """An ordered list of pairs as a tagged map; duplicate keys stay."""
    one = lambda e: F.concat(F.lit('{"key":'), key(e), F.lit(',"value":'), value(e), F.lit("}"))
    return F.concat(F.lit('{"$expr":"map","entries":['), F.array_join(F.transform(entries, one), ","), F.lit("]}"))


def object_fields(json: Column) -> Column:
    """Top-level fields of a JSON object, in the order of their names, as (key, raw, domain): raw is the value's text, null for a JSON null; other JSON gives null.

    ``domain`` is ``number bool nil string list map``, from the value's type, so a string of digits is a string.  Numbers of up to 38 digits keep
    them all (1.50 is written 1.5).  An object that names a key twice gives null; see :func:`repeated_keys`.
    """
    values = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")

    def one(e: Column) -> Column:
        v = e["value"]
        raw = lambda kind: F.when(kind == "string", F.try_variant_get(v, "$", "string")).when(kind != "nil", F.to_json(v))
        return bind(variant_kind(v), lambda kind: F.struct(e["key"].alias("key"), raw(kind).alias("raw"), kind.alias("domain")))

    return F.transform(F.map_entries(values), one)


#: Kinds of scalars by the first word of a VARIANT's schema.
KINDS = {"STRING": "string", "BOOLEAN": "bool", "VOID": "nil"} | dict.fromkeys(("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "number")


def variant_kind(v: Column) -> Column:
    """``string number bool nil list map`` of a VARIANT; null for null."""
    return kind_of(lambda as_type: v if as_type == "variant" else F.try_variant_get(v, "$", as_type))


def kind_of(get) -> Column:
    """The kind of the VARIANT that ``get("variant")`` is.  Only scalars are asked for their schema: that of a list or map takes all they hold."""
    word = F.substring_index(F.schema_of_variant(get("variant")), "(", 1)
    scalar = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), word)
    return F.when(get("array<variant>").isNotNull(), "list").when(get("map<string,variant>").isNotNull(), "map").otherwise(scalar)


def repeated_keys(json: Column) -> Column:
    """Whether a JSON object names a top-level key twice; null for what is no object."""
    keys = F.json_object_keys(json)
    return F.size(keys) != F.size(F.array_distinct(keys))


def symbol_dictionary(words: Column) -> Column:
    """Distinct symbols of a value in canonical order: what a frame's side table holds."""
    return F.array_sort(F.array_distinct(words))

"""Size limits as predicates: a value over a limit gives an error text beside it, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default limits (fixed values): bytes of input, string and blob, items of a collection, nodes and depth of a value, tokens, trivia.
DEFAULTS = {
    "input bytes": 8 * 1024 * 1024,
    "tokens": 1_000_000,
    "nodes": 200_000,
    "depth": 512,
    "string bytes": 256 * 1024,
    "blob bytes": 8 * 1024 * 1024,
    "collection length": 65_536,
    "trivia": 16_384,
}


def exceeded(what: str, got: Column, most: int | None = None) -> Column:
    """Null within the limit, else the error text; a null value is within every limit."""
    most = DEFAULTS[what] if most is None else most
    text = F.concat(F.lit(f"decode {what} limit exceeded: "), got.cast("string"), F.lit(f" > {most}"))
    return F.when(got > most, text)


def input_bytes(text: Column, most: int | None = None) -> Column:
    return exceeded("input bytes", F.octet_length(text), most)


def string_bytes(text: Column, most: int | None = None) -> Column:
    return exceeded("string bytes", F.octet_length(text), most)


def collection_length(items: Column, most: int | None = None) -> Column:
    return exceeded("collection length", F.size(items), most)


def first_error(*checks: Column) -> Column:
    """The first error of several checks, in their order."""
    return F.coalesce(*checks)

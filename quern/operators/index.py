"""Index records: JSON documents of a closed schema, checked field by field, and the references among their items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.json import items_at, keys_at, kind_at, parsed, string_at
from quern.functions.values import bind, repeated_keys

# The fields of each record with their kinds; a question mark stands for a field that may be missing (a string also nil), and
# a list says of what its items are.
TEXTS = "list of string"
GRAMMAR = {
    "index": {
        "schema": "string", "generated-by": "string", "visibility": "string", "subjects": "list of subject", "anchors": "list of anchor",
        "surfaces": "list of surface", "specimens": "list of specimen", "drafts": "list of draft", "features": "list of feature",
        "routes": "list of route", "edges": "list of edge",
    },
    "subject": {"id": "string", "kind": "string", "title": "string"},
    "anchor": {"id": "string", "subject": "string", "kind": "string"},
    "surface": {"id": "string", "subject": "string", "kind": "string"},
    "specimen": {
        "id": "string", "subject": "string", "kind": "string", "path": "string", "language": "string?", "runnable": "bool", "checked": "bool",
        "checked-by": "string?", "doc-anchor": "string?",
    },
    "draft": {
        "id": "string", "subject": "string", "title": "string", "summary": "string", "claims-anchors": TEXTS, "claims-surfaces": TEXTS,
        "claims-specimens": TEXTS, "literal-anchors": TEXTS, "literal-surfaces": TEXTS, "literal-specimens": TEXTS,
        "grammar-contracts": "list of grammar contract", "doc-anchor": "string?",
    },
    "feature": {
        "id": "string", "key": "string", "subject": "string", "title": "string", "summary": "string", "anchors": TEXTS, "surfaces": TEXTS,
        "specimens": TEXTS, "grammar-contracts": "list of grammar contract", "doc-anchor": "string?",
    },
    "grammar contract": {"id": "string", "decoder": "string?", "encoder": "string?", "surface": "string?", "round-trip": "bool"},
    "route": {"id": "string", "title": "string", "audiences": TEXTS + "?", "steps": "list of step", "doc-anchor": "string?"},
    "step": {"kind": "string", "id": "string", "why": "string?"},
    "edge": {"from": "string", "rel": "string", "to": "string"},
}

#: Where references go: section, field (a string or a list of these), section of the targets.
REFERENCES = (
    ("anchors", "subject", "subjects"), ("surfaces", "subject", "subjects"), ("specimens", "subject", "subjects"), ("features", "subject", "subjects"),
    ("features", "anchors", "anchors"), ("features", "surfaces", "surfaces"), ("features", "specimens", "specimens"), ("drafts", "subject", "subjects"),
    ("drafts", "claims-anchors", "anchors"), ("drafts", "claims-surfaces", "surfaces"), ("drafts", "claims-specimens", "specimens"),
)


def _path(name: str) -> str:
    return f'$["{name}"]'


def _kind_test(allowed: tuple[str, ...], wrong: str, missing: str | None):
    """What is wrong with the kind of a field, as a function of the kind alone."""
    return lambda found: F.when(found.isNull(), missing).when(~found.isin(*allowed), wrong)


def _item_test(kind: str, wrong: str):
    """What is wrong with an item of a list, as a function of the item alone."""
    if kind == "string":
        return lambda x: F.when(~kind_at(x).eqNullSafe("string"), wrong)
    return lambda x: fields_reason(x, kind)


def fields_reason(v: Column, label: str) -> Column:
    """The first thing wrong with a record of the kind ``label``: no map, an unknown, missing or ill-kinded field, in this order; else null."""
    spec = GRAMMAR[label]
    more = bind(F.array_except(keys_at(v), F.array(*[F.lit(k) for k in spec])), lambda x: F.when(F.size(x) > 0, F.concat(F.lit(f"{label} has unknown field "), F.get(x, 0))))
    reasons = [F.when(~kind_at(v).eqNullSafe("map"), f"{label} must be a map"), more]
    for name, kind in spec.items():
        base, may = kind.removesuffix("?"), kind.endswith("?")
        wrong = f"{name} of {label} is no {base}"
        is_list = base.startswith("list of ")
        allowed = ("list",) if is_list else ("nil", base) if may else (base,)
        reasons.append(bind(kind_at(v, _path(name)), _kind_test(allowed, wrong, None if may else f"{label} missing field {name}")))
        if is_list:
            reasons.append(F.get(F.array_compact(F.transform(items_at(v, _path(name)), _item_test(base.removeprefix("list of "), wrong))), 0))
    return F.coalesce(*reasons)


def check(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``reason`` of each index document in ``json``; null where it fits the grammar."""
    whole = lambda v: F.when(v.isNull(), "no JSON, or a field of a record is repeated").otherwise(fields_reason(v, "index"))
    return docs.select("doc_id", F.when(repeated_keys(F.col("json")), "index repeats a field").otherwise(bind(parsed(F.col("json")), whole)).alias("reason"))


def items(docs: DataFrame, section: str) -> DataFrame:
    """The items of a section, a row each: ``doc_id``, ``item_ix``, ``id`` and the ``item`` as VARIANT."""
    rows = docs.select("doc_id", F.posexplode(items_at(parsed(F.col("json")), _path(section))).alias("item_ix", "item"))
    return rows.select("doc_id", "item_ix", string_at(F.col("item"), "$.id").alias("id"), "item")


def references(docs: DataFrame, section: str, field: str) -> DataFrame:
    """What the items of a section name in a field: ``doc_id``, ``id`` of the item, ``ref``."""
    item = F.col("item")
    named = F.coalesce(F.transform(items_at(item, _path(field)), lambda x: F.try_variant_get(x, "$", "string")), F.array(string_at(item, _path(field))))
    return items(docs, section).select("doc_id", "id", F.explode(F.array_compact(named)).alias("ref"))


def dangling(docs: DataFrame) -> DataFrame:
    """References that no item of the same document answers: ``doc_id``, ``relation``, ``id``, ``ref``; one anti-join for each target section."""
    found = []
    for target in dict.fromkeys(t for _, _, t in REFERENCES):
        wanted = [references(docs, s, f).withColumn("relation", F.lit(f"{s}.{f}")) for s, f, t in REFERENCES if t == target]
        there = items(docs, target).select("doc_id", F.col("id").alias("ref")).distinct()
        found.append(reduce(DataFrame.unionByName, wanted).join(there, ["doc_id", "ref"], "left_anti"))
    return reduce(DataFrame.unionByName, found).select("doc_id", "relation", "id", "ref")


def repeated(docs: DataFrame) -> DataFrame:
    """Identifiers that several items of a section share: ``doc_id``, ``section``, ``id``, ``n``."""
    every = [items(docs, s).select("doc_id", F.lit(s).alias("section"), "id") for s in ("subjects", "anchors", "surfaces", "specimens", "features", "routes")]
    rows = reduce(DataFrame.unionByName, every).groupBy("doc_id", "section", "id").agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("id").isNotNull() & (F.col("n") > 1))

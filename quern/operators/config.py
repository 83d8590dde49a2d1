"""Configuration texts: sections, keys and typed values as rows, with an error for each line that is none of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .documents import lines

KEY = r"[A-Za-z0-9_/-]+"
STRING = r'"(?:[^"\\]|\\["\\nrt])*"'
INT = r"[+-]?[0-9]+"
SCALAR = rf"(?:{STRING}|true|false|{INT})"


def settings(texts: DataFrame) -> DataFrame:
    """Lines of ``texts`` (``doc_id``, ``text``) as ``section``, ``key``, ``kind``, ``value`` and ``error``.

    A line is ``[section]``, ``[[section]]`` (repeatable), ``key = value``, a comment or blank.  Values are strings, integers of 64 bits,
    booleans, or arrays of these without nesting or trailing comma; dates and floats are errors, as are characters beyond ASCII, a key
    given twice in a section, and a plain section given twice.
    """
    rows = lines(texts).select("doc_id", "line_ix", F.trim("line").alias("line"))
    rows = rows.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    many = F.regexp_extract("line", rf"^\[\[({KEY}(?:\.{KEY})*)\]\]$", 1)
    head = F.regexp_extract("line", rf"^\[({KEY}(?:\.{KEY})*)\]$", 1)
    rows = rows.withColumns(
        {
            "many": F.nullif(many, F.lit("")),
            "head": F.nullif(head, F.lit("")),
            "key": F.nullif(F.regexp_extract("line", rf"^({KEY})\s*=\s*(.*)$", 1), F.lit("")),
            "value": F.regexp_extract("line", rf"^({KEY})\s*=\s*(.*)$", 2),
        }
    )
    name = F.coalesce("many", "head")
    upto = Window.partitionBy("doc_id").orderBy("line_ix")
    number = F.sum(name.isNotNull().cast("int")).over(upto)
    rows = rows.withColumns({"name": name, "section": F.coalesce(F.last(name, ignorenulls=True).over(upto), F.lit("")), "section_ix": number, "repeated": F.coalesce(F.last(F.when(name.isNotNull(), F.col("many").isNotNull()), ignorenulls=True).over(upto), F.lit(False))})
    kind = (
        F.when(F.col("value").rlike(rf"^{STRING}$"), "string")
        .when(F.col("value").isin("true", "false"), "bool")
        .when(F.col("value").rlike(rf"^{INT}$") & F.expr("try_cast(value as bigint)").isNotNull(), "int")
        .when(F.col("value").rlike(rf"^\[\s*(?:{SCALAR}(?:\s*,\s*{SCALAR})*)?\s*\]$"), "array")
    )
    rows = rows.withColumn("kind", F.when(F.col("key").isNotNull(), kind))
    twice = F.row_number().over(Window.partitionBy("doc_id", "section_ix", "key").orderBy("line_ix")) > 1
    again = F.row_number().over(Window.partitionBy("doc_id", "head").orderBy("line_ix")) > 1
    error = (
        F.when(F.col("line").rlike(r"[^\x00-\x7F]"), "not ASCII")
        .when(F.col("name").isNull() & F.col("key").isNull(), "neither section nor key")
        .when(F.col("key").isNotNull() & F.col("kind").isNull(), "no value of a known kind")
        .when(F.col("key").isNotNull() & twice, "key given twice")
        .when(F.col("head").isNotNull() & again, "section given twice")
    )
    rows = rows.withColumn("error", error)
    return rows.where("key is not null or error is not null").select("doc_id", "line_ix", "section", "section_ix", "repeated", "key", "kind", "value", "error")


def encode(found: DataFrame) -> DataFrame:
    """Texts of settings without errors, as :func:`settings` gives them: each section's head before its first key, repeated ones in double brackets.

    Comments and empty sections are not kept.  Reading the text again gives the same settings.
    """
    row = F.struct("line_ix", "section", "section_ix", "repeated", "key", "value")
    docs = found.where("error is null").groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("s"))

    def line(x, i):
        pair = F.concat(x["key"], F.lit(" = "), x["value"])
        head = F.when(x["repeated"], F.concat(F.lit("[["), x["section"], F.lit("]]"))).otherwise(F.concat(F.lit("["), x["section"], F.lit("]")))
        new = (x["section_ix"] > 0) & ((i == 0) | (x["section_ix"] != F.get("s", i - 1)["section_ix"]))
        return F.when(new, F.concat(head, F.lit("\n"), pair)).otherwise(pair)

    return docs.select("doc_id", F.concat(F.array_join(F.transform("s", line), "\n"), F.lit("\n")).alias("text"))

"""Edits of block tables: replace, insert or delete one block of a document, and their inverses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: ``edits``: one row for each document that is edited.
SCHEMA = "doc_id long, op string, at int, old string, new string"


def invert(edits: DataFrame) -> DataFrame:
    """The edits that undo these: old and new change places, insert and delete too."""
    op = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise(F.col("op"))
    return edits.select("doc_id", op.alias("op"), "at", F.col("new").alias("old"), F.col("old").alias("new"))


def applied(after: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits that :func:`apply`, whose result is ``after``, did: only these have something to undo."""
    return edits.join(after.where("error is not null").select("doc_id").distinct(), "doc_id", "left_anti")


def apply(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """``blocks`` (``doc_id``, ``block_ix``, ``text``) after the edits, with ``dirty`` for changed blocks and ``error``.

    Replace and delete need the old text at their place, insert a place up to the number of blocks; an edit that doesn't fit
    leaves its document as it is, with the reason in ``error`` on all its rows.  One exchange on the document, no order needed.
    """
    rows = blocks.select("doc_id", "block_ix", "text").join(edits.select("doc_id", "op", "at", "old", "new"), "doc_id", "full")
    of_doc = Window.partitionBy("doc_id")
    at, op = F.col("at"), F.col("op")
    here = F.col("block_ix") == at
    rows = rows.withColumns(
        {
            "n": F.count("block_ix").over(of_doc),
            "found": F.max(F.when(here, F.col("text"))).over(of_doc),
            "first": F.row_number().over(of_doc.orderBy("block_ix")) == 1,
        }
    )
    error = (
        F.when(op.isNull(), None)
        .when(~op.isin("replace", "insert", "delete"), F.concat(F.lit("unknown edit "), op))
        .when((op == "insert") & ((at < 0) | (at > F.col("n"))), "no such place")
        .when((op != "insert") & F.col("found").isNull(), "no such block")
        .when((op != "insert") & (F.col("found") != F.col("old")), "the old text differs")
    )
    rows = rows.withColumn("error", error)
    does = lambda name: op.eqNullSafe(name) & F.col("error").isNull()
    change = does("replace") & here
    step = F.when(does("insert") & (F.col("block_ix") >= at), 1).when(does("delete") & (F.col("block_ix") > at), -1).otherwise(0)
    kept = F.when(
        F.col("block_ix").isNotNull() & ~(does("delete") & here),
        F.struct((F.col("block_ix") + step).alias("block_ix"), F.when(change, F.col("new")).otherwise(F.col("text")).alias("text"), change.alias("dirty")),
    )
    added = F.when(does("insert") & F.col("first"), F.struct(at.alias("block_ix"), F.col("new").alias("text"), F.lit(True).alias("dirty")))
    out = rows.select("doc_id", "error", F.explode(F.array_compact(F.array(kept, added))).alias("b"))
    return out.select("doc_id", "b.block_ix", "b.text", F.coalesce("b.dirty", F.lit(False)).alias("dirty"), "error")

"""Documents as blocks and chunks with exact byte offsets.

Offsets count UTF-8 bytes.  Lines end with a line feed, before which one carriage return is cut off; a heading is a line of one to
six number signs, white space and a title; lines between headings and blank lines form paragraphs.  A heading's path is
the stack of titles: a heading of level n keeps the first n - 1 entries below it, however deep these were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.values import bind

#: Fixed value: what Typst reads as markup inside a text.
TYPST_MARKUP = r"([#*_`$@<>\\])"
HEADING = r"(?sU)^\s*(#{1,6})\s+(\S.*?)\s*$"


def headed(conversations: DataFrame) -> DataFrame:
    """One Markdown document for each conversation: a title, and a section for each turn."""
    turn = F.concat(F.lit("## "), F.coalesce("role", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"))
    body = F.array_join(F.transform("ts", lambda x: x["t"]), "")
    title = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.concat(title, body).alias("text"))


def lines(docs: DataFrame) -> DataFrame:
    """Lines of each document: ``line_ix``, text without its end, and byte range."""
    pieces = F.split(F.col("text"), "\n", -1)
    rows = docs.select("doc_id", F.size(pieces).alias("n"), F.posexplode(pieces).alias("line_ix", "raw"))
    ended = F.col("line_ix") < F.col("n") - 1
    rows = rows.where(ended | (F.col("raw") != ""))
    before = Window.partitionBy("doc_id").orderBy("line_ix").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("raw") + 1).over(before), F.lit(0))
    line = F.when(ended & F.endswith("raw", F.lit("\r")), F.expr("substring(raw, 1, length(raw) - 1)")).otherwise(F.col("raw"))
    rows = rows.select("doc_id", "line_ix", "raw", line.alias("line"), start.alias("start"))
    return rows.withColumn("end", F.col("start") + F.octet_length("line"))


def _paths(headings: Column) -> Column:
    """The path at each heading, in order."""
    step = lambda acc, h: F.concat(
        acc, F.array(F.concat(F.slice(F.coalesce(F.get(acc, F.size(acc) - 1), F.array().cast("array<string>")), F.lit(1), h["level"] - 1), F.array(h["title"])))
    )
    return F.aggregate(headings, F.array().cast("array<array<string>>"), step)


def _running(sizes: Column) -> Column:
    """The sum before each of the sizes.  Sums of groups first, then inside the groups, so the work grows as the power 1.5 of their number."""
    return bind(sizes, _running_of)


def _running_of(sizes: Column) -> Column:
    n = F.size(sizes)
    wide = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))

    def sums(wide: Column) -> Column:
        part = lambda at, size: F.aggregate(F.slice(sizes, at + 1, size), F.lit(0).cast("long"), lambda s, x: s + x)
        groups = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / wide).cast("int")), lambda g: part(g * wide, wide))
        step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        before = F.aggregate(groups, F.array(F.lit(0).cast("long")), step)
        group = lambda i: F.floor(i / wide).cast("int")
        return bind(before, lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(b, group(i)) + part(group(i) * wide, i - group(i) * wide)))

    return F.when(n > 0, bind(wide, sums)).otherwise(F.array().cast("array<bigint>"))


EMPTY = "array<struct<kind:string,text:string,start:bigint,end:bigint,heading_path:array<string>,level:int>>"


def with_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` with their blocks in order, as the array ``blocks``, all worked out inside the row: nothing is shuffled.

    Lines become arrays: their texts, kinds and byte offsets.  A paragraph goes from a line of text that follows none to the next that is
    followed by none; the section of a block is its place among all blocks less its place among those of its kind.
    """
    chop = lambda x: F.when(F.endswith(x, F.lit("\r")), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    pieces = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = docs.withColumn("_raw", F.slice(pieces, F.lit(1), F.size(pieces) - F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)))
    open_end = F.when(F.endswith(F.coalesce("text", F.lit("")), F.lit("\n")), -1).otherwise(F.size("_raw") - 1)  # the last line keeps its carriage return
    line = lambda x, i: F.when(i == open_end, x).otherwise(chop(x))
    rows = rows.withColumns({"_line": F.transform("_raw", line), "_start": _running(F.transform("_raw", lambda x: F.octet_length(x) + 1))})

    def read(x: Column) -> Column:
        level = F.when(F.contains(x, F.lit("#")), F.length(F.regexp_extract(x, HEADING, 1))).otherwise(0)
        made = lambda n: F.struct(n.alias("level"), F.when(n > 0, F.regexp_extract(x, HEADING, 2)).alias("title"), ((n == 0) & ~F.regexp_like(x, F.lit(r"(?sU)^\s*$"))).alias("text"))
        return bind(level, made)

    rows = rows.withColumn("_read", F.transform("_line", read))
    at = F.when(F.size("_raw") > 0, F.sequence(F.lit(0), F.size("_raw") - 1)).otherwise(F.array().cast("array<int>"))
    text = lambda i: F.coalesce(F.get("_read", i)["text"], F.lit(False))
    firsts, lasts = F.filter(at, lambda i: text(i) & ~text(i - 1)), F.filter(at, lambda i: text(i) & ~text(i + 1))
    # what a lambda uses is bound outside of it: Spark moves a column that is used once into the lambda, which would work it out for each element
    run = lambda i, p, lasts: F.struct(i.alias("i"), F.get(lasts, p).alias("j"), p.alias("n"), F.lit(False).alias("head"))
    runs = bind(lasts, lambda ends: F.transform(firsts, lambda i, p: run(i, p, ends)))
    rows = rows.withColumns({"_runs": runs, "_head": F.filter(at, lambda i: F.get("_read", i)["level"] > 0)})
    heads = F.transform("_head", lambda i, h: F.struct(i.alias("i"), i.alias("j"), h.alias("n"), F.lit(True).alias("head")))
    paths = _paths(F.transform("_head", lambda i: F.get("_read", i)))
    parts = F.array_sort(F.concat("_runs", heads))

    def block(x: Column, k: Column, paths: Column, start: Column) -> Column:
        own = F.get("_read", x["i"])
        lines_ = F.concat(F.slice("_raw", x["i"] + 1, x["j"] - x["i"]), F.array(F.get("_line", x["j"])))
        section = F.when(x["head"], x["n"]).otherwise(k - x["n"] - 1)
        return F.struct(
            F.when(x["head"], "heading").otherwise("paragraph").alias("kind"),
            F.when(x["head"], own["title"]).otherwise(F.array_join(lines_, "\n")).alias("text"),
            F.get(start, x["i"]).alias("start"),
            (F.get(start, x["j"]) + F.octet_length(F.get("_line", x["j"]))).alias("end"),
            F.coalesce(F.get(paths, section), F.array().cast("array<string>")).alias("heading_path"),
            F.when(x["head"], own["level"]).alias("level"),
        )

    every = bind(paths, lambda ps: bind(F.col("_start"), lambda start: F.transform(parts, lambda x, k: block(x, k, ps, start))))
    made = F.coalesce(every, F.array()).cast(EMPTY)
    # through a generator of one row, beyond which no expression is moved, so that each field of a block does not have all blocks worked out anew
    return rows.select(F.inline(F.array(F.struct(*[F.col(c) for c in docs.columns if c != "blocks"], made.alias("blocks")))))


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of each document: index, kind, text, byte range, heading path and level.

    ``docs`` has ``doc_id`` and ``text``; a null or empty text has no blocks.
    """
    return with_blocks(docs.select("doc_id", "text")).select("doc_id", F.posexplode("blocks").alias("block_ix", "b")).select("doc_id", "block_ix", "b.*")


def _ends(text: Column, data: Column, most: int) -> Column:
    """Byte offsets at which greedy windows of at most ``most`` bytes end; windows never cut a character, ``data`` are the text's bytes.

    A character wider than ``most`` is a window of its own.  In a text of ASCII all windows are equally wide; else a fold takes a
    step for each window, not for each character.
    """
    n = F.octet_length(text)
    inside = lambda p: F.hex(F.substring(data, p + 1, 1)).between("80", "BF")  # noqa: E731  within a character

    def step(acc: Column, _: Column) -> Column:
        at = F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))
        to = F.least(at + most, n)
        back = F.when(to >= n, to).when(~inside(to), to).when(~inside(to - 1), to - 1).when(~inside(to - 2), to - 2).otherwise(to - 3)
        wide = F.when(~inside(at + 1) | (at + 1 >= n), at + 1).when(~inside(at + 2) | (at + 2 >= n), at + 2).when(~inside(at + 3) | (at + 3 >= n), at + 3).otherwise(at + 4)
        to = F.when(back > at, back).otherwise(F.least(wide, n))
        return F.when(at >= n, acc).otherwise(F.concat(acc, F.array(to)))

    steps = F.sequence(F.lit(1), F.ceil(n / max(1, most - 3)).cast("int") + 1)
    even = F.transform(F.sequence(F.lit(1), F.ceil(n / most).cast("int")), lambda i: F.least(i * most, n))
    return F.when(n == F.length(text), even).otherwise(F.aggregate(steps, F.array().cast("array<int>"), step))


def windows(text: Column, most: int) -> Column:
    """The byte windows of a text as (``text``, ``a``, ``b``), cut inside the row from its bytes; none of an empty text."""
    if most <= 0:
        return F.array().cast("array<struct<text:string,a:int,b:int>>")

    def cut(data: Column, ends: Column) -> Column:
        start = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        part = lambda e, i: F.decode(F.substring(data, start(i) + 1, e - start(i)), "utf-8")
        return F.transform(ends, lambda e, i: F.struct(part(e, i).alias("text"), start(i).alias("a"), e.alias("b")))

    return F.when(F.octet_length(text) > 0, bind(F.encode(text, "utf-8"), lambda data: bind(_ends(text, data, most), lambda ends: cut(data, ends))))


def chunk_fixed(docs: DataFrame, most: int) -> DataFrame:
    """Byte windows of whole documents; a limit of 0 gives none."""
    rows = docs.select("doc_id", F.posexplode(windows(F.col("text"), most)).alias("chunk_ix", "w"))
    return rows.select("doc_id", "chunk_ix", "w.text", F.col("w.a").cast("long").alias("start"), F.col("w.b").cast("long").alias("end"))


def _paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the array ``p`` of a document's paragraphs; of one without, the whole text as one."""
    rows = with_blocks(docs.select("doc_id", "text")).withColumn("p", F.filter("blocks", lambda b: b["kind"] == "paragraph"))
    whole = F.struct(
        F.lit("paragraph").alias("kind"), F.col("text"), F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"),
        F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("int").alias("level"),
    )
    return rows.select("doc_id", F.when(F.size("p") > 0, F.col("p")).when(F.octet_length("text") > 0, F.array(whole)).alias("p"))


def chunk_recursive(docs: DataFrame, most: int) -> DataFrame:
    """Paragraphs of at most ``most`` bytes whole, longer ones in windows; without paragraphs, windows of the document."""
    cut = lambda p: F.transform(
        windows(p["text"], most),
        lambda w: F.struct(w["text"].alias("text"), (p["start"] + w["a"]).alias("start"), (p["start"] + w["b"]).alias("end"), p["heading_path"].alias("heading_path")),
    )
    rows = _paragraphs(docs).select("doc_id", F.posexplode(F.flatten(F.transform("p", cut))).alias("chunk_ix", "c"))
    return rows.select("doc_id", "chunk_ix", "c.*")


def chunk_heading(docs: DataFrame) -> DataFrame:
    """One chunk for each paragraph with its heading path; without paragraphs, the whole document."""
    rows = _paragraphs(docs).select("doc_id", F.posexplode("p").alias("chunk_ix", "c"))
    return rows.select("doc_id", "c.text", "c.start", "c.end", "c.heading_path", "chunk_ix")


def format_of(docs: DataFrame) -> DataFrame:
    """``markdown`` for a document with a heading, else ``text``; decided line by line inside the row."""
    cut = lambda x: F.regexp_replace(x, r"\r$", "")
    any_heading = F.exists(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_like(cut(x), F.lit(HEADING)))
    return docs.select("doc_id", F.when(any_heading, "markdown").otherwise("text").alias("format"))


def markdown_to_typst(found: DataFrame) -> DataFrame:
    """Blocks rendered for Typst, one document a row: headings by level, and texts with the characters escaped that Typst reads as markup."""
    body = F.regexp_replace("text", TYPST_MARKUP, r"\\$1")
    text = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("="), F.col("level")), F.lit(" "), body)).otherwise(body)
    rows = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_ix", text.alias("t")))).alias("b"), F.count(F.lit(1)).alias("n_blocks"))
    body = F.concat(F.array_join(F.transform("b", lambda x: x["t"]), "\n\n"), F.lit("\n"))
    return rows.select("doc_id", body.alias("typst"), "n_blocks")

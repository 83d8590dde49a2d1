"""Sources: whole files of text or bytes, and lines of newline-delimited JSON or server-sent events, as DataFrames or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: path and whole text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def blobs(spark: SparkSession, path: str, most: int = 8 * 1024 * 1024) -> DataFrame:
    """One row for each file: path, bytes, and an error instead of bytes beyond the limit."""
    files = spark.read.format("binaryFile").load(path)
    small = F.col("length") <= most
    error = F.concat(F.lit("decode input bytes limit exceeded: "), F.col("length").cast("string"), F.lit(f" > {most}"))
    return files.select("path", F.when(small, F.col("content")).alias("data"), F.when(~small, error).alias("error"))


def ndjson_frames(spark: SparkSession, path: str) -> DataFrame:
    """Lines of newline-delimited JSON with their file and their number in it; blank lines are none.  A file is one answer's, so it is read whole."""
    rows = texts(spark, path).select("path", F.posexplode(F.split("text", "\r?\n")).alias("frame_ix", "data"))
    return rows.where(F.length(F.trim("data")) > 0)


def sse_frames(bodies: DataFrame) -> DataFrame:
    """Frames of server-sent event bodies (``response_id``, ``body``): event name and data, several data lines joined.

    Comments are skipped; a frame without data is none, and leaves its event name to the next frame.
    """
    text = F.regexp_replace("body", "\r\n", "\n")
    field = lambda line, name: F.regexp_extract(line, rf"^{name}:\s?(.*)$", 1)
    cut = F.transform(F.split(text, "\n\n+"), lambda f: F.split(f, "\n"))
    frame = lambda ls: F.struct(
        F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(ls, lambda x: F.startswith(x, F.lit("event:"))), lambda x: field(x, "event"))), -1).alias("event"),
        F.filter(ls, lambda x: F.startswith(x, F.lit("data:"))).alias("lines"),
    )
    step = lambda acc, f: F.when(
        F.size(f["lines"]) > 0,
        F.struct(
            F.lit("").alias("name"),
            F.concat(
                acc["out"],
                F.array(F.struct(F.when(f["event"] != "", f["event"]).otherwise(acc["name"]).alias("event"), F.array_join(F.transform(f["lines"], lambda x: field(x, "data")), "\n").alias("data"))),
            ).alias("out"),
        ),
    ).otherwise(F.struct(F.when(f["event"] != "", f["event"]).otherwise(acc["name"]).alias("name"), acc["out"].alias("out")))
    start = F.struct(F.lit("").alias("name"), F.array().cast("array<struct<event:string,data:string>>").alias("out"))
    folded = F.aggregate(F.transform(cut, frame), start, step)["out"]
    return bodies.select("response_id", F.posexplode(folded).alias("frame_ix", "f")).select("response_id", "frame_ix", "f.event", "f.data")

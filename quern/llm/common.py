"""What the operators of this subpackage share: reading tables, words, and durable intermediate tables."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as all operators here see it: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows of a batch where whole texts go to workers.
RECORDS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where that is unset in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the time of one job; underscores in the names given stand for dots."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def durable(df: DataFrame, name: str, partition_by: list[str] | None = None, records: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    Spark removes the shuffle files of the job at its end.  ``records`` bounds the rows of a batch that workers are given, for large rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    values = {"spark_sql_classic_shuffleDependency_fileCleanup_enabled": "true"}
    if records:
        values["spark_sql_execution_arrow_maxRecordsPerBatch"] = str(records)
    with settings(spark, **values):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_place(docs: DataFrame) -> DataFrame:
    """``docs`` as stored files, with each row's place in them: ``_file``, the hash of a file's path, and ``_row``, the row's number there."""
    file, row = F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    try:
        return docs.select("*", file, row)
    except AnalysisException:  # no table of files
        return durable(docs, "docs").select("*", file, row)


def word_array(text: Column) -> Column:
    """The words of ``text`` in order; null gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.array_remove(F.split(trimmed, GAP), "")

"""Streamed answers: deltas of many responses, in any order and batch, put together per response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reassemble_stream(frames: DataFrame, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Answers of a stream of frames (``response_id``, ``frame_ix``, ``data``, event time ``at``).

    Frames of a response that lie at most ``gap`` apart are one answer.  It is emitted once, in append mode, when the
    watermark, ``delay`` behind the latest frame, has passed its end; later frames of it are dropped, as are frames sent twice.
    State is kept for open answers only.  ``ended`` says whether the end mark came.
    """
    done = F.col("data") == "[DONE]"
    content = F.get_json_object("data", "$.choices[0].delta.content")
    rows = frames.withWatermark("at", delay).dropDuplicatesWithinWatermark(["response_id", "frame_ix"])
    parts = F.sort_array(F.collect_list(F.when(~done & content.isNotNull(), F.struct("frame_ix", content.alias("c")))))
    answers = rows.groupBy("response_id", F.session_window("at", gap)).agg(
        parts.alias("p"), F.bool_or(done).alias("ended"), F.count(F.lit(1)).alias("n_frames")
    )
    text = F.array_join(F.transform("p", lambda x: x["c"]), "")
    return answers.select("response_id", F.col("session_window.end").alias("closed_at"), text.alias("text"), "ended", "n_frames")

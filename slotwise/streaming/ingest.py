"""Inbound message ingest (T-1) and intent tagging (T-2).

The same column transformations serve the batch twin (``spark.read``) and
the stream (``spark.readStream``): they are stateless, row-local
expressions, so a micro-batch plan is just a projection and filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotwise.functions.intents import intent, menu_index, message_text
from slotwise.functions.text import normalize_phone, py_strip, title_case
from slotwise.schemas import MESSAGES


def valid_messages(messages: DataFrame) -> DataFrame:
    """Drop messages without a sender or whose text is blank after strip."""
    return messages.where(
        F.coalesce(F.length("from_number"), F.lit(0)) > 0
    ).where(F.coalesce(F.length(py_strip("body")), F.lit(0)) > 0)


def message_log(messages: DataFrame) -> DataFrame:
    """Log rows: phone without the address prefix, stripped text in original case."""
    return valid_messages(messages).select(
        "id",
        normalize_phone("from_number").alias("phone"),
        F.lit("incoming").alias("event"),
        py_strip("body").alias("details"),
        F.col("ts").alias("created_at"),
    )


def tagged_messages(messages: DataFrame) -> DataFrame:
    """Valid messages with their sender (without the address prefix, so that
    both spellings are one conversation), normalised text and intent."""
    return valid_messages(messages).select(
        "id", normalize_phone("from_number").alias("phone"), "ts",
        message_text("body").alias("text"),
    ).withColumn("intent", intent("text"))


def menu_selection(messages: DataFrame, departments: DataFrame) -> DataFrame:
    """Which department a numeric reply picks on the department menu
    (``departments`` carries ``menu_no``); NULL when not a number or out of range."""
    t = tagged_messages(messages).select("id", "text", menu_index("text").alias("choice"))
    d = departments.select(F.col("menu_no").cast("int").alias("choice"), "department")
    return t.join(d, "choice", "left").select("id", "text", "choice", "department")


def name_titlecase(messages: DataFrame) -> DataFrame:
    """Names as the booking step stores them: stripped, title-cased, >= 2 chars."""
    return (
        valid_messages(messages)
        .select("id", title_case(py_strip("body")).alias("name"))
        .where(F.length("name") >= 2)
    )


def read_message_stream(spark: SparkSession, source_dir: str, fmt: str = "parquet") -> DataFrame:
    """Inbound messages as a stream of files with a fixed schema."""
    return spark.readStream.schema(MESSAGES).format(fmt).load(source_dir)


def start_message_log(
    spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, available_now: bool = True,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Stream inbound message files into the append-only log table.

    Exactly-once through the file sink's commit log plus the checkpoint: a
    restarted query resumes from the last committed offsets.
    """
    log = message_log(read_message_stream(spark, source_dir, fmt))
    writer = log.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(sink_dir)

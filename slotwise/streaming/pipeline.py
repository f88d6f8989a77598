"""The chat pipeline as one streaming query.

message files → tagged messages → each micro-batch: the dialogue of its phones
goes on from their sessions, over the menus of the ledger as it stands then;
the commands it gives are settled against that ledger; transitions, sessions,
ledger changes and replies are written and committed together, once per batch
id (see ``commands.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from slotwise.streaming import commands, dialogue, ingest

def start_chat_pipeline(
    spark: SparkSession,
    source_dir: str,
    doctors: DataFrame,
    leaves: DataFrame,
    initial_ledger: DataFrame,
    as_of,
    name: str,
    checkpoint_dir: str,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    reader = spark.readStream.schema(ingest.MESSAGES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    tagged = ingest.tagged_messages(reader.parquet(source_dir))

    def talk(batch: DataFrame, ledger: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
        menus = dialogue.menu_tables(doctors, leaves, ledger, as_of)
        before = commands.current_sessions(batch.sparkSession, name)
        here = batch.select("phone").distinct()
        steps = dialogue.dialogue_steps(batch, menus, before.join(here, "phone", "left_semi") if before is not None else None)
        # Written once: the commands, the sessions and the log are read from it.
        steps = dialogue._written(steps, "transitions")
        said = steps.select("msg_id", "phone", "ts", "command", "doctor_id", "date", "slot", "name")
        return said, {"transitions": steps, "sessions": dialogue.sessions_after(steps).select(commands.SESSION)}

    write = commands.ledger_writer(name, doctors, leaves, initial_ledger, talk)
    w = tagged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()

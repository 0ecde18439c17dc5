"""Interaction scores kept up to date from arriving log files.

Sums of event scores are additive, the clip at 0 is not; so the stored table holds raw sums and the clip happens on
read. A batch adds one segment with the sums of its own files; it neither reads nor writes what is stored. Readers
add the segments up. Segments of like size are put together now and then, so each sum is written anew only a few
times, however many batches follow. How far the stream has been read stands in the same commit as the sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens import schemas
from cartlens.functions.scores import clip, event_score
from cartlens.operators.interactions import behavior_logs
from cartlens.plans.tables import LoggedTable

PAIR = ["user_id", "product_id"]


def partial_sums(logs: DataFrame) -> DataFrame:
    return logs.groupBy(*PAIR).agg(F.sum(event_score()).alias("raw_score"), F.count("*").alias("n_events"))


def combined(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*PAIR).agg(F.sum("raw_score").alias("raw_score"), F.sum("n_events").alias("n_events"))


def absorb_new_logs(
    spark: SparkSession,
    log_folder: str,
    sums: LoggedTable,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> None:
    """Add all log files not seen before to the stored sums, then stop.

    A batch replayed after a failure finds its number in the log and adds nothing twice; a new checkpoint is
    another source. ``files_per_batch`` bounds a batch where many files wait.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        if sums.log.current().streams.get(checkpoint, -1) >= batch_id:
            return
        sums.append(partial_sums(behavior_logs(batch)), {checkpoint: batch_id})

    stream = spark.readStream.schema(schemas.BEHAVIOR)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    query = (
        stream.parquet(log_folder)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if sums.exists():
        sums.merge_segments(combined)


def fresh_scores(sums: LoggedTable) -> DataFrame:
    """The stored sums as interaction scores."""
    return combined(sums.read()).select(
        *PAIR, clip(F.col("raw_score"), low=0.0).alias("score"), "n_events"
    )

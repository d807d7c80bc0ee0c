"""Resumable ingest of finished response files (L1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import schemas
from ..sources.files import completion_text

ANSWER = "custom_id string, content string, file string, block bigint, line bigint, ingest int"


def ingest_responses_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    shape: str = "body",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Append the answers of files not seen before, oldest file first, and return the whole table.

    The stream's checkpoint remembers finished files: a rerun adds nothing, and a new file adds only
    its own rows. Repeated ids are kept; the merge by id (E1) takes the last one when reading.
    """
    schema = schemas.RESPONSE_BODY if shape == "body" else schemas.RESPONSE_FLAT
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.json(source).withColumns(
        {
            "content": completion_text(shape),
            "file": F.col("_metadata.file_path"),
            "block": F.col("_metadata.file_block_start"),
        }
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        # One folder per batch, overwritten when a batch is repeated after a failure.
        answers = batch.select(
            "custom_id", "content", "file", "block", F.monotonically_increasing_id().alias("line")
        )
        answers.write.mode("overwrite").parquet(f"{target}/ingest={batch_id}")

    query = (
        raw.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(ANSWER).parquet(target)

"""Continuous ingest: a folder of EPUB files as a file stream through the batch pipeline's stages."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from potluck.operators.store import RecipeStore
from potluck.plans.config import Config
from potluck.plans.pipeline import extract_from_documents
from potluck.sources.epub import read_documents


def ingest_folder(spark: SparkSession, folder: str, store_path: str, checkpoint: str, config: Config | None = None, files_per_batch: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Save the recipes of new archives to a store as they come; each file is read once, whatever is restarted.

    A batch is saved under the stream's checkpoint and its number, in one commit of the store, so one that is repeated
    after a failure at any point is saved once.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.epub")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    recipes = extract_from_documents(read_documents(files.select("path", "content")), config)

    def save(batch, number: int) -> None:
        RecipeStore(spark, store_path).save(batch, key=f"{checkpoint.rstrip('/')}#{number}")

    writer = recipes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()

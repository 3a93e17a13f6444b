"""Detections as they arrive: the stateless plans of the batch side over files of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import detections

DETECTIONS = "sheet long, id long, tile_id int, x0 double, y0 double, x1 double, y1 double, conf double"


def read_detections(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def keep_sure(folder_in: str, folder_out: str, checkpoint: str, spark: SparkSession, least: float = 0.3):
    """Writes the detections that are sure enough; ends when what is there has been read. Restarts go on after the last files written."""
    kept = detections.filter_confidence(read_detections(spark, folder_in), least)
    return kept.writeStream.format("parquet").option("path", folder_out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

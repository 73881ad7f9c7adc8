"""The row-local parts of the review over a stream: an addition of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import schemas
from tessera.operators.review import flags


def read_requirements(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder that requirements arrive in as Parquet files."""
    return spark.readStream.schema(StructType.fromDDL(schemas.REQUIREMENT + ", arrived timestamp")).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_scores(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Compliant and all rows per source and window; rows later than the watermark are left out."""
    flagged = flags(stream.withColumn("tr_id", F.to_json(F.struct("tr_id", "arrived"))))
    back = F.from_json("tr_id", "tr_id string, arrived timestamp")
    timed = flagged.withColumn("arrived", back["arrived"]).withWatermark("arrived", late)
    return timed.groupBy(F.window("arrived", width), "source_id").agg(F.count_if("compliant").alias("compliant"), F.count("*").alias("total"))

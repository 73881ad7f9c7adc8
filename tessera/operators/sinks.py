"""Stage tables on disk: one folder per stage, dealt into buckets by source, with a list of the sources; and what is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.plans.storage import exists, materialize, release

MANIFEST = "source_id string, rows long, bucket int, buckets int"


def save(df: DataFrame, path: str, json: bool = False, buckets: int = 64, rows_per_file: int = 1_000_000) -> None:
    """Parquet, or JSON lines for other tools, in a fixed number of buckets by source. Only the sources of `df` are replaced.

    Buckets that `df` touches are written anew with the other sources they hold, in files of about `rows_per_file` rows, so the number of
    files goes by rows and buckets and not by sources, and a large source is spread over several. The number of buckets is that of the first
    save, kept with the rows of each source in the list of sources (`saved_sources`).
    """
    spark = df.sparkSession
    listed = saved_sources(spark, path)
    known = listed.select("buckets").first()
    buckets = known["buckets"] if known else buckets
    bucket = F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int")
    new = materialize(df.withColumn("bucket", bucket), "to-save")
    whole = new
    if known:
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets
        stored = spark.read.schema(new.schema)
        old = (stored.json(path) if json else stored.parquet(path)).filter(F.col("bucket").isin(*touched)).select(*new.columns)
        whole = materialize(new.unionByName(old.join(new.select("source_id").distinct(), "source_id", "left_anti")), "to-save")
    most = whole.groupBy("bucket").count().agg(F.max("count").alias("n")).first()["n"] or 0
    part = F.pmod(F.xxhash64(*[c for c in df.columns if c != "source_id"] or ["source_id"]), F.lit(-(-most // rows_per_file) or 1))
    spread = whole.repartition(max(1, min(buckets * (-(-most // rows_per_file) or 1), spark.sparkContext.defaultParallelism * 4)), "bucket", part)
    writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
    writer.json(path) if json else writer.parquet(path)
    names = whole.groupBy("source_id", "bucket").agg(F.count("*").alias("rows")).select("source_id", "rows", F.lit(buckets).alias("buckets"), "bucket")
    names.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/_sources")
    release(*{id(x): x for x in (new, whole)}.values())


def saved_sources(spark: SparkSession, path: str) -> DataFrame:
    """source_id, rows, bucket, buckets of what is saved below a path, from its list of sources; empty if nothing is."""
    at = f"{path}/_sources"
    return spark.read.schema(MANIFEST).parquet(at).select("source_id", "rows", "bucket", "buckets") if exists(spark, at) else spark.createDataFrame([], MANIFEST)


def load(spark: SparkSession, path: str, ddl: str, json: bool = False, domains: dict[str, tuple[str, ...]] | None = None, required: tuple[str, ...] = (), multi_line: bool = False) -> DataFrame:
    """A stage table, from Parquet or from JSON (objects or arrays by line, or one document a file with `multi_line`). Rows with a value outside its column's domain, or without a required one, are left out."""
    schema = StructType.fromDDL(ddl)
    keep = F.lit(True)
    for c, values in (domains or {}).items():
        keep &= F.coalesce(F.col(c).isin(*values), F.lit(False))
    for c in required:
        keep &= F.col(c).isNotNull()
    reader = spark.read.schema(schema)
    rows = reader.option("mode", "PERMISSIVE").option("multiLine", multi_line).json(path) if json else reader.parquet(path)
    return rows.filter(keep).select(*schema.names)


def pending(inputs: DataFrame, done: DataFrame | None, force: bool = False) -> DataFrame:
    """Rows of sources that aren't done yet."""
    return inputs if force or done is None else inputs.join(done.select("source_id").distinct(), "source_id", "left_anti")


def resume(rows: DataFrame, done: DataFrame, first: int = 30) -> DataFrame:
    """The first rows of each source (by ordinal) that have no verdict yet: the window is fixed before done rows go."""
    window = rows.withColumn("n", F.row_number().over(W.partitionBy("source_id").orderBy("ordinal"))).filter(F.col("n") <= first)
    return window.join(done.select("source_id", "tr_id"), ["source_id", "tr_id"], "left_anti").drop("n")

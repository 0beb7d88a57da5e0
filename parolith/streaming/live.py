"""The stateless part of the pipeline on streams, and the newest rating of each claim kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parolith.functions import text as X
from parolith.functions.claims import canonicalise
from parolith.operators.clean import with_basis
from parolith.operators.validation import latest_ratings
from parolith.session import ensure_checkpoint_dir
from parolith.sources.files import delete, exists


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(folder)


def clean_stream(sayings: DataFrame) -> DataFrame:
    """Cleaned rows with score and claim; every step is a column expression, so it runs on a stream as on a table."""
    kept = with_basis(sayings).where(X.keep_basis(F.col("basis")))
    return kept.withColumn("quality_score", X.quality_score(F.col("basis"))).withColumn("claim", canonicalise(F.col("basis")))


def counts_by_window(sayings: DataFrame, time: str, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Cleaned sayings per people and window; rows later than the watermark are left out."""
    kept = clean_stream(sayings.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late))
    return kept.groupBy(F.window(time, window).alias("w"), "people").agg(F.count("*").alias("n"), F.avg("quality_score").alias("avg_quality")).select(F.col("w.start").alias("start"), "people", "n", "avg_quality")


def upsert_ratings(stream: DataFrame, folder: str, checkpoint: str, key: str, time: str, tie: str):
    """Keeps the newest rating of each key in versions below the folder, the last two; a batch that runs again writes the same version again."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = f"{folder}/v={number - 1}"
        if number and not exists(spark, before):
            raise FileNotFoundError(f"{before} is missing: the state can't be carried on")
        whole = batch.unionByName(spark.read.parquet(before)) if number else batch
        latest_ratings(whole, key, time, tie).write.mode("overwrite").parquet(f"{folder}/v={number}")
        if number > 1:
            delete(spark, f"{folder}/v={number - 2}")  # this batch may run again and needs the version before it, no older one

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts_once(spark: SparkSession, folder: str, schema: T.StructType, time: str, late: str = "3650 days") -> DataFrame:
    """``counts_by_window`` over what a folder holds, in one pass; windows still open at its end are given too."""
    name, at = f"windows_{uuid.uuid4().hex}", f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = counts_by_window(stream_table(spark, folder, schema), time, late)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{name}/batch={number}")

    run = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(T.StructType([*counts.schema, T.StructField("batch", T.IntegerType())])).parquet(f"{at}/{name}")
    keys = [c for c in counts.columns if c not in ("n", "avg_quality")]
    return out.groupBy(*keys).agg(F.max_by(F.struct("n", "avg_quality"), "batch").alias("x")).select(*keys, "x.n", "x.avg_quality")


def upsert_once(spark: SparkSession, folder: str, schema: T.StructType, key: str, time: str, tie: str) -> DataFrame:
    """``upsert_ratings`` over what a folder holds: the newest rating of each key."""
    at = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    upsert_ratings(stream_table(spark, folder, schema), f"{at}/rows", f"{at}/state", key, time, tie).awaitTermination()
    return newest_version(spark, f"{at}/rows")


def newest_version(spark: SparkSession, folder: str) -> DataFrame:
    """The last version that was written whole."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    versions = [int(s.getPath().getName().split("=")[1]) for s in listed if s.getPath().getName().startswith("v=")]
    whole = [v for v in versions if exists(spark, f"{folder}/v={v}/_SUCCESS")]
    return spark.read.parquet(f"{folder}/v={max(whole)}")

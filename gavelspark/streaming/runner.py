"""Start a stream over what is available now and read its result back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.sources.storage import new_folder


def write_available(stream: DataFrame, name: str, *, folder: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Append the stream to Parquet in the shared folder until its input is used up.

    The file sink commits each micro-batch once; running again with the same ``folder``
    and ``checkpoint`` continues where the last run stopped.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)
    checkpoint = checkpoint or new_folder(spark, f"{name}-checkpoint")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


def latest_available(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Current values of an aggregate over what is available, one row for each of its keys,
    with the windows that are still open.

    Each micro-batch writes the rows it changed under its number, so a repeated batch
    replaces its own rows; the last batch that names a key has its value. Nothing is kept by
    the driver, and the table may have any number of keys.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    values = [c for c in stream.columns if c not in keys]

    def put(batch: DataFrame, number: int) -> None:
        changed = batch.withColumn("_batch", F.lit(number).cast("long"))
        changed.write.mode("overwrite").parquet(f"{folder}/{number}")

    query = (
        stream.writeStream.foreachBatch(put)
        .outputMode("update")
        .option("checkpointLocation", new_folder(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    if query.lastProgress is None:  # no input, so no batch
        return spark.createDataFrame([], stream.schema)
    written = spark.read.schema(schema).parquet(f"{folder}/*")
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_latest"))
    return latest.select(*keys, "_latest.*")

"""Continuous ingestion of document files: each micro-batch adds the checksums that the table lacks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine, where none is named, one beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-streams").rstrip("/")


def ingest_available(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Read what lies at path as a stream, once; return (doc_id, checksum) of the table at target."""
    root = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    target = target or f"{root}/table"
    schema = spark.read.parquet(path).schema

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("checksum")).agg(F.min("doc_id").alias("doc_id"))
        if number:
            known = spark.read.parquet(*[f"{target}/batch={i}" for i in range(number)]).select("checksum")
            fresh = fresh.join(known, "checksum", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")  # a repeated batch replaces itself

    # As a pattern, a path may be one file or a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).select("doc_id", "checksum")

"""Incremental loading: a stream of new files is appended to a table, keys that exist are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sinks import insert_if_absent


def append_new(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's rows of new keys to the Parquet table `target`, one row a key. Ends when the input is read.

    A batch that is tried again appends nothing twice, as its keys exist by then."""
    schema = stream.schema

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            there = spark.read.schema(schema).parquet(target)
            there.limit(0).count()
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            there = spark.createDataFrame([], schema)
        order = [F.xxhash64(*batch.columns)]
        insert_if_absent(batch, there, key, order).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

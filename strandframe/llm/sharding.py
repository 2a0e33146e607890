"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. The rows are staged once, numbered by input partition and place, so a retried task sees the same rows.
2. For each input partition the number of rows it sends to each shard is drawn from the multivariate hypergeometric
   distribution of the places left (the exact law of a uniform shuffle); shard sizes differ by one row at most.
3. A random order inside each partition says which rows make up those numbers (local permutation).
4. Rows move to their shards and take random places there (second permutation). The places of a shard are found in
   buckets of a random key, so no task sorts a whole shard.

Every row is placed on its own: copies of a text, repeated rows and null or empty texts are rows like others. An empty
table gives no rows. Columns of df pass by; those named shard or slot are replaced, names of this module begin with two
underscores. Very long texts are rows like others, and move twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from pyspark.taskcontext import TaskContext

from .common import durable, tidy

#: Rows that one bucket of the second permutation should hold, about.
BUCKET_ROWS = 200_000


def communication_matrix(rows: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard: row sums are `rows`, column sums differ by one at most."""
    total = int(rows.sum())
    generator = np.random.Generator(np.random.PCG64(seed))
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    out = np.zeros((len(rows), shards), np.int64)
    for p, n in enumerate(rows):
        remaining = int(left.sum())
        if remaining < 1_000_000_000:  # numpy draws the whole row
            out[p] = generator.multivariate_hypergeometric(left, int(n), method="marginals")
            left -= out[p]
            continue
        for s in range(shards):  # one shard after another: each draw is a plain hypergeometric one
            if n == 0:
                break
            others = remaining - int(left[s])
            k = int(n) if others == 0 else _hypergeometric(generator, int(left[s]), others, int(n))
            out[p, s] = k
            n -= k
            remaining = others
        left -= out[p]
    return out


def _hypergeometric(generator: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw. Populations beyond what numpy's generator takes are drawn by inversion around the mode, from the exact
    ratios of neighbouring probabilities."""
    if good + bad < 1_000_000_000:
        return int(generator.hypergeometric(good, bad, n))
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    share = good / total
    reach = int(14 * (n * share * (1 - share)) ** 0.5) + 40
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    ratio = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    chance = np.cumsum(np.exp(weight - weight.max()))
    return int(k[np.searchsorted(chance, generator.random() * chance[-1], side="right")])


def _numbered(df: DataFrame) -> DataFrame:
    schema = T.StructType([*df.schema, T.StructField("__part", T.IntegerType(), False), T.StructField("__row", T.LongType(), False)])
    names = [*df.columns, "__part", "__row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], names)
            at += n

    return df.mapInArrow(tidy(run), schema)


def _uniform(seed: int, *columns: str):
    return F.xxhash64(F.lit(seed), *columns)


def hypergeometric_shuffle(df: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """All rows of df with shard (0 to shards - 1) and slot (0, 1, ... in each shard, without gaps), uniformly at random."""
    spark = df.sparkSession
    staged = durable(_numbered(df.drop("shard", "slot")))
    counted = staged.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # one number for each input split
    parts, rows = [r["__part"] for r in counted], np.array([r.n for r in counted], np.int64)
    matrix = communication_matrix(rows, shards, seed) if len(rows) else np.zeros((0, shards), np.int64)
    flat = pa.array(np.cumsum(matrix, axis=1).ravel(), pa.int64())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, shards), pa.int32()), flat)
    bounds = spark.createDataFrame(pa.table({"__part": pa.array(parts, pa.int32()), "__bounds": lists}))

    local = Window.partitionBy("__part").orderBy(_uniform(seed, "__part", "__row"), "__row")
    ranked = staged.withColumn("__rank", F.row_number().over(local))
    sent = (
        ranked.join(bounds, "__part")
        .withColumn("shard", F.size(F.filter("__bounds", lambda b: b < F.col("__rank"))))
        .drop("__bounds", "__rank")
    )

    n = int(rows.sum())
    buckets = max(1, -(-n // (shards * BUCKET_ROWS)))
    key = _uniform(seed + 1, "__part", "__row")
    sent = durable(sent.withColumn("__key", key).withColumn("__bucket", F.pmod(F.shiftrightunsigned("__key", 20), F.lit(buckets)).cast("int")))
    sizes = sent.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("__key", "__part", "__row")
    placed = sent.withColumn("__place", F.row_number().over(inside) - 1).join(first, ["shard", "__bucket"])
    return placed.select(*df.drop("shard", "slot").columns, F.col("shard").cast("int").alias("shard"), (F.col("__first") + F.col("__place")).alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """One folder for each shard, rows in order of their slot."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)

"""Tables that grow: skipping known keys through a Bloom filter, and updates that rewrite only the folders they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .joins import anti_join
from .sinks import upsert

_COUNTED = "bucket_of_"


def _place(on: Sequence[str], blocks: int) -> dict[str, Column]:
    """Where a key is in the filter: its block, by the low bits of its hash, and four bits of that block's word, by the high ones."""
    h = F.xxhash64(*on)
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40 + 6 * i).cast("int").bitwiseAND(63)) for i in range(4)]
    return {"__block": h.bitwiseAND(F.lit(blocks - 1).cast("long")), "__bits": bit[0].bitwiseOR(bit[1]).bitwiseOR(bit[2]).bitwiseOR(bit[3])}


def _met(df: DataFrame, keys: DataFrame, on: Sequence[str], blocks: int) -> DataFrame:
    """df with __met: false only where no row of `keys` has the row's key. A word for each block, merged with partial ORs."""
    words = keys.dropna(subset=list(on)).select(*[c.alias(n) for n, c in _place(on, blocks).items()]).groupBy("__block").agg(F.bit_or("__bits").alias("__word"))
    whole = F.lit(True)
    for c in on:
        whole &= F.col(c).isNotNull()
    seen = df.withColumns(_place(on, blocks)).join(F.broadcast(words), "__block", "left")
    met = whole & (F.coalesce("__word", F.lit(0)).bitwiseAND(F.col("__bits")) == F.col("__bits"))
    return seen.withColumn("__met", met).drop("__block", "__bits", "__word")


def skip_known(df: DataFrame, known: DataFrame, on: Sequence[str], bits: int = 16, most_bytes: int = 64 << 20) -> DataFrame:
    """Rows of df whose key is not among `known`, like anti_join, where one side has very many rows. Null keys equal none and stay;
    repeated rows stay. The key columns must have the same types on both sides.

    A Bloom filter of `bits` bits a key of the smaller side, at its broadcast size (about 32 bytes for 64 bits) at most
    most_bytes, is applied where the other side is scanned; only rows that it lets through are exchanged for the exact join.
    If df is smaller, known keys that it cannot hold are left out; else the rows that are surely new skip the join, and df is
    read twice. Where both sides have too many rows for the filter it is a plain anti_join. The result is the same each time."""
    types = [[d.schema[c].dataType for c in on] for d in (df, known)]
    if types[0] != types[1]:
        raise ValueError(f"key types differ: {types[0]} and {types[1]}")
    keys = known.select(*on)
    rows, there = df.count(), keys.count()
    blocks = 1 << max(4, (min(rows, there) * bits // 64).bit_length())
    if rows == 0 or there == 0:
        return df
    if blocks * 32 > most_bytes:
        return anti_join(df, keys, on)
    if rows <= there:
        return anti_join(df, _met(keys, df, on, blocks).where("__met").select(*on), on)
    seen = _met(df, keys, on, blocks)
    return seen.where(~F.col("__met")).select(*df.columns).union(anti_join(seen.where("__met"), keys, on).select(*df.columns))


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(f"{_COUNTED}{buckets}", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int"))


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = 64, pieces: int = 4, mode: str = "overwrite") -> None:
    """A Parquet table in folders by hash of its key, so that an update finds the few that hold its keys. Rows of a null key are in a
    folder of their own. A folder is written by up to `pieces` tasks, dealt by the whole row."""
    placed = _bucketed(df, key, buckets)
    placed = placed.withColumn("__piece", F.pmod(F.xxhash64(*df.columns), F.lit(pieces)))
    name = f"{_COUNTED}{buckets}"
    placed.repartition(name, "__piece").drop("__piece").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.drop(*[c for c in df.columns if c.startswith(_COUNTED)])


def upsert_buckets(changes: DataFrame, path: str, key: str, columns: Sequence[str], pieces: int = 4) -> list[int]:
    """`upsert` of changes, which have unique keys, into a table of write_buckets; returns the buckets that were rewritten. Only their
    folders are read and replaced, all others keep their files. The key must have the table's type. Changes with a null key are
    appended, and rewrite nothing.

    New files are written beside the old ones and take their place when all tasks have ended, so lost tasks and executors change
    nothing; a run that dies before may be started again. Every changed folder is first made whole in the shared folder."""
    spark = changes.sparkSession
    table = spark.read.parquet(path)
    (name,) = [c for c in table.columns if c.startswith(_COUNTED)]
    buckets, plain = int(name.removeprefix(_COUNTED)), [c for c in table.columns if c != name]
    if changes.schema[key].dataType != table.schema[key].dataType:
        raise ValueError(f"the key is {table.schema[key].dataType} in the table and {changes.schema[key].dataType} in the changes")
    placed = durable(_bucketed(changes.select(key, *columns), key, buckets))
    touched = sorted(r[name] for r in placed.where(f"{name} >= 0").select(name).distinct().collect())  # at most `buckets` numbers
    if touched:
        merged = upsert(table.where(F.col(name).isin(touched)).select(*plain), placed.where(F.col(key).isNotNull()).drop(name), key, columns)
        write_buckets(durable(merged.select(*plain)), path, key, buckets, pieces)
    alone = placed.where(F.col(key).isNull()).drop(name)
    if not alone.isEmpty():
        rest = {c: F.lit(None).cast(table.schema[c].dataType) for c in plain if c not in alone.columns}
        write_buckets(alone.withColumns(rest).select(*plain), path, key, buckets, pieces, "append")
    return touched

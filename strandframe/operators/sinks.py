"""Writers and incremental updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_csv(df: DataFrame, path: str, separator: str = ",", mode: str = "overwrite", two_decimals: Sequence[str] = ()) -> None:
    """Text with a header in every part file. two_decimals are formatted here, at the sink, not before."""
    df.withColumns({c: F.format_string("%.2f", F.col(c)) for c in two_decimals}).write.mode(mode).csv(path, header=True, sep=separator)


def fasta_lines(header: Column, sequence: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), sequence)


def write_fasta(df: DataFrame, path: str, header: str, sequence: str, order: Sequence[str] = ()) -> None:
    lines = df.orderBy(*order) if order else df
    lines.select(fasta_lines(F.col(header), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


def write_ordered(df: DataFrame, path: str, order: Sequence[str | Column], *lines: Column | str, together: Sequence[str] = ()) -> None:
    """The lines of each row as one text in parts: ranges of the order are sorted and written side by side, and the parts, in the
    order of their names, are the text. Readers take such a folder with of="folder". Rows equal in `together`, which must lead
    the order, go to one part, as a record of several rows must."""
    ranged = df.repartitionByRange(*together).sortWithinPartitions(*order) if together else df.orderBy(*order)
    ranged.select(F.concat_ws("\n", *lines).alias("value")).write.mode("overwrite").text(path)


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Rows of `new` to append: the first of each key by the order, unless the key exists. Rows with a null key equal none, nor each
    other: all are appended."""
    first = Window.partitionBy(key).orderBy(*order)
    fresh = new.where(F.col(key).isNotNull()).join(existing.select(key), key, "left_anti").select(*new.columns)
    return fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").unionByName(new.where(F.col(key).isNull()))


def upsert(existing: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """All keys of both; a change replaces the named columns where it has a value."""
    other = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = existing.join(other, key, "full_outer")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def rekey(df: DataFrame, key: str, new_key: Column) -> DataFrame:
    """Rows under a new key; where it is null the old one stays."""
    return df.withColumn(key, F.coalesce(new_key, F.col(key)))

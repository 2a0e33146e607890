"""Hierarchical clustering in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def row_distances(matrix: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """id_a, id_b (the lesser first) and Euclidean distance of the rows of a matrix of (row, column, value); absent values are 0. One
    row for each pair: for as many rows as a picture shows."""
    # Read from four sides, so computed once.
    cells = stored(matrix.groupBy(F.col(row).alias("id"), F.col(column).alias("c")).agg(F.sum(F.col(value).cast("double")).alias("v")))
    norms = cells.groupBy("id").agg(F.sum(F.col("v") * F.col("v")).alias("n"))
    a, b = (cells.select(F.col("id").alias(f"id_{s}"), "c", F.col("v").alias(f"v_{s}")) for s in "ab")
    products = a.join(b, "c").where("id_a < id_b").groupBy("id_a", "id_b").agg(F.sum(F.col("v_a") * F.col("v_b")).alias("p"))
    one, two = (norms.select(F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    pairs = one.join(two, F.col("id_a") < F.col("id_b")).join(products, ["id_a", "id_b"], "left")
    squared = F.col("n_a") + F.col("n_b") - 2 * F.coalesce("p", F.lit(0.0))
    return pairs.select("id_a", "id_b", F.sqrt(F.greatest(squared, F.lit(0.0))).alias("distance"))


def average_linkage(distances: DataFrame) -> DataFrame:
    """a, b, height, size and round of every merge: two clusters, each named by its least row, whose rows are `height` apart on average.

    In a round all pairs that are each other's nearest merge at once. With average linkage a merge brings no other pair nearer, so
    the tree is that of one merge after another. Equal distances go by the names. Only sums of distances between clusters are
    kept: they add up when clusters merge."""
    sums = stored(distances.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), F.col("distance").cast("double").alias("s"), F.lit(1).cast("long").alias("pairs")).where("a <> b"))
    sizes = stored(sums.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("n", F.lit(1).cast("long")))
    merges, number = None, 0
    while not sums.isEmpty():
        number += 1
        apart = sums.withColumn("d", F.round(F.col("s") / F.col("pairs"), 12))
        sides = apart.select(F.explode(F.array("a", "b")).alias("id"), F.struct("d", "a", "b").alias("m"))
        nearest = sides.groupBy("id").agg(F.min("m").alias("m"))
        mutual = nearest.groupBy("m").agg(F.count("*").alias("k")).where("k = 2").select("m.a", "m.b", F.col("m.d").alias("height"))
        of = lambda side: sizes.withColumnsRenamed({"id": side, "n": f"n_{side}"})
        merged = stored(mutual.join(of("a"), "a").join(of("b"), "b").select("a", "b", "height", (F.col("n_a") + F.col("n_b")).alias("size"), F.lit(number).alias("round")))
        merges = merged if merges is None else merges.unionByName(merged)
        into = merged.select(F.col("b").alias("old"), F.col("a").alias("new"))
        renamed = sums
        for side in ("a", "b"):
            renamed = renamed.join(into.withColumnsRenamed({"old": side, "new": f"to_{side}"}), side, "left").withColumn(side, F.coalesce(f"to_{side}", side)).drop(f"to_{side}")
        pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        sums = stored(renamed.where("a <> b").groupBy(*pair).agg(F.sum("s").alias("s"), F.sum("pairs").alias("pairs")))
        grown = merged.select(F.col("a").alias("id"), F.col("size").alias("now"))
        sizes = stored(sizes.join(into.select(F.col("old").alias("id")), "id", "left_anti").join(grown, "id", "left").select("id", F.coalesce("now", "n").alias("n")))
    if merges is None:
        return sums.select("a", "b", F.col("s").alias("height"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("round"))
    return merges


def leaf_order(merges: list[tuple[str, str, float]]) -> list[str]:
    """The rows in the order in which the tree draws them, from (a, b, height) of all merges: as many as the picture has rows."""
    groups: dict[str, list[str]] = {}
    for a, b, _ in sorted(merges, key=lambda m: (m[2], m[0], m[1])):
        groups[a] = groups.get(a, [a]) + groups.pop(b, [b])
    return [x for g in sorted(groups.values()) for x in g]

"""Aggregations. Each is one grouped aggregate with partial sums before the exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable


def with_totals(df: DataFrame, scope: Sequence[str], totals: Sequence[Column], of: DataFrame | None = None) -> DataFrame:
    """Each row with aggregates of its scope (of `of`, by default of df itself). Sums are partial before the exchange and the small
    result is joined back, so a scope with most of the rows does not fill one task as a window over it would. A null scope is one."""
    keys = [F.col(c) for c in scope] or [F.lit(0)]
    table = (df if of is None else of).groupBy(*[k.alias(f"__scope_{i}") for i, k in enumerate(keys)]).agg(*totals)
    same = F.lit(True)
    for i, key in enumerate(keys):
        same &= key.eqNullSafe(F.col(f"__scope_{i}"))
    return df.join(table, same).drop(*[f"__scope_{i}" for i in range(len(keys))])


def best_hit(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by the order, whose last entries break ties. Nulls in the order sort first.
    A minimum over structs: no sort, no window, and partial minima before the exchange."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"__{i}") for i, o in enumerate(order)], F.struct(*rest).alias("__row"))
    return df.groupBy(*keys).agg(F.min(ranked).alias("__m")).select(*keys, *[F.col(f"__m.__row.{c}").alias(c) for c in rest])


def group_size(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows of each key; rows with a null key are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(name))


def frequency_desc(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Counts of each value, the most frequent first, then by value."""
    return df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def word_frequency(df: DataFrame, text: Column) -> DataFrame:
    """Counts of words between white space."""
    words = df.select(F.explode(F.split(text, r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word")


def proximity_score(df: DataFrame, group: str, relative: str, scope: Sequence[str] = (), products: str | None = None) -> DataFrame:
    """For each group of a scope: total_gene, total_r, average_r, score = sum(1 / (|relative| + 1)) * n^2 / N * 100 with N the rows
    of the scope, readme_score = n / sum(relative) * n^2 / N * 100 and, where asked for, products (sorted, copies included).
    products holds every row of a group in one value, so ask for it only where a group fits a row; otherwise keep the rows."""
    keys = [*scope, group]
    n, total = F.count("*"), F.sum(F.col(relative).cast("double"))
    measures = [n.alias("total_gene"), total.alias("total_r"), F.sum(1.0 / (F.abs(F.col(relative).cast("double")) + 1)).alias("__near")]
    if products:
        measures.append(F.sort_array(F.collect_list(products)).alias("products"))
    # The input may be dear, so it is read once: its groups are computed, and their rows are the scope's rows.
    groups = with_totals(durable(df.groupBy(*keys).agg(*measures)), scope, [F.sum("total_gene").alias("__whole")])
    weight = F.col("total_gene") * F.col("total_gene") / F.col("__whole") * 100
    return groups.select(
        *keys,
        "total_gene",
        "total_r",
        (F.col("total_r") / F.col("total_gene")).alias("average_r"),
        (F.col("__near") * weight).alias("score"),
        (F.try_divide(F.col("total_gene").cast("double"), F.col("total_r") + 1e-6) * weight).alias("readme_score"),
        *(["products"] if products else []),
    )


def category_percentage(df: DataFrame, keys: Sequence[str], condition: Column, name: str = "percent") -> DataFrame:
    """Share of rows that meet the condition, in per cent; 0 where there are none."""
    share = F.try_divide(F.count_if(condition) * 100.0, F.count("*").cast("double"))
    return df.groupBy(*keys).agg(F.coalesce(share, F.lit(0.0)).alias(name))


def document_flags(df: DataFrame, items: str, flags: dict[str, callable]) -> DataFrame:
    """One row: documents in all, with items, and for each flag the documents with a matching item and the matching items."""
    values = F.coalesce(F.col(items), F.array().cast(df.schema[items].dataType))
    out = [F.count("*").alias("documents"), F.count_if(F.size(values) > 0).alias("non_empty")]
    for name, test in flags.items():
        out += [F.count_if(F.exists(values, test)).alias(f"{name}_documents"), F.coalesce(F.sum(F.size(F.filter(values, test)).cast("long")), F.lit(0)).alias(f"{name}_items")]
    return df.agg(*out)


def share_bucket(df: DataFrame, scope: Sequence[str], label: str, value: str, share: float, other: str = "Other") -> DataFrame:
    """Labels whose value is a smaller share of their scope's total become `other`, and are added up."""
    counted = with_totals(df, scope, [F.sum(value).alias("__total")])
    kept = F.when(F.try_divide(F.col(value).cast("double"), F.col("__total")) >= share, F.col(label)).otherwise(F.lit(other))
    return counted.withColumn(label, kept).groupBy(*scope, label).agg(F.sum(value).alias(value))


def minmax_scale(df: DataFrame, scope: Sequence[str], value: Column, name: str) -> DataFrame:
    """Value scaled to 0 to 1 inside its scope; 0 where all are equal."""
    raw = with_totals(df.withColumn("__v", value), scope, [F.min("__v").alias("__low"), F.max("__v").alias("__high")])
    scaled = F.coalesce(F.try_divide(F.col("__v") - F.col("__low"), F.col("__high") - F.col("__low")), F.lit(0.0))
    return raw.withColumn(name, scaled).drop("__v", "__low", "__high")


def mean_pairwise(pairs: DataFrame, distance: str) -> DataFrame:
    return pairs.agg(F.coalesce(F.avg(distance), F.lit(0.0)).alias("mean_distance"), F.count("*").alias("pairs"))


def mean_p_distance(df: DataFrame, text: str) -> DataFrame:
    """mean_distance and pairs: what mean_pairwise gives for the p-distances of all pairs of texts, without making the pairs. Texts of
    equal length agree at a place as often as their letters there meet, so counts of letters by length and place suffice. Null
    texts are left out; a pair with an empty text has distance 0."""
    texts = df.where(F.col(text).isNotNull()).select(F.length(text).alias("size"), F.split(text, "").alias("letters"))
    sizes = texts.groupBy("size").agg(F.count("*").alias("n"))
    counts = texts.where("size > 0").select("size", F.posexplode("letters").alias("place", "letter")).groupBy("size", "place", "letter").agg(F.count("*").alias("c"))
    side = lambda t, s: t.withColumnsRenamed({c: f"{c}_{s}" for c in t.columns if c not in ("place", "letter")})
    one, two = side(counts, "a"), side(counts, "b")
    alike = one.join(two, ["place", "letter"]).where("size_a <= size_b").groupBy("size_a", "size_b").agg(F.sum(F.when(F.expr("size_a = size_b"), F.expr("c_a * (c_b - 1) / 2")).otherwise(F.expr("c_a * c_b"))).alias("alike"))
    met = side(sizes, "a").join(side(sizes, "b"), F.col("size_a") <= F.col("size_b"))  # of lengths, not of texts
    met = met.withColumn("pairs", F.when(F.expr("size_a = size_b"), F.expr("n_a * (n_b - 1) div 2")).otherwise(F.expr("n_a * n_b")))
    whole = met.join(alike, ["size_a", "size_b"], "left")
    far = F.when(F.col("size_a") == 0, 0.0).otherwise(F.col("pairs") - F.coalesce("alike", F.lit(0.0)) / F.col("size_a"))
    pairs = F.coalesce(F.sum("pairs"), F.lit(0)).cast("long")
    return whole.agg(F.coalesce(F.try_divide(F.sum(far), F.sum("pairs").cast("double")), F.lit(0.0)).alias("mean_distance"), pairs.alias("pairs"))


def compare_means(a: Column, b: Column) -> Column:
    return F.when(a > b, "first").when(b > a, "second").otherwise("equal")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows with their place in the ascending order, from 0 and without gaps; nulls come first, the order of equal rows is open. Ranges
    of the order are sorted side by side and begin where the ranges before them end, so no task holds the whole table; rows that
    are equal in all of `order` lie in one range."""
    # The ranges must not change when they are read again.
    ranged = durable(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = ranged.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__inside", inside).join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + F.col("__inside") - 1).drop("__range", "__before", "__inside")


def sankey(df: DataFrame, source: str, target: str, share: float, scope: Sequence[str]) -> DataFrame:
    """source, target, value of the links between two columns, rare targets joined as Other, with dense numbers for
    the nodes: sources first, then targets, each in alphabetical order."""
    links = share_bucket(group_size(df, [source, target], "value"), scope, target, "value", share)
    links = links.groupBy(source, target).agg(F.sum("value").alias("value"))
    nodes = links.select(F.lit(0).alias("side"), F.col(source).alias("label")).union(links.select(F.lit(1), target)).distinct()
    placed = numbered(nodes, ["side", "label"], "node").withColumn("node", F.col("node").cast("int"))
    left = placed.where("side = 0").select(F.col("label").alias(source), F.col("node").alias("source_id"))
    right = placed.where("side = 1").select(F.col("label").alias(target), F.col("node").alias("target_id"))
    return links.join(left, source).join(right, target).select("source_id", "target_id", source, target, "value")

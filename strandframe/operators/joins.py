"""Joins. The equality part is the join key, so Spark may choose broadcast, sort-merge or shuffled hash and split skewed keys."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import durable
from .aggregates import best_hit


def semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def anti_join(df: DataFrame, existing: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(existing, list(on), "left_anti")


def lookup_join(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Columns of a table with unique keys. how='inner' drops rows without an entry; missing_keys reports them."""
    return df.join(table, list(on), how)


def missing_keys(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.select(*on).distinct().join(table, list(on), "left_anti")


def nearest_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_key: Sequence[str], distance: Column, tie: Sequence[str], max_distance: float | None = None, band: tuple[str, str, int] | None = None) -> DataFrame:
    """For each left row its right row of least distance on the same key; ties go to the first by `tie`. Left rows that are equal
    in `on` and left_key are one.

    distance is over columns of both sides, whose names must differ except for `on`. With band = (left position, right position,
    width) only right rows in the same or a neighbouring band of that width are met, which is exact for max_distance <= width
    and keeps a large key from meeting itself in full. A right row may serve several left rows.
    """
    if band and (max_distance is None or max_distance > band[2]):
        raise ValueError("a band must be as wide as max_distance at least: partners beyond it would be lost")
    if band:
        left_at, right_at, width = band
        left = left.withColumn("__band", F.explode(F.array(*[F.floor(F.col(left_at) / width) + i for i in (-1, 0, 1)])))
        right = right.withColumn("__band", F.floor(F.col(right_at) / width))
    keys = [*on, "__band"] if band else list(on)
    rest = [c for c in right.columns if c not in keys]
    pairs = left.join(right, keys).withColumn("__d", distance)
    if max_distance is not None:
        pairs = pairs.where(F.col("__d") <= max_distance)
    best = pairs.groupBy(*on, *left_key).agg(F.min(F.struct("__d", *tie, F.struct(*rest).alias("__r"))).alias("m"))
    return best.select(*on, *left_key, F.col("m.__d").alias("distance"), *[F.col(f"m.__r.{c}").alias(c) for c in rest])


def nearest_sorted(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, tie: str) -> DataFrame:
    """Each left row with its right row of the same key whose position is nearest, at any distance; ties go to the least `tie`. Left
    rows without a partner go. Null keys have no partner.

    Both sides are dealt over ranges of (key, position), so a key with most of the rows is spread; in a range the neighbours on
    either side are found in one pass each way. Where a range begins or ends inside a key, the last partner of the ranges before
    it and the first of those after it are carried over: a row for each range and key."""
    rest = [c for c in right.columns if c not in on]
    best = right.where(F.col(right_at).isNotNull()).groupBy(*on, F.col(right_at).alias("__at")).agg(F.min(F.struct(tie, *[c for c in rest if c != tie])).alias("__r"))
    rows = left.where(F.col(left_at).isNotNull())
    both = rows.select(*on, F.col(left_at).alias("__at"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(best.schema["__r"].dataType).alias("__r")).unionByName(best.withColumn("__l", F.lit(None).cast(T.StructType(left.schema.fields))))
    both = both.where(functools.reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in on]))
    # The ranges must not change when they are read again.
    ranged = durable(both.repartitionByRange(*on, "__at").withColumn("__range", F.spark_partition_id()))
    up_to_here = lambda order: Window.partitionBy("__range", *on).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.when(F.col("__r").isNotNull(), F.struct("__at", "__r"))
    # Both are growing frames, one in descending order: a frame that shrinks would be read anew for every row.
    before, after = (F.last(found, ignorenulls=True).over(up_to_here(o)) for o in (F.asc("__at"), F.desc("__at")))
    # What other ranges of a key bring: their last and first partners, by the ranges' order.
    ends = ranged.groupBy("__range", *on).agg(F.max(F.when(F.col("__r").isNotNull(), F.struct("__at", F.col(f"__r.{tie}").alias("t"), "__r"))).alias("z"), F.min(F.when(F.col("__r").isNotNull(), F.struct("__at", F.col(f"__r.{tie}").alias("t"), "__r"))).alias("y"))
    of_key = Window.partitionBy(*on).orderBy("__range")
    carried = ends.select(
        "__range", *on,
        F.last("z", ignorenulls=True).over(of_key.rowsBetween(Window.unboundedPreceding, -1)).alias("__z"),
        F.first("y", ignorenulls=True).over(of_key.rowsBetween(1, Window.unboundedFollowing)).alias("__y"),
    )
    nearby = ranged.withColumns({"__b": before, "__a": after}).where("__l IS NOT NULL").join(carried, ["__range", *on])
    nearby = nearby.withColumns({"__b": F.coalesce("__b", F.when(F.col("__z").isNotNull(), F.struct("__z.__at", "__z.__r"))), "__a": F.coalesce("__a", F.when(F.col("__y").isNotNull(), F.struct("__y.__at", "__y.__r")))})
    met = nearby.where("__b IS NOT NULL OR __a IS NOT NULL")
    ranked = F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col("__at") - F.col(f"{s}.__at")).alias("d"), F.col(f"{s}.__r.{tie}").alias("t"), F.col(f"{s}.__r").alias("r"))) for s in ("__b", "__a")])
    nearest = met.withColumn("__m", F.array_min(F.array_compact(ranked)))
    return nearest.select(*[F.col(f"__l.{c}").alias(c) for c in left.columns], F.col("__m.d").alias("distance"), *[F.col(f"__m.r.{c}").alias(c) for c in rest])


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str], finest: int = 10, levels: int = 22) -> DataFrame:
    """Pairs of a left and a right row of the same key whose half-open ranges (start, end) share a place, at any length; columns of
    both, whose names must differ except for `on`. Ranges that are empty or null share none.

    A range lies in the least bin that holds it, in bins of 2^finest places and twice, four times, ... that. Two ranges that overlap
    lie in one bin or in bins of which one holds the other, so a range meets those of its own bin, of the bins around it and of the
    bins inside it, never the whole key. Each row is copied once for each of `levels` sizes; Spark takes the copies for as small as
    the rows, so they must not be broadcast."""

    def binned(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        start, last = (F.col(ends[0]).cast("long"), F.col(ends[1]).cast("long") - 1)
        known = df.where(F.col(ends[0]) < F.col(ends[1]))
        bins = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.when(k < levels, F.call_function("shiftright", start, k + finest)).otherwise(0).alias("bin"), ((k == levels) | (F.call_function("shiftright", start, k + finest) == F.call_function("shiftright", last, k + finest))).alias("holds")))
        return known.withColumn("__bins", F.filter(bins, lambda b: b["holds"])).withColumns({"__own": F.col("__bins")[0]})

    def at(df: DataFrame, place: str | None) -> DataFrame:
        """In its own bin, or (a list) in those around it."""
        bin_ = F.col("__own") if place == "own" else F.explode(F.col("__bins") if place == "all" else F.slice("__bins", F.lit(2), F.lit(levels + 1)))
        return df.withColumn("__bin", bin_).withColumns({"__level": F.col("__bin.level"), "__bin": F.col("__bin.bin")}).drop("__bins", "__own")

    one, two = binned(left, left_range), binned(right, right_range)
    keys = [*on, "__level", "__bin"]
    shared = (F.col(left_range[0]) < F.col(right_range[1])) & (F.col(right_range[0]) < F.col(left_range[1]))
    met = at(one, "own").join(at(two, "all").hint("merge"), keys).unionByName(at(one, "around").hint("merge").join(at(two, "own"), keys))
    return met.where(shared).drop("__level", "__bin")


def window_proximity(targets: DataFrame, features: DataFrame, on: Sequence[str], target: tuple[str, str], feature: tuple[str, str], reach: int, length: str | None = None, max_overlap: float | None = None) -> DataFrame:
    """Features that lie wholly within `reach` of a target of the same key, with side and gap. Features that overlap the target by
    more than max_overlap per cent of the hull are left out.

    Ranges meet through bands of twice the reach: a target visits the bands its window touches, a feature is in the band of its
    start, so a key with many rows is met piece by piece."""
    from ..functions import scalars as S

    width = max(1, 2 * reach)
    ts, te, fs, fe = (F.col(c) for c in (*target, *feature))
    low, high = S.clamp_window(ts, te, F.col(length) if length else F.lit(None).cast("long"), reach)
    seen = targets.withColumns({"__low": low, "__high": high})
    seen = seen.withColumn("__band", F.explode(F.sequence(F.floor(F.col("__low") / width), F.floor(F.col("__high") / width))))
    pairs = seen.join(features.withColumn("__band", F.floor(fs / width)), [*on, "__band"]).where((fs >= F.col("__low")) & (fe <= F.col("__high")))
    if max_overlap is not None:
        pairs = pairs.where(S.overlap_percent(ts, te, fs, fe) <= max_overlap)
    return pairs.withColumns({"side": S.side(ts, fs), "gap": S.signed_gap(ts, te, fs, fe)}).drop("__low", "__high", "__band")


def interval_exact_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each left row the first right row of equal key and bounds: the right side is reduced to one row a key, with partial
    minima, before the two meet."""
    best = best_hit(right, on, [F.col(c) for c in order])
    return left.select(*on, *left_key).join(best, list(on))


def self_pairs(df: DataFrame, key: str, on: Sequence[str] = ()) -> DataFrame:
    """All pairs of rows inside a block (`on`), each once: columns with suffixes _a and _b. Without a block it is all pairs of the
    table: for small sets of representatives only."""
    rest = [c for c in df.columns if c not in on]
    a = df.select(*on, *[F.col(c).alias(f"{c}_a") for c in rest])
    b = df.select(*on, *[F.col(c).alias(f"{c}_b") for c in rest])
    before = F.col(f"{key}_a") < F.col(f"{key}_b")
    return a.join(b, list(on)).where(before) if on else a.join(b, before)


def pairs_by_class(
    df: DataFrame, key: str, on: Sequence[str], by: Sequence[str], values: Mapping[str, Column], meet: Callable[[DataFrame, DataFrame], DataFrame] | None = None, longest: int = 256, pairs_a_task: int = 1 << 24
) -> DataFrame:
    """All pairs of rows of a block (`on`), each once, the lesser key first: {key}_a, {key}_b and `values`, which are columns over those
    of `by`, with suffixes _a and _b. Null keys and null blocks have no pairs.

    Rows equal in `on` and `by` are a class, and the pairs of two classes have the same values: these are found once, and the keys
    come as lists of at most `longest`. meet joins the classes, left (_a) and right (_b), where not all of a block belong together.
    As the result grows with the square of a class while its keys do not, the number of tasks follows from the number of pairs."""
    place = Window.partitionBy(*on, *by).orderBy(key)
    dealt = df.where(F.col(key).isNotNull()).select(key, *on, *by).withColumn("__list", F.floor((F.row_number().over(place) - 1) / longest))
    lists = dealt.groupBy(*on, *by, "__list").agg(F.sort_array(F.collect_list(key)).alias("__keys")).drop("__list")
    # Lists are named before they are stored: both sides must know them by the same names.
    lists = durable(lists.withColumn("__id", F.monotonically_increasing_id()))

    def side(s: str) -> DataFrame:
        return lists.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in by], F.col("__id").alias(f"__{s}"), F.size("__keys").cast("long").alias(f"__n_{s}"), F.col("__keys")[0].alias(f"__least_{s}"), F.element_at("__keys", -1).alias(f"__most_{s}"))

    def keys(s: str) -> DataFrame:
        return lists.select(F.col("__id").alias(f"__{s}"), F.col("__keys").alias(f"__keys_{s}"))

    met = meet(side("a"), side("b")) if meet else side("a").join(side("b"), list(on))
    met = met.where("__least_a < __most_b")
    pairs = met.agg(F.sum(F.col("__n_a") * F.col("__n_b"))).first()[0] or 0
    tasks = max(math.ceil(pairs / pairs_a_task), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / (1 << 18))), 1)
    one = met.select("__a", "__b", *[c.alias(n) for n, c in values.items()]).join(keys("a"), "__a")
    both = one.repartition(tasks, "__b").join(keys("b").repartition(tasks, "__b"), "__b")
    first = both.select(F.explode("__keys_a").alias(f"{key}_a"), "__keys_b", *values)
    return first.select(f"{key}_a", F.explode("__keys_b").alias(f"{key}_b"), *values).where(F.col(f"{key}_a") < F.col(f"{key}_b"))


def merge_structs(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Columns of both; where both have a column, the right value wins if there is a right row."""
    common = [c for c in right.columns if c in left.columns and c not in on]
    mark = right.withColumnsRenamed({c: f"__{c}" for c in common}).withColumn("__there", F.lit(True))
    joined = left.join(mark, list(on), how)
    new = {c: F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)) for c in common}
    return joined.withColumns(new).drop("__there", *[f"__{c}" for c in common])

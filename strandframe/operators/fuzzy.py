"""Similar texts of a scope by an inverted index, and greedy groups of them in parallel rounds.

A join of similar texts never compares all pairs. Texts that are as similar as the threshold asks share most of their pairs of
letters (bigrams), so they share one among the rarest few of each: these alone are indexed, in one order of rareness. How many
are needed follows from a text's length. Texts with too few different bigrams for that meet in bands of length. Texts so short
that the threshold lets at most one edit meet by what one edit leaves: names made of few letters share bigrams widely. Every pair
that meets is then scored.

Greedy leaders are the texts that no earlier leader resembles. In the graph of similar pairs, a text without an earlier neighbour
leads; what it resembles does not; both leave, and the next round begins. The order of texts alone decides, so the rounds end
with the leaders that one pass over the texts in order would find. A round is two joins on the pairs left; their number is the
longest chain of decisions that hang on each other, a few in practice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import likeness
from ..functions import scalars as S
from ..session import durable

_Q = 2
_EPS = 1e-9
_MARK = "\x00"


def _bigrams(c: Column) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(_Q)))
    return F.when(F.length(c) >= _Q, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0)


def _ranked_tokens(texts: DataFrame, keys: Sequence[str], tokens: Column) -> DataFrame:
    """keys, token and n: each text's tokens with how many texts of the scope hold them."""
    rows = texts.select(*keys, "low", F.explode(tokens).alias("token"))
    scope = [k for k in keys if k != "text"]
    counts = rows.groupBy(*scope, "token").agg(F.count("*").alias("n"))
    return rows.join(counts, [*scope, "token"])


def _met(left: DataFrame, right: DataFrame, on: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """Pairs of texts that meet, the lesser text first."""
    pairs = left.select(*on, F.col("text").alias("x")).join(right.select(*on, F.col("text").alias("y")), list(on)).where("x <> y")
    return pairs.select(*scope, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _sharing_rare_tokens(texts: DataFrame, scope: Sequence[str], tokens: Column, lost: Column, factor: float, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs that may differ in no more than `lost` of their tokens, on either side, whose lengths differ by `factor` at most; only
    those wanted by the length of the longer, but for pairs of texts with few tokens."""
    keys = [*scope, "text"]
    sized = texts.withColumns({"__tokens": tokens, "__lost": lost})
    order = Window.partitionBy(*keys).orderBy("n", "token")
    ranked = _ranked_tokens(sized, [*keys, "__lost"], F.col("__tokens")).withColumn("__place", F.row_number().over(order))
    first = ranked.where(F.col("__place") <= F.col("__lost") + 1).select(*keys, F.length("low").alias("size"), "token")
    left, right = first.withColumnRenamed("text", "x"), first.withColumnsRenamed({"text": "y", "size": "size_y"})
    near = (F.col("x") < F.col("y")) & (F.greatest("size", "size_y") <= F.least("size", "size_y") * (factor + _EPS))
    near = near & wanted(F.greatest("size", "size_y")) if wanted else near
    met = left.join(right, [*scope, "token"]).where(near).select(*scope, F.col("x").alias("a"), F.col("y").alias("b"))
    # Texts that could lose all their tokens: by bands of length, a band and the next.
    band = F.floor(F.log(F.greatest(F.length("low"), F.lit(1)).cast("double")) / math.log(max(factor, 1 + 1e-6))).cast("long")
    weak = sized.where((F.size("__tokens") <= F.col("__lost")) & (F.length("low") > 0)).select(*keys, band.alias("band"))
    beside = weak.select(*keys, F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    return met.unionByName(_met(weak, beside, [*scope, "band"], scope))


def _one_edit_apart(texts: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Pairs of equal forms or of forms that one edit makes equal; `edits` tells whether a text may be edited.

    Two forms of one length that differ in a place are equal with a mark there; of two others, the longer is the shorter with a
    letter left out. As many texts meet at a form with a mark as there are letters."""
    keys = [*scope, "text"]
    low, places = F.col("low"), F.sequence(F.lit(1), F.length("low"))
    without = lambda mark: F.transform(places, lambda i: F.concat(F.substring(low, F.lit(1), i - 1), F.lit(mark), F.substring(low, i + 1, F.length(low))))
    may = lambda c: F.when(F.col("edits") > 0, c).otherwise(F.array().cast("array<string>"))
    form = lambda c: F.xxhash64(c).alias("form")
    marked = texts.select(*keys, F.explode(F.concat(F.array("low"), may(without(_MARK)))).alias("f")).select(*keys, form("f"))
    left, right = marked.withColumnRenamed("text", "x"), marked.withColumnRenamed("text", "y")
    met = left.join(right, [*scope, "form"]).where("x < y").select(*scope, F.col("x").alias("a"), F.col("y").alias("b"))
    shorter = texts.select(*keys, F.explode(may(F.array_distinct(without("")))).alias("f")).select(*keys, form("f"))
    return met.unionByName(_met(shorter, texts.select(*keys, form("low")), [*scope, "form"], scope))


def _candidates_by_edits(texts: DataFrame, scope: Sequence[str], threshold: float) -> DataFrame:
    edits = lambda size: F.floor((1 - threshold) * size + _EPS)
    # The longer text has size / threshold letters at most; an edit touches two bigrams.
    lost = _Q * edits(F.floor(F.length("low") / threshold + _EPS))
    own = texts.withColumn("edits", edits(F.length("low")))
    one = _one_edit_apart(own.where("edits < 2"), scope)
    # The longer of the other pairs may have more edits: scopes without such a text end here.
    several = own.where(lost >= 2 * _Q)
    if scope:
        several = several.join(own.where("edits >= 2").select(*scope).distinct(), list(scope), "left_semi")
    return one.unionByName(_sharing_rare_tokens(several, scope, _bigrams(F.col("low")), lost, 1 / threshold, lambda size: edits(size) >= 2))


def _candidates_by_subsequence(texts: DataFrame, scope: Sequence[str], threshold: float, form: Column, padded: bool) -> DataFrame:
    """Pairs whose forms may have a common subsequence of `threshold` of their lengths."""
    formed = texts.withColumn("low", form).where(F.length("low") > 0)
    size = F.length("low") + (2 if padded else 0)
    # Letters left out on both sides: (1 - t) (n + m), with m <= n (2 / t - 1).
    lost = _Q * F.floor((1 - threshold) * 2 * size / threshold + _EPS)
    grams = _bigrams(F.concat(F.lit(" "), F.col("low"), F.lit(" ")) if padded else F.col("low"))
    return _sharing_rare_tokens(formed, scope, grams, lost, 2 / threshold - 1 + (0.5 if padded else 0))


def _candidates_by_words(texts: DataFrame, scope: Sequence[str], threshold: float) -> DataFrame:
    """Pairs where nearly all the words of one text, by length, may be among the other's: the rarest of the one that could not all be
    missing look among all words of the other."""
    keys = [*scope, "text"]
    ratio = 2 * (1 - threshold) / threshold
    ranked = _ranked_tokens(texts, keys, F.array_distinct(_words(F.col("low")))).withColumn("__size", F.length("token") + 1)
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("n", "token")
    summed = ranked.withColumns({"__all": F.sum("__size").over(whole), "__before": F.sum("__size").over(order) - F.col("__size")})
    probing = summed.where(F.col("__before") <= F.col("__all") * (ratio / (1 + ratio)) + 1 + _EPS)
    return _met(probing, ranked, [*scope, "token"], scope)


def _candidates_by_stretch(texts: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Pairs where one text may lie in the other whole: the rarest bigram of the one looks among all of the other's; a single letter
    looks among the letters of texts that are not too long for it."""
    keys = [*scope, "text"]
    letters = F.when(F.length("low") <= int(likeness.MUCH_LONGER), F.array_distinct(F.filter(F.split("low", ""), lambda x: F.length(x) > 0))).otherwise(F.array().cast("array<string>"))
    ranked = _ranked_tokens(texts, keys, F.array_union(_bigrams(F.col("low")), letters))
    own = ranked.where((F.length("token") == _Q) | (F.length("low") == 1))
    rarest = own.groupBy(*keys).agg(F.min(F.struct("n", "token")).alias("m")).select(*keys, F.col("m.token").alias("token"))
    return _met(rarest, ranked, [*scope, "token"], scope)


def similar_pairs(texts: DataFrame, scope: Sequence[str], threshold: float, scorer: str = "edit") -> DataFrame:
    """scope, a, b (the lesser text first) and score of every pair of different texts of a scope that score threshold or more, each
    once. texts: the scope's columns and `text`, without repeated rows; null and empty texts resemble nothing.

    scorer "edit": 1 less the edit distance of the lower-cased texts over the longer one's length. "words": the same of their
    words in alphabetical order. "weighted": see `functions.likeness`; for thresholds of 0.9 and more, as less would let
    stretches count that no rare token gives away."""
    if not 0 < threshold:
        raise ValueError("a threshold must be over 0")
    forms = {"edit": F.lower("text"), "words": F.array_join(F.array_sort(_words(F.lower("text"))), " "), "weighted": F.lower("text")}
    if scorer not in forms:
        raise ValueError(f"no scorer {scorer}; there are {', '.join(forms)}")
    if scorer == "weighted" and threshold < likeness.STRETCH:
        raise ValueError(f"the weighted score takes thresholds of {likeness.STRETCH} and more")
    known = texts.where(F.col("text").isNotNull()).select(*scope, "text", forms[scorer].alias("low")).where(F.length("low") > 0)
    limit = min(threshold, 1.0)
    if scorer == "weighted":
        met = _candidates_by_subsequence(known, scope, limit, F.col("low"), False)
        of_words = limit / likeness.WORDS
        if of_words <= 1:
            words = _words(F.col("low"))
            for form in (F.array_join(F.array_sort(words), " "), F.array_join(F.array_sort(F.array_distinct(words)), " ")):
                met = met.unionByName(_candidates_by_subsequence(known, scope, of_words, form, True))
            met = met.unionByName(_candidates_by_words(known, scope, of_words))
        if limit <= likeness.STRETCH:
            met = met.unionByName(_candidates_by_stretch(known, scope))
    else:
        met = _candidates_by_edits(known, scope, limit)
    pairs = met.distinct()
    if scorer == "weighted":
        scored = pairs.withColumn("score", likeness.weighted_likeness(F.col("a"), F.col("b")))
    else:
        low = lambda c: forms[scorer] if c is None else (F.lower(c) if scorer == "edit" else F.array_join(F.array_sort(_words(F.lower(c))), " "))
        scored = pairs.withColumn("score", S.levenshtein_similarity(low("a"), low("b")))
    return scored.where(F.col("score") >= threshold)


def greedy_followers(pairs: DataFrame, scope: Sequence[str], durably: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """scope and text of the texts that an earlier leader resembles. pairs: scope, earlier and later text of each similar pair, from
    a table that is cheap to read."""
    left, followers = pairs.select(*scope, "earlier", "later"), None
    while not left.isEmpty():
        waiting = left.select(*scope, F.col("later").alias("earlier")).distinct()
        leads = left.select(*scope, "earlier").distinct().join(waiting, [*scope, "earlier"], "left_anti")
        led = durably(left.join(leads, [*scope, "earlier"], "left_semi").select(*scope, F.col("later").alias("text")).distinct())
        followers = led if followers is None else followers.unionByName(led)
        for side in ("earlier", "later"):
            left = left.join(led.withColumnRenamed("text", side), [*scope, side], "left_anti")
        left = durably(left)
    return left.select(*scope, F.col("later").alias("text")) if followers is None else followers


def fuzzy_group(df: DataFrame, scope: Sequence[str], text: str, position: str, rules: Sequence[tuple[str, str]] = (), threshold: float = 0.9, scorer: str = "edit") -> DataFrame:
    """scope, text and group of each distinct text: the rule's group, else a founder's name.

    Rows are in order of position and then text; those without a position come last. Founders are the greedy leaders among the
    texts without a rule in order of first appearance. A text belongs to its most similar founder among those founded before its
    own last occurrence (the earlier one where equal). scorer: see `similar_pairs`. Null texts go; null scopes are scopes of
    their own."""
    at = F.coalesce(F.col(position).cast("double"), F.lit(float("inf")))
    # Names of scopes may clash with those in use here, and null scopes must meet themselves.
    names = [f"__s{i}" for i in range(len(scope))]
    own = df.where(F.col(text).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(scope, names)], F.col(text).alias("text"), at.alias("at"))
    if scope:
        own = own.withColumn("scope", F.to_json(F.struct(*[F.struct(F.col(n).alias("v")) for n in names])))
    else:
        own = own.withColumn("scope", F.lit(""))
    stats = durable(own.groupBy("scope", *names, "text").agg(F.min("at").alias("first"), F.max("at").alias("last")))
    group = S.keyword_classify(F.col("text"), rules, F.lit(None).cast("string")) if rules else F.lit(None).cast("string")
    ruled = stats.withColumn("group", group)
    free = ruled.where("group IS NULL").select("scope", "text", F.struct("first", "text").alias("born"), "last")
    similar = similar_pairs(free.select("scope", "text"), ["scope"], threshold, scorer)
    born = lambda side: free.select("scope", F.col("text").alias(side), F.col("born").alias(f"born_{side}"), F.col("last").alias(f"last_{side}"))
    edges = durable(similar.join(born("a"), ["scope", "a"]).join(born("b"), ["scope", "b"]))
    first = F.col("born_a") < F.col("born_b")
    followers = greedy_followers(edges.select("scope", F.when(first, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("later")), ["scope"])
    both_ways = edges.select("scope", F.explode(F.array(*[
        F.struct(F.col(x).alias("text"), F.struct(F.col(f"last_{x}").alias("at"), F.col(x).alias("t")).alias("until"), F.col(f"born_{y}").alias("born"), F.col(y).alias("founder"), "score")
        for x, y in (("a", "b"), ("b", "a"))
    ])).alias("e")).select("scope", "e.*")
    open_ = both_ways.where(F.struct(F.col("born.first"), F.col("born.text")) < F.struct(F.col("until.at"), F.col("until.t")))
    of_founders = open_.join(followers, ["scope", "text"], "left_semi").join(followers.withColumnRenamed("text", "founder"), ["scope", "founder"], "left_anti")
    best = of_founders.groupBy("scope", "text").agg(F.min(F.struct((-F.col("score")).alias("s"), "born", "founder"))["founder"].alias("best"))
    found = ruled.join(best, ["scope", "text"], "left").withColumn("group", F.coalesce("group", "best", "text"))
    return found.select(*[F.col(n).alias(c) for c, n in zip(scope, names)], F.col("text").alias(text), "group")

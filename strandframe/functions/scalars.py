"""Scalar column expressions. All are built-in functions, so they stay inside generated code.

Null in, null out, unless a docstring says otherwise. Where a pattern or a position is absent the result is null.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def absent_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def split_part(c: Column, separator: str, n: int) -> Column:
    """The n-th part (from 1)."""
    return absent_to_null(F.split_part(c, F.lit(separator), F.lit(n)))


def prefix_join(c: Column, separator: str = "_", parts: int = 3) -> Column:
    """The first parts, still joined; null where there are no more than these."""
    return F.when(F.size(F.split(c, re.escape(separator))) > parts, F.substring_index(c, separator, parts))


def rename_header(header: Column, base: Column, number: Column) -> Column:
    """base_number_name, the name being the header's first word up to its first bar."""
    name = F.split_part(F.split(F.ltrim(header), r"\s+")[0], F.lit("|"), F.lit(1))
    return F.concat_ws("_", base, number.cast("string"), name)


def header_parse(header: Column) -> Column:
    """Struct of kind, start, end, contig and reject from a header `kind | ... | start-end | contig`.
    A header that does not have this form keeps its text in reject, other fields null."""
    parts = F.transform(F.split(header, r"\|"), lambda x: F.trim(x))
    bounds = F.try_element_at(parts, F.lit(-2))
    fine = (F.size(parts) >= 3) & bounds.rlike(r"^\d+-\d+$")
    number = lambda i: F.when(fine, F.regexp_extract(bounds, r"^(\d+)-(\d+)$", i).try_cast("int"))
    return F.struct(
        F.when(fine, F.try_element_at(parts, F.lit(1))).alias("kind"),
        number(1).alias("start"),
        number(2).alias("end"),
        F.when(fine, F.try_element_at(parts, F.lit(-1))).alias("contig"),
        F.when(~F.coalesce(fine, F.lit(False)), header).alias("reject"),
    )


def header_compose(kind: Column, name: Column, start: Column, end: Column, contig: Column) -> Column:
    """`kind | name | start-end | contig`; a null name reads unknown."""
    return F.concat_ws(" | ", kind, F.coalesce(name, F.lit("unknown")), F.concat_ws("-", start.cast("string"), end.cast("string")), contig)


def regex_extract(c: Column, pattern: str, group: int = 1) -> Column:
    return absent_to_null(F.regexp_extract(c, pattern, group))


def map_replace(c: Column, mapping: Mapping[str, str]) -> Column:
    """Mapped value; a value that is not mapped stays."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def first_token(c: Column, separators: str = r"[-/ ]") -> Column:
    return F.split(c, separators)[0]


def lineage_levels(c: Column, names: Sequence[str] = ("domain", "phylum", "class"), separator: str = "; ") -> list[Column]:
    """One column for each leading level; an absent level is empty, also where the lineage is null."""
    parts = F.split(c, re.escape(separator))
    return [F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")).alias(name) for i, name in enumerate(names)]


def char_replace(c: Column, old: str = "N", new: str = "-") -> Column:
    return F.translate(c, old, new)


def strip_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=[^/])\.[^./]*$", "")


def filename_to_dims(name: Column) -> Column:
    """Struct (group, value) of a file name group_value_rest.csv with three parts or more; else null."""
    parts = F.split(name, "_")
    return F.when((F.size(parts) >= 3) & F.try_element_at(parts, F.lit(3)).endswith(".csv"), F.struct(parts[0].alias("group"), parts[1].alias("value")))


def any_keyword(c: Column, keywords: Sequence[str]) -> Column:
    """Whether a text holds any of the keywords, whatever the case; null counts as no text."""
    return F.coalesce(F.lower(c).rlike("|".join(re.escape(k.lower()) for k in keywords)), F.lit(False))


def keyword_classify(c: Column, rules: Sequence[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """Group of the first rule whose keyword the lower-cased text holds."""
    low, chain = F.lower(c), F
    for keyword, group in rules:
        chain = chain.when(low.contains(keyword), group)
    return chain.otherwise(otherwise) if otherwise is not None else chain


def midpoint(start: Column, end: Column) -> Column:
    """Floor of the mean."""
    return F.floor((start.cast("long") + end.cast("long")) / 2).cast("long")


def overlap_percent(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection in per cent of the hull; 0 where the hull is empty."""
    inner = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.coalesce(F.try_divide(inner * 100.0, hull.cast("double")), F.lit(0.0))


def side(target_start: Column, start: Column) -> Column:
    return F.when(start < target_start, "left").otherwise("right")


def signed_gap(target_start: Column, target_end: Column, start: Column, end: Column) -> Column:
    """Distance from the target; negative where they overlap."""
    return F.when(start < target_start, target_start - end).otherwise(start - target_end)


def clamp_window(start: Column, end: Column, length: Column, reach: int) -> tuple[Column, Column]:
    """The range widened by `reach` on both sides, kept inside 0 to length; null length sets no end."""
    low = F.when(start.isNotNull(), F.greatest(F.lit(0), start - reach))
    return low, F.when(end.isNotNull(), F.least(length, end + reach))


def log10_eps(c: Column, eps: float = 1e-6) -> Column:
    return F.log10(c + F.lit(eps))


def row_max_center(columns: Sequence[str]) -> list[Column]:
    """Each column less the greatest of its row."""
    top = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    return [(F.col(c) - top).alias(c) for c in columns]


def p_distance(a: Column, b: Column) -> Column:
    """Share of places that differ, over the length of the shorter text; 0 where one is empty."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    shorter = F.least(F.length(a), F.length(b))
    return F.when(shorter == 0, 0.0).otherwise(F.try_divide(F.size(F.filter(pairs, lambda x: x)).cast("double"), shorter))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance of the lower-cased texts over the longer one's length; 1 for two empty texts."""
    low_a, low_b = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(low_a), F.length(low_b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(low_a, low_b) / longest)

"""Licence recognition by sentences: normalised sentences are looked up among known licence sentences, and the sequence of
their identifiers is matched against ordered licence rules.

SQL functions only. Each row is handled where it is read; no shuffle, no Python. The sentence table and the rules are
parameters of a size that does not depend on the data. Work is linear in a text: it is cut once, each piece is looked up in a
hash set, and one fold over the identifiers advances every rule. A text without any of a few words, one of which every known
sentence has, is not cut at all.

A text is cut into paragraphs at lines without letters and digits, a paragraph into sentences, whose lines are joined first. A
joined sentence counts by its lines where these tell more. A sentence is also cut before the opening words of a long known one, as
a name and a copyright line may stand before it without a mark between. Besides the one-line sentences below, the full
sentences, headers, notices and SPDX lines of `license_texts` are known; the SQL registered for the query knows the one-line
ones only and no wrapped sentence. A notice, or an SPDX expression, may name several licences joined by or, and, with.

Null and empty texts have no sentences and no licence. Unknown sentences between known ones do not break a rule: a rule
asks for its identifiers in order. Where several rules match, all are reported, in the order of the rules; `license` is
the first. A rule yields to those that say more: see YIELDS. Repeated rows each get their own result, an empty table none.
Columns pass by only when named in `keep`; a name that is also an output raises. A very long text is handled whole by one
expression, in memory of some times its size.
"""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_keep
from .license_texts import TEXT_RULES, notices, text_sentences

#: Normalised sentence -> identifier. Several wordings can share one.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under the gnu general public license version 2": "gpl-2",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "you may not use this file except in compliance with the license": "apache-terms",
    "you may obtain a copy of the license at": "apache-copy",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies": "mit-notice-kept",
    "the software is provided as is without warranty of any kind": "as-is",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "all rights reserved": "all-rights",
}

#: Ordered rules: (licence, identifiers that occur in this order, class).
RULES: list[tuple[str, list[str], str]] = [
    ("MIT", ["mit-grant", "mit-notice-kept", "as-is"], "permissive"),
    ("BSD-2-Clause", ["bsd-source", "bsd-binary"], "permissive"),
    ("Apache-2.0", ["apache-2"], "permissive"),
    ("Apache-2.0", ["apache-terms", "apache-copy"], "permissive"),
    ("MIT", ["mit-notice"], "permissive"),
    ("GPL-3.0", ["gpl-3"], "copyleft"),
    ("GPL-2.0", ["gpl-2"], "copyleft"),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"], "noncommercial"),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"], "copyleft"),
    ("CC-BY-4.0", ["cc-by-4"], "permissive"),
    ("Proprietary", ["all-rights"], "reserved"),
]

NOTICE_NAMES, NOTICE_RULES = notices()
ALL_SENTENCES = text_sentences() | SENTENCES
ALL_RULES = TEXT_RULES + RULES + NOTICE_RULES

#: Rules that do not count beside others: the last line of a copyright notice beside a licence text, a part beside the whole.
YIELDS: dict[str, set[str]] = {"Proprietary": {"BSD-2-Clause", *(name for name, _, _ in TEXT_RULES)}, "BSD-2-Clause": {"BSD-3-Clause"}}

#: What stands before a licence's name in a notice.
NOTICE = (
    "(?:spdx license identifier|(?:(?:this|the|it|all) (?:[a-z]+ ){0,3}?(?:is|are) )?(?:also )?(?:free software )?(?:dual )?"
    "(?:licensed|released|distributed|published|available|made available|provided) under (?:either of )?(?:an? |the )?(?:terms of the )?(?:conditions of the )?)"
)
_NOTICE_START = re.compile("^" + NOTICE)
#: What joins the names of one notice; "or later" is part of a name.
JOINED = r" (?:or(?! later)|and|with) (?:an? |the )?"
#: A sentence ends at . ! ? ; before white space. Version numbers keep their points.
SENTENCE_END = r"[.!?;]+(?=\s)"
#: A known sentence of so many words may follow others without a mark between; so many of them tell that it begins.
LONG, OPENING = 16, 4


def telling_words(sentences: Iterable[str]) -> list[str]:
    """A few words, one of which every sentence has: again and again the word of most sentences that are left; short words, which
    any text has, only where a sentence has no others."""
    left, out = [{w for w in s.split() if len(w) > 5} or set(s.split()) for s in sentences], []
    while left := [s for s in left if not s & set(out)]:
        counts = Counter(w for s in left for w in s)
        out.append(min(counts, key=lambda w: (-counts[w], -len(w), w)))
    return out


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def _table(entries: dict[str, str]) -> Column:
    """A constant map; keys and values are plain words."""
    return F.map_from_arrays(*[F.split(F.lit("\n".join(x)), "\n") for x in (entries.keys(), entries.values())])


def _identifiers(text: Column, sentences: dict[str, str], names: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order. Every list of constants occurs once in the expression."""
    none = F.array().cast("array<string>")
    known = _table({**sentences, **{f"= {n}": i for n, i in names.items()}})
    openings = sorted({" ".join(s.split(" ")[:OPENING]) for s in sentences if s.count(" ") + 1 >= LONG})

    def named(unit: Column) -> Column:
        rest = F.regexp_replace(unit, _NOTICE_START.pattern + " ?(?:the )?| at your option$", "")
        parts = F.transform(F.split(F.trim(rest), JOINED), lambda n: F.concat(F.lit("= "), n))
        return F.filter(parts, lambda n: n.isin(*[f"= {n}" for n in names]))

    def of_unit(unit: Column) -> Column:
        """Keys of a piece without marks: a known sentence, or the names of a notice."""
        found = F.when(unit.isin(*sentences), F.array(unit))
        return found.when(unit.rlike(_NOTICE_START.pattern), named(unit)).otherwise(none) if names else found.otherwise(none)

    cut = lambda plain: F.split(plain, " (?=(?:" + "|".join(openings) + ") )") if openings else F.array(plain)

    def of_sentence(sentence: Column) -> Column:
        """Whole and cut, then by lines, whole and cut; more keys win, and whole ones at the same number."""
        whole = _plain(sentence)
        lines = F.when(sentence.contains("\n"), F.transform(F.split(sentence, "\n"), _plain)).otherwise(none)
        ways = F.array(F.array(whole), cut(whole), lines, F.flatten(F.transform(lines, cut)))
        keys = F.transform(ways, lambda units: F.flatten(F.transform(units, of_unit)))
        first = lambda k: F.when(F.size(k[0]) > 0, k[0]).otherwise(k[1])
        then = lambda k: F.when(F.size(k[3]) > F.size(k[2]), k[3]).otherwise(k[2])
        return _let(keys, lambda k: F.when(F.size(then(k)) > F.size(first(k)), then(k)).otherwise(first(k)))

    # A blank, a comment mark or a rule on a line of its own ends a paragraph.
    ends = r"\n(?:[^a-z0-9\n]*+\n)+|" + SENTENCE_END
    keys = F.flatten(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), ends), of_sentence))
    return F.transform(keys, lambda k: F.element_at(known, k))


def _matched(ids: Column, rules: list[tuple[str, list[str], str]]) -> Column:
    """Numbers of the rules whose identifiers occur in order: one fold advances all rules of several identifiers."""
    several = [i for i, (_, wanted, _) in enumerate(rules) if len(wanted) > 1]
    wanted = F.array(*[F.array(*[F.lit(x) for x in rules[i][1]]) for i in several])
    start = F.array(*[F.lit(0) for _ in several])
    step = lambda at, i: F.transform(at, lambda p, r: F.when(F.get(F.get(wanted, r), p) == i, p + 1).otherwise(p))
    reached = F.aggregate(ids, start, step) if several else F.array().cast("array<int>")
    met = lambda at: F.array_compact(F.array(*[F.when(at[several.index(i)] == len(w) if len(w) > 1 else F.array_contains(ids, w[0]), F.lit(i)) for i, (_, w, _) in enumerate(rules)]))
    return _let(reached, met)


def recognize_licenses(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), sentences: dict[str, str] = ALL_SENTENCES, rules: list[tuple[str, list[str], str]] = ALL_RULES, names: dict[str, str] = NOTICE_NAMES, yields: dict[str, set[str]] = YIELDS) -> DataFrame:
    """The columns of `keep`, sentence_ids (known identifiers in order), licenses (distinct, in the order of the rules),
    license and license_class (of the first rule that matches, else null). names: what may follow the words of a notice.
    yields: licences that do not count where another of the set is found."""
    check_keep(keep, ("sentence_ids", "licenses", "license", "license_class"))
    none = F.array().cast("array<string>")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    telling = telling_words([*sentences, *["under"] * bool(names), *["spdx"] * bool(names)])
    titles, classes = F.array(*[F.lit(name) for name, _, _ in rules]), F.array(*[F.lit(kind) for _, _, kind in rules])

    def counting(hits: Column) -> Column:
        out = hits
        for name, stronger in yields.items():
            own, others = ([F.lit(i) for i, (n, _, _) in enumerate(rules) if n in of] for of in ({name}, stronger))
            if own and others:
                out = F.when(F.arrays_overlap(hits, F.array(*others)), F.array_except(out, F.array(*own))).otherwise(out)
        return out

    result = lambda ids, hits: F.struct(
        ids.alias("sentence_ids"), F.array_distinct(F.transform(hits, lambda i: titles[i])).alias("licenses"),
        F.when(F.size(hits) > 0, titles[F.try_element_at(hits, F.lit(1))]).alias("license"), F.when(F.size(hits) > 0, classes[F.try_element_at(hits, F.lit(1))]).alias("license_class"),
    )
    nothing = F.struct(none.alias("sentence_ids"), none.alias("licenses"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("string").alias("license_class"))
    whole = lambda t: _let(_identifiers(t, sentences, names), lambda ids: F.when(F.size(ids) == 0, nothing).otherwise(_let(_matched(ids, rules), lambda hits: _let(counting(hits), lambda h: result(ids, h)))))
    told = lambda t: functools.reduce(operator.or_, [t.contains(w) for w in telling])
    found = _let(low, lambda t: F.when(told(t), whole(t)).otherwise(nothing))
    return df.select(*keep, F.inline(F.array(found)))

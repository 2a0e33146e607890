"""Information-theoretic sanitisation of personal data.

Protected entities are e-mail addresses, IP addresses, card and phone numbers, found by fixed patterns. How strongly a
term reveals an entity is estimated from the corpus: with n(e), n(t) documents that hold the entity and the term, n(e, t)
that hold the term near the entity, and N documents in all, the pointwise mutual information log2(N n(e, t) / (n(e) n(t)))
relative to the entity's information log2(N / n(e)) is 1 where the term occurs with that entity alone and 0 where they are
independent. How much such a ratio is worth does not depend on N but on how often it has been seen: a term is looked at because
it stood near the entity once, so that sighting proves nothing, and only further ones do. With c different surroundings of the
pair (copies of one passage are one) and m documents that hold the term elsewhere, the evidence is
(c - 1 + p) / (c + m), where p is the share of all pairs of the corpus that recur, under one half. One sighting therefore has
evidence p and never suffices, at any N. Terms whose ratio is at least `remove_at` and whose evidence at least `remove_evidence`
are removed wherever they occur; those at or above `generalize_at` and `generalize_evidence` are generalised to the kind of
entity that they reveal most, such as [EMAIL TERM].

Only words near entities are shuffled, with counts added up before the exchange; texts are not. Chosen terms are broadcast
where they number at most `max_broadcast_terms`; beyond that they meet the texts by a join.

Null and empty texts have no spans, an empty table no rows. Spans are in characters (code points), end exclusive. Repeated
rows each get their own result and count as rows in the statistics. Where a term reveals several entities alike, the kind
listed first names it. Columns pass by only when named in `keep`; a name that is also an output raises. Work is linear in the
length of a text, which is held whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, check_keep, durable, tidy

#: Kinds in the order in which spans are listed; the last two come from the corpus statistics.
KINDS = ("email", "ip", "card", "phone", "disclosing", "revealing")
BASE_KINDS = KINDS[:4]

_LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]").search
_TERM = re.compile(r"[^\W\d_]{4,}")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]


def _emails(text: str) -> list[Span]:
    """Matches of local part, @ and dotted domain: as the local part holds no @, each @ decides one match at most."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = at - (len(head) - len(head.rstrip(_LOCAL_PART)))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", at + 1)
    return out


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) of the protected entities, by kind and then start; for each kind leftmost and non-overlapping."""
    if not text:
        return []
    out = _emails(text) if "@" in text else []
    if _ANY_DIGIT(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((3, *m.span()))
    return out


def _entity(text: str, span: Span) -> int:
    """A number for the protected value, the same however it is written."""
    value = text[span[1] : span[2]]
    value = value.lower() if span[0] == 0 else _NOT_DIGIT.sub(".", value) if span[0] == 1 else _NOT_DIGIT.sub("", value)
    return xxhash.xxh3_64_intdigest(f"{KINDS[span[0]]}:{value}") - (1 << 63)


def _joined(spans: list[Span]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the disjoint ranges that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start), ends.append(end)
    return starts, ends


def _surroundings(text: str, span: Span, starts: list[int], ends: list[int], reach: int) -> tuple[int, set[str]]:
    """(number of the surroundings, terms in them): the same line up to `reach` characters on either side, without the ranges
    of entities (starts, ends)."""
    low = max(text.rfind("\n", max(0, span[1] - reach), span[1]) + 1, span[1] - reach, 0)
    high = text.find("\n", span[2], span[2] + reach)
    high = min(len(text), span[2] + reach) if high < 0 else high
    pieces, at, i = [], low, bisect_right(ends, low)
    while i < len(starts) and starts[i] < high:
        pieces.append(text[at : max(at, starts[i])])
        at = ends[i]
        i += 1
    pieces.append(text[at : max(at, high)])
    around = " ".join(pieces)
    inner = around
    if low > 0 and text[low - 1] != "\n":
        inner = inner.partition(" ")[2]  # a word that the reach cuts is not a term
    if high < len(text) and text[high] != "\n":
        inner = inner.rpartition(" ")[0]
    return xxhash.xxh3_64_intdigest(around.lower()) - (1 << 63), {m[0].lower() for m in _TERM.finditer(inner)}


def _co_occurrences(df: DataFrame, text: str, reach: int) -> DataFrame:
    """entity, kind, term, context, first: once for each document, entity, term near it and surroundings; first is 1 for one of these
    of each document, entity and term, else 0. A null term stands for the entity itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["entity", "kind", "term", "context", "first"]
        for batch in batches:
            entities, kinds, terms, contexts, firsts = [], [], [], [], []
            for value in batch.column(0):
                t = value.as_py()
                spans = base_spans(t)
                starts, ends = _joined(spans)
                seen: set[tuple[int, str | None]] = set()
                met: set[tuple[int, int]] = set()
                for span in spans:
                    entity = _entity(t, span)
                    context, near = _surroundings(t, span, starts, ends, reach)
                    if (entity, context) in met:
                        continue
                    met.add((entity, context))
                    for term in (None, *near):
                        entities.append(entity), kinds.append(span[0]), terms.append(term), contexts.append(context), firsts.append(int((entity, term) not in seen))
                        seen.add((entity, term))
            yield pa.RecordBatch.from_arrays([pa.array(entities, pa.int64()), pa.array(kinds, pa.int32()), pa.array(terms, pa.string()), pa.array(contexts, pa.int64()), pa.array(firsts, pa.int64())], names)

    return df.select(text).mapInArrow(tidy(run), "entity long, kind int, term string, context long, first long")


def _terms_of(text: str) -> set[str]:
    return set(_TERM.findall(text.lower()))


def _document_counts(df: DataFrame, terms: DataFrame, text: str, broadcast: bool) -> DataFrame:
    """term, n_t: documents that hold each of the terms."""
    if broadcast:
        shared = Shared(df.sparkSession, frozenset(r.term for r in terms.toLocalIterator()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, counts = shared.once(), {}
            for batch in batches:
                for value in batch.column(0):
                    for term in _terms_of(value.as_py() or "") & wanted:
                        counts[term] = counts.get(term, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        return df.select(text).mapInArrow(tidy(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = {}
            for value in batch.column(0):
                for term in _terms_of(value.as_py() or ""):
                    counts[term] = counts.get(term, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    summed = df.select(text).mapInArrow(tidy(words), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return summed.join(terms, "term", "left_semi")


def disclosing_terms(
    df: DataFrame, text: str = "text", reach: int = 80, generalize_at: float = 0.8, remove_at: float = 0.95,
    generalize_evidence: float = 1 / 2, remove_evidence: float = 2 / 3, max_broadcast_terms: int = 1_000_000,
) -> DataFrame:
    """term, disclosure (the ratio, 0 to 1, for the entity that it reveals most), evidence, kind (of that entity) and action (`remove`
    or `generalize`), of the whole corpus."""
    if min(generalize_evidence, remove_evidence) < 1 / 2:
        raise ValueError("evidence under one half would let a single sighting decide")
    pairs = _co_occurrences(df, text, reach).groupBy("entity", "kind", "term", "context").agg(F.sum("first").alias("n"))
    pairs = durable(pairs.groupBy("entity", "kind", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("contexts")))
    entities = pairs.where("term IS NULL").select("entity", F.col("n_et").alias("n_e"))
    near = pairs.where("entity IS NOT NULL AND term IS NOT NULL")
    recurring = near.agg(F.try_divide(F.count_if(F.col("contexts") > 1), F.count("*"))).first()[0] or 0.0
    prior = min(recurring, 0.499)
    evidence = lambda away: (F.col("contexts") - 1 + prior) / (F.col("contexts") + away)
    # Documents elsewhere only lower the evidence: what is too little without any is not counted.
    candidates = durable(near.where(evidence(F.lit(0)) >= min(generalize_evidence, remove_evidence)))
    terms = candidates.select("term").distinct()
    broadcast = terms.count() <= max_broadcast_terms
    total = df.count()
    counted = candidates.join(entities, "entity").join(_document_counts(df, terms, text, broadcast), "term")
    log2 = lambda c: F.log2(c.cast("double"))
    information = F.lit(float(total)).cast("double")
    ratio = F.try_divide(log2(information * F.col("n_et") / (F.col("n_e") * F.col("n_t"))), log2(information / F.col("n_e")))
    counted = counted.withColumns({"r": F.least(F.lit(1.0), ratio), "evidence": evidence(F.col("n_t") - F.col("n_et"))})
    removed = (F.col("r") >= remove_at) & (F.col("evidence") >= remove_evidence)
    revealed = (F.col("r") >= generalize_at) & (F.col("evidence") >= generalize_evidence)
    acted = counted.withColumn("act", F.when(removed, 2).when(revealed, 1)).where("act IS NOT NULL")
    strongest = acted.groupBy("term").agg(F.max(F.struct("act", "r", (-F.col("kind")).alias("k"), "evidence")).alias("m"))
    kind = F.array(*[F.lit(k) for k in BASE_KINDS])[(-F.col("m.k")).cast("int")]
    action = F.when(F.col("m.act") == 2, "remove").otherwise("generalize")
    return durable(strongest.select("term", F.col("m.r").alias("disclosure"), F.col("m.evidence").alias("evidence"), kind.alias("kind"), action.alias("action")))


#: What each kind of a chosen term (4: removed, 5 and more: generalised, by the entity's kind) is replaced by.
_REPLACED = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "[EMAIL TERM]", "[IP TERM]", "[CARD TERM]", "[PHONE TERM]"]


def _apply(text: str, chosen: dict[str, int]) -> list[Span]:
    """Base spans, then those of chosen terms outside them."""
    spans = base_spans(text)
    if chosen:
        starts, ends = _joined(spans)
        own = []
        for m in _TERM.finditer(text):
            kind = chosen.get(m[0].lower())
            if kind:
                i = bisect_right(ends, m.start())
                if i == len(starts) or starts[i] >= m.end():
                    own.append((kind, *m.span()))
        spans += sorted(own, key=lambda s: (min(s[0], 5), s[1]))
    return spans


def redact(text: str, spans: list[Span]) -> str:
    """Entities become their kind in brackets, revealing terms what they reveal; disclosing terms go. Overlapping spans become
    one, of the kind listed first."""
    pieces, at = [], 0
    merged: list[list[int]] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if merged and start < merged[-1][2]:
            merged[-1] = [min(merged[-1][0], kind), merged[-1][1], max(merged[-1][2], end)]
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        pieces.append(text[at:start])
        pieces.append(_REPLACED[kind])
        at = end
    pieces.append(text[at:])
    return "".join(pieces)


def sanitize(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), terms: DataFrame | None = None, max_broadcast_terms: int = 1_000_000) -> DataFrame:
    """The columns of `keep`, spans (kind, start, end; by kind, then start) and sanitized (the text with the spans replaced;
    null stays null). `terms` is the result of disclosing_terms, by default that of df itself."""
    check_keep(keep, ("spans", "sanitized"))
    terms = disclosing_terms(df, text, max_broadcast_terms=max_broadcast_terms) if terms is None else terms
    few = terms.limit(max_broadcast_terms + 1).count() <= max_broadcast_terms
    source = df.select(*keep, F.col(text).alias("__text"))
    fields = [f for f in source.schema if f.name != "__text"]
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*fields, T.StructField("spans", span, False), T.StructField("sanitized", T.StringType())])
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    if few:
        shared = Shared(df.sparkSession, {r.term: 4 if r.action == "remove" else 5 + BASE_KINDS.index(r.kind) for r in terms.toLocalIterator()})
    else:
        source = _with_terms(source, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            every = [shared.once()] * len(texts) if few else [dict(x or ()) for x in batch.column("__terms").to_pylist()]
            spans = [_apply(t, own) if t else [] for t, own in zip(texts, every, strict=True)]
            new = [redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            rows = [[{"kind": KINDS[min(k, 5)], "start": a, "end": b} for k, a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, span_type), pa.array(new, pa.string())], [*keep, "spans", "sanitized"])

    return source.mapInArrow(tidy(run), schema)


def _with_terms(source: DataFrame, terms: DataFrame) -> DataFrame:
    """source with __terms, the chosen terms of each text, by a join: for more terms than one broadcast should hold."""
    staged = durable(source.withColumn("__row", F.monotonically_increasing_id()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column("__row"), batch.column("__text"), strict=True):
                own = list(_terms_of(value.as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(own), pa.int64()), pa.array(own, pa.string())], ["__row", "term"])

    held = staged.select("__row", "__text").mapInArrow(tidy(words), "__row long, term string").join(terms, "term")
    pair = F.struct("term", F.when(F.col("action") == "remove", 4).otherwise(F.array_position(F.array(*[F.lit(k) for k in BASE_KINDS]), F.col("kind")) + 4).cast("int").alias("kind"))
    return staged.join(held.groupBy("__row").agg(F.map_from_entries(F.collect_list(pair)).alias("__terms")), "__row", "left")

"""Exact repeated-substring removal by a range-partitioned, sampled suffix array.

A byte goes when a string of `length` bytes that covers it also starts earlier (in a smaller document, or before in the same
one). Sorting all suffixes is not needed: in each window of `length` bytes the k-gram of least hash is its anchor, so equal
windows have equal anchors at equal places, and only suffixes at anchors (about one in 40 bytes) matter.

1. Scan: the anchors of each text, each with the stretch of bytes that its windows cover. Stretches of one input batch that
   are equal, byte by byte, are settled there (the earliest stays), so a passage found everywhere sends one row a batch.
2. Company: anchors are exchanged by the hash of their k-gram; those alone with it cannot repeat and are dropped. The hash
   only saves work: k-grams that share one by accident part in step 4. Anchors of a k-gram that has CROWD of them in one
   batch have company for sure: they are dealt over all tasks, and one mark a batch tells the other batches' anchors of it,
   so a k-gram found everywhere sends at most CROWD rows a batch to one task.
3. Suffixes: for the anchors left, the bytes from the anchor on and those before it are read from the texts.
4. Order: sampled splitters range-partition the suffixes by their leading bytes and never part equal ones, so no match
   crosses a boundary unseen. In a bucket a multikey sort orders the suffixes to the right and the bytes before them to the
   left; the common lengths of neighbours in the two orders tell which suffixes share a window, and which is the earliest.
   A lead of more than `hot` suffixes would fill a bucket, so it is split by its next bytes: suffixes that share a window
   share either the next bytes to the right or those to the left, and each half is split again until it fits or the
   lead is a whole window.
5. The removed ranges meet their texts. Lists are broadcast up to `broadcast_bytes`, else joined.

Null text counts as empty. Texts under `length` bytes are never touched. Rows that share an id hold one and the same text;
a row with a null id has no place in the order: it keeps all its bytes and takes none from others. An empty table gives no rows. Columns of df pass by only when named in `keep`; a name that is
also an output raises, others cannot clash. A very long text is scanned a piece at a time; its anchors are held whole, about 4 bytes of memory for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import STEP_BYTES, SpanHasher, check_keep, durable, in_steps, mix64, tidy, utf8

K = 32
#: Suffixes that one step of a bucket takes, about.
BUCKET_STEP = 50_000
#: So many anchors of a k-gram in one batch do not wait for each other.
CROWD = 16
_PLACE_BITS = 28


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` entries."""
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int, bits: int = 64) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text (index), at (of the anchor in all data), before and after (bytes of the stretch that
    the windows cover on either side of it), and hashes of the anchor's k-gram and of the stretch."""
    if len(offsets) > 2 or len(data) < 2 * STEP_BYTES:
        return _anchors(data, offsets, length, k, bits)
    parts: list[dict[str, np.ndarray]] = []  # a very long text, a piece of its windows at a time
    for start in range(0, len(data) - length + 1, STEP_BYTES):
        piece = data[start : start + STEP_BYTES + length - 1]
        t = _anchors(piece, np.array([0, len(piece)]), length, k, bits)
        t["at"] += start
        if parts and parts[-1]["at"][-1] == t["at"][0]:  # a run goes on over the cut
            before = t["before"][0] = parts[-1]["before"][-1]
            own = data[t["at"][0] - before : t["at"][0] + t["after"][0]]
            t["stretch"][0] = _stretch(SpanHasher(own), np.array([0]), np.array([len(own)]), np.array([before]), bits)[0]
            parts[-1] = {c: v[:-1] for c, v in parts[-1].items()}
        parts.append(t)
    return {c: np.concatenate([t[c] for t in parts]) for c in parts[0]}


def _stretch(hasher: SpanHasher, first: np.ndarray, end: np.ndarray, before: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(hasher.hash(first, end) + before.astype(np.uint64)) & np.uint64((1 << bits) - 1)).view(np.int64)


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int, bits: int) -> dict[str, np.ndarray]:
    names = ("text", "at", "before", "after", "gram", "stretch")
    n = len(data) - length + 1
    if n <= 0:
        return {c: np.zeros(0, np.int64) for c in names}
    hasher = SpanHasher(data)
    begins = np.arange(len(data) - k + 1)
    few = np.uint64((1 << bits) - 1)
    grams = hasher.hash(begins, begins + k) & few
    keys = (mix64(grams) >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS)
    keys |= begins.astype(np.uint64) & np.uint64((1 << _PLACE_BITS) - 1)
    chosen = (_slide(keys, length - k + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    real = np.zeros(n, bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= length:
            real[a : b - length + 1] = True
    change = np.ones(n, bool)
    change[1:] = (chosen[1:] != chosen[:-1]) | ~real[:-1]
    first = np.flatnonzero(change & real)
    stop = np.ones(n, bool)
    stop[:-1] = (chosen[1:] != chosen[:-1]) | ~real[1:]
    end = np.flatnonzero(stop & real) + length
    at = chosen[first]
    at += ((first - at) >> _PLACE_BITS << _PLACE_BITS) if len(data) >> _PLACE_BITS else 0
    stretch = _stretch(hasher, first, end, at - first, bits)
    return dict(zip(names, (np.searchsorted(offsets, first, side="right") - 1, at, at - first, end - at, grams[at].view(np.int64), stretch), strict=True))


def _union(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of half-open ranges, apart for each owner."""
    if not len(start):
        return start, end, owner
    order = np.lexsort((start, owner))
    start, end, owner = start[order], end[order], owner[order]
    fresh = np.ones(len(start), bool)
    group = np.concatenate([[0], np.cumsum(owner[1:] != owner[:-1])])
    lift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    fresh[1:] = start[1:] + lift[1:] > reach[:-1]
    begin = np.flatnonzero(fresh)
    return start[begin], np.maximum.reduceat(end, begin), owner[begin]


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Whether data[a : a + size] is data[b : b + size], for each entry."""
    same = np.ones(len(a), bool)
    steps = np.arange(width)
    for start in range(0, len(a), 50_000):
        own = slice(start, start + 50_000)
        inside = steps < sizes[own, None]
        left, right = (np.take(data, x[own, None] + steps, mode="clip") for x in (a, b))
        same[own] = ((left == right) | ~inside).all(axis=1)
    return same


#: code is 256 * before + after of an anchor, and _CROWDED more in a crowd; 0 is the mark that a batch has a crowd of this gram; a
#: range settled in its batch has the negative of its size there, and its start in at.
_MARKS = "gram long, id long, at int, code int"
_CROWDED = 1 << 16


def _scan(df: DataFrame, text: str, doc_id: str, length: int, k: int, bits: int, batch_rows: int = 1 << 19) -> DataFrame:
    """Anchors, and ranges that an earlier equal stretch of the same batch covers."""
    names = ("gram", "id", "at", "code")

    def settle(held: list[tuple[np.ndarray, dict[str, np.ndarray]]]) -> pa.RecordBatch:
        data = np.concatenate([d for d, _ in held])
        base = np.concatenate([[0], np.cumsum([len(d) for d, _ in held])])
        t = {c: np.concatenate([x[c] for _, x in held]) for c in held[0][1]}
        place = t["at"] + np.repeat(base[:-1], [len(x["at"]) for _, x in held]) - t["before"]
        t["at"] = t["at"] - t.pop("start")
        order = np.lexsort((t["at"], t["id"], t["stretch"], t["gram"]))
        t, place = {c: v[order] for c, v in t.items()}, place[order]
        new = np.ones(len(order), bool)
        new[1:] = (t["gram"][1:] != t["gram"][:-1]) | (t["stretch"][1:] != t["stretch"][:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        later = np.flatnonzero(~((t["id"] == t["id"][head]) & (t["at"] == t["at"][head])))
        first = head[later]
        sizes = t["before"] + t["after"]
        alike = (t["before"][later] == t["before"][first]) & (sizes[later] == sizes[first])
        later, first = later[alike], first[alike]
        later = later[_equal_bytes(data, place[later], place[first], sizes[later], 2 * length)]
        start, end, owner = _union((t["at"] - t["before"])[later], (t["at"] + t["after"])[later], t["id"][later])
        stay = np.ones(len(order), bool)
        stay[later] = False
        code = (256 * t["before"] + t["after"])[stay]
        grams, of, many = np.unique(t["gram"][stay], return_inverse=True, return_counts=True)
        crowds = grams[many >= CROWD]
        code[many[of] >= CROWD] += _CROWDED
        none = np.zeros(len(crowds), np.int64)
        columns = [np.concatenate(c) for c in ((t["gram"][stay], mix64(owner.view(np.uint64)).view(np.int64), crowds), (t["id"][stay], owner, none), (t["at"][stay], start, none), (code, start - end, none))]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []
        for part in in_steps(batches, "__text"):
            data, offsets = utf8(part.column("__text"))
            t = anchors(data, offsets, length, k, bits)
            if not len(t["at"]):
                continue
            text_of = t.pop("text")
            ids = part.column("__id").to_numpy(zero_copy_only=False)
            held.append((data, t | {"id": ids[text_of], "start": offsets[text_of]}))
            if sum(len(x["at"]) for _, x in held) >= batch_rows:
                yield settle(held)
                held = []
        if held:
            yield settle(held)

    placed = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    return placed.mapInArrow(tidy(run), _MARKS)


def _suffixes(df: DataFrame, text: str, doc_id: str, marks: DataFrame, length: int, broadcast_bytes: int) -> DataFrame:
    """id, at, right (bytes of the stretch from the anchor on) and left (those before it, nearest first) of the marked anchors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.unique(x.values.to_numpy()).tobytes() for x in batch.column("places")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "packed"])

    place = F.shiftleft(F.col("at").cast("long"), 16).bitwiseOR(F.col("code").cast("long"))
    places = durable(marks.groupBy("id").agg(F.collect_list(place).alias("places")).mapInArrow(tidy(pack), "id long, packed binary"))
    joined = _meet(df, text, doc_id, (), places, broadcast_bytes, "inner")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_steps(batches, "__text"):
            data, offsets = utf8(part.column("__text"))
            lists = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("packed")]
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            own = np.concatenate(lists)
            at, before, after = own >> 16, own >> 8 & 255, own & 255
            fits = at + after <= np.diff(offsets)[owner]  # rows that share an id, but not the text, may be shorter
            for chosen in np.array_split(np.flatnonzero(fits), -(-int(fits.sum()) // 20_000) or 1):
                begin, ids = (offsets[owner] + at)[chosen], part.column("__id").take(pa.array(owner[chosen]))
                columns = [ids, pa.array(at[chosen], pa.int32()), _slices(data, begin, after[chosen], 1), _slices(data, begin - 1, before[chosen], -1)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "at", "right", "left"])

    return joined.select("__id", "__text", "packed").mapInArrow(tidy(cut), "id long, at int, right binary, left binary")


def _slices(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, step: int) -> pa.Array:
    """Binary values of `sizes` bytes from `begin` on, forwards or backwards."""
    ends = np.cumsum(sizes)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    taken = data[np.repeat(begin, sizes) + step * inside]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(taken)]).cast(pa.binary())


def _meet(df: DataFrame, text: str, doc_id: str, keep: tuple[str, ...], per_document: DataFrame, broadcast_bytes: int, how: str) -> DataFrame:
    """__id, __text, the columns of keep, and packed of per_document (id, packed). Broadcast only up to broadcast_bytes."""
    texts = df.select(*[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)], F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    size = per_document.agg(F.coalesce(F.sum(F.octet_length("packed") + 24), F.lit(0)).alias("n")).first().n
    other = per_document.select(F.col("id").alias("__id"), "packed")
    return texts.join(F.broadcast(other) if size <= broadcast_bytes else other, "__id", how)


def _matrix(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded with zeros to `width`, lengths)."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    whole = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(sizes.sum()) - np.repeat(offsets[:-1] - offsets[0], sizes)] = whole[offsets[0] : offsets[-1]]
    return out, sizes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common starts of rows."""
    differ = a != b
    return np.where(differ.any(axis=-1), differ.argmax(axis=-1), a.shape[-1])


def multikey_order(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by group and then bytes, common bytes with the row before, -1 at the first of a group). A multikey quicksort
    whose characters are eight bytes: rows that are equal so far are parted by their next character, others stay."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    run = group[order]
    open_places = np.arange(len(order))
    for character in range(words.shape[1]):
        first = np.ones(len(order), bool)
        first[1:] = run[1:] != run[:-1]
        alone = first & np.append(first[1:], True)
        open_places = np.flatnonzero(~alone)
        if not len(open_places):
            break
        own = words[order[open_places], character]
        again = np.lexsort((own, run[open_places]))
        order[open_places] = order[open_places][again]
        own, before = own[again], run[open_places]
        part = np.zeros(len(order), bool)
        part[open_places[1:]] = (own[1:] != own[:-1]) & (before[1:] == before[:-1])
        run = np.cumsum(first | part)
    ranked, of = rows[order], group[order]
    common = np.full(len(order), -1)
    common[1:] = np.where(of[1:] == of[:-1], _common(ranked[1:], ranked[:-1]), -1)
    return order, common


def shared_windows(group, right, left, nr, nl, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes before the anchor, bytes from it on) that windows shared with an earlier suffix of the group cover, -1 for none; rows
    in order of group and occurrence. right and left are padded with zeros, nr and nl their sizes."""
    m = len(nr)
    back, ahead = np.full(m, -1), np.full(m, -1)
    if m == 0:
        return back, ahead
    sizes = np.diff(np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), m))
    of_size = np.repeat(sizes, sizes)
    two = np.flatnonzero((of_size == 2) & np.append(False, group[1:] == group[:-1]))
    r, x = np.minimum(_common(right[two], right[two - 1]), np.minimum(nr[two], nr[two - 1])), np.minimum(_common(left[two], left[two - 1]), np.minimum(nl[two], nl[two - 1]))
    good = r + x >= length
    back[two[good]], ahead[two[good]] = x[good], r[good]
    many = np.flatnonzero(of_size > 2)
    if not len(many):
        return back, ahead
    group, right, left, nr, nl = group[many], right[many], left[many], nr[many], nl[many]
    (ro, rc), (lo, lc) = multikey_order(group, right), multikey_order(group, left)
    m = len(many)
    of_right, of_left = np.empty(m, np.int64), np.empty(m, np.int64)
    # Stretches alike on both sides, whole: all but the earliest are settled, and need not be met again.
    of_right[ro], of_left[lo] = np.cumsum(rc < right.shape[1]), np.cumsum(lc < left.shape[1])
    _, first, same = np.unique(np.stack([of_right, of_left, nr, nl], axis=1), axis=0, return_index=True, return_inverse=True)
    copy = first[same.ravel()] != np.arange(m)
    own_back, own_ahead = np.where(copy, nl, -1), np.where(copy, nr, -1)
    for x in range(int(nl.max()) + 1):
        rows = np.flatnonzero((nl >= x) & (nr >= length - x) & ~copy)
        if len(rows) < 2:
            continue
        of_right[ro], of_left[lo] = np.cumsum(rc < length - x), np.cumsum(lc < x)
        _, first, same = np.unique(of_right[rows] * (m + 1) + of_left[rows], return_index=True, return_inverse=True)
        again = rows[first[same] != np.arange(len(rows))]
        own_back[again] = np.maximum(own_back[again], x)
        own_ahead[again] = np.maximum(own_ahead[again], length - x)
    back[many], ahead[many] = own_back, own_ahead
    return back, ahead


def _bucket_matches(suffixes: DataFrame, length: int, k: int) -> DataFrame:
    """Removed ranges from suffixes with their leads, in range-partitioned buckets of whole leads."""
    names = ["lead", "id", "at", "right", "left"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole groups of equal leads, of about BUCKET_STEP rows."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            leads = batch.column("lead")
            stop, last = batch.num_rows, leads[-1].as_py()
            while stop and leads[stop - 1].as_py() == last:
                stop -= 1
            if stop == 0 and held and held[-1].column("lead")[-1].as_py() != last:
                # the batch begins a group: what is held is whole
                if sum(b.num_rows for b in held) >= BUCKET_STEP:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch)
                continue
            held.append(batch.slice(0, stop))
            if stop and sum(b.num_rows for b in held) >= BUCKET_STEP:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(stop))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            table = table.select(names).combine_chunks()
            if table.num_rows < 2:
                continue
            column = {c: table.column(c).combine_chunks() for c in names}
            lead = column["lead"].dictionary_encode()
            lead = (lead.chunk(0) if isinstance(lead, pa.ChunkedArray) else lead).indices.to_numpy()
            ids, at = column["id"].to_numpy(), column["at"].to_numpy()
            order = np.lexsort((at, ids, lead))
            again = (lead[order][1:] == lead[order][:-1]) & (ids[order][1:] == ids[order][:-1]) & (at[order][1:] == at[order][:-1])
            order = order[np.append(True, ~again)]  # repeated rows give one place twice
            alone = np.bincount(lead[order])[lead[order]] < 2
            order = order[~alone]
            (right, nr), (left, nl) = _matrix(column["right"].take(pa.array(order)), length), _matrix(column["left"].take(pa.array(order)), length - k)
            ids, at = ids[order], at[order]
            back, ahead = shared_windows(lead[order], right, left, nr, nl, length)
            hit = back >= 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array((at - back)[hit], pa.int32()), pa.array((at + ahead)[hit], pa.int32())], ["id", "start", "end"])

    return suffixes.select(*names).repartitionByRange("lead").sortWithinPartitions("lead").mapInArrow(tidy(run), "id long, start int, end int")


def _lead(a, b):
    """The leading bytes of a suffix: a before the anchor, nearest first, and b from it on; a tells where one ends."""
    return F.concat(F.encode(F.lpad(a.cast("string"), 3, "0"), "UTF-8"), F.substring("left", F.lit(1), a), F.substring("right", F.lit(1), b))


def _split_hot(suffixes: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(suffixes with leads of at most `hot` suffixes each, removed ranges of leads that are whole windows). A lead of a bytes
    before the anchor and b from it on leaves s = length - a - b bytes open: of suffixes that share a window, those with at most
    the a + s - s/2 nearest bytes of it before the anchor share the next s/2 to the right, the others the next to the left."""
    spark = suffixes.sparkSession
    fits = spark.createDataFrame([], "lead binary, id long, at int, right binary, left binary")
    gone = spark.createDataFrame([], "id long, start int, end int")
    level = durable(suffixes)
    while True:
        crowded = level.groupBy("lead").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("m")).where(F.col("n") > hot)
        if crowded.isEmpty():
            return fits.union(level.select("lead", "id", "at", "right", "left")), gone
        crowded = durable(crowded)
        fits = fits.union(level.join(crowded, "lead", "left_anti").select("lead", "id", "at", "right", "left"))
        large = level.join(crowded.select("lead", "m"), "lead")
        whole = large.where(F.col("a") + F.col("b") >= length).where((F.col("id") != F.col("m.id")) | (F.col("at") != F.col("m.at")))
        gone = gone.union(whole.select("id", (F.col("at") - F.col("a")).cast("int"), (F.col("at") + F.col("b")).cast("int")))
        open_ = F.lit(length) - F.col("a") - F.col("b")
        step = F.ceil(open_ / 2).cast("int")
        halves = F.array(F.struct(F.col("a").alias("a"), (F.col("b") + step).alias("b")), F.struct((F.col("a") + open_ - step + 1).alias("a"), F.col("b").alias("b")))
        halves = F.filter(halves, lambda h: (h["a"] <= F.octet_length("left")) & (h["b"] <= F.octet_length("right")))
        next_level = large.where(F.col("a") + F.col("b") < length).select("id", "at", "right", "left", F.explode(halves).alias("h"))
        next_level = next_level.select("id", "at", "right", "left", "h.a", "h.b")
        level = durable(next_level.withColumn("lead", _lead(F.col("a"), F.col("b"))))


def repeated_ranges(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 100, k: int = K, hot: int = 20_000, broadcast_bytes: int = 64 << 20, bits: int = 64) -> DataFrame:
    """id and packed ranges (starts and ends in bytes, maximal runs) of all documents with something to remove. bits: of the hashes that
    bring k-grams and stretches together; fewer only make more work."""
    if not k < length <= 255:
        raise ValueError("length must be over k and at most 255")
    crowded = F.col("code") >= _CROWDED
    met = _scan(df, text, doc_id, length, k, bits).withColumn("meet", F.when(crowded, F.xxhash64("id", "at")).otherwise(F.col("gram")))
    company = met.withColumn("n", F.count("*").over(Window.partitionBy("meet"))).where((F.col("code") != 0) & (crowded | (F.col("n") > 1) | (F.col("code") < 0)))
    marked = durable(company.select("gram", "id", "at", F.when(crowded, F.col("code") - _CROWDED).otherwise(F.col("code")).alias("code")))
    suffix = marked.where("code > 0")
    crowds = durable(suffix.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("gram"))
    hot_there = not crowds.isEmpty()
    found = marked.where("code < 0").select("id", F.col("at").alias("start"), (F.col("at") - F.col("code")).alias("end"))
    leading = lambda suffixes: suffixes.withColumns({"a": F.lit(0), "b": F.lit(k)}).withColumn("lead", _lead(F.col("a"), F.col("b")))
    few = suffix.join(crowds, "gram", "left_anti") if hot_there else suffix
    found = found.union(_bucket_matches(leading(_suffixes(df, text, doc_id, few, length, broadcast_bytes)), length, k))
    if hot_there:
        many = suffix.join(crowds, "gram", "left_semi")
        fits, gone = _split_hot(leading(_suffixes(df, text, doc_id, many, length, broadcast_bytes)), length, hot)
        found = found.union(_bucket_matches(fits, length, k)).union(gone)
    return found.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("ranges")).mapInArrow(tidy(_merged), "id long, packed binary")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of each document's ranges, packed as pairs of 32-bit integers."""
    for batch in batches:
        lists = batch.column("ranges")
        flat = lists.flatten()
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        start, end, owner = _union(flat.field("start").to_numpy().astype(np.int64), flat.field("end").to_numpy().astype(np.int64), owner)
        packed = np.stack([start, end], axis=1).astype("<i4")
        cuts = np.searchsorted(owner, np.arange(len(lists) + 1))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["id", "packed"])


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 100, keep: tuple[str, ...] = ("doc_id",), broadcast_bytes: int = 64 << 20, hot: int = 20_000, bits: int = 64) -> DataFrame:
    """The columns of `keep`, n_bytes, spans (maximal removed runs: start, end in bytes) and kept_bytes (what is left, as binary:
    a run may begin or end inside a character)."""
    outputs = ("n_bytes", "spans", "kept_bytes")
    check_keep(keep, outputs)
    ranges = durable(repeated_ranges(df, text, doc_id, length, hot=hot, broadcast_bytes=broadcast_bytes, bits=bits))
    joined = _meet(df, text, doc_id, keep, ranges, broadcast_bytes, "left").drop("__id")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kinds = df.select(*keep).schema
    schema = T.StructType([*kinds, T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept_bytes", T.BinaryType())])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_steps(batches, "__text", 8 << 20):
            sizes, spans, left = [], [], []
            for whole, found in zip(part.column("__text").to_pylist(), part.column("packed").to_pylist(), strict=True):
                whole = (whole or "").encode()
                runs = np.frombuffer(found or b"", "<i4").reshape(-1, 2).tolist()
                at, pieces = 0, []
                for start, end in runs:
                    pieces.append(whole[at:start])
                    at = end
                sizes.append(len(whole)), left.append(b"".join([*pieces, whole[at:]])), spans.append([{"start": a, "end": min(b, len(whole))} for a, b in runs if a < len(whole)])
            yield pa.RecordBatch.from_arrays([*(part.column(f"__keep_{i}") for i in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(spans, span_type), pa.array(left, pa.binary())], [*keep, *outputs])

    return joined.mapInArrow(tidy(run), schema)

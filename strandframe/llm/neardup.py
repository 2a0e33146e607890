"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Documents with equal sets are one from the start (a grouped minimum). Each set
gets MinHash tokens; a tree starts with all sets in one node, and a node sends each set to a child for each of
1 / similarity (on average) randomly chosen tokens, by the token's value. Sets of similarity s stay together in a child
with probability s, so a pair at the threshold keeps one common path on average, while unrelated sets part after a few
levels. The nodes at the end are compared exhaustively, unless they are dense (more than `leaf` sets). There are as many
trees as let a pair at the threshold meet with probability `recall`.

Comparing uses a 64-token sketch; what may be similar is then confirmed on the full sets:
- round 1 takes the first trees. Dense nodes, whose sets are alike, are dealt into small random places; as each set is in several
  nodes, this links nearly all of a group of copies in time linear in the group;
- round 2 takes all trees, but compares only sets of different components. In a dense node those outside the largest component
  meet all others in cells of bounded size; dense nodes of one component are left out. Of two components the most agreeing pair
  is confirmed;
- the likely pairs of both rounds join sets to clusters, so every likely pair lies inside one. Round 3 takes the clusters that
  still have several components: their sets meet in cells again, and an index of a cell's shingles gives the exact overlaps.
So no link between components is lost, and no group is expanded into pairs. What remains quadratic is a group of sets that are
nearly, but not, similar enough: its pairs must be compared, and are, in cells over all machines.

A row with a null id or no shingles (null, empty or blank text) is linked with nothing; rows that share an id count as one
document, equal texts as one set. An empty table gives no rows. Of columns of df only the id passes by, so none can clash. A
very long text is hashed a piece at a time; its words and shingles are held whole (about 20 bytes of memory for each byte).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, combine, durable, in_steps, mix64, span_hashes, tidy, utf8, word_spans
from .components import connected_components

TOKENS = 64
#: Trees branch on more tokens than the sketch holds, so that pairs with few agreeing ones are rarer.
BRANCH_TOKENS = 128
_rng = np.random.Generator(np.random.PCG64(20))
_MULTIPLY = _rng.integers(1, 1 << 63, BRANCH_TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BRANCH_TOKENS, dtype=np.uint64)

_PAIRS = np.uint64(0x5555555555555555)
_KEY = np.uint64(0x9FB21C651E98DF25)
#: Trees of round 1, and the sets of a dense node that meet there in one place.
EARLY_TREES, CONTRACT = 2, 64
CELLS = "array<struct<place:bigint,side:int>>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets of each text). A text of fewer words is one shingle."""
    starts, ends, owner = word_spans(data, offsets)
    n = len(offsets) - 1
    hashes = span_hashes(data, starts, ends, LOWER)
    first = np.searchsorted(owner, np.arange(n + 1))
    rolled = combine(hashes, words)
    sets = []
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            sets.append(mix64(combine(hashes[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 MinHash tokens of 16 bits for each non-empty set; the sketch is of the first 64."""
    out = np.empty((len(offsets) - 1, BRANCH_TOKENS), np.uint16)
    for t in range(BRANCH_TOKENS):
        least = np.minimum.reduceat(values * _MULTIPLY[t] + _ADD[t], offsets[:-1])
        out[:, t] = mix64(least).astype(np.uint16)
    return out


def _describe(df: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """id, n_shingles, set_key (128 bits of the set; null without shingles) and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_steps(batches, "__text"):
            values, offsets = shingle_sets(*utf8(part.column("__text")), words)
            sizes = np.diff(offsets)
            full = sizes > 0
            keys: list[bytes | None] = [None] * len(sizes)
            marks: list[bytes | None] = [None] * len(sizes)
            if full.any():
                cuts = np.append(offsets[:-1][full], offsets[-1])
                two = np.stack([np.add.reduceat(mix64(values + np.uint64(c)), cuts[:-1]) for c in (1, 0x5851F42D4C957F2D)], axis=1)
                signs = _signatures(values, cuts)
                for row, i in enumerate(np.flatnonzero(full)):
                    keys[i], marks[i] = two[row].tobytes(), signs[row].tobytes()
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())], ["id", "n_shingles", "set_key", "signature"])

    return df.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")).mapInArrow(tidy(run), "id long, n_shingles long, set_key binary, signature binary")


def meeting_probability(similarity: float, levels: int, trees: int) -> float:
    """Probability that a pair of this similarity has a common node in one of the trees, after `levels` that branch
    1 / similarity times on average. All trees choose from the same tokens, so it is averaged over the number of tokens on
    which the pair agrees."""
    two = 1 / similarity - 1
    total = 0.0
    for k in range(BRANCH_TOKENS + 1):
        p = 1.0
        for _ in range(levels):
            x = k / BRANCH_TOKENS * p
            p = (1 - two) * x + two * (1 - (1 - x) ** 2)
        total += math.comb(BRANCH_TOKENS, k) * similarity**k * (1 - similarity) ** (BRANCH_TOKENS - k) * (1 - p) ** trees
    return 1 - total


def _branch(node: np.ndarray, signature: np.ndarray, two: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of each branch: one chosen token for every node, and a second one for a share `two` of the nodes."""
    h = mix64(node)
    rows = np.arange(len(node))
    first = (h & np.uint64(BRANCH_TOKENS - 1)).astype(np.int64)
    second = (first + 1 + ((h >> np.uint64(8)) % np.uint64(BRANCH_TOKENS - 1)).astype(np.int64)) % BRANCH_TOKENS
    more = (h >> np.uint64(32)).astype(np.float64) < two * 2.0**32

    def child(row: np.ndarray, token: np.ndarray) -> np.ndarray:
        return mix64((node[row] ^ (token.astype(np.uint64) << np.uint64(20))) * _KEY + signature[row, token])

    extra = rows[more]
    return np.concatenate([rows, extra]), np.concatenate([child(rows, first), child(extra, second[more])])


def _node_rows(sets: DataFrame, first_tree: int, trees: int, levels: int, two: float, compare: bool = True) -> DataFrame:
    """node and, to compare, id, component and sketch of every set in every node that it ends in."""
    names = ["node", "id", "component", "s0", "s1"] if compare else ["node"]
    roots = mix64(np.arange(first_tree + 1, first_tree + trees + 1, dtype=np.uint64) * _KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                n = part.num_rows
                signature = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, BRANCH_TOKENS)
                row, node = np.tile(np.arange(n), trees), np.repeat(roots, n)
                for _ in range(levels):
                    at, node = _branch(node, signature[row], two)
                    row = row[at]
                columns = {"node": node.view(np.int64)}
                if compare:
                    bits = (signature[:, :TOKENS] >> 14).astype(np.uint64)
                    for name, h in (("s0", 0), ("s1", 32)):
                        sketch = np.bitwise_or.reduce(bits[:, h : h + 32] << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1)
                        columns[name] = sketch[row].view(np.int64)
                    columns |= {c: part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("id", "component")}
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], pa.int64()) for c in names], names)

    return sets.select("id", "component", "signature").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))


def _agreeing(a0, a1, b0, b1) -> np.ndarray:
    """Tokens on which two sketches agree."""
    x, y = a0 ^ b0, a1 ^ b1
    return TOKENS - np.bitwise_count((x | (x >> np.uint64(1))) & _PAIRS).astype(np.int64) - np.bitwise_count((y | (y >> np.uint64(1))) & _PAIRS)


def _groups(batches: Iterator[pa.RecordBatch], key: str, names: list[str]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Columns of consecutive whole groups of a sorted stream, many groups at a time: (starts of the groups, columns)."""
    held: list[dict[str, np.ndarray]] = []

    def cut(table: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        k = table[key]
        return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1]), table

    for batch in batches:
        if batch.num_rows == 0:
            continue
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        last = new[key][-1]
        if new[key][0] == last and held and held[-1][key][-1] == last:
            held.append(new)
            continue
        stop = int(np.flatnonzero(new[key] != last)[-1]) + 1 if (new[key] != last).any() else 0
        whole = [*held, {c: v[:stop] for c, v in new.items()}]
        table = {c: np.concatenate([w[c] for w in whole]) for c in names}
        if len(table[key]):
            yield cut(table)
        held = [{c: v[stop:] for c, v in new.items()}]
    if held:
        table = {c: np.concatenate([w[c] for w in held]) for c in names}
        if len(table[key]):
            yield cut(table)


def _likely_pairs(starts: np.ndarray, t: dict[str, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, agreeing tokens) of the pairs of different components inside groups whose sketches agree on `least` tokens or
    more. A visitor (side 2) meets the members (side 1) of its cell only, side 0 meets all."""
    n = len(t["id"])
    a0, a1 = t["s0"].view(np.uint64), t["s1"].view(np.uint64)
    end_of = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    left, right, score = [], [], []
    rows, step = np.arange(n), 1
    while True:
        rows = rows[rows + step < end_of[rows]]
        if not len(rows):
            break
        other = rows + step
        apart = (t["component"][rows] != t["component"][other]) & ((t["side"][rows] == 0) | (t["side"][rows] != t["side"][other]))
        a, b = rows[apart], other[apart]
        agree = _agreeing(a0[a], a1[a], a0[b], a1[b])
        good = agree >= least
        left.append(a[good]), right.append(b[good]), score.append(agree[good])
        step += 1
    if not left:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(left), np.concatenate(right), np.concatenate(score)


def _forest(n_nodes: int, left: np.ndarray, right: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which of the pairs make a spanning forest of greatest agreement."""
    parent = list(range(n_nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    used = np.zeros(len(left), bool)
    for i in np.argsort(-score, kind="stable"):
        a, b = root(left[i]), root(right[i])
        if a != b:
            parent[a], used[i] = b, True
    return used


def _forest_pairs(placed: DataFrame, least: int) -> DataFrame:
    """a, b: for components with likely pairs in a common place (place, id, component, s0, s1, side) enough pairs to join
    them: a spanning forest over the components of each place, and of each two components the most agreeing pair."""
    names = ["place", "id", "component", "s0", "s1", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, t in _groups(batches, "place", names):
            mixed = np.minimum.reduceat(t["component"], starts) != np.maximum.reduceat(t["component"], starts)
            if not mixed.any():
                continue
            sizes = np.diff(np.append(starts, len(t["id"])))
            t = {c: v[np.repeat(mixed, sizes)] for c, v in t.items()}
            starts = np.concatenate([[0], np.cumsum(sizes[mixed])[:-1]])
            left, right, score = _likely_pairs(starts, t, least)
            if not len(left):
                continue
            place = np.searchsorted(starts, np.arange(len(t["id"])), side="right")
            _, kind = np.unique(t["component"], return_inverse=True)
            _, kind = np.unique(place * (kind.max() + 1) + kind, return_inverse=True)
            used = _forest(int(kind.max()) + 1, kind[left], kind[right], score)
            left, right, score = left[used], right[used], score[used]
            swap = t["component"][left] > t["component"][right]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
            columns = [t["component"][left], t["component"][right], score, t["id"][left], t["id"][right]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["low", "high", "score", "a", "b"])

    found = placed.repartition("place").sortWithinPartitions("place").mapInArrow(tidy(run), "low long, high long, score long, a long, b long")
    best = found.groupBy("low", "high").agg(F.max(F.struct("score", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("m"))
    return best.select(F.least(-F.col("m.a"), -F.col("m.b")).alias("a"), F.greatest(-F.col("m.a"), -F.col("m.b")).alias("b"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df for a join: as a broadcast where it has at most so many rows (of a few numbers each)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _dealt_evenly(rows: DataFrame, dense: DataFrame, size: int) -> DataFrame:
    """Each node is a place; the sets of a dense one (node, n) are dealt into places of about `size`."""
    parts = F.ceil(F.col("n") / size).cast("int")
    place = F.when(F.col("n").isNull(), F.col("node")).otherwise(F.xxhash64("node", F.pmod(F.xxhash64("id"), parts)))
    return rows.join(dense, "node", "left").select(place.alias("place"), "id", "component", "s0", "s1", F.lit(0).alias("side"))


def _dealt_in_cells(rows: DataFrame, dense: DataFrame, size: int, broadcast_rows: int) -> DataFrame:
    """Each node is a place. In a dense node sets of one component need not meet: those outside its largest component are
    visitors, dealt into groups; all sets are members, dealt into blocks. Every group of visitors meets every block of
    members in a cell of about twice `size`; a dense node of a single component has no place."""
    inside = rows.join(dense, "node", "left_semi").groupBy("node", "component").agg(F.count("*").alias("k"))
    of_node = inside.groupBy("node").agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("main"))
    known = durable(of_node.select("node", "n", F.col("main.component").alias("main"), (F.col("n") - F.col("main.k")).alias("m")))
    blocks, groups = F.ceil(F.col("n") / size).cast("int"), F.ceil(F.col("m") / size).cast("int")
    block, group = F.pmod(F.xxhash64("id"), blocks), F.pmod(F.xxhash64(F.lit(1), "id"), groups)
    cell = lambda b, g, side: F.struct(F.xxhash64("node", b.cast("int"), g.cast("int")).alias("place"), F.lit(side).alias("side"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    as_member = F.transform(up_to(groups), lambda g: cell(block, g, 1))
    as_visitor = F.when(F.col("component") == F.col("main"), F.array().cast(CELLS)).otherwise(F.transform(up_to(blocks), lambda b: cell(b, group, 2)))
    cells = F.when(F.col("n").isNull(), F.array(F.struct(F.col("node").alias("place"), F.lit(0).alias("side")))).when(F.col("m") > 0, F.concat(as_member, as_visitor)).otherwise(F.array().cast(CELLS))
    met = rows.join(_small(known, broadcast_rows), "node", "left").select("id", "component", "s0", "s1", F.explode(cells).alias("c"))
    return met.select("c.place", "id", "component", "s0", "s1", "c.side")


class _Block:
    """The sets of one block, and an index from shingle to set."""

    def __init__(self):
        self.ids, self.components, self.sets, self.ready = [], [], [], False

    def add(self, i: int, component: int, values: np.ndarray) -> None:
        self.ids.append(i), self.components.append(component), self.sets.append(values)

    def links(self, i: int, component: int, values: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """A confirmed link from this set to each other component that has one in the block."""
        if not self.ready:
            self.sizes = np.array([len(s) for s in self.sets])
            every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
            order = np.argsort(every, kind="stable")
            self.values, self.owner = every[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
            self.of, self.who, self.ready = np.array(self.components, np.int64), np.array(self.ids, np.int64), True
        low, high = np.searchsorted(self.values, values, "left"), np.searchsorted(self.values, values, "right")
        n = high - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        linked = np.flatnonzero((100 * shared >= percent * (len(values) + self.sizes - shared)) & (shared > 0) & (self.of != component))
        _, first = np.unique(self.of[linked], return_index=True)
        return [(i, int(x)) for x in self.who[linked[first]]]


def _block_links(df: DataFrame, text: str, doc_id: str, words: int, clustered: DataFrame, percent: int, block: int) -> DataFrame:
    """Confirmed links a, b between components of one cluster. clustered: id, cluster, component. Blocks of sets and groups of
    those outside the main component meet in cells, as in a dense node."""
    sizes = clustered.groupBy("cluster", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("cluster").agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed = clustered.join(main.select("cluster", "n", F.col("main.component").alias("main"), (F.col("n") - F.col("main.k")).alias("m")), "cluster")
    blocks, groups = F.ceil(F.col("n") / block).cast("int"), F.ceil(F.col("m") / block).cast("int")
    own_block, own_group = (F.pmod(F.xxhash64(F.lit(i), "id"), n).cast("int") for i, n in enumerate((blocks, groups)))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    home = F.transform(up_to(groups), lambda g: F.struct(own_block.alias("block"), g.alias("group"), F.lit(0).alias("visitor")))
    guest = F.transform(up_to(blocks), lambda b: F.struct(b.alias("block"), own_group.alias("group"), F.lit(1).alias("visitor")))
    every = F.when(F.col("component") == F.col("main"), home).otherwise(F.concat(home, guest))
    roles = durable(mixed.select("id", "cluster", "component", every.alias("roles")))
    sets = _shingle_sets(df, text, doc_id, words, roles.select("id").distinct())
    rows = roles.join(sets, "id").select("id", "cluster", "component", "shingles", F.explode("roles").alias("r"))
    rows = rows.select(F.xxhash64("cluster", "r.block", "r.group").alias("place"), "r.visitor", "id", "component", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, _Block()
        for batch in batches:
            a: list[tuple[int, int]] = []
            for place, visitor, i, component, values in zip(*(batch.column(c) for c in ("place", "visitor", "id", "component", "shingles")), strict=True):
                if place != now:
                    now, held = place, _Block()
                own = np.frombuffer(values.as_buffer(), np.uint64)
                if visitor.as_py():
                    a += held.links(i.as_py(), component.as_py(), own, percent)
                else:
                    held.add(i.as_py(), component.as_py(), own)
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in a], pa.int64()), pa.array([max(p) for p in a], pa.int64())], ["a", "b"])

    return rows.repartition("place").sortWithinPartitions("place", "visitor").mapInArrow(tidy(run), "a long, b long").distinct()


def _shingle_sets(df: DataFrame, text: str, doc_id: str, words: int, ids: DataFrame) -> DataFrame:
    """id and shingles (sorted hashes of the whole set, packed) of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_steps(batches, "__text"):
            values, offsets = shingle_sets(*utf8(part.column("__text")), words)
            sets = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    wanted = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("__text")).join(ids, "id", "left_semi")
    return wanted.mapInArrow(tidy(run), "id long, shingles binary")


def _confirm(df: DataFrame, text: str, doc_id: str, words: int, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _shingle_sets(df, text, doc_id, words, ids)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 80, recall: float = 0.99999, leaf: int = 256, block: int = 512, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id linked, directly or not) and kept (the document is its component's least) of each row.

    broadcast_rows bounds the lists of dense nodes that are broadcast; longer ones meet the nodes by a join.
    """
    described = durable(_describe(df, text, doc_id, words))
    best = described.where("set_key IS NOT NULL AND id IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("id", "signature")).alias("m"))
    sets = durable(best.select("set_key", "m.id", "m.signature"))
    n = max(1, sets.count())
    similarity = percent / 100
    two = 1 / similarity - 1
    # Unrelated sets share a token with a probability under 1 in 20: so many levels leave a few of them to a node.
    levels = max(1, math.ceil(math.log(max(2.0, 8 * n / leaf)) / math.log(20)))
    trees = next(t for t in itertools.count(1) if meeting_probability(similarity, levels, t) >= recall)
    # An estimate this far below the threshold is more than four standard errors off: agreeing tokens include 1 in 4 by chance.
    at_threshold = similarity + (1 - similarity) / 4
    least = math.floor(TOKENS * at_threshold - 4.3 * math.sqrt(TOKENS * at_threshold * (1 - at_threshold)))

    alone = sets.withColumn("component", F.col("id"))
    counts = _node_rows(alone, 0, trees, levels, two, compare=False).groupBy("node").agg(F.count("*").alias("n"))
    dense = durable(counts.where(F.col("n") > leaf))
    stars = lambda of: of.select(F.col("id").alias("a"), F.col("component").alias("b"))

    early = _dealt_evenly(_node_rows(alone, 0, min(trees, EARLY_TREES), levels, two), _small(dense, broadcast_rows), CONTRACT)
    tried = durable(_forest_pairs(early, least))
    found = connected_components(_confirm(df, text, doc_id, words, tried, percent))

    linked = durable(sets.join(found, "id", "left").select("id", "signature", F.coalesce("component", "id").alias("component")))
    rows = _node_rows(linked, 0, trees, levels, two)
    placed = _dealt_in_cells(rows, dense, leaf, broadcast_rows) if not dense.isEmpty() else rows.select(F.col("node").alias("place"), "id", "component", "s0", "s1", F.lit(0).alias("side"))
    more = durable(_forest_pairs(placed, least).join(tried, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        found = connected_components(stars(found).union(_confirm(df, text, doc_id, words, more, percent)))

    clusters = connected_components(stars(found).union(tried).union(more)).withColumnRenamed("component", "cluster")
    clustered = durable(clusters.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    # A pair that failed may keep two sets apart that are linked through others, untried or not.
    if not clustered.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").isEmpty():
        late = durable(_block_links(df, text, doc_id, words, clustered, percent, block))
        if not late.isEmpty():
            found = connected_components(stars(found).union(late))
    of_set = sets.select("set_key", "id").join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("c"))
    out = described.join(of_set, "set_key", "left").select(F.col("id").alias(doc_id), "n_shingles", F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)))

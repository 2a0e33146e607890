"""Links that rest on the rounds after the first, and the recall of the trees."""

import random

import numpy as np

import brute
from strandframe.llm import neardup
from strandframe.llm.common import mix64, utf8


def _triple(seed):
    """a and c at exactly 0.80; b at 0.782 to both."""
    r = random.Random(seed)
    words = [f"w{r.randrange(10**9)}" for _ in range(106)]
    core, own_a, own_c, own_b = words[:80], words[80:90], words[90:100], words[100:]
    return [" ".join(core + own_a), " ".join(core[:74] + own_a[:5] + own_c[:5] + own_b), " ".join(core + own_c)]


def _unlucky(texts, trees):
    """Whether the sketch ranks both failing pairs above the link, and each node of the trees with a and c holds b."""
    import pyarrow as pa

    signature = neardup._signatures(*neardup.shingle_sets(*utf8(pa.array(texts)), 1))
    marks = signature[:, : neardup.TOKENS] >> 14
    ab, bc, ac = ((marks[i] == marks[j]).sum() for i, j in ((0, 1), (1, 2), (0, 2)))
    if min(ab, bc) <= ac or min(ab, bc, ac) < 42:
        return False
    roots = mix64(np.arange(1, trees + 1, dtype=np.uint64) * neardup._KEY)
    row = np.tile(np.arange(3), trees)
    at, node = neardup._branch(np.repeat(roots, 3), signature[row], 0.25)
    a, b, c = (set(node[row[at] == i].tolist()) for i in range(3))
    return a & c <= b and bool(a & b & c)


def test_a_link_behind_two_failed_pairs(spark):
    texts = next(t for t in map(_triple, range(200_000)) if _unlucky(t, 1))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(rows, words=1, recall=0.3).collect()}
    assert got == {i: c for i, (_, c) in brute.near_duplicates(list(enumerate(texts)), 1).items()} == {0: 0, 1: 1, 2: 0}


def test_recall_counts_levels_and_shared_tokens():
    """Against a simulation of the branching of pairs at the threshold."""
    levels, trees, pairs = 4, 2, 20_000
    g = np.random.Generator(np.random.PCG64(4))
    a = g.integers(0, 1 << 16, (pairs, neardup.BRANCH_TOKENS), dtype=np.uint16)
    b = np.where(g.random(a.shape) < 0.8, a, a + np.uint16(1))
    met = np.zeros(pairs, bool)
    for tree in range(trees):
        node = mix64(np.arange(pairs, dtype=np.uint64) + np.uint64(1 + tree * pairs))
        row = np.arange(pairs)
        for more in [0.25] * levels:
            at, left = neardup._branch(node, a[row], more)
            again, right = neardup._branch(node, b[row], more)
            assert (at == again).all()
            row, node = row[at][left == right], left[left == right]
        met[row] = True
    assert abs(met.mean() - neardup.meeting_probability(0.8, levels, trees)) < 0.01


def _edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10**9)}"
    return out


def _exact(spark, texts, words=2, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(rows, words=words, **options).collect()}
    assert got == brute.near_duplicates(list(enumerate(texts)), words)
    return len({c for _, c in got.values()})


def test_thousands_of_borderline_pairs_and_groups(spark):
    """Copies whose similarity lies around the threshold, in pairs, triples and small groups."""
    r = random.Random(12)
    texts = []
    for _ in range(1500):
        base = [f"w{r.randrange(10**9)}" for _ in range(r.randrange(30, 120))]
        texts += [" ".join(_edited(r, base, r.randrange(0, max(2, len(base) // 9)))) for _ in range(r.choice([2, 2, 3, 6]))]
    r.shuffle(texts)
    assert 1500 < _exact(spark, texts) < len(texts)


def test_dense_nodes_meet_in_cells(spark, monkeypatch):
    """One group around the threshold, another just below it, in nodes far over `leaf`; lists of dense nodes broadcast or joined."""
    monkeypatch.setattr(neardup, "CONTRACT", 8)
    r = random.Random(3)
    base, below = ([f"w{r.randrange(10**9)}" for _ in range(80)] for _ in range(2))
    texts = [" ".join(_edited(r, base, r.randrange(0, 11))) for _ in range(300)] + [" ".join(_edited(r, below, r.randrange(6, 9))) for _ in range(150)]
    for broadcast_rows in (1_000_000, 0):
        assert _exact(spark, texts, leaf=16, block=32, broadcast_rows=broadcast_rows) > 100


def test_every_way_gives_components_of_exact_links(spark, monkeypatch):
    """Round 1 sees too little (one set to a place): rounds 2 and 3 find the same."""
    monkeypatch.setattr(neardup, "CONTRACT", 1)
    r = random.Random(6)
    base = [f"w{r.randrange(10**9)}" for _ in range(60)]
    _exact(spark, [" ".join(_edited(r, base, r.randrange(0, 9))) for _ in range(120)], leaf=8, block=16)

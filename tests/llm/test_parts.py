"""Parts that the small tables do not reach: exact ways beyond a bound, and laws of random draws."""

import random

import numpy as np
import pytest

import brute
from strandframe.llm import bpe, components, decontaminate, neardup, pii, sharding, substrings


def _rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_perfect_hash_has_one_slot_for_each_token():
    tokens = {bytes([a, b]): i for i, (a, b) in enumerate((a, b) for a in range(64) for b in range(40))}
    v = bpe.Vocabulary.build(tokens, ".")
    assert sorted(v.slots) == sorted(tokens) and all(v.find(t) == i for t, i in tokens.items()) and v.find(b"zzz") == -1


def test_components_by_star_steps(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x.id: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8), local_edges=20).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_large_groups_of_near_copies(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(100)]
    texts = []
    for i in range(260):
        copy = list(base)
        for _ in range(r.randrange(0, 14)):
            copy[r.randrange(100)] = r.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(r.choice(words) for _ in range(80)) for _ in range(60)]
    got = {x.doc_id: x for x in neardup.near_duplicates(_rows(spark, texts), words=2, leaf=16, block=32).collect()}
    for i, (n, component) in brute.near_duplicates(list(enumerate(texts)), 2).items():
        assert (got[i].n_shingles, got[i].component_id) == (n, component)


def _removed(spark, texts, **options):
    got = substrings.remove_repeats(_rows(spark, texts), **options).collect()
    want = brute.repeats(list(enumerate(texts)))
    assert len(got) == len(texts)
    for x in got:
        spans = [(s.start, s.end) for s in x.spans]
        assert (x.n_bytes, sum(b - a for a, b in spans), len(spans), brute.sha(bytes(x.kept_bytes))) == want[x.doc_id], x.doc_id


@pytest.mark.parametrize(("hot", "broadcast_bytes", "bits"), [(20_000, 64 << 20, 64), (3, 0, 64), (60, 0, 64), (20_000, 0, 8), (5, 64 << 20, 8), (1, 0, 1)])
def test_frequent_passages(spark, hot, broadcast_bytes, bits):
    """Also with leads that are split down to whole windows, and with hashes of 8 bits or 1: they only choose what is compared."""
    r = random.Random(hot)
    noise = lambda n: "".join(r.choice("abcdef gh") for _ in range(n))
    passage = noise(130)
    texts = [noise(r.randrange(200)) + passage[r.randrange(25) :] + noise(r.randrange(150)) for _ in range(80)] + ["ab" * 400, "ab" * 401, passage * 3, passage[:99]]
    texts += ["\0" * 150, "x" + "\0" * 220 + "y", passage[:60] + "\0" * 60, passage[:60] + "\0" * 59]
    _removed(spark, texts, hot=hot, broadcast_bytes=broadcast_bytes, bits=bits)


@pytest.mark.parametrize("step", [1, 7, 50_000])
def test_buckets_in_steps_of_whole_leads(spark, monkeypatch, step):
    monkeypatch.setattr(substrings, "BUCKET_STEP", step)
    r = random.Random(step)
    passages = ["".join(r.choice("abc ") for _ in range(110)) for _ in range(6)]
    _removed(spark, ["".join(r.choice(passages)[r.randrange(9) :] + r.choice(["", "-", "=="]) for _ in range(4)) for _ in range(50)])


def test_multikey_order_is_that_of_bytes():
    g = np.random.Generator(np.random.PCG64(2))
    rows = g.integers(0, 2, (400, 19), dtype=np.uint8)
    group = g.integers(0, 3, 400)
    order, common = substrings.multikey_order(group, rows)
    keys = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(400))
    for (a, x), (b, y), c in zip(keys, keys[1:], common[1:]):
        assert c == (-1 if a != b else next((i for i in range(19) if x[i] != y[i]), 19))


def test_rows_without_an_id_are_left_alone(spark):
    text = "some passage that is long enough to count " * 5
    rows = spark.createDataFrame([(None, text), (None, text + "x"), (4, text), (5, text)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, bytes(x.kept_bytes).decode() == t) for x in substrings.remove_repeats(rows, keep=("doc_id", "text")).collect() for t in [x.text])
    assert [a for a, _ in got] == [0, 0, 4, 5] and [b for _, b in got] == [True, True, False, False]


def test_terms_beyond_a_broadcast_are_joined(spark):
    texts = [f"contact boss{i % 2}@corp.example codeword{'alpha' if i % 2 else 'bravo'} with note number {i} {'x' * i}" for i in range(12)] + ["nothing here"] * 30
    few = {x.doc_id: (x.spans, x.sanitized) for x in pii.sanitize(_rows(spark, texts)).collect()}
    many = {x.doc_id: (x.spans, x.sanitized) for x in pii.sanitize(_rows(spark, texts), max_broadcast_terms=1).collect()}
    assert few == many and any(s.kind == "disclosing" for spans, _ in few.values() for s in spans)
    assert few[20][1] == "nothing here" and "codeword" not in few[0][1] and "[EMAIL]" in few[0][1]


def test_several_automata_find_the_same(spark):
    items = spark.createDataFrame([(i, f"alpha beta gamma w{i} delta") for i in range(30)], "item_id long, text string")
    docs = _rows(spark, ["zero Alpha, beta gamma w7 DELTA end", "alpha beta gamma w31 delta"])
    one, many = (decontaminate.find_contamination(docs, items, max_words=n).orderBy("doc_id").collect() for n in (10_000, 60))
    assert one == many and one[0]["items"] == ["7"] and [(s.start, s.end) for s in one[0].spans] == [(5, 31)]


def test_communication_matrix_is_exact_and_uniform():
    rows = np.array([5, 0, 17, 1])
    draws = np.stack([sharding.communication_matrix(rows, 4, s) for s in range(600)])
    assert (draws.sum(axis=2) == rows).all() and set(np.unique(draws.sum(axis=1))) == {5, 6}
    assert abs(draws[:, 2, :].mean(axis=0) - 17 / 23 * np.array([6, 6, 6, 5])).max() < 0.25


def test_huge_hypergeometric_draws():
    g = np.random.Generator(np.random.PCG64(1))
    x = np.array([sharding._hypergeometric(g, 10**12, 3 * 10**12, 10**6) for _ in range(300)])
    assert abs(x.mean() - 250_000) < 100 and 350 < x.std() < 520


def test_forward_backward_sums_over_all_labellings():
    from itertools import product

    from strandframe.llm import quality_crf

    score, owner = np.array([0.3, -1.2, 0.7, 2.0]), np.array([0, 0, 0, 1])
    change = np.array([[0.5, -0.4], [-0.2, 0.1]])
    good, _ = quality_crf.marginals(score, owner, change)
    weight = {y: np.exp(sum(score[i] * y[i] for i in range(3)) + change[y[0], y[1]] + change[y[1], y[2]]) for y in product((0, 1), repeat=3)}
    for i in range(3):
        assert np.isclose(good[i], sum(w for y, w in weight.items() if y[i]) / sum(weight.values()))
    assert np.isclose(good[3], 1 / (1 + np.exp(-2.0)))


def test_one_common_gram_is_dealt_over_tasks(spark):
    """Anchors around rule lines, all different: right results, and few of them wait for each other in one task."""
    r = random.Random(12)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rule = "=" * 90
    rules = [c * 90 for c in "=-_#*~+.:;!?/|%&^@<>"]  # the hash decides which of them are anchors
    texts = ["".join(noise(r.randrange(60, 90)) + line for line in rules) + noise(70) for _ in range(60)]
    texts += [texts[3][20:200], noise(80) + rule[:60] + noise(80), texts[7]]
    _removed(spark, texts)
    marks = substrings._scan(_rows(spark, texts).coalesce(1), "text", "doc_id", 100, 32, 64).toPandas()
    waiting = marks[(marks.code > 0) & (marks.code < substrings._CROWDED)]
    assert (marks.code >= substrings._CROWDED).sum() > 50, marks.code.max()
    assert waiting.groupby("gram").size().max() < substrings.CROWD
    assert set(marks[marks.code == 0].gram) == set(marks[marks.code >= substrings._CROWDED].gram)

"""Similar texts, greedy groups and likeness scores against plain programs on thousands of random inputs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandframe.functions import likeness
from strandframe.operators import fuzzy
from strandframe.plans import composites, queries

WORDS = ["alpha", "beta", "transporter", "permease", "ABC", "abc", "x", "regulator", "of", "oxygenase", "small", "subunit", "é", "ß日"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def edit_score(a, b):
    a, b = a.lower(), b.lower()
    return (1 - edits(a, b) / max(len(a), len(b))) if a and b else 0.0


def words_score(a, b):
    return edit_score(" ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split())))


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def whole(a, b):
    return 2 * common(a, b) / (len(a) + len(b)) if a and b else 0.0


def stretch(a, b):
    short, long = sorted((a, b), key=len)
    pieces = {long[max(0, p) : max(0, p + len(short))] for p in range(-len(short), len(long))} if short else set()
    return max((whole(short, p) for p in pieces), default=0.0)


def weighted_score(a, b):
    """From the statement of the score, a pair at a time."""
    a, b = a.lower(), b.lower()
    if not a or not b:
        return 0.0
    one, two = set(a.split()), set(b.split())
    join = lambda s: " ".join(sorted(s))
    both, x, y = join(one & two), join(one - two), join(two - one)
    in_order = [" ".join(sorted(t.split())) for t in (a, b)]
    ratio = max(len(a), len(b)) / min(len(a), len(b))
    if ratio < 1.5:
        with_x, with_y = (both + " " + x).strip(), (both + " " + y).strip()
        shared = 1.0 if both and not (x and y) else max(whole(with_x, with_y), whole(both, with_x), whole(both, with_y))
        return max(whole(a, b), 0.95 * whole(*in_order), 0.95 * shared)
    weight = 0.9 if ratio <= 8 else 0.6
    return max(whole(a, b), weight * stretch(a, b), weight * 0.95 * max(stretch(*in_order), 1.0 if both else stretch(x, y)))


SCORES = {"edit": edit_score, "words": words_score, "weighted": weighted_score}


def sequential_groups(rows, rules, threshold, score):
    """One row after another, each product remembering the group it got last."""
    founders, group = [], {}
    for name in rows:
        ruled = next((g for k, g in rules if k in name.lower()), None)
        if ruled:
            group[name] = ruled
            continue
        if name in founders:
            group[name] = name
            continue
        scores = [(score(name, f), -i) for i, f in enumerate(founders)]
        best = max(scores, default=(-1, 0))
        if best[0] >= threshold:
            group[name] = founders[-best[1]]
        else:
            founders.append(name)
            group[name] = name
    return group


def _text(r):
    t = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 6)))
    for _ in range(r.choice([0, 0, 1, 2])):
        i = r.randrange(len(t) + 1)
        t = t[:i] + r.choice(["", "q", "a", " "]) + t[i + r.choice([0, 1]) :]
    return t


def test_scores_of_random_pairs():
    r = random.Random(1)
    size = lambda: r.choice([0, 1, 5, 20, 63, 64, 65, 130])
    a, b = ([("".join(r.choice("abc é日") for _ in range(size()))) for _ in range(400)] for _ in range(2))
    assert likeness.common_subsequence(a, b).tolist() == [common(x, y) for x, y in zip(a, b)]
    assert likeness.likest_stretch(a[:60], b[:60]).tolist() == pytest.approx([stretch(x, y) for x, y in zip(a[:60], b[:60])])
    a, b = ([_text(r) for _ in range(400)] + ["", "x", "", " "] for _ in range(2))
    assert likeness.weighted([x.lower() for x in a], [x.lower() for x in b]).tolist() == pytest.approx([weighted_score(x, y) for x, y in zip(a, b)])
    assert len(likeness.weighted([], [])) == 0


def test_scores_of_columns(spark):
    df = spark.createDataFrame([("ABC transporter permease", "permease ABC transporter"), ("transporter", "ABC transporter permease"), (None, "x"), ("", "x"), ("a", "A")], "a string, b string")
    got = [r.s for r in df.select(likeness.weighted_likeness(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [pytest.approx(0.95), pytest.approx(0.9), None, 0.0, 1.0]


@pytest.mark.parametrize("scorer, threshold", [("edit", 0.9), ("edit", 0.75), ("edit", 0.5), ("words", 0.85), ("weighted", 0.9), ("weighted", 0.94)])
def test_similar_pairs_are_those_of_all_pairs(spark, scorer, threshold):
    r = random.Random(int(threshold * 100))
    rows = list({(k, t[:6] if threshold == 0.75 else t) for k in "pq" for t in (_text(r) for _ in range(130))}) + [("p", ""), ("p", None), (None, "alpha")]
    got = {(x.k, x.a, x.b): x.score for x in fuzzy.similar_pairs(spark.createDataFrame(rows, "k string, text string"), ["k"], threshold, scorer).collect()}
    score = SCORES[scorer]
    want = {(k, a, b): score(a, b) for k, a in rows for k2, b in rows if k and k == k2 and a is not None and b is not None and a < b}
    want = {p: s for p, s in want.items() if s >= threshold}
    assert want and got == pytest.approx(want)


@pytest.mark.parametrize("threshold", [0.9, 0.8, 1.0])
def test_short_texts_of_few_letters(spark, threshold):
    """Lengths on either side of one and of two edits; letters repeat, so that one edit can be had in several ways."""
    r = random.Random(int(threshold * 10))
    texts = {"".join(r.choice("01é" if r.random() < 0.2 else "0") for _ in range(r.choice([1, 2, 4, 5, 9, 10, 11, 18, 19, 20, 21, 22]))) for _ in range(160)} | {"Ab" * 5, "aB" * 5, "0\x000000000000", "00000000000000"}
    got = {(x.a, x.b): x.score for x in fuzzy.similar_pairs(spark.createDataFrame([("k", t) for t in texts], "k string, text string"), ["k"], threshold).collect()}
    want = {(a, b): s for a in texts for b in texts if a < b and (s := edit_score(a, b)) >= threshold}
    assert want and got == pytest.approx(want)


def test_numbers_meet_only_where_one_edit_lies_between(spark):
    """3,000 names that share nearly all bigrams: about 54 others are one digit away, and no more meet."""
    rows = spark.range(3000).select(F.lit("s").alias("scope"), F.format_string("Customer#%09d", "id").alias("text"))
    low = rows.withColumn("low", F.lower("text"))
    met, pairs = fuzzy._candidates_by_edits(low, ["scope"], 0.9), fuzzy.similar_pairs(rows, ["scope"], 0.9).count()
    assert pairs == met.distinct().count() == sum(10 * 9 // 2 * 300 for _ in range(3)) + 1000 * 3


def test_thresholds_without_an_exact_filter_raise(spark):
    df = spark.createDataFrame([("a",)], "text string")
    for threshold, scorer in ((0.89, "weighted"), (0, "edit"), (0.9, "other")):
        with pytest.raises(ValueError):
            fuzzy.similar_pairs(df, [], threshold, scorer)


@pytest.mark.parametrize("scorer, threshold, scopes", [("edit", 0.75, 1500), ("edit", 0.9, 300), ("weighted", 0.9, 120)])
def test_groups_follow_the_sequential_model(spark, scorer, threshold, scopes):
    """Each scope is a random input of its own: short texts that resemble each other in chains."""
    r = random.Random(7)
    letters = lambda: "".join(r.choice("ab") for _ in range(4)) + r.choice(["", "", " reductase"])
    inputs = {s: [letters() if threshold == 0.75 else _text(r)[:14] for _ in range(r.randint(1, 24))] for s in range(scopes)}
    df = spark.createDataFrame([(s, n, i) for s, rows in inputs.items() for i, n in enumerate(rows)], "c int, n string, i int")
    got = defaultdict(dict)
    for x in composites.fuzzy_group(df, ["c"], "n", "i", threshold=threshold, scorer=scorer).collect():
        got[x.c][x.n] = x.group
    for s, rows in inputs.items():
        assert got[s] == sequential_groups(rows, composites.PRODUCT_RULES, threshold, SCORES[scorer]), rows


def test_groups_of_rows_at_one_position_null_scopes_and_no_scope(spark):
    rows = [("c", "abcdefghij", 1), ("c", "abcdefghix", 1), ("c", "zzz", None), ("c", "zzy", None), ("c", "abcdefghiy", None), (None, "zzz", 1), (None, "zzy", 2), ("c", None, 1)]
    df = spark.createDataFrame(rows, "c string, n string, i int")
    group = lambda d, scope: {(*[x[c] for c in scope], x.n): x.group for x in composites.fuzzy_group(d, scope, "n", "i", threshold=0.6).collect()}
    same = {"abcdefghij": "abcdefghij", "abcdefghix": "abcdefghij", "abcdefghiy": "abcdefghij"}
    assert group(df, ["c"]) == {**{("c", n): g for n, g in same.items()}, ("c", "zzy"): "zzy", ("c", "zzz"): "zzy", (None, "zzz"): "zzz", (None, "zzy"): "zzz"}
    assert group(df, []) == {**{(n,): g for n, g in same.items()}, ("zzy",): "zzz", ("zzz",): "zzz"}
    assert group(df.limit(0), ["c"]) == {}
    clash = df.withColumnsRenamed({"c": "text", "n": "group_", "i": "first"})
    assert {(x.text, x.group_): x.group for x in composites.fuzzy_group(clash, ["text"], "group_", "first", threshold=0.6).collect()} == group(df, ["c"])


def test_a_long_chain_of_likeness(spark):
    """Each name resembles the next only: every second one leads."""
    pairs = spark.createDataFrame([("s", f"{i:02d}", f"{i + 1:02d}") for i in range(9)], "k string, earlier string, later string")
    assert sorted(x.text for x in fuzzy.greedy_followers(pairs, ["k"]).collect()) == ["01", "03", "05", "07", "09"]


def test_plans_hold_no_group_in_python(spark, capsys):
    composites.fuzzy_group(spark.createDataFrame([("c", "n", 1)], "c string, n string, i int"), ["c"], "n", "i").explain()
    assert "FlatMapGroups" not in capsys.readouterr().out


def test_weighted_groups_of_part_names(spark):
    folder = "/root/testdata/sf0.001"
    names = defaultdict(list)
    for x in spark.read.parquet(f"{folder}/part.parquet").orderBy("p_partkey").collect():
        names[x.p_brand].append(x.p_name)
    got = {(x.p_brand, x.p_name): x.group for x in queries.fuzzy_group_weighted(spark, folder).collect()}
    want = {(b, n): g for b, rows in names.items() for n, g in sequential_groups(rows, queries.PART_RULES, 0.9, weighted_score).items()}
    assert got == want

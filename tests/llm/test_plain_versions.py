"""Scores, verdicts and corpus statistics against plain loops over small corpora."""

import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import brute
from strandframe.llm import langid, pii, quality_crf, repetition
from strandframe.llm.common import utf8

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n ", "one", "a b\n\na b\nA B", "no letters 123 ###", "x " * 200, "über\nlicht 9%\n" * 12, "tab\tand\x0bmore\r\nline"]


def _documents():
    table = pq.read_table(f"{SMALL}/documents.parquet")
    return [*table["text"].to_pylist(), *ODD], [*table["lang"].to_pylist(), *([None] * len(ODD))]


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


# --- repetition ---------------------------------------------------------------------------------------------------------------


def _shares(text):
    words = WORD.findall(text or "")
    whole, out = max(1, sum(map(len, words))), {}
    for k in (5, 8, 12):
        windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        times = Counter(windows)
        hit = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + k)}
        out[f"ngram_share_{k}"] = sum(len(words[j]) for j in hit) / whole
    seen, chars = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            chars += sum(map(len, WORD.findall(line))) if line in seen else 0
            seen.add(line)
    return out | {"dup_line_share": chars / whole}


def test_shares_and_verdict(spark):
    texts, _ = _documents()
    limits = {"ngram_share_5": 0.40, "ngram_share_8": 0.30, "ngram_share_12": 0.30, "dup_line_share": 0.30}
    for r in repetition.repetition_quality(_frame(spark, list(enumerate(texts)), "doc_id long, text string")).collect():
        want = _shares(texts[r.doc_id])
        assert {c: r[c] for c in want} == pytest.approx(want), r.doc_id
        assert r.kept == (not brute.repetition(texts[r.doc_id])[5] and all(want[c] <= x for c, x in limits.items())), r.doc_id


# --- language -----------------------------------------------------------------------------------------------------------------


def _buckets(text, buckets=1 << 16, orders=(2, 3)):
    mask, padded = (1 << 64) - 1, " " + text.lower()
    for n in orders:
        for i in range(len(padded) - n + 1):
            h = n
            for c in padded[i : i + n]:
                h = (h + ord(c)) * 0x9E3779B97F4A7C15 & mask
                h ^= h >> 29
            yield (h * 0xBF58476D1CE4E5B9 & mask) >> 64 - int(math.log2(buckets)), padded[i : i + n]


def _plain_letters(gram):
    return all(c == " " or "a" <= c <= "z" or ord(c) >= 0xC0 for c in gram)


def test_posterior_from_plain_counts(spark):
    texts, langs = _documents()
    texts, langs = texts[:60] + ODD, langs[:60] + [None] * len(ODD)
    counts, rows = defaultdict(Counter), Counter()
    for t, one in zip(texts, langs):
        if t is not None and one is not None:
            rows[one] += 1
            counts[one].update(b for b, _ in _buckets(t))
    total = {one: sum(c.values()) + 0.5 * (1 << 16) for one, c in counts.items()}
    logp = lambda one, b: math.log((counts[one][b] + 0.5) / total[one])
    df = _frame(spark, list(zip(range(len(texts)), texts, langs)), "doc_id long, text string, lang string")
    for r in langid.identify_language(df, langid.train_language_model(df)).collect():
        t = texts[r.doc_id] or ""
        if not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score, r.fit) == ("und", 0, None)
            continue
        grams = list(_buckets(t))
        scores = {one: math.log(n / sum(rows.values())) + sum(logp(one, b) for b, _ in grams) for one, n in rows.items()}
        best = max(sorted(scores), key=scores.get)
        usual = sum(n * logp(best, b) for b, n in counts[best].items()) / sum(counts[best].values())
        plain = [logp(best, b) for b, g in grams if _plain_letters(g)]
        assert r.lang_pred == best, r.doc_id
        assert r.score == pytest.approx(1 / sum(math.exp(s - scores[best]) for s in scores.values()), abs=1e-3)
        assert r.fit == pytest.approx(sum(plain) / max(1, len(plain)) - usual, abs=1e-3)


def test_pieces_of_a_long_text_count_every_ngram_once(monkeypatch):
    texts = ["some words, über and more " * 5, "", "short"]
    whole = [np.concatenate(x) for x in zip(*langid._ngrams(texts, (2, 3), 1 << 16))]
    monkeypatch.setattr(langid, "STEP_BYTES", 7)
    pieces = [np.concatenate(x) for x in zip(*langid._ngrams(texts, (2, 3), 1 << 16))]
    count = lambda parts: Counter(zip(*(p.tolist() for p in parts)))
    assert count(whole) == count(pieces)


def test_a_language_that_was_not_learnt_does_not_fit(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    other = spark.createDataFrame([(1, "これは日本語の文章です。読むことができますか"), (2, "Все люди рождаются свободными и равными")], "doc_id long, text string")
    model = langid.train_language_model(df)
    assert all(r.fit < -4 for r in langid.identify_language(other, model).collect())
    assert all(r.fit is None or r.fit > -4 for r in langid.identify_language(df, model).collect())


# --- quality ------------------------------------------------------------------------------------------------------------------


def _features(text):
    lines = [x for x in (text or "").encode().split(b"\n") if WORD.search(x.decode())]
    times = Counter(lines)
    rows = []
    for line in lines:
        words = line.split()
        words = WORD.findall(line.decode("utf-8"))
        raw, share = [w.encode() for w in words], lambda chars: sum(c in chars.encode() for c in line) / len(line)  # noqa: B023
        measures = {
            "symbols": share("#$%&*|<>{}[]\\^~_=@+/"), "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share("0123456789"), "marks": share(".,;:!?'\"()-"),
            "word_length": sum(map(len, raw)) / len(raw), "repeated_words": (len(raw) - len(set(raw))) / len(raw), "words": len(raw), "repeated_line": float(times[line] > 1),
        }
        rows.append([8 * i + bisect_right(edges, measures[k]) for i, (k, edges) in enumerate(quality_crf.EDGES.items())])
    width = 8 * len(quality_crf.EDGES)
    none = [3 * width] * len(quality_crf.EDGES)
    found = []
    for i, own in enumerate(rows):
        before = [x + width for x in rows[i - 1]] if i else none
        after = [x + 2 * width for x in rows[i + 1]] if i + 1 < len(rows) else none
        found.append(own + before + after + [3 * width + 1])
    return found, [len(x) for x in lines]


def test_score_by_enumerating_labellings():
    """Features, probabilities and weighting, all in plain loops, for texts of up to ten lines."""
    g = np.random.Generator(np.random.PCG64(5))
    model = quality_crf.LineChain(g.normal(size=quality_crf.N_FEATURES) / 3, g.normal(size=(2, 2)), 0.25)
    texts = [t for t in _documents()[0] if (t or "").count("\n") < 10][:60] + ODD[:7] + [ODD[8]]
    got = quality_crf.score_documents(*utf8(pa.array(texts)), model)
    for t, score in zip(texts, got):
        features, sizes = _features(t)
        if not features:
            assert score == 0.25
            continue
        line = [sum(model.weights[f] for f in row) for row in features]
        weight, good = 0.0, [0.0] * len(line)
        for labels in product((0, 1), repeat=len(line)):
            w = math.exp(sum(s * y for s, y in zip(line, labels)) + sum(model.change[a, b] for a, b in zip(labels, labels[1:])))
            weight += w
            for i, y in enumerate(labels):
                good[i] += w * y
        assert score == pytest.approx(sum(n * p / weight for n, p in zip(sizes, good)) / sum(sizes), abs=1e-9), t


def test_expected_changes_by_enumeration():
    g = np.random.Generator(np.random.PCG64(9))
    score, owner, change = g.normal(size=9) * 2, np.array([0, 0, 0, 0, 1, 2, 2, 2, 2]), g.normal(size=(2, 2))
    _, pairs = quality_crf.marginals(score, owner, change)
    want = np.zeros((2, 2))
    for d in (0, 1, 2):
        own = np.flatnonzero(owner == d)
        weights = {y: math.exp(sum(score[own] * y) + sum(change[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=len(own))}
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += w / sum(weights.values())
    assert np.allclose(pairs, want)


def test_a_text_that_changes_half_way(spark):
    """Half good and half bad lines: the chain changes once, and the score lies between."""
    table, labels = pq.read_table("/root/testdata/sf0.01/documents.parquet"), pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()
    texts = dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    model = quality_crf.train_line_chain(spark.createDataFrame([(texts[r["doc_id"]], r["quality"]) for r in labels if r["doc_id"] in texts], "text string, quality int"))
    of = lambda t: float(quality_crf.score_documents(*utf8(pa.array([t])), model)[0])
    lines = lambda q: [x for r in labels if r["quality"] == q and r["doc_id"] in texts for x in (texts[r["doc_id"]] or "").split("\n") if len(x) > 60]
    good, bad = ("\n".join(lines(q)[:12]) for q in (1, 0))
    assert of(good) > 0.9 > 0.2 > of(bad)
    assert of(bad) + 0.1 < of(good + "\n" + bad) < of(good) - 0.1


# --- personal data ------------------------------------------------------------------------------------------------------------


def _chosen(texts, reach=80, generalize_at=0.8, remove_at=0.95):
    n_e, n_et, contexts = Counter(), Counter(), defaultdict(set)
    term = re.compile(r"[^\W\d_]{4,}")
    for t in texts:
        spans = brute.personal(t)
        inside = {i for _, a, b in spans for i in range(a, b)}
        met, pairs = set(), set()
        for kind, a, b in spans:
            value = t[a:b].lower() if kind == "email" else re.sub("[^0-9]+", "." if kind == "ip" else "", t[a:b])
            low, high = max(0, a - reach), min(len(t), b + reach)
            low = max(low, t.rfind("\n", low, a) + 1)
            high = min(high, t.find("\n", b, high) if "\n" in t[b:high] else high)
            around = "".join(" " if i in inside else t[i] for i in range(low, high))
            cut = around
            if low > 0 and t[low - 1] != "\n":
                cut = cut.partition(" ")[2]
            if high < len(t) and t[high] != "\n":
                cut = cut.rpartition(" ")[0]
            met.add((kind, value))
            for w in {x.lower() for x in term.findall(cut)}:
                pairs.add((kind, value, w))
                contexts[kind, value, w].add(re.sub(r"\s+", " ", around.lower()).strip())
        n_e.update(met), n_et.update(pairs)
    n_t = Counter(w for t in texts for w in set(term.findall((t or "").lower())))
    best, prior = {}, min(0.499, sum(len(c) > 1 for c in contexts.values()) / max(1, len(contexts)))
    for (kind, value, w), n in n_et.items():
        c = len(contexts[kind, value, w])
        evidence = (c - 1 + prior) / (c + n_t[w] - n)
        if n_e[kind, value] == len(texts):
            continue
        r = min(1.0, math.log2(len(texts) * n / (n_e[kind, value] * n_t[w])) / math.log2(len(texts) / n_e[kind, value]))
        act = 2 if r >= remove_at and evidence >= 2 / 3 else 1 if r >= generalize_at and evidence >= 1 / 2 else 0
        best[w] = max(best.get(w, (0, -9, 0)), (act, r, -list(brute.BASE).index(kind)))
    return {w: ("remove" if act == 2 else "generalize", list(brute.BASE)[-k]) for w, (act, r, k) in best.items() if act}


def test_disclosing_terms_from_a_plain_corpus_loop(spark):
    r = random.Random(4)
    names = ["torvald", "quillon", "marbeck", "ashgrove"]
    filler = lambda: " ".join(r.choice(["meeting", "about", "budget", "river", "please", "of", "the"]) for _ in range(r.randrange(3, 9)))
    texts = [f"{filler()} {r.choice(names[:2])} at {r.choice(['tor', 'bob'])}@mail.example {filler()}\n{filler()} {r.choice(names)}" for _ in range(40)]
    texts += [f"{filler()} call marbeck on +1 (555) 010-9999 {filler()}", f"server ashgrovehost 10.0.0.7 {filler()}", None, ""] + [filler() for _ in range(400)]
    texts += [f"{filler()} ashgrovehost 10.0.0.7 {filler()}" for _ in range(3)] + [f"{filler()} vexley from 10.0.0.9 {filler()}" for _ in range(2)]
    found = pii.disclosing_terms(_frame(spark, [(t,) for t in texts], "text string")).collect()
    want = _chosen(texts)
    assert {x.term: (x.action, x.kind) for x in found} == want and len(want) >= 2
    words = {w.lower() for w in want}
    for x in pii.sanitize(_frame(spark, list(enumerate(texts)), "doc_id long, text string")).collect():
        t = texts[x.doc_id] or ""
        base = brute.personal(t)
        own = {(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{4,}", t) if m[0].lower() in words and not any(a < m.end() and m.start() < b for _, a, b in base)}
        assert {(s.start, s.end) for s in x.spans if s.kind in ("disclosing", "revealing")} == own
        assert not any(w in (x.sanitized or "").lower() for w in words)


def test_generalised_terms_name_the_kind_they_reveal(spark):
    texts = ["server ashgrovehost 10.0.0.7 is down", "ashgrovehost rebooted 10.0.0.7 again"] + [f"nothing number {i} here" for i in range(3000)]
    rows = {x.doc_id: x.sanitized for x in pii.sanitize(_frame(spark, list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (rows[0], rows[1]) == ("server [IP TERM] [IP] is down", "[IP TERM] rebooted [IP] again")
    assert rows[2] == texts[2]

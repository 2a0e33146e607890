"""Surroundings of every mention count, one sighting proves nothing, and what is chosen is right: planted names against rare words."""

import random

import pytest

from strandframe.llm import pii


def test_mentions_in_one_document_count_each(spark):
    lines = ["ask lone.person@corp.example about quetzalcode today", "mail lone.person@corp.example, quetzalcode is late", "for quetzalcode see lone.person@corp.example again"]
    texts = ["\n".join(lines), *["nothing to see here"] * 30]
    found = pii.disclosing_terms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {(x.term, x.disclosure, x.action) for x in found} == {("quetzalcode", 1.0, "remove")}


def test_copies_of_one_line_stay_one_surrounding(spark):
    texts = ["ask lone.person@corp.example about quetzalcode today\n" * 5, *["nothing to see here"] * 30]
    assert pii.disclosing_terms(spark.createDataFrame([(t,) for t in texts], "text string")).count() == 0


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("n", [400, 20_000])
def test_ordinary_words_beside_an_entity_stay(spark, n):
    text = "yesterday afternoon write to bob@example.com about invoices please"
    rows = pii.sanitize(_frame(spark, [text, *[f"filler number {i}" for i in range(n)]])).where("doc_id = 0").collect()
    assert rows[0].sanitized == text.replace("bob@example.com", "[EMAIL]")


def test_planted_names_go_and_rare_words_stay(spark):
    """Forty entities, each with a code word of its own in three or four messages, and with rare words that occur once."""
    r = random.Random(9)
    word = lambda k: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(k))
    common = [word(3) for _ in range(60)]
    filler = lambda n: " ".join(r.choice(common) for _ in range(n))
    planted, rare, texts = set(), set(), [filler(12) for _ in range(2000)]
    for i in range(40):
        code = f"code{word(4)}"
        planted.add(code)
        for _ in range(r.choice([3, 4])):
            once = f"rare{word(5)}"
            rare.add(once)
            texts.append(f"{filler(4)} {once} {filler(1)} {code} person{i}@corp.example {filler(5)}")
    chosen = {x.term for x in pii.disclosing_terms(_frame(spark, texts)).collect()}
    assert planted <= chosen and not chosen & rare and not chosen & set(common)


def test_evidence_under_one_half_raises(spark):
    with pytest.raises(ValueError, match="evidence"):
        pii.disclosing_terms(_frame(spark, ["a"]), generalize_evidence=0.4)

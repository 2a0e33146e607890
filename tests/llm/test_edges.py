"""Clashing column names, very long texts, and settings of a cluster."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm import bpe, common, decontaminate, langid, licenses, neardup, pii, quality_crf, repetition, sharding, substrings
from strandframe.llm.common import utf8

CLASHES = ("ranges", "places", "bounds", "score", "n_words", "spans", "shard", "slot", "id", "node", "component", "text_", "packed", "lead", "items", "kept", "lang_pred", "fit", "token_ids")


def _clashing(spark):
    rows = [(1, "some words of a text that is like no other"), (2, None), (3, "mail a@b.co now"), (3, "mail a@b.co now")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASHES})


def _operators(spark):
    ranks = {bytes([i]): i for i in range(256)}
    model = langid.train_language_model(spark.createDataFrame([("abc abd", "x")], "text string, lang string"))
    chain = quality_crf.LineChain(np.zeros(quality_crf.N_FEATURES), np.zeros((2, 2)), 0.0)
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    return {
        "bpe": lambda d, **k: bpe.bpe_encode(d, ranks, r"\s*\S+|\s+", **k),
        "repetition": lambda d, **k: repetition.repetition_quality(d, **k),
        "pii": lambda d, **k: pii.sanitize(d, **k),
        "licenses": lambda d, **k: licenses.recognize_licenses(d, **k),
        "decontaminate": lambda d, **k: decontaminate.find_contamination(d, items, **k),
        "quality": lambda d, **k: quality_crf.score_quality(d, chain, **k),
        "language": lambda d, **k: langid.identify_language(d, model, **k),
        "substrings": lambda d, **k: substrings.remove_repeats(d, **k),
    }


@pytest.mark.parametrize("name", ["bpe", "repetition", "pii", "licenses", "decontaminate", "quality", "language", "substrings"])
def test_extra_columns_pass_or_raise(spark, name):
    run, df = _operators(spark)[name], _clashing(spark)
    plain = run(df)
    assert plain.count() == 4
    outputs = [c for c in plain.columns if c != "doc_id"]
    free = tuple(c for c in CLASHES if c not in outputs)
    both = run(df, keep=("doc_id", *free))
    assert both.columns == ["doc_id", *free, *outputs] and all(r[c] == 7 for r in both.collect() for c in free)
    with pytest.raises(ValueError, match="clash"):
        run(df, keep=("doc_id", outputs[0]))
    with pytest.raises(ValueError, match="clash"):
        run(df, keep=("doc_id", "doc_id"))


def test_extra_columns_of_the_other_operators(spark):
    df = _clashing(spark)
    shuffled = sharding.hypergeometric_shuffle(df, 3)
    assert shuffled.columns == [c for c in df.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert shuffled.count() == 4 and all(r["bounds"] == 7 for r in shuffled.collect())
    assert neardup.near_duplicates(df).count() == 4


def test_hundred_thousand_addresses_and_a_million_lines():
    began = time.time()
    text = " ".join(f"user{i}@mail{i % 7}.example met someone" for i in range(100_000))
    assert len(pii._apply(text, {"someone": 5})) == 200_000
    starts, ends = pii._joined(pii.base_spans(text))
    for span in pii.base_spans(text):
        pii._surroundings(text, span, starts, ends, 80)
    lines = "\n".join(f"line {i} of the text that goes on" for i in range(1_000_000))
    chain = quality_crf.LineChain(np.zeros(quality_crf.N_FEATURES), np.zeros((2, 2)), 0.0)
    assert quality_crf.score_documents(*utf8(pa.array([lines])), chain)[0] == pytest.approx(0.5)
    assert time.time() - began < 120


def test_sixty_four_megabytes_of_text():
    data = np.frombuffer((b"many words of one very long text, number 12345 of them " * 1_250_000)[: 64 << 20], np.uint8)
    offsets = np.array([0, len(data)])
    m = repetition.measure(data, offsets, (5, 8, 12), 8)
    assert m["n_words"][0] >= m["n_repeat_words"][0] >= m["n_words"][0] - 1 > 10_000_000  # the last word is cut
    values, _ = neardup.shingle_sets(data, offsets, 2)
    assert len(values) in (10, 11, 12)


def test_spans_longer_than_a_piece_hash_alike(monkeypatch):
    data = np.frombuffer(b"x" * 50 + b" " + b"x" * 50 + b" yy yy", np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    for size in (1 << 20, 20, 3):
        monkeypatch.setattr(common, "STEP_BYTES", size)
        h = common.span_hashes(data, starts, ends)
        assert h[0] == h[1] != h[2] == h[3]
        assert common.span_counts(data, starts, ends, common.BEGINS).tolist() == [50, 50, 2, 2]


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.ensure_checkpoint_dir(Session())


def test_files_of_past_stages_go(spark, tmp_path):
    before = set(_stages(spark))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [x.rsplit("-", 1)[1] for x in set(_stages(spark)) - before] == ["tokens"]


def _stages(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(common.ensure_checkpoint_dir(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(x.getPath()) for x in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "corpus-*/*-*"))]


def test_a_long_text_has_the_same_anchors_in_pieces(monkeypatch):
    r = np.random.Generator(np.random.PCG64(8))
    for letters in (2, 20):
        data = r.integers(97, 97 + letters, 5000, dtype=np.uint8)
        whole = substrings._anchors(data, np.array([0, 5000]), 100, 32, 64)
        for step in (70, 333, 1024):
            monkeypatch.setattr(substrings, "STEP_BYTES", step)
            pieces = substrings.anchors(data, np.array([0, 5000]), 100, 32)
            assert all((pieces[c] == whole[c]).all() and len(pieces[c]) == len(whole[c]) for c in whole)


def test_sixty_four_megabytes_have_anchors():
    data = np.random.Generator(np.random.PCG64(1)).integers(97, 123, 64 << 20, dtype=np.uint8)
    found = substrings.anchors(data, np.array([0, len(data)]), 100, 32)
    assert 1_200_000 < len(found["at"]) < 2_500_000 and (found["before"] + found["after"] >= 100).all()

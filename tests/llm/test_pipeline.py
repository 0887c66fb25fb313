import corpus_pipeline
import pytest
from quadrel.llm.jaccard import join_similar
from quadrel.llm.pii import base_spans
from quadrel.llm.quality import score_quality, train_quality
from quadrel.llm.toxicity import score_toxicity, train_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    base = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        kept = spark.read.parquet(f"{base}/{name}")
        out.append((name, docs, kept))
        docs = kept
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_decide_as_their_operators(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    _, docs, kept = stages[0]
    assert kept.columns == docs.columns
    assert ids(kept) == ids(score_quality(docs, train_quality(docs, labels)).where("predicted = 1"))
    _, docs, kept = stages[1]
    assert ids(kept) == ids(score_toxicity(docs, train_toxicity(docs, labels)).where("predicted = 0"))
    _, docs, kept = stages[2]
    groups = {r.doc_id: r.class_id for r in join_similar(docs).collect()}
    assert ids(kept) == sorted(set(groups.values()))
    _, docs, kept = stages[3]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert ids(kept) == sorted(texts) and kept.columns == docs.columns
    for r in kept.collect():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        assert base_spans(texts[r.doc_id]) or r.text == texts[r.doc_id] or "[" in r.text
    _, docs, kept = stages[4]
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(ids(docs))


def test_run_gives_the_last_stage(spark, stages):
    _, _, last = stages[-1]
    got = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, last.select(key).collect()))


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (None, "a text of some words here", "en", "s", 5), (2, "same text twice over here", "en", "s", 5), (2, "same text twice over here", "en", "s", 5), (3, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert name == "best_fit_packing" or out.columns == docs.columns
            count = out.count()
            assert count == 0 if frame is not docs else count >= 0
    assert corpus_pipeline.keep_one_of_each_group(spark, docs, SF).count() == 3


def test_rows_of_one_id_leave_the_least(spark):
    story = " ".join(f"word{i}" for i in range(40))
    rows = [(1, story, "en", "b", 5), (1, story, "en", "a", 5), (1, "another text of the same id", None, "a", 5), (2, story + " more", "en", "a", 5), (3, "alone", "en", "a", 1), (None, story, "en", "a", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        got = sorted(map(tuple, corpus_pipeline.keep_one_of_each_group(spark, frame.repartition(parts), SF).collect()), key=repr)
        assert got == sorted([(1, "another text of the same id", None, "a", 5), (3, "alone", "en", "a", 1), (None, story, "en", "a", 5)], key=repr)

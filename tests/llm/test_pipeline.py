from collections import defaultdict

import corpus_pipeline
from corpusframe.llm import compression_quality, jaccard_join, packing, toxic_crf
from corpusframe.llm.common import table

from .conftest import ODD
from .test_copies import brute


def test_stages_against_their_scores(spark, sf):
    """Each stage by itself against a plain version over what the one before kept."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    assert [f for _, f in corpus_pipeline.STAGES][-1] is corpus_pipeline.packed and len(corpus_pipeline.STAGES) == 5
    cols = docs.columns

    one = corpus_pipeline.toxicity(spark, docs, sf).cache()
    assert one.columns == cols
    bad = {r["doc_id"] for r in toxic_crf.toxicity(docs, labels, ~toxic_crf.held_out()).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in docs.collect()} - bad

    two = corpus_pipeline.quality(spark, one, sf).cache()
    bad = {r["doc_id"] for r in compression_quality.quality_scores(one, labels, ~compression_quality.held_out()).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in two.collect()} == {r["doc_id"] for r in one.collect()} - bad

    three = corpus_pipeline.exact_copies(spark, two, sf).cache()
    by = defaultdict(list)
    for r in two.collect():
        by[r["text"]].append(r["doc_id"])
    assert {r["doc_id"] for r in three.collect()} == {max(v) for v in by.values()} and three.columns == cols

    four = corpus_pipeline.near_copies(spark, three, sf).cache()
    want = brute([(r["doc_id"], r["text"]) for r in three.collect()])
    assert {r["doc_id"] for r in four.collect()} == {c for _, c in want.values()} and four.columns == cols

    five = corpus_pipeline.packed(spark, four, sf)
    assert {r["doc_id"] for r in five.collect()} == {r["doc_id"] for r in four.collect()}
    whole = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, five.select(key).collect()))


def test_stages_take_odd_rows(spark, sf, odd_docs, no_docs):
    for docs, n in ((odd_docs, len(ODD) + 2), (no_docs, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            if stage is not corpus_pipeline.packed:
                assert out.columns == docs.columns and len(rows) <= n
                assert all(r in set(docs.collect()) for r in rows), name
            else:
                assert len(rows) >= n
    assert jaccard_join.FEW and packing.SEQ_LEN == 2048

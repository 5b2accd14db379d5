"""Each stage on its own input, against the rules of its operator."""

import collections

import corpus_pipeline
from filinglens.llm import surrogates, toxicity
from filinglens.llm.common import documents, labels
from test_dedup import brute_near

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert out.count() <= docs.count() and (docs is not none or out.count() == 0)
        assert corpus_pipeline.packed(spark, docs, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stage_by_stage(spark):
    docs = documents(spark, SF)
    score = toxicity.fitted_scorer(docs, labels(spark, SF))
    clean = corpus_pipeline.toxic_out(spark, docs, SF).cache()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in docs.filter(score("text") < 0.7).collect())
    once = corpus_pipeline.copies_out(spark, clean, SF).cache()
    last = {}
    for r in clean.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    assert sorted(r.doc_id for r in once.collect()) == sorted(last.values())
    apart = corpus_pipeline.near_copies_out(spark, once, SF).cache()
    want = sorted(int(i) for i, _, _, kept in brute_near([(r.doc_id, r.text) for r in once.collect()]) if kept)
    assert sorted(r.doc_id for r in apart.collect()) == want
    private = corpus_pipeline.private_data_replaced(spark, apart, SF).cache()
    worker = surrogates.Surrogates()
    assert {r.doc_id: r.text for r in private.collect()} == {r.doc_id: worker.replace(r.text)[0] for r in apart.collect()}
    assert all(r.n_chars == len(r.text) for r in private.collect())
    pieces = corpus_pipeline.packed(spark, private, SF).collect()
    assert {r.doc_id for r in pieces} == set(want)
    used = collections.Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces)

"""The pipeline's stages, each on what the one before kept, held against plain versions."""

import os

import pytest

import corpus_pipeline
from quillmill.llm import decontaminate, jaccard_join, language_id, queries
from quillmill.llm.pieces import Codec

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are elsewhere")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name != "pieces":
            assert out.columns == columns
        if name == "language":
            kept = {r.doc_id for r in language_id.identify(before, language_id.fit(before)).where("accepted").collect()}
            assert {r.doc_id for r in out.collect()} == kept and len(kept) == before.count()
        elif name == "near_duplicates":
            want = {r.doc_id for r in jaccard_join.jaccard_components(before).where("doc_id = component_id").collect()}
            assert {r.doc_id for r in out.collect()} == want
        elif name == "benchmark":
            assert decontaminate.contamination(out, spark.read.parquet(f"{SMALL}/benchmark.parquet")).where("contaminated").count() == 0
        elif name == "pieces":
            codec = Codec.of(queries.vocabulary("piece_bpe_32k.model"))
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in out.collect():
                assert r.ids == codec.sp.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        before = out
    assert corpus_pipeline.run(spark, SMALL).count() == before.count()


def test_odd_rows(spark):
    d = spark.createDataFrame([(None, "some words here", None, None, None), (1, None, None, None, None), (2, "some words here", None, None, 3), (2, "some words here", None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_near_duplicates(spark, d, SMALL).count() == 3
    two = spark.createDataFrame([(7, "a text of some five words", None, "s", 1), (7, "another one of five words", None, "s", 1), (7, "another one of five words", None, "s", 1), (8, "another one of five words", None, "s", 1)], d.schema)
    assert sorted((r.doc_id, r.text[:2]) for r in corpus_pipeline.drop_near_duplicates(spark, two, SMALL).collect()) == [(7, "a "), (7, "an")]
    assert corpus_pipeline.drop_near_duplicates(spark, d.where("false"), SMALL).count() == 0
    assert corpus_pipeline.hide_personal_data(spark, d, SMALL).count() == 4
    assert corpus_pipeline.encode_pieces(spark, d, SMALL).count() == 4
    assert corpus_pipeline.identify_language(spark, d, SMALL).count() == 0

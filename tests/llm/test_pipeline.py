"""The pipeline's stages on a small table: each decision takes effect, and clean documents stay."""

import os

import pytest

import corpus_pipeline
from storyloom.llm.queries import table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    from storyloom.llm import blocks, decontamination, line_dedup, quality_rules, simhash

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "packing"]
    docs = table(spark, DATA, "documents")
    kept = quality_rules.verdicts(docs, table(spark, DATA, "labels")).filter("kept").select("doc_id")
    want = docs.join(kept, "doc_id", "left_semi")
    first = corpus_pipeline.quality(spark, docs, DATA)
    assert first.columns == docs.columns and sorted(first.collect()) == sorted(want.select(docs.columns).collect())
    docs = blocks.stored(first, "t1")
    second = blocks.stored(corpus_pipeline.lines(spark, docs, DATA), "t2")
    texts = {r.doc_id: r.kept_text for r in line_dedup.shared_lines(docs.select("doc_id", "text")).collect()}
    assert second.columns == docs.columns and {r.doc_id: r.text for r in second.collect()} == texts
    third = blocks.stored(corpus_pipeline.near_duplicates(spark, second, DATA), "t3")
    assert {r.doc_id for r in third.collect()} == {r.component_id for r in simhash.near_duplicates(second, words=5, most=6).collect()}
    fourth = blocks.stored(corpus_pipeline.decontaminate(spark, third, DATA), "t4")
    bad = {r.row.doc_id for r in decontamination.contamination(third, table(spark, DATA, "benchmark")).filter("contaminated").collect()}
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in third.collect()} - bad
    last = corpus_pipeline.pack(spark, fourth, DATA)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in fourth.collect()}

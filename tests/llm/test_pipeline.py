"""The pipeline's stages against what their decisions should be, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from wayfinder.llm import mixing, near_dedup, pii, quality_crf

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = before, docs
    before, after = kept["quality classifier"]
    scores = {r.doc_id: r.score for r in quality_crf.quality(before, quality_crf.train(spark, SF)).collect()}
    assert {r.doc_id for r in after.collect()} == {i for i, s in scores.items() if s >= 0.5}
    before, after = kept["near-duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in near_dedup.near_duplicates(before).collect()})
    before, after = kept["personal data"]
    assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: r.text for r in pii.redacted(before).collect()}
    before, after = kept["mixing"]
    taken = {r.doc_id: r.taken for r in mixing.mixed(before).collect() if r.taken}
    words = Counter()
    for r in after.collect():
        words[r.doc_id] += len(r.text.split())
    assert set(words) == set(taken)
    _, packed = kept["packing"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(tuple, packed.drop("sequence_id", "offset").collect()))


def test_stages_on_odd_tables(spark):
    """Nulls, repeats, an empty table and columns that are named as the operators' own."""
    extra = ["score", "root", "key", "size", "src", "rep", "found", "part", "words", "place", "sign", "row", "h1"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    text = "The first line of a text is here and it ends.\nMail me at a@b.com for the rest of it, or don't."
    rows = [(1, text), (1, text), (2, text + " More."), (None, text), (3, None), (4, ""), (5, "x " * 40), (6, "One more of the texts that says something else in its only line.")]
    full = [(i, t, None, None if i == 6 else "s", None, *["z"] * len(extra)) for i, t in rows]
    for table in (spark.createDataFrame(full, schema), spark.createDataFrame([], schema)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, SF)
            got = out.collect()
            assert (out.columns == table.columns) if k < 4 else ("sequence_id" in out.columns)
            assert bool(got) == bool(table.count())
            if k == 1 and got:
                assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 3, 4, 5, 6] and sum(r.doc_id is None for r in got) == 1
            if k == 2 and got:
                assert all("<email>" in r.text for r in got if r.text and "Mail me" in r.text)

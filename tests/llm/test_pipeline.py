import pandas as pd

import corpus_pipeline
from tabsynth.llm.jaccard import jaccard_components
from tabsynth.llm.linededup import ENDS
from tests.llm.test_jaccard import brute as components
from tests.llm.test_linededup import brute as lines


def test_stages_at_the_smallest_scale(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    kept = corpus_pipeline.quality_rules(spark, docs, sf).cache()
    bad = labels[(labels.quality == 0)].doc_id
    good = labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    long = {r.doc_id for r in docs.where("size(split(text, ' ')) >= 30").collect()}
    assert len(set(good) & long - ids) <= 0.02 * len(good) and len(set(bad) & ids) <= 0.3 * len(bad)
    rows = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    want = components(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(kept).collect()), key=str) == want
    one = corpus_pipeline.near_duplicates(spark, kept, sf).cache()
    assert {r.doc_id for r in one.collect()} == {c for _, _, c in want}
    cleaned = corpus_pipeline.repeated_passages(spark, one, sf).cache()
    left = {d: x for (d, _), x in lines([(r.doc_id, r.text) for r in one.collect()], ENDS["clause"], 8).items() if x and x.split()}
    assert {r.doc_id: r.text for r in cleaned.collect()} == left
    assert cleaned.columns == corpus_pipeline.COLUMNS
    packed = pd.DataFrame([r.asDict() for r in corpus_pipeline.packing(spark, cleaned, sf).collect()])
    assert set(packed.doc_id) == set(left)
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0

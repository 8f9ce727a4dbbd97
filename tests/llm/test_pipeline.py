import importlib.util

import __spark_entry__
import corpus_pipeline
from pixelframe.llm import decontamination, language_crf, queries, sentence_spans
from test_near_copies import brute_force

SF = "/root/testdata/sf0.001"


def test_stages_follow_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    model = language_crf.fit(docs, language_crf.F.lit(True))
    known = {r.doc_id for r in language_crf.label(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.3}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["known_language"](spark, docs, SF)
    assert one.columns == names and {r.doc_id for r in one.collect()} == known
    unique = brute_force([(i, t) for i, t in kept.items() if i in known])
    two = stages["one_of_each"](spark, one, SF)
    assert two.columns == names and {r.doc_id for r in two.collect()} == unique
    left = {r.doc_id: r for r in sentence_spans.remove_repeats(two, context=True).collect()}
    three = stages["no_repeated_passages"](spark, two, SF)
    got = {r.doc_id: r for r in three.collect()}
    assert three.columns == names and three.schema == docs.schema
    assert {i: r.text for i, r in got.items()} == {i: r.text for i, r in left.items() if r.text or not r.n_removed}
    assert all(r.n_chars == (len(r.text) if left[i].n_removed else r.n_chars) for i, r in got.items())
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = {r.doc_id for r in decontamination.contamination(three, items).where("n_hit = 0").collect()}
    four = stages["no_benchmark"](spark, three, SF)
    assert four.columns == names and {r.doc_id for r in four.collect()} == clean < set(kept)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == clean


def test_everything_is_registered():
    found = __spark_entry__.queries()
    assert [n for n in queries.QUERIES if n in found] == list(queries.QUERIES) and "pipeline" in found
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert importlib.util.find_spec("pixelframe.llm")

import numpy as np
from pyspark.sql import functions as F

from pixelframe.llm import language_crf as lc
from pixelframe.llm.queries import op6_language

SF = "/root/testdata/sf0.01"


def test_forward_backward_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    lengths, moves = np.array([4, 3, 1]), rng.random((3, 3))
    chances = rng.random((4, 3, 3))
    pairs = np.zeros((3, 3))
    got = lc.forward_backward(chances, moves, lengths, pairs)
    total_pairs = np.zeros((3, 3))
    for s, n in enumerate(lengths):
        marginal, mass, both = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            p = np.prod([chances[t, s, y] for t, y in enumerate(path)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:])])
            mass += p
            for t, y in enumerate(path):
                marginal[t, y] += p
            for a, b in zip(path, path[1:]):
                both[a, b] += p
        assert np.allclose(got[:n, s], marginal / mass)
        total_pairs += both / mass
    assert np.allclose(pairs, total_pairs)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = op6_language(spark, SF).join(docs, "doc_id")
    held = out.where("held_out")
    assert out.count() == docs.count() and 150 < held.count() < 350
    assert held.where("lang_pred = lang").count() >= 0.98 * held.count()
    assert out.where("score < 0 OR score > 1 OR lang_pred NOT IN ('de', 'en', 'es', 'fr', 'und')").count() == 0


def test_switched_text_edge_rows_and_unknown_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lc.fit(docs, F.lit(True), texts_per_language=100)
    assert model.langs == ["de", "en", "es", "fr"] and (np.diag(model.moves) > model.moves.mean(axis=1)).all()
    pure = lc.label(docs, model).where("score > 0.99 AND n_words > 200").join(docs, "doc_id")
    long = {lang: lc.words_of(pure.where(f"lang_pred = '{lang}'").first().text) for lang in ("en", "de")}
    mixed = " ".join(long["en"][:60] + long["de"][:60])
    rows = [(1, mixed), (2, None), (3, ""), (4, "123 !!"), (None, mixed), (5, "x"), (5, "x"), (6, mixed * 200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("").alias("score"), F.lit(1).alias("lang_pred"))
    out = lc.label(df, model).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (2, 3, 4))
    assert abs(got[1].shares["en"] - 0.5) < 0.1 and abs(got[1].shares["de"] - 0.5) < 0.1
    assert sum(s.n_words for s in got[1].spans) == got[1].n_words and len(got[1].spans) < 20
    kept = lc.keep_known(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 5, 6]
    nothing = lc.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in lc.label(df, nothing).collect()} == {"und"} and lc.keep_known(df, nothing).count() == 0
    assert lc.label(df.limit(0), model).count() == 0


def test_columns_that_clash(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("*", F.lit(1).alias("TEXT"), F.lit(2).alias("Lang"))
    model = lc.fit(docs, F.lit(True))
    assert model.langs and lc.keep_known(docs, model).columns == docs.columns


def test_least_hashes_of_a_language(spark):
    rng = np.random.default_rng(2)
    rows = [("a", int(h)) for h in rng.integers(0, 1 << 63, 5000)] + [("b", 5), ("b", 1 << 62), ("b", 1 << 61)]
    left = lc._least(spark.createDataFrame(rows, "lang string, h bigint"), 40).collect()
    least = sorted(h for lang, h in rows if lang == "a")[:40]
    assert set(least) <= {r.h for r in left if r.lang == "a"} and len(left) < 60
    assert sum(r.lang == "b" for r in left) == 3

from pixelframe.durable import shared_folder
from pixelframe.llm import near_copies, simhash

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_linked_fingerprints_are_proposed(spark):
    rows = [(1, 0b1111), (2, 0b0), (3, 0b0), (4, 0b11111), (5, -1)]
    got = near_copies.proposed(spark.createDataFrame(rows, "node long, fp long")).collect()
    assert {tuple(sorted(r)) for r in got} == {(1, 2), (2, 3), (1, 4)}


def test_fingerprints_decide_which_texts_are_compared(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "alive", lambda nodes: nodes.select("node").limit(0))
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, "other words")], "doc_id long, text string")
    bits = [r.fp for r in docs.select(simhash.fingerprint()(docs.text).alias("fp")).collect()]
    assert bin(bits[0] ^ bits[1]).count("1") <= 4
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == {1, 3}


def test_stages_leave_no_tables_of_their_own(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/pixelframe")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def tables():
        return {str(f.getPath()) for f in files.listStatus(folder)} if files.exists(folder) else set()

    before = tables()
    corpus_pipeline.run(spark, SF)
    assert tables() <= before

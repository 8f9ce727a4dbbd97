import __spark_entry__
import pyarrow as pa

from pixelframe.llm.sentence_spans import remove_repeats, sentences

TAIL = "with empty hands and torn coats and not one word to each other along the narrow path that leads from the upper village down to the old stone bridge."
WHOLE = "Nobody in the valley could remember a winter as long and as bitter as that one."
HEAD = "People burned their chairs and then their doors and at last even the carved beams and the long benches under the windows of"


def rows(whole):
    return [
        (1, f"First came a man with two goats {TAIL} {whole} {HEAD} the church itself. He said so."),
        (2, f"Yesterday some children ran {TAIL} {whole} {HEAD} houses nobody owned. It rained."),
        (3, f"A quiet text of its own with no more than the start: {HEAD} something else. It ends."),
    ]


def left(spark, given, **more):
    df = spark.createDataFrame(given, "doc_id bigint, text string")
    return {r.doc_id: r.text for r in remove_repeats(df, **more).collect()}


def test_one_whole_sentence_between_cut_ones_goes(spark):
    for whole in (WHOLE, "Nobody spoke.", "Nobody in the valley could remember it."):
        given = rows(whole)
        got = left(spark, given, context=True)
        assert got[1] == given[0][1] and got[3] == given[2][1]
        assert whole not in got[2]


def test_short_shared_sentences_stay(spark):
    given = [(i, f"Text {i} starts in way {i}. {WHOLE} Then it goes on in way {i}.") for i in range(3)]
    assert left(spark, given, context=True) == dict(given)


def test_the_query_uses_context(spark, tmp_path):
    spark.createDataFrame(rows(WHOLE), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["op9_sentence_spans"](spark, str(tmp_path))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 1, 3: 0}


def test_unspaced_scripts_reach_the_limit(spark):
    one = "村里的老人都说那年冬天比往年更长更冷而且河水一直到四月才慢慢化开。"
    two = "孩子们每天早上都要走很远的路去学校可是没有一个人抱怨过什么。"
    got = left(spark, [(1, f"{one}{two}"), (2, f"今天下雨。{one}{two}"), (3, "今天下雨。明天晴。")])
    assert got[2] == "今天下雨。" and got[3] == "今天下雨。明天晴。"
    assert sentences(pa.array(["one two. Three", one])).sizes().tolist() == [2, 1, (len(one) - 1 + 1) // 2]

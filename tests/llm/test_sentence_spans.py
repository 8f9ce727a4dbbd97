import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.llm import sentence_spans
from pixelframe.llm.sentence_spans import remove_repeats, runs, sentences
from pixelframe.llm.workers import map_slices

GAP = re.compile(r"(?<=[.!?;:…])[ \t\n\r\x0b\x0c]+|[ \t\r\x0b\x0c]*\n[ \t\n\r\x0b\x0c]*|[ \t\r\x0b\x0c]+(?=\w)|(?<=[。！？])(?=\S)")

PASSAGE = (
    "Seven grey herons stood in the shallow water near the broken mill. None of them moved for a very long "
    "time. When the miller came back with his lantern, they rose together and flew away over the dark fields. "
    "He counted them twice, shook his head, and went in to bar the heavy door against the cold night."
)


def sentence_bounds(text):
    """Start and end of each sentence, by a scan of the characters."""
    space, bounds = " \t\n\r\x0b\x0c", []
    start = len(text) - len(text.lstrip(space))
    for gap in GAP.finditer(text, start):
        after = text[gap.end() : gap.end() + 1]
        cut = "\n" in gap[0] or text[gap.start() - 1] in ".!?;:…。！？" or after.isupper() and len(after.lower()) == 1
        if cut and gap.start() > start:
            bounds.append((start, gap.start()))
            start = gap.end()
    end = len(text.rstrip(space))
    return [*bounds, (start, end)] if end > start else bounds


def brute_force(rows, min_words=20, min_sentences=2, long_sentence=50):
    """All runs of all texts, compared as word tuples."""
    first, cut = {}, {}
    for i, text in rows:
        words = [text[a:b].split() for a, b in sentence_bounds(text or "")]
        sizes = list(map(len, words))
        own = set()
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                enough = sum(sizes[a:b]) >= min_words and b - a >= min_sentences
                shorter = [(x, y) for x, y in ((a + 1, b), (a, b - 1))]
                still = [sum(sizes[x:y]) >= min_words and y - x >= min_sentences for x, y in shorter]
                if enough and not all(still) or b - a == 1 and sizes[a] >= long_sentence:
                    own.add((a, b))
        cut[i] = [(a, b, tuple(w for s in words[a:b] for w in s)) for a, b in own]
        for a, _, run in cut[i]:
            first[run] = min(first.get(run, (i, a)), (i, a))
    return {i: {k for a, b, run in own if first[run] != (i, a) for k in range(a, b)} for i, own in cut.items()}


def collect(spark, rows, schema="doc_id bigint, text string", **more):
    return {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, schema), **more).collect()}


def test_passage_goes_everywhere_but_once(spark):
    rows = [
        (3, f"It began like any other day. {PASSAGE} Then came spring."),
        (5, f"some words with no stop at all {PASSAGE} and it went on in the same way."),
        (9, "Nothing is shared here. It is short. It is clean."),
        (11, f"{PASSAGE}\n{PASSAGE}"),
    ]
    got = collect(spark, rows)
    assert got[3].text == rows[0][1] and got[9].text == rows[2][1]
    assert got[5].text == "some words with no stop at all and it went on in the same way."
    assert got[11].text == "" and got[11].n_removed == got[11].n_sentences


def test_edge_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \n\t ", 7), (None, PASSAGE, 7), (4, PASSAGE, 7), (4, PASSAGE, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_removed int").select("*", F.lit("x").alias("Text"))
    out = remove_repeats(df).collect()
    assert len(out) == 6
    assert {(r.doc_id, r.text) for r in out} == {(1, None), (2, ""), (3, " \n\t "), (None, PASSAGE), (4, "")}
    assert remove_repeats(df.limit(0)).collect() == []


def test_long_sentence_is_a_run(spark):
    long = " ".join(f"w{i}" for i in range(60))
    got = collect(spark, [(1, long), (2, long), (3, "one two. three four.")])
    assert got[1].text == long and got[2].text == "" and got[3].n_removed == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_force(rows)
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {i: len(k) for i, k in want.items()}
    assert any(want.values())
    assert all(got[i].text == text for i, text in rows if not want[i])


def test_runs_cover_every_sentence_of_long_passages():
    sizes = np.array([3, 1, 9, 2, 2, 14, 1, 1, 1, 30])
    covered = {k for a, b in runs(sizes, np.array([0, 10]), 20, 2, 50) for k in range(a, b)}
    assert covered == set(range(10))


def test_sentences_of_odd_texts():
    texts = ["", " ", "One two. Three", "a\nb", "x Ärger y ß Éa", "終わり。始まり！ 次", "wait… so", "A.b C:d", "\n\n x\n", "𝐀 𝐁 no"]
    found = sentences(pa.array([None, *texts]))
    for i, text in enumerate(texts, 1):
        firsts = found.first[found.rows[i] : found.rows[i + 1] + 1].tolist()
        got = [found.data[found.starts[a] : found.ends[b - 1]].tobytes().decode() for a, b in zip(firsts, firsts[1:])]
        assert got == [text[a:b] for a, b in sentence_bounds(text)], text


def test_texts_that_stay_do_not_move(spark, monkeypatch):
    stored = []

    def recorded(df):
        stored.append(df.columns)
        return durable(df)

    monkeypatch.setattr(sentence_spans, "durable", recorded)
    df = spark.createDataFrame([(1, f"One. {PASSAGE}"), (2, f"Two. {PASSAGE}"), (3, "A text of its own.")], "doc_id bigint, text string")
    plan = remove_repeats(df)._jdf.queryExecution().optimizedPlan().toString()
    assert stored[0] == ["h1"]  # runs are counted by half of their hash
    assert "Union" in plan  # only texts that may lose a sentence meet what they lose


def test_half_a_hash_decides_nothing(spark, monkeypatch):
    rows = [(1, f"One. {PASSAGE}"), (2, f"Two. {PASSAGE}"), (3, "A quiet text. " * 12), (None, PASSAGE), (3, "Other words here. " * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(str, remove_repeats(df, context=True).collect()))
    monkeypatch.setattr(sentence_spans, "map_slices", with_equal_halves)
    assert sorted(map(str, remove_repeats(df, context=True).collect())) == want


def with_equal_halves(docs, run, schema, text):
    return map_slices(docs, run, schema, text).withColumn("h1", F.lit(0).cast("bigint"))

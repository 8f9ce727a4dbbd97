import random

import public_tokenizers
from pyspark.sql import functions as F

from pixelframe.llm.piece_counts import PieceCounter, counter, pieces_of, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def greedy(word, first, later):
    """Longest match first, piece by piece."""
    n, at = 0, 0
    while at < len(word):
        pieces = later if at else first
        size = next((k for k in range(min(len(word) - at, 40), 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return None
        n, at = n + 1, at + size
    return n


def test_random_vocabularies():
    rng = random.Random(5)
    for _ in range(60):
        make = lambda: {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        first, later = make(), make()
        automaton = PieceCounter(first, later)
        for _ in range(300):
            word = "".join(rng.choices("abcd" if rng.random() < 0.1 else "abc", k=rng.randint(1, 14)))
            assert automaton.count(word) == greedy(word, first, later), (first, later, word)


def test_documents_against_greedy_matching(spark):
    first, later = pieces_of(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in token_counts(docs, PATH).collect()}
    for r in docs.collect():
        counts = [greedy(w, first, later) for w in r.text.split()]
        assert got[r.doc_id].n_tokens == sum(c or 1 for c in counts)
        assert got[r.doc_id].n_unknown == counts.count(None) and got[r.doc_id].n_words == len(counts)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "the the"), (4, "the"), (4, "the"), (5, "a" * 200_000), (6, "\U0010ffff the")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("").alias("n_tokens"))
    out = token_counts(df, PATH).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and [by[i].n_tokens for i in (1, 2, 3)] == [0, 0, 0]
    assert by[None].n_words == 2 and by[6].n_unknown == 1
    assert by[5].n_tokens == counter(PATH).count("a" * 200_000) > 1
    assert token_counts(df.limit(0), PATH).count() == 0

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from pixelframe.llm.byte_bpe import MinimalPerfectHash, Vocabulary, decoder, encode, round_trip

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hash_is_minimal_and_perfect():
    words = [str(i).encode() for i in range(5000)]
    assert sorted(MinimalPerfectHash(words).find(words).tolist()) == list(range(5000))
    assert MinimalPerfectHash([b"a"]).find([b"b"]).tolist() == [0]


def test_random_texts_as_tiktoken():
    own, other, rng = Vocabulary(PATH, PATTERN), reference(), random.Random(1)
    pieces = ["a", "b", "  ", "\n", "\x1c", "\x85", "é", "ß", "日本", "1", "²", "'s", "!", "the", "ing", "\0", "\U0001fae8", "०"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += ["a" * 30_000, "ab" * 20_000, "\n" * 500 + "x", ""]
    for text, ids in zip(texts, own.encode(texts)):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == other.encode_ordinary(text)
        assert b"".join(own.decode(ids)) == text.encode()


def test_memo_starts_afresh_when_full():
    small = Vocabulary(PATH, PATTERN, memo_entries=20)
    texts = [f"qx{i} zy{i * i}" for i in range(200)]
    assert [small.encode([t])[0] for t in texts] == Vocabulary(PATH, PATTERN).encode(texts)


def test_documents_and_edge_rows(spark):
    other = reference()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(-1, None), (-2, ""), (None, "x"), (-3, "twice"), (-3, "twice"), (-4, "long " * 60_000)]
    more = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.select("doc_id", "text").unionByName(more).select("*", F.lit("").alias("ids"))
    out = round_trip(docs, PATH, PATTERN).collect()
    got = {r.doc_id: r for r in out}
    for r in docs.collect():
        ids = other.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert len(out) == docs.count() and round_trip(docs.limit(0), PATH, PATTERN).count() == 0
    back = encode(docs, PATH, PATTERN).select("doc_id", decoder(PATH, PATTERN)(F.col("ids")).cast("string").alias("text"))
    assert back.exceptAll(docs.select("doc_id", F.coalesce("text", F.lit("")))).count() == 0

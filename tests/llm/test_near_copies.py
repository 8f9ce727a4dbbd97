import random
import re

import pytest

import corpus_pipeline
from pixelframe.llm.near_copies import keep_one
from pyspark.sql import functions as F


def shingle_set(text, words=5):
    own = re.sub("[\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff]", r" \g<0> ", text or "").encode().lower().split()
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def brute_force(rows, similarity=0.8):
    """Ids that stay: the smallest of each group closed over similar pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)):
                both = len(a & b)
                if both >= similarity * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return set(least.values())


def edited(rng, words, places):
    own = list(words)
    for k in rng.sample(range(len(own)), places):
        own[k] = f"new{rng.random()}"
    return " ".join(own)


def test_documents_and_edits_against_brute_force(spark):
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for g in range(40):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(300)]
        rows += [(10_000 + 10 * g + k, edited(rng, words, k)) for k in (0, 2, 5, 9, 14)]
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "One two"), (20_004, "one  TWO")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit(1).alias("node"))
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == brute_force(rows)
    assert keep_one(df.limit(0)).count() == 0


def test_large_buckets(spark):
    """Many texts around one common part: near copies among them meet although no bucket is small."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(150)]
    rows = []
    for g in range(150):
        own = common + [f"g{g}x{i}" for i in range(50)]
        rows += [(2 * g, " ".join(own)), (2 * g + 1, " ".join(own[:-1] + ["end"]))]
    rows += [(1000 + i, edited(rng, common * 2, 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in keep_one(df).collect()} == brute_force(rows)


def planted(rng, pairs, shared, pair, own):
    """Texts around one shared part, in pairs that share some more words, as ``(rows, pairs of ids)``."""
    common = [f"c{i}" for i in range(shared)]
    rows = []
    for g in range(pairs):
        both = [f"p{g}x{i}" for i in range(pair)]
        for k in (0, 1):
            rows.append((2 * g + k, " ".join(common + both + [f"o{g}k{k}x{i}" for i in range(own)])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shared, pair, own, pairs", [(300, 35, 15, 1000), (300, 20, 25, 1000), (300, 12, 30, 1000), (300, 12, 30, 5000)])
def test_template_with_pairs_of_near_copies(spark, shared, pair, own, pairs):
    """All pairs are found, however many texts share the template; texts of different pairs are not similar."""
    rows = planted(random.Random(6), pairs, shared, pair, own)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    assert {r.doc_id for r in keep_one(df).collect()} == {2 * g for g in range(pairs)}


def test_groups_that_share_a_template_with_others(spark):
    """Large groups of near copies and single texts that meet in the same shingles."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for g in range(6):
        base = common + [f"g{g}x{i}" for i in range(20 + 6 * g)]
        rows += [(100 * g + k, edited(rng, base, rng.randint(0, 3))) for k in range(60)]
    rows += [(1000 + k, " ".join(common + [f"s{k}x{i}" for i in range(rng.randint(10, 40))])) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in keep_one(df).collect()} == brute_force(rows)


def test_scripts_without_spaces(spark):
    rng = random.Random(3)
    rows = []
    for g in range(20):
        letters = [chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(200)]
        rows.append((2 * g, "".join(letters)))
        for k in rng.sample(range(200), 3):
            letters[k] = "ก"
        rows.append((2 * g + 1, "".join(letters)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in keep_one(df).collect()} == brute_force(rows) == {2 * g for g in range(20)}


def test_stage_takes_near_copies_of_many_bits(spark):
    """Documents 1 and 177 have Jaccard 0.83 and fingerprints that differ in nine bits."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id in (1, 177)")
    stage = dict(corpus_pipeline.STAGES)["one_of_each"]
    assert [r.doc_id for r in stage(spark, docs, "").collect()] == [1]

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelframe.llm.components import components
from pixelframe.llm.simhash import keep_one, links, near_duplicates


def fingerprint(text):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def brute_force(rows):
    prints = [fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1) if (prints[i] ^ prints[j]).bit_count() <= 4]
    of = roots(pairs)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[of[i]] = min(least.get(of[i], doc), doc)
    return [(doc, f"{prints[i]:016x}", least.get(of[i])) for i, (doc, _) in enumerate(rows)]


def test_links_for_all_block_numbers(spark):
    rng = random.Random(6)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                v ^= 1 << b
            values.add(v)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    for blocks in (5, 6, 7):
        got = [tuple(r) for r in links(nodes, 4, blocks).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        links(nodes, 4, 4)


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    want = {k: v for k, v in roots(pairs).items()}
    assert all(got.get(k, k) == v for k, v in want.items()) and set(got) <= set(want)


def test_documents_and_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    text = " ".join(f"word{i}" for i in range(300))
    rows += [(901, text), (900, text.upper()), (902, text.replace("word7 ", "other ")), (None, text)]
    rows += [(903, None), (904, ""), (904, ""), (905, "one two"), (906, "ONE  two"), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit(1).alias("fp"), F.lit(2).alias("row"))
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    want = sorted(brute_force(rows), key=str)
    assert got == want
    kept = keep_one(df)
    groups = {(c, i) if c is None else c for i, _, c in want}
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0

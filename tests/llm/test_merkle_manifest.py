import hashlib
import random
import zlib

from pyspark.sql import functions as F

from pixelframe.llm import merkle_manifest as mm

SCHEMA = "doc_id bigint, source string, n int, text string"


def h(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode('utf-8'))}:{value}"


def climb(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def siblings(levels, place):
    out = []
    for level in levels[:-1]:
        start = place - place % 3
        out.append(("".join(level[start:place]), "".join(level[place + 1 : start + 3])))
        place //= 3
    return out


def brute_force(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode("utf-8")))
    leaf = lambda r: h("".join(part(v) for v in (r[0], r[1], r[2], r[3])))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, climb([leaf(r) for r in own])
    top = climb([trees[s][1][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        own, levels = trees[s]
        for i, r in enumerate(own):
            way = siblings(levels, i) + siblings(top, k)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], way))
    return sorted(out, key=str)


def run(spark, rows, also=None):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", TEXT string")
    return mm.proofs(df, ["doc_id", "source", "n", "text"], "source", "doc_id", also)


def check(spark, rows):
    found = run(spark, rows).collect()
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in found), key=str)
    assert got == brute_force(rows)


def test_random_documents_with_a_hot_source(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        source = "hot" if rng.random() < 0.6 else rng.choice([None, "", "é", "z", *(f"s{k}" for k in range(95))])
        text = rng.choice([None, "", "ab\ncd", "ü" * rng.randint(0, 40)])
        rows.append((rng.choice([None, *range(900)]), source, rng.choice([None, 3]), text))
    rows += rows[:5]
    rows.append((5000, "long", 1, "word " * 200_000))
    check(spark, rows)


def test_sizes_of_trees(spark):
    for n in (1, 4, 81, 244):
        check(spark, [(i, "s", i, None) for i in range(n)])
    check(spark, [(i, f"s{i:04d}", 0, "t") for i in range(100)])


def test_empty_table(spark):
    found = run(spark, [])
    assert found.collect() == [] and found.columns == ["doc_id", "leaf", "subroot", "root", "proof"]


def test_fold_tells_tampered_leaves(spark):
    rows = [(i, f"s{i % 4}", 1, f"line\nline {i}") for i in range(200)]
    clean = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    seen = mm.digest([F.col("doc_id"), F.col("source"), F.col("n"), clean])
    found = run(spark, rows, {"seen": seen}).select("*", mm.fold(F.col("seen"), F.col("proof")).alias("f")).collect()
    assert len(found) == 200
    for r in found:
        assert (r.f == r.root) == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1)
        way = "".join(left + right for left, right in r.proof)
        folded = r.seen
        for left, right in r.proof:
            folded = h(left + folded + right)
        assert folded == r.f and len(way) % 64 == 0

import re

from pyspark.sql import functions as F

from pixelframe.llm.decontamination import contamination, drop_contaminated

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return SPLIT.findall(lowered)


def brute_force(text, items, window=10):
    own, hit, named = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        n = min(window, len(w))
        for p in range(len(w) - n + 1) if n else ():
            for q in range(len(own) - n + 1):
                if own[q : q + n] == w[p : p + n]:
                    hit.update(range(q, q + n)), named.add(str(item))
    return len(own), len(hit), sorted(named)


def compare(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit(0).alias("n_words"))
    bench = spark.createDataFrame(items, "item_id bigint, text string").select("*", F.lit("").alias("words"))
    found = contamination(docs, bench).collect()
    key = lambda x: (str(x[0]), str(x[1:]))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found), key=key)
    assert got == sorted(((i, *brute_force(t, items)) for i, t in rows), key=key)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in found)
    kept = sorted(((r.doc_id, r.text) for r in drop_contaminated(docs, bench).collect()), key=str)
    assert kept == sorted(((i, t) for i, t in rows if not brute_force(t, items)[1]), key=str)


def test_planted_windows(spark):
    base = " ".join(f"w{i}" for i in range(24))
    items = [(10, base), (2, "Only three words!"), (3, "one"), (4, None), (5, "..."), (6, base), (7, "a a a a a a a a a a a a")]
    rows = [
        (1, f"before {base.upper()} after"),
        (2, f"x {' '.join(base.split()[3:13])}, and, {' '.join(base.split()[8:19])}"),
        (3, " ".join(base.split()[:9])),
        (4, "there: only, three - words and ONE more one"),
        (5, "a " * 30 + "b"),
        (6, None),
        (7, ""),
        (None, "one"),
        (8, "one"),
        (8, "one"),
        (8, "none"),
        (9, "word " * 50_000 + base),
        (10, "Ünï ß日本 one"),
    ]
    compare(spark, rows, items)


def test_nothing_to_find(spark):
    compare(spark, [(1, "one two three"), (2, None)], [])
    compare(spark, [(1, "one two three")], [(1, None), (2, " ")])
    compare(spark, [], [(1, "one")])


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12)
    wanted = [(r.item_id, r.text) for r in items.collect()]
    short = docs.where("length(text) < 3000")
    compare(spark, [(r.doc_id, r.text) for r in short.collect()][:80], wanted)

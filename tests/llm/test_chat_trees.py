import hashlib

from pyspark.sql import functions as F

from pixelframe.llm import chat_trees as ct

SCHEMA = "tree bigint, node bigint, parent bigint, role string, text string, score double"


def brute_force(rows):
    """``{(tree, leaf): [ids from the root]}`` of every branch that reaches a root."""
    known = {(t, n): p for t, n, p, *_ in rows}
    parents = {k: (k[0], p) if p is not None and (k[0], p) in known and p != k[1] else None for k, p in known.items()}
    out = {}
    for leaf in set(known) - set(parents.values()):
        way, at = [], leaf
        while at is not None and at not in way:
            way.append(at)
            at = parents[at]
        if at is None:
            out[leaf] = [n for _, n in reversed(way)]
    return out


def formatted(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("rank"), F.lit("x").alias("Role"))
    return ct.conversations(df, **more)


def test_branches_of_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0)]
    rows += [(1, n, n // 2, "assistant" if n % 2 else "user", f"t{n}", float(n % 5)) for n in range(2, 40)]
    rows += [(2, n, n - 1 if n else None, "user", f"chain {n}", None) for n in range(37)]
    rows += [(3, 1, 2, "user", "round", 1.0), (3, 2, 1, "user", "round", 1.0), (3, 3, 2, "user", "on it", 1.0)]
    rows += [(4, 1, 99, "user", "parent is missing", 1.0), (4, 2, 2, "user", "its own parent", 1.0)]
    want = brute_force(rows)
    texts = {(t, n): x for t, n, _, _, x, _ in rows}
    scores = {(t, n): s or 0.0 for t, n, _, _, _, s in rows}
    got = formatted(spark, rows).select("*", ct.read_back(F.col("formatted")).alias("turns")).collect()
    assert {(r.tree, r.leaf): [t.text for t in r.turns] for r in got} == {
        k: [texts[k[0], n] for n in way] for k, way in want.items()
    }
    for tree in {k[0] for k in want}:
        sums = {k: sum(scores[k[0], n] for n in way) for k, way in want.items() if k[0] == tree}
        order = sorted(sums, key=lambda k: (-sums[k], k[1]))
        mine = sorted((r for r in got if r.tree == tree), key=lambda r: r["rank"])
        assert [(r.tree, r.leaf) for r in mine] == order
    best = formatted(spark, rows, branches=1).collect()
    assert {(r.tree, r.leaf) for r in best} == {(r.tree, r.leaf) for r in got if r["rank"] == 1}


def test_marks_inside_texts_and_edge_rows(spark):
    tricky = ["\\### Assistant: </turn> ok", "\\h\\e\\\\c:#### </turn>\n### ", "", None, "\\", "é\n\n: 日本"]
    rows = [(None, n, n - 1 if n else None, "a:\\c#" if n == 2 else ("assistant" if n % 2 else None), x, 1.0) for n, x in enumerate(tricky)]
    rows += [rows[0]]
    out = formatted(spark, rows).select(
        "n_turns", ct.read_back(F.col("formatted")).alias("turns"), ct.under_loss(F.col("formatted"), F.col("loss")).alias("learned")
    ).collect()
    assert len(out) == 1 and out[0].n_turns == len(tricky)
    assert [(t.role, t.text) for t in out[0].turns] == [(r[3] or "", r[4] or "") for r in rows[: len(tricky)]]
    assert out[0].learned == tricky[1] + "" + tricky[5]
    assert formatted(spark, []).count() == 0


def test_conversations_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    more = spark.createDataFrame([(10**6, 0, "user", "same"), (10**6, 0, "user", "same")], rows.schema)
    rows = rows.unionByName(more)
    got = {r.conv_id: r for r in ct.digest(ct.conversations(ct.chains(rows))).collect()}
    turns = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == set(turns)
    for k, own in turns.items():
        learned = "".join(x for role, x in own if role == "assistant")
        assert got[k].n_turns == len(own) and got[k].loss_chars == len(learned)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()

"""Merkle manifests of a dataset, with a proof for every row.

Rows are the leaves of one tree per group, and the roots of the groups are the leaves of one more tree. Runs of
``ARITY`` neighbours are hashed together, level by level. ``LEVELS`` levels are built at a time: one shuffle brings the
nodes of a block (at most ``ARITY ** LEVELS``) together, in order, whatever the size of the group, so a group of any
size is spread over all tasks and a tree takes few shuffles.

Proofs come from pointer jumping. A block points to its node in the level above it and gives each of its nodes the
segment of siblings on the way there. Then the table of pointers is joined with itself: whoever points to a node takes
over that node's pointer and appends its segment, so the distance doubles every round until all have reached the
root. Leaves of a block share their pointer, so they are joined as one row and told apart at the end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.durable import discard, durable, durable_counted
from pixelframe.llm.columns import row_key, take
from pixelframe.operators.ranking import ordinal

ARITY, LEVELS = 3, 4
BLOCK = ARITY**LEVELS
_SIBLINGS = "array<struct<left: string, right: string>>"


def encoded(values: Sequence[Column]) -> Column:
    """Values one behind the other, each as its number of UTF-8 bytes, ``:`` and itself; null as ``-``."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def digest(values: Sequence[Column]) -> Column:
    """Digest of a leaf that holds these values."""
    return F.sha2(encoded(values).cast("binary"), 256)


def _hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def _runs(level: Column) -> Column:
    """The digests of the level above: one for each run of ``ARITY``."""
    last = F.floor((F.size(level) - 1) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: _hash(F.slice(level, i * ARITY + 1, ARITY)))


def _climb(n: Column) -> Column:
    """Levels that a block still climbs in a tree of ``n`` nodes."""
    steps = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        steps = F.when(n <= ARITY**k, F.lit(k)).otherwise(steps)
    return steps


def _segment(place: Column) -> Column:
    """Siblings of the ``place``-th node of a block, level by level up to the block's own node."""
    parts = []
    for k in range(LEVELS):
        level, own = F.col(f"l{k}"), F.floor(place / ARITY**k).cast("int")
        start = F.floor(own / ARITY).cast("int") * ARITY
        left = F.array_join(F.slice(level, start + 1, own - start), "")
        right = F.array_join(F.slice(level, own + 2, start + ARITY - 1 - own), "")
        parts.append(F.struct(left.alias("left"), right.alias("right")))
    return F.slice(F.array(*parts), F.lit(1), F.col("steps"))


def _name(tree: Column, level: int | Column, place: Column) -> Column:
    """A node's name: its tree, level and place in it."""
    return F.struct(tree.alias("tree"), F.lit(level).cast("int").alias("level"), place.cast("bigint").alias("place"))


def _blocks(nodes: DataFrame, trees: DataFrame | int, level: int) -> tuple[DataFrame, int]:
    """Blocks of ``nodes`` (``tree, place, digest, rest``) with the levels inside, their top, and how many have more above.

    ``trees``: ``tree, n`` (leaves), ``after`` (name of the node that a finished tree stands for); for a single tree with
    nothing above it, its number of leaves.
    """
    members = F.sort_array(F.collect_list(F.struct("place", "digest", "rest")))
    block = F.floor(F.col("place") / BLOCK).alias("block")
    grouped = nodes.groupBy("tree", block).agg(members.alias("members"))
    if isinstance(trees, int):
        none = F.lit(None).cast("struct<tree: binary, level: int, place: bigint>")
        grouped = grouped.select("*", F.lit(trees).cast("bigint").alias("n"), none.alias("after"))
    else:
        grouped = grouped.join(trees, "tree")
    size = F.ceil(F.col("n") / F.lit(float(BLOCK**level))).cast("bigint")
    out = grouped.select("tree", "block", "after", "members", size.alias("size"), F.transform("members", lambda m: m["digest"]).alias("l0"))
    out = out.withColumn("steps", _climb(F.col("size")))
    for k in range(LEVELS):
        below = F.col(f"l{k}")
        out = out.withColumn(f"l{k + 1}", F.when(F.col("steps") > k, _runs(below)).otherwise(below))
    above = _name(F.col("tree"), level + 1, F.col("block"))
    more = F.col("size") > BLOCK
    out = out.select(
        "tree", "block", "members", *[f"l{k}" for k in range(LEVELS)], "steps", "size",
        F.element_at(f"l{LEVELS}", 1).alias("top"), F.when(more, above).otherwise(F.col("after")).alias("up"),
    )
    return durable_counted(out, more)


def _forest(nodes: DataFrame, trees: DataFrame | int) -> list[DataFrame]:
    """The blocks of all levels, leaves first."""
    found, level = [], 0
    while True:
        blocks, more = _blocks(nodes, trees, level)
        found.append(blocks)
        if not more:
            return found
        level += 1
        nodes = blocks.where(F.col("size") > BLOCK).select(
            "tree", F.col("block").alias("place"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("rest")
        )


def _pointers(blocks: DataFrame, level: int) -> DataFrame:
    """``node, up, segment`` for every node of the blocks."""
    each = blocks.select("*", F.explode(F.sequence(F.lit(0), F.size("l0") - 1)).alias("at"))
    return each.select(
        _name(F.col("tree"), level, F.col("block") * BLOCK + F.col("at")).alias("node"),
        "up",
        _segment(F.col("at")).alias("segment"),
        F.when(F.col("tree") == F.lit(b""), F.when(F.lit(level == 0), F.element_at("l0", F.col("at") + 1))).alias("subroot"),
    )


def _jumped(pointers: DataFrame) -> DataFrame:
    """Pointers followed to the root, each round twice as far: ``node, segment, subroot``."""
    table, left = durable_counted(pointers, F.col("up").isNotNull())
    while left:
        far = table.select(
            F.col("node").alias("up"), F.col("up").alias("next"), F.col("segment").alias("more"), F.col("subroot").alias("theirs")
        )
        joined = table.join(far, "up", "left").select(
            "node",
            F.col("next").alias("up"),
            F.concat("segment", F.coalesce("more", F.array().cast(_SIBLINGS))).alias("segment"),
            F.coalesce("subroot", "theirs").alias("subroot"),
        )
        before = table
        table, left = durable_counted(joined, F.col("up").isNotNull())
        discard(before)
    return table


def proofs(
    rows: DataFrame,
    values: Sequence[str],
    group: str,
    order: str,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``<order>, leaf, subroot, root, proof`` and the columns of ``also``, one row for each row of ``rows``.

    ``leaf`` is the digest of the columns ``values``. Leaves of a ``group`` (null is one, too) ascend by ``order``
    (nulls first), equal ones by their digest; while a level has several nodes, every ``ARITY`` neighbours, or fewer
    at its end, become the digest of their digests. What remains is the group's ``subroot``; subroots in order of
    their groups (null first, UTF-8 bytewise) lead to ``root`` likewise. ``proof`` lists the siblings from the leaf's
    level up to the root, ``left`` and ``right`` of the way (joined digests, empty where there are none).
    ``also`` holds further expressions of the columns ``values``, worked out beside the leaf.

    Repeated rows are leaves of their own with equal digests; texts may be of any length and count whole; columns
    that are not named are ignored whatever they are called; an empty table gives no rows.
    """
    also = dict(also or {})
    wanted = {v: v for v in dict.fromkeys([*values, group, order])}
    own = take(rows, **wanted).select(
        row_key(group).alias("tree"),
        F.col(group).cast("string").alias("group_name"),
        F.col(order).alias("rank_by"),
        digest([F.col(v) for v in values]).alias("digest"),
        F.struct(F.col(order).alias("id"), *[c.alias(f"a{i}") for i, c in enumerate(also.values())]).alias("rest"),
    )
    numbered = ordinal(own, ["tree"], ["rank_by", "digest"], "place")
    groups = durable(numbered.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.first("group_name").alias("group_name")))
    placed = durable(ordinal(groups, [], ["group_name"], "no").select("tree", "n", (F.col("no") - 1).alias("no")))
    leaf_nodes = numbered.select("tree", (F.col("place") - 1).alias("place"), "digest", "rest")
    top_name = _name(F.lit(b""), 0, F.col("no"))
    low = _forest(leaf_nodes, placed.select("tree", "n", top_name.alias("after")))
    finished = [b.where(F.col("size") <= BLOCK).select("tree", F.col("top").alias("digest")) for b in low]
    subroots = finished[0]
    for more in finished[1:]:
        subroots = subroots.unionByName(more)
    top_nodes = subroots.join(placed, "tree").select(
        F.lit(b"").alias("tree"), F.col("no").alias("place"), "digest", F.lit(None).cast("string").alias("rest")
    )
    high = _forest(top_nodes, placed.count())
    root = high[-1].select("top").first()
    tables = [_pointers(b, k) for k, b in enumerate(low) if k] + [_pointers(b, k) for k, b in enumerate(high)]
    pointers = tables[0]
    for more in tables[1:]:
        pointers = pointers.unionByName(more)
    ways = _jumped(pointers).select(F.col("node").alias("up"), F.col("segment").alias("rest_of_way"), "subroot")
    for used in (groups, placed, *low[1:], *high):
        discard(used)
    blocks = low[0].join(ways, "up").select("*", F.posexplode("members").alias("at", "member"))
    return blocks.select(
        F.col("member.rest.id").alias(order),
        F.col("member.digest").alias("leaf"),
        "subroot",
        F.lit(root.top if root else None).cast("string").alias("root"),
        F.concat(_segment(F.col("at")), "rest_of_way").alias("proof"),
        *[F.col(f"member.rest.a{i}").alias(name) for i, name in enumerate(also)],
    )


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(proof, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)

"""Chat formatting of reply trees with built-in expressions only.

Messages with a parent form trees. Pointer doubling by self-joins lists, for every leaf, all messages up to its
root: after ``k`` rounds a path holds the ``2 ** k`` messages nearest to the leaf, and a message knows its
``2 ** k``-th ancestor, so rounds grow with the logarithm of the depth. Branches of a tree are ranked by the sum
of their scores, and every chosen branch becomes one conversation.

Template: ``### <role>: <text></turn>`` and a line break for every turn. Inside roles and texts a backslash is
doubled, ``###`` becomes a backslash and ``h``, ``</turn>`` a backslash and ``e``, and in roles ``:`` a backslash
and ``c``; so the marks stand only where the template put them, and :func:`read_back` recovers every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.durable import discard, durable, durable_counted
from pixelframe.llm.columns import row_key, take
from pixelframe.operators.ranking import ordinal

#: Fixed marks of the template.
HEADER, SEPARATOR, FOOTER = "### ", ": ", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    """Text without any mark of the template; null counts as empty."""
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark, code in (("###", "\\h"), ("</turn>", "\\e"), *(((":", "\\c"),) if role else ())):
        safe = F.replace(safe, F.lit(mark), F.lit(code))
    return safe


def unescape(safe: Column) -> Column:
    """The text of :func:`escape`: pairs of backslashes are cut out first, then codes are unambiguous."""

    def codes(part: Column) -> Column:
        for mark, code in (("###", "\\h"), ("</turn>", "\\e"), (":", "\\c")):
            part = F.replace(part, F.lit(code), F.lit(mark))
        return part

    return F.array_join(F.transform(F.split(safe, r"\\\\"), codes), "\\")


def _messages(nodes: DataFrame) -> DataFrame:
    """One row per message with keys that are never null. Of rows with the same tree and id, the one with the
    best score counts (then the least parent, role and text); a parent that is missing, or the message itself, is
    none."""
    own = take(nodes, tree="tree", id="node", up="parent", role="role", text="text", score="score")
    keyed = own.select(
        row_key("tree", "id").alias("node"),
        F.when(F.col("up").isNotNull() & ~F.col("up").eqNullSafe(F.col("id")), row_key("tree", "up")).alias("parent"),
        "tree",
        "id",
        "role",
        "text",
        F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(0.0)).alias("score"),
    )
    rest = F.struct((-F.col("score")).alias("order"), "parent", "role", "text", "tree", "id", "score")
    best = keyed.groupBy("node").agg(F.min(rest).alias("m")).select("node", "m.*").drop("order")
    return durable(best)


def paths(messages: DataFrame) -> DataFrame:
    """``leaf, node, above``: every message on the way from each leaf to its root; ``above`` counts from the leaf.

    Messages on a cycle of parents have no root and no leaf; branches that hang on one are left out.
    """
    known = messages.select(F.col("node").alias("parent"))
    jump, left = durable_counted(messages.select("node", "parent").join(known, "parent", "left_semi").select("node", F.col("parent").alias("up")))
    leaves = messages.select("node").join(jump.select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    found = durable(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("above")))
    step = 1
    while left:
        higher = found.join(jump, "node").select("leaf", F.col("up").alias("node"), (F.col("above") + step).alias("above"))
        grown = durable(found.unionByName(higher))
        far = jump.alias("a").join(jump.alias("b"), F.col("a.up") == F.col("b.node"))
        doubled, remain = durable_counted(far.select(F.col("a.node").alias("node"), F.col("b.up").alias("up")))
        discard(found)
        found, step = grown, step * 2
        if remain == left:  # no message is that deep: what is left runs in circles
            endless = doubled.select(F.col("node").alias("leaf")).distinct()
            return found.join(endless, "leaf", "left_anti")
        discard(jump)
        jump, left = doubled, remain
    return found


def conversations(nodes: DataFrame, branches: int | None = None, learn_role: str = "assistant") -> DataFrame:
    """One formatted conversation per chosen branch of each tree.

    ``nodes``: ``tree, node, parent, role, text, score`` in any order, other columns ignored. ``branches``
    limits the result to the best ones of each tree; all are returned without it. Equal sums are ranked by the
    leaf's id. Result: ``tree, leaf, rank, path_score, n_turns, formatted, loss array<struct<start, length>>``,
    where ``loss`` marks (from 1, in code points) the escaped texts of ``learn_role``. Null roles and texts
    count as empty. Empty input gives no rows.
    """
    messages = _messages(nodes)
    way = durable(paths(messages))
    scores = messages.select("node", "score")
    ends = messages.select(F.col("node").alias("leaf"), "tree", F.col("id").alias("leaf_id"), row_key("tree").alias("group"))
    sums = way.join(scores, "node").groupBy("leaf").agg(F.sum("score").alias("path_score")).join(ends, "leaf")
    ranked = ordinal(
        sums.withColumn("falling", -F.col("path_score")), ["group"], ["falling", "leaf_id", "leaf"], "rank"
    )
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    ranked = ranked.select("leaf", "leaf_id", "tree", "rank", "path_score")
    turns = way.join(ranked.select("leaf"), "leaf", "left_semi").join(messages.select("node", "role", "text"), "node")
    safe = escape(F.col("text"))
    head = F.concat(F.lit(HEADER), escape(F.col("role"), role=True), F.lit(SEPARATOR))
    shaped = turns.select(
        "leaf",
        "above",
        F.concat(head, safe, F.lit(FOOTER)).alias("piece"),
        F.when(F.col("role") == learn_role, F.length(head)).alias("inner"),
        F.length(safe).alias("length"),
    )
    before = Window.partitionBy("leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    placed = shaped.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("bigint")).over(before), F.lit(0)) + F.col("inner") + 1)
    span = F.when(F.col("inner").isNotNull(), F.struct("start", F.col("length").cast("bigint").alias("length")))
    joined = placed.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct((-F.col("above")).alias("order"), "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(span)).alias("loss"),
    )
    return joined.join(ranked, "leaf").select(
        "tree",
        F.col("leaf_id").alias("leaf"),
        "rank",
        "path_score",
        "n_turns",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        "loss",
    )


def read_back(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation."""
    turns = F.split(formatted, FOOTER)

    def parts(turn: Column) -> Column:
        colon = F.instr(turn, SEPARATOR)
        role = F.substring(turn, F.lit(len(HEADER) + 1), colon - len(HEADER) - 1)
        return F.struct(
            unescape(role).alias("role"),
            unescape(F.substring(turn, colon + len(SEPARATOR), F.length(turn))).alias("text"),
        )

    return F.transform(F.slice(turns, 1, F.size(turns) - 1), parts)


def under_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask, span after span."""
    spans = F.transform(
        loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))
    )
    return F.array_join(spans, "")


def chains(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Flat conversations as trees of one branch: every turn replies to the one before it.

    Turns are put in order of number, then role and text, so repeated numbers stay apart; null numbers are first.
    """
    own = take(rows, tree=id_col, turn=turn_col, role="role", text="text").withColumn("group", row_key("tree"))
    placed = ordinal(own, ["group"], ["turn", "role", "text"], "node")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return placed.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read from the output alone."""
    turns, learned = read_back(F.col("formatted")), under_loss(F.col("formatted"), F.col("loss"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = formatted.select(
        F.col("tree").alias("conv_id"),
        lines.alias("lines"),
        learned.alias("learned"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        F.size("lines").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )

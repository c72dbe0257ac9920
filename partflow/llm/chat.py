"""Reply trees: root-to-leaf paths by self-joins that double their reach, ranked by score and written as conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partflow.llm.common import dropped, stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"  # fixed values: the template's turn marks
TRAINED = "assistant"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;"))  # the last for roles only


def escaped(text: Column, role: bool = False) -> Column:
    """The text without any character that a control string begins with; `unescaped` gives it back."""
    for plain, safe in ESCAPES if role else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    for plain, safe in reversed(ESCAPES if role else ESCAPES[:-1]):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def paths(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, leaf, node, back, path_score): each chosen root-to-leaf path, a row a node, back counting from the leaf.

    nodes: tree (string), node, parent (null at a root), score. In round k every node knows its ancestor 2^k up, and the
    score from there down; each path row finds the row 2^k further up, so the rounds are the logarithm of the depth. A tree
    keeps its `top` leaves by the path's score (ties: the smaller leaf), or all. A parent that does not exist makes a root;
    nodes that hang on a cycle are in no path.
    """
    base = stored(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")).distinct(), "tree-nodes")
    ids = base.select("tree", F.col("node").alias("parent"))
    real = base.join(ids.withColumn("known", F.lit(True)), ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score")
    jumps, most = [stored(real, "jumps")], base.count().bit_length()
    while len(jumps) <= most and not jumps[-1].filter("up IS NOT NULL").isEmpty():
        far = jumps[-1].select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"))
        climbing, done = jumps[-1].filter("up IS NOT NULL"), jumps[-1].filter("up IS NULL")
        step = climbing.join(far, ["tree", "up"], "left").select("tree", "node", F.col("next").alias("up"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
        jumps.append(stored(step.unionByName(done), "jumps"))
    inner = jumps[0].filter("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    leaves = jumps[-1].filter("up IS NULL").join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), F.col("score").alias("path_score"))
    if top is not None:
        order = Window.partitionBy("tree").orderBy(F.col("path_score").desc(), "leaf")
        leaves = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("rank")
    found = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"), "path_score")
    for k, jump in enumerate(jumps[:-1]):
        further = found.join(jump.filter("up IS NOT NULL").select("tree", "node", "up"), ["tree", "node"])
        grown = stored(found.unionByName(further.select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"), "path_score")), "paths")
        if k:
            dropped(found)
        found = grown
    return found


def formatted(rows: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss_spans): one string a path, and where the assistant's texts lie in it (start from 0,
    length, in code points). rows: tree, leaf, back, role, text. A null role or text is empty. One path is one string, so
    one path is what a task must hold."""
    head = F.concat(F.lit(OPEN), escaped(F.coalesce("role", F.lit("")), role=True), F.lit("\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    turns = rows.select("tree", "leaf", "back", F.coalesce(F.col("role") == TRAINED, F.lit(False)).alias("trained"), head.alias("head"), body.alias("body"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    before = Window.partitionBy("tree", "leaf").orderBy(F.col("back").desc()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("turn"), "trained", "start", F.length("body").cast("long").alias("length"))))
    out = turns.groupBy("tree", "leaf").agg(ordered.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return out.select("tree", "leaf", F.array_join(F.col("turns")["turn"], "").alias("formatted"), spans.alias("loss_spans"))


def read_back(text: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, as they were."""
    parts = F.split(text, r"<\|im_start\|>", -1)
    turn = lambda p: F.struct(
        unescaped(F.substring_index(p, "\n", 1), role=True).alias("role"),
        unescaped(_body(p)).alias("text"),
    )
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def _body(part: Column) -> Column:
    at = F.length(F.substring_index(part, "\n", 1)) + 1
    return F.substring(part, at + 1, F.length(part) - at - len(CLOSE))


def masked(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def linear_nodes(rows: DataFrame) -> DataFrame:
    """Messages of plain conversations as trees without branches: each turn answers the one before it.

    Turns go by turn (null first), role and text, so repeated turns keep a fixed order. A null conv_id is a conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    out = rows.select("conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return out.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))


def format_trees(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, formatted, loss_spans) of the chosen paths of trees of messages: tree, node, parent, role, text, score."""
    chosen = paths(nodes, top)
    return formatted(chosen.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]))

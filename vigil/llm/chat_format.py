"""Chat formatting over reply trees.

Messages (tree, node, parent, role, text, score) form reply trees. Root-to-leaf paths are enumerated by iterative
self-joins with doubled steps: after k joins each node knows the ancestor 2^k steps up, so a path of n messages takes
log2(n) joins and long threads need no more rounds than their depth's logarithm. Branches are ranked by the sum of
scores along the path, and each chosen leaf's path is formatted as one conversation:

    ### <role>: <text></turn>

with a line end after each turn. Control strings inside texts and roles are escaped reversibly (``ESCAPES``), so an
unescaped marker never comes from a text. The loss mask gives, for each turn under the loss, the span of its text
within the turn (code points), which keeps offsets linear in very long conversations.

Defined cases: null texts and roles are empty; a parent that isn't there makes its child a root; messages on a cycle
have no root and are on no path; ties of branches go to the longer path, then the smaller leaf; rows that repeat one
another are messages of their own; an empty table gives no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.ordering import global_position, ordered
from vigil.llm.shared import Workspace

# Fixed values of the template. A backslash is escaped first and restored last.
HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>"
ESCAPES = [("\\", "\\b"), (END, "\\e"), (HEAD, "\\h")]
ROLE_ESCAPES = [*ESCAPES, (AFTER_ROLE, "\\c")]


def escape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ROLE_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chains(rows: DataFrame, ws: Workspace, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Flat conversations as reply trees: each row answers the row before it.

    Rows are numbered in a global order (ordering.py), so the previous row is the previous number and no window
    gathers a conversation.
    """
    columns = [F.col(conversation).cast("long").alias("tree"), F.col(turn).cast("long").alias("turn"),
               F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    keys = [F.col("tree").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    line = global_position(ordered(ws, rows.select(*columns), keys, "line")).withColumnRenamed("position", "node")
    first = line.groupBy(F.col("tree").alias("__t")).agg(F.min("node").alias("first"))
    return ws.store(line.join(first, F.col("tree").eqNullSafe(F.col("__t")))
                    .select("tree", "node", F.when(F.col("node") > F.col("first"), F.col("node") - 1).alias("parent"),
                            "role", "text", F.lit(0.0).alias("score")), "messages")


def climb(messages: DataFrame, ws: Workspace) -> tuple[list[DataFrame], DataFrame]:
    """The tables of doubled steps, and each rooted node with its depth and the score of its path from the root."""
    known = messages.select(F.col("node").alias("__n"))
    here = messages.select("node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    step = ws.store(here.join(known, here["parent"] == known["__n"], "left")
                    .select("node", F.col("__n").alias("up"), F.lit(1).cast("long").alias("steps"), "score"), "step0")
    tables, rounds = [], 0
    limit = max(1, int(step.count()).bit_length()) + 1  # a pointer still up after that is on its way round a cycle
    while True:
        open_rows = step.where("up IS NOT NULL")
        if rounds >= limit or open_rows.isEmpty():
            break
        tables.append(open_rows.select("node", "up"))
        above = step.select(F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("score").alias("__score"))
        moved = open_rows.join(above, F.col("up") == F.col("__n")).select(
            "node", F.col("__up").alias("up"), (F.col("steps") + F.col("__steps")).alias("steps"), (F.col("score") + F.col("__score")).alias("score"))
        rounds += 1
        step = ws.store(step.where("up IS NULL").unionByName(moved), f"step{rounds}")
    return tables, step.where("up IS NULL").select("node", F.col("steps").alias("depth"), "score")


def paths(messages: DataFrame, ws: Workspace, branches: int | None = 1) -> DataFrame:
    """Messages on the chosen root-to-leaf paths: tree, leaf, branch (rank), depth (from 1), role, text.

    ``branches`` best paths of each tree are chosen, all of them if None.
    """
    tables, rooted = climb(messages, ws)
    parents = messages.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = messages.select("tree", "node").join(parents, "node", "left_anti").join(rooted, "node")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("depth").desc(), F.col("node")))
    chosen = leaves.withColumn("branch", rank)
    if branches is not None:
        chosen = chosen.where(F.col("branch") <= branches)
    chosen = ws.store(chosen.select("tree", F.col("node").alias("leaf"), "branch"), "leaves")
    on = chosen.select("leaf", F.col("leaf").alias("node"))
    for k, table in enumerate(tables):
        on = ws.store(on.unionByName(on.join(table, "node").select("leaf", F.col("up").alias("node"))), f"on{k}")
    texts = messages.select("node", "role", "text")
    return (on.join(chosen, "leaf").join(rooted.select("node", "depth"), "node").join(texts, "node")
            .select("tree", "leaf", "branch", "depth", "role", "text"))


def conversations(path_rows: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per path: tree, leaf, branch, formatted, loss_spans (turn from 0, start, end within the turn).

    A conversation is one record, so its turns meet in one row.
    """
    head = F.concat(F.lit(HEAD), escape(F.coalesce("role", F.lit("")), ROLE_ESCAPES), F.lit(AFTER_ROLE))
    pieces = path_rows.select("tree", "leaf", "branch", "depth", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("inner"),
                              F.coalesce("role", F.lit("")).isin(*trained_roles).alias("trained"))
    turn = F.struct("depth", F.concat("head", "inner", F.lit(END + "\n")).alias("piece"), "trained",
                    F.length("head").alias("start"), (F.length("head") + F.length("inner")).alias("end"))
    whole = pieces.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("branch").alias("branch"),
                                       F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["end"].alias("end"),
                                                                t["trained"].alias("trained"))), lambda s: s["trained"])
    return whole.select("tree", "leaf", "branch", F.array_join(F.col("turns.piece"), "").alias("formatted"),
                        F.transform(spans, lambda s: s.dropFields("trained")).alias("loss_spans"))


def pieces_of(formatted: Column) -> Column:
    """The turns of a formatted conversation, without their end marks; no text holds an end mark."""
    parts = F.split(formatted, END + "\n")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_back(formatted: DataFrame) -> DataFrame:
    """Formatted conversations with ``turns`` (role, text) and ``loss_texts`` read from the formatted text and the mask."""
    def parse(piece: Column) -> Column:
        at = F.locate(AFTER_ROLE, piece, len(HEAD) + 1)
        return F.struct(unescape(F.substring(piece, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"),
                        unescape(F.substring(piece, at + len(AFTER_ROLE), F.length(piece))).alias("text"))

    read = formatted.withColumn("pieces", pieces_of(F.col("formatted")))
    return (read.withColumn("turns", F.transform("pieces", parse))
            .withColumn("loss_texts", F.transform("loss_spans", lambda s: unescape(
                F.substring(F.element_at("pieces", s["turn"] + 1), s["start"] + 1, s["end"] - s["start"]))))
            .drop("pieces"))

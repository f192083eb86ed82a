"""Chat formatting: the best root-to-leaf paths of reply trees as marked-up conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.llm.scratch import Scratch

OPEN, SHUT, CLOSE = '<turn role="', '">', "</turn>\n"


def escape(text: Column) -> Column:
    """No ``<`` or quote is left, and every backslash begins an escape."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit('"'), F.lit("\\q"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\q"), F.lit('"')), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def linear_replies(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as a reply tree in which each turn answers the one before.

    Turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(w).cast("bigint")
    rows = turns.select("conv_id", "role", "text", node.alias("msg_id"))
    return rows.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Turns of the ``branches`` best root-to-leaf paths of each conversation.

    ``messages``: conv_id, msg_id (unique in its conversation), parent_id (null: a root; an unknown parent
    makes its message a root), role, text, score (null: 0).  A path's score is the sum over its messages;
    ties go to the longer path, then to the smaller leaf id.  Returns conv_id, branch (1 is best), depth (0 is
    the root), role, text.

    Round k of the self-joins links each message that is so deep with the ancestor 2**k above it and sums scores on
    the way, so a path of n turns takes log2(n) rounds; the chosen leaves then walk the same links from the longest
    to the shortest.  Every join key is (conv_id, msg_id), which no conversation makes hot.  Messages on a
    cycle of replies reach no root and are left out; repeated (conv_id, msg_id) rows count once (the least).
    """
    spark = messages.sparkSession
    scratch = Scratch(spark, "chat")
    columns = ["conv_id", "msg_id", "parent_id", "role", "text", "score"]
    least = F.min(F.struct("parent_id", "role", "text", "score")).alias("m")
    nodes = messages.select(*columns).filter(F.col("msg_id").isNotNull()).groupBy("conv_id", "msg_id").agg(least).select("conv_id", "msg_id", "m.*")
    nodes = scratch.keep(nodes, "nodes")
    known = nodes.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"))
    links = nodes.join(known, _same("conv_id", "c") & (F.col("parent_id") == F.col("m")), "left").select(
        "conv_id", "msg_id", F.col("m").alias("up"), F.when(F.col("m").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.coalesce("score", F.lit(0.0)).alias("gain")
    )
    links = scratch.keep(links, "links-0")
    size = links.count()
    rungs, ended = [links.filter(F.col("up").isNotNull())], links.filter(F.col("up").isNull())
    while 2 ** (len(rungs) - 1) <= size and rungs[-1].limit(1).count():
        above = rungs[-1].union(ended).select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("gain").alias("gain2"))
        links = rungs[-1].join(above, _same("conv_id", "c") & (F.col("up") == F.col("m"))).select(
            "conv_id", "msg_id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("gain") + F.col("gain2")).alias("gain")
        )
        links = scratch.keep(links, f"links-{len(rungs)}")
        rungs.append(links.filter(F.col("up").isNotNull()))
        ended = ended.union(links.filter(F.col("up").isNull()))
    whole = ended
    parents = rungs[0].select(F.col("conv_id").alias("c"), F.col("up").alias("m")).distinct()
    leaves = whole.join(parents, _same("conv_id", "c") & (F.col("msg_id") == F.col("m")), "left_anti")
    best = Window.partitionBy("conv_id").orderBy(F.desc("gain"), F.desc("steps"), "msg_id")
    walk = leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches).select("conv_id", "branch", "msg_id", F.col("steps").alias("depth"))
    walk = scratch.keep(walk, "walk")
    for k in range(len(rungs) - 1, -1, -1):
        rung = rungs[k].select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), "up")
        up = walk.join(rung, _same("conv_id", "c") & (F.col("msg_id") == F.col("m"))).select("conv_id", "branch", F.col("up").alias("msg_id"), (F.col("depth") - 2**k).alias("depth"))
        walk = scratch.keep(walk.union(up), f"walk-{k}")
    bodies = nodes.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), "role", "text")
    out = walk.join(bodies, _same("conv_id", "c") & (F.col("msg_id") == F.col("m"))).select("conv_id", "branch", "depth", "role", "text")
    return out


def format_paths(paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """One conversation per (conv_id, branch): ``formatted``, ``turn_starts`` and ``loss``.

    A turn is ``<turn role="ROLE">TEXT</turn>`` and a line feed, ROLE and TEXT escaped.  ``turn_starts`` has the
    offset of each turn, ``loss`` the (start, stop) of the text of each turn whose role is ``learn``, null for the
    other turns; offsets count code points of ``formatted``.  Null role or text: empty.  A conversation is one
    row of output, so its turns meet in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = paths.select("conv_id", "branch", "depth", F.concat(F.lit(OPEN), escape(role), F.lit(SHUT)).alias("head"), escape(text).alias("body"), (role == learn).alias("learnt"))
    rows = rows.withColumns({"turn": F.concat("head", "body", F.lit(CLOSE)), "a": F.char_length("head"), "b": F.char_length("body")})
    before = Window.partitionBy("conv_id", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("turn").cast("bigint")).over(before), F.lit(0)))
    mask = F.when(F.col("learnt"), F.struct((F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("a") + F.col("b")).alias("stop")))
    turns = F.array_sort(F.collect_list(F.struct("depth", "turn", "start", mask.alias("loss"))))
    return rows.groupBy("conv_id", "branch").agg(turns.alias("t")).select(
        "conv_id", "branch", F.array_join("t.turn", "").alias("formatted"), F.col("t.start").alias("turn_starts"), F.col("t.loss").alias("loss")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(OPEN) + 1))
        role = F.substring_index(rest, SHUT, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(rest, F.char_length(role) + len(SHUT) + 1)).alias("text"))

    return F.transform(pieces, turn)


def read_learnt(formatted: Column, turn_starts: Column, loss: Column) -> Column:
    """The texts under the loss mask, in order and unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    kept = F.filter(F.arrays_zip(pieces.alias("piece"), turn_starts.alias("at"), loss.alias("loss")), lambda z: z["loss"].isNotNull())
    return F.transform(
        kept, lambda z: unescape(F.substr(z["piece"], (z["loss"]["start"] - z["at"] + 1).cast("int"), (z["loss"]["stop"] - z["loss"]["start"]).cast("int")))
    )

"""Line dedup: lines that several documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.scratch import Scratch

BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare.rlike("[A-Z]"), F.translate(bare, _UPPER, _LOWER)).otherwise(bare)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``; adds ``n_lines`` (before) and ``n_dropped``.

    Lines whose key has ``min_chars`` code points and is found in ``min_docs`` documents stay only in the
    document with the smallest id, there at every place.  Keys are compared by two 64-bit hashes.  Only
    positions travel: the text itself is shuffled once, for the reassembly.  A hot line is summed up
    before its shuffle (minimum and maximum of the ids) and the join back has one row per key on the
    other side, so it can be split.

    Null or empty text: one empty line; null text stays null.  Null id: counts as one document behind all
    others.  Rows with the same id are one document: each row is returned, and their lines are not held
    against one another.  An empty table gives an empty table.  Other columns pass through; columns named
    ``n_lines`` or ``n_dropped`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(
        F.struct(*[docs[c] for c in names]).alias("row"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("version"),
        F.split(F.coalesce(docs[text_col], F.lit("")), "\n", -1).alias("lines"),
    )
    key = line_key(F.col("line"))
    lines = rows.select("id", "version", F.posexplode("lines").alias("pos", "line")).select("id", "version", "pos", key.alias("key"))
    lines = lines.filter(F.char_length("key") >= min_chars).select("id", "version", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2"))
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(lines, "lines")
    owners = lines.groupBy("k1", "k2").agg(
        F.min("id").alias("owner"), F.max("id").alias("other"), F.max(F.col("id").isNull()).alias("nameless"),
        *([] if min_docs == 2 else [F.count_distinct("id").alias("holders")]),
    )
    if min_docs == 2:
        owners = owners.filter((F.col("owner") < F.col("other")) | (F.col("nameless") & F.col("owner").isNotNull()))
    else:
        owners = owners.filter(F.col("owner").isNotNull() & (F.col("holders") + F.col("nameless").cast("int") >= min_docs))
    owners = scratch.keep(owners.select("k1", "k2", "owner"), "owners")  # written, so that the join's hot lines can be split
    drops = lines.join(owners, ["k1", "k2"]).filter(F.col("id").isNull() | (F.col("id") != F.col("owner")))
    drops = drops.groupBy(F.col("id").alias("drop_id"), F.col("version").alias("drop_version")).agg(F.collect_set("pos").alias("drops"))
    drops = scratch.keep(drops, "drops")
    scratch.drop(lines)
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("version") == F.col("drop_version")), "left")
    n = F.size("lines")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("drops")), lambda i: F.get(F.col("lines"), i))
    text = F.when(F.col("drops").isNull(), F.col(f"row.{text_col}")).otherwise(F.array_join(stay, "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names],
        n.cast("bigint").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )

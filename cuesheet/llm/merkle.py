"""A Merkle manifest of a dataset: leaf coordinates by ranks in bitmaps, levels reduced through keyed slot arrays.

The ids of every group are merged into bitmaps of 64 ids, of which only the occupied words are kept.  Directories of
their popcounts, one per 16 bits of the id above, turn an id into its rank, which is the leaf's coordinate: no leaves are
sorted.  A node goes to slot ``pos % FAN`` of the run ``pos div FAN``, so each level is one grouping by (group, run).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.scratch import Scratch

FAN = 8  # nodes of a run
WORD = 6  # bits of an id that a bitmap word answers
DIRECTORY = (10, 16, 16, 16)  # bits that each directory above the words answers; 64 together with WORD
SALTS = 64  # parts that rows of one repeated id are dealt into


def digest(*parts: Column) -> Column:
    """H: lowercase hex sha256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value; numbers as decimals."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def group_key(group: Column) -> Column:
    """A key that is never null and sorts like the group, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _bitmaps(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """From rows (group, id): the occupied bitmap words (group, key, word, before), and (group, n, n_null) of every group.

    ``before`` counts the group's rows with smaller ids than any of the word, nulls included, as nulls come first.
    """
    key = F.shiftright("id", WORD)
    words = rows.filter(F.col("id").isNotNull()).groupBy("group", key.alias("key")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(id & 63 AS int))")).alias("word"), F.count(F.lit(1)).alias("n")
    )
    words = scratch.keep(words, "bitmaps")
    nulls = rows.groupBy("group").agg(F.count_if(F.col("id").isNull()).alias("n_null"))
    level, levels = words.select("group", "key", "n"), []
    for bits in DIRECTORY:
        level = level.withColumn("parent", F.shiftright("key", bits))
        levels.append(scratch.keep(level.withColumn("before", _running(["group", "parent"], "key")), "directory"))
        level = levels[-1].groupBy("group", F.col("parent").alias("key")).agg(F.sum("n").alias("n"))
    # the last level has the parents 0 and -1, the ids from 0 up and those below
    level = level.groupBy("group").agg(F.sum("n").alias("n_ids"), F.sum(F.when(F.col("key") < 0, F.col("n")).otherwise(0)).alias("below"))
    groups = scratch.keep(nulls.join(level, "group", "left").select("group", "n_null", (F.col("n_null") + F.coalesce("n_ids", F.lit(0))).alias("n"), F.coalesce("below", F.lit(0)).alias("below")), "groups")
    upper = groups.select("group", F.explode(F.array(F.lit(-1), F.lit(0)).cast("array<bigint>")).alias("parent"), "n_null", "below")
    upper = upper.select("group", "parent", (F.col("n_null") + F.when(F.col("parent") < 0, 0).otherwise(F.col("below"))).alias("above"))
    for table in reversed(levels):
        upper = table.join(upper, ["group", "parent"]).select("group", F.col("key").alias("parent"), (F.col("above") + F.col("before")).alias("above"))
        upper = scratch.keep(upper, "ranks")
    words = words.join(upper.withColumnRenamed("parent", "key"), ["group", "key"]).select("group", "key", "word", F.col("above").alias("before"), "n")
    return words, groups


def _running(keys: list[str], order: str) -> Column:
    """The sum of ``n`` over the rows of the same keys that come before."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(before), F.lit(0))


def _same(a: DataFrame, b: DataFrame, *more: str) -> list[Column]:
    return [a["group"] == b["group"], a["id"].eqNullSafe(b["id"]), *[a[m] == b[m] for m in more]]


def _ties(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of repeated ids with ``tie``, the rows of the same group and id before each; and (group, id, rows) of these ids.

    Ties ascend by leaf.  They are counted in parts, by leaf and a salt for equal rows, and parts are summed by the first digits of
    the leaf, so that no task sorts all rows of an id.
    """
    counts = rows.groupBy("group", "id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    counts = scratch.keep(counts, "repeats")
    rows = rows.join(counts, _same(rows, counts)).select(*[rows[c] for c in rows.columns])
    salt = F.format_string("%02d", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    rows = scratch.keep(rows.withColumn("part", F.concat("leaf", salt)), "tied")
    parts = rows.groupBy("group", "id", F.substring("part", 1, 2).alias("head"), "part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("inner", _running(["group", "id", "head"], "part"))
    heads = parts.groupBy("group", "id", "head").agg(F.sum("n").alias("n"))
    heads = scratch.keep(heads.withColumn("outer", _running(["group", "id"], "head")), "heads")
    parts = parts.join(heads, _same(parts, heads, "head")).select(parts["group"], parts["id"], "part", (F.col("inner") + F.col("outer")).alias("before"))
    parts = scratch.keep(parts, "parts")
    rows = rows.withColumn("within", F.row_number().over(Window.partitionBy("group", "id", "part").orderBy("part")) - 1)
    rows = rows.join(parts, _same(rows, parts, "part")).select(*[rows[c] for c in rows.columns if c not in ("part", "within")], (F.col("before") + F.col("within")).alias("tie"))
    return scratch.keep(rows, "ties"), counts


def _coordinates(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``rows`` (group, id, leaf, ...) with ``pos``, the number of rows of the group before each; and its groups (group, n).

    Null ids come first.  Rows of one group and id are ordered by their leaves.
    """
    words, groups = _bitmaps(rows, scratch)
    words = scratch.keep(words, "words")
    names, rows = rows.columns, rows.withColumn("key", F.shiftright("id", WORD))
    # Words that hold fewer ids than rows have ids of several rows; these count besides their bit.
    crowded = words.filter(F.bit_count("word") < F.col("n")).select("group", "key")
    crowded = scratch.keep(crowded.union(groups.filter("n_null > 1").select("group", F.lit(None).cast("bigint"))), "crowded")
    none = F.lit(0).cast("bigint")
    if crowded.limit(1).count():
        there = lambda a, b: (a["group"] == b["group"]) & a["key"].eqNullSafe(b["key"])
        tied, counts = _ties(rows.join(crowded, there(rows, crowded), "left_semi"), scratch)
        extra = counts.filter("id IS NOT NULL").groupBy("group", F.shiftright("id", WORD).alias("key")).agg(F.collect_list(F.struct("id", (F.col("rows") - 1).alias("more"))).alias("extra"))  # 64 at most
        words = scratch.keep(words.join(extra, ["group", "key"], "left"), "words")
        rows = rows.join(counts, _same(rows, counts), "left_anti").withColumn("tie", none).unionByName(tied)
    else:
        words = words.withColumn("extra", F.lit(None).cast("array<struct<id:bigint,more:bigint>>"))
        rows = rows.withColumn("tie", none)
    rows = rows.join(words.drop("n"), ["group", "key"], "left")
    smaller = F.expr("bit_count(word & ~shiftleft(-1L, cast(id & 63 AS int)))")
    more = F.coalesce(F.aggregate(F.filter("extra", lambda e: e["id"] < F.col("id")), none, lambda a, e: a + e["more"]), none)
    pos = F.when(F.col("id").isNull(), F.col("tie")).otherwise(F.col("before") + smaller + more + F.col("tie"))
    return rows.select(*names, pos.cast("bigint").alias("pos")), groups.select("group", "n")


def _height(n: Column) -> Column:
    """How many levels of runs lie above ``n`` leaves."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda i: F.pow(F.lit(float(FAN)), i) < n))


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes (group, pos, n, node struct with ``digest``) grouped into runs (group, run, n, slots): keyed slot arrays, gaps left out."""
    slots = F.map_from_entries(F.collect_list(F.struct((F.col("pos") % FAN).alias("slot"), "node")))
    runs = nodes.groupBy("group", F.floor(F.col("pos") / FAN).alias("run")).agg(slots.alias("m"), F.first("n").alias("n"))
    return runs.select("group", "run", "n", F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(FAN - 1).cast("bigint")), lambda i: F.try_element_at("m", i)), lambda s: s.isNotNull()).alias("slots"))


def _parents(runs: DataFrame) -> DataFrame:
    return runs.select("group", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), F.struct(F.sha2(F.array_join(F.col("slots.digest"), ""), 256).alias("digest")).alias("node"))


def _tree(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level and (group, root) of a forest given by its leaves (group, pos, n, node)."""
    levels, roots = [], []
    while True:
        if levels:
            roots.append(nodes.filter("n = 1").select("group", F.col("node.digest").alias("root")))
            nodes = nodes.filter("n > 1")
        runs = scratch.keep(_runs(nodes), f"{name}-runs")
        if levels and not runs.limit(1).count():
            break
        levels.append(runs)
        if len(levels) == 1:
            roots.append(runs.filter("n = 1").select("group", F.col("slots")[0]["digest"].alias("root")))
            runs = runs.filter("n > 1")
        nodes = _parents(runs)
    every = roots[0]
    for more in roots[1:]:
        every = every.union(more)
    return levels, scratch.keep(every, f"{name}-roots")


PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def _paths(levels: list[DataFrame], tops: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(group, pos, node, path) of every leaf.  ``path`` holds the siblings' digests to the left and right, level by level.

    ``tops`` has (group, n, path): how the path goes on above a group's root.
    """
    tops = tops.withColumn("height", _height(F.col("n")))
    above = None
    for k in range(len(levels) - 1, -1, -1):
        here = tops.filter(F.col("height") == k + 1).select("group", F.lit(0).cast("bigint").alias("run"), "path")
        if k == 0:
            here = here.union(tops.filter("height = 0").select("group", F.lit(0).cast("bigint"), "path"))
        above = here if above is None else above.union(here)
        runs = levels[k].join(above, ["group", "run"])
        side = lambda part: F.array_join(F.transform(part, lambda s: s["digest"]), "")
        own = F.transform("slots", lambda s, i: F.struct(
            s.alias("node"), i.cast("bigint").alias("slot"),
            F.struct(side(F.slice("slots", F.lit(1), i)).alias("left"), side(F.slice("slots", i + 2, F.lit(FAN))).alias("right")).alias("step"),
        ))
        each = runs.select("group", "run", "n", "path", F.explode(own).alias("s"))
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(F.col("s.step")), F.col("path")))
        each = each.select("group", (F.col("run") * FAN + F.col("s.slot")).alias("run"), F.col("s.node").alias("node"), path.alias("path"))
        if k == 0:
            return each.withColumnRenamed("run", "pos")
        above = scratch.keep(each.select("group", "run", "path"), f"{name}-paths")
    raise ValueError("a tree has at least one level")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def _numbered(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct keys (group, ...) with ``pos``, their rank: sorted by range, then counted per part; no task holds all."""
    parts = scratch.keep(keys.orderBy("group").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    sizes = parts.groupBy(F.shiftright("_at", 33).alias("_part")).agg((F.max(F.expr("_at & 8589934591")) + 1).alias("_size"))
    first = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # a row per sort task
    return parts.join(scratch.keep(first, "firsts"), F.shiftright("_at", 33) == F.col("_part")).withColumn("pos", F.col("_first") + F.expr("_at & 8589934591")).drop("_at", "_part", "_first")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), current_leaf: Column | None = None) -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, path, folded_root, verified) of every row.

    A row's leaf is the digest of ``fields``, each as ``field`` writes it.  Per group, leaves ascend by id; every ``FAN``
    consecutive ones become their digest until one is left, the subroot (a lone leaf is its own).  Subroots, ordered by
    group (null first, then by bytes), lead to the root in the same way.  ``path`` holds a leaf's siblings from the leaf to the
    root and ``proof_sha256`` is the digest of all of them.  ``current_leaf``, an expression over ``docs``, gives the leaf to verify (default: the leaf
    itself): ``folded_root`` is what it leads to with the original siblings, and ``verified`` whether that is the root.

    Texts are read once and only digests are shuffled.  Ids must be whole numbers of at most 64 bits (a TypeError
    otherwise).  Null ids and groups are values of their own and come first.  Rows of the same group and id are all leaves, ordered by their
    digests.  Null and empty texts have different leaves.  Other columns are ignored, whatever their names.  An empty table gives no rows.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a column of whole numbers")
    scratch = Scratch(docs.sparkSession, "merkle")
    leaf = digest(*[field(docs[f]) for f in fields])
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), group_key(docs[group_col]).alias("group"), leaf.alias("leaf"), (leaf if current_leaf is None else current_leaf).alias("current"))
    rows = scratch.keep(rows, "leaves")
    placed, groups = _coordinates(rows, scratch)
    placed = placed.join(groups, "group").select("group", "pos", "n", F.struct(F.col("leaf").alias("digest"), "id", "current").alias("node"))
    levels, subroots = _tree(placed, scratch, "group")
    tops = scratch.keep(_numbered(subroots.join(groups.withColumnRenamed("n", "leaves"), "group"), scratch), "numbered")
    n_groups = tops.count()
    over = tops.select(F.lit("").alias("group"), "pos", F.lit(n_groups).cast("bigint").alias("n"), F.struct(F.col("root").alias("digest"), F.col("group").alias("of"), "leaves").alias("node"))
    top_levels, root = _tree(over, scratch, "top")
    start = root.select("group", F.lit(n_groups).cast("bigint").alias("n"), F.array().cast(PATH).alias("path"))
    above = _paths(top_levels, start, scratch, "top").select(F.col("node.of").alias("group"), F.col("node.leaves").alias("n"), F.col("node.digest").alias("subroot"), "path")
    above = scratch.keep(above, "above")
    top = root.first()  # one digest, or none for an empty table
    out = _paths(levels, above.select("group", "n", "path"), scratch, "group").join(above.select("group", "subroot"), "group")
    out = out.select(
        F.col("node.id").alias(id_col), F.col("node.digest").alias("leaf"), "subroot", F.lit(top["root"] if top else None).cast("string").alias("root"),
        F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256).alias("proof_sha256"),
        "path", fold(F.col("node.current"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Repair rounds: translation requests as a work queue in tables.

A request names a range of units (or of segments) of one media and the context around it, and carries
them along.  Every generation of requests meets its replies by (media_id, request); those whose reply does not fit
become the next generation: halves of the range, then the segments of a single unit, then
halves of these.  A single segment that fails keeps its source text.  Ranges at least halve, so there are about
log2(units of a batch) + log2(parts of a unit) + 2 generations, each one join over what still fails.

Request names spell the way from the batch: ``7`` is a batch, ``7/0`` and ``7/1`` its halves, ``7/1/s`` the segments
of what has come down to one unit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import replies as rp
from cuesheet.functions import times as tm
from cuesheet.functions.text import let
from cuesheet.operators import translate as tn
from cuesheet.ordering import Ordered, arrange
from cuesheet.session import materialise

REQUEST = ["media_id", "request", "generation", "kind", "unit_lo", "unit_hi", "lo", "hi", "context_lo", "context_hi"]
HALF_CONTEXT = 2  # segments of context that a half keeps on each side
UNITS, SEGMENTS = "units", "segments"
DONE, SPLIT, SOURCE = "done", "split", "source"

Model = Callable[[DataFrame], DataFrame]


def first_requests(units: Ordered, context: int = tn.CONTEXT) -> DataFrame:
    """Generation 0: one request per batch of ``assign_batches``, with all that it and its halves may send.

    ``items`` are the segments from ``context_lo`` to ``context_hi``, ``heads`` the units without their parts (``lo`` and ``n`` tell where these
    are in ``items``).  A batch bounds both, so no later generation has to look up segments or units again.
    """
    head = F.struct(
        F.col("unit_id").alias("id"), "speaker", tm.seconds(F.col("start_ms")).alias("start"), tm.seconds(F.col("end_ms")).alias("end"), "text",
        "lo", F.size("parts").alias("n"),
    )
    packed = F.array_sort(F.collect_list(F.struct("unit_no", head.alias("h"), "parts")))
    batches = units.df.groupBy(*units.keys, "batch_no").agg(
        F.min("lo").alias("lo"), (F.max("hi") + 1).alias("hi"), F.min("unit_no").alias("unit_lo"), (F.max("unit_no") + 1).alias("unit_hi"), packed.alias("_u")
    )
    batches = batches.select("*", F.transform("_u", lambda x: x["h"]).alias("heads"), F.flatten(F.transform("_u", lambda x: x["parts"])).alias("own")).drop("_u")
    o = arrange(batches, units.keys, ("batch_no",), like=units)
    if context:
        # A batch has one segment at least, so that many batches on each side have the context.
        from_start, from_end = F.slice("own", 1, context), _last(F.col("own"), context)
        near = {
            "_before": lambda w: F.collect_list(from_end).over(w.rowsBetween(-context, -1)),
            "_after": lambda w: F.collect_list(from_start).over(w.rowsBetween(1, context)),
        }
        o = o.local(near, before=context, after=context)
        o = o.with_columns({"_before": _last(F.flatten("_before"), context), "_after": F.slice(F.flatten("_after"), 1, context)})
    else:
        o = o.with_columns({name: F.slice("own", 1, 0) for name in ("_before", "_after")})
    return o.df.select(
        "media_id", F.col("batch_no").cast("string").alias("request"), F.lit(0).alias("generation"), F.lit(UNITS).alias("kind"), "unit_lo", "unit_hi", "lo", "hi",
        (F.col("lo") - F.size("_before")).alias("context_lo"), (F.col("hi") + F.size("_after")).alias("context_hi"),
        F.concat("_before", "own", "_after").alias("items"), "heads",
    )


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n, F.lit(0)) + 1, n)


def _between(lo: str, hi: str) -> Column:
    """The segments of a range of positions, from ``items``."""
    return F.slice("items", (F.col(lo) - F.col("context_lo") + 1).cast("int"), (F.col(hi) - F.col(lo)).cast("int"))


def _parts(head: Column) -> Column:
    return F.slice("items", (head["lo"] - F.col("context_lo") + 1).cast("int"), head["n"])


def payload() -> Column:
    """The request body: context before, items (units, or plain segments where every unit has one), context after."""
    rich = F.transform("heads", lambda h: F.struct(*[h[c].alias(c) for c in ("id", "speaker", "start", "end", "text")], _parts(h).alias("parts")))
    items = F.when(_plain(), F.to_json(_between("lo", "hi"))).otherwise(F.to_json(rich))
    before, after = F.to_json(_between("context_lo", "lo")), F.to_json(_between("hi", "context_hi"))
    return F.concat(F.lit('{"context_before":'), before, F.lit(',"items":'), items, F.lit(',"context_after":'), after, F.lit("}"))


def _plain() -> Column:
    """Whether a request lists segments: by kind, or because each of its units has one."""
    return (F.col("kind") == SEGMENTS) | (F.col("hi") - F.col("lo") == F.col("unit_hi") - F.col("unit_lo"))


def judge(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests with ``texts`` (one translation per segment; null if the reply does not fit) and ``outcome``.

    A list of segments fits by its number of items; a single segment takes the first of several.
    A list of units fits if every item fits the parts of its unit.  No reply does not fit.
    """
    key = ["media_id", "request"]
    asked = F.when(F.col("kind") == UNITS, F.col("unit_hi") - F.col("unit_lo")).otherwise(F.col("hi") - F.col("lo"))
    read = requests.join(replies.select(*key, "content"), key, "left").withColumn("told", rp.reply_items(F.col("content"))).withColumn("n", asked)
    single = (F.col("kind") == SEGMENTS) & (F.col("n") == 1) & (F.size("told") > 1)
    fits = F.coalesce((F.size("told") == F.col("n")) | single, F.lit(False))
    listed = F.transform(F.slice("told", F.lit(1), F.col("n").cast("int")), lambda x: rp.item_text(x, plain_null="None"))
    by_unit = F.zip_with("told", "heads", lambda item, h: rp.unit_parts(item, F.transform(_parts(h), lambda s: s["id"])))
    aligned = let(by_unit, lambda g: F.when(F.forall(g, lambda t: t.isNotNull()), F.flatten(g)))
    out = read.withColumn("texts", F.when(fits, F.when(_plain(), listed).otherwise(aligned)))
    last = (F.col("kind") == SEGMENTS) & (F.col("hi") - F.col("lo") == 1)
    outcome = F.when(F.col("texts").isNotNull(), DONE).when(last, SOURCE).otherwise(SPLIT)
    return out.select(*REQUEST, "items", "heads", "texts", outcome.alias("outcome"))


def next_requests(judged: DataFrame) -> DataFrame:
    """The next generation: halves of what failed with more than one unit (segment), the segments of what failed with one unit."""
    failed = judged.filter(F.col("outcome") == SPLIT)
    by_unit = F.col("kind") == UNITS
    many = by_unit & (F.col("unit_hi") - F.col("unit_lo") > 1)
    half = lambda lo, hi: (F.col(lo) + F.greatest(F.lit(1), F.expr(f"({hi} - {lo}) div 2"))).cast("bigint")
    failed = failed.withColumn("mid", F.when(many, half("unit_lo", "unit_hi")))
    at = F.when(many, F.get("heads", (F.col("mid") - F.col("unit_lo")).cast("int"))["lo"]).otherwise(half("lo", "hi"))
    failed = failed.withColumn("at", at)

    def child(name: str, kind: Column, unit_lo: Column, unit_hi: Column, lo: Column, hi: Column, context_lo: Column, context_hi: Column) -> Column:
        values = [F.concat("request", F.lit(name)), kind, unit_lo, unit_hi, lo, hi, context_lo, context_hi]
        return F.struct(*[v.alias(n) for n, v in zip(["request", "kind", *REQUEST[4:]], values)])

    low = lambda x: F.greatest("context_lo", x - HALF_CONTEXT)
    high = lambda x: F.least("context_hi", x + HALF_CONTEXT)
    c = F.col
    unit_mid_hi, unit_mid_lo = F.when(many, c("mid")).otherwise(c("unit_hi")), F.when(many, c("mid")).otherwise(c("unit_lo"))
    halves = F.array(
        child("/0", c("kind"), c("unit_lo"), unit_mid_hi, c("lo"), c("at"), low(c("lo")), high(c("at"))),
        child("/1", c("kind"), unit_mid_lo, c("unit_hi"), c("at"), c("hi"), low(c("at")), high(c("hi"))),
    )
    alone = F.array(child("/s", F.lit(SEGMENTS), c("unit_lo"), c("unit_hi"), c("lo"), c("hi"), c("context_lo"), c("context_hi")))
    children = failed.select(
        "media_id", (c("generation") + 1).alias("generation"), "items", "heads", c("context_lo").alias("_from"), c("unit_lo").alias("_unit"),
        F.explode(F.when(by_unit & ~many, alone).otherwise(halves)).alias("c"),
    )
    cut = lambda name, lo, hi, base: F.slice(name, (c(f"c.{lo}") - c(base) + 1).cast("int"), (c(f"c.{hi}") - c(f"c.{lo}")).cast("int")).alias(name)
    return children.select(
        "media_id", "c.request", "generation", "c.kind", *[f"c.{n}" for n in REQUEST[4:]],
        cut("items", "context_lo", "context_hi", "_from"), cut("heads", "unit_lo", "unit_hi", "_unit"),
    )


def repair_rounds(parts: Ordered, units: Ordered, model: Model | DataFrame, context: int = tn.CONTEXT) -> tuple[DataFrame, DataFrame]:
    """All generations of requests: (every request with ``payload`` and ``outcome``, translations (media_id, pos, translation)).

    ``model`` takes requests with payloads and returns (media_id, request, content), or is a table of all replies.
    Each generation is written once, without payloads, which follow from ``items``; the driver only asks whether anything is left.
    """
    requests, log = materialise(first_requests(units, context)), []
    while True:
        replies = model(requests.select(*REQUEST, payload().alias("payload"))) if callable(model) else model
        judged = materialise(judge(requests, replies))
        log.append(judged)
        if judged.filter(F.col("outcome") == SPLIT).isEmpty():
            break
        requests = next_requests(judged)
    every = log[0]
    for more in log[1:]:
        every = every.unionByName(more)
    said = every.filter(F.col("outcome") == DONE).select("media_id", "lo", F.posexplode("texts").alias("_k", "translation"))
    return every.select(*REQUEST, "outcome", payload().alias("payload")), said.select("media_id", (F.col("lo") + F.col("_k")).alias("pos"), "translation")

"""Translation around an external model: plan units and batches, check and apply replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions import replies as rp
from cuesheet.functions import text as tx
from cuesheet.functions import times as tm
from cuesheet.functions import translation as tl
from cuesheet.operators.segments import number_id
from cuesheet.ordering import POS, Ordered, arrange

MAX_GAP_MS, MAX_PARTS, MAX_CHARS = 1200, 4, 260
BATCH = 18
CONTEXT = 2


REASON = "_reason"


def with_skip_reasons(o: Ordered) -> Ordered:
    """The reasons as a column, for flows that ask for them several times and write the rows before."""
    return o.with_columns({REASON: tl.skip_reason(F.col("text"))})


def _reason(o: Ordered) -> Column:
    return F.col(REASON) if REASON in o.df.columns else tl.skip_reason(F.col("text"))


def collect_skips(o: Ordered) -> DataFrame:
    """Rows left out before translation, with the reason."""
    df = o.df.withColumn("reason", _reason(o)).filter(F.col("reason").isNotNull())
    return df.select(
        "media_id", (F.col(POS) + 1).alias("idx"), "id", "start_ms", "end_ms", F.lit("pretranslation_skip").alias("type"), "reason",
        F.substring("text", 1, 240).alias("text"),
    )


def without_skips(o: Ordered) -> Ordered:
    """The rows to translate, renumbered; ``idx`` still names the source row."""
    return arrange(o.df.withColumn("idx", F.col(POS) + 1).filter(_reason(o).isNull()).drop(REASON), o.keys, ("idx",), like=o)


def _unit_step(max_parts: int, max_chars: int):
    width = max_chars + 2

    def step(state, joins, gap, chars):
        parts, length = divmod(state, width)
        if state and joins and parts < max_parts and length + gap + chars <= max_chars:
            return (parts + 1) * width + length + gap + chars, 0
        if chars == 0:  # a blank row is a unit of its own and nothing joins it
            return 0, 1
        return width + min(chars, max_chars + 1), 1

    return step


def assign_units(
    o: Ordered, *, max_gap_ms: int = MAX_GAP_MS, max_parts: int = MAX_PARTS, max_chars: int = MAX_CHARS, semantic: bool = True
) -> Ordered:
    """Add ``unit_no`` (0-based): neighbours of one speaker that belong to one sentence."""
    if not semantic:
        return o.with_columns({"unit_no": F.col(POS)})
    bare = tx.strip(F.coalesce("text", F.lit("")))
    o = o.with_columns({"_bare": bare})
    o = o.local(
        {
            "_pe": lambda w: F.lag("end_ms").over(w),
            "_ps": lambda w: F.lag("speaker").over(w),
            "_pt": lambda w: F.lag("_bare").over(w),
        },
        before=1,
    )
    joins = (
        (F.col("_ps") == F.col("speaker"))
        & (F.col("start_ms") - F.col("_pe") <= max_gap_ms)
        & (F.length("_pt") > 0)
        & (F.length("_bare") > 0)
        & ~tx.ends_sentence(F.col("_pt"))
    )
    o = o.fold(
        "_opens",
        {
            "joins": F.coalesce(joins, F.lit(False)),
            "gap": F.coalesce(F.length(tx.subtitle_separator(F.col("_pt"), F.col("_bare"))), F.lit(0)),
            "chars": F.least(F.length("_bare"), F.lit(max_chars + 1)),
        },
        _unit_step(max_parts, max_chars),
        states=(max_parts + 1) * (max_chars + 2),
    )
    o = o.running({"_n": ("sum", F.col("_opens").cast("bigint"))})
    return o.of(o.df.withColumn("unit_no", F.col("_n") - 1).drop("_bare", "_pe", "_ps", "_pt", "_opens", "_n"))


def segment_item() -> Column:
    return F.struct(
        "id", "speaker", tm.seconds(F.col("start_ms")).alias("start"), tm.seconds(F.col("end_ms")).alias("end"), "text"
    )


def units_of(parts: Ordered) -> Ordered:
    """One row per unit with its parts in order (at most ``max_parts``)."""
    packed = F.array_sort(F.collect_list(F.struct(POS, segment_item().alias("s"))))
    units = parts.df.groupBy(*parts.keys, "unit_no").agg(
        F.min(POS).alias("lo"), F.max(POS).alias("hi"), F.min_by("speaker", POS).alias("speaker"), F.min_by("start_ms", POS).alias("start_ms"),
        F.max_by("end_ms", POS).alias("end_ms"), packed.alias("_p"),
    )
    items = F.transform("_p", lambda x: x["s"])
    units = units.withColumn("parts", items).withColumn("text", tx.join_subtitle_parts(F.transform("parts", lambda s: s["text"]))).drop("_p")
    units = units.withColumn("unit_id", number_id(F.col("unit_no") + 1, "unit_"))
    return arrange(units, parts.keys, ("unit_no",), like=parts)


def _batch_step(size: int):
    def step(held, parts):
        if held and held + parts <= size:
            return held + parts, 0
        return min(parts, size), 1

    return step


def assign_batches(units: Ordered, batch_size: int = BATCH) -> Ordered:
    """Add ``batch_no`` (0-based): units packed in order up to ``batch_size`` parts."""
    size = max(1, batch_size)
    o = units.fold("_opens", {"parts": F.greatest(F.size("parts"), F.lit(1))}, _batch_step(size), states=size + 1)
    o = o.running({"_n": ("sum", F.col("_opens").cast("bigint"))})
    return o.of(o.df.withColumn("batch_no", F.col("_n") - 1).drop("_opens", "_n"))


def batch_ranges(units: Ordered, context: int = CONTEXT) -> DataFrame:
    """One row per batch: its units, its segment range and the range of its context (half-open)."""
    counted = units.df.groupBy("media_id", "batch_no").agg(
        F.min("lo").alias("lo"), (F.max("hi") + 1).alias("hi"), F.min("unit_no").alias("unit_lo"), (F.max("unit_no") + 1).alias("unit_hi")
    )
    ends = units.df.groupBy("media_id").agg((F.max("hi") + 1).alias("_n"))
    out = counted.join(ends, "media_id")
    return out.select(
        "media_id", "batch_no", "lo", "hi", "unit_lo", "unit_hi", F.greatest(F.col("lo") - context, F.lit(0)).alias("context_lo"),
        F.least(F.col("hi") + context, "_n").alias("context_hi"),
    )


def payloads(parts: Ordered, units: Ordered, context: int = CONTEXT) -> DataFrame:
    """Request body per batch: context before, items, context after.

    The context of a batch is read at its first and last row with a bounded frame.
    """
    o = parts.with_columns({"_item": segment_item()})
    o = o.local(
        {
            "_before": lambda w: F.collect_list("_item").over(w.rowsBetween(-context, -1)) if context else F.array().cast("array<string>"),
            "_after": lambda w: F.collect_list("_item").over(w.rowsBetween(1, context)) if context else F.array().cast("array<string>"),
        },
        before=context,
        after=context,
    )
    item = F.struct(
        F.col("unit_id").alias("id"), "speaker", tm.seconds(F.col("start_ms")).alias("start"), tm.seconds(F.col("end_ms")).alias("end"), "text", "parts"
    )
    packed = F.array_sort(F.collect_list(F.struct("unit_no", item.alias("u"))))
    batches = units.df.groupBy("media_id", "batch_no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), packed.alias("_u"))
    edge = o.df.select(F.col("media_id").alias("_m"), F.col(POS).alias("_p"), "_before", "_after")
    out = batches.join(edge.select("_m", "_p", "_before"), (F.col("media_id") == F.col("_m")) & (F.col("lo") == F.col("_p"))).drop("_m", "_p")
    out = out.join(edge.select("_m", "_p", "_after"), (F.col("media_id") == F.col("_m")) & (F.col("hi") == F.col("_p"))).drop("_m", "_p")
    single = F.forall("_u", lambda x: F.size(x["u"]["parts"]) == 1)
    plain = F.to_json(F.transform("_u", lambda x: x["u"]["parts"][0]))
    rich = F.to_json(F.transform("_u", lambda x: x["u"]))
    body = F.concat(
        F.lit('{"context_before":'), F.to_json("_before"), F.lit(',"items":'), F.when(single, plain).otherwise(rich),
        F.lit(',"context_after":'), F.to_json("_after"), F.lit("}"),
    )
    return out.select("media_id", "batch_no", F.size("_u").cast("bigint").alias("units"), body.alias("payload"))


def read_replies(units: Ordered, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies (media_id, batch_no, content) -> (translations per part, failed batches).

    A batch fails when its reply is no list, has the wrong number of items, or an item
    does not fit the parts of its unit.
    """
    sizes = units.df.groupBy("media_id", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.min("unit_no").alias("_first"))
    read = sizes.join(replies, ["media_id", "batch_no"], "left").withColumn("items", rp.reply_items(F.col("content")))
    usable = F.coalesce(F.size("items") == F.col("n"), F.lit(False))
    items = read.filter(usable).select("media_id", "batch_no", "_first", F.posexplode("items").alias("_at", "item"))
    items = items.select("media_id", "batch_no", (F.col("_first") + F.col("_at")).alias("unit_no"), "item")
    parts = units.df.select("media_id", "batch_no", "unit_no", "lo", "parts").join(items, ["media_id", "batch_no", "unit_no"])
    parts = parts.withColumn("texts", rp.unit_parts(F.col("item"), F.transform("parts", lambda s: s["id"]))).drop("item")
    misfit = parts.filter(F.col("texts").isNull()).select("media_id", "batch_no").distinct()
    failed = read.filter(~usable).select("media_id", "batch_no").unionByName(misfit)
    good = parts.join(misfit, ["media_id", "batch_no"], "left_anti")
    good = good.select("media_id", "lo", F.posexplode("texts").alias("_k", "translation"))
    return good.select("media_id", (F.col("lo") + F.col("_k")).alias("pos"), "translation"), failed


def split_failed(batches: DataFrame, failed: DataFrame, units: Ordered) -> tuple[DataFrame, DataFrame]:
    """One repair round: failed batches of several units -> two halves with new context.

    Failed batches of one unit cannot shrink; they are returned apart, to be retried by
    segment or kept as source.  Children carry ``batch_no`` ``2n+1`` and ``2n+2`` of a
    tree whose first level is the negative of the parent, so numbers never clash.
    """
    bad = batches.join(failed, ["media_id", "batch_no"])
    many = F.col("unit_hi") - F.col("unit_lo") > 1
    middle = F.col("unit_lo") + F.greatest(F.lit(1), F.floor((F.col("unit_hi") - F.col("unit_lo")) / 2))
    cut = bad.filter(many).withColumn("unit_no", middle.cast("bigint"))
    cut = cut.join(units.df.select("media_id", "unit_no", F.col("lo").alias("at")), ["media_id", "unit_no"])
    left = F.struct(
        F.lit(0).cast("bigint").alias("half"), "lo", F.col("at").alias("hi"), "unit_lo", F.col("unit_no").alias("unit_hi"),
        F.greatest("context_lo", F.col("lo") - 2).alias("context_lo"), F.least("context_hi", F.col("at") + 2).alias("context_hi"),
    )
    right = F.struct(
        F.lit(1).cast("bigint").alias("half"), F.col("at").alias("lo"), "hi", F.col("unit_no").alias("unit_lo"), "unit_hi",
        F.greatest("context_lo", F.col("at") - 2).alias("context_lo"), F.least("context_hi", F.col("hi") + 2).alias("context_hi"),
    )
    halves = cut.select("media_id", F.col("batch_no").alias("parent_no"), F.explode(F.array(left, right)).alias("h")).select("media_id", "parent_no", "h.*")
    return halves, bad.filter(~many).select("media_id", "batch_no", "lo", "hi")


def apply_translations(o: Ordered, translations: DataFrame, mode: str = "replace") -> DataFrame:
    """translations (media_id, idx, translation) onto segments; missing or unusable ones keep the source."""
    return translated(o.df.withColumn("idx", F.col(POS) + 1).join(translations.select("media_id", "idx", "translation"), ["media_id", "idx"], "left"), mode)


def translated(df: DataFrame, mode: str = "replace") -> DataFrame:
    """Segments beside their ``translation`` -> segments with it."""
    cleaned = tl.clean_translation(F.coalesce("translation", "text"), F.col("text"))
    cleaned = F.when(F.length(cleaned) == 0, F.col("text")).otherwise(cleaned)
    if mode == "bilingual":
        same = tx.strip(cleaned) == tx.strip(F.col("text"))
        cleaned = F.when(same, cleaned).otherwise(F.concat(cleaned, F.lit("\n"), "text"))
    return df.select("media_id", "idx", "id", "start_ms", "end_ms", "speaker", cleaned.alias("text"))


def validate_translations(o: Ordered, translations: DataFrame) -> DataFrame:
    """Issue rows; per translation the first matching rule, and a count mismatch per media."""
    source = o.df.select("media_id", (F.col(POS) + 1).alias("idx"), "id", "start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("source"), F.lit(True).alias("has"))
    given = translations.select("media_id", "idx", tx.strip(F.coalesce("translation", F.lit(""))).alias("value"))
    both = source.join(given, ["media_id", "idx"], "full_outer")
    counts = both.groupBy("media_id").agg(F.count("has").alias("expected"), F.count("value").alias("actual"))
    nothing = lambda t: F.lit(None).cast(t)
    mismatch = counts.filter("expected <> actual").select(
        "media_id", F.lit("count_mismatch").alias("type"), nothing("bigint").alias("idx"), nothing("string").alias("id"), nothing("bigint").alias("start_ms"),
        nothing("bigint").alias("end_ms"), nothing("string").alias("source_text"), nothing("string").alias("text"), "expected", "actual",
    )
    return _issues(both).unionByName(mismatch)


def issues_of(every: DataFrame) -> DataFrame:
    """The issues of segments (numbered by ``idx``) that stand beside their ``translation``: as ``validate_translations`` where none lacks it."""
    source = every.select("media_id", "idx", "id", "start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("source"), F.lit(True).alias("has"),
                          tx.strip(F.coalesce("translation", F.lit(""))).alias("value"))
    return _issues(source)


def _issues(both: DataFrame) -> DataFrame:
    long = F.coalesce(F.col("has"), F.lit(False)) & tl.is_suspicious(F.col("source"), F.col("value"))
    filled = F.length("value") > 0
    kind = (
        F.when(filled & tl.has_artifact(F.col("value")), "model_artifact")
        .when(filled & tl.is_json_fragment(F.col("value")), "json_fragment")
        .when(long, "suspicious_expansion")
        .when(~filled & (F.length(tx.strip(F.col("source"))) > 0), "empty_translation")
    )
    rows = both.filter(F.col("value").isNotNull()).withColumn("type", kind).filter(F.col("type").isNotNull())
    return rows.select(
        "media_id", "type", "idx", F.coalesce("id", F.lit("")).alias("id"), "start_ms", "end_ms",
        F.substring(F.coalesce("source", F.lit("")), 1, 240).alias("source_text"),
        F.when(F.col("type") != "empty_translation", F.substring("value", 1, 240)).alias("text"),
        F.when(F.col("type") == "suspicious_expansion", F.length(tx.strip(F.col("source")))).cast("bigint").alias("expected"),
        F.when(F.col("type") == "suspicious_expansion", F.length("value")).cast("bigint").alias("actual"),
    )


# Labels shown for review items.
LABELS = {
    "count_mismatch": "数量不一致", "model_artifact": "模型副产物", "json_fragment": "JSON 残片", "suspicious_expansion": "译文异常变长",
    "empty_translation": "空译文", "empty": "空字幕", "known_transcript_noise": "已知转写噪声", "bracketed_effect": "括号音效", "too_short": "过短",
    "short_code_or_noise": "短代码/噪声", "repeated_chant": "重复 chant", "filler_noise": "语气噪声",
}


def review_list(issues: DataFrame, skips: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """Issues and skips in one list with severity, label and a stable key."""
    from cuesheet.operators.intervals import without_dismissed

    nothing = F.lit(None).cast("string")
    a = issues.select("media_id", F.lit("issue").alias("group"), F.lit("warning").alias("severity"), "type", "idx", "id", "start_ms",
                      F.coalesce(F.when(F.length("text") > 0, F.col("text")), "source_text", F.lit("")).alias("text"), nothing.alias("reason"))
    b = skips.select("media_id", F.lit("skip").alias("group"), F.lit("info").alias("severity"), "type", "idx", "id", "start_ms", "text", "reason")
    items = a.unionByName(b)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    items = items.withColumn("key", F.concat_ws(":", "group", text("id"), text("idx"), text("reason"))).withColumn(
        "label", F.coalesce(labels[F.coalesce("reason", "type")], "reason", "type")
    )
    return items if dismissed is None else without_dismissed(items, dismissed)


def first_per_media(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first rows per media; Spark trims every task before the shuffle."""
    w = Window.partitionBy("media_id").orderBy(F.col(order).asc_nulls_first())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def translation_report(o: Ordered, skips: DataFrame, issues: DataFrame, *, skip_rows: int = 50, issue_rows: int = 20) -> DataFrame:
    """Per media: counts and the first skips and issues."""
    total = o.df.groupBy("media_id").agg(F.count(F.lit(1)).alias("segments"))
    count = lambda df, name: df.groupBy("media_id").agg(F.count(F.lit(1)).alias(name))
    listed = lambda df, n, name: first_per_media(df, "idx", n).groupBy("media_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "what"))), lambda x: x["what"]), ",").alias(name)
    )
    tag = lambda df, c: df.select("media_id", "idx", F.concat_ws(":", F.coalesce(F.col("idx").cast("string"), F.lit("-")), c).alias("what"))
    out = total
    for part in (
        count(skips, "skip_count"), count(issues, "issue_count"), listed(tag(skips, "reason"), skip_rows, "skips"), listed(tag(issues, "type"), issue_rows, "issues")
    ):
        out = out.join(part, "media_id", "left")
    return out.fillna(0, ["skip_count", "issue_count"]).fillna("", ["skips", "issues"])


def report_rows(skips: DataFrame, issues: DataFrame, *, skip_rows: int = 50, issue_rows: int = 50) -> DataFrame:
    """The rows a report lists, in order: (media_id, part, n, idx, id, start_ms, end_ms, type, reason, source_text, text, expected, actual)."""
    nothing = lambda t: F.lit(None).cast(t)
    a = first_per_media(skips, "idx", skip_rows).select(
        "media_id", F.lit("skips").alias("part"), "idx", "id", "start_ms", "end_ms", "type", "reason", nothing("string").alias("source_text"), "text",
        nothing("bigint").alias("expected"), nothing("bigint").alias("actual"),
    )
    b = first_per_media(issues, "idx", issue_rows).select(
        "media_id", F.lit("issues").alias("part"), "idx", "id", "start_ms", "end_ms", "type", nothing("string").alias("reason"), "source_text", "text", "expected", "actual"
    )
    w = Window.partitionBy("media_id", "part").orderBy(F.col("idx").asc_nulls_first())
    return a.unionByName(b).withColumn("n", F.row_number().over(w).cast("bigint"))


def report_json(o: Ordered, skips: DataFrame, issues: DataFrame, files: DataFrame, *, mode: str = "replace", skip_rows: int = 50, issue_rows: int = 50) -> DataFrame:
    """(media_id, json): counts, the first skips and issues as objects, and the files written.

    ``files``: media_id, name, path.  Null fields are left out of an object; row numbers count from 0, times are seconds.
    """
    rows = report_rows(skips, issues, skip_rows=skip_rows, issue_rows=issue_rows)
    item = F.to_json(F.struct(
        "type", (F.col("idx") - 1).alias("index"), "id", tm.seconds(F.col("start_ms")).alias("start"), tm.seconds(F.col("end_ms")).alias("end"), "reason",
        "source_text", "text", "expected", "actual",
    ))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("j")))), lambda x: x["j"]), ",")  # at most skip_rows or issue_rows
    rows = rows.groupBy("media_id", "part").agg(listed.alias("list"))
    count = lambda df, name: df.groupBy("media_id").agg(F.count(F.lit(1)).alias(name))
    part = lambda name: rows.filter(F.col("part") == name).select("media_id", F.col("list").alias(name))
    paths = files.groupBy("media_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "path"))))).alias("files"))
    out = count(o.df, "segments")
    for more in (count(skips, "n_skips"), count(issues, "n_issues"), part("skips"), part("issues"), paths):
        out = out.join(more, "media_id", "left")
    out = out.fillna(0, ["n_skips", "n_issues"]).fillna("", ["skips", "issues"]).fillna("{}", ["files"])
    text = F.concat(
        F.lit(f'{{"mode":"{mode}","segments":'), "segments", F.lit(',"pretranslation_skip_count":'), "n_skips", F.lit(',"pretranslation_skips":['), "skips",
        F.lit('],"validation_issue_count":'), "n_issues", F.lit(',"validation_issues":['), "issues", F.lit('],"files":'), "files", F.lit("}"),
    )
    return out.select("media_id", text.alias("json"))


def progress(done: Column, total: Column) -> tuple[Column, Column]:
    """(percent with one decimal, job progress 0.95..0.99)."""
    ratio = F.when(total <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / total)))
    return tm.round_to(ratio * 100, 1), F.lit(0.95) + F.lit(0.04) * ratio


def plan(o: Ordered, *, batch_size: int = BATCH, semantic: bool = True) -> tuple[Ordered, Ordered]:
    """Skips out, units, batches: (parts with unit_no, units with batch_no)."""
    parts = assign_units(without_skips(o), semantic=semantic)
    return parts, assign_batches(units_of(parts), batch_size)

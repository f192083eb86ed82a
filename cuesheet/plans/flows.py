"""Whole flows, composed of operators; steps that several consumers read are written once while the flow is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.operators import clips as cl
from cuesheet.operators import repair as rq
from cuesheet.operators import segments as sg
from cuesheet.operators import speakers as sp
from cuesheet.operators import translate as tn
from cuesheet.ordering import POS, Ordered, arrange
from cuesheet.session import materialise
from cuesheet.sinks import ass as ass_sink
from cuesheet.sinks import subtitles as sb
from cuesheet.sources.transcripts import parse_transcripts


def transcripts_to_segments(texts: DataFrame, *, postprocess: bool = True, **options) -> Ordered:
    """Compact texts -> numbered segments, optionally normalised."""
    parsed = parse_transcripts(texts)
    if postprocess:
        return sg.normalize(parsed, **options)
    return arrange(sg.coerce_segments(parsed.selectExpr("*", "cast(null as string) id")))


def label_and_export(texts: DataFrame, turns: DataFrame, *, style: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transcripts -> segments without repeated phrases -> speakers from turns -> (json, srt, ass) texts."""
    o = transcripts_to_segments(texts, postprocess=False)
    kept = sg.drop_repeated_phrases(o)
    o = sp.label_from_turns(arrange(kept, like=o), turns)
    return sb.export_json(o), sb.export_srt(o, show_speaker=bool((style or {}).get("show_speaker"))), ass_sink.export_ass(o, style)


def translate_run(o: Ordered, model: rq.Model | DataFrame, *, mode: str = "bilingual", batch_size: int = tn.BATCH, context: int = tn.CONTEXT) -> dict[str, DataFrame]:
    """Skips out, units, batches, rounds of requests until every segment is answered or kept, checks, application, report.

    ``model`` as for ``repair_rounds``.  Gives ``segments``, ``requests``, ``skips``, ``issues``, ``report`` and ``report_rows``.  As in a run with
    a live model, every segment ends with a text: skipped and unanswered ones count as translated by their source.
    """
    o = tn.with_skip_reasons(o)
    o = o.of(materialise(o.df))
    parts = tn.assign_units(tn.without_skips(o))
    parts = parts.of(materialise(parts.df))
    requests, said = rq.repair_rounds(parts, tn.assign_batches(tn.units_of(parts), batch_size), model, context)
    back = parts.df.select("media_id", "idx", F.col(POS).alias("pos")).join(said, ["media_id", "pos"]).select("media_id", "idx", "translation")
    every = o.with_columns({"idx": F.col(POS) + 1}).df.join(back, ["media_id", "idx"], "left")
    every = materialise(every.withColumn("translation", F.coalesce("translation", "text", F.lit(""))))
    skips, issues = materialise(tn.collect_skips(o)), materialise(tn.issues_of(every))
    return {
        "segments": tn.translated(every, mode), "requests": requests, "skips": skips, "issues": issues,
        "report": tn.translation_report(o, skips, issues), "report_rows": tn.report_rows(skips, issues),
    }


def translate_and_cut(o: Ordered, model: rq.Model | DataFrame, *, mode: str = "bilingual", min_clip_ms: int = 60_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A translate run and clips of its result: (segments, report, clips)."""
    run = translate_run(o, model, mode=mode)
    return run["segments"], run["report"], cl.clip_candidates(arrange(run["segments"], like=o), min_ms=min_clip_ms)

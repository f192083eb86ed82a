"""Speaker labelling of whole media: which way each takes, its labels, and an account per media."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.operators import speakers as sp
from cuesheet.ordering import Ordered, arrange
from cuesheet.session import materialise

OFF = ("off", "none", "disabled")
TURNS, CLUSTER = "turns", "cluster"
# The reasons that callers read.
DISABLED, FEW, LABELLED = "disabled", "too few segments", "speaker labels already exist"
NO_TURNS, UNVOICED, SINGLE = "no speaker turns returned", "not enough voiced audio", "single speaker estimated"


class Labelled(NamedTuple):
    segments: Ordered
    outcomes: DataFrame


def _turns_way(have: Column, error: Column) -> tuple[Column, Column]:
    """(whether the labels are taken, else the reason) of the turns."""
    return error.isNull() & have, F.when(error.isNotNull(), error).when(~have, F.lit(NO_TURNS))


def plan_labelling(status: DataFrame, turns: DataFrame, labels: DataFrame, failures: DataFrame, backend: str = "auto") -> DataFrame:
    """The way of every media: (media_id, way, enabled, applied, backend, speakers, segments, reason, fallback).

    ``way`` is ``turns``, ``cluster``, ``single`` (all rows are S01) or ``keep`` (rows stay as they are); ``speakers`` is null where only the labelled
    rows can tell.  See ``label_speakers`` for the inputs and rules.
    """
    backend = (backend or "auto").lower()
    off, null = backend in OFF, F.lit(None).cast("string")
    failed = lambda kind: failures.filter(F.col("backend") == kind).groupBy("media_id").agg(F.min(F.coalesce("error", F.lit(""))).alias(f"_{kind}_error"))
    usable = turns.filter("turn_end_ms > turn_start_ms").groupBy("media_id").agg(F.lit(True).alias("_turns"))
    groups = labels.filter("label is not null").groupBy("media_id").agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct("label").alias("_labels"))
    df = status.select("media_id", "segments", "existing")
    for side in (usable, groups, failed(TURNS), failed(CLUSTER)):
        df = df.join(side, "media_id", "left")

    turns_fine, turns_reason = _turns_way(F.coalesce("_turns", F.lit(False)), F.col("_turns_error"))
    rows = F.coalesce("_rows", F.lit(0))
    cluster_error = F.col("_cluster_error")
    cluster_way = F.when(cluster_error.isNotNull() | (rows < sp.MIN_ROWS), "keep").when(F.col("_labels") <= 1, "single").otherwise("cluster")
    cluster_reason = F.when(cluster_error.isNotNull(), cluster_error).when(rows < sp.MIN_ROWS, UNVOICED).when(F.col("_labels") <= 1, SINGLE)
    if backend == "auto":  # turns first; clusters only where the turns failed, not where there are none
        by_cluster = F.col("_turns_error").isNotNull()
    else:
        by_cluster = F.lit(backend == CLUSTER)
    known = backend in ("auto", TURNS, CLUSTER)
    way = F.when(by_cluster, cluster_way).when(turns_fine, "turns").otherwise("keep") if known else F.lit("keep")
    reason = F.when(by_cluster, cluster_reason).otherwise(turns_reason) if known else F.lit(f"unsupported backend: {backend}")
    used = F.when(by_cluster, CLUSTER).otherwise(TURNS) if known else F.lit(backend)
    fallback = F.when(by_cluster, F.concat(F.lit("turns failed: "), "_turns_error")) if backend == "auto" else null

    few, several = F.col("segments") < sp.MIN_ROWS, F.col("existing") > 1
    early = few | several if not off else F.lit(True)
    early_reason = F.lit(DISABLED) if off else F.when(few, FEW).otherwise(LABELLED)
    early_speakers = F.lit(0) if off else F.when(few, 1).otherwise(F.col("existing"))
    way = F.when(early, "keep").otherwise(way)
    return df.select(
        "media_id", way.alias("way"), F.lit(not off).alias("enabled"), (way != "keep").alias("applied"), F.when(early, backend).otherwise(used).alias("backend"),
        F.when(early, early_speakers).when(way.isin("keep", "single"), 1).cast("bigint").alias("speakers"), "segments",
        F.when(early, early_reason).otherwise(reason).alias("reason"), F.when(~early, fallback).alias("fallback"),
    )


def label_speakers(o: Ordered, turns: DataFrame, labels: DataFrame, failures: DataFrame, *, backend: str = "auto", enabled: bool = True) -> Labelled:
    """Labels for all media at once, each by the first way that holds, with an account per media.

    ``turns``: media_id, turn_no, turn_start_ms, turn_end_ms, source, of a diarizer.  ``labels``: media_id, idx, label, of clustered features, a row for
    each segment with enough voiced audio (``cluster_labels``).  ``failures``: media_id, backend (``turns`` or ``cluster``), error; of several the least counts.

    Segments without text or duration go.  A media keeps its speakers if labelling is off, if fewer than four segments are left, or if they have
    two speakers already.  ``auto`` takes the turns; where they failed it takes the clusters and says so in ``fallback``.  A media without turns that did not fail
    keeps its speakers, as does one whose chosen way failed or that has fewer than four clustered rows.  One cluster makes all rows S01.

    ``outcomes`` has a row per media of ``o``, also where no segment is left: media_id, enabled, applied, backend, speakers, segments, reason (null if all went well),
    fallback.  The rows are written once, with the way of their media; every way then reads its own.
    """
    live = (F.length("text") > 0) & (F.col("end_ms") > F.col("start_ms"))
    spoken = F.when(live & (F.length("speaker") > 0), F.col("speaker"))
    status = o.df.groupBy("media_id").agg(F.count_if(live).alias("segments"), F.count_distinct(spoken).alias("existing"))
    plan = materialise(plan_labelling(status, turns, labels, failures, backend if enabled else OFF[0]))
    if not enabled:
        plan = plan.withColumn("backend", F.lit((backend or "auto").lower()))

    kept = arrange(o.df.filter(live), ("media_id",), ("idx",), like=o)
    rows = materialise(kept.df.join(plan.select("media_id", F.col("way").alias("_way")), "media_id"))
    part = lambda way: kept.of(rows.filter(F.col("_way") == way).drop("_way"))
    columns = kept.df.columns
    done = [
        part("keep").df,
        part("single").df.withColumn("speaker", F.lit("S01")),
        sp.label_from_turns(part("turns"), turns).df,
        sp.apply_labels(part("cluster"), labels.filter("label is not null")).df,
    ]
    out = done[0].select(columns)
    for other in done[1:]:
        out = out.unionByName(other.select(columns))
    named = materialise(out)
    counts = named.groupBy("media_id").agg(F.count_distinct("speaker").alias("_speakers"))
    outcomes = plan.join(counts, "media_id", "left").withColumn("speakers", F.coalesce("speakers", "_speakers"))
    return Labelled(kept.of(named), outcomes.drop("way", "_speakers"))

"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed; the result is written to the ``noop``
sink, so every column of every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cuesheet.queries import gather
from cuesheet.session import build_session

HEADLINE = [
    "parse_transcripts", "fix_overlaps", "normalize_segments", "drop_repeated_phrases", "export_srt", "flatten_overlaps", "export_ass",
    "visible_at", "snap_edges", "lane_layout", "clip_windows", "clip_candidates", "clip_candidates_documents", "assign_turns", "translation_units",
    "translation_payloads", "translate_with_skips", "validate_translations", "apply_edits", "silhouette", "cluster_speakers",
    "throttle_events", "fold_deltas", "stream_transcripts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 16g pyspark-shell")  # local mode: one JVM does it all
    spark = build_session("cuesheet-bench", master=f"local[{cpus}]", partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = gather("queries")
    warm = os.environ.get("BENCH_WARM_DIR", sf_dir.replace("sf0.1", "sf0.01"))
    times = {}
    for name in names:
        queries[name](spark, warm).write.format("noop").mode("overwrite").save()
        begun = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begun, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total wall-clock of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()

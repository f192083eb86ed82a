"""python -m tests.run_queries <sf> [names...]: compare queries with their SQL twins."""

import sys
import time

from cuesheet.queries import gather
from cuesheet.session import build_session
from tests.harness import compare


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = gather("queries"), gather("oracles")
    sf_dir = f"/root/testdata/{sf}"
    bad = 0
    for name in names or queries:
        begun = time.time()
        try:
            if name in oracles:
                message = compare(spark, name, queries[name], oracles[name], sf_dir)
            else:
                message = None if queries[name](spark, sf_dir).count() else f"{name}: no rows"
        except Exception as exc:  # noqa: BLE001 - report and go on
            message = f"{name}: {type(exc).__name__} {str(exc)[:900]}"
        bad += message is not None
        print(f"{'ok  ' if message is None else 'BAD '} {name} {time.time() - begun:.1f}s {message or ''}", flush=True)
    print(f"{bad} bad")


main()

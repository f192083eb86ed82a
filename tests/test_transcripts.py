"""The transcript grammar: own cases, fuzz against a slow reader, batch and incremental alike."""

import random

from cuesheet.sources.transcripts import parse_transcripts
from cuesheet.streaming.scanner import Scanner
from tests import brute

CASES = {
    "[3.07][S02]Morning all[4.5][20.01][S01]Shall we[21.3]": [(3070, 4500, "S02", "Morning all"), (20010, 21300, "S01", "Shall we")],
    "[7][S03]房间[305]在[12]楼[9.5]": [(7000, 9500, "S03", "房间[305]在[12]楼")],
    "(music) [??][2.2][S04]right[2.9]": [(2200, 2900, "S04", "right")],
    "[10][S01]up[11] \n\n[12][S05]down[13]": [(10000, 11000, "S01", "up"), (12000, 13000, "S05", "down")],
    "[5][S01]late[4] end[6]": [(5000, 6000, "S01", "late[4] end")],
    "[0][S01]open": [],
    "[0][S01]  [1]": [],
    "[0][S01]x[[5]y[6]": [(0, 6000, "S01", "x[[5]y")],
    "[0][5][S01]x[6]": [],
}


def batch(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "media_id bigint, text string")
    out = {i: [] for i in range(len(texts))}
    for r in parse_transcripts(df).orderBy("media_id", "idx").collect():
        out[r.media_id].append((r.start_ms, r.end_ms, r.speaker, r.text))
    return [out[i] for i in range(len(texts))]


def stepwise(text, cuts):
    s, found, at = Scanner(), [], 0
    for cut in [*cuts, len(text)]:
        found += s.feed(text[at:cut])
        at = cut
    found += s.close()
    return [(int(a * 1000 + 0.5), int(b * 1000 + 0.5), c, d) for a, b, c, d in found]


def test_cases(spark):
    assert batch(spark, list(CASES)) == list(CASES.values())
    for text, want in CASES.items():
        assert stepwise(text, range(1, len(text))) == want


def test_fuzz_batch_stream_and_slow_reader_agree(spark):
    rng = random.Random(11)
    bits = ["[1]", "[2.5]", "[3]", "[S01]", "[S02]", "[", "]", "x", " ", "\n", "12", ".", "[.]", "[1.2.3]", "S", "好", "[4][S03]", "[9]"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(1500)]
    got = batch(spark, texts)
    for text, rows in zip(texts, got):
        want = [(int(a * 1000 + 0.5), int(b * 1000 + 0.5), c, d) for a, b, c, d in brute.transcript(text)]
        assert rows == want, text
        cuts = sorted(rng.sample(range(len(text) + 1), k=min(3, len(text))))
        assert stepwise(text, cuts) == want, (text, cuts)

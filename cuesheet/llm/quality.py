"""Quality rules: how much of a text lies in repeated word runs and repeated lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.words import covered, grams, split, texts

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
BASE_RUN, BASE_MIN_WORDS, BASE_MAX_SHARE = 3, 50, 50
#: Greatest share of word characters inside runs of n words that repeat earlier ones, and in such lines.
MAX_RUN_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_SHARE = 0.30
LEAST_CHARS = 0  # no floor in characters: the shares hold for texts of every length
_PIECE = 1 << 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in MAX_RUN_SHARE)]


def _again(hashes: np.ndarray, first_too: bool) -> np.ndarray:
    """Which values occurred before, or if asked which occur twice or more."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    if first_too:
        out[order[:-1][same]] = True
    return out


def measure_all(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row per text with the values of ``COUNTS``; about ``_PIECE`` bytes of texts are held at once."""
    out, a = [np.zeros((0, len(COUNTS)), np.int64)], 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _PIECE, "right")) - 1)
        out.append(measure(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))
        a = b
    return np.concatenate(out)


def measure(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``measure_all`` for texts that fit in memory several times over."""
    start, end, word, first = split(data, bounds)
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))  # code points before each byte
    width = letters[end] - letters[start]
    symbol = np.concatenate(([0], np.cumsum(_SYMBOL[data], dtype=np.int32)))
    breaks = np.flatnonzero(data == 10)
    out = np.zeros((len(bounds) - 1, len(COUNTS)), np.int64)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if a == b:
            out[i, 2] = symbol[bounds[i + 1]] - symbol[bounds[i]]
            continue
        w, chars = word[a:b], width[a:b]
        row = [b - a, chars.sum(), symbol[bounds[i + 1]] - symbol[bounds[i]], 0, 0, 0]
        k = np.searchsorted(breaks, (bounds[i], bounds[i + 1]))
        if k[1] > k[0]:
            row[3], row[5] = _lines(data, np.concatenate(([bounds[i] - 1], breaks[k[0] : k[1]], [bounds[i + 1]])), start[a:b], letters)
        runs = []
        for n in (BASE_RUN, *MAX_RUN_SHARE):
            again = np.flatnonzero(_again(grams(w, n), n == BASE_RUN)) if b - a > n else ()
            runs.append(covered(again, n, b - a) if len(again) else None)
            if not len(again):  # a longer run that repeats holds a shorter one that does
                break
        runs += [None] * (1 + len(MAX_RUN_SHARE) - len(runs))
        row[4] = 0 if runs[0] is None else runs[0].sum()
        out[i] = row + [0 if r is None else chars[r].sum() for r in runs[1:]]
    return out


def _lines(data: np.ndarray, breaks: np.ndarray, starts: np.ndarray, letters: np.ndarray) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their characters."""
    holds = np.diff(np.searchsorted(starts, breaks)) > 0
    seen, n, chars = set(), 0, 0
    for a, b in zip(breaks[:-1][holds] + 1, breaks[1:][holds]):
        line = data[a:b].tobytes()
        if line in seen:
            n += 1
            chars += letters[b] - letters[a]
        seen.add(line)
    return n, chars


def repetition_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``COUNTS``, ``base_failed`` and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``dup_chars_n`` counts the characters of words inside runs of n words
    that occurred before in the text; runs are compared by 64-bit rolling hashes.
    ``base_failed``: under 50 words, or over 50 % of the words in repeated runs of three.  ``kept``: not
    ``base_failed``, at most ``MAX_RUN_SHARE[n]`` of the word characters in repeated runs of each n, and at
    most ``MAX_LINE_SHARE`` in lines equal to an earlier line.

    Null or empty text: all counts 0, ``base_failed`` true.  Rows stand for themselves, so null or repeated
    ids do not matter; an empty table gives an empty table.  Other columns pass through; columns with
    the names above are replaced.
    """
    docs = docs.select(*[docs[c] for c in docs.columns if c not in {*COUNTS, "base_failed", "kept"}])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches):
        for batch in batches:
            counts = measure_all(*texts(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(counts[:, k]) for k in range(len(COUNTS)))], names=schema.names)

    out = docs.mapInArrow(run, schema)
    chars = F.col("word_chars")
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_SHARE * F.col("n_words"))
    fine = F.col("dup_line_chars") <= MAX_LINE_SHARE * chars
    for n, share in MAX_RUN_SHARE.items():
        fine &= F.col(f"dup_chars_{n}") <= share * chars
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)

"""Spelling variants: words one edit apart, found by Gram matrices of letter counts.

Words become rows of letter counts.  Words one edit apart have counts at a squared distance of at most two, and the product
of two blocks of counts gives all their distances.  Blocks hold words of one length and of the same number of letters
in each class of letters; an edit moves one letter out of a class, into one, or from one to another, so a block
meets its own length and the next one only in the few blocks that such a step leads to.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.scratch import Scratch

RUN = "[A-Za-z\\u00C0-\\u00FF]{%d,}"
LEAST_LETTERS, LEAST_ROWS = 6, 5
DELETED = 199  # one occurrence in so many loses a letter
RATIO = 5  # how much more frequent than a word its form is
CHUNK, CHUNK_LETTERS = 1024, 1 << 18  # words and letters of a block that one product takes on a side
MOST_CLASSES = 12
LETTERS = 160  # columns of letter counts; ASCII and Latin-1 letters have one each, others share them
TYPICAL_LENGTH, LENGTHS = 9, 10  # for the number of classes only


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, rows: int = LEAST_ROWS, deleted: int = DELETED) -> DataFrame:
    """(word, n) of the words with at least ``least`` letters and ``rows`` occurrences in all texts.

    An occurrence is a run of letters, A-Z in lower case.  Where ``deleted`` divides the crc32 h of ``<id>:<run>``, it loses its code
    point h % length.  Null texts have none; a null id counts as an empty string there.  Rows with the same id count each.
    """
    ident = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    found = docs.select(ident.alias("id"), F.explode(F.regexp_extract_all(docs[text_col], F.lit(RUN % least), F.lit(0))).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = found.select("id", F.translate("run", upper, upper.lower()).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = found.select(F.when(F.col("h") % deleted == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rows)


def classes_for(n_words: int) -> int:
    """How many classes of letters keep a typical block within ``CHUNK`` words."""
    fits = (c for c in range(1, MOST_CLASSES) if n_words <= CHUNK * LENGTHS * comb(TYPICAL_LENGTH + c - 1, c - 1))
    return next(fits, MOST_CLASSES)


def _codes(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), len(words[0]) if words else 0)


def _chunks(words: DataFrame, classes: int, scratch: Scratch) -> DataFrame:
    """Blocks of words (key, part, words, counts): ``key`` has the letters of every class, which add up to the length."""

    def keyed(batches):
        for batch in batches:
            texts = batch.column("word").to_pylist()
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            counts = np.bincount(row * classes + codes % classes, minlength=len(texts) * classes).astype(np.int32).reshape(len(texts), classes)
            yield batch.append_column("key", pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel()), classes).cast(pa.list_(pa.int32())))

    schema = T.StructType([*words.schema.fields, T.StructField("key", T.ArrayType(T.IntegerType()))])
    rows = scratch.keep(words.mapInArrow(keyed, schema), "keyed")
    length = F.aggregate("key", F.lit(0), lambda a, x: a + x)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select("key", F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("size") * length / CHUNK_LETTERS), F.lit(1)).alias("parts"))
    rows = rows.join(scratch.keep(sizes, "sizes"), "key").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    # one part holds about CHUNK words at most, however many the block has
    return rows.groupBy("key", "part").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("counts"))


def _steps(classes: int) -> list[list[int]]:
    """What an edit adds to a key, each pair of blocks once: nothing, a letter from a later class to an earlier one, or one letter more."""
    unit = np.eye(classes, dtype=int)
    moves = [unit[i] - unit[j] for i in range(classes) for j in range(i + 1, classes)]
    return [d.tolist() for d in [np.zeros(classes, int), *moves, *unit]]


def _letters(codes: np.ndarray) -> np.ndarray:
    n, length = codes.shape
    cell = (np.arange(n)[:, None] * LETTERS + codes % LETTERS).ravel()
    return np.bincount(cell, minlength=n * LETTERS).reshape(n, LETTERS).astype(np.float32 if length < 2000 else np.float64)


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The rows of two code matrices that are one edit apart; ``b`` has words as long as ``a`` or one letter longer.

    ``same`` says that both are one matrix, whose pairs then come once.
    """
    x, y = _letters(a), _letters(b)
    distance = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
    i, j = np.nonzero(np.triu(distance <= 2, 1) if same else distance <= 2)
    keep, step = np.zeros(len(i), bool), max(1, (1 << 22) // max(1, b.shape[1]))
    for at in range(0, len(i), step):
        u, v = a[i[at : at + step]], b[j[at : at + step]]
        if u.shape[1] == v.shape[1]:
            keep[at : at + step] = (u != v).sum(axis=1) == 1
        else:
            head = np.logical_and.accumulate(u == v[:, :-1], axis=1).sum(axis=1)
            tail = np.logical_and.accumulate((u == v[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            keep[at : at + step] = head + tail >= u.shape[1]
    return i[keep], j[keep]


def _best(own: np.ndarray, other: np.ndarray, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of ``own`` once: (word, how many others, the other of largest count, ties by code points)."""
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -counts[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return own[first], np.diff(first, append=len(own)), other[first]


def _near(chunks: DataFrame, classes: int) -> DataFrame:
    """(word, n_near, form, form_n): for every word the near words that each pair of chunks holds, summed up."""
    steps = F.array(*[F.array(*map(F.lit, d)) for d in _steps(classes)])
    ways = F.filter(F.transform(steps, lambda d: F.zip_with("key", d, lambda x, y: x + y)), lambda k: F.forall(k, lambda x: x >= 0))
    left = chunks.select("key", "part", "words", "counts", F.explode(ways).alias("to"))
    right = chunks.select(F.col("key").alias("to"), F.col("part").alias("part2"), F.col("words").alias("words2"), F.col("counts").alias("counts2"))
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A product takes far longer than its bytes suggest, so partitions must not be merged by size.
    pairs = left.repartition(parts, "to").join(right.repartition(parts, "to"), "to").filter((F.col("key") != F.col("to")) | (F.col("part") <= F.col("part2")))
    pairs = pairs.select("words", "counts", "words2", "counts2", ((F.col("key") == F.col("to")) & (F.col("part") == F.col("part2"))).alias("same"))

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                a, n, b, m, same = (batch.column(c)[k].as_py() for c in ("words", "counts", "words2", "counts2", "same"))
                i, j = near_pairs(_codes(a), _codes(b), same)
                if not len(i):
                    continue
                out = []
                for own, other, names, others, counts in [(i, j, a, b, m), (j, i, b, a, n)]:
                    counts = np.array(counts)
                    word, many, best = _best(own, other, others, counts)
                    out.append((pa.array([names[w] for w in word]), pa.array(many), pa.array([others[w] for w in best]), pa.array(counts[best])))
                for columns in out:
                    yield pa.RecordBatch.from_arrays(list(columns), names=["word", "n_near", "form", "form_n"])

    found = pairs.mapInArrow(run, "word string, n_near bigint, form string, form_n bigint")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min_by("form", F.struct(-F.col("form_n"), "form")).alias("form"), F.max("form_n").alias("form_n"))


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words with a form: each round follows as far again as all before; counts rise, so chains end."""
    now = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.keep(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.filter("moved").limit(1).count()
        scratch.drop(now)
        now = after.drop("moved")
        now._kept_at = after._kept_at
        if not moved:
            return now


def variants(words: DataFrame, ratio: int = RATIO, classes: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a table (word, n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts a word's near
    words.  Its form is the one of largest ``n`` (ties: the smallest in code-point order), if that is at least ``ratio`` times its own, else null; ``root`` is
    where following forms ends, the word itself if it has none.

    ``classes`` (default: by the number of words) sets how finely blocks are cut and changes no result.  Blocks of over ``CHUNK`` words are multiplied part
    by part; each product leaves a sum and the best near word per word, never pairs.  Null words are left out, an empty word is a
    word of length 0; rows with the same word count together.  An empty table gives no rows.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    words = scratch.keep(words, "words")
    classes = classes or classes_for(words.count())
    chunks = scratch.keep(_chunks(words, classes, scratch), "chunks")
    near = scratch.keep(_near(chunks, classes), "near")
    rows = words.join(near, "word", "left")
    held = F.col("form_n") >= ratio * F.col("n")
    rows = rows.select("word", F.when(held, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(held, F.col("form_n")).alias("form_n"))
    rows = scratch.keep(rows, "forms")
    roots = _roots(rows.filter("form IS NOT NULL"), scratch)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Language of documents: text likelihood fused with declared language, address suffix and host priors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.words import texts

BUCKETS = 1 << 15
SAMPLE = 2000  # labelled rows per language, about, that the text model is fitted on
LEAST_ROWS = 5  # labelled rows that make a language
SMOOTH = 0.5
TEMPER = 0.25  # neighbouring trigrams share letters: their likelihoods count this much
DECLARED_WEIGHT = 2.0  # pseudo-counts of the confusion table of declared languages
HOST_WEIGHT, DOMAIN_WEIGHT = 8.0, 32.0  # pseudo-counts from the level above
SCORES = 1 << 22  # likelihoods held at once
SHORT = 20  # trigrams under which a text isn't held against the alphabet's chance
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0xC2, 0xF5)]] = True  # leads of longer characters count once


_PIECE = 1 << 20


def trigrams(data: np.ndarray, bounds: np.ndarray):
    """(bounds within the piece, buckets) of pieces of the bytes, in order.

    The bucket of a place is that of the three bytes from it; ``BUCKETS`` where fewer are left in the text.
    """
    for lo in range(0, len(data), _PIECE):
        hi = min(lo + _PIECE, len(data))
        folded = np.zeros(hi - lo + 2, np.uint32)
        ahead = data[lo : hi + 2]
        folded[: len(ahead)] = _FOLD[ahead]
        code = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
        out = (code * np.uint32(2654435761)) >> np.uint32(32 - 15)
        for back in (1, 2):
            ends = bounds[1:] - back - lo
            ends = ends[(ends >= 0) & (ends < hi - lo)]
            out[ends] = BUCKETS
        yield np.clip(bounds, lo, hi) - lo, data[lo:hi], out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> dict:
    """Trigram log-probabilities per language, from about ``SAMPLE`` rows each, picked by the hash of the text.

    Rows with null label or text are left out.  Languages are all labels with at least
    ``LEAST_ROWS`` rows, however many.  No label at all gives a model without languages, which knows nothing.
    """
    rows = labelled.select(labelled[text_col].alias("text"), labelled[label_col].alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_ROWS).collect()}
    names = sorted(sizes)
    if not names:
        return {"names": [], "table": np.zeros((0, BUCKETS + 1), np.float32)}
    number = {name: k for k, name in enumerate(names)}
    every = F.create_map(*[F.lit(x) for name in names for x in (name, max(1, sizes[name] // SAMPLE))])  # null for other labels
    pick = F.pmod(F.xxhash64("text"), every[F.col("lang")]) == 0

    def run(batches):
        for batch in batches:
            data, bounds = texts(batch.column("text"))
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for own, _, grams in trigrams(data, bounds):
                cell, counts = np.unique(np.repeat(langs, np.diff(own)) * (BUCKETS + 1) + grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell // (BUCKETS + 1)), pa.array(cell % (BUCKETS + 1)), pa.array(counts)], names=["k", "bucket", "n"])

    counted = rows.filter(pick).mapInArrow(run, "k bigint, bucket bigint, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(names), BUCKETS + 1), SMOOTH)
    table[counted["k"].to_numpy(), counted["bucket"].to_numpy()] += counted["n"].to_numpy()
    table = np.log(table / table[:, :BUCKETS].sum(axis=1, keepdims=True)).astype(np.float32)
    table[:, BUCKETS] = 0
    return {"names": names, "table": table}


def _with_text(docs: DataFrame, model: dict, text_col: str | None) -> DataFrame:
    """Adds ``_ll``: tempered log-likelihoods over a text that carries no language, per language; null if it tells nothing."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_ll", T.ArrayType(T.DoubleType()))])
    table = model["table"]

    def likelihoods(column):
        data, bounds = texts(column)
        n, letters, over = np.zeros(len(column)), np.zeros(len(column)), np.zeros((len(table), len(column)))
        for own, part, grams in trigrams(data, bounds):
            n += _sums(grams != BUCKETS, own)
            letters += _sums(_LETTER[part], own)
            for row, sums in zip(table, over):
                sums += _sums(row[grams], own)
        over += n * math.log(BUCKETS)
        sure = (letters > 0) & ((over.max(axis=0, initial=-np.inf) > 0) | (n < SHORT)) & (len(table) > 0)
        ends = np.concatenate(([0], np.cumsum(sure * len(table)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array((TEMPER * over).T[sure].ravel()), mask=pa.array(~sure))

    def run(batches):
        for batch in batches:
            step = max(1, SCORES // max(1, len(table)))
            for part in (batch.slice(a, step) for a in range(0, len(batch), step)):
                yield pa.RecordBatch.from_arrays([*part.columns, likelihoods(part.column(text_col))], names=[*batch.schema.names, "_ll"])

    return docs.mapInArrow(run, schema)


def _normal(log: Column) -> Column:
    """Probabilities from log weights."""
    top = F.array_max(log)
    powers = F.transform(log, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def host_of(address: Column) -> Column:
    """The host of a URL, without port; other strings stay as they are."""
    bare = F.regexp_replace(F.lower(address), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_extract(bare, r"^([^/?#:]*)", 1)


def domain_of(host: Column) -> Column:
    """The last two labels of a host; a host without dots has the empty domain."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def suffix_of(address: Column) -> Column:
    """What the address says by itself: last label of the host, and the first folder of the path."""
    return F.concat_ws("/", F.regexp_extract(host_of(address), r"\.([^.]+)$", 1), F.regexp_extract(F.lower(address), r"^[a-z][a-z0-9+.-]*://[^/]*/([^/?#]{1,8})", 1))


def declared_in(html: Column) -> Column:
    """The language of the ``lang`` attribute of the html element, without region."""
    found = F.regexp_extract(html, r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return F.when(found != "", F.lower(found))


def identify(docs: DataFrame, model: dict, text: Column, declared: Column | None = None, address: Column | None = None) -> DataFrame:
    """``docs`` with ``language``, ``language_p`` (its posterior, 6 digits) and ``language_known``.

    The posterior of each language is its text likelihood (byte trigrams) times P(declared | language) times
    P(suffix | language) times the prior of the host.  The tables of declared languages and suffixes and the
    priors come from all rows by grouped sums of what the text alone says; a host's prior is smoothed towards its
    domain's, a domain's towards that of the whole corpus, so rare hosts lean on what is above them.

    ``language_known`` is false, and the language ``und``, where the text has no letter, is (from
    ``SHORT`` trigrams on) less likely under every language than under none, or no language was learnt.  Null or empty text is such a text;
    null declared language or address is no evidence.  Rows stand for themselves, so null or repeated ids do not
    matter; an empty table gives an empty table.  Other columns pass through; columns with the names above are replaced.
    """
    names = model["names"]
    docs = docs.select(*[docs[c] for c in docs.columns if c not in ("language", "language_p", "language_known")])
    own = docs.columns
    address = F.lit(None).cast("string") if address is None else address
    held = docs.select(F.struct(*own).alias("row"), text.alias("_t"), F.lower(F.lit(None).cast("string") if declared is None else declared).alias("_d"), host_of(address).alias("_h"), suffix_of(address).alias("_s"))
    seen = _with_text(held.select("_t", "_d", "_h", "_s"), model, "_t").filter("_ll IS NOT NULL").select("_d", "_h", "_s", _normal(F.col("_ll")).alias("p"))
    k = range(len(names))
    sums = [F.sum(F.col("p")[i]).alias(f"p{i}") for i in k]
    total = F.array(*[F.coalesce(f"p{i}", F.lit(0.0)) for i in k]) if names else F.array().cast("array<double>")

    from cuesheet.llm.scratch import Scratch

    scratch = Scratch(docs.sparkSession, "language")
    # One pass over the texts; every table below is a sum over its rows.
    tallies = scratch.keep(seen.groupBy("_d", "_h", "_s").agg(*sums, F.count(F.lit(1)).alias("n")), "tallies")
    again = [F.sum(f"p{i}").alias(f"p{i}") for i in k]
    corpus = tallies.agg(*again, F.sum("n").alias("n")).first()
    everything = [((corpus[f"p{i}"] or 0.0) + 1.0) / ((corpus["n"] or 0) + len(names)) for i in k]

    def evidence(column: str) -> DataFrame:
        """log P(value | language) per value, with pseudo-counts by the value's share of all rows."""
        per = tallies.filter(F.col(column).isNotNull()).groupBy(column).agg(*again, F.sum("n").alias("n"))
        share = F.col("n") / F.lit(float(max(1, corpus["n"] or 0)))
        log = [F.log((F.col(f"p{i}") + DECLARED_WEIGHT * share) / F.lit((corpus[f"p{i}"] or 0.0) + DECLARED_WEIGHT)) for i in k]
        return per.select(column, F.array(*log).alias(f"log{column}"))

    hosts = tallies.filter("_h IS NOT NULL").groupBy("_h").agg(*again, F.sum("n").alias("n")).withColumn("_dom", domain_of(F.col("_h")))
    domains = hosts.groupBy("_dom").agg(*again, F.sum("n").alias("n"))
    domain_p = F.array(*[(F.col(f"p{i}") + DOMAIN_WEIGHT * everything[i]) / (F.col("n") + DOMAIN_WEIGHT) for i in k])
    host_p = F.transform(F.arrays_zip(total.alias("own"), F.col("dp").alias("above")), lambda z: (z["own"] + HOST_WEIGHT * z["above"]) / (F.col("n") + HOST_WEIGHT))
    priors = hosts.join(domains.select("_dom", domain_p.alias("dp")), "_dom").select("_h", F.transform(host_p, lambda x: F.log(x)).alias("log_h"))

    rows = _with_text(held, model, "_t").drop("_t")
    for table, column in ((evidence("_d"), "_d"), (evidence("_s"), "_s"), (priors, "_h")):
        if names:
            rows = rows.join(scratch.keep(table, f"evidence{column}"), column, "left")
        else:
            rows = rows.withColumn(f"log{column}", F.lit(None))
    corpus_log = F.array(*[F.lit(math.log(p)) for p in everything])
    none = F.array(*[F.lit(0.0) for _ in k])
    fused = F.transform(
        F.arrays_zip(F.col("_ll").alias("t"), F.coalesce("log_d", none).alias("d"), F.coalesce("log_s", none).alias("s"), F.coalesce("log_h", corpus_log).alias("h")),
        lambda z: z["t"] + z["d"] + z["s"] + z["h"],
    )
    if not names:
        return rows.select("row.*", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("language_p"), F.lit(False).alias("language_known"))
    rows = rows.withColumn("_p", F.when(F.col("_ll").isNotNull(), _normal(fused)))
    best = F.array_max("_p")
    label = F.get(F.array(*[F.lit(n) for n in names]), (F.array_position("_p", best) - 1).cast("int"))
    known = F.col("_p").isNotNull()
    return rows.select("row.*", F.when(known, label).otherwise(UNKNOWN).alias("language"), F.round(F.coalesce(best, F.lit(0.0)), 6).alias("language_p"), known.alias("language_known"))

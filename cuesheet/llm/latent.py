"""Benchmark passages in documents: containment of weighted terms, then longest common subsequences and answers.

Documents become passages of 64 words every 32 words.  A passage is a candidate for a benchmark passage if the words
around it hold so much of the benchmark passage's own idf weight as a match cannot do without, and a candidate
counts if enough of the benchmark passage is a common subsequence of these words.  TF-IDF rows of all passages over
the benchmark's terms go through a distributed randomised SVD, which gives the cosine of every match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.scratch import Scratch
from cuesheet.llm.words import pieces, split, texts

STRIDE = 32  # words between passages; a passage has two strides
ITEM_WORDS, ITEM_STRIDE = 64, 48  # longer benchmark items are cut
BLOCK = 240  # benchmark passages searched in one latent space
RANK, OVERSAMPLE = 272, 16
COMMON, COMMON_ROWS = 0.01, 50  # a term in more passages than both this share and number tells too little for the cosine
THIN = 6  # terms a benchmark passage needs for the cosine; if it has fewer, its common terms count too
SURE, LIKELY = 0.8, 0.5  # share of common words: enough by itself, or with the answer
ANSWER_WORDS = 5
SHORT_ITEM, LEAST_ITEM = 8, 4  # benchmark passages under 8 words must be there as they are; under 4, they match nothing
CHUNKS, SALTS = 64, 64
ENTRIES, ROWS = 1 << 18, 2048  # benchmark terms, and passages of a product, that a task takes at once
DENSE, WINDOWS = 512, 2048  # terms scored by a dense product, and passages scored at once


def _parts(item_id, text: str | None, answer: str | None):
    """(item, words, words of the answer) of the passages that a benchmark item is cut into; words are hashes."""
    data, bounds = texts(pa.array([text or ""]))
    word = split(data, bounds, bare=True)[2]
    if len(word) < LEAST_ITEM:
        return
    data, bounds = texts(pa.array([answer or ""]))
    own = split(data, bounds, bare=True)[2] if answer else word[-ANSWER_WORDS:]
    starts = [0] if len(word) <= ITEM_WORDS else [*range(0, len(word) - ITEM_WORDS, ITEM_STRIDE), len(word) - ITEM_WORDS]
    for a in starts:
        part = word[a : a + ITEM_WORDS]
        yield item_id, part, own if len(own) and answer or a + ITEM_WORDS >= len(word) else part[-ANSWER_WORDS:]


class Block:
    """Some benchmark passages, as ``_parts`` gives them, and the terms in them."""

    def __init__(self, parts: list[tuple]):
        self.ids = [item_id for item_id, _, _ in parts]
        self.sequences, self.answers = [], []
        hashes = [(part, own) for _, part, own in parts]
        self.terms = np.unique(np.concatenate([np.concatenate(h) for h in hashes])) if hashes else np.zeros(0, np.uint64)
        for part, own in hashes:
            self.sequences.append(np.searchsorted(self.terms, part))
            self.answers.append(np.searchsorted(self.terms, own))

    def find(self, word: np.ndarray) -> np.ndarray:
        """The number of each word among the terms, or -1."""
        seen = np.zeros(1 << 20, bool)
        seen[self.terms >> np.uint64(44)] = True
        out = np.full(len(word), -1, np.int32)
        maybe = np.flatnonzero(seen[word >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.terms, word[maybe]), len(self.terms) - 1)
        hit = self.terms[at] == word[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def masks(self) -> np.ndarray:
        """For each benchmark passage and term, the places of the term as bits."""
        out = np.zeros((len(self.ids), len(self.terms)), np.uint64)
        for i, s in enumerate(self.sequences):
            np.bitwise_or.at(out[i], s, np.uint64(1) << np.arange(len(s), dtype=np.uint64))
        return out


def _blocks(benchmark: DataFrame):
    """The benchmark in blocks of at most ``BLOCK`` passages, so that the latent space has room for each; a long item spans several."""
    held = []
    for r in benchmark.toLocalIterator():
        for part in _parts(r["item"], r["text"], r["answer"]):
            held.append(part)
            if len(held) == BLOCK:
                yield Block(held)
                held = []
    if held:
        yield Block(held)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _found(docs: DataFrame, block: Block) -> DataFrame:
    """Per document the benchmark terms in it and their places (binaries of 32-bit integers)."""
    schema = T.StructType([*docs.drop("text").schema.fields, *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("terms", T.BinaryType()), ("places", T.BinaryType())))])

    def run(batches):
        for batch in batches:
            for a, b, data, bounds in pieces(batch.column("text")):
                _, _, word, first = split(data, bounds, bare=True)
                term = block.find(word)
                hit = np.flatnonzero(term >= 0)
                doc = np.searchsorted(first, hit, "right") - 1
                counts = np.bincount(doc, minlength=b - a)
                others = [batch.column(c).slice(a, b - a) for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*others, pa.array(np.diff(first)), _binary(term[hit], counts), _binary((hit - first[doc]).astype(np.int32), counts)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch):
    """Runs of rows with about ``ENTRIES`` benchmark terms together, or one longer row."""
    sizes = np.cumsum(pc.binary_length(batch.column("terms")).to_numpy(zero_copy_only=False), dtype=np.int64) // 4
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + ENTRIES, "right")))
        yield batch.slice(a, b - a)
        a = b


class Passages:
    """The passages of a batch as a sparse matrix: sorted entries (row, term, count)."""

    def __init__(self, batch: pa.RecordBatch, n_terms: int, use: np.ndarray | None = None):
        words = batch.column("n_words").to_numpy()
        self.sizes = np.maximum(1, -(-words // STRIDE) - 1)
        self.base = np.concatenate(([0], np.cumsum(self.sizes)))
        self.term = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
        self.place = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.int32)
        counts = np.array([len(x) // 4 for x in batch.column("terms").to_pylist()], np.int64)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        doc = np.repeat(np.arange(len(words)), counts)
        keep = slice(None) if use is None else use[self.term]
        doc, term, block = doc[keep], self.term[keep].astype(np.int64), self.place[keep] // STRIDE
        here, before = block < self.sizes[doc], block > 0
        key = np.concatenate(((self.base[doc] + block)[here] * n_terms + term[here], (self.base[doc] + block - 1)[before] * n_terms + term[before]))
        key, self.count = np.unique(key, return_counts=True)
        self.row, self.col = key // n_terms, key % n_terms
        self.starts = np.flatnonzero(np.diff(self.row, prepend=-1))
        self.rows = self.row[self.starts]

    def weigh(self, idf: np.ndarray) -> np.ndarray:
        """TF-IDF entries, each row of length one."""
        value = self.count * idf[self.col]
        if not len(value):
            return value
        norm = np.sqrt(np.add.reduceat(value * value, self.starts))
        return value / np.repeat(norm, np.diff(self.starts, append=len(value)))

    def cosines(self, value: np.ndarray, aims: np.ndarray, passage: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The products of some passages' rows with one column each of a dense matrix; 0 for rows without entries."""
        out = np.zeros(len(passage))
        if not len(self.rows):
            return out
        at = np.minimum(np.searchsorted(self.rows, passage), len(self.rows) - 1)
        bounds = np.append(self.starts, len(value))
        for k in np.flatnonzero(self.rows[at] == passage):
            own = slice(bounds[at[k]], bounds[at[k] + 1])
            out[k] = value[own] @ aims[self.col[own], item[k]]
        return out

    def turned(self, value: np.ndarray, test: "SparseSigns", n_terms: int) -> np.ndarray:
        """The transpose times the matrix times ``test``: what the rows add to the sketch."""
        out = np.zeros((n_terms, test.width), np.float32)
        bounds = np.append(self.starts, len(value))
        for a in range(0, len(self.rows), ROWS):
            b = min(a + ROWS, len(self.rows))
            lo, hi = bounds[a], bounds[b]
            col, val, row = self.col[lo:hi], value[lo:hi], np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
            cell = row[:, None] * test.width + test.columns[col]
            product = np.bincount(cell.ravel(), (val[:, None] * test.signs[col]).ravel(), (b - a) * test.width).astype(np.float32).reshape(b - a, -1)
            order = np.argsort(col, kind="stable")
            col, val, row = col[order], val[order].astype(np.float32), row[order]
            for c in range(0, len(col), 8192):
                part = slice(c, c + 8192)
                starts = np.flatnonzero(np.diff(col[part], prepend=-1))
                out[col[part][starts]] += np.add.reduceat(val[part, None] * product[row[part]], starts)
        return out


class SparseSigns:
    """A random test matrix with a few signs in every row."""

    def __init__(self, n_terms: int, width: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.width, each = width, min(8, width)
        self.columns = np.argsort(rng.random((n_terms, width)), axis=1)[:, :each]
        self.signs = rng.choice((-1.0, 1.0), (n_terms, each))

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.columns), self.width))
        np.put_along_axis(out, self.columns, self.signs, axis=1)
        return out


def _singular_vectors(sketch: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of A from the sketch (A^T A) test, by the single-pass Nystroem form."""
    shift = 1e-9 * np.linalg.norm(sketch)
    sketch = sketch + shift * test
    core = test.T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = values > 1e-12 * values.max(initial=0)
    left, _, _ = np.linalg.svd(sketch @ (vectors[:, kept] / np.sqrt(values[kept])), full_matrices=False)
    return left[:, :rank]


def _add_up(found: DataFrame, n_terms: int, use: np.ndarray, shape: tuple[int, int], part) -> np.ndarray:
    """The sum over all batches of ``part(Passages)``, a matrix of a size that the benchmark block bounds.

    Tasks send their sums in chunks of rows; these are added per chunk and salt, then per chunk.
    """
    height = -(-shape[0] // CHUNKS)

    def sums(batches):
        total, salt = np.zeros(shape), 0
        for batch in batches:
            for some in _slices(batch):
                total += part(Passages(some, n_terms, use))
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        chunks = [c for c in range(CHUNKS) if c * height < shape[0]]
        yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array([salt] * len(chunks)), pa.array([total[c * height : (c + 1) * height].tobytes() for c in chunks])], names=["chunk", "salt", "data"])

    def merge(batches):
        held: dict = {}
        for batch in batches:
            for c, d in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist()):
                held[c] = held.get(c, 0) + np.frombuffer(d)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([0] * len(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["chunk", "salt", "data"])

    fields = "chunk bigint, salt bigint, data binary"
    rows = found.mapInArrow(sums, fields).repartition("chunk", "salt").mapInArrow(merge, fields).repartition("chunk").mapInArrow(merge, fields)
    out = np.zeros(shape)
    for r in rows.collect():
        out[r["chunk"] * height : (r["chunk"] + 1) * height] = np.frombuffer(r["data"]).reshape(-1, shape[1])
    return out


class Cover:
    """What a match cannot do without: the least weight of a benchmark passage's words that the words around a passage hold.

    The score is the weight of the benchmark passage's words whose terms are there.  A match by ``SURE`` has at least
    that share of the words, so no less than its lightest words weigh; a match by ``LIKELY`` has the answer's terms
    and the lightest of the other words up to that share; items under ``SHORT_ITEM`` words must be there whole.
    Every match of ``_verify`` is therefore a candidate, whatever else stands around it.
    """

    def __init__(self, block: Block, idf: np.ndarray, df: np.ndarray):
        self.n, self.width = len(block.terms), len(block.ids)
        self.sure, self.likely, self.asked = np.zeros(self.width), np.zeros(self.width), []
        term, item, weight = [], [], []
        for i, (s, own) in enumerate(zip(block.sequences, block.answers)):
            w, inside = idf[s], np.isin(s, own)
            slack = 1e-4 * w.sum()
            own = np.unique(own)
            self.asked.append(own[np.argsort(df[own], kind="stable")])
            if len(s) < SHORT_ITEM:
                self.sure[i] = self.likely[i] = w.sum() - slack
            else:
                self.sure[i] = np.sort(w)[: int(np.ceil(SURE * len(s) - 1e-9))].sum() - slack
                more = max(0, int(np.ceil(LIKELY * len(s) - 1e-9)) - int(inside.sum()))
                self.likely[i] = w[inside].sum() + np.sort(w[~inside])[:more].sum() - slack
            own, counts = np.unique(s, return_counts=True)
            term.append(own)
            item.append(np.full(len(own), i))
            weight.append(counts * idf[own])
        term, item, weight = map(np.concatenate, (term, item, weight))
        held = np.bincount(term, minlength=self.n)
        heavy = np.argsort(-(df * held), kind="stable")[:DENSE]
        self.slot = np.full(self.n, -1)
        self.slot[heavy] = np.arange(len(heavy))
        dense = self.slot[term] >= 0
        self.dense = np.zeros((len(heavy), self.width), np.float32)
        self.dense[self.slot[term[dense]], item[dense]] = weight[dense]
        term, item, weight = term[~dense], item[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        self.item, self.weight = item[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(self.n + 1))

    def candidates(self, p: Passages):
        """(passages, items) of runs of ``WINDOWS`` passages."""
        doc = np.repeat(np.arange(len(p.sizes)), np.diff(p.first))
        block = p.place // STRIDE
        low, high = p.base[doc] + np.clip(block - 2, 0, p.sizes[doc] - 1), p.base[doc] + np.minimum(block + 1, p.sizes[doc] - 1)
        for g in range(0, int(p.base[-1]), WINDOWS):
            size = min(WINDOWS, int(p.base[-1]) - g)
            a, b = np.searchsorted(high, g), np.searchsorted(low, g + size)
            if a >= b:
                continue
            row, term = [], []
            for shift in range(4):  # a passage's words are those of its two strides and of one on either side
                at = np.maximum(low[a:b], g) + shift
                there = np.flatnonzero(at <= np.minimum(high[a:b], g + size - 1))
                row.append(at[there] - g)
                term.append(p.term[a:b][there])
            row, term = np.concatenate(row), np.concatenate(term)
            slot = self.slot[term]
            held = np.zeros((size, len(self.dense)), np.float32)
            held[row[slot >= 0], slot[slot >= 0]] = 1
            score = (held @ self.dense).astype(np.float64)
            rare = np.unique(row[slot < 0] * self.n + term[slot < 0])
            t = rare % self.n
            counts = self.first[t + 1] - self.first[t]
            each = np.repeat(self.first[t] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            score += np.bincount(np.repeat(rare // self.n, counts) * self.width + self.item[each], self.weight[each], size * self.width).reshape(size, -1)
            row, item = np.nonzero(score >= np.minimum(self.sure, self.likely))
            kept = score[row, item] >= self.sure[item]
            rest = np.flatnonzero(~kept)
            rest = rest[np.argsort(item[rest], kind="stable")]
            for part in np.split(rest, np.flatnonzero(np.diff(item[rest])) + 1) if len(rest) else ():
                own = np.ones(len(part), bool)
                for term in self.asked[item[part[0]]]:
                    if self.slot[term] >= 0:
                        own &= held[row[part], self.slot[term]] > 0
                    else:
                        key = row[part] * self.n + term
                        at = np.searchsorted(rare, key)
                        own &= (at < len(rare)) & (rare[np.minimum(at, len(rare) - 1)] == key) if len(rare) else False
                kept[part] = own
            yield row[kept] + g, item[kept]


def _search(found: DataFrame, block: Block) -> DataFrame:
    """The matches of one block of the benchmark; see ``benchmark_matches``."""
    n = len(block.terms)

    def frequencies(batches):
        df, rows = np.zeros(n, np.int64), 0
        for batch in batches:
            for some in _slices(batch):
                p = Passages(some, n)
                df += np.bincount(p.col, minlength=n)
                rows += int(p.base[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n)), pa.array(np.concatenate(([rows], df)))], names=["term", "n"])

    counted = found.mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(n + 1, np.int64)
    df[counted["term"].to_numpy() + 1] = counted["n"].to_numpy()
    total, df = df[0], df[1:]
    idf = np.log((total + len(block.ids) + 1) / (df + 1.0)) + 1e-6
    use = df <= max(COMMON * total, COMMON_ROWS)
    for s in block.sequences:
        if use[np.unique(s)].sum() < min(THIN, len(np.unique(s))):
            use = use.copy()
            use[s] = True
    queries = np.zeros((len(block.ids), n))
    for i, s in enumerate(block.sequences):
        np.add.at(queries[i], s, 1.0)
    queries *= idf * use
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    # Benchmark passages are rows as well, heavy enough that the latent space holds their own directions.
    weight = float(max(1, total))
    width = min(RANK + OVERSAMPLE, n)
    test = SparseSigns(n, width)
    signs = test.dense()
    sketch = _add_up(found, n, use, (n, width), lambda p: p.turned(p.weigh(idf), test, n)) + weight * queries.T @ (queries @ signs)
    latent = _singular_vectors(sketch, signs, RANK)
    aims = (latent @ (queries @ latent).T).astype(np.float32)  # the cosine of a row is its product with this
    cover = Cover(block, idf, df)
    masks, sequences, answers, ids = block.masks(), block.sequences, block.answers, block.ids
    lengths = np.array([len(s) for s in sequences])
    key_fields = [f for f in found.schema.fields if f.name not in ("n_words", "terms", "places")]
    added = [("item", T.LongType()), ("place", T.LongType()), ("cosine", T.DoubleType()), ("common", T.LongType()), ("item_words", T.LongType()), ("answered", T.BooleanType())]
    schema = T.StructType([*key_fields, *(T.StructField(a, t) for a, t in added)])

    def run(batches):
        for batch in (some for whole in batches for some in _slices(whole)):
            p = Passages(batch, n, use)
            value = p.weigh(idf)
            for every_passage, every_item in cover.candidates(p):
                for at in range(0, len(every_passage), 65536):
                    passage, item = every_passage[at : at + 65536], every_item[at : at + 65536]
                    doc = np.searchsorted(p.base, passage, "right") - 1
                    start = (passage - p.base[doc]) * STRIDE
                    common, answered = _verify(p, doc, start, item, masks, answers, lengths)
                    share = common / lengths[item]
                    sure = np.where(lengths[item] < SHORT_ITEM, answered & (share == 1), (share >= SURE) | ((share >= LIKELY) & answered))
                    k = np.flatnonzero(sure)
                    cosine = p.cosines(value, aims, passage[k], item[k])
                    keys = [batch.column(f.name).take(pa.array(doc[k])) for f in key_fields]
                    out = [pa.array([ids[i] for i in item[k]], pa.int64()), pa.array(start[k], pa.int64()), pa.array(cosine), pa.array(common[k], pa.int64()), pa.array(lengths[item[k]], pa.int64()), pa.array(answered[k], pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*keys, *out], names=schema.names)

    return found.mapInArrow(run, schema)


def _verify(p: Passages, doc, start, item, masks, answers, lengths) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate the length of the longest common subsequence of the benchmark passage and the
    words from one stride before the passage to one after it, and whether the answer is there word by word."""
    common, answered = np.zeros(len(doc), np.int64), np.zeros(len(doc), bool)
    spot = (np.repeat(np.arange(len(p.sizes)), np.diff(p.first)) << 40) + p.place
    lo, hi = np.searchsorted(spot, (doc << 40) + np.maximum(start - STRIDE, 0)), np.searchsorted(spot, (doc << 40) + start + 3 * STRIDE)
    full = np.uint64(2**64 - 1)
    for at in range(0, len(doc), 4096):
        a, b, i = lo[at : at + 4096], hi[at : at + 4096], item[at : at + 4096]
        state = np.full(len(a), full)
        for step in range(int((b - a).max(initial=0))):
            live = np.flatnonzero(a + step < b)
            held = state[live]
            hit = held & masks[i[live], p.term[a[live] + step]]
            state[live] = (held + hit) | (held & ~hit)
        common[at : at + 4096] = np.bitwise_count(~state)
    for k in np.flatnonzero(common >= LIKELY * lengths[item]):  # below that no answer lets it count
        a, b, own = lo[k], hi[k], answers[item[k]]
        if common[k] >= len(own) and b - a >= len(own):
            term, place = p.term[a:b], p.place[a:b]
            for s in np.flatnonzero(term[: len(term) - len(own) + 1] == own[0]):
                if place[s + len(own) - 1] - place[s] == len(own) - 1 and (term[s : s + len(own)] == own).all():
                    answered[k] = True
                    break
    return common, answered


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """(doc, version, item, place, cosine, common, item_words, answered): benchmark items found in documents.

    Words are runs of bytes between blanks and ASCII punctuation, A-Z in lower case.  All documents give the document
    frequencies and the sketch of the SVD; every passage is scored against every benchmark
    passage of a block, and the score leaves out none that the rest of this paragraph lets count.  A passage counts if ``SURE`` of the benchmark passage's words are common with the 128
    words around it, in order, or ``LIKELY`` and the answer (``answer_col``, or the last ``ANSWER_WORDS`` words)
    stands there word by word.  Items under ``SHORT_ITEM`` words must be there
    in one piece; under ``LEAST_ITEM`` words they match nothing.  ``place``
    is the first word of the best passage; ``version`` the xxhash64 of the text.  One row per document text and item.

    The benchmark goes through the driver a block of items at a time.  Null texts and texts without words, on either
    side, match nothing.  Null ids are kept as null, apart by ``version``; rows with the same id and text are one.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "latent")
    rows = docs.select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col]).alias("version"), docs[text_col].alias("text"))
    answer = benchmark[answer_col] if answer_col else F.lit(None).cast("string")
    items = benchmark.select(benchmark[item_col].cast("bigint").alias("item"), benchmark[item_text_col].alias("text"), answer.alias("answer"))
    parts = []
    for block in _blocks(items):
        found = scratch.keep(_found(rows, block), "found")
        parts.append(scratch.keep(_search(found, block), "matches"))
        scratch.drop(found)
    if not parts:
        schema = T.StructType([*rows.drop("text").schema.fields, *T.StructType.fromDDL("item bigint, place bigint, cosine double, common bigint, item_words bigint, answered boolean").fields])
        return spark.createDataFrame([], schema)
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    best = F.max_by(F.struct("place", "cosine", "common", "item_words", "answered"), F.struct("common", "cosine", -F.col("place")))
    return every.groupBy("doc", "version", "item").agg(best.alias("m")).select("doc", "version", "item", "m.*")

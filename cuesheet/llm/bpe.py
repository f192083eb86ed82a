"""Byte-level BPE with a tokenizers file: token counts and ids of whole texts.

Texts are cut before every space; if a visible character follows each, the pre-tokenizer's pattern
begins a pre-token there, so the parts encode alone as they do in the text, and a part met before is
answered from a bounded cache.  Other texts are encoded whole.
"""

from __future__ import annotations

import os
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuesheet.llm.worker import Units, groups, once

# Fixed value: the pre-token pattern of byte-level BPE with a leading space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 1_500_000


def load(path: str):
    """The tokenizer of a ``.json`` file, one thread, no truncation or padding."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    return once(("bpe", path), make)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary, read backwards."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(tokenizer) -> dict[str, int]:
    """Vocabulary strings proved to encode alone as one token, with its id.

    A string passes if it is valid UTF-8, the pattern takes it as one pre-token, and encoding it gives
    exactly its own id.  Special strings are left to the tokenizer.
    """
    letters, pattern = byte_letters(), regex.compile(PRE_TOKEN)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    found = {}
    for token, i in tokenizer.get_vocab().items():
        if token in special or not all(c in letters for c in token):
            continue
        try:
            text = bytes(letters[c] for c in token).decode()
        except UnicodeDecodeError:
            continue
        if pattern.fullmatch(text) and pattern.match(text).end() == len(text):
            found[text] = i
    names = list(found)
    encoded = tokenizer.encode_batch(names, add_special_tokens=False)
    return {text: found[text] for text, e in zip(names, encoded) if e.ids == [found[text]]}


def settled(c: str) -> bool:
    """Whether every Unicode version since 3.2 agrees on the kind of a character (letter, number, other)."""
    return unicodedata.ucd_3_2_0.category(c)[0] == unicodedata.category(c)[0] != "C" or c <= "\xff"


class Bpe:
    """A tokenizers file with its proved whole tokens and caches of units met before."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.whole = whole_tokens(self.tokenizer)
        self.merge = self.tokenizer.model.tokenize
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.counts = Units(lambda new: self._all(new, self._count), CACHED)
        self.ids = Units(lambda new: self._all(new, self._ids), CACHED)

    def _all(self, new: list[str], encode) -> list:
        """``encode`` over units; those with special strings or characters of unsettled kind go to the library whole.

        A unit stands for itself after a space; one that ends with a space opens a text.
        """
        joined = "".join(new)
        odd = {c for c in set(joined) if not settled(c)}
        special = any(s in joined for s in self.special)
        out = []
        for u in new:
            text = u[:-1] if u[-1:] == " " else " " + u
            if not u or u[0].isspace() and u != " ":
                out.append(False)
            elif (odd and not odd.isdisjoint(u)) or (special and any(s in u for s in self.special)):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(len(ids) if encode == self._count else struct.pack(f"<{len(ids)}I", *ids))
            else:
                out.append(encode(self._pre_tokens(text)))
        return out

    def _pre_tokens(self, unit: str) -> list[str]:
        body = unit[1:] if unit[:1] == " " else unit
        if body.isalpha():
            return [unit]
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return [unit[:-1], body[-1]]
        return self.pattern.findall(unit)

    def _merged(self, pre_token: str) -> list:
        """The tokens of a pre-token, by the library's merges."""
        if pre_token.isascii() and pre_token.isprintable():
            return self.merge(pre_token.replace(" ", self.letters[32]))
        return self.merge(pre_token.encode().decode("latin-1").translate(self.letters))

    def _known(self, cache: Units, pre_token: str, encode):
        """The value of a pre-token, which is a unit of its own too; one that was not met before is kept."""
        if pre_token.isspace():
            return encode(pre_token)
        unit = pre_token[1:] if pre_token[0] == " " else pre_token + " "
        value = cache.get(unit)
        if value is None:
            value = encode(pre_token)
            if len(cache) < cache.most:
                cache[unit] = value
        return value

    def _one_count(self, pre_token: str) -> int:
        return 1 if pre_token in self.whole else len(self._merged(pre_token))

    def _one_ids(self, pre_token: str) -> bytes:
        whole = self.whole.get(pre_token)
        ids = [t.id for t in self._merged(pre_token)] if whole is None else [whole]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _count(self, pre_tokens: list[str]) -> int:
        if len(pre_tokens) == 1:
            return self._one_count(pre_tokens[0])
        return sum([self._known(self.counts, p, self._one_count) for p in pre_tokens])

    def _ids(self, pre_tokens: list[str]) -> bytes:
        """Little-endian unsigned 32-bit integers."""
        if len(pre_tokens) == 1:
            return self._one_ids(pre_tokens[0])
        return b"".join([self._known(self.ids, p, self._one_ids) for p in pre_tokens])

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the tokenizers library gives them without added special tokens."""
        found = self.counts.look_up([units(t) for t in texts])
        return [len(self.tokenizer.encode(t, add_special_tokens=False).ids) if False in f else sum(f) for t, f in zip(texts, found)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = self.ids.look_up([units(t) for t in texts])
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if False in f else b"".join(f) for t, f in zip(texts, found)
        ]


def bpe(path: str) -> Bpe:
    return once(("bpe-units", path), lambda: Bpe(path))


def units(text: str) -> list[str]:
    """The parts between spaces, the first marked by a space behind it."""
    parts = text.split(" ")
    parts[0] += " "
    return parts


def with_token_counts(docs: DataFrame, path: str, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``text_col`` as a long.

    ``path`` is the tokenizer's file, which every executor can read.  Null or empty text: 0.  Every row is counted by itself, so null
    or repeated ids do not matter; an empty table gives an empty table.  A column called ``name`` is
    replaced; other columns pass through (only the text goes through Python with them).
    """
    docs = docs.select(*[docs[c] for c in docs.columns if c != name])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            counts = [n for group in groups(texts) for n in bpe(path).count_all(group)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)

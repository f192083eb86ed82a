"""SentencePiece encoding that keeps the place of every piece in the original bytes."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuesheet.llm.worker import Units, groups, once

MARK = "▁"
CACHED = 700_000


class CharMap:
    """The compiled character map of a model: longest-prefix replacement over UTF-8 bytes.

    The blob is the byte size of a double-array trie, the trie's 32-bit units, then the replacement
    strings, each ended by a zero byte.  A unit holds a label or value, whether a value hangs on it, and
    the offset to its children.
    """

    def __init__(self, blob: bytes):
        self.trie: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.trie = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and what replaces it."""
        if not self.trie:
            return None
        found, node, trie = None, self._children(self.trie[0]), self.trie
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(trie) or trie[node] & (1 << 31 | 0xFF) != data[k]:
                break
            unit = trie[node]
            node ^= self._children(unit)
            if unit & 1 << 8:
                start = trie[node] & 0x7FFFFFFF
                found = k + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found


def _letter(data: bytes, at: int) -> int:
    """Bytes of the UTF-8 character at ``at``."""
    lead = data[at]
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normalizer:
    """Text -> normalised bytes, and for each of them (and the end) the original byte it comes from."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not spec.precompiled_charsmap and self.prefix and not self.squeeze and self.escape

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        data, out, source, at = text.encode(), bytearray(), [], 0
        if self.plain and b" " not in data:
            return MARK.encode() + data, [0, 0, 0, *range(len(data) + 1)]
        space = MARK.encode() if self.escape else b" "
        parts = []
        while at < len(data):
            hit = self.map.longest(data, at)
            size, new = hit or (_letter(data, at), data[at : at + _letter(data, at)])
            parts.append((at, size, new))
            at += size
        if self.squeeze:
            while parts and not parts[0][2].strip(b" "):
                del parts[0]
        if parts and self.prefix:
            out += space
            source += [parts[0][0]] * len(space)
        blank = self.squeeze and bool(parts)
        for at, size, new in parts:
            if self.squeeze and blank:
                new = new.lstrip(b" ")
            if not new:
                continue
            for i in range(len(new)):
                add = space if new[i : i + 1] == b" " else new[i : i + 1]
                out += add
                source += [at + (i if len(new) == size else 0)] * len(add)
            blank = self.squeeze and new.endswith(b" ")
        end = parts[-1][0] + parts[-1][1] if parts else 0
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], source[len(out) :]
                end = source[len(out)] if len(source) > len(out) else end
            if out:
                last = next((p for p in reversed(parts) if p[2].strip(b" ")), parts[-1])
                end = last[0] + last[1]
        return bytes(out), [*source, end]


class Model:
    """A SentencePiece model with its normaliser, and a cache of encoded units.

    Where no piece holds the space mark behind another character and the normaliser maps characters one to one,
    no merge can join two words, so words encode alone as they do in the text.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        parsed = proto.ModelProto()
        parsed.ParseFromString(self.library.serialized_model_proto())
        spec = parsed.normalizer_spec
        self.normalize = Normalizer(spec)
        kind = proto.ModelProto.SentencePiece.Type
        self.bytes = [p.type == kind.BYTE for p in parsed.pieces]
        self.sizes = [1 if b else len(p.piece.encode()) for b, p in zip(self.bytes, parsed.pieces)]
        self.widths = np.array(self.sizes, np.int64)
        self.opens = np.array([p.piece.startswith(MARK) for p in parsed.pieces], np.int64)
        self.decimal = [str(i) for i in range(len(parsed.pieces))]
        self.unknown = parsed.trainer_spec.unk_id
        apart = not any(MARK in p.piece.lstrip(MARK) for p in parsed.pieces) and not any(p.type == kind.USER_DEFINED for p in parsed.pieces)
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self.by_units = apart and plain and parsed.trainer_spec.model_type == 2
        self.units = Units(self._encode, CACHED)

    def spans(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """The original bytes [begin, end) of every piece."""
        normal, source = self.normalize(text)
        out, at = [], 0
        for k, i in enumerate(ids):
            if i == self.unknown:  # a run of characters that no piece has: up to where the next piece matches
                nxt = next((self.library.id_to_piece(j).encode() for j in ids[k + 1 :] if j != self.unknown), None)
                stop = normal.index(nxt, at + 1) if nxt else len(normal)
                size = stop - at
            else:
                size = self.sizes[i]
            out.append((source[at], source[at + size]))
            at += size
        return out

    def _encode(self, words: list[str]) -> list:
        """The ids of each word as 32-bit integers."""
        alone = [w for w in words if w and MARK not in w]
        ids = dict(zip(alone, self.library.encode(alone, num_threads=1)))
        return [struct.pack(f"<{len(i)}i", *i) if (i := ids.get(w)) else False for w in words]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: ids, and the original bytes [begin, end) of each piece.

        A piece that opens with the space mark takes the space in.
        """
        found = self.units.look_up([t.split(" ") for t in texts]) if self.by_units else [[False]] * len(texts)
        out = []
        for text, parts in zip(texts, found):
            if False in parts:
                ids = self.library.encode(text)
                spans = np.array(self.spans(text, ids), np.int64).reshape(-1, 2)
                out.append((np.array(ids, np.int32), spans[:, 0], spans[:, 1]))
                continue
            ids = np.frombuffer(b"".join(parts), np.int32)
            out.append((ids, *self._places(ids, self.widths[ids])))
        return out

    def _places(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends where the normaliser only puts marks for spaces and one before the text.

        A mark is three bytes in normalised text and one in the original, none for the one before the text.
        """
        ends = np.cumsum(sizes - (len(MARK.encode()) - 1) * self.opens[ids]) - 1
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return begins, ends


def model(path: str) -> Model:
    return once(("pieces", path), lambda: Model(path))


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``decoded`` (the ids decoded again) and, if asked, ``begins`` and ``ends``.

    ``begins``/``ends`` are byte offsets of each piece in the original UTF-8 text.  ``path`` is the model's file,
    which every executor can read.  Null or empty text: no ids, decoded to the empty string.  Rows stand
    for themselves, so null or repeated ids do not matter; an empty table gives an empty table.  Other columns
    pass through; columns with the names above are replaced.
    """
    added = [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    added += [("begins", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.LongType()))] if spans else []
    docs = docs.select(*[docs[c] for c in docs.columns if c not in {n for n, _ in added}])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in added)])

    def run(batches):
        m = model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            rows = [r for group in groups(texts) for r in m.encode_all(group)]
            arrays = [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([m.library.decode(r[0].tolist()) for r in rows], pa.string())]
            if spans:
                arrays += [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *(n for n, _ in added)])

    return docs.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``encode_pieces`` gives, as digests: id, n_tokens, ids_sha256, decoded_sha256, span_bytes.

    The ids in decimal are joined by commas; ``span_bytes`` is the number of original bytes under the pieces.
    Edge cases as in ``encode_pieces``.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("span_bytes", T.LongType())))])

    def run(batches):
        from hashlib import sha256

        m = model(path)
        for batch in batches:
            out = []
            for ids, begins, ends in (r for group in groups([t or "" for t in batch.column("text").to_pylist()]) for r in m.encode_all(group)):
                own = ids.tolist()
                joined = ",".join(map(m.decimal.__getitem__, own))
                out.append((len(own), sha256(joined.encode()).hexdigest(), sha256(m.library.decode(own).encode()).hexdigest(), int((ends - begins).sum())))
            columns = [list(c) for c in zip(*out)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64())))], names=schema.names)

    return rows.mapInArrow(run, schema)

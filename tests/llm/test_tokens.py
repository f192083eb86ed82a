"""Token counts, ids and pieces against the libraries, and exact round trips of the store."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cuesheet.llm import bpe, pieces, tokenstore
from tests.llm.helpers import clashing, frame, odd_documents

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def strange_texts(n=3000):
    rng = random.Random(4)
    letters = [chr(c) for c in range(32, 127)] + list("  \n\t  éÉñ漢字かなÅ😀'’…٣½́‍▁\x00\x85　")
    fixed = [
        "", " ", "  ", "a ", " a", "a  b", "x\n y", "x \ny", "it's we'll '  's", "<|endoftext|>", "a<|endoftext|> b", "<|endof text|>", "ab  b", "️", "क्षि ३", "\U0001f9ff",
        "Ꟃ͸ \U0001df00", "</s><s> <unk> <0x41>", "▁▁a ▁", "word, next. end!",
    ]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(n)]


def test_byte_bpe_equals_the_library():
    library, own = Tokenizer.from_file(BPE), bpe.bpe(BPE)
    texts = strange_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.count_all(texts) == [len(i) for i in want]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.encode_all(texts)] == want


def test_whole_tokens_are_proved():
    own = bpe.bpe(BPE)
    assert len(own.whole) > 40_000
    for text in random.Random(2).sample(sorted(own.whole), 300):
        assert own.tokenizer.encode(text, add_special_tokens=False).ids == [own.whole[text]]


def test_caches_start_anew():
    own = bpe.Bpe(BPE)
    own.ids.most = 10
    texts = strange_texts(50)
    assert own.encode_all(texts) == bpe.bpe(BPE).encode_all(texts) and len(own.ids) < 2000


def test_pieces_and_their_places():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Model(PIECES)
    assert own.by_units
    texts = strange_texts()
    for text, (ids, begins, ends) in zip(texts, own.encode_all(texts)):
        assert ids.tolist() == library.encode(text)
        data = text.encode()
        assert list(zip(begins.tolist(), ends.tolist())) == own.spans(text, ids.tolist())
        assert begins[1:].tolist() == ends[:-1].tolist() and (not len(ids) or (begins[0] == 0 and ends[-1] == len(data)))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_compiled_map_equals_the_library(rule):
    """Longest-prefix replacement, and places that never go backwards, over the library's own maps."""
    try:
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        from sentencepiece import sentencepiece_model_pb2 as proto

        parsed = proto.ModelProto()
        parsed.ParseFromString(library.serialized_model_proto())
    except Exception as e:  # an edition of the library without normalizers
        pytest.skip(str(e))
    spec = parsed.normalizer_spec
    for squeeze in (False, True):
        spec.add_dummy_prefix, spec.escape_whitespaces, spec.remove_extra_whitespaces = False, False, squeeze
        own = pieces.Normalizer(spec)
        check = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=squeeze)
        for text in ["ﬁne ½ Å ｶﾞ  x", "  ㎏　a\tb  ", "é é ﷺ", "", "plain", "Ⅷ​ z"] + strange_texts(300):
            normal, source = own(text)
            assert normal.decode() == check.normalize(text), (rule, squeeze, text)
            assert len(source) == len(normal) + 1 and source == sorted(source) and source[-1] <= len(text.encode())


def test_operators_on_odd_documents(spark):
    rows = odd_documents()
    library, model = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = clashing(frame(spark, rows))
    counted = bpe.with_token_counts(df, BPE)
    assert counted.columns == [c for c in df.columns if c != "n_tokens"] + ["n_tokens"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = sorted(rows, key=key)
    got = sorted(((r.doc_id, r.text, r.n_tokens) for r in counted.collect()), key=key)
    assert [g[2] for g in got] == [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in want]
    out = sorted(((r.doc_id, r.text, r.ids, r.decoded, r.begins, r.ends) for r in pieces.encode_pieces(df, PIECES).collect()), key=key)
    for (_, text), (_, _, ids, decoded, begins, ends) in zip(want, out):
        assert ids == model.encode(text or "") and decoded == model.decode(ids) and len(begins) == len(ends) == len(ids)
    assert {len(r.ids_sha256) for r in pieces.piece_digests(df, PIECES).collect()} == {64}
    for op in (lambda d: bpe.with_token_counts(d, BPE), lambda d: pieces.encode_pieces(d, PIECES), lambda d: pieces.piece_digests(d, PIECES)):
        assert op(df.filter("false")).count() == 0


def test_store_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenstore, "BLOCK_BYTES", 100)
    rows = odd_documents()
    library = Tokenizer.from_file(BPE)
    store = f"file://{tmp_path}/store"
    tokenstore.write_store(clashing(frame(spark, rows)), store, BPE, end=0)
    got = sorted(tokenstore.read_store(spark, store).collect(), key=lambda r: r.start)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.doc_id for r in got] == [i for i in order for _ in ids[i]]
    at = 0
    for r in got:
        assert r.ids in ids[r.doc_id] and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    for i in (1, 15, 20, -3):
        assert sorted(tokenstore.read_document(spark, store, i)) == sorted(ids[i])
    assert tokenstore.read_document(spark, store, 999) == []
    assert spark.read.parquet(f"{store}/blocks").count() > 5


def test_store_of_nothing(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    tokenstore.write_store(frame(spark, [(1, "x")]).filter("false"), store, BPE)
    assert tokenstore.read_store(spark, store).count() == 0

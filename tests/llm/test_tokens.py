import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memoria.llm import sentencepiece as sp
from memoria.llm import token_store as ts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a  b", "it's we'll 'S", "x\n\n  y\t", "é ñ 中文 😀", "<|endoftext|> a", "12ab 3.4", "   a　b", "___ a_b", "don''t", "\r\n", "ﬁ Ⅷ ½", "▁x ▁", "x" * 300, "a b " * 500, "\x00\x01"]
mixed = st.text(st.sampled_from(list("ab'st \n\t1é中.!▁<|>_ 😀")), max_size=40)


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    ids, counts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(mixed, min_size=1, max_size=6))
def test_byte_bpe_equals_the_library(texts):
    library = Tokenizer.from_file(BYTE_BPE)
    assert encoded(ts.encoder(BYTE_BPE), texts + ODD) == [library.encode(t, add_special_tokens=False).ids for t in texts + ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(mixed, min_size=1, max_size=6))
def test_pieces_equal_the_library_and_decode(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder = sp.Encoder(PIECES)
    found = encoded(encoder, texts + ODD)
    assert found == [library.encode(t) for t in texts + ODD]
    counts = np.array([len(x) for x in found])
    data, offsets = sp.decode(encoder.model, np.array(sum(found, []), np.int64), counts)
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])] == [t.replace("▁", " ") for t in texts + ODD]


def test_lattice_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    units = [" the", " representation", " internationalization", " aaaaaa", " hello.world", " ", "  x", " zzz,qqq", " 12,345"]
    found = {r.unit: r.ids for r in sp.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), sp.load(PIECES)).collect()}
    assert found == {u: library.encode(u[1:]) if u.strip() else [library.piece_to_id("▁")] for u in units}


def test_documents_encode_and_decode(spark):
    rows = [(None, "a b c " * 40), (1, None), (2, ""), (3, "the house " * 60), (3, "the house " * 60), (4, ODD[5])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = sp.encode_documents(docs, PIECES)
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    assert sorted(((r.doc_id, r.ids) for r in found.collect()), key=key) == sorted(((i, library.encode(t or "")) for i, t in rows), key=key)
    back = sp.decode_documents(found, PIECES).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert sp.piece_report(docs, PIECES).filter("round_trip").count() == 6
    assert sp.encode_documents(docs.limit(0), PIECES).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=900))
def test_dac_gives_every_id_at_random(ids):
    data = ts.dac_file([1, None], np.array([len(ids) // 2, len(ids)]), np.array(ids, np.uint32))
    dac = ts.Dac(data)
    assert dac.all().tolist() == ids and [dac[i] for i in range(len(ids))] == ids
    assert dac.ends.tolist() == [len(ids) // 2, len(ids)] and dac.null_ids.tolist() == [False, True]
    with pytest.raises(IndexError):
        dac[len(ids)]


def test_token_files_keep_order(spark, tmp_path):
    rows = [(5, "one two three"), (None, "nothing"), (2, ""), (9, None), (2, "again " * 50), (7, "x y"), (7, "x y")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    manifest = ts.write_tokens(docs, f"file://{tmp_path}/t", tokenizer=BYTE_BPE, files_tokens=40, partitions=3)
    assert manifest.count() > 1
    library, at, expected = Tokenizer.from_file(BYTE_BPE), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in ts.read_tokens(manifest).collect()), key=lambda r: r[1])
    assert found == expected
    assert ts.read_tokens(ts.write_tokens(docs.limit(0), f"file://{tmp_path}/e", tokenizer=BYTE_BPE)).count() == 0

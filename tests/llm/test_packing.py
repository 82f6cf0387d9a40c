import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glossaloom.llm import bytepairs, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
LIB.encode_special_tokens = True
CODEC = bytepairs.BytePairCodec(open(PATH, "rb").read())
AWKWARD = [
    "", " ", "  ", "a  b", " a", "a ", "\n", "a \n b", "a\n b", "a\n\n b", "don't 's x", "<|endoftext|> <|endoftext|>", "日本 語", "é 🙂 ½ 3",
    "\x1c a \x85 b  c", "tab\t x", "   lead", "trail   ", "word " * 2000, "x" * 3000, "Ġ Ġa ĠĠ", "a  b \t c",
]


def expected(text):
    return LIB.encode(text, add_special_tokens=False).ids


def unpacked(packed):
    return np.frombuffer(packed, CODEC.dtype).tolist()


def test_awkward_texts_equal_the_library():
    for text, packed in zip(AWKWARD, CODEC.encode(AWKWARD)):
        assert unpacked(packed) == expected(text), repr(text[:40])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab the\n\t'sé.,1  \x1c日Ġ"), max_size=40), max_size=4))
def test_random_texts_equal_the_library(texts):
    assert [unpacked(p) for p in CODEC.encode(texts)] == [expected(t) for t in texts]


def test_special_tokens_in_texts_are_the_unmodified_librarys(spark, tmp_path):
    lib = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "plain words, here", *AWKWARD, "<|endoftext|>", "x<|endoftext|>y  z", "<|endoftext| >", None]
    packing.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, f"file://{tmp_path}/set")
    place = 0
    for r, text in zip(packing.read_documents(spark, f"file://{tmp_path}/set").orderBy("doc_id").collect(), texts):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.ids) == (place, ids), repr(text)
        place += len(ids)
    assert lib.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 15, 16, 17, 24, 31, 32])
def test_pack_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    packed = packing.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    for start, count in ((0, 1001), (0, 0), (3, 1), (500, 501), (1001, 0)):
        assert packing.unpack(packed, bits, start, count).tolist() == ids[start : start + count].tolist()


def test_id_bits():
    assert [packing.id_bits(v) for v in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_files(spark, tmp_path):
    rows = [(5, "the cat", 1), (2, None, 1), (-3, "a  b", 1), (9, "", 1), (9, "", 1), (None, "first", 1), (7, "x " * 40, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    folder = f"file://{tmp_path}/set"
    packing.write_tokens(docs, PATH, folder, block_ids=8)
    got = sorted(packing.read_documents(spark, folder).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    stream = []
    for r, (_, text, _) in zip(got, order):
        ids = [*expected(text or ""), 0]
        assert (r.start, r.n_tokens, r.ids) == (len(stream), len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        stream += ids
    for start, count in ((0, len(stream)), (5, 30), (len(stream), 4)):
        assert packing.read_range(spark, folder, start, count).tolist() == stream[start : start + count]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    packing.write_tokens(docs, PATH, f"file://{tmp_path}/none")
    assert packing.read_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_query(spark):
    from glossaloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op9_packed_ids"](spark, sf).collect()}
    place = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*expected(r.text or ""), 0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (place, len(ids))
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        place += len(ids)

import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossaloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODEC = pieces.PieceCodec(open(MODEL, "rb").read())
AWKWARD = [
    "", " ", "  ", "a  b", " a", "a ", "\n", "a \n b", "x▁y", "▁", "日本語 テキスト", "é 🙂", "tab\there", "   lead", "trail   ",
    "<s> </s> <unk> <0x41>", "a b", "word " * 3000, "x" * 5000, " ▁ ▁", "\x01\x7f",
]


def expected(text):
    return [LIB.bos_id(), *LIB.encode(text), LIB.eos_id()]


def unpacked(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_awkward_texts_equal_the_library():
    for text, packed in zip(AWKWARD, CODEC.encode(AWKWARD)):
        assert unpacked(packed) == expected(text), repr(text[:30])
        assert CODEC.decode([packed]) == [LIB.decode(expected(text))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab the\n▁é.,<>s/0 日"), max_size=40), max_size=4))
def test_random_texts_equal_the_library(texts):
    assert [unpacked(p) for p in CODEC.encode(texts)] == [expected(t) for t in texts]


def test_frame_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "the cat  sat", 5), (3, "the cat  sat", 5), (None, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    made = pieces.encode(docs, MODEL, decoded=True)
    got = sorted(((r.doc_id, unpacked(r.ids), r.n_tokens, r.decoded) for r in made.collect()), key=repr)
    want = sorted(((i, expected(t or ""), len(expected(t or "")), LIB.decode(expected(t or ""))) for i, t, _ in rows), key=repr)
    assert got == want
    back = {(r.doc_id, r.text) for r in pieces.decode(made, MODEL).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}
    arrays = made.select(pieces.id_array(F.col("ids")).alias("a"), "ids").collect()
    assert all(r.a == unpacked(r.ids) for r in arrays)
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def test_query_digests(spark):
    from glossaloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op2_sentencepiece"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = expected(r.text or "")
        mine = got[r.doc_id]
        assert mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()

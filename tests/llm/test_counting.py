import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from glossaloom.llm import counting

VOCABULARY = counting.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))
TIES = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0), ("▁a", -3.0), ("bb", -2.0), ("cc", -1.0)]


def library(vocabulary, byte_fallback):
    unknown = [p for p, _ in vocabulary].index("<unk>")
    made = Tokenizer(models.Unigram([(p, float(s)) for p, s in vocabulary], unk_id=unknown, byte_fallback=byte_fallback))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


LIB, TIED = library(VOCABULARY, True), library(TIES, False)
COUNTER, TIED_COUNTER = counting.UnigramCounter(VOCABULARY), counting.UnigramCounter(TIES, False)
AWKWARD = ["", " ", "  ", "a  b", " a", "a ", "\n", "x▁y", "▁", "日本語 🙂é", "<0x41> <unk>", "word " * 2000, "x" * 3000, "the cat\nsat"]


@pytest.mark.parametrize("text", AWKWARD)
def test_awkward_texts_equal_the_library(text):
    assert COUNTER.counts([text])[0] == [len(LIB.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab the\n▁é.,<>日"), max_size=40))
def test_random_texts_equal_the_library(text):
    assert COUNTER.counts([text])[0] == [len(LIB.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("aabbc d"), max_size=20))
def test_ties_and_unknown_runs_equal_the_library(text):
    assert TIED_COUNTER.counts([text])[0] == [len(TIED.encode(text, add_special_tokens=False).ids)]


def test_frames_and_query(spark):
    from glossaloom.llm.queries import QUERIES

    rows = [(1, None, 1), (2, "", 1), (3, "the cat", 1), (3, "the cat", 1), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted((tuple(r) for r in counting.count_tokens(docs, VOCABULARY).collect()), key=repr)
    assert got == sorted(((i, len(LIB.encode(t or "", add_special_tokens=False).ids), len((t or "").split())) for i, t, _ in rows), key=repr)
    assert counting.count_tokens(docs.limit(0), VOCABULARY).count() == 0
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op5_token_counts"](spark, sf).collect():
        assert r.n_tokens == len(LIB.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)

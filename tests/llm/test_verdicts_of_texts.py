"""Language, quality rules and rule ensemble: brute-force counts, held-out accuracy and awkward rows."""

import math
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glossaloom.llm import langid, outliers, rules
from glossaloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    lines, seen, dup = [x for x in text.split("\n") if WORDS.search(x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "|", "\n", " x", "\x1cy", "\x85"]), max_size=60).flatmap(lambda w: st.sampled_from([" ", "\t", "\n", "  "]).map(lambda s: s.join(w))))
def test_counts_equal_brute_force(text):
    assert outliers.text_counts(text) == brute_counts(text)
    assert all(math.isfinite(x) for x in rules.text_statistics(text))


def test_counts_of_repeats():
    for text in ("x " * 500, "a b c d e f g h " * 3, "a b c d e f g h i a b c d e f g h", "", "one"):
        assert outliers.text_counts(text) == brute_counts(text)


def test_chi_square():
    assert abs(outliers.chi_square(0.95, 5) - 11.07) < 0.05


def test_quality_rules_on_awkward_rows(spark):
    rows = [(i, f"plain words of text number {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "s", 1) for i in range(150)]
    rows += [(900, None, "en", "s", 1), (901, "", None, None, 1), (902, "&|<> $$$ " * 12 + " ".join(f"##v{j}%%" for j in range(60)), "en", None, 1), (0, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    got = outliers.judge(docs).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(150)) and not kept[900] and not kept[901] and not kept[902]
    assert outliers.judge(docs.limit(0)).count() == 0
    few = {r.doc_id: r for r in outliers.judge(docs.where("doc_id > 890 or doc_id < 5")).collect()}
    assert few[902].distance is None and few[902].kept


def test_quality_rules_query(spark):
    got = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    for i in [i for i in docs if len(docs[i]) < 4000][:300]:
        n, chars, symbols, dup, repeated = brute_counts(docs[i])
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = lambda q: [got[i].kept for i, v in labels.items() if v == q and not got[i].base_failed]
    assert np.mean(judged(1)) > 0.99 and np.mean(judged(0)) < 0.2


def test_kernel_weights_equal_the_expansion(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, rows=40, landmarks=6)
    again = langid.fit(docs, rows=40, landmarks=6)
    assert model.languages == ["de", "en", "es", "fr"] and np.allclose(model.weights, again.weights)
    text = "Ça va bien"
    held = set(langid.grams(text)) & set(model.vocabulary)
    by_hand = sum(model.weights[np.searchsorted(model.vocabulary, g)] for g in held) / math.sqrt(len(langid.grams(text)))
    assert np.allclose(model.margins([text])[0][0], by_hand, atol=1e-4)
    assert {chr(g) for g in langid.grams("Ab, b") if g < 1 << 21} == {"a", "b", " "}


def test_language_query_and_awkward_rows(spark):
    got = {r.doc_id: r for r in QUERIES["op1_language"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in docs)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in docs if got[r.doc_id].held_out]) > 0.97
    rows = [(1, None, None, 1), (2, "", "en", 1), (3, "123 ... ", "en", 1), (4, "the word", "en", 1), (4, "the word", "en", 1), (5, "x" * 300000, "en", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    found = sorted(tuple(r) for r in langid.identify(odd, langid.fit(odd)).collect())
    assert [(r[0], r[1]) for r in found] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "en")]
    assert all(0 <= r[2] <= 1 for r in found)
    nothing = langid.fit(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"} and langid.identify(odd.limit(0), nothing).count() == 0


def test_tree_rules():
    printed = """RandomForest (uid=x) with 1 trees
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 0 <= 1.5)
      Predict: 0.0
     Else (feature 0 > 1.5)
      Predict: 1.0
    Else (feature 0 > 2.5)
     Predict: 1.0
"""
    assert rules.tree_rules(printed) == [((0, False, 2.5),), ((0, False, 1.5),), ((0, False, 2.5), (0, True, 1.5)), ((0, True, 2.5),)]


def test_rule_quality_query(spark):
    got = {r.doc_id: r for r in QUERIES["op10_rule_quality"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for q, low, high in ((1, 0.97, 1.0), (0, 0.0, 0.1)):
        share = np.mean([got[i].predicted for i, v in labels.items() if v == q and got[i].held_out])
        assert low <= share <= high
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_rule_quality_without_labels_and_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (3, "a b", 3.0), (3, "a b", 3.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert [r.score for r in rules.judge(docs, rules.fit(docs, none)).collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (1, 1), (3, 1)], "doc_id long, quality int")
    assert all(0.5 < r.score < 1 for r in rules.judge(docs, rules.fit(docs, one)).collect())
    assert rules.judge(docs.limit(0), rules.fit(docs.limit(0), one)).count() == 0

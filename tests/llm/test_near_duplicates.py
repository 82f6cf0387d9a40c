import itertools
import random
from collections import Counter

import numpy as np
import pytest

from glossaloom.llm import bagminhash, shingles
from glossaloom.llm.links import components


def bag(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] * bool(words))


def jaccard(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows, least=0.8):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, s), (j, t) in itertools.combinations(rows, 2):
        if (s or "").split() and (t or "").split() and jaccard(s, t) >= least:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in rows}


def hashed(text):
    return shingles.shingled(shingles.word_hashes([shingles.words_of(text)])[0])


def test_signature_agreement_estimates_weighted_similarity():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    for repeats in (1, 7, 300):
        a = " ".join(words) + " x y z v u" * repeats
        b = " ".join(words[:45]) + " x y z v u" * (repeats * 2 // 3)
        left, right = bagminhash.signature(hashed(a), 8000), bagminhash.signature(hashed(b), 8000)
        assert abs(np.mean(left == right) - jaccard(a, b)) < 0.025, repeats
    assert len(set(rng.sample(words, 3))) == 3


def test_signature_does_not_depend_on_the_time_bound():
    for text in ("one two three four five six " * 9, " ".join(map(str, range(400))), "a"):
        made = bagminhash.signature(hashed(text), 64)
        real = bagminhash._points
        try:
            bagminhash._points = lambda s, level, until, cover: real(s, level, until * 3, cover)
            assert (bagminhash.signature(hashed(text), 64) == made).all()
        finally:
            bagminhash._points = real


def test_numbered_copies_give_the_multiset_overlap():
    a, b = "p q r s t " * 6 + "end of it", "p q r s t " * 4 + "another end of it"
    left, right = (set(shingles.numbered_copies(hashed(t)).tolist()) for t in (a, b))
    assert len(left & right) == sum((bag(a) & bag(b)).values()) and len(left) == sum(bag(a).values())


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(60, 50), (60, 55)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 41), 50, 55, 60, 99]], "node long")
    got = {r.node: r.component for r in components(links, nodes).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 55: 50, 60: 50, 99: 99}


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for group in range(12):
        words = [f"g{group}w{rng.randrange(2000)}" for _ in range(rng.choice([8, 40, 120]))]
        for copy in range(rng.choice([1, 2, 6])):
            edited = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(99999)}"
            rows.append((len(rows), " ".join(edited)))
    # a chain whose ends are far apart
    words = [f"c{i}" for i in range(120)]
    for step in range(8):
        rows.append((len(rows), " ".join([f"n{i}" if i < 8 * step else w for i, w in enumerate(words)])))
    # versions of one text, edited to all degrees: some near the text, some near another version only
    words = [f"v{i}" for i in range(90)]
    for version in range(60):
        edited = list(words)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice([[], [f"e{rng.randrange(6)}"], [edited[at], "more"]])
        rows.append((len(rows), " ".join(edited)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Same words"), (904, "same  words"), (905, "again " * 50), (906, "again " * 60), (907, "again " * 70)]
    return rows


def test_short_signatures_differ_where_signatures_do():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 350, dtype=np.uint64)
    b = np.where(rng.random(350) < 0.3, rng.integers(0, 1 << 63, 350, dtype=np.uint64), a)
    x = bagminhash.short_signature(a) ^ bagminhash.short_signature(b)
    differing = sum(digit != "0" for v in x.view(np.uint64).tolist() for digit in f"{v:x}")
    changed = int((a != b).sum())
    assert differing <= changed and abs(differing - 15 / 16 * changed) < 15


@pytest.mark.parametrize("seed", [3, 17])
def test_classes_equal_brute_force(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    got = {r.doc_id: (r.class_id, r.kept) for r in bagminhash.near_duplicates(docs).collect()}
    want = brute_classes(rows)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(kept == (i == c) for i, (c, kept) in got.items())


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x y"), (2, "x y"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, bagminhash.near_duplicates(docs).select("doc_id", "class_id").collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (None, 2), (2, 2), (3, 3)], key=repr)
    assert bagminhash.near_duplicates(docs.limit(0)).count() == 0


def test_null_and_repeated_ids_keep_their_links(spark):
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(None, text), (None, text + " more"), (5, text + " more still"), (None, "other " * 3), (7, "p q"), (7, "r s"), (7, "r s"), (8, "r S")]
    # one id for texts that are near copies and for one that is not
    rows += [(9, "x " + text[:200] + " y"), (9, "x " + text[:200] + " z"), (9, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, bagminhash.near_duplicates(docs).select("doc_id", "class_id", "kept").collect()), key=repr)
    assert got == sorted([(None, 5, False), (None, 5, False), (5, 5, True), (None, None, True), (7, 7, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 9, True), (9, 9, False), (9, 9, True)], key=repr)
    unnamed = docs.where("doc_id is null")
    kept = [r.kept for r in bagminhash.near_duplicates(unnamed).collect()]
    assert sorted(kept) == [False, True, True]


def test_near_copies_of_very_long_texts(spark):
    words = [f"w{i % 7001}x{i % 13}" for i in range(20_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:19_000] + ["new"] * 800)), (3, " ".join(words[:9_000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()}
    assert got == brute_classes(rows) == {1: 1, 2: 1, 3: 3}


def test_versions_just_under_the_bound_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(8)
    words, rows = [f"b{i}" for i in range(64)], []
    for version in range(60):
        edited = list(words)
        edited[rng.randrange(5, 59)] = f"e{version}"
        rows.append((version, " ".join(edited)))
    verified, real = [], bagminhash._similarities
    monkeypatch.setattr(bagminhash, "_similarities", lambda pairs, bags: verified.append(pairs.count()) or real(pairs, bags))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()} == brute_classes(rows)
    assert verified[1] <= 2 * len(rows), verified


def test_a_worker_holds_few_word_hashes():
    for start in range(0, 500_000, 20_000):
        shingles.word_hashes([[b"x%d" % i for i in range(start, start + 20_000)]])
    assert len(shingles._WORDS.known) + len(shingles._WORDS.before) <= 250_000

import random
from collections import Counter

import numpy as np

from glossaloom.llm import decontaminate, shingles


def bag(words, width):
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(docs, items, least=0.8):
    found = {}
    for i, text in docs:
        words = (text or "").lower().split()
        for item, item_text in items:
            wanted = (item_text or "").lower().split()
            n, width = len(wanted), min(5, len(wanted))
            own = bag(wanted, width) if n else None
            best = None
            for start in range(len(words) - n + 1) if n else ():
                seen = bag(words[start : start + n], width)
                value = sum((seen & own).values()) / sum((seen | own).values())
                if value >= least and (best is None or value > best[1] + 1e-12):
                    best = (start, value)
            if best:
                found[i, item] = (best[0], n, round(best[1], 9))
    return found


def cases(seed, docs=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of a to and in is it was for".split() + [f"w{rng.randrange(400)}" for _ in range(12)])
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 9, 14, 30, 30, 60])))) for k in range(20)] + [(90, None), (91, " "), (92, "go " * 30)]
    rows = []
    for i in range(docs):
        words = [word() for _ in range(rng.choice([5, 60, 300]))]
        for _ in range(rng.choice([0, 1, 2])):
            copy = rng.choice(items[:20])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.choice([0, len(copy) - 1, rng.randrange(len(copy))])
                copy[at : at + 1] = rng.choice([[], ["new"], ["new", "er"]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        rows.append((i, " ".join(words).title() if i % 7 == 0 else " ".join(words)))
    rows += [(900, None), (901, ""), (902, "go " * 45), (903, items[3][1]), (903, items[3][1])]
    return rows, items


def test_hits_equal_brute_force():
    rows, items = cases(11)
    index = decontaminate.ItemIndex([t or "" for _, t in items])
    got = {}
    for i, text in rows:
        for item, start, words, value, _ in index.hits(shingles.word_hashes([shingles.words_of(text or "")])[0]):
            got[i, items[item][0]] = (start, words, round(value, 9))
    want = brute(rows, items)
    assert len(want) > 20 and got == want


def test_multi_index_finds_every_print_within_the_radius():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    asked = np.concatenate([items[:50] ^ np.uint64(0b1011 << 20), items[50:60] ^ np.uint64((1 << 22) - 1), rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    index = decontaminate.BlockIndex(items)
    got = set(zip(*(x.tolist() for x in index.within(asked))))
    assert got == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(items) if int(a ^ b).bit_count() <= index.radius}


def test_documents_shorter_than_the_item_are_compared_whole():
    words = [f"w{i}" for i in range(30)]
    items = [" ".join(words), "a b c", " ".join(f"v{i}" for i in range(8))]
    index = decontaminate.ItemIndex(items)

    def hits(text):
        return [h[:4] for h in index.hits(shingles.word_hashes([shingles.words_of(text)])[0])]

    assert hits(" ".join(words[:-1])) == [(0, 0, 29, 25 / 26)] and hits(" ".join(words[1:])) == [(0, 0, 29, 25 / 26)]
    assert hits(" ".join(words[2:-3])) == [(0, 0, 25, 21 / 26)] and hits(" ".join(words[3:-3])) == []
    assert hits("a b") == [] and hits("v0 v1 v2 v3 v4 v5 v6") == [] and hits(" ".join(words[:3])) == []


def test_frames(spark):
    rows, items = cases(4, docs=30)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    want = brute(rows, items)
    for item_words in (2_000_000, 100):
        got = decontaminate.find_leaks(docs, benchmark, item_words=item_words).collect()
        assert {(r.doc_id, r.item_id): (r.start_word, r.n_words, round(r.similarity, 9)) for r in got} == want
        assert sum(r.doc_id == 903 for r in got) == 2 * sum(i == 903 for i, _ in want)
    flags = decontaminate.flag_leaks(docs, benchmark).collect()
    assert len(flags) == len(rows) and {r.doc_id for r in flags if r.leaked} == {i for i, _ in want}
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.flag_leaks(docs, benchmark.limit(0)).where("leaked").count() == 0

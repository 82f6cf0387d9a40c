import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from glossaloom.llm import brown

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORDS.findall(lower), None]


def base(rows, learn):
    counts = Counter(t for x in learn for t in tokens(x))
    total, kinds = sum(counts.values()), len(counts)
    told = {}
    for i, text in rows:
        own = tokens(text)
        told[i] = (len(own), sum(counts[t] > 0 for t in own), total, sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in own))
    return told


def by_hand(text, model):
    """The class model's log10 probability, word by word."""
    counts = {bytes(r.word): r.c for r in model.counts.collect()}
    places = {w: i for i, w in enumerate(model.words, 1)}
    rare, end = len(model.table) - 2, len(model.table) - 1
    smooth = model.table + model.smoothing
    members = Counter()
    for w, i in places.items():
        if i <= model.clustered:
            members[model.classes[i]] += counts[w]
    free = [c for w, c in counts.items() if w != brown.END and places.get(w, 10**9) > model.clustered]
    now, value = end, 0.0
    for word in tokens(text):
        key = word.encode() if word is not None else None
        place = places.get(key, 0)
        after = end if word is None else model.classes[place] if 0 < place <= model.clustered else rare
        value += math.log10(smooth[now, after] / smooth[now].sum())
        if after == rare:
            value += math.log10((counts.get(key, 0) + 1) / (sum(free) + len(free) + 1))
        elif after != end:
            value += math.log10(counts[key] / members[after])
        now = after
    return value


def corpus(seed=2, texts=120):
    rng = random.Random(seed)
    nouns, verbs = [f"noun{i}" for i in range(12)], [f"Verb{i}" for i in range(12)]
    rows = []
    for i in range(texts):
        words = [w for _ in range(rng.randrange(25)) for w in ("the", rng.choice(nouns), rng.choice(verbs), rng.choice(["x", f"odd{rng.randrange(500)}"]))]
        rows.append((i, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, "UNSEEN words\x1conly é"), (503, rows[0][1]), (503, rows[0][1])]


@pytest.mark.parametrize("shares", [(1 / 20_000, 1 / 500_000), (1 / 200, 1 / 400), (0.9, 0.8)])
def test_scores_equal_models_by_hand(spark, shares):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    learn = docs.where("doc_id < 100")
    model = brown.fit(learn, classes=6, rounds=3, least_share=shares[0], listed_share=shares[1])
    want = base(rows, [t for i, t in rows if i < 100])
    got = brown.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, value = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, value, rel_tol=1e-9)
    texts = dict(rows)
    for r in [r for r in got if r.doc_id in (0, 7, 110, 500, 501, 502, 503)]:
        assert math.isclose(r.score, by_hand(texts[r.doc_id], model), rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)


def test_best_move_gains_what_the_likelihood_gains():
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 9, (12, 12))
    classes = rng.integers(0, 4, 12)

    def table(assigned):
        made = np.zeros((4, 4), np.int64)
        for a, b in itertools.product(range(12), repeat=2):
            made[assigned[a], assigned[b]] += pairs[a, b]
        return made

    for word in range(12):
        follow, lead = np.zeros(4, np.int64), np.zeros(4, np.int64)
        for other in range(12):
            follow[classes[other]] += pairs[word, other]
            lead[classes[other]] += pairs[other, word]
        target, gain = brown.best_move(follow, lead, float(pairs[word, word]), int(classes[word]), table(classes), 3)
        values = []
        for c in range(4):
            moved = classes.copy()
            moved[word] = c
            values.append(brown.likelihood(table(moved)))
        allowed = max([*values[:3], values[classes[word]]])
        assert math.isclose(values[target], allowed, rel_tol=1e-12) and math.isclose(gain, values[target] - values[classes[word]], abs_tol=1e-6)


def test_moves_of_many_words_equal_single_moves():
    rng = np.random.default_rng(7)
    pairs = rng.integers(0, 30, (40, 40)) * rng.integers(0, 2, (40, 40))
    classes = rng.integers(0, 5, 40)
    member = np.eye(6, dtype=np.int64)[classes]
    table, follow, lead, own = member.T @ pairs @ member, pairs @ member, pairs.T @ member, np.diag(pairs)
    want = [brown.best_move(follow[w], lead[w], float(own[w]), int(classes[w]), table, 5)[0] for w in range(40)]
    assert len(set(want)) > 2 and brown.best_moves(follow, lead, own.astype(float), classes, table, 5).tolist() == want


def test_every_word_of_five_tokens_is_clustered_however_large_the_corpus(spark):
    rng = random.Random(3)
    texts = [" ".join(["the", "of"] * 3000)] * 20 + [" ".join(f"w{(i * 30 + j) % 900}" for j in range(30)) for i in range(150)] + ["once twice twice"]
    rng.shuffle(texts)
    model = brown.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    counts = Counter(t for x in texts for t in tokens(x) if t)
    assert model.tokens > 100_000 and max(c for w, c in counts.items() if w[0] == "w") < model.tokens / 20_000
    want = {w.encode(): c for w, c in counts.items() if c >= 5}
    assert model.clustered == len(want) == 902 and dict(zip(model.words[:902], model.word_counts.tolist())) == want
    assert model.rare == (3, 2) and len(set(model.classes[1:-1])) > 10
    assert int(model.table.sum()) == model.tokens
    assert brown.classes_for(10**6) > brown.classes_for(10**5) == 48


def test_exchange_beats_its_start_and_the_unigram(spark):
    rows = corpus(5, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start, end = (brown.fit(docs, classes=6, rounds=r) for r in (0, 6))
    assert brown.likelihood(end.table) > brown.likelihood(start.table)
    sums = brown.score(docs, end).selectExpr("sum(score) s", "sum(base_score) b").head()
    assert sums.s > sums.b


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = brown.fit(docs.limit(0))
    r = brown.score(docs, model).head()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)
    assert brown.score(docs.limit(0), model).count() == 0


def test_query(spark):
    from glossaloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    want = base(rows, [t for i, t in rows if not held[i]])
    for r in QUERIES["op3_class_model"](spark, sf).collect():
        assert r.held_out == held[r.doc_id] and (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9)

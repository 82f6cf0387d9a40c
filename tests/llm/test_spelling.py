import random
import re
import zlib
from collections import Counter, defaultdict

from glossaloom.llm import spelling

WORDS = "word string, n long"


def neighbours(words):
    gaps = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            near[w] |= gaps[w[:i], w[i + 1 :]]
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
        near[w].discard(w)
    return near


def variants_by_hand(words):
    near, form = neighbours(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    made = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        made[w] = (words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root)
    return made


def got(frame):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    words = {}
    for _ in range(1500):
        words["".join(rng.choice("abé÷") for _ in range(rng.randint(1, 7)))] = rng.randint(1, 60)
    words |= {"a" * k: k * k for k in range(1, 30)} | {"ab" * 3000: 9, "ab" * 3000 + "b": 30, "z": 1000, "ÿ": 1}
    frame = spark.createDataFrame(list(words.items()), WORDS).repartition(7)
    assert got(spelling.variants(frame)) == variants_by_hand(words)


def test_roots_follow_long_chains(spark):
    words = {"q" * k: 2**k for k in range(5, 40)}
    made = got(spelling.variants(spark.createDataFrame(list(words.items()), WORDS)))
    assert made == variants_by_hand(words) and {r[-1] for r in made.values()} == {"q" * 39}


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["Käse", "KÄSE", "running", "Straße", "×÷xyz", "naïve", "abcd", "aaaaaa"]) + rng.choice(["", ".", "1", "—x", "Āb"]) for _ in range(80))) for i in range(120)]
    texts += [(None, "running running running"), (500, None), (501, ""), (502, "x" * 200_000), (7, texts[7][1]), (7, texts[7][1])]
    counts: Counter = Counter()
    for number, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{number}:{run}".encode())
            if number is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    made = {r.word: r.n for r in spelling.count_words(frame).collect()}
    assert made == {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert spelling.variants(spelling.count_words(frame.limit(0))).count() == 0
    plain = {r.word: r.n for r in spelling.count_words(frame, noise=None, letters=1, count=1).collect()}
    assert plain["x" * 200_000] == 1 and plain["running"] == sum(len(re.findall("running", t or "")) for _, t in texts)


def test_a_letter_of_all_words_is_no_hot_pair(spark):
    """Every pair of trie nodes meets at most one word of each letter, however many words begin alike."""
    words = {f"common{a}{b}{c}": 5 for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"}
    made = got(spelling.variants(spark.createDataFrame(list(words.items()), WORDS)))
    assert all(r == (5, 27, None, None, w) for w, r in made.items())

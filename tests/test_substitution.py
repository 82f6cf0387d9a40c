"""Retrieval, overlap resolution, pre-pass, known errors and shielding against small hand models."""

import random
import re

from pyspark.sql import functions as F

from glossaloom.operators import retrieval as R
from glossaloom.operators import substitution as S

POLICY = (
    "novel string, policy_id string, type string, trigger string, render_as string, applies string, confidence double, "
    "evidence_count bigint, rejected boolean, rank bigint"
)
FORM = "novel string, policy_id string, pos bigint, form string"


def store(spark, rows):
    """rows: (id, trigger, forms, confidence, evidence_count, applies, render)."""
    policies = spark.createDataFrame(
        [("n", i, "entity-naming", t, r, a, c, e, False, k) for k, (i, t, f, c, e, a, r) in enumerate(rows, 1)], POLICY
    )
    forms = spark.createDataFrame([("n", r[0], p, f) for r in rows for p, f in enumerate(r[2])], FORM)
    return policies, forms


def chapters(spark, texts):
    return spark.createDataFrame([("n", i, t) for i, t in enumerate(texts, 1)], "novel string, chapter bigint, text string")


def model_resolve(text, rows):
    """Spans by score; returns winners and (span, winner, loser) conflicts."""
    matched = []
    entries = [(len(f.lower()), k, p, r) for k, r in enumerate(rows) for p, f in enumerate(r[2])]
    for _, _, p, r in sorted(entries, key=lambda e: -e[0]):
        form = r[2][p].lower()
        if r not in matched and re.search(r"(?<![a-z0-9])" + re.escape(form) + r"(?![a-z0-9])", text.lower()):
            matched.append(r)
    spans = []
    for r in matched:
        for f in r[2]:
            spans += [(m.start(), m.end(), r) for m in re.finditer(r"(?<!\w)" + re.escape(f) + r"(?!\w)", text, re.I)]
    score = lambda r: (r[3], r[4], len(r[1]))
    won, lost = [], []
    for s in sorted(spans, key=lambda s: score(s[2]), reverse=True):
        hits = [w for w in won if s[0] < w[1] and s[1] > w[0]]
        other = [w for w in hits if w[2][0] != s[2][0]]
        if not hits:
            won.append(s)
        elif other:
            lost.append((text[s[0] : s[1]], max(other, key=lambda w: score(w[2]))[2][0], s[2][0]))
    out = text
    for a, b, r in sorted(won, key=lambda w: -w[0]):
        if r[5] == "deterministic":
            out = out[:a] + r[6] + out[b:]
    return out, sorted(lost)


def test_word_boundaries_and_conflict_winner(spark):
    policies, forms = store(spark, [
        ("p1", "Master", ["Master"], 0.5, 3, "deterministic", "Boss"),
        ("p2", "Young Master", ["Young Master"], 0.95, 3, "deterministic", "young lord"),
        ("p3", "Ian", ["Ian"], 0.9, 3, "deterministic", "Iain"),
    ])
    texts = chapters(spark, ["The Young Master arrived.", "a brilliant Julian met éIan", "ian spoke to IAN."])
    rewritten, resolved = S.prepass(texts, policies, forms)
    out = {r.chapter: r.new_text for r in rewritten.collect()}
    assert out == {1: "The young lord arrived.", 2: "a brilliant Julian met éIan", 3: "Iain spoke to Iain."}
    clash = S.conflicts(resolved, policies).collect()
    assert [(c.span, c.winner_id, c.loser_id, c.tied) for c in clash] == [("Master", "p2", "p1", False)]
    trace = S.trace_rows(rewritten).where("chapter = 3").orderBy("start").collect()
    assert [(t.original, t.start, t.stop) for t in trace] == [("ian", 0, 3), ("IAN", 13, 16)]
    matched = R.retrieve_policies(texts, policies, forms)
    assert {(r.chapter, r.policy_id) for r in matched.collect()} == {(1, "p1"), (1, "p2"), (2, "p3"), (3, "p3")}
    assert R.retrieve_policies(texts, policies, forms, k=1).where("chapter = 1").collect()[0].policy_id == "p2"


def test_random_texts_match_the_model(spark):
    rng = random.Random(7)
    words = ["li", "Qing", "Li Qing", "old", "Old Li", "gate", "the", "Gate's", "-", "a.b", "Qing-er", "ten years of the long quiet road home"]
    rows = []
    for i in range(14):
        forms = list(dict.fromkeys(" ".join(rng.sample(words, rng.choice([1, 1, 2, 3]))) for _ in range(3)))
        rows.append((f"p{i}", forms[0], forms, rng.choice([0.5, 0.7, 0.9]), rng.randint(1, 2), rng.choice(["deterministic", "prompted"]), f"<{i}>"))
    texts = [" ".join(rng.choice(words + ["x", "\n", ","]) for _ in range(rng.randint(0, 40))) for _ in range(25)]
    policies, forms = store(spark, rows)
    frame = chapters(spark, texts)
    rewritten, resolved = S.prepass(frame, policies, forms)
    got = {r.chapter: r.new_text for r in rewritten.collect()}
    lost = {}
    for c in S.conflicts(resolved, policies).collect():
        lost.setdefault(c.chapter, []).append((c.span, c.winner_id, c.loser_id))
    for i, text in enumerate(texts, 1):
        want, clashes = model_resolve(text, rows)
        assert got[i] == want
        assert sorted(lost.get(i, [])) == clashes


def test_known_errors_respect_protected_terms(spark):
    rules = spark.createDataFrame(
        [("r1", "bad luck", "misfortune", None), ("r2", "luck", "fortune", None), ("r3", "Profit!", "Tch!", False), ("r4", "mis", "miss", True)],
        "id string, mtl_phrase string, correct_translation string, auto_apply boolean",
    )
    texts = chapters(spark, ["Bad luck and Luck Stone, luck. Profit!", "nothing here", "mis luck"])
    guard = spark.createDataFrame([("n", "Luck Stone"), ("n", "fortune mis"), ("n", "zzz")], "novel string, form string")
    out = {r.chapter: r for r in S.apply_known_errors(texts, rules, guard).collect()}
    assert out[1].fixed_text == "misfortune and Luck Stone, fortune. Profit!"
    assert [(f.original, f.rule_id) for f in out[1].fixes] == [("Bad luck", "r1"), ("luck", "r2")]
    assert out[2].fixed_text == "nothing here" and out[2].fixes is None
    assert out[3].fixed_text == "miss fortune"
    seen = S.scan_known_errors(texts, rules).select("chapter", "id").collect()
    assert {(r.chapter, r.id) for r in seen} == {(1, "r1"), (1, "r2"), (1, "r3"), (3, "r2"), (3, "r4")}


def corrected(text, rules, guards):
    """Rules one after another on the text, whole words only, outside guards."""

    def standing(low, phrase):
        inside = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
        at = low.find(phrase)
        while at >= 0:
            alone = not inside(at - 1) and not inside(at + len(phrase))
            if alone:
                yield at
            at = low.find(phrase, at + (len(phrase) if alone else 1))

    changes = []
    for phrase, output, rule in rules:
        low = text.lower()
        shield = {i for g in guards for at in range(len(low)) for x in [g.lower()] if low.startswith(x, at) and at in set(alone_at(low, x)) for i in range(at, at + len(x))}
        free = [at for at in standing(low, phrase.lower()) if not shield & set(range(at, at + len(phrase)))]
        changes += [(text[at : at + len(phrase)], output, rule, at, at + len(phrase)) for at in free]
        ends = [0, *(at + len(phrase) for at in free)]
        text = output.join(text[x:y] for x, y in zip(ends, [*free, len(text)])) if free else text
    return text, changes


def alone_at(low, form):
    word = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
    return [at for at in range(len(low)) if low.startswith(form, at) and not word(at - 1) and not word(at + len(form))]


def test_rules_by_rounds_equal_rules_one_by_one(spark):
    rng = random.Random(8)
    some = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    words = ["a", "b", "B", "c", "d", "e", "-", "a-b", "_x", "é"]
    texts = chapters(spark, [some(words, rng.randint(0, 25)) for _ in range(40)])
    rules = {(some(words, rng.randint(1, 3)), rng.choice([some(words, rng.randint(1, 2)), "-", " d", "b e", "zz"])) for _ in range(3)} | {("a a", "b"), ("zz", "c d")}
    rows = [(f"r{i}", p, o, rng.choice([True, None])) for i, (p, o) in enumerate(sorted(rules))] + [("no", "c", "x", False)]
    guards = ["d e", "B c", "zz c"]
    frame = spark.createDataFrame(rows, "id string, mtl_phrase string, correct_translation string, auto_apply boolean")
    out = S.apply_known_errors(texts, frame, spark.createDataFrame([("n", g) for g in guards] + [("m", "a")], "novel string, form string")).collect()
    ordered = sorted(((p, o, i) for i, p, o, auto in rows if auto is not False), key=lambda r: (-len(r[0]), r[0], r[1], r[2]))
    assert len(out) == 40
    for r in out:
        text, changes = corrected(r.text, ordered, guards)
        assert (r.fixed_text, [tuple(f) for f in r.fixes or []]) == (text, changes)


def test_contains_join_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abAB É") for _ in range(n))
    texts = [(rng.choice("mn"), i, word(rng.randint(0, 60))) for i in range(80)] + [("n", 100, None), ("n", 3, "abc"), ("n", 3, "abc"), (None, 5, "abc")]
    phrases = [(rng.choice("mno"), word(rng.randint(1, 6))) for _ in range(120)] + [("n", "abc"), ("n", "abc"), ("n", ""), ("n", None), ("m", "É")]
    t = spark.createDataFrame(texts, "novel string, chapter bigint, text string")
    p = spark.createDataFrame(phrases, "novel string, p string")
    got = sorted((r.novel, r.chapter, r.p) for r in R.contains_join(t, p, ["novel"], "p").collect())
    want = sorted((n, c, q) for n, c, x in texts for m, q in set(phrases) if n == m and q and x is not None and q.lower() in x.lower())
    assert got == want
    everywhere = sorted((r.chapter, r.p) for r in R.contains_join(t.drop("novel"), p.select("p"), [], "p").collect())
    assert everywhere == sorted((c, q) for _, c, x in texts for q in {q for _, q in phrases} if q and x is not None and q.lower() in x.lower())
    assert R.contains_join(t, p.limit(0), ["novel"], "p").count() == 0 and R.contains_join(t.limit(0), p, ["novel"], "p").count() == 0


def test_contains_join_with_very_many_phrases(spark):
    phrases = spark.range(200_000).select(F.lit("n").alias("novel"), F.concat(F.lit("the term "), F.hex(F.xxhash64("id"))).alias("p"))
    wanted = {r.p for r in phrases.where("p like '%7A'").limit(40).collect()}
    texts = spark.createDataFrame([("n", i, f"before {p.upper()} after the term") for i, p in enumerate(sorted(wanted))], "novel string, chapter bigint, text string")
    found = R.contains_join(texts, phrases, ["novel"], "p").collect()
    assert {r.p for r in found} == wanted and len(found) == 40


def test_shield_longest_name_first_and_restore(spark):
    texts = chapters(spark, ["Li Qing met Li. li qing left; Dominic stayed.", "nobody"])
    forms = spark.createDataFrame(
        [("n", "Li", "Li"), ("n", "Li Qing", "Li Qing"), ("n", "Dominic", "Dom")], "novel string, canonical string, form string"
    )
    shielded, mapping = S.shield_entities(texts, forms)
    rows = {r.chapter: r.shielded for r in shielded.collect()}
    assert rows[1] == "__ENT_0__ met __ENT_1__. __ENT_0__ left; __ENT_2__ stayed." and rows[2] == "nobody"
    back = S.restore_entities(shielded.select("novel", "chapter", F.concat("shielded", F.lit(" __ENT_9__")).alias("text")), mapping)
    assert {r.chapter: r.text for r in back.collect()}[1] == "Li Qing met Li. Li Qing left; Dominic stayed. __ENT_9__"
    only = mapping.where("canonical = 'Dominic'")
    again, _ = S.shield_entities(texts, forms, mapping=only)
    assert {r.chapter: r.shielded for r in again.collect()}[1] == "Li Qing met Li. li qing left; __ENT_2__ stayed."


def test_clean_artifacts_and_missing_names(spark):
    df = spark.createDataFrame([("keep [go away!] this\n* * * * *\nRead on Wuxiaworld now\n=== ===\nend [a\nb]",)], "t string")
    assert df.select(S.clean_artifacts(F.col("t")).alias("t")).collect()[0].t == "keep go away! this\nend [a\nb]"
    texts = chapters(spark, ["Dominic cooked."])
    trace = spark.createDataFrame([("n", 1, "DOMINIC"), ("n", 1, "Calron "), ("n", 1, "")], "novel string, chapter bigint, output string")
    assert [r.term for r in S.missing_entities(texts, trace).collect()] == ["Calron"]


def test_only_forms_that_can_overlap_are_settled(spark):
    forms = spark.createDataFrame(
        [("n", "p1", 0, "Li Qing"), ("n", "p2", 0, "Qing"), ("n", "p3", 0, "Gate of Li"), ("n", "p4", 0, "Iron of"), ("m", "p5", 0, "Qing"), ("n", "p6", 0, "a-b-a"), ("n", "p7", 0, "Dom")],
        FORM,
    )
    # "of" stands in two forms, but no form begins with it.
    assert {r.policy_id for r in S.meeting_forms(forms, ["policy_id", "pos", "form"]).collect()} == {"p1", "p2", "p3", "p6"}


def test_prepass_shuffles_texts_once_a_side_and_no_spans(spark):
    policies = spark.createDataFrame([("n", "p1", "x", "Ian", "Iain", "deterministic", 0.9, 3, False, 1)], POLICY)
    forms = spark.createDataFrame([("n", "p1", 0, "Ian")], FORM)
    texts = chapters(spark, ["ian met Ian", "nobody"])
    rewritten, resolved = S.prepass(texts, policies, forms)
    plan = rewritten._jdf.queryExecution().executedPlan().toString()
    by_chapter = [keys for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "chapter" in keys]
    assert len(by_chapter) == 2 and {r.new_text for r in rewritten.collect()} == {"Iain met Iain", "nobody"}
    assert resolved.where("won").count() == 2


def test_restored_texts_equal_names_replaced_in_turn(spark):
    names = {"__ENT_0__": "Li", "__ENT_1__": "Qing", "__ENT_10__": "Old Li", "__ENT_3__": "A"}
    odd = {"__ENT_0__": "3", "__ENT_3__": "under_score", "<x>": "y"}
    texts = ["__ENT_0____ENT_10__, __ENT_1__.", "__ENT_9__ __ENT_01__ __ENT_3__", "__ENT_9__ENT_0__ and __ENT___ENT_0____", "ENT_1__ none", "", "__ENT_99999999999__ <x>"]
    for mapping in (names, odd):
        rows = [("n", i, canonical, mark) for i in range(len(texts)) for mark, canonical in mapping.items()]
        frame = spark.createDataFrame([("n", i, t) for i, t in enumerate(texts)] + [("n", 77, "__ENT_0__")], "novel string, chapter bigint, text string")
        back = S.restore_entities(frame, spark.createDataFrame(rows, "novel string, chapter bigint, canonical string, placeholder string"))
        got = {r.chapter: r.text for r in back.collect()}
        for i, text in enumerate(texts):
            for mark in sorted(mapping):
                text = text.replace(mark, mapping[mark])
            assert got[i] == text
        assert got[77] == "__ENT_0__"


def test_rewrite_keeps_texts_in_parquet_only(spark):
    from glossaloom.operators.rewriting import rewrite_chapters

    policies = spark.createDataFrame([("n", "p1", "x", "Ian", "Iain", "deterministic", 0.9, 3, False, 1)], POLICY)
    forms = spark.createDataFrame([("n", "p1", 0, "Ian")], FORM)
    glossary = spark.createDataFrame([("n", "Ian", [], {})], "novel string, canonical string, aliases array<string>, metadata map<string,string>")
    result = rewrite_chapters(chapters(spark, ["ian met Ian\nthere", "nobody"]), policies, forms, glossary)["result"]
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    # Checkpointed texts lie uncompressed, several times over; only small tables may be read from there.
    assert not [line for line in plan.splitlines() if "LogicalRDD" in line and ("prepassed" in line or "text#" in line)]
    assert {(r.rewritten, r.deterministic_count) for r in result.collect()} == {("Iain met Iain\n\nthere", 2), ("nobody", 0)}

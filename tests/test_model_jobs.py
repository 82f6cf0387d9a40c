"""Jobs that call a model: style conditions, profiles, the judge, alias blocks; models are made up."""

import json

from pyspark.sql import functions as F

from glossaloom.operators import ablation as B
from glossaloom.operators import alignment as A
from glossaloom.operators import rewriting as W
from glossaloom.operators import style as ST
from test_substitution import chapters, store


def rewritten(spark, conditions=B.CONDITIONS):
    policies, forms = store(spark, [("p1", "Calron", ["Calron", "Carlon"], 0.9, 2, "deterministic", "Calron")])
    glossary = spark.createDataFrame([], "novel string, canonical string, aliases array<string>, metadata map<string,string>")
    lines = spark.createDataFrame(
        [("n", c, source, k, f"{source}{k} of {c}") for c in (1, 2) for source in ("measured", "exemplar", "tendency", "profile") for k in (2, 1)],
        "novel string, chapter bigint, source string, rank int, line string",
    )

    def model(prompts):
        body = prompts[0].split("=== (A) MACHINE TRANSLATION ===\n")[1]
        voice = prompts[0].split("<Voice>\n")[1].split("\n</Voice>")[0] if "<Voice>" in prompts[0] else "none"
        return [body + "\n\n" + voice]

    return B.ablate(chapters(spark, ["Carlon saw the gate.", "Rain fell."]), policies, forms, glossary, lines, model, conditions)


def test_conditions_show_their_lines_in_order(spark):
    got = {(r.chapter, r.condition): (r.mtl, r.generated) for r in rewritten(spark).collect()}
    assert len(got) == 8
    for chapter, mtl, text in ((1, "Carlon saw the gate.", "Calron saw the gate."), (2, "Rain fell.", "Rain fell.")):
        for condition, sources in B.CONDITIONS.items():
            voice = "\n".join(f"- {s}{k} of {chapter}" for s in sources for k in (1, 2)) or "none"
            assert got[chapter, condition] == (mtl, f"{text}\n\n{voice}")


def test_scores_and_table_by_condition(spark):
    rows = [
        ("n", 1, "A", "the old gate fell", "the old gate fell slowly. Rain came."), ("n", 1, "B", "the old gate fell", "Calron watched the ancient gate collapse."),
        ("n", 2, "A", "rain", "rain"), ("n", 3, "A", "no original", "none"),
    ]
    runs = spark.createDataFrame(rows, "novel string, chapter bigint, condition string, mtl string, generated string")
    originals = chapters(spark, ["Calron watched the ancient gate collapse.", "rain"])
    names = spark.createDataFrame([("n", 1, "Calron")], "novel string, pos int, name string")
    scores = B.ablation_scores(runs, originals, names)
    got = {(r.chapter, r.condition): r for r in scores.collect()}
    assert set(got) == {(1, "A"), (1, "B"), (2, "A")}
    best, base = got[1, "B"], got[1, "A"]
    assert best.sim_generated_original == best.sim_generated_original_norm == best.coverage == 1 and best.intrusion_score == 0
    assert all(best[f"delta_{m}"] == 0 for m in ST.METRICS) and best.voice_generated == best.voice_original
    assert base.sim_mtl_original == best.sim_mtl_original and base.sim_generated_original < 1 and base.delta_avg_sentence_length > 0
    assert best.delta_vs_mtl == round(1 - base.sim_mtl_original, 4)
    table = {r.chapter: (r.A, r.B, r.D) for r in B.ablation_table(scores).collect()}
    assert table == {1: (base.sim_generated_original, 1.0, None), 2: (got[2, "A"].sim_generated_original, None, None)}


def test_profiles_and_tendencies_of_a_model(spark):
    def model(prompts):
        if "broken" in prompts[0]:
            raise RuntimeError("down")
        if prompts[0].startswith("Describe"):
            return [f"Register: {len(p.split('TEXT:')[1].strip())}\nnothing\nDIALOGUE: curt" for p in prompts]
        return ["# notes\nformal: looser\nempty:\nformal: loose" for _ in prompts]

    texts = chapters(spark, ["x" * 5000, "", "broken"]).unionByName(chapters(spark, ["z"]).withColumn("text", F.lit(None).cast("string")).withColumn("chapter", F.lit(9).cast("bigint")))
    one = lambda df, limit: {r.chapter: r for r in ST.model_profiles(df.repartition(4, "chapter"), model, limit).collect()}
    sound = texts.where("text is null or text <> 'broken'")
    assert {c: r.profile.register for c, r in one(sound, 2000).items()} == {1: "2000", 2: "0", 9: "0"}
    whole = one(sound, None)[1]
    assert whole.profile == ("5000", "", "curt") and whole.error is None and whole.avg_sentence_length == 1
    failed = one(texts.where("text = 'broken'"), None)[3]
    assert failed.profile == ("", "", "") and "down" in failed.error
    pairs = spark.createDataFrame([(1, "a", "b"), (2, None, "")], "k int, mtl string, original string")
    for r in ST.model_tendencies(pairs, model).collect():
        assert [tuple(t) for t in r.tendencies] == [("formal", "loose")] and r.error is None


def test_judge_scores_or_says_why_not(spark):
    replies = {"good": '```json\n{"faithfulness": 4, "fluency": 5, "notes": "fine"}\n```', "odd": "I like it", "part": '{"faithfulness": 3}'}

    def model(prompts):
        return [replies[p.split("REPAIRED\n")[1]] for p in prompts]

    pairs = spark.createDataFrame([(k, "source") for k in replies], "generated string, source string")
    got = {r.generated: r for r in A.judge_chapters(pairs, model).collect()}
    assert (got["good"].faithfulness, got["good"].fluency, got["good"].notes, got["good"].error) == (4, 5, "fine", None)
    assert got["odd"].error == got["part"].error == "no scores in the reply" and got["part"].faithfulness == 3


def test_every_name_and_every_known_form_reaches_the_model(spark):
    names = [f"Name{i:03d}" for i in range(100)]
    policies, forms = store(spark, [(f"p{i}", f"Known{i:03d}", [f"Known{i:03d}", f"K{i}"], 0.9, 1, "deterministic", f"Known{i:03d}") for i in range(60)])

    def entities(batch):
        return [[(n, "PERSON", "NNP", "PROPN", 1, "s") for n in t.split()] for t in batch]

    def model(prompts):
        out = []
        for p in prompts:
            known, asked = p.split("Known names:\n")[1].split("\nNames:\n")
            assert len(asked.split("\n")) <= 45 and len(known.split("\n")) <= 50
            # a name stands for the known form of its number; a model may also answer what it was not asked
            number = lambda n: int(n[4:] or -1)
            reply = {n: f"k{number(n)}" if f"- K{number(n)} " in known else None for n in asked.split("\n")}
            out.append("```json\n" + json.dumps(reply | {"Unasked": "K1"}) + "\n```")
        return out

    texts = chapters(spark, [" ".join(names + ["He", "Name001"]), "Name059 K3", ""])
    got = {(r.chapter, r.policy_id, r.form) for r in W.bridge_aliases(texts, forms, policies, entities, model, known_block=50).collect()}
    assert got == {(1, f"p{i}", f"Name{i:03d}") for i in range(60)} | {(2, "p59", "Name059")}

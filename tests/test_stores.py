"""Verdicts, merges, lore, chunks, rewriting with a fake model, sources and streams."""

import random
import re
import zipfile

from pyspark.sql import functions as F

from glossaloom.operators import chunks as C
from glossaloom.operators import lore as L
from glossaloom.operators import rewriting as W
from glossaloom.operators import verdicts as V
from glossaloom.operators.mining import Mined
from glossaloom.sources import corpus, stores
from glossaloom.streaming import chapters as ST
from test_substitution import chapters, store


def test_roots_of_chains_and_circles(spark):
    rng = random.Random(2)
    ids = [f"p{i:02d}" for i in range(40)]
    conf = {i: rng.choice([0.5, 0.6, 0.7]) + n / 1000 for n, i in enumerate(ids)}
    edges = {i: rng.choice([j for j in ids if j != i]) for i in ids[:30]}
    edges.update({"p00": "p01", "p01": "p00", "p02": "p03", "p03": "p04", "p04": "p02"})

    def root(start):
        seen, cur = [], start
        while cur in edges and cur not in seen:
            seen.append(cur)
            if edges[cur] in seen:
                entry = edges[cur]
                return max([k for k in seen if edges[k] == entry or k == entry], key=lambda k: conf[k])
            cur = edges[cur]
        return cur

    policies = spark.createDataFrame([("n", i, c, "x") for i, c in conf.items()], "novel string, policy_id string, confidence double, trigger string")
    df = spark.createDataFrame([("n", a, b) for a, b in edges.items()], "novel string, src string, dst string")
    assert {r.src: r.root for r in V.resolve_roots(df, policies).collect()} == {i: root(i) for i in edges}


def test_chain_ends_leave_circles_out(spark):
    rows = [("n", "a", "b"), ("n", "b", "c"), ("n", "x", "y"), ("n", "y", "x"), ("n", "to", "x")]
    ended, looping = V.chain_ends(spark.createDataFrame(rows, "novel string, src string, dst string"))
    assert {(r.src, r.root) for r in ended.collect()} == {("a", "c"), ("b", "c")}
    assert {r.src for r in looping.collect()} == {"x", "y", "to"}


def test_related_spelling_in_bytes_and_empty_triggers(spark):
    names = [("d1", "Èque"), ("d2", "Èqueré"), ("d3", ""), ("d4", ""), ("d5", "Èquer")]
    p = spark.createDataFrame([("n", i, t, True, False) for i, t in names], "novel string, policy_id string, trigger string, needs_review boolean, rejected boolean")
    pairs = lambda **how: {(r.policy_id, r.related_id) for r in V.related_policies(p, **how).collect() if r.policy_id < r.related_id}
    # Two letters of six, but three bytes.
    assert pairs() == {("d1", "d2"), ("d1", "d5"), ("d2", "d5")}
    assert pairs(in_bytes=True) == {("d1", "d5"), ("d2", "d5")}


def test_related_lists_are_made_once_a_trigger(spark):
    """Fifty policies of one name are one row until the prompts are written, where each lists the others."""
    rows = [("n", f"p{i:02d}", "Aldous Brandt", "entity-naming", 0.5, True, False, i) for i in range(50)]
    rows += [("n", "q1", "Brandt", "entity-naming", 0.9, False, False, 60), ("n", "q2", "", "entity-naming", 0.5, True, False, 61), ("n", "q3", "Zo", "entity-naming", 0.5, True, False, 62)]
    p = spark.createDataFrame(rows, "novel string, policy_id string, trigger string, type string, confidence double, needs_review boolean, rejected boolean, rank bigint")
    assert {(r.trigger, r.other) for r in V.related_triggers(p).collect()} == {("Aldous Brandt", "Aldous Brandt"), ("Aldous Brandt", "Brandt"), ("Zo", "Zo")}
    assert V.related_triggers(p).count() == 3
    assert V.related_policies(p).count() == 50 * 50
    contexts = spark.createDataFrame([("n", "p00", 1, "Seen.")], "novel string, policy_id string, pos int, context string")
    prompts = sorted(V.review_prompts(Mined(p, None, None, contexts), batch_size=1).collect(), key=lambda r: r.batch)
    assert [r.ids for r in prompts] == [[f"p{i:02d}"] for i in range(50)] + [["q2"], ["q3"]]
    for i, r in enumerate(prompts[:50]):
        facts = [f"      - p{k:02d} Aldous Brandt (entity-naming, conf=0.5)" for k in range(50) if k != i] + ["      - q1 Brandt (entity-naming, conf=0.9)"]
        assert "\n    related:\n" + "\n".join(facts) + "\nReply" in r.prompt and ("example: Seen." in r.prompt) == (i == 0)
    assert not any("related:" in r.prompt for r in prompts[50:])


def mined(spark):
    policies, forms = store(spark, [
        ("p1", "Carlon", ["Carlon"], 0.5, 1, "prompted", "Carlon"), ("p2", "Calron", ["Calron", "Cal"], 0.99, 2, "deterministic", "Calron"),
        ("p3", "Rice", ["Rice"], 0.55, 1, "prompted", "Rice"), ("p4", "Sir Knight", ["Sir Knight"], 0.56, 1, "prompted", "Sir Knight")])
    policies = policies.withColumn("needs_review", F.col("policy_id") != "p2").withColumn("note", F.lit(""))
    evidence = spark.createDataFrame([("n", "p1", 1), ("n", "p1", 5), ("n", "p2", 1), ("n", "p2", 2)], "novel string, policy_id string, chapter bigint")
    contexts = spark.createDataFrame([("n", "p1", 1, "Carlon ran."), ("n", "p2", 1, "Calron sat.")], "novel string, policy_id string, pos int, context string")
    return Mined(policies, forms, evidence, contexts)


def test_decisions_merge_drop_and_retype(spark):
    s = mined(spark)
    assert {(r.policy_id, r.related_id) for r in V.related_policies(s.policies).collect()} == {("p1", "p2")}

    def model(prompts):
        assert "Carlon ran." in prompts[0] and "related" in prompts[0]
        return ['Sure: [{"id":"p1","decision":"merge_into","target_id":"p2","reason":"typo"},{"id":"p3","decision":"DROP","reason":"food"},'
                '{"id":"p4","decision":"RETYPE","type":"honorific","reason":"address"}] done']

    out, merges = V.apply_decisions(s, V.ask_decisions(s, model))
    rows = {r.policy_id: r for r in out.policies.collect()}
    assert set(rows) == {"p2", "p3", "p4"} and rows["p3"].rejected and rows["p3"].note == "food" and rows["p3"].applies == "prompted"
    assert rows["p4"].type == "honorific" and not rows["p4"].needs_review and rows["p2"].evidence_count == 3
    whole = {r.policy_id: r for r in Mined(out.policies, out.forms, out.evidence, out.contexts).assembled().collect()}["p2"]
    assert (whole.match, whole.evidence, whole.contexts) == (["Cal", "Calron", "Carlon"], [1, 2, 5], ["Calron sat.", "Carlon ran."])
    assert [(r.src, r.root, r.reason) for r in merges.collect()] == [("p1", "p2", "typo")]


def test_failed_call_keeps_its_policies(spark):
    s = mined(spark)

    def broken(prompts):
        raise RuntimeError("down")

    applied = V.apply_verdicts(s.policies, V.ask_verdicts(s, broken)).collect()
    assert {r.verdict for r in applied} == {"KEEP"} and not any(r.rejected for r in applied)


def model_chunks(text, target, minimum, cap):
    paras = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    breaks = {"***", "---", "* * *", "- - -"}
    talk = lambda p: bool(re.search("[\"“”]", p)) or p.startswith("'") or p.endswith("'")
    out, cur, size = [], [], 0
    for p in paras:
        if len(p) > cap:
            if cur:
                out, cur, size = out + ["\n\n".join(cur)], [], 0
            for piece in re.split(r"(?<=[.!?])\s+", p):
                if piece.strip():
                    if size + len(piece) > target and cur:
                        out, cur, size = out + ["\n\n".join(cur)], [], 0
                    cur.append(piece)
                    size += len(piece)
            continue
        add = len(p) + (2 if cur else 0)
        close = False
        if cur:
            live = talk(cur[-1].strip()) and talk(p)
            if size + add > cap:
                close = not live or size + add > cap + 1200
            elif size + add >= target and size >= minimum:
                close = cur[-1].strip() in breaks or p in breaks or not live
        if close:
            out, cur, size = out + ["\n\n".join(cur)], [], 0
        cur.append(p)
        size += len(p) + (2 if len(cur) > 1 else 0)
    return out + (["\n\n".join(cur)] if cur else [])


def test_chunks_equal_the_model(spark):
    rng = random.Random(9)
    parts = ["***", '"Yes," he said.', "He walked. She ran! They met?", "x" * 30, "A long one. " * 12, "'quoted'", "- - -", '"' + "y" * 40 + '"']
    texts = ["\n\n".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.chunk_text(F.col("t"), 120, 80, 140).alias("c"))
    assert {r.i: list(r.c) for r in df.collect()} == {i: model_chunks(t, 120, 80, 140) for i, t in enumerate(texts)}


def test_reference_alignment_and_integrity(spark):
    row = spark.createDataFrame([(["a\n\nb", "c", "d"], "r1\n\nr2", "First 7 and 7.\n\nSecond.", "First 7.")], "c array<string>, r string, s string, o string")
    got = row.select(
        C.align_reference(F.col("c"), F.col("r")).alias("a"), C.integrity_violations(F.col("s"), F.col("o")).alias("v"),
        C.integrity_violations(F.col("s"), F.lit(" ")).alias("e"), C.strip_echo(F.lit("```text\nHere is the repaired text:\nBody.\n```")).alias("t"),
        C.tail_paragraphs(F.lit("one")).alias("tail"),
    ).collect()[0]
    assert got.a == ["r1", "r2", "r2"] and got.v == ["fewer paragraphs", "numbers lost: 7"] and got.e == ["no output"]
    assert got.t == "Body." and got.tail == "one"
    assert C.plain_reply("First 7 and 7.\n\nSecond.", "First 7.")[1] == got.v


def test_rewrite_with_a_model(spark):
    policies, forms = store(spark, [("p1", "Calron", ["Calron", "Carlon"], 0.9, 2, "deterministic", "Calron"), ("p2", "Gate", ["gate"], 0.5, 1, "prompted", "Gate")])
    glossary = spark.createDataFrame([("n", "Calron", ["Cal"], {"gender": "male"})], "novel string, canonical string, aliases array<string>, metadata map<string,string>")
    texts = chapters(spark, ["[Carlon] saw the gate.", "Nothing 42 here.", "Plain text."])
    refs = chapters(spark, ["Calron saw the gate.", "x", "x"]).where("chapter = 1")

    def model(prompts):
        p = prompts[0]
        if p.startswith("Remove these names"):
            return ["Calron saw the gate, gladly."]
        body = p.split("=== (A) MACHINE TRANSLATION ===\n")[1].split("\n\n=== (B)")[0]
        if "__ENT_0__" in body:
            assert "- Calron [Aliases/Titles: Cal] (male)" in p and 'Write "Gate"' in p and "=== (B)" in p
            return [body.replace("saw", "and Zed saw")]
        return ["gone"] if "42" in body else [body + " Zed came."]

    def entities(batch):
        return [[("Zed", "PERSON", "NNP", "PROPN", 1, "s")] if "Zed" in t else [] for t in batch]

    out = W.rewrite_chapters(texts, policies, forms, glossary, references=refs, model_fn=model, entity_fn=entities)
    rows = {r.chapter: r for r in out["result"].collect()}
    assert rows[1].prepassed == "Calron saw the gate." and rows[1].rewritten == "Calron saw the gate, gladly." and rows[1].mode == "supervised_reference"
    assert rows[2].rewritten == "Nothing 42 here." and rows[2].warnings == ["chunk 1: numbers lost: 42"]
    assert rows[3].rewritten == "Plain text. Zed came." and rows[3].warnings == ["possible invented names: Zed"]
    assert (rows[1].deterministic_count, rows[1].prompted_count) == (1, 1)
    totals = W.run_totals(out).collect()[0]
    assert (totals.chapters, totals.edits, totals.conflicts) == (3, 1, 0)


SIGHTING = ("novel string, name string, chapter bigint, pos int, text string, quote string, gender string, race_or_identity string, "
            "speech_style string, background string")
KNOWN = ("novel string, name string, gender string, race_or_identity string, speech_style string, background string, "
         "proposed map<string,string>, verified boolean, evidence array<string>")


def fold(existing, sightings):
    state = {k: dict(v) for k, v in existing.items()}
    for s in sorted(sightings, key=lambda s: (s[2], s[3])):
        meta = dict(zip(L.FIELDS, s[6:]))
        cur = state.get(s[1])
        if cur is None:
            state[s[1]] = {**meta, "verified": False, "proposed": {}}
        elif not cur["verified"]:
            cur.update(meta)
        else:
            props = {f: meta[f] for f in ("speech_style", "race_or_identity") if meta[f] and meta[f] != cur[f]}
            if props:
                cur.update(proposed=props, verified=False)
    return state


def lore_rows(rng):
    existing = {f"N{i}": dict(gender="f", race_or_identity=rng.choice("ab"), speech_style=rng.choice("xy"), background="", verified=rng.random() < 0.6, proposed={}) for i in range(8)}
    sightings = [("n", f"N{rng.randint(0, 11)}", rng.randint(1, 6), i, "line one\nN1 spoke", "a quote", rng.choice("fm"), rng.choice(["a", "b", ""]), rng.choice(["x", "y", ""]), "") for i in range(60)]
    return existing, sightings


def known_frame(spark, existing):
    return spark.createDataFrame([("n", k, v["gender"], v["race_or_identity"], v["speech_style"], "", {}, v["verified"], []) for k, v in existing.items()], KNOWN)


def state_of(rows):
    return {r.name: (r.gender, r.race_or_identity, r.speech_style, r.verified, dict(r.proposed or {})) for r in rows}


def expected(state):
    return {k: (v["gender"], v["race_or_identity"], v["speech_style"], v["verified"], v["proposed"]) for k, v in state.items()}


def test_character_updates_equal_a_fold(spark):
    existing, sightings = lore_rows(random.Random(4))
    out = L.update_characters(known_frame(spark, existing), spark.createDataFrame(sightings, SIGHTING)).collect()
    assert state_of(out) == expected(fold(existing, sightings))
    title = [("n", "The Boy", 1, 0, "t", "The Boy ran", "m", "", "", ""), ("n", "the Knight", 1, 1, "t", "q", "m", "", "", "")]
    none = known_frame(spark, existing).limit(0)
    fresh = L.update_characters(none, spark.createDataFrame(title, SIGHTING)).collect()
    assert [r.name for r in fresh] == ["The Boy"] and fresh[0].evidence == ["The Boy ran."]


def test_lore_replies(spark):
    def model(prompts):
        return ['```json\n{"chapter_summary": "S", "characters": [{"name": "Ann", "gender": "f", "introduction_context": "Ann sat"}]}\n```' if "Ann" in p else "??" for p in prompts]

    lore = L.extract_lore(chapters(spark, ["Ann sat down.\nBo left.", "zz"]), model)
    rows = L.character_rows(lore).withColumn("q", L.evidence_quotes()).collect()
    assert [(r.name, r.chapter, r.q) for r in rows] == [("Ann", 1, ["Ann sat down."])]


def test_streams_give_the_batch_results(spark, tmp_path):
    existing, sightings = lore_rows(random.Random(6))
    known = known_frame(spark, existing)
    src = str(tmp_path / "s")
    for part in (sightings[40:], sightings[:20], sightings[20:40]):
        spark.createDataFrame(part, SIGHTING).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SIGHTING).option("maxFilesPerTrigger", 1).parquet(src)
    ST.stream_characters(stream, known, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    assert state_of(ST.current_characters(spark, known, str(tmp_path / "o")).collect()) == expected(fold(existing, sightings))

    policies, forms = store(spark, [("p1", "Mara", ["mara"], 0.9, 2, "deterministic", "Mara")])
    texts = ["then mara and Tobin left", "so Tobin met mara", "here Tobin sat"]
    path = str(tmp_path / "ch")
    for i, t in enumerate(texts + ["here Tobin stood"]):
        spark.createDataFrame([("n", min(i, 2) + 1, t)], ST.CHAPTER_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    ST.stream_prepass(ST.read_chapters(spark, path), policies, forms, str(tmp_path / "p"), str(tmp_path / "pc")).awaitTermination(120)
    done = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "p" / "texts")).collect()
    assert "then Mara and Tobin left" in {r.text for r in done} and len(done) == 4
    ST.collect_signals(ST.read_chapters(spark, path, 1), str(tmp_path / "m"), str(tmp_path / "mc")).awaitTermination(120)
    found = ST.mine_collected(spark, str(tmp_path / "m")).policies.collect()
    assert [(r.trigger, r.evidence_count, r.n_signals) for r in found] == [("Tobin", 3, 3)]


def test_reading_trees(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "001.txt").write_text("intro\n# Chapter 3\nText one.\n\nMore.\n# Ch. 4\nText two. Editor's notes here", encoding="utf-8")
    (tmp_path / "b.TXT").write_bytes(b"No heading \xff here")
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("x.xhtml", "<p># Chapter 9</p><p>Hi &amp; bye</p><script>s()</script>")
        z.writestr("note.css", "p{}")
    rows = corpus.load_corpus(spark, str(tmp_path), "n", strips=[r"(?i)editor'?s?\s*notes?"]).orderBy("chapter").collect()
    assert [(r.chapter, r.title, r.text) for r in rows] == [
        (1, "", "No heading  here"), (3, "# Chapter 3", "# Chapter 3\nText one.\n\nMore."), (4, "# Ch. 4", "# Ch. 4\nText two.  here"),
        (9, "# Chapter 9", "# Chapter 9\n\nHi & bye\ns()")]
    assert rows[1].paragraphs == ["# Chapter 3", "Text one.", "More."]
    once = corpus.chapter_rows(corpus.read_text_tree(spark, str(tmp_path)), multiline=False)
    assert once.count() == 2


def test_policy_files(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id":"p1","trigger":"A","action":{"render_as":"B"},"confidence":0.5}\n\n{"id":"p2","trigger":"C","action":"junk","confidence":0.9,"note":"n"}\n')
    df = stores.read_policies(spark, str(tmp_path / "p.jsonl"))
    assert {(r.id, r.render_as, r.applies) for r in df.collect()} == {("p1", "B", "deterministic"), ("p2", "C", "deterministic")}
    stores.write_policies(df, str(tmp_path / "out"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    assert text.index("p2") < text.index("p1") and '"category"' not in text and '"needs_review"' not in text
    assert stores.read_known_errors(spark, str(tmp_path / "none.json")).count() == 0

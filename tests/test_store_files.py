"""Stores that are written and read again, changes that repeat or chain, and top-k over several blocks."""

import random

from pyspark.sql import functions as F

from glossaloom.operators import glossary as G
from glossaloom.operators import style as S
from glossaloom.operators import verdicts as V
from glossaloom.operators.mining import Mined
from glossaloom.sources import corpus, stores
from test_substitution import store

ENTRY = (
    "novel string, entry_id string, canonical string, aliases array<string>, entity_type string, confidence double, "
    "evidence_contexts array<string>, metadata map<string,string>"
)


def entry(entry_id, name, aliases=(), meta=None, quotes=()):
    return ("n", entry_id, name, list(aliases), "entity", 0.9, list(quotes), meta or {})


def test_store_round_trip_keeps_every_field(spark, tmp_path):
    policies, forms = store(spark, [
        ("p1", "Sect", ["Sect", "The Sect"], 0.5, 1, "prompted", "Order"), ("p2", "Calron", ["Calron", "Cal"], 0.99, 2, "deterministic", "Calron")])
    policies = policies.withColumn("rejected", F.col("policy_id") == "p1").withColumn("needs_review", F.lit(True)).withColumn("note", F.lit("why"))
    evidence = spark.createDataFrame([("n", "p1", 4), ("n", "p2", 1), ("n", "p2", 2)], "novel string, policy_id string, chapter bigint")
    policies = policies.drop("evidence_count").join(evidence.groupBy("novel", "policy_id").agg(F.count("*").alias("evidence_count")), ["novel", "policy_id"])
    contexts = spark.createDataFrame([("n", "p1", 1, "The Sect fell."), ("n", "p2", 1, "Cal ran."), ("n", "p2", 2, "So.")], "novel string, policy_id string, pos int, context string")
    first = Mined(policies, forms, evidence, contexts)
    stores.write_store(first, str(tmp_path / "out"))
    again = stores.read_store(spark, str(tmp_path / "out"))
    columns = ["novel", "policy_id", "trigger", "render_as", "confidence", "applies", "needs_review", "rejected", "note", "evidence_count"]
    for name, wanted in (("policies", columns), ("forms", ["novel", "policy_id", "pos", "form"]), ("evidence", ["novel", "policy_id", "chapter"]), ("contexts", ["novel", "policy_id", "pos", "context"])):
        rows = lambda df: sorted(map(tuple, df.select(*wanted).collect()))  # noqa: B023, E731
        assert rows(getattr(again, name)) == rows(getattr(first, name)), name


def test_glossary_files_in_both_layouts(spark, tmp_path):
    rows = spark.createDataFrame([(f"Name {i}", [f"N{i}"]) for i in range(10)], "canonical string, aliases array<string>")
    stores.write_json(rows.coalesce(1), str(tmp_path / "lines"))
    assert stores.read_glossary(spark, str(tmp_path / "lines")).count() == 10
    (tmp_path / "array.json").write_text('[{"canonical": "A"}, {"canonical": "B"}]')
    assert {r.canonical for r in stores.read_glossary(spark, str(tmp_path / "array.json"), "array").collect()} == {"A", "B"}


def test_last_change_counts(spark):
    current = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    changes = spark.createDataFrame([("a", 5, 1), ("a", 3, 2), ("c", 9, 1), ("c", 9, 1)], "k string, v int, at int")
    assert sorted(map(tuple, stores.upsert(current, changes, ["k"], "at").collect())) == [("a", 3), ("b", 1), ("c", 9)]
    assert sorted(map(tuple, stores.upsert(current, changes.drop("at"), ["k"]).collect())) == [("a", 5), ("b", 1), ("c", 9)]
    policies, _ = store(spark, [("p1", "Sect", ["Sect"], 0.5, 1, "prompted", "Sect")])
    policies = policies.withColumn("note", F.lit("")).withColumn("rejected", F.lit(False))
    said = spark.createDataFrame([("n", "p1", "DROP", None, "x", 1), ("n", "p1", "KEEP", None, "y", 2)], "novel string, policy_id string, verdict string, correct_type string, reason string, at int")
    got = V.apply_verdicts(policies, said, "at").head()
    assert (got.verdict, got.rejected, got.note) == ("KEEP", False, "y")


def test_replacing_a_novel_by_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    stores.replace_novels(spark.createDataFrame([("n 1", 1), ("m", 2)], "novel string, v int"), path)
    novels = spark.createDataFrame([("n 1",), ("k",)], "novel string")
    stores.replace_novels(spark.createDataFrame([("k", 3)], "novel string, v int"), path, novels)
    assert sorted((r.novel, r.v) for r in spark.read.parquet(path).collect()) == [("k", 3), ("m", 2)]


def test_duplicates_with_long_ids(spark):
    for ids in (("1", "2"), ("entry-0000000000000000001", "entry-0000000000000000002")):
        rows = spark.createDataFrame([entry(i, "Dominic Vale") for i in ids] + [entry("9" * 30, "Other Person")], ENTRY)
        got = G.duplicate_clusters(rows).collect()
        assert sorted((r.entry_id, r.target_id) for r in got) == [(ids[0], ids[0]), (ids[1], ids[0])]
        assert all(r.reason for r in got)


def test_chained_merges_end_in_the_last_target(spark):
    rows = spark.createDataFrame([entry("a", "Ann", ["Annie"], {"gender": "f"}, ["q1"]), entry("b", "Anna", ["An"]), entry("c", "Anne", [], {}, ["q2"]), entry("d", "Dan")], ENTRY)
    policies, forms = store(spark, [(f"p{i}", name, [name], 0.9, 1, "deterministic", name) for i, name in enumerate(["Ann", "Anna", "Anne", "Dan"])])
    policies = policies.withColumn("rejected", F.lit(False)).withColumn("needs_review", F.lit(False))
    merges = spark.createDataFrame([("n", "b", "a", 1, None), ("n", "c", "b", 2, None)], "novel string, target_id string, source_id string, pos int, deterministic boolean")
    glossary, kept, _ = G.merge_entries(rows, policies, forms, merges)
    got = {r.entry_id: r for r in glossary.collect()}
    assert set(got) == {"c", "d"} and set(got["c"].aliases) == {"An", "Ann", "Anna", "Annie"}
    assert got["c"].metadata["gender"] == "f" and set(got["c"].evidence_contexts) == {"q1", "q2"}
    assert {r.trigger for r in kept.where("not rejected").collect()} == {"Anne", "Dan"}


def test_top_k_is_exact_over_many_blocks(spark):
    rng = random.Random(6)
    draw = lambda: sorted(rng.sample("abcdefghij", rng.randrange(6)))
    bank = [(g, i, draw(), rng.choice([0.0, 0.15]), rng.randrange(5)) for g in "xy" for i in range(60)]
    asked = [(g, q, draw(), rng.randrange(6)) for g in "xyz" for q in range(25)] + [("x", 99, None, 5)]
    items = spark.createDataFrame(bank, "g string, item_id int, features array<string>, bonus double, number int")
    queries = spark.createDataFrame(asked, "g string, query_id int, features array<string>, below int")
    want = []
    for g, q, have, below in asked:
        scored = []
        for h, i, own, bonus, number in bank:
            if g == h and have is not None and number < below:
                both, either = len(set(have) & set(own)), len(set(have) | set(own))
                scored.append((-(both / either if either and have and own else 0.0) - bonus, i))
        want += [(g, q, i, k) for k, (_, i) in enumerate(sorted(scored)[:4], 1)]
    for block in (7, 1000):
        got = S.top_k(queries, items, 4, "jaccard", ["g"], block, "bonus", ("number", "below"))
        assert sorted((r.g, r.query_id, r.item_id, r["rank"]) for r in got.collect()) == sorted(want)
    vectors = [(i, [rng.random() for _ in range(4)]) for i in range(40)] + [(40, [0.0] * 4)]
    bank_v = spark.createDataFrame(vectors, "item_id int, features array<double>")
    got = S.top_k(bank_v.withColumnRenamed("item_id", "query_id"), bank_v, 1, "cosine", block=9).where("query_id < 40").collect()
    assert all(r.query_id == r.item_id and abs(r.score - 1) < 1e-9 for r in got) and len(got) == 40


def test_top_k_sends_a_query_to_blocks_and_not_to_each_item(spark):
    """Items of one common token: what is shuffled for a query are blocks of the bank; ties and items of no shared token count too."""
    items = [(f"{i:03d}", ["all", f"w{i}"], 0.15 if i % 7 == 0 else 0.0, i) for i in range(100)]
    asked = [(q, ["all", f"w{q}", "none"], q + 1) for q in range(0, 100, 9)] + [(200, ["none"], 60), (201, [], 3), (202, ["all"], 0), (203, None, 5)]
    bank = spark.createDataFrame(items, "item_id string, features array<string>, bonus double, number int")
    queries = spark.createDataFrame(asked, "query_id int, features array<string>, below int")
    seen = []
    for block in (1, 3, 1000):
        got = S.top_k(queries, bank, 3, "jaccard", None, block, "bonus", ("number", "below"))
        seen.append(sorted((r.query_id, r["rank"], r.item_id, r.score) for r in got.collect()))
        if block == 1:
            assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert seen[0] == seen[1] == seen[2]
    best = {(q, k): (i, s) for q, k, i, s in seen[0]}
    assert best[200, 1] == ("000", 0.15) and best[200, 3] == ("014", 0.15) and best[201, 3] == ("002", 0.0)
    assert best[45, 1] == ("045", 2 / 3) and best[45, 2] == ("000", 1 / 4 + 0.15)
    assert not {q for q, _ in best} & {202, 203}


def test_chapters_are_seeded_from_files_once(spark, tmp_path):
    files = {
        "my novel/originals/001-The gate.txt": "One.\n\nTwo.", "my novel/originals/002.txt": "Second", "my novel/originals/notes.txt": "no number",
        "my novel/mtl/chapter-0001.txt": "mtl one", "my novel/mtl/001-x.txt": "wrong name", "a+b/originals/7-x.txt": "first name", "a+b/originals/7-y.txt": "later name", "a+b/originals/8.txt": "",
        "a+b/other/1.txt": "other folder", "a+b/mtl/chapter-99999999999999999999.txt": "no such number",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = stores.chapter_files(spark, str(tmp_path))
    rows = sorted((r.novel, r.source_type, r.number, r.text) for r in found.collect())
    assert rows == [("a+b", "original", 7, "first name"), ("my novel", "mtl", 1, "mtl one"), ("my novel", "original", 1, "One.\n\nTwo."), ("my novel", "original", 2, "Second")]
    kept = found.where("novel = 'my novel' and number = 1 and source_type = 'original'")
    added = lambda have, **how: sorted((r.novel, r.source_type, r.number) for r in stores.seed_chapters(have, found, **how).collect())
    assert added(kept) == [("a+b", "original", 7), ("my novel", "mtl", 1)]
    assert added(kept, by_file=True) == [("a+b", "original", 7), ("my novel", "mtl", 1), ("my novel", "original", 2)]
    assert added(kept.withColumn("checksum", F.lit("old")), by_file=True) == [r[:3] for r in rows]
    assert added(found) == added(found, by_file=True) == []


def test_files_of_one_name_go_by_their_order(spark):
    rows = [(3, "a/7", "late"), (1, "a/7", "first"), (2, "a/7", "mid"), (9, "A/7", "other"), (5, "b", "none")]
    files = spark.createDataFrame(rows, "page_id bigint, name string, raw string")
    assert [tuple(r) for r in corpus.index_by_number(files, "page_id").collect()] == [(7, "first")]


def test_pages_go_to_python_in_small_batches(spark):
    pages = spark.createDataFrame([("<p>One</p><script>x</script>",), (None,)], "html string")
    text = pages.select(corpus.html_to_text(F.col("html"), drop_script=True).alias("t"))
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [None if r.t is None else r.t.strip() for r in text.collect()] == ["One", None]

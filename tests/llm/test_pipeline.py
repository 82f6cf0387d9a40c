"""The pipeline's stages on planted rows, against what each must keep."""

import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_number int"


def planted(spark, folder):
    """Documents of two made-up languages; clean ones, junk, copies, near copies, leaks, empty rows."""
    rng = random.Random(8)
    sounds = {"aa": ["ba", "ka", "ta", "ra", "na"], "ee": ["be", "ke", "te", "re", "ne"]}
    word = lambda lang: "".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 6)))
    prose = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows, labels, junk = [], [], set()
    for i in range(300):
        lang = rng.choice(["aa", "ee"])
        text = prose(lang, rng.randrange(60, 200))
        if i % 5 == 4:
            text, _ = " ".join(f"{w}%%%" for w in text.split()), junk.add(i)
        rows.append([i, text, lang])
        if i % 3:
            labels.append((i, int(i not in junk), 0))
    items = [(k, prose("aa", 30)) for k in range(6)]
    rows[10][1] = rows[11][1] = rows[0][1]
    rows[12][1] = rows[1][1] + " ba"
    rows[15][1] = rows[15][1] + " " + items[2][1] + " " + prose("aa", 40)
    rows += [[900, None, "aa"], [901, "", "aa"], [902, "123 456", "ee"], [0, rows[0][1], rows[0][2]]]
    docs = [(i, t, lang, "s", len(t or ""), 1) for i, t, lang in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: t for i, t, _ in rows}, junk


def test_stages_keep_clean_documents_and_act_on_the_rest(spark, tmp_path):
    folder = f"file://{tmp_path}"
    texts, junk = planted(spark, folder)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        made = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert made.columns == docs.columns
        docs, kept[name] = made, sorted(r.doc_id for r in made.select("doc_id").collect())
    assert set(kept["language_id"]) == set(range(300)) and kept["language_id"].count(0) == 2
    assert junk.isdisjoint(kept["quality_classifier"]) and set(kept["quality_classifier"]) == set(range(300)) - junk
    assert kept["near_dedup"] == sorted(set(range(300)) - junk - {10, 11, 12})
    assert kept["decontamination"] == sorted(set(range(300)) - junk - {10, 11, 12, 15})
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert kept["sentencepiece"] == kept["decontamination"]
    for r in docs.collect():
        ids = [lib.bos_id(), *lib.encode(texts[r.doc_id]), lib.eos_id()]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_texts_that_no_language_claims_are_rejected(spark):
    sf, rng = "/root/testdata/sf0.01", random.Random(1)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(2, 9))) for _ in range(80))
    strange = [
        "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 3,
        "所有幸福的家庭都是相似的，每个不幸的家庭各有各的不幸。" * 3, noise,
        "Kaikki onnelliset perheet ovat toistensa kaltaisia, jokainen onneton perhe on onneton omalla tavallaan. " * 3,
    ]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    judged = corpus_pipeline.language_id(spark, docs.unionByName(more, allowMissingColumns=True), sf)
    kept = [r.doc_id for r in judged.select("doc_id").collect()]
    assert min(kept) >= 0 and len(kept) > 0.98 * docs.count()


def test_query_runs_the_stages(spark):
    from __spark_entry__ import queries

    sf = "/root/testdata/sf0.001"
    made = queries()["pipeline"](spark, sf)
    assert made.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert 0 < made.count() < spark.read.parquet(f"{sf}/documents.parquet").count()


def test_stages_take_odd_columns_and_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    planted(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "doc_id AS `a.b`", "1 AS id", "2 AS score", "3 AS `tick``s`")
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns, name
        rows = made.select("doc_id", "`a.b`", "score").collect()
        assert rows and all(r[0] == r[1] and r[2] == 2 for r in rows), name
    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name

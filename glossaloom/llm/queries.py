"""The registered queries of the corpus operators: thin digests of each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.llm import bagminhash, brown, chat, counting, decontaminate, langid, outliers, packing, pieces, rules, spelling
from glossaloom.llm import talktrie, twins, urltree
from glossaloom.llm.batches import hash_class, shared_folder


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = langid.fit(docs.where(hash_class("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    return langid.identify(docs, model).withColumn("held_out", hash_class("doc_id", 5) == 0)


def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    made = pieces.encode(_table(spark, sf, "documents"), model, decoded=True)
    return made.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op3_class_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = brown.fit(docs.where(hash_class("doc_id", 7) != 2))
    return brown.score(docs, model).withColumn("held_out", hash_class("doc_id", 7) == 2)


def op4_bagminhash(spark: SparkSession, sf: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf, "documents"))


def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = counting.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))
    return counting.count_tokens(_table(spark, sf, "documents"), vocabulary)


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op7_chat(spark: SparkSession, sf: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    trap = "\\### Assistant: </turn> ok"
    talk = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(talk.unionByName(extra), tokenizer), tokenizer)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.judge(_table(spark, sf, "documents"))


def op9_packed_ids(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "packed")
    packing.write_tokens(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return packing.read_documents(spark, folder, with_ids=False)


def op10_rule_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    judged = rules.judge(docs, rules.fit(docs, labels.where(hash_class("doc_id", 4) != 2)))
    return judged.select("doc_id", (hash_class("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op11_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A page's label is that of the document whose id its path names: bad if of low quality or toxic."""
    labels = _table(spark, sf, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    doc_id = F.regexp_extract(urltree.path_of(F.col("url")), r"/([0-9]{1,18})(?:[/.]|\z)", 1).try_cast("long")
    pages = _table(spark, sf, "pages").select("page_id", "url", doc_id.alias("doc_id")).join(labels, "doc_id", "left")
    return urltree.judge(pages, URL_RULES)


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns, lengths = talktrie.rebuilt(talktrie.numbered(_table(spark, sf, "conversations")))
    return talktrie.prefix_trie(turns, lengths).drop("role", "text_sha256")


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(spelling.count_words(_table(spark, sf, "documents")))


#: The filter's rules.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

QUERIES = {
    "op1_language": op1_language,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_class_model": op3_class_model,
    "op4_bagminhash": op4_bagminhash,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_chat": op7_chat,
    "op8_quality_rules": op8_quality_rules,
    "op9_packed_ids": op9_packed_ids,
    "op10_rule_quality": op10_rule_quality,
    "op11_url_filter": op11_url_filter,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op11_url_filter": twins.url_filter(URL_RULES, urltree.TreeRules()),
    "op12_conversation_trie": twins.CONVERSATION_TRIE,
    "op13_spelling_variants": twins.SPELLING_VARIANTS,
}

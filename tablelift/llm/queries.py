"""Registered queries of the text operators, with their SQL where SQL can say the same."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tablelift.llm import decontam, gam, hmm, langid, licenses, packing, periodic, pii, ranking, rules, search, simhash, toxicity
from tablelift.llm.text import id_remainder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = langid.learn(documents, documents.filter(~held_out).select("doc_id", F.col("lang").alias("label")))
    return langid.identify_language(documents.select("doc_id", held_out.alias("held_out"), "text"), model)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base score's terms of words that are not frequent come from the same join as the model's."""
    held_out = (id_remainder(F.col("doc_id"), 7) == 2).alias("held_out")
    documents = table(spark, sf_dir, "documents").select("doc_id", held_out, "text")
    return hmm.learn_and_score(documents, ~F.col("held_out"))


def _labelled(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(id_remainder(F.col("doc_id"), 4) != 2)
    return labels.select("doc_id", F.col(name).alias("label")).dropna().dropDuplicates(["doc_id"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = _labelled(spark, sf_dir, "quality")
    sample = gam.sampled_texts(documents, labelled, "label", gam.SAMPLE_ROWS, gam.SAMPLE_LONGEST)
    good, all_rows = labelled.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    drawn = sum(1 for _, label in sample if label)
    balance = 0.0
    if 0 < drawn < len(sample) and 0 < good < all_rows:
        balance = math.log(good / (all_rows - good)) - math.log(drawn / (len(sample) - drawn))
    held_out = (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return gam.score_quality(documents.select("doc_id", held_out, "text"), gam.fit_sample(sample), balance=balance)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.digest(documents, pii.learn(documents))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.tokenizer_json())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(documents, _labelled(spark, sf_dir, "toxic"))
    held_out = (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return toxicity.score_toxicity(documents.select("doc_id", held_out, "text"), model)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(periodic.with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_language_model": op2_language_model,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_search": op12_search,
    "op13_ranking": op13_ranking,
    "pipeline": pipeline,
}

ORACLES = {"op8_quality_rules": rules.SQL, "op12_search": search.SQL, "op13_ranking": ranking.SQL}

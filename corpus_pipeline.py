"""From raw documents to packed token sequences, stage by stage, with the operators of ``tablelift.llm``.

Each stage gets all rows that the one before it kept, as a table, and decides by itself. ``run`` writes the result
of every stage as Parquet below ``spark.checkpoint.dir`` and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelift.llm import decontam, langid, packing, pii, simhash
from tablelift.llm.text import id_remainder, table
from tablelift.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` becomes the predicted one."""
    labelled = docs.filter(id_remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("lang").alias("label"))
    found = langid.identify_language(docs.withColumn("_text", F.col("text")), langid.learn(docs, labelled))
    kept = langid.accepted(found).withColumn("lang", F.col("lang_pred")).withColumn("text", F.col("_text"))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, as op4 links them."""
    return simhash.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no item of the benchmark."""
    return decontam.without_leaking(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` counts the new text."""
    hidden = pii.masked(docs, pii.learn(docs))
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in token sequences."""
    return packing.pack(docs, packing.tokenizer_json())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Hashes, tokenizers and learned models are not SQL's; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

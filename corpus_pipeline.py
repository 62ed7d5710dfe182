"""A training corpus from raw documents: language, near duplicates, benchmark passages, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as the next one's docs. A row is a
document: ids may be null or repeated, each row is judged by its own text, and columns of any name come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isofold.llm import decontamination, language, mixing, pseudonyms, simhash
from isofold.llm.common import columns_of, text_key, unused, without_keys, written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go (null texts and those without a letter); a missing lang is filled in."""
    label, score = unused(docs, "lang_pred"), unused(docs, "score")
    found = language.identified(docs, language.fit_languages(docs), label, score).where(F.col(label) != language.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", label)).select(*columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays, that with the smallest id: null ids come last, and of several texts under an id the one whose digest sorts first.

    Of rows that repeat both id and text one stays, that whose columns come first as JSON. Different texts under one id are different documents.
    """
    keys = {"doc_id": F.col("doc_id").cast("long"), "text_key": text_key(F.col("text"))}
    gone, again = simhash.copies(docs, shingle=3, bits=3)
    kept = without_keys(docs, gone, keys)
    again = written(again, "again")
    if again.isEmpty():
        return kept
    id_, key, own = unused(docs, "own_id"), unused(docs, "own_key"), unused(docs, "own_row")
    few = again.limit(1_000_001).count() <= 1_000_000
    theirs = again.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    rows = docs.select(F.struct(*columns_of(docs)).alias(own), keys["doc_id"].alias(unused(docs, "the_id")), keys["text_key"].alias(unused(docs, "the_key")))
    same = rows[rows.columns[1]].eqNullSafe(theirs[id_]) & (rows[rows.columns[2]] == theirs[key])
    rows = rows.join(F.broadcast(theirs) if few else theirs, same, "left_semi").groupBy(*rows.columns[1:]).agg(F.min_by(own, F.to_json(own, {"ignoreNullFields": "false"})).alias(own))
    return without_keys(kept, again, keys).unionByName(rows.select(f"{own}.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go."""
    keys = {"text_key": text_key(F.col("text"))}
    marked = docs.select(F.col("doc_id"), F.col("text"), keys["text_key"].alias("text_key"))
    judged = decontamination.contamination(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), also=("text_key",))
    return without_keys(docs, judged.where("contaminated").select("text_key"), keys)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid personal values in texts become pseudonyms of the same format."""
    out = pseudonyms.pseudonymized(docs, pseudonyms.session_key(spark), counts=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns_of(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes.

    Places in the mix come from what pseudonyms leave as it is, so another key gives the same mix: letters, digits and signs that stand within values don't count.
    """
    return mixing.mix(docs, told_by=F.regexp_replace(F.col("text").cast("string"), "[0-9A-Za-z.:@_%+()/-]+", "a")).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("language identification", identify_languages),
    ("SimHash near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", pseudonymize),
    ("source mixture", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language identification and fingerprints aren't SQL; tests hold the pipeline against plain versions.
ORACLE_SQL = None

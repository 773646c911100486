"""A corpus pipeline of five of the llm operators: filter, deduplicate, decontaminate, redact, mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, mixing, secrets, toxicity
from tidemark.llm.textops import written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go; the lexicon is learned from the labels of documents still there."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; rows without doc_id stay."""
    extra = jaccard_join.link(docs).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mark; n_chars follows the new text; all documents stay."""
    out = secrets.redact(docs, secrets.dictionary(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one row for each row taken, with size, source_size, target, copies and taken; rows without doc_id and repeated ids are rows of their own."""
    docs = docs.select("doc_id", "text", "lang", "source")
    mark = F.concat_ws(":", *(f("text", F.lit(1), "lang", F.lit(2), "source") for f in (F.xxhash64, F.hash)))
    taken = mixing.mix(docs, mark=mark).where("copies > 0")
    taken = taken.groupBy("doc_id", "mark", "size", "source_size", "target", "copies", "taken").agg(F.count("*").alias("_rows"))
    taken, _ = written(taken.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}), "mixed")
    # Rows that are alike in all columns share one text; each comes out as often as it was taken.
    one = docs.withColumn("mark", mark).dropDuplicates(["doc_id", "mark"])
    met = one.join(taken, one.doc_id.eqNullSafe(F.col("_id")) & (one.mark == F.col("_mark")))
    met = met.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
    return met.select("doc_id", "text", "lang", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secrets", secret_spans),
    ("mixing", mixed),
]

#: SQL cannot express the cube method or the wrapped classifiers; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = written(docs, f"stage{k}")
    return docs

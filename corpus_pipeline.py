"""A corpus pipeline of five stages, each one of the operators of topograph.llm.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.llm.bpe import encode_decode
from topograph.llm.decontaminate import leaks
from topograph.llm.near_dedup import near_duplicates
from topograph.llm.quality import quality
from topograph.llm.repeats import kept_texts, remove_repeats


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those whose doc_id is among ids; a null doc_id stays."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    A doc_id that stands before several texts goes only if all of them are
    rejected. A null or empty text is scored as any other; a null doc_id stays,
    as do rows that repeat; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality(docs, labels)
    return without_ids(docs, judged.groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Rows that are equal in all columns become one, those of a null doc_id too,
    which else stay. A doc_id before several texts goes only if none of them is
    kept. Documents without words are linked with none.
    """
    found = near_duplicates(docs, k=5, percent=80)
    kept = without_ids(docs, found.groupBy("doc_id").agg(F.max(F.col("kept").cast("int")).alias("best")).where("best = 0"))
    # equal rows have equal ids, so only rows whose id repeats are compared
    again = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    again = materialize(again, "again")
    same = kept["doc_id"].eqNullSafe(again["doc_id"])
    once = kept.join(again, same, "left_anti")
    return once.union(kept.join(again, same, "left_semi").dropDuplicates())


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that start earlier in the corpus too; a document left without text goes."""
    found = remove_repeats(docs)
    left = kept_texts(docs, materialize(found.select("doc_id", "sha", "n_removed", "spans"), "cuts"))
    empty = (F.length("text") == 0) & (F.col("n_chars") > 0)
    return left.where(~F.coalesce(empty, F.lit(False))).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null and tokenless texts and null ids stay; of rows that repeat an id all go if one leaks."""
    return without_ids(docs, leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each row; a null text counts as empty."""
    return encode_decode(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("repeats", repeat_removal),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The quality stage can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

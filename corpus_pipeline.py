"""From raw documents to packed sequences: reject, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns the documents that the next one works on; the last returns pieces.
Columns of ``docs`` beyond those of documents stay, whatever their names, but the classifier's own three. Empty tables give
empty tables. Null values in any column are values like others; what null and blank texts mean a stage says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import jaccard_join, mixing, packing, quality_model, quality_rules, stages
from symloom.llm.common import written


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier finds to be neither junk nor toxic. Null and blank texts are junk; repeated rows are judged alike."""
    judged = quality_model.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source. Texts under 50 words fail; rows repeated in id, text, language and source stay or go together."""
    key, name = stages.row_key(["doc_id", "text", "lang", "source"]), stages.fresh(docs, "_key")
    judged = quality_rules.judge_quality(docs.withColumn(name, key), carry=[name])
    return stages.without(docs, judged.where("NOT kept").select(f"c_{name}"), key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more: that with the smallest id. Texts without words link with nothing and stay; of rows repeated in id and text one stays."""
    key, name = stages.row_key(["doc_id", "text"]), stages.fresh(docs, "_key")
    groups = jaccard_join.similar(docs.withColumn(name, key), k=5, percent=80, row_col=name)
    return stages.first_of_each(docs, groups, key)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to whole numbers. Texts without words, which the mix takes 0 times, stay once; rows repeated in id, text, language and source are taken alike."""
    columns, name = ["doc_id", "text", "lang", "source"], stages.fresh(docs, "_key")
    mixed = mixing.mix_documents(docs.withColumn(name, stages.row_key(columns)), carry=[name])
    return stages.repeated(docs, mixed.select(F.col(name).alias("key"), "size", "taken"), columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens. A null or empty text is the end's id alone."""
    return packing.pack_documents(docs).drop("text_key")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classifier),
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the stages that build on it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

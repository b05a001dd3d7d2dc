"""From raw documents to packed training sequences.

Each stage takes the rows that the one before it kept, stored as Parquet in the shared folder, and returns
rows with the columns of ``documents``; the last returns packed pieces.

Edge cases: stages keep all columns, whatever they are called; rows without ``doc_id`` pass where ids
decide, but for exact copies; a stage that keeps nothing hands on an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tankline.llm.common import documents, held_out, shared_folder, stored
from tankline.llm.jaccard_join import jaccard_classes
from tankline.llm.language_id import UNDETERMINED, fit, identify
from tankline.llm.mixing import mixed_documents
from tankline.llm.packing import pack_documents
from tankline.llm.quality_rules import quality_rules

#: A document whose language is less sure than this goes.
SURE = 0.5


def _with_document(docs: DataFrame) -> DataFrame:
    """All columns in one, so that their names cannot meet those of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "doc_id", "text")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and all thresholds."""
    return quality_rules(_with_document(docs), keep=("document",)).filter("kept").select("document.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognized; learned from those that the language query learns from."""
    model = fit(docs.filter(~held_out(F.col("doc_id"), 5, 0)))
    found = identify(_with_document(docs), model, keep=("document",))
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= SURE)).select("document.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id; of rows with the same id and text, one.

    Rows are told apart by id and text, so a text whose id stands with another one's copy stays.
    """
    found = jaccard_classes(docs, marked=True).filter(F.col("doc_id") != F.col("component_id"))
    copies = found.select(F.col("doc_id").alias("copy_id"), F.col("mark").alias("copy_mark")).distinct()
    mark = F.xxhash64("text")
    rest = docs.join(copies, (F.col("doc_id") == F.col("copy_id")) & (mark == F.col("copy_mark")), "left_anti")
    alike = Window.partitionBy("doc_id", mark).orderBy("text")
    number = "copy " + "_".join(docs.columns)
    return rest.withColumn(number, F.row_number().over(alike)).filter(F.col(f"`{number}`") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; what it takes in part is cut to the words taken."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", good_quality),
    ("language id", known_language),
    ("near duplicates", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL cannot express the language model; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = shared_folder(spark), documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), folder, f"stage-{number}")
    return docs

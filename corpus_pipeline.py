"""The training corpus pipeline: five stages over ``documents``, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``. A stage's scratch tables serve until its result is
written; the next stage removes them, and no others.

Every stage takes null and empty texts, very long texts, ties, repeated rows,
empty tables and further columns; its docstring says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm.common import fresh_path, own_tables, prepare, table
from tributary.llm.exact_dedup import exact_dedup
from tributary.llm.packing import pack, token_pieces
from tributary.llm.queries import tokenizer_path
from tributary.llm.sentence_dedup import substring_dedup
from tributary.llm.simhash import similar_dedup
from tributary.llm.toxicity import without_toxic


#: Under this name stages keep their scratch tables.
OWNER = "pipeline"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null texts are scored as empty ones, which stay unless nearly all labels are 1;
    whole texts are scored, however long. Rows that repeat stay or go together.
    """
    with own_tables(spark, OWNER):
        return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays.

    Null texts equal empty ones. Rows that repeat an id and a text are one document;
    a document without an id stays only where its text has no other.
    """
    with own_tables(spark, OWNER):
        return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles, the one with the smallest id stays.

    Texts without a word and rows without an id are near copies of nothing and
    stay. Rows that repeat an id are one document.
    """
    with own_tables(spark, OWNER):
        return similar_dedup(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from all documents but the first; every document stays.

    A null text stays null, a text of repeated passages alone becomes empty. Rows
    without an id stay as they are. Ties go to the smaller id, then the earlier place.
    """
    with own_tables(spark, OWNER):
        return substring_dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: each document's pieces with their ids, sequence and place there.

    Null and empty texts are one piece of the end id alone; longer ones than a
    sequence are cut. Rows that repeat, or have no id, are packed like any other.
    """
    with own_tables(spark, OWNER):
        return pack(token_pieces(docs, tokenizer_path("byte_bpe_50k.json"))).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_near_dedup", near), ("substring_dedup", substring), ("best_fit_packing", packing)]

#: The stages are a trained classifier, bit sketches and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

"""Corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next stage's docs.
All but the last return the columns of documents. Each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import line_dedup, ngram_join, packing, toxicity
from quillspan.llm._common import scratch_path
from quillspan.llm.queries import held_out, tokenizer_path
from quillspan.session import read_table, ship_package

#: A score from which a document is rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC. Columns and texts stay as they are.

    The model is fitted on the table of documents and those of its labels that are not held out.
    """
    ship_package(spark)
    model = toxicity.fit_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out())
    return model.score(docs, carry=docs.columns).where(F.col("score") < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that stand in three documents or more stay only in the one with the largest id.

    Every document stays, with n_chars counted anew; a null text comes out empty.
    """
    ship_package(spark)
    cleaned = line_dedup.line_dedup(docs, carry=docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of five-word shingles with a similarity of 0.8 or more the smallest id stays.

    Documents without words or without an id stay. Rows that repeat an id are one document.
    """
    ship_package(spark)
    found = ngram_join.ngram_components(docs, words=5, numer=80, denom=100)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, packed into sequences of 2048: a row a piece, with its sequence and offset."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_join", drop_near_copies), ("packing", pack_sequences)]

#: The toxicity model is fitted and links are followed by iteration, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder before the next begins."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

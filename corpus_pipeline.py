"""A cleaning pipeline of corpus operators: quality, language, near-duplicates, packing.

Each stage reads what its predecessor kept and drops what it rejects; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import kneser_ney, language_id, near_dedup, packing
from vecloom.llm.bpe import tokenizer_path
from vecloom.llm.common import columns_of, drop, free_names, numbered, table

TOKENIZER = "byte_bpe_50k.json"
SURE = 0.9
#: percent of similarity from which documents are near-duplicates; op6's query has a limit of its own
LINKED = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose perplexity under the model of trusted texts is above their language's quantile.

    Null texts are kept, as is everything if no text is trusted.  Repeated rows are judged each;
    extra columns stay, whatever their names; an empty table stays empty.  Texts of any length are read
    whole, in parts.
    """
    return kneser_ney.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and those that are surely of another language than they are said to be.

    Null and empty texts have no letter.  A null lang is no statement to hold a text against.  Repeated
    rows are judged each; extra columns stay, whatever their names; an empty table stays empty.  Texts of
    any length are read a segment at a time.
    """
    names = free_names(docs, "lang_pred", "score", "ambiguous")
    seen = language_id.predict(docs, language_id.fit(docs), names)
    found, score, close = (F.col(x) for x in names)
    wrong = (found != F.col("lang")) & ~close & (score >= SURE)
    return seen.where((found != language_id.UNKNOWN) & ~F.coalesce(wrong, F.lit(False))).select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near-duplicates: the smallest doc_id, the first row of several.

    Every row is a document of its own here, also if rows share a doc_id or have none.  Texts without
    words, null ones included, are near to nothing and stay.  Extra columns stay, whatever their names;
    an empty table stays empty.  Texts of any length count whole: a task holds the hashes of one text's words.
    """
    full, row = numbered(docs, "numbered")
    found = near_dedup.classes(full.select(F.col(row).alias("doc_id"), "text"), LINKED).select(F.col("doc_id").alias(row), F.col("component_id").alias("class"))
    ids = full.select(row, F.col("doc_id").alias("id")).join(found, row)
    first = ids.groupBy("class").agg(F.min_by(F.col(row), F.struct(F.col("id").isNull(), "id", row)).alias(row)).select(row)
    return full.join(first, row, "left_semi").select(*columns_of(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences.

    A null text is an end alone; repeated rows are packed each, also if they have no doc_id; extra
    columns are left out; an empty table gives an empty result.  Long texts are encoded in parts.
    """
    return packing.pack(docs, tokenizer_path(TOKENIZER))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
        drop(*before)  # the new table holds all that goes on
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the learned stages
ORACLE_SQL: str | None = None

"""A training corpus from raw documents: each stage takes what the one before it kept.

Every stage reads whole texts and takes nulls in any column, empty tables, extra columns of any name and repeated rows:

* quality_rules: a null, empty or blank text has under 20 words and goes. Repeated rows are judged alike.
* line_dedup: a null text and one of blank lines only pass. Of equal lines that of the least doc_id stays, null doc_ids last;
  a document that loses all its full lines goes, and so do rows that repeat doc_id and text.
* near_dedup: null and empty texts are one class. Of a class the row of the least doc_id stays; of rows that repeat doc_id and text one.
* decontamination: a null or empty text has no benchmark words and stays.
* packing: a null or empty text is its end id alone.

No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewise.llm.contamination import clean
from slopewise.llm.lines import dedup_lines
from slopewise.llm.near import one_of_each
from slopewise.llm.packing import pack
from slopewise.llm.quality import passing
from slopewise.llm.queries import tokenizer_path
from slopewise.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are copies of a kept line; n_chars, where there is one, follows the text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark window."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids (with start, length and checksum) with their places in packed sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


#: Each writes its rows; the next one reads them.
STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Similarity classes and packing have no SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        after = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return docs

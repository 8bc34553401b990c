"""A corpus pipeline of five stages: quality, boilerplate lines, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each result as
Parquet to the shared folder and reads it back as the next one's documents.  All but the last return
the columns of ``documents``, others that are there pass through.

Stages decide by row: rows that repeat an id with another text are documents of their own, a null id
is an id that comes after all others, and no row goes for its id alone.  A null or empty
text fails the base rule of the first stage; later stages, given one, keep it.  Equal rows are copies
of each other.  Very long texts are handled whole.  An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import jaccard, lines, packing, pii, quality
from docketry.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go, each judged by its text alone; null and empty texts fail the base rule."""
    trees = quality.train(written(quality.statistics(docs), "stats"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, trees)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on many sites go, but for their first occurrence; every row stays, null texts as they are."""
    return lines.dedup(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest doc_id.  Rows without words stay."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed spans are replaced by their kind, n_chars follows the text; every row stays, null texts as they are."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else done


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences; a null text is its end mark alone, rows of one id are packed each for itself."""
    return packing.op9_packing(spark, sf_dir, docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("packing", packed)]
#: Trees, shingle joins and tokens are beyond SQL; tests hold run() against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return docs

"""A training corpus from ``documents``: five stages, each a Spark job over all rows that its predecessor kept.

Every stage but the last returns the columns of ``documents``; the last returns
the packed pieces.  ``run`` writes each stage's rows to the shared folder and
reads them back, so a lost executor never replays an earlier stage.

Nulls and odd rows: a null or empty text has no language and goes in the first
stage; a row without a doc_id is judged by its own text in the first stage and
stays in the others.  Rows that repeat a doc_id and its text become one row in
near_dedup; rows that share a doc_id but not the text stay beside each other.
Empty tables give empty tables.  Input columns of any name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bourseline.llm import decontaminate, langid, lines, near_dup, packing
from bourseline.llm.common import load, stored

#: A document nearer to nothing than this is in none of the known languages.
LEAST_SCORE = 0.05


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one struct beside doc_id and text, so that no column of the input meets a name of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the profiles are learned from this stage's own input."""
    profiles = langid.learn_profiles(docs)
    judged = langid.identify(_whole(docs), profiles)
    return judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their text without lines that repeat an earlier one; n_chars follows the text."""
    cut = lines.without_repeats(_whole(docs), short=True)
    changed = F.col("n_removed_") > 0

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        own = F.col("row").getField(c)
        return F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(own).alias(c) if c == "n_chars" else own.alias(c)

    return cut.select(*map(column, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of every class of near duplicates; rows without a doc_id stay."""
    classes = near_dup.near_duplicates(docs).filter("doc_id = class_id").select("doc_id").distinct()
    rows = _whole(docs).select("row", "doc_id", F.xxhash64("text").alias("t"), F.xxhash64("text", F.lit(1)).alias("t2"))
    kept = rows.join(classes, "doc_id", "left_semi").dropDuplicates(["doc_id", "t", "t2"])
    return kept.select("row.*").unionByName(rows.filter("doc_id IS NULL").select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: Tokenisation, SimHash and alignment are not SQL; the tests compare each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

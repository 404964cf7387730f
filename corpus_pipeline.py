"""A training-corpus pipeline: each stage applies one operator to what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's result as Parquet in
the shared folder and reads it again as the next one's documents.

Defined results, for every stage: other columns of ``docs`` are ignored, whatever their
names; an empty table gives an empty one; rows with null or empty texts, languages,
sources or counts are rows like any other; texts are handled whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.llm._work import among, marks, put
from kinframe.llm.bpe import bpe_codec
from kinframe.llm.catalog import VOCABULARY
from kinframe.llm.decontaminate import decontaminate
from kinframe.llm.ngram_join import ngram_jaccard
from kinframe.llm.pii import find_pii
from kinframe.llm.quality import fit, quality_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as empty ones; repeated rows are scored alike and all
    stay or go; a row with a null id is scored too; without usable labels all stay (0.5).
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_scores(docs, model, keep=tuple(COLUMNS)).where("predicted = 1").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8) stays.

    It is the one with the smallest doc_id; rows equal in id and text count as one. Texts
    without words are linked with nothing and stay; rows with a null id stay as well.
    """
    docs = docs.select(COLUMNS)
    groups = put(ngram_jaccard(docs, size=5, num=80, den=100).withColumn("kept", F.expr("doc_id IS NULL OR doc_id = component_id")), "groups")
    # a document that is kept and there once is told by its id, without shuffling its text
    unsure = groups.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("kept").alias("kept")).where("doc_id IS NULL OR rows > 1 OR NOT kept")
    told = put(marks(unsure, "doc_id"), "marks")
    kept = groups.where("kept").select(F.col("doc_id").alias("id"), F.col("text_md5").alias("md5"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_md5").eqNullSafe(F.col("md5"))
    # merged at any size: what is kept follows the input, and so should the plan
    found = among(docs, "doc_id", told).withColumn("text_md5", F.md5("text")).join(kept.hint("merge"), same, "left_semi")
    return among(docs, "doc_id", told, "left_anti").union(found.dropDuplicates(["doc_id", "text_md5"]).select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Texts without words hold none; repeated rows all stay or go; benchmark items without
    words, or with null texts, match nothing.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(c for c in COLUMNS if c != "doc_id"))
    return found.where("NOT contaminated").select(COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds; every row stays.

    A null text becomes an empty one; ``n_chars`` is the length of the new text.
    """
    found = find_pii(docs, keep=("lang", "source"), redacted=True)
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the remaining documents, one row each; a null text has no tokens."""
    return bpe_codec(docs, VOCABULARY)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]

#: The stages' methods can't be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

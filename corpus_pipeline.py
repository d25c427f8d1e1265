"""A corpus pipeline of the training-data operators.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage
before kept, and returns the columns of ``documents`` (whatever they are named);
the last returns the packed sequences. Null ids and repeated rows are documents
like others, an empty table passes every stage, very long texts are handled
whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.llm import decontaminate, language, near_duplicates, packing, secrets
from newsmill.llm._common import new_path, scratch, staged, table

#: Least share of the best language of a text that is kept.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null and empty texts, those
    without a letter, and those whose best language has a share under LEAST_SCORE.
    Equal texts are judged alike."""
    names, p = language.learn(docs.where(language.remainder(4) != 2))
    told = language.classify(docs, names, p, keep=docs.columns, out=("__lang", "__share"))
    return told.where((F.col("__lang") != "und") & (F.col("__share") >= LEAST_SCORE)).select(docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the least id
    (null first), of equal ids that with the least digest. Null and empty texts
    are one group; a text of one to four words is one shingle."""
    return near_duplicates.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none;
    repeated rows are judged alike; an empty benchmark lets all stay."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), docs.columns)
    return found.where(F.size("__hits") == 0).select(docs.columns)


def clean_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked in the text (n_chars follows); every
    document stays, null and empty texts as they are."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as sequences of token ids in length buckets and batches.
    Null and empty texts are the end token alone; long texts are several
    sequences; of equal lengths the lesser id comes first."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicate),
    ("decontamination", decontaminated),
    ("secret_scan", clean_secrets),
    ("packing", pack),
]

#: Segmentation sums, banding and tokenizing are beyond SQL; tests/llm compares
#: each stage and the whole with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what a stage
    staged on the way goes when its output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), name, f"{path}/out")
    return docs

"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs; all but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillstone.llm.mixing import resample
from rillstone.llm.near_dedup import keep_one
from rillstone.llm.pieces import encode
from rillstone.store import Scratch
from rillstone.llm.substring_dedup import substring_dedup
from rillstone.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What the mix asks of the domains: the expected tokens that the stage's own input has, times these.  None is below 1, as
#: toxic and repeated documents are gone by then and the clean ones are to stay; poor ones are raised less than fine ones.
FACTORS = {"fine": 1.2, "poor": 1.1, "toxic": 1.0}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier predicts to be toxic."""
    return score_toxicity(docs, _labels(spark, sf_dir)).where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each class of near duplicates."""
    return keep_one(docs).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that an earlier document has, and leave all other text as it is; n_chars follows the text."""
    return substring_dedup(docs, layout=True).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that the domains' expected tokens are ``FACTORS`` times those of the input."""
    return resample(docs, _labels(spark, sf_dir), targets=None, factors=FACTORS).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts by their best segmentations."""
    return encode(docs).select("doc_id", "lang", "source", "n_tokens", "score", "ids", "nbest", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("mixing", mixing),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is written to the shared folder and read again, and goes when the next is written."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifiers, sampling and the lattice search have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None

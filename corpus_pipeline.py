"""A corpus from documents: toxicity, exact and near copies, mixture, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ironquill.llm import toxicity
from ironquill.llm.bpe import encoded
from ironquill.llm.exact_dedup import drop_exact_copies
from ironquill.llm.mixing import replicate
from ironquill.llm.queries import MIX_WEIGHTS, vocabulary_path
from ironquill.llm.shared import cut, table
from ironquill.llm.simhash import drop_near_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), model).filter(F.col("_score") < toxicity.THRESHOLD).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return drop_exact_copies(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest id stays."""
    return drop_near_copies(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture holds it, in random order."""
    return replicate(docs.select(*COLUMNS), MIX_WEIGHTS).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and the text that they decode to."""
    found = encoded(docs, vocabulary_path(), carry=("doc_id", "source"))
    return found.select("doc_id", "source", F.size("_ids").cast("long").alias("n_tokens"), F.col("_ids").alias("ids"), F.col("_decoded").alias("decoded"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read back as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near duplicates need hashes that SQL lacks; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None

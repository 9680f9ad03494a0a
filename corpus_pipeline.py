"""The corpus pipeline: documents through the training-data operators, stage by stage.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return the columns of
``documents`` (n_chars is set anew where a stage changes the text); the last returns one row per remaining row with
the digests of its tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, minhash, mixing, pii, toxicity
from quarry.llm.common import fresh, read, save
from quarry.llm.queries import TARGETS, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below 0.5."""
    net = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    column = fresh(docs, "_score")
    return toxicity.score(docs, net, column=column).where(F.col(column) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group: shingles of five words, similarity 0.8 or more."""
    return minhash.keep_first(docs, words=5, percent=80, base=4)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says, so that expected tokens match the target weights."""
    return mixing.resample(docs, mixing.quality_domains(read(spark, sf_dir, "labels")), TARGETS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = tokenizer()
    return bpe.encode_column(docs, path, pattern)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("pii", redact_personal_data),
          ("mixing", mix_domains), ("byte_bpe", tokenise)]

#: DuckDB SQL for the rows of run(); None: trained models and seeded draws are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, name)
    return docs

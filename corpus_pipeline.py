"""A corpus pipeline of five stages over ``documents``.

1. toxicity: documents that the conditional random field predicts toxic go.
2. similarity join: of each group of near-duplicate documents the smallest doc_id stays.
3. decontamination: documents that contain a benchmark item go.
4. secrets: secrets are masked in the text; all documents stay.
5. pieces: each text is encoded as a reproducible sampled sequence of SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again for the next.
All but the last keep the columns of ``documents``. Rows with a null text pass stages 1 to 4 unless the classifier's
prior rejects them, and have null ids; an empty table passes through; further columns are kept up to stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from betwixt.llm import decontam, pieces, secrets, simjoin, toxicity
from betwixt.llm.common import materialize, table

SIMILARITY = 0.8
CONTAINMENT = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simjoin.deduplicate(docs, similarity=SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), CONTAINMENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.sample_encode(docs, ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("toxicity", drop_toxic),
    ("similarity_join", drop_similar),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]

#: The learned and sampling stages have no SQL form; tests compare the pipeline with a plain re-computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

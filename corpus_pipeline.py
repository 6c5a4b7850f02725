"""A training corpus from `documents`: quality, near-dedup, personal data, source mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame, which is written and read
again as the next stage's docs. All but the last return the columns of documents.

Defined cases, by stage: null and empty texts are scored like others, linked with nothing, hold no personal data, have size 0
and so leave at the mixture; very long texts are taken whole throughout; ties: a score of exactly the threshold is kept,
of equal documents that of the smallest id stays, equal disclosures go by kind, rows of one id are mixed together; repeated
rows are one group, of which one row stays; empty tables give empty results; extra columns are kept up to the last stage,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import bpe, mixture, neardup, pii, quality
from ridgeline.llm.common import cut, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking scores below its threshold go."""
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a likeness of 0.8 on five-word shingles one document stays."""
    return neardup.keep_one(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base spans are generalised to their kind; terms that reveal them are removed."""
    return pii.sanitize(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left as the sources' targets ask."""
    return mixture.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes."""
    return bpe.encode_decode(docs, decoded=False, digests=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", remove_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier, the signatures and the tokenizer cannot be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{k}")
    return docs

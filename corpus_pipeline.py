"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows that the one before kept: quality rules and the
quality classifier drop what they reject, the n-gram Jaccard join keeps one
document of each group of near copies (the smallest doc_id), secret scans
replace what they find in the texts, and best-fit packing lays the tokens out.

Defined results: null texts and texts without words are rejected by the first
stage; repeated rows are copies, of which the third stage keeps one; rows are
told apart by numbers of their own, so that null or repeated identifiers lose
nothing; empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loglathe.llm import classifier, minhash, packing, quality, secrets
from loglathe.llm import common as C

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and their language's perplexity bands."""
    return quality.rules(docs, DOCUMENTS).where("kept").select(*DOCUMENTS)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label model finds good."""
    return classifier.classify(docs, through=DOCUMENTS).where("kept").select(*DOCUMENTS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id."""
    rows = C.numbered(docs, *DOCUMENTS)
    return rows.join(minhash.of_rows(rows).where("kept").select("row"), "row").select(*DOCUMENTS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, secrets replaced."""
    return secrets.redacted(docs.select(*DOCUMENTS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of everything that was kept."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", by_rules),
    ("quality classifier", by_classifier),
    ("n-gram Jaccard join", without_near_copies),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: SQL expresses neither the models nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read again for the next."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: quality, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet in the shared folder and reads them back as the next one's documents.

Defined cases, for all stages: an empty table gives an empty one; further columns stay as they are, whatever
their names; rows are counted one by one, so repeated rows are only dropped where near_duplicates says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliomatch.llm import mixing, packing, pii, quality, simhash
from foliomatch.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among docs.

    Null and empty texts are scored like others (all features 0). A score at the threshold is accepted. Without labels
    of both kinds all documents stay."""
    return quality.keep(docs, quality.classifier(spark, sf_dir, docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies (five-word shingles, Jaccard similarity of 0.8 or more).

    The smallest doc_id stays, null last, then the smallest digest of the text; null and empty texts are copies of each
    other; of rows that agree in both, that of the smallest digest of all columns."""
    return simhash.without_copies(docs)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format. n_chars stays the original's; null text stays null."""
    return pii.pseudonymise(docs, pii.configured_key(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times.

    A null source is a source, the last. Documents without words go with the one behind them in their source. Equal
    rows stay together."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 4096 tokens. Null text counts as empty: its end id alone."""
    return packing.pack(docs, packing.word_tokenizer())


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("personal_data", pseudonymised),
    ("mixture", mixed),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

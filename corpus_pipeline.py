"""The corpus pipeline: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the
shared folder and reads it again as the next stage's docs. All stages but the last return the
columns of documents; the packing finds the mixture's slots again from them. Near copies are documents that share 0.8 of their five-word shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import exact_dedup, mixing, ngram_join, packing, quality
from palimpsest.llm.common import materialize, table
from palimpsest.llm.queries import tokenizer_path


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled rows of the whole table; documents scored under 0.3 go.

    Null and empty texts are scored as one empty line; repeated rows stay or go together; an empty table stays empty.
    """
    chain = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, chain)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays.

    Null counts as empty; of rows repeated with one id one stays; a null id never beats another.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the one with the smallest doc_id stays.

    Texts without words, empty and null ones have no copies and stay.
    """
    return ngram_join.keep_one_per_group(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture; sources weigh the square root of their documents.

    A null source is a source of its own; repeated rows are ordered like any others.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids in the order of the mixture, neighbours on the curve together inside each range of its slots.

    Null and empty texts are the end id alone; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), source_col="source", added_tokens=True, keep_tables=False)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted model, tokenizer ids and a curve have no SQL; tests/llm/test_set_ops.py holds the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

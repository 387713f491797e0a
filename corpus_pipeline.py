"""A training corpus from raw documents: classified, ruled, deduplicated, mixed, encoded.

Columns beside those of documents are handed on to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docreef.llm import jaccard, mixing, pieces, quality_model, quality_rules
from docreef.llm.common import written
from docreef.llm.queries import table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labels of these documents.

    A null or empty text is judged by statistics of 0, a very long one whole; null ids are judged and never learned from;
    rows that are repeated fare alike; without labels of both kinds all stay; no rows give no rows.
    """
    return quality_model.accepted(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go.

    Null and empty texts have no words and go; very long ones are measured whole; rows that are repeated fare alike; no
    rows give no rows.
    """
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id.

    Of equal rows one stays, of several texts of a class with its smallest id the one of least fingerprint; texts without
    words (null, empty) and rows without an id all stay; very long texts are compared whole; no rows give no rows.
    """
    return jaccard.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target asks: not at all, once or twice.

    A null source is a source; null and empty texts come at the rate of a document without words; rows of one id come
    equally often; no rows give no rows.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, with proof that they decode to its text: doc_id, n_chars, n_pieces, ids_crc32, lossless,
    pieces.

    A null or empty text has the leading mark's piece alone; null ids stay; rows that are repeated are cut alike; very long
    texts are cut whole; no rows give no rows.
    """
    return pieces.round_trips(docs, tokenizer_path("piece_bpe_32k.model"), with_pieces=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: A learned classifier, sampled segmentations and Newton steps are not SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

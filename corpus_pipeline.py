"""From raw documents to token ids: five stages, each over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotledger.llm import jaccard_join, mixing, pieces, quality_classifier, quality_rules
from lotledger.llm.common import DOCUMENT_COLUMNS, materialize, read_table
from lotledger.llm.queries import piece_model


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside the fences of their language and source."""
    return quality_rules.quality_rules(docs.select(DOCUMENT_COLUMNS)).filter("kept").select(DOCUMENT_COLUMNS)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, predicts to be of quality."""
    stats = materialize(quality_classifier.with_statistics(docs.select("doc_id", "text")), "statistics")
    model = quality_classifier.fit(quality_classifier.labelled(stats, read_table(spark, sf_dir, "labels")))
    return quality_classifier.score_texts(docs.select(DOCUMENT_COLUMNS), model).filter("predicted = 1").select(DOCUMENT_COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles (similarity 0.8 or more) connect."""
    return jaccard_join.keep_one(docs.select(DOCUMENT_COLUMNS), n=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times (0, 1 or 2) as the mix of sources takes them."""
    return mixing.mix(docs.select(DOCUMENT_COLUMNS))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, their number, and the text that they decode to."""
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), piece_model(), decoded="decoded", keep_text=False)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: SQL can express neither the classifier's fit nor the SentencePiece model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs

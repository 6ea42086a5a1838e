"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    filter_audit, jaccard_join, language_id, mixing, neighbours, pieces, quality_classifier, quality_rules, sharding, suffix_tree, warc, whitening,
    wordpiece,
)
from .common import each, materialize, read_table

#: The model file that op8 applies.
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), k=20, is_query=F.col("id") % 20 == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    counted = quality_rules.with_counts(docs).drop("text")
    judged = quality_rules.judge(counted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.token_counts(docs, *wordpiece.vocabulary(piece_model()), keep_text=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = materialize(mixing.alike(mixing.sized(docs).drop("text")), "sized")
    mixed = mixing.with_copies(each(rows, "same", "copy"), mixing.plan(rows))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.parse_records(warc.records_of_pages(read_table(spark, sf_dir, "pages")))
    found = warc.resolve_revisits(records)
    lines = F.transform(F.array_sort(F.map_keys("merged")), lambda k: F.concat(k, F.lit(": "), F.col("merged")[k]))
    return found.select("record_id", "url", F.unix_timestamp("date").alias("seconds"), "response_id", "outcome", F.md5(F.array_join(lines, "\n").cast("binary")).alias("headers_md5"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, piece_model(), decoded="decoded", keep_text=False)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.lm_scores(read_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialize(quality_classifier.with_statistics(docs), "statistics")
    model = quality_classifier.fit(quality_classifier.labelled(stats, read_table(spark, sf_dir, "labels")))
    scored = quality_classifier.score(stats, model)
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read_table(spark, sf_dir, "documents"), law="rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_neighbours": op2_neighbours,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_pieces": op8_pieces,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_whitening": op11_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_sharding": op13_sharding,
}

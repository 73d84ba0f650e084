"""The queries of the training-data operators: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import language, leakage, mixing, near_duplicates, packing, pairs, quality, subjects, token_budget
from corvane.llm.bpe import Tokenizer
from corvane.llm.common import spread, table


def texts(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table for work that is heavy for each row."""
    return spread(table(spark, d, name))


def p1_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "sft_sequences"))


def p1_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p1_pack(spark, d))


def p2_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.token_budget(texts(spark, d, "download_candidates"), Tokenizer.of(table(spark, d, "tokenizer_merges")))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return language.label_documents(texts(spark, d, "corpus_docs"), table(spark, d, "corpus_labels"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(_languages(spark, d))


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d)


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.trained_quality(texts(spark, d, "corpus_docs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).where("kind in ('list', 'table', 'junk')").select("seq", "kind").distinct()


def p4_quality(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    sft = texts(spark, d, "sft_pairs")
    labelled = language.labelled_sample(texts(spark, d, "corpus_docs"), language.latest_labels(table(spark, d, "corpus_labels")))
    return pairs.defects(sft, pairs.NaiveBayes.train(labelled)).select("seq", "defect").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.all_pairs(*near_duplicates.near_duplicates(texts(spark, d, "download_candidates")))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Five words and a similarity of 0.8: one row per document with its class and number of links."""
    return near_duplicates.near_duplicate_classes(*near_duplicates.near_duplicates(texts(spark, d, "download_candidates"), shingle=5, least=0.8))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(texts(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_locations(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(texts(spark, d, "documents").select("doc_id"), _leaks(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(texts(spark, d, "documents"), table(spark, d, "mix_targets"), Tokenizer.of(table(spark, d, "tokenizer_merges")))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_posteriors(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d, "documents")
    return mixing.posteriors(docs, mixing.train_domains(docs))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d, "documents")
    return subjects.document_subjects(docs, subjects.train_subjects(docs, table(spark, d, "subject_labels"), table(spark, d, "subject_areas")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    return _subjects(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.avg("share"), 6).alias("mean_share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (p1_pack, p1_fill, p2_token_budget, p3_found, p3_segments, p4_found, p4_quality, p5_found, p6_found, p6_classes, p7_found, p7_locations, p7_clean, p8_mix, p8_shares, p8_posteriors, p9_found, p9_composition)
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    """The operators aren't expressible in SQL at whole-table scale; tests/llm holds brute-force checks of each."""
    return {}

"""The corpus pipeline: language, near-duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import _shared, decontamination, language_id, near_dups, packing, secret_scan


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models of their corpus don't reject.

    The models learn from all rows with a lang. A text without letters is rejected, so null and empty texts go. Rows without doc_id,
    or that share one, are judged each by their text. An empty table, or one without any lang, gives no rows.
    """
    _shared.prepare(spark)
    learn = docs.select("doc_id", "text", "lang")
    model = language_id.train(spark, learn)
    return language_id.accepted(spark, docs, model, language_id.calibrate(spark, learn, model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingles alike to 0.8, that of the smallest doc_id; near_dups.representatives() says which
    of rows without doc_id or that share one. Texts without words stay. An empty table gives no rows."""
    return near_dups.representatives(spark, docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, each row judged by its text; null and empty texts stay. An empty table gives no rows."""
    return decontamination.clean(spark, docs, _shared.source(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; null texts stay null. An empty table gives no rows."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, placed in sequences; a null text is empty and gives the end id alone, rows are packed each."""
    return packing.pack(spark, docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: SQL can't express the language models or the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = _shared.source(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _shared.table(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

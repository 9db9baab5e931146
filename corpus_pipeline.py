"""A training-data pipeline over ``documents``: language ID, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nymora.llm import decontaminate, langid, line_dedup, packing, simhash
from nymora.llm.common import fold, small_batches, table, texts, written


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with column names that can't clash with an operator's, and the names of doc_id and text there; they go to Python in small batches."""
    small_batches(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that are rejected (no letters, or a narrow margin) go.

    Null and empty texts have no letters, so they go; two languages that fit equally well are a narrow margin; repeated rows are judged alike, each by
    itself; a null doc_id counts as empty in the choice of learning rows; without labelled rows no language is told and all documents go.
    """
    model = langid.fit(docs.where(fold() != 0).select("doc_id", "text", "lang"))
    plain, _, text = _plain(docs)
    return langid.identify(plain, model, plain.columns, text).where(~F.col("rejected")).select(*plain.columns).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates; n_chars follows.

    A null text stays null, an empty one empty; a text all of whose lines go becomes empty; repeated rows count as one text and lose the same
    lines; an empty table gives no rows.
    """
    plain, doc_id, text = _plain(docs)
    out = line_dedup.deduplicated(plain, text, doc_id)
    if "n_chars" in docs.columns:
        n_chars = plain.columns[docs.columns.index("n_chars")]
        out = out.withColumn(n_chars, F.when(F.col("n_dropped") > 0, F.length(text).cast(plain.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (smallest doc_id) of each component of near-duplicates.

    Texts without words, null and empty ones, are one group, of which one stays; of repeated rows one stays; a null doc_id comes first, and ties of doc_id
    go by a hash of the text; an empty table gives no rows.
    """
    plain, doc_id, text = _plain(docs)
    return simhash.deduplicated(plain, text, doc_id).toDF(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark.

    Null and empty texts have no words and stay; repeated rows are judged each; with an empty benchmark all documents stay.
    """
    plain, _, text = _plain(docs)
    judged = decontaminate.judge(plain, table(spark, sf_dir, "benchmark"), plain.columns, text)
    return judged.where(~F.col("contaminated")).select(*plain.columns).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences.

    A null or empty text is its end id alone; repeated rows are packed each; equal lengths go by doc_id, start and checksum; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark_free), ("packing", packed)]

#: Compression, hashing by XXH64 and tokenization have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = texts(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

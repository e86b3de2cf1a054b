"""A training corpus from the table documents: classify, deduplicate, mix, encode.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents, whatever others there are. run() writes the result of each as a table in the shared folder and
reads it again. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import common, exact_dedup, ngram_join, piece_codec, quality, source_mix


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier rejects; it learns from labels of these documents.

    Null and empty texts, sources and languages are judged like any other; documents alike are judged alike. With fewer
    than ten labelled documents of either quality all stay.
    """
    common.prepare(spark)
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels").select("doc_id", "quality"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest doc_id.

    Null counts as the empty text. A null id loses against any other; rows that repeat the kept id and its text all stay.
    """
    common.prepare(spark)
    return exact_dedup.drop_copies(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard index of 0.8 or more over five-word shingles, the one with the smallest doc_id.

    Texts without words link with nothing and stay, as do rows of null id; rows of one id are one document.
    """
    common.prepare(spark)
    return ngram_join.one_of_each(docs, width=5, num=80, den=100)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (0 to 3) as the mix of the sources takes it.

    Null sources are one source, last in order; texts without words are never taken. Ties are ordered by shuffle key and id.
    """
    common.prepare(spark)
    return source_mix.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, and of the text: ids, their number and digest, and the digest of the text decoded from them.

    A null text counts as empty and has no ids. A row of docs is a row of the result.
    """
    common.prepare(spark)
    return piece_codec.tokenised(docs).select("doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", no_copies),
    ("near_dedup", one_of_each_group),
    ("mix", to_target_weights),
    ("encode", encoded),
]

#: The classifier and the codec are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, common.written(stage(spark, docs, sf_dir), name)
        if k:
            common.drop(before)
    return docs

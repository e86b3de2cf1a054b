"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from strandlake.llm import common, exact_dedup, language_spans, ngram_join, piece_codec, quality, secret_scan, simhash, source_mix, url_templates, warc_index


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.prepare(spark)
        return query(spark, sf_dir)

    return run


_QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_language_spans": language_spans.op2_language_spans,
    "op3_simhash": simhash.op3_simhash,
    "op4_url_templates": url_templates.op4_url_templates,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_piece_codec": piece_codec.op6_piece_codec,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_warc_index": warc_index.op9_warc_index,
    "op10_source_mix": source_mix.op10_source_mix,
}

_QUERIES["pipeline"] = corpus_pipeline.run
QUERIES = {name: shipped(query) for name, query in _QUERIES.items()}

ORACLES = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op9_warc_index": warc_index.ORACLE,
    "op10_source_mix": source_mix.ORACLE,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

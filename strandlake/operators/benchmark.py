"""Timed queries on an index: nanoseconds for each k-mer."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import matching, search
from strandlake.operators.index import KmerIndex


def _timed(df: DataFrame, n: int) -> int:
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return int((time.perf_counter() - t) * 1e9 / max(n, 1))


def random_kmers(index: KmerIndex, n: int, seed: int = 1) -> DataFrame:
    letters = [F.element_at(F.split(F.lit("A,C,G,T"), ","), (F.floor(F.rand(seed + i) * 4) + 1).cast("int")) for i in range(index.k)]
    return index.spark.range(n).select(F.col("id").alias("query_id"), F.concat(*letters).alias("seq"))


def benchmark(index: KmerIndex, n: int = 1_000_000, streams: int = 100, length: int = 10_000, seed: int = 1) -> dict[str, int | None]:
    """single_positive, single_random, streaming_random, access and bounded matching statistics, in ns a k-mer; n and lengths as given."""
    total = index.n_sets()
    real = index.kmers().orderBy(F.xxhash64("kmer", F.lit(seed))).limit(n).select(F.col("colex").alias("query_id"), F.col("kmer").alias("seq"))
    n_real = real.count()
    letters = index.spark.range(streams).select(F.col("id").alias("query_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(4)) + 1).cast("int"), F.lit(1))), "").alias("seq"))
    ranks = index.spark.range(n).select(F.floor(F.rand(seed) * total).alias("colex"))
    return {
        "single_positive_ns": _timed(search.lookup(index, real), n_real) if n_real else None,
        "single_random_ns": _timed(search.lookup(index, random_kmers(index, n, seed)), n),
        "streaming_random_ns": _timed(matching.matching_statistics(index, letters), streams * length),
        "bounded_streaming_random_ns": _timed(matching.matching_statistics(index, letters, max(index.k // 2, 1)), streams * length),
        "access_ns": _timed(search.access(index, ranks), n),
    }

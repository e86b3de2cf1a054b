"""Set operations on indexes: on their k-mers, after which the padded relation is derived anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.index import KmerIndex


def _same_k(a: KmerIndex, b: KmerIndex) -> None:
    if a.k != b.k:
        raise ValueError("the indexes differ in k")


def _only(index: KmerIndex) -> DataFrame:
    return index.nodes.where(~F.col("is_dummy")).select(F.col("node").alias("kmer"))


def _result(kmers: DataFrame, a: KmerIndex, b: KmerIndex) -> KmerIndex:
    return KmerIndex.from_kmers(kmers, a.k, precalc_length=max(a.precalc_length, b.precalc_length))


def union(a: KmerIndex, b: KmerIndex) -> KmerIndex:
    _same_k(a, b)
    return _result(_only(a).unionByName(_only(b)).distinct(), a, b)


def intersection(a: KmerIndex, b: KmerIndex) -> KmerIndex:
    _same_k(a, b)
    return _result(_only(a).join(_only(b), "kmer", "left_semi"), a, b)


def difference(a: KmerIndex, b: KmerIndex) -> KmerIndex:
    _same_k(a, b)
    return _result(_only(a).join(_only(b), "kmer", "left_anti"), a, b)


def sizes(a: KmerIndex, b: KmerIndex) -> DataFrame:
    """n_union, n_intersection, n_difference, jaccard, in one pass; the Jaccard index of two empty sets is NaN."""
    _same_k(a, b)
    both = _only(a).select("kmer", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(_only(b).select("kmer", F.lit(0).alias("x"), F.lit(1).alias("y")))
    by = both.groupBy("kmer").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    out = by.agg(F.count("*").alias("n_union"), F.count_if((F.col("x") == 1) & (F.col("y") == 1)).alias("n_intersection"), F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("n_difference"))
    share = F.coalesce(F.try_divide(F.col("n_intersection").cast("double"), F.col("n_union")), F.lit(float("nan")))
    return out.withColumn("jaccard", share)


def interleaving(a: KmerIndex, b: KmerIndex) -> DataFrame:
    """node, in1, in2, is_dummy, is_leader over the nodes of both; a leader is the first of its group in joint order."""
    _same_k(a, b)
    left = a.nodes.select("node", "is_dummy", F.lit(True).alias("in1"))
    right = b.nodes.select("node", F.col("is_dummy").alias("d2"), F.lit(True).alias("in2"))
    both = left.join(right, "node", "full_outer").select("node", F.coalesce("in1", F.lit(False)).alias("in1"), F.coalesce("in2", F.lit(False)).alias("in2"), F.coalesce("is_dummy", "d2").alias("is_dummy"))
    grp = F.right("node", F.lit(a.k - 1))
    first = both.groupBy(grp.alias("grp")).agg(F.min(F.reverse("node")).alias("first"))
    return both.withColumn("grp", grp).join(first, "grp").select("node", "in1", "in2", "is_dummy", (F.reverse("node") == F.col("first")).alias("is_leader"))

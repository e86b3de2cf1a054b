"""Verification of indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators.index import KmerIndex, kmers_of
from strandlake.sources import sequences


def invariant(index: KmerIndex) -> DataFrame:
    """n_sets, n_edges, ok: every node but the root is entered by one edge."""
    edges = sum(F.col(x).cast("long") for x in "acgt")
    out = index.nodes.agg(F.count("*").alias("n_sets"), F.coalesce(F.sum(edges), F.lit(0)).alias("n_edges"))
    return out.withColumn("ok", F.col("n_edges") + 1 == F.col("n_sets"))


def against(index: KmerIndex, kmers: DataFrame) -> DataFrame:
    """kmer, side (missing or extra): where the index differs from a set of k-mers; no rows if it doesn't."""
    mine = index.kmers().select("kmer")
    missing = kmers.select("kmer").join(mine, "kmer", "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(mine.join(kmers.select("kmer"), "kmer", "left_anti").withColumn("side", F.lit("extra")))


def against_sequences(index: KmerIndex, seqs: DataFrame, add_rev_comp: bool = False) -> DataFrame:
    if add_rev_comp:
        seqs = sequences.with_reverse_complements(seqs)
    return against(index, kmers_of(seqs.select("seq_id", dna.upper(F.col("seq")).alias("seq")), index.k))


def against_set_operation(result: KmerIndex, op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """The same against merge, intersect or difference of two sets of k-mers."""
    a, b = a.select("kmer").distinct(), b.select("kmer").distinct()
    if op == "merge":
        kmers = a.unionByName(b).distinct()
    elif op == "intersect":
        kmers = a.join(b, "kmer", "left_semi")
    elif op == "difference":
        kmers = a.join(b, "kmer", "left_anti")
    else:
        raise ValueError(f"no set operation {op}")
    return against(result, kmers)


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two relations has more often than the other."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))

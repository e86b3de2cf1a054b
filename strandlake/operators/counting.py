"""Occurrence counts of k-mers and of all shorter strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators.index import KmerIndex
from strandlake.plans import rank
from strandlake.sources import sequences


def string_counts(seqs: DataFrame, d: int) -> DataFrame:
    """str, n: occurrences of every string of d characters ACGT, straight from the input."""
    return dna.windows(sequences.dna_runs(seqs), "run", d, "str").groupBy("str").agg(F.count("*").alias("n"))


def node_counts(index: KmerIndex) -> DataFrame:
    """colex, node, n of an index built with counts: input positions whose longest match is the node."""
    if index.counts is None:
        raise ValueError("the index was built without counts")
    return index.nodes.select("colex", "node").join(index.counts, "node", "left").select("colex", "node", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def prefix_sums(index: KmerIndex) -> DataFrame:
    """colex, n, before: the count of a node and of all nodes before it."""
    out = rank.running_sums(node_counts(index).select("colex", "n"), "colex", ["n"])
    return out.select("colex", "n", F.col("before_n").cast("long").alias("before"))


def range_sums(index: KmerIndex, ranges: DataFrame) -> DataFrame:
    """ranges (lo, hi, half-open) with n, the sum of their counts: a difference of two prefix sums."""
    p = prefix_sums(index)
    total = p.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    lo = p.select(F.col("colex").alias("lo"), F.col("before").alias("a"))
    hi = p.select(F.col("colex").alias("hi"), F.col("before").alias("b"))
    whole = total.first().total
    out = ranges.join(lo, "lo", "left").join(hi, "hi", "left")
    return out.select(*ranges.columns, (F.coalesce("b", F.lit(whole)) - F.coalesce("a", F.lit(whole))).cast("long").alias("n"))


def order_counts(index: KmerIndex, order: int) -> DataFrame:
    """str, n: occurrences of all strings of an order, as sums over their ranges of an index with all dummy paths and counts."""
    if not index.all_dummy_paths:
        raise ValueError("counts of shorter strings need all dummy paths")
    nodes = node_counts(index).select(F.right("node", F.lit(order)).alias("str"), "n").where(~F.col("str").contains(dna.PAD))
    return nodes.groupBy("str").agg(F.sum("n").alias("n"))

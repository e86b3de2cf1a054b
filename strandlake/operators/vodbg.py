"""The variable-order de Bruijn graph: at every order d up to k the nodes are the strings of d characters that the index has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import matching
from strandlake.operators.index import KmerIndex
from strandlake.operators.search import intervals
from strandlake.plans import rank


class VoDbg:
    def __init__(self, index: KmerIndex):
        self.index, self.k = index, index.k

    def nodes(self, order: int) -> DataFrame:
        """str, lo, hi: all nodes of an order, in colexicographic order of lo."""
        if not 0 <= order <= self.k:
            raise ValueError("the order must be from 0 to k")
        return intervals(self.index, [order]).select("str", "lo", "hi")

    def node_iterator(self, order: int) -> DataFrame:
        return self.nodes(order).orderBy("lo")

    def get_node(self, strings: DataFrame, col: str = "str") -> DataFrame:
        """strings with lo, hi; null if the index doesn't have them or they are longer than k."""
        found = matching.bounds(self.index, strings.where((F.length(col) > 0) & (F.length(col) <= self.k)).select(F.col(col).alias("str")))
        every = F.length(col) == 0
        out = strings.join(found.withColumnRenamed("str", col), col, "left")
        return out.select(*strings.columns, F.when(every, F.lit(0)).otherwise(F.col("lo")).alias("lo"), F.when(every, F.lit(self.index.n_sets())).otherwise(F.col("hi")).alias("hi"))

    def contract_left(self, order: int, to: int) -> DataFrame:
        """str, target, lo, hi: the node of the last `to` characters."""
        at = self.nodes(order).select("str", F.right("str", F.lit(to)).alias("target"))
        return at.join(self.nodes(to).withColumnRenamed("str", "target"), "target").select("str", "target", "lo", "hi")

    def contract_right(self, order: int, to: int) -> DataFrame:
        """str, target, lo, hi: the node of the first `to` characters."""
        at = self.nodes(order).select("str", F.left("str", F.lit(to)).alias("target"))
        return at.join(self.nodes(to).withColumnRenamed("str", "target"), "target", "left").select("str", "target", "lo", "hi")

    def extend_left(self, order: int) -> DataFrame:
        """str, nth, label, target, lo, hi: the nodes of order + 1 that end in the string; nth in colexicographic order."""
        up = self.nodes(order + 1).select(F.substring("str", 2, self.k).alias("str"), F.left("str", F.lit(1)).alias("label"), F.col("str").alias("target"), "lo", "hi")
        w = Window.partitionBy("str").orderBy("lo")
        return up.select("str", (F.row_number().over(w) - 1).cast("long").alias("nth"), "label", "target", "lo", "hi")

    def extend_right(self, order: int) -> DataFrame:
        """str, label, target, lo, hi: the string followed by a character, as a node of order + 1, or of order k at k.

        Edges are those of the strings the index has, for every node and not only the first of its group.
        """
        if order < self.k:
            up = self.nodes(order + 1)
            return up.select(F.left("str", F.lit(order)).alias("str"), F.right("str", F.lit(1)).alias("label"), F.col("str").alias("target"), "lo", "hi").join(self.nodes(order).select("str"), "str", "left_semi")
        return self.edges(order)

    def edges(self, order: int) -> DataFrame:
        """str, label, target, lo, hi: edges between nodes of one order."""
        x = self.nodes(order).select("str", F.right("str", F.lit(order - 1)).alias("via"))
        y = self.nodes(order).select(F.left("str", F.lit(order - 1)).alias("via"), F.right("str", F.lit(1)).alias("label"), F.col("str").alias("target"), "lo", "hi")
        if order < self.k:  # an edge of order d is a string of d + 1 characters
            held = self.nodes(order + 1).select(F.col("str").alias("both"))
            return x.join(y, "via").withColumn("both", F.concat("str", "label")).join(held, "both", "left_semi").select("str", "label", "target", "lo", "hi")
        return x.join(y, "via").select("str", "label", "target", "lo", "hi")

    def degrees(self, order: int) -> DataFrame:
        """str, outdegree, indegree at an order."""
        e = self.edges(order)
        outs = e.groupBy("str").agg(F.count("*").alias("o"))
        ins = e.groupBy(F.col("target").alias("str")).agg(F.count("*").alias("i"))
        out = self.nodes(order).select("str").join(outs, "str", "left").join(ins, "str", "left")
        return out.select("str", F.coalesce("o", F.lit(0)).alias("outdegree"), F.coalesce("i", F.lit(0)).alias("indegree"))

    def in_neighbors(self, order: int) -> DataFrame:
        """str, nth, neighbor: predecessors in colexicographic order."""
        e = self.edges(order).select(F.col("target").alias("str"), F.col("str").alias("neighbor"))
        e = e.join(self.nodes(order).select(F.col("str").alias("neighbor"), "lo"), "neighbor")
        w = Window.partitionBy("str").orderBy("lo")
        return e.select("str", (F.row_number().over(w) - 1).cast("long").alias("nth"), "neighbor")

    def representative(self, order: int) -> DataFrame:
        """str, colex: the first row of each node's range."""
        return self.nodes(order).select("str", F.col("lo").alias("colex"))


def previous_smaller(index: KmerIndex, target: int) -> DataFrame:
    """colex, previous, next: the nearest row at or before, and at or after, with an lcs below the target; 0 and n if there is none.

    The range of the suffix of target characters of a row is [previous, next of the row after).
    """
    small = index.nodes.where(F.col("lcs") < target).select("colex")
    n = index.n_sets()
    at = rank.merged(small.select(F.col("colex").alias("key")), index.nodes.select(F.col("colex").alias("key")))
    here = small.select(F.col("colex").alias("key"), F.lit(True).alias("here"))
    out = at.join(here, "key", "left")
    return out.select(F.col("key").alias("colex"), F.when(F.col("here"), F.col("key")).otherwise(F.coalesce("prev", F.lit(0))).alias("previous"), F.coalesce("next", F.lit(n)).cast("long").alias("next"))

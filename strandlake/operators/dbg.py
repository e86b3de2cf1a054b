"""The node-centric de Bruijn graph of order k: k-mers, and an edge where one's last k-1 characters begin another."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators.index import KmerIndex
from strandlake.plans import rank, store


class Dbg:
    def __init__(self, index: KmerIndex):
        self.k = index.k
        self.nodes = index.kmers()

    @classmethod
    def of_kmers(cls, kmers: DataFrame, k: int) -> Dbg:
        out = cls.__new__(cls)
        out.k = k
        out.nodes = rank.ranked(kmers.select("kmer", F.reverse("kmer").alias("rev")), "rev", "colex").select("colex", "kmer")
        return out

    def get_node(self, kmers: DataFrame, col: str = "kmer") -> DataFrame:
        """kmers with their colex; null if absent."""
        return kmers.join(self.nodes.select(F.col("kmer").alias(col), "colex"), col, "left")

    def edges(self) -> DataFrame:
        """src, dst, label, src_colex, dst_colex."""
        x = self.nodes.select(F.col("kmer").alias("src"), F.col("colex").alias("src_colex"), F.right("kmer", F.lit(self.k - 1)).alias("via"))
        y = self.nodes.select(F.col("kmer").alias("dst"), F.col("colex").alias("dst_colex"), F.left("kmer", F.lit(self.k - 1)).alias("via"))
        return x.join(y, "via").select("src", "dst", F.right("dst", F.lit(1)).alias("label"), "src_colex", "dst_colex")

    def degrees(self) -> DataFrame:
        """kmer, outdegree, indegree. Both are counts by the shared k-1 characters: no edge is made."""
        outs = self.nodes.groupBy(F.left("kmer", F.lit(self.k - 1)).alias("a")).agg(F.count("*").alias("o"))
        ins = self.nodes.groupBy(F.right("kmer", F.lit(self.k - 1)).alias("b")).agg(F.count("*").alias("i"))
        d = self.nodes.select("kmer", F.right("kmer", F.lit(self.k - 1)).alias("a"), F.left("kmer", F.lit(self.k - 1)).alias("b"))
        d = d.join(outs, "a", "left").join(ins, "b", "left")
        return d.select("kmer", F.coalesce("o", F.lit(0)).cast("long").alias("outdegree"), F.coalesce("i", F.lit(0)).cast("long").alias("indegree"))

    def out_neighbors(self) -> DataFrame:
        """kmer, neighbor, label."""
        return self.edges().select(F.col("src").alias("kmer"), F.col("dst").alias("neighbor"), "label")

    def in_neighbors(self) -> DataFrame:
        """kmer, neighbor, label (that of the edge, the k-mer's last character)."""
        return self.edges().select(F.col("dst").alias("kmer"), F.col("src").alias("neighbor"), "label")

    def out_labels(self) -> DataFrame:
        """kmer, labels: its edges' labels in order."""
        by = self.edges().groupBy("src").agg(F.array_join(F.sort_array(F.collect_set("label")), "").alias("labels"))
        return self.nodes.select("kmer").join(by.withColumnRenamed("src", "kmer"), "kmer", "left").select("kmer", F.coalesce("labels", F.lit("")).alias("labels"))

    def follow_out(self, steps: DataFrame) -> DataFrame:
        """steps (kmer, label) with target; null where there is no such edge."""
        to = steps.withColumn("target", dna.successor(F.col("kmer"), F.col("label")))
        held = self.nodes.select(F.col("kmer").alias("target"), F.lit(True).alias("there"))
        return to.join(held, "target", "left").select("kmer", "label", F.when(F.col("there"), F.col("target")).alias("target"))

    def predecessors(self) -> DataFrame:
        """kmer, nth, neighbor: the nth predecessor (from 0) in colexicographic order."""
        w = Window.partitionBy("dst").orderBy("src_colex")
        return self.edges().select(F.col("dst").alias("kmer"), (F.row_number().over(w) - 1).cast("long").alias("nth"), F.col("src").alias("neighbor"))

    def follow_in(self, i: int) -> DataFrame:
        return self.predecessors().where(F.col("nth") == i).select("kmer", "neighbor")

    # --- unitigs
    def unary_edges(self) -> DataFrame:
        """src, dst where src has no other way out and dst no other way in."""
        outs = self.nodes.groupBy(F.left("kmer", F.lit(self.k - 1)).alias("via")).agg(F.count("*").alias("o"), F.min("kmer").alias("dst")).where("o = 1")
        ins = self.nodes.groupBy(F.right("kmer", F.lit(self.k - 1)).alias("via")).agg(F.count("*").alias("i"), F.min("kmer").alias("src")).where("i = 1")
        return ins.join(outs, "via").select("src", "dst")

    def first_kmers(self) -> DataFrame:
        """kmer: those no unary edge enters, the beginnings of acyclic unitigs."""
        return self.nodes.select("kmer").join(self.unary_edges().select(F.col("dst").alias("kmer")), "kmer", "left_anti")

    def _chains(self, nodes: DataFrame, unary: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(kmer, head, pos) of the nodes that hang on a head, and the other nodes (kmer): pointer jumping."""
        state = nodes.join(unary.select(F.col("dst").alias("kmer"), F.col("src").alias("ptr")), "kmer", "left")
        state = store.written(state.select("kmer", F.coalesce("ptr", "kmer").alias("ptr"), F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col("ptr").isNull().alias("done")), "chains")
        left = state.where("NOT done").count()
        while left:
            # a pointer to a head is final; only the others jump
            to = state.select(F.col("kmer").alias("at"), F.col("ptr").alias("p2"), F.col("dist").alias("d2"), F.col("done").alias("done2"))
            jumped = state.where("NOT done").join(to, F.col("ptr") == F.col("at")).select("kmer", F.col("p2").alias("ptr"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("done2").alias("done"))
            state = store.written(state.where("done").unionByName(jumped), "chains")
            now = state.where("NOT done").count()
            if now == left:  # as long as a chain is unfinished some of its nodes finish in every round
                break
            left = now
        return state.where("done").select("kmer", F.col("ptr").alias("head"), F.col("dist").alias("pos")), state.where("NOT done").select("kmer")

    def _cycle_starts(self, nodes: DataFrame, unary: DataFrame) -> DataFrame:
        """kmer: the smallest of each cycle; the smallest within 2**r steps is found in round r until none changes."""
        state = store.written(nodes.join(unary.select(F.col("src").alias("kmer"), F.col("dst").alias("ptr")), "kmer").withColumn("low", F.col("kmer")), "cycles")
        while True:
            to = state.select(F.col("kmer").alias("at"), F.col("ptr").alias("p2"), F.col("low").alias("l2"))
            new = store.written(state.join(to, F.col("ptr") == F.col("at")).select("kmer", F.col("p2").alias("ptr"), F.least("low", "l2").alias("low"), (F.col("l2") < F.col("low")).alias("changed")), "cycles")
            state = new.drop("changed")
            if not new.where("changed").limit(1).count():
                return state.where("kmer = low").select("kmer")

    def unitig_positions(self) -> DataFrame:
        """kmer, head, pos, is_cycle: each k-mer's unitig, named by its first k-mer, and its place there.

        A cycle begins at its smallest k-mer.
        """
        unary = store.written(self.unary_edges(), "unary")
        nodes = self.nodes.select("kmer")
        chains, rest = self._chains(nodes, unary)
        out = chains.withColumn("is_cycle", F.lit(False))
        rest = store.written(rest, "rest")
        if rest.limit(1).count():
            starts = store.written(self._cycle_starts(rest, unary), "starts")
            cut = unary.join(starts.select(F.col("kmer").alias("dst")), "dst", "left_anti").join(rest.select(F.col("kmer").alias("dst")), "dst", "left_semi").select("src", "dst")
            cycles, _ = self._chains(rest, cut)
            out = out.unionByName(cycles.withColumn("is_cycle", F.lit(True)))
        return out

    def unitigs(self) -> DataFrame:
        """unitig_id, seq, n_kmers, is_cycle; ids in order of the first k-mer."""
        at = self.unitig_positions()
        by = at.groupBy("head", "is_cycle").agg(F.array_sort(F.collect_list(F.struct("pos", F.right("kmer", F.lit(1)).alias("c")))).alias("cs"), F.count("*").alias("n_kmers"))
        seq = F.concat(F.left("head", F.lit(self.k - 1)), F.array_join(F.transform("cs", lambda x: x["c"]), ""))
        return rank.ranked(by.select("head", seq.alias("seq"), "n_kmers", "is_cycle"), "head", "unitig_id").select("unitig_id", "seq", "n_kmers", "is_cycle")


def fasta_lines(unitigs: DataFrame) -> DataFrame:
    """value: >id and the sequence, for write.text."""
    return unitigs.select(F.concat(F.lit(">"), F.col("unitig_id").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))


def orientations(unitigs: DataFrame, k: int, patience: int = 4, id_col: str = "unitig_id") -> DataFrame:
    """id, orientation (Forward or Reverse): chosen so that few sequences begin with k-1 characters that none ends with.

    In every round each sequence counts how many ends it would meet either way round; of those that gain by turning,
    the ones with the largest hash among the sequences they touch turn at once. That goes on until none gains, or until
    `patience` rounds have not lowered the number of sources. The result never has more sources than all Forward has.
    """
    ends = unitigs.select(F.col(id_col).alias("id"), dna.upper(F.col("seq")).alias("seq"))
    rc = dna.reverse_complement(F.col("seq"))
    ends = store.written(ends.select("id", F.left("seq", F.lit(k - 1)).alias("fl"), F.right("seq", F.lit(k - 1)).alias("fr"), F.left(rc, F.lit(k - 1)).alias("rl"), F.right(rc, F.lit(k - 1)).alias("rr")), "ends")
    state = ends.select("id", F.lit(False).alias("turned"))

    def sources(s: DataFrame) -> int:
        now = ends.join(s, "id").select(F.when(F.col("turned"), F.col("rl")).otherwise(F.col("fl")).alias("l"), F.when(F.col("turned"), F.col("rr")).otherwise(F.col("fr")).alias("r"))
        return now.select("l").join(now.select(F.col("r").alias("l")).distinct(), "l", "left_anti").count()

    best, kept, last = sources(state), state, 0
    for r in itertools.count():
        now = store.written(ends.join(state, "id").select("id", "turned", F.when(F.col("turned"), F.col("rl")).otherwise(F.col("fl")).alias("l"), F.when(F.col("turned"), F.col("rr")).otherwise(F.col("fr")).alias("r"), F.when(F.col("turned"), F.col("fl")).otherwise(F.col("rl")).alias("tl"), F.when(F.col("turned"), F.col("fr")).otherwise(F.col("rr")).alias("tr")), "oriented")
        begins = now.groupBy(F.col("l").alias("x")).agg(F.count("*").alias("nb"))
        finishes = now.groupBy(F.col("r").alias("x")).agg(F.count("*").alias("ne"))

        def met(left: str, right: str, name: str) -> DataFrame:
            a = now.select("id", F.col(left).alias("x")).join(finishes, "x", "left").select("id", F.least(F.coalesce("ne", F.lit(0)), F.lit(1)).alias("p"))
            b = now.select("id", F.col(right).alias("x")).join(begins, "x", "left").select("id", F.least(F.coalesce("nb", F.lit(0)), F.lit(1)).alias("q"))
            return a.join(b, "id").select("id", (F.col("p") + F.col("q")).alias(name))

        gain = met("l", "r", "as_is").join(met("tl", "tr", "if_turned"), "id").where("if_turned > as_is").select("id", F.xxhash64("id", F.lit(r)).alias("h"))
        # sequences that share an end must not turn together: the largest hash at every end wins
        touch = now.join(gain, "id").select("id", "h", F.explode(F.array("l", "r", "tl", "tr")).alias("x"))
        top = touch.groupBy("x").agg(F.max("h").alias("top"))
        turn = touch.join(top, "x").groupBy("id").agg(F.min(F.col("h") == F.col("top")).alias("wins")).where("wins").select("id", F.lit(True).alias("flip"))
        state = store.written(state.join(turn, "id", "left").select("id", (F.col("turned") != F.coalesce("flip", F.lit(False))).alias("turned")), "state")
        n = sources(state)
        if n < best:
            best, kept, last = n, state, r
        if r - last >= patience or not turn.limit(1).count():
            break
    return kept.select(F.col("id").alias(id_col), F.when(F.col("turned"), F.lit("Reverse")).otherwise(F.lit("Forward")).alias("orientation"))

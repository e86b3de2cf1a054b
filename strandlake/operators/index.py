"""The index: a relation of padded k-mers in colexicographic order, with what is derived from it.

nodes(colex, node, len, is_dummy, grp, is_leader, a, c, g, t, lcs): node is a k-mer, or a proper prefix of a k-mer that
no other k-mer precedes, padded with $ on the left; colex is its rank by the reversed string. grp is its last k-1
characters; the first node of a grp is the leader and carries the labels of the edges that leave the group. lcs is the
length of the common suffix with the node before.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.plans import rank, store
from strandlake.sources import sequences

LETTERS = "ACGT"
COLUMNS = ["colex", "node", "len", "is_dummy", "grp", "is_leader", "a", "c", "g", "t", "lcs"]


def coded_windows(seqs: DataFrame, k: int, keep: list[str] | None = None) -> DataFrame:
    """keep, code: all windows of k characters ACGT, k at most dna.CODED."""
    runs = sequences.dna_runs(seqs).withColumn("run", F.translate("run", "ACGT", "0123"))
    return dna.windows(runs, "run", k, "w", keep).select(*(keep or []), dna.coded(F.col("w")).alias("code"))


def kmers_of(seqs: DataFrame, k: int) -> DataFrame:
    """The distinct windows of k characters ACGT (column kmer). Short ones are shuffled as numbers."""
    if k <= dna.CODED:
        return coded_windows(seqs, k).distinct().select(dna.decoded(F.col("code"), k).alias("kmer"))
    return dna.windows(sequences.dna_runs(seqs), "run", k, "kmer").distinct()


def kmers_of_both_strands(seqs: DataFrame, k: int) -> DataFrame:
    """The distinct k-mers and their reverse complements, which are made of the distinct ones only."""
    one = kmers_of(seqs, k)
    return one.select(F.explode(F.array("kmer", dna.reverse_complement(F.col("kmer")))).alias("kmer")).distinct()


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, n: occurrences over all windows."""
    if k <= dna.CODED:
        return coded_windows(seqs, k).groupBy("code").agg(F.count("*").alias("n")).select(dna.decoded(F.col("code"), k).alias("kmer"), "n")
    return dna.windows(sequences.dna_runs(seqs), "run", k, "kmer").groupBy("kmer").agg(F.count("*").alias("n"))


def sources_of(kmers: DataFrame, k: int) -> DataFrame:
    """The k-mers that no k-mer precedes: none ends in their first k-1 characters. One that precedes itself is no source."""
    ends = kmers.select(F.right("kmer", F.lit(k - 1)).alias("end")).distinct()
    return kmers.join(ends, F.left("kmer", F.lit(k - 1)) == F.col("end"), "left_anti")


def padded(prefix: Column, k: int) -> Column:
    return F.lpad(prefix, k, dna.PAD)


def dummies_of(sources: DataFrame, k: int, runs: DataFrame | None = None) -> DataFrame:
    """node, len: all proper prefixes of sources and the root; with runs, also the prefixes of every run."""
    cut = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("len")
    out = sources.select("kmer", cut).select(padded(F.expr("left(kmer, len)"), k).alias("node"), "len")
    if runs is not None and k > 1:
        heads = runs.select(F.left("run", F.lit(k - 1)).alias("h")).where("length(h) > 0").distinct()
        heads = heads.select("h", F.explode(F.sequence(F.lit(1), F.length("h"))).alias("len"))
        out = out.unionByName(heads.select(padded(F.expr("left(h, len)"), k).alias("node"), "len"))
    root = sources.sparkSession.createDataFrame([(dna.PAD * k, 0)], "node string, len int")
    return out.unionByName(root).distinct()


def out_labels(nodes: DataFrame, k: int) -> DataFrame:
    """grp, a, c, g, t: by which characters any node but the root follows a group."""
    last = F.right("node", F.lit(1))
    return nodes.where("len > 0").groupBy(F.left("node", F.lit(k - 1)).alias("grp")).agg(*[F.max(last == x).alias(x.lower()) for x in LETTERS])


def ordered(nodes: DataFrame, k: int) -> DataFrame:
    """The full relation from (node, len)."""
    keyed = rank.ranked(nodes.withColumn("rev", F.reverse("node")), "rev", "colex", before="prev")
    leads = F.col("prev").isNull() | (F.left("rev", F.lit(k - 1)) != F.left("prev", F.lit(k - 1)))
    shared = F.when(F.col("prev").isNull(), F.lit(0)).otherwise(dna.common_prefix(F.col("rev"), F.col("prev"), k))
    base = keyed.select("colex", "node", F.col("len").cast("int").alias("len"), (F.col("len") < k).alias("is_dummy"), F.right("node", F.lit(k - 1)).alias("grp"), leads.alias("is_leader"), shared.cast("int").alias("lcs"))
    labels = out_labels(nodes, k)
    has = [(F.col("is_leader") & F.coalesce(F.col(f"l_{x}"), F.lit(False))).alias(x) for x in "acgt"]
    labels = labels.select("grp", *[F.col(x).alias(f"l_{x}") for x in "acgt"])
    return base.join(labels, "grp", "left").select("colex", "node", "len", "is_dummy", "grp", "is_leader", *has, "lcs")


@dataclass
class KmerIndex:
    """An index over a set of k-mers: the relation nodes and a few numbers."""

    k: int
    nodes: DataFrame
    all_dummy_paths: bool = False
    precalc_length: int = 8
    counts: DataFrame | None = None
    _kept: dict = field(default_factory=dict, repr=False)

    # --- construction
    @classmethod
    def from_kmers(cls, kmers: DataFrame, k: int, runs: DataFrame | None = None, precalc_length: int = 8, keep: bool = True) -> KmerIndex:
        """From distinct k-mers (column kmer); with runs, all dummy paths are added."""
        kmers = store.written(kmers.select("kmer"), "kmers")
        nodes = kmers.select(F.col("kmer").alias("node"), F.lit(k).alias("len")).unionByName(dummies_of(sources_of(kmers, k), k, runs))
        out = ordered(store.written(nodes, "padded"), k)
        return cls(k, store.written(out, "nodes") if keep else out, runs is not None, precalc_length)

    @classmethod
    def build(cls, seqs: DataFrame, k: int, add_rev_comp: bool = False, all_dummy_paths: bool = False, precalc_length: int = 8, count: bool = False) -> KmerIndex:
        """From sequences (seq). Any k from 1; the result doesn't depend on how the input is partitioned."""
        if k < 1:
            raise ValueError("k must be at least 1")
        seqs = seqs.select("seq_id", dna.upper(F.col("seq")).alias("seq"))
        kmers = kmers_of_both_strands(seqs, k) if add_rev_comp else kmers_of(seqs, k)
        if add_rev_comp:
            seqs = sequences.with_reverse_complements(seqs).select("seq_id", "seq")
        runs = sequences.dna_runs(seqs)
        index = cls.from_kmers(kmers, k, runs if all_dummy_paths else None, precalc_length)
        if count:
            index.counts = store.written(node_counts(runs, k), "counts")
        return index

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    # --- numbers
    def stats(self) -> DataFrame:
        """k, n_kmers, n_sets."""
        return self.nodes.agg(F.lit(self.k).alias("k"), F.count_if(~F.col("is_dummy")).alias("n_kmers"), F.count("*").alias("n_sets"))

    def n_sets(self) -> int:
        if "n" not in self._kept:
            self._kept["n"] = self.nodes.count()
        return self._kept["n"]

    def c_array(self) -> DataFrame:
        """label, c: 1 + the number of edges with a smaller label."""
        sums = self.nodes.agg(*[F.count_if(F.col(x)).alias(x) for x in "acgt"])
        rows, before = [], F.lit(1)
        for x in "acgt":
            rows.append(F.struct(F.lit(x.upper()).alias("label"), before.cast("long").alias("c")))
            before = before + F.col(x)
        return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.label", "r.c")

    def kmers(self) -> DataFrame:
        return self.nodes.where(~F.col("is_dummy")).select("colex", F.col("node").alias("kmer"))

    def labels(self) -> DataFrame:
        """colex, node, len, labels (a string of letters), lcs."""
        text = F.concat(*[F.when(F.col(x.lower()), F.lit(x)).otherwise("") for x in LETTERS])
        return self.nodes.select("colex", "node", "len", text.alias("labels"), "lcs")

    def matrix_rows(self) -> DataFrame:
        """label, bits: for each letter a string of 0 and 1 over all nodes in order (a display, for small indexes)."""
        def bits(x: str) -> Column:
            cells = F.array_sort(F.collect_list(F.struct("colex", F.col(x).cast("int").cast("string").alias("bit"))))
            return F.array_join(F.transform(cells, lambda cell: cell["bit"]), "").alias(x)

        bit = [bits(x) for x in "acgt"]
        row = self.nodes.groupBy().agg(*bit)
        return row.select(F.explode(F.array(*[F.struct(F.lit(x.upper()).alias("label"), F.col(x).alias("bits")) for x in "acgt"])).alias("r")).select("r.label", "r.bits")

    # --- edges and labels
    def edges_all(self) -> DataFrame:
        """src, dst (colex of leader and target), label: every edge of the padded graph."""
        letters = F.array_compact(F.array(*[F.when(F.col(x.lower()), F.lit(x)) for x in LETTERS]))
        out = self.nodes.where("is_leader").select(F.col("colex").alias("src"), "grp", F.explode(letters).alias("label"))
        out = out.withColumn("node", F.concat("grp", "label"))
        return out.join(self.nodes.select("node", F.col("colex").alias("dst")), "node").select("src", "dst", "label")

    def last_column(self) -> DataFrame:
        return self.nodes.select("colex", F.right("node", F.lit(1)).alias("last"))

    def inlabel(self) -> DataFrame:
        """colex, label of the edge that enters the node; null for the root."""
        last = F.right("node", F.lit(1))
        return self.nodes.select("colex", F.when(last != dna.PAD, last).alias("label"))

    def push_labels_forward(self, labels: DataFrame) -> DataFrame:
        """labels (colex, label) moved along the edges; the root gets $."""
        leader = self.nodes.where("is_leader").select("grp", F.col("colex").alias("src")).join(labels.select(F.col("colex").alias("src"), "label"), "src")
        target = self.nodes.select("colex", F.left("node", F.lit(self.k - 1)).alias("grp"), "len")
        out = target.where("len > 0").join(leader, "grp").select("colex", "label")
        return out.unionByName(target.where("len = 0").select("colex", F.lit(dna.PAD).alias("label")))

    # --- subset rank and select
    def subset_rank(self) -> DataFrame:
        """colex, rank_a..rank_t: sets before this one that hold the letter."""
        bits = self.nodes.select("colex", *[F.col(x).cast("long").alias(x) for x in "acgt"])
        out = rank.running_sums(bits, "colex", list("acgt"))
        return out.select("colex", *[F.col(f"before_{x}").cast("long").alias(f"rank_{x}") for x in "acgt"])

    def subset_select(self, letter: str) -> DataFrame:
        """nth, colex: the position of the nth set (from 0) that holds the letter."""
        x = letter.lower()
        return self.nodes.where(F.col(x)).select("colex").join(self.subset_rank().select("colex", F.col(f"rank_{x}").alias("nth")), "colex").select("nth", "colex")

    def lf_step(self, steps: DataFrame) -> DataFrame:
        """steps (colex, label) with target = C[label] + rank: where the edge leads, or would be inserted."""
        ranks = self.subset_rank().join(steps, "colex")
        by = F.coalesce(*[F.when(F.col("label") == x, F.col(f"rank_{x.lower()}")) for x in LETTERS])
        return ranks.join(F.broadcast(self.c_array()), "label").select("colex", "label", (F.col("c") + by).alias("target"))

    def inverse_lf_step(self) -> DataFrame:
        """colex, source: the leader that the node's edge comes from; null for the root."""
        back = self.edges_all().select(F.col("dst").alias("colex"), F.col("src").alias("source"))
        return self.nodes.select("colex").join(back, "colex", "left")


def node_counts(runs: DataFrame, k: int) -> DataFrame:
    """node, n: occurrences of each k-mer, and of each run prefix shorter than k, padded: every position counts at one node."""
    full = dna.windows(runs, "run", k, "node")
    if k == 1:
        return full.groupBy("node").agg(F.count("*").alias("n"))
    heads = runs.select(F.left("run", F.lit(k - 1)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    heads = heads.where("length(h) > 0").select("n", "h", F.explode(F.sequence(F.lit(1), F.length("h"))).alias("i"))
    short = heads.select(padded(F.expr("left(h, i)"), k).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n"))
    return full.groupBy("node").agg(F.count("*").alias("n")).unionByName(short)

"""Lookups: intervals of patterns, k-mer access, membership and ranks of all windows of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators.index import KmerIndex, coded_windows
from strandlake.plans import rank, store
from strandlake.sources import sequences


def intervals(index: KmerIndex, lengths: list[int]) -> DataFrame:
    """len, str, lo, hi: of every string of the given lengths that is a suffix of a node."""
    wide = [d for d in lengths if 0 < d <= index.k]
    nodes = index.nodes.select("colex", "node", F.explode(F.array(*[F.lit(d) for d in wide])).alias("d")) if wide else index.nodes.select("colex", "node", F.lit(0).alias("d")).limit(0)
    text = F.expr("right(node, d)")
    out = nodes.select("colex", "d", text.alias("str")).where(F.substring("str", 1, 1) != dna.PAD).groupBy(F.col("d").alias("len"), "str").agg(F.min("colex").alias("lo"), (F.max("colex") + 1).alias("hi"))
    if 0 in lengths:
        out = out.unionByName(index.nodes.agg(F.lit(0).alias("len"), F.lit("").alias("str"), F.lit(0).cast("long").alias("lo"), F.count("*").alias("hi")))
    return out


#: Above every character of a node.
TOP = "~"


def bounds(index: KmerIndex, strings: DataFrame, col: str = "str") -> DataFrame:
    """str, lo, hi: the range of nodes that end in each distinct string of ACGT of at most k characters; absent ones are left out."""
    held = index.nodes.select(F.reverse("node").alias("key"))
    rev = strings.select(F.reverse(col).alias("rev")).distinct()
    keys = rev.select(F.explode(F.array("rev", F.concat("rev", F.lit(TOP)))).alias("key"))
    at = rank.merged(held, keys).select("key", "below")
    lo = at.where(~F.col("key").endswith(TOP)).select(F.col("key").alias("rev"), F.col("below").alias("lo"))
    hi = at.where(F.col("key").endswith(TOP)).select(F.expr("substring(key, 1, length(key) - 1)").alias("rev"), F.col("below").alias("hi"))
    return lo.join(hi, "rev").where("lo < hi").select(F.reverse("rev").alias(col), "lo", "hi")


def search(index: KmerIndex, patterns: DataFrame, col: str = "pattern") -> DataFrame:
    """patterns with lo and hi: the half-open range of nodes that end in the pattern, null if there is none.

    The empty pattern has all nodes. A pattern longer than k, or with other characters than ACGT, has no range.
    """
    rows = patterns.withColumn("__p", dna.upper(F.col(col)))
    asked = rows.where((F.length("__p") > 0) & (F.length("__p") <= index.k) & ~F.col("__p").rlike("[^ACGT]"))
    found = bounds(index, asked.select(F.col("__p").alias("str"))).withColumnRenamed("str", "__p")
    every = F.length("__p") == 0
    out = rows.join(found, "__p", "left")
    return out.select(*patterns.columns, F.when(every, F.lit(0)).otherwise(F.col("lo")).alias("lo"), F.when(every, F.lit(index.n_sets())).otherwise(F.col("hi")).alias("hi"))


def search_from(index: KmerIndex, rows: DataFrame, start: str = "start", col: str = "pattern") -> DataFrame:
    """Continues from the nodes that end in start: the range of start followed by pattern (at most its last k characters).

    An absent start has none.
    """
    first = search(index, rows.withColumn("__s", F.col(start)), "__s").withColumnsRenamed({"lo": "__lo", "hi": "__hi"}).drop("__s")
    both = first.withColumn("__j", F.right(F.concat(start, col), F.lit(index.k)))
    out = search(index, both, "__j")
    return out.select(*rows.columns, F.when(F.col("__lo").isNotNull(), F.col("lo")).alias("lo"), F.when(F.col("__lo").isNotNull(), F.col("hi")).alias("hi"))


def prefix_table(index: KmerIndex, p: int) -> DataFrame:
    """pmer, lo, hi: of all 4**p strings in lexicographic order; absent ones have 0, 0."""
    if not 1 <= p <= min(index.k, 12):
        raise ValueError("p must be from 1 to k, and at most 12")
    every = index.spark.range(4**p).select(dna.unpacked(F.col("id"), p).alias("pmer"))
    found = intervals(index, [p]).select(F.col("str").alias("pmer"), "lo", "hi")
    return every.join(found, "pmer", "left").select("pmer", F.coalesce("lo", F.lit(0)).cast("long").alias("lo"), F.coalesce("hi", F.lit(0)).cast("long").alias("hi"))


def access(index: KmerIndex, ranks: DataFrame, col: str = "colex") -> DataFrame:
    """ranks with the node at each; null outside of the index."""
    return ranks.join(index.nodes.select(F.col("colex").alias(col), "node"), col, "left")


def kmer_at_colex(index: KmerIndex, colex: int) -> str:
    row = index.nodes.where(F.col("colex") == colex).select("node").first()
    if row is None:
        raise IndexError(f"rank {colex} is outside of the index")
    return row.node


def padded_spectrum(index: KmerIndex, dummies: bool = True) -> DataFrame:
    """colex, node, in order."""
    out = index.nodes if dummies else index.nodes.where(~F.col("is_dummy"))
    return out.select("colex", "node").orderBy("colex")


def query_windows(queries: DataFrame, k: int) -> DataFrame:
    """query_id, pos, kmer: all windows of each query, whatever characters they hold."""
    return dna.windows(queries.select("query_id", dna.upper(F.col("seq")).alias("seq")), "seq", k, "kmer", ["query_id"], start="pos")


#: Indexes of so many nodes are broadcast to the windows (some 50 bytes a node); larger ones are joined by a shuffle.
FEW_NODES = 4_000_000


def lookup(index: KmerIndex, queries: DataFrame) -> DataFrame:
    """query_id, pos, colex: the rank of every window of the queries (query_id, seq); -1 if absent. Short k-mers meet as numbers."""
    held = index.nodes.where(~F.col("is_dummy"))
    if index.k <= dna.CODED:
        digits = queries.select("query_id", dna.as_digits(dna.upper(F.col("seq"))).alias("seq"))
        asked = dna.windows(digits, "seq", index.k, "w", ["query_id"], start="pos").select("query_id", "pos", dna.coded(F.col("w")).alias("key"))
        found = held.select(dna.coded(dna.as_digits(F.col("node"))).alias("key"), "colex")
    else:
        asked = query_windows(queries, index.k).withColumnRenamed("kmer", "key")
        found = held.select(F.col("node").alias("key"), "colex")
    out = asked.join(F.broadcast(found) if index.n_sets() <= FEW_NODES else found, "key", "left")
    return out.select("query_id", "pos", F.coalesce("colex", F.lit(-1)).cast("long").alias("colex"))


def lookup_lines(index: KmerIndex, queries: DataFrame, membership_only: bool = False) -> DataFrame:
    """query_id, line: the ranks joined by spaces, or a string of 0 and 1; empty for queries shorter than k."""
    found = lookup(index, queries).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "colex"))).alias("r"))
    cell = (lambda x: (x["colex"] >= 0).cast("int").cast("string")) if membership_only else (lambda x: x["colex"].cast("string"))
    line = F.array_join(F.transform("r", cell), "" if membership_only else " ")
    return queries.select("query_id").join(found.select("query_id", line.alias("line")), "query_id", "left").select("query_id", F.coalesce("line", F.lit("")).alias("line"))


#: Sets of so many k-mers are broadcast as a filter, larger ones joined by a shuffle.
FEW_KMERS = 2_000_000


def membership(seqs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, n_kmers, n_found: windows of each query, and those that sequences (seq) have.

    Distinct windows are counted first, so that a frequent one is one row. What is asked for filters the sequences'
    windows before these are made distinct, as a broadcast table if it has FEW_KMERS at most.
    """
    windows = dna.windows(queries.select("query_id", dna.upper(F.col("seq")).alias("seq")), "seq", k, "kmer", ["query_id"])
    mine = store.written(windows.groupBy("query_id", "kmer").agg(F.count("*").alias("n")), "asked")
    asked = mine.where(~F.col("kmer").rlike("[^ACGT]")).select("kmer").distinct()
    if k <= dna.CODED:
        asked = store.written(asked.select(dna.coded(dna.as_digits(F.col("kmer"))).alias("code")), "distinct")
        met = coded_windows(seqs, k)
    else:
        asked = store.written(asked.withColumnRenamed("kmer", "code"), "distinct")
        met = dna.windows(sequences.dna_runs(seqs), "run", k, "code")
    asked = F.broadcast(asked) if asked.count() <= FEW_KMERS else asked
    met = met.join(asked, "code", "left_semi").distinct()
    met = met.select((dna.decoded(F.col("code"), k) if k <= dna.CODED else F.col("code")).alias("kmer"), F.lit(True).alias("hit"))
    hit = mine.join(met, "kmer", "left")
    return hit.groupBy("query_id").agg(F.sum("n").alias("n_kmers"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("n_found"))


def lookup_stats(index: KmerIndex, queries: DataFrame) -> DataFrame:
    """n_queried, n_found, share_found over all windows."""
    out = lookup(index, queries).agg(F.count("*").alias("n_queried"), F.count_if(F.col("colex") >= 0).alias("n_found"))
    return out.withColumn("share_found", F.try_divide(F.col("n_found").cast("double"), F.col("n_queried")))

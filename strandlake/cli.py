"""Command line: python -m strandlake.cli COMMAND ...; indexes are folders."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators import benchmark, checks, dbg, matching, search, setops
from strandlake.operators.index import KmerIndex, kmers_of
from strandlake.shipping import ship
from strandlake.sources import index_store, sequences


def _session(a: argparse.Namespace) -> SparkSession:
    """The session there is, or a local one. Of the options on resources, those count that Spark has a counterpart for."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        parts = a.threads * (8 if getattr(a, "low_ram", False) else 2)  # smaller partitions need less memory at a time
        start = SparkSession.builder.master(f"local[{a.threads}]").appName("strandlake").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(parts))
        if getattr(a, "mem_gb", None):
            start = start.config("spark.driver.memory", f"{a.mem_gb}g")
        spark = start.getOrCreate()
    if getattr(a, "temp_dir", None):
        spark.sparkContext.setCheckpointDir(a.temp_dir)
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def _input(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return sequences.read_list(spark, a.input_list) if getattr(a, "input_list", None) else sequences.read_any(spark, a.input)


def _load(spark: SparkSession, path: str, a: argparse.Namespace) -> KmerIndex:
    return index_store.import_plain_matrix(spark, path) if getattr(a, "load_cpp_format", False) else index_store.load(spark, path)


def _queries(spark: SparkSession, path: str) -> DataFrame:
    return sequences.read_any(spark, path).withColumnRenamed("seq_id", "query_id")


def build(spark, a) -> int:
    seqs = _input(spark, a)
    t = time.time()
    index = KmerIndex.build(seqs, a.k, a.add_revcomp, a.add_all_dummy_paths, a.prefix_precalc)
    index_store.save(index, a.output, "overwrite")
    if a.build_lcs:
        index.nodes.select("colex", "lcs").write.mode("overwrite").parquet(f"{a.output}.lcs")
    bits = index_store.size_bits(index, a.output).first()
    print(f"built in {time.time() - t:.1f} s: {bits.n_kmers} k-mers, {bits.bits_per_kmer or 0:.1f} bits a k-mer", file=sys.stderr)
    return 0


def build_lcs(spark, a) -> int:
    index = _load(spark, a.input, a)
    index.nodes.select("colex", "lcs").write.mode("overwrite").parquet(a.output)
    return 0


def run_benchmark(spark, a) -> int:
    record = benchmark.benchmark(_load(spark, a.input, a), a.queries, a.streams, a.length)
    print(index_store.report(record))
    return 0


def lookup(spark, a) -> int:
    index, queries = _load(spark, a.index, a), _queries(spark, a.query)
    index_store.write_lines(search.lookup_lines(index, queries, a.membership_only).orderBy("query_id"), a.output, "line", "overwrite")
    got = search.lookup_stats(index, queries).first()
    print(f"{got.n_queried} k-mers, {100 * (got.share_found or 0):.2f}% found", file=sys.stderr)
    return 0


def matching_statistics(spark, a) -> int:
    lines = matching.lines(_load(spark, a.index, a), _queries(spark, a.query), a.bound)
    index_store.write_lines(lines.orderBy("query_id"), a.output, "line", "overwrite")
    return 0


def set_operation(op):
    def run(spark, a) -> int:
        index_store.save(op(_load(spark, a.first, a), _load(spark, a.second, a)), a.output, "overwrite")
        return 0

    return run


def jaccard(spark, a) -> int:
    got = setops.sizes(_load(spark, a.first, a), _load(spark, a.second, a)).first()
    print(f"intersection {got.n_intersection}\nunion {got.n_union}\njaccard {got.jaccard}")
    return 0


def dump_kmers(spark, a) -> int:
    index = _load(spark, a.input, a)
    if a.all_at_once:  # one file
        index_store.write_lines(search.padded_spectrum(index, a.include_dummies).coalesce(1), a.output, "node", "overwrite")
    else:
        index_store.dump_kmers(index, a.output, a.include_dummies, "overwrite")
    return 0


def dump_unitigs(spark, a) -> int:
    lines = dbg.fasta_lines(dbg.Dbg(_load(spark, a.input, a)).unitigs().orderBy("unitig_id"))
    index_store.write_lines(lines, a.output, mode="overwrite")
    return 0


def stats(spark, a) -> int:
    got = _load(spark, a.input, a).stats().first()
    print(f"k-mers {got.n_kmers}\nsets {got.n_sets}")
    return 0


def kmer_at_colex(spark, a) -> int:
    try:
        print(search.kmer_at_colex(_load(spark, a.input, a), a.rank))
    except IndexError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def check(spark, a) -> int:
    index, bad = _load(spark, a.input, a), False
    if a.invariant:
        ok = checks.invariant(index).first().ok
        print("PASS" if ok else "FAIL")
        bad |= not ok
    if a.original_sequences:
        first = checks.against_sequences(index, sequences.read_any(spark, a.original_sequences), a.add_revcomp).first()
        print("PASS" if first is None else f"FAIL: {first.kmer} is {first.side}")
        bad |= first is not None
    return int(bad)


def check_set_operation(spark, a) -> int:
    result = _load(spark, a.result, a)

    def kmers(seqs: str | None, index: str | None, n: int) -> DataFrame:
        if seqs:
            return kmers_of(sequences.read_any(spark, seqs), result.k)
        unitigs = dbg.Dbg(_load(spark, index, a)).unitigs()
        if a.keep_unitigs:
            index_store.write_lines(dbg.fasta_lines(unitigs), f"{a.result}.unitigs{n}", mode="overwrite")
        return kmers_of(unitigs.select(F.col("unitig_id").alias("seq_id"), "seq"), result.k)

    first = checks.against_set_operation(result, a.op, kmers(a.seq1, a.index1, 1), kmers(a.seq2, a.index2, 2)).first()
    print("PASS" if first is None else f"FAIL: {first.kmer} is {first.side}")
    return int(first is not None)


def sort_kmers(spark, a) -> int:
    seqs = _input(spark, a).select("seq_id", dna.upper(F.col("seq")).alias("seq"))
    if a.add_revcomp:
        seqs = sequences.with_reverse_complements(seqs).select("seq_id", "seq")
    out = kmers_of(seqs, a.k).withColumn("rev", F.reverse("kmer"))
    out.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "rev").sortWithinPartitions("rev").select("kmer").write.mode("overwrite").parquet(a.output)
    return 0


def build_from_kmers(spark, a) -> int:
    kmers = spark.read.parquet(a.kmers_file)
    runs = sequences.dna_runs(_input(spark, a)) if a.input and a.add_all_dummy_paths else None
    index_store.save(KmerIndex.from_kmers(kmers, a.k, runs), a.output, "overwrite")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake")
    p.add_argument("-t", "--threads", type=int, default=4)
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *args):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        for flags, kw in args:
            s.add_argument(*flags, **kw)
        return s

    def opt(*flags, **kw):
        return flags, kw

    cpp = opt("--load-cpp-format", action="store_true")
    low = opt("--low-ram", action="store_true")
    # how an index is built is up to Spark, and the same index comes of all of these
    ways = [opt(f"--{x}", action="store_true") for x in ("in-memory", "bounded-suffix-sort", "via-libsais")]
    ways += [opt("-d", "--dedup-batches", action="store_true"), opt("--bucket-sort-prefix-length", type=int)]
    out = opt("-o", "--output", "--output-prefix", required=True)
    building = [out, opt("-k", type=int, required=True), opt("-r", "--add-revcomp", action="store_true"), opt("--add-all-dummy-paths", action="store_true"), opt("-p", "--prefix-precalc", type=int, default=8), opt("-l", "--build-lcs", action="store_true"), opt("-m", "--mem-gb", type=int), opt("--temp-dir"), *ways]

    def with_input(s, required=True):
        g = s.add_mutually_exclusive_group(required=required)
        g.add_argument("-i", "--input")
        g.add_argument("--input-list")

    with_input(add("build", build, *building))
    add("build-lcs", build_lcs, opt("-i", "--input", required=True), out, low, cpp)
    add("benchmark", run_benchmark, opt("-i", "--input", required=True), opt("--queries", type=int, default=100_000), opt("--streams", type=int, default=100), opt("--length", type=int, default=10_000), cpp)
    add("lookup", lookup, opt("-i", "--index", required=True), opt("-q", "--query", required=True), out, opt("-b", "--membership-only", action="store_true"), cpp)
    add("matching-statistics", matching_statistics, opt("-i", "--index", required=True), opt("-q", "--query", required=True), out, opt("--bound", type=int), cpp)
    for name, op in (("merge", setops.union), ("intersect", setops.intersection), ("difference", setops.difference)):
        add(name, set_operation(op), opt("first"), opt("second"), out, low, cpp)
    add("jaccard", jaccard, opt("first"), opt("second"), low, cpp)
    add("dump-kmers", dump_kmers, opt("-i", "--input", required=True), out, opt("-d", "--include-dummies", action="store_true"), opt("-a", "--all-at-once", action="store_true"), cpp)
    add("dump-unitigs", dump_unitigs, opt("-i", "--input", required=True), out, cpp)
    add("stats", stats, opt("-i", "--input", required=True), cpp)
    add("kmer-at-colex", kmer_at_colex, opt("-i", "--input", required=True), opt("-r", "--rank", type=int, required=True), cpp)
    add("check", check, opt("-i", "--input", required=True), opt("--invariant", action="store_true"), opt("-s", "--original-sequences"), opt("--add-revcomp", action="store_true"), cpp)
    add("check-set-operation", check_set_operation, opt("--op", required=True, choices=["merge", "intersect", "difference"]), *[opt(f"--{x}{n}") for x in ("seq", "index") for n in (1, 2)], opt("--result", required=True), opt("--keep-unitigs", action="store_true"), cpp)
    with_input(add("sort-kmers-to-disk", sort_kmers, *building))
    with_input(add("build-from-kmers-on-disk", build_from_kmers, opt("--kmers-file", required=True), *building), required=False)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "check" and not (a.invariant or a.original_sequences):
        parser().error("check needs --invariant or --original-sequences")
    return a.run(_session(a), a)


if __name__ == "__main__":
    sys.exit(main())

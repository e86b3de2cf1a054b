"""Queries over the driver's tables: text is mapped onto DNA, one table is indexed and another one asks.

The structure queries index `benchmark` with k = K and ask with `conversations`; the heavy scans take `documents` with
k = WIDE. Each has the same in DuckDB's SQL where SQL can say it. An index is built once a session and folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators import checks, counting, dbg, matching, search, setops, vodbg
from strandlake.operators.index import KmerIndex, dummies_of, kmer_counts, kmers_of, kmers_of_both_strands, sources_of
from strandlake.plans import store
from strandlake.shipping import ship
from strandlake.sources import index_store, sequences
from strandlake.streaming import live

K, WIDE, SETS = 7, 12, 9
QUERY_ID = "conv_id * 1000 + turn"

_indexes: dict[tuple, KmerIndex] = {}


def seqs(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "conversations":
        return sequences.from_table(df.withColumn("id", F.expr(QUERY_ID)), "id", "text")
    return sequences.from_table(df, {"documents": "doc_id", "benchmark": "item_id"}[table], "text")


def index_of(spark: SparkSession, sf_dir: str, table: str = "benchmark", k: int = K, **options) -> KmerIndex:
    key = (spark.sparkContext.applicationId, sf_dir, table, k, tuple(sorted(options.items())))
    if key not in _indexes:
        _indexes[key] = KmerIndex.build(seqs(spark, sf_dir, table), k, **options)
    return _indexes[key]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir, "conversations").withColumnRenamed("seq_id", "query_id")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each benchmark item, how many of its k-mers the documents have."""
    found = search.membership(seqs(spark, sf_dir, "documents"), seqs(spark, sf_dir, "benchmark").withColumnRenamed("seq_id", "query_id"), WIDE)
    return found.select(F.col("query_id").alias("item_id"), "n_kmers", "n_found")


def stream_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    # the file source watches a folder; the table may be one file
    table = store.written(asked(spark, sf_dir).repartition(4), "stream")
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    top = f"{store.shared_dir(spark)}/strandlake/stream-{id(table)}-{spark.sparkContext.applicationId}"
    stream = live.read(spark, path, "query_id long, seq string", 2)
    out = live.lookup(index, stream).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema("query_id long, pos long, colex long").parquet(f"{top}/out")


def stream_matching_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    whole = asked(spark, sf_dir).select("query_id", F.posexplode(F.expr("transform(sequence(0, greatest(length(seq) - 1, 0) div 64), i -> substring(seq, i * 64 + 1, 64))")).alias("chunk_no", "part"))
    # read in two micro-batches, however many files are written at once
    half = max(2, spark.sparkContext.defaultParallelism // 2)
    table = store.written(whole.withColumn("chunk_no", F.col("chunk_no").cast("long")).repartition(2 * half), "chunks")
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    top = f"{store.shared_dir(spark)}/strandlake/ms-{id(table)}-{spark.sparkContext.applicationId}"
    stream = live.read(spark, path, "query_id long, chunk_no long, part string", half)
    live.matching_statistics(index, stream, f"{top}/out", f"{top}/checkpoint").awaitTermination()
    return spark.read.schema("query_id long, pos long, len int, lo long, hi long, batch long").parquet(f"{top}/out").drop("batch")


def _set_nodes(op) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = op(index_of(spark, sf_dir, "benchmark", SETS), index_of(spark, sf_dir, "conversations", SETS))
        return out.nodes.select("colex", "node")

    return run


def _graph(spark: SparkSession, sf_dir: str) -> dbg.Dbg:
    return dbg.Dbg(index_of(spark, sf_dir))


def _vo(spark: SparkSession, sf_dir: str) -> vodbg.VoDbg:
    return vodbg.VoDbg(index_of(spark, sf_dir))


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sequences.dna_runs(seqs(spark, sf_dir, "conversations"))
    parts = [dna.windows(runs, "run", d, "pattern") for d in (3, 5, K)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def _unitig_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unitigs, their k-mers and how many of these the index lacks or has besides."""
    index = index_of(spark, sf_dir)
    u = store.written(dbg.Dbg(index).unitigs(), "unitigs")
    bad = checks.against(index, kmers_of(u.select(F.col("unitig_id").alias("seq_id"), "seq"), index.k)).agg(F.count("*").alias("n_wrong"))
    return u.agg(F.sum("n_kmers").alias("n_kmers")).select(F.lit(1).alias("j"), "n_kmers").join(bad.select(F.lit(1).alias("j"), "n_wrong"), "j").drop("j")


def _orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = store.written(_graph(spark, sf_dir).unitigs(), "unitigs")
    return dbg.orientations(u.select("unitig_id", "seq"), K)


def _counted(spark: SparkSession, sf_dir: str) -> KmerIndex:
    return index_of(spark, sf_dir, all_dummy_paths=True, count=True)


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{store.shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, seq: benchmark's sequences with N for all other characters, as files of sequences have them."""
    return seqs(spark, sf_dir, "benchmark").select("seq_id", F.regexp_replace("seq", "[^ACGT]", "N").alias("seq"))


def _written_fasta(spark: SparkSession, sf_dir: str) -> str:
    path = _fresh(spark, "fasta")
    # in two lines, the second one in lower case
    lines = F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit(" x\n"), F.left("seq", F.lit(50)), F.lit("\n"), F.translate(F.expr("substring(seq, 51)"), "ACGT", "acgt"))
    index_store.write_lines(_clean(spark, sf_dir).repartition(3).select(lines.alias("value")), path)
    return path


def _written_fastq(spark: SparkSession, sf_dir: str) -> str:
    path = _fresh(spark, "fastq")
    lines = F.concat(F.lit("@"), F.col("seq_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.expr("repeat('@', length(seq))"))
    index_store.write_lines(_clean(spark, sf_dir).repartition(3).select(lines.alias("value")), path)
    return path


def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.read_fasta(spark, _written_fasta(spark, sf_dir)).select("header", "seq")


def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.read_fastq(spark, _written_fastq(spark, sf_dir)).select("header", "seq", F.length("quality").cast("long").alias("n_quality"))


def list_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_records of each sequence in a list of FASTA and FASTQ files of all of benchmark."""
    files = [f for path in (_written_fasta(spark, sf_dir), _written_fastq(spark, sf_dir)) for f in sorted(spark.read.text(path).inputFiles())]
    list_path = _fresh(spark, "list")
    spark.createDataFrame([("\n".join(files),)], "value string").coalesce(1).write.text(list_path)
    return sequences.read_list(spark, list_path).groupBy("seq").agg(F.count("*").alias("n_records"))


def saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "index")
    index_store.save(_counted(spark, sf_dir), path)
    back = index_store.load(spark, path)
    return back.nodes.join(back.counts, "node", "left").select("colex", "node", F.col("lcs").cast("long").alias("lcs"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dumped_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "dump")
    index_store.dump_kmers(index_of(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "kmer")


def growing_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padded spectrum of a set that a stream of benchmark's sequences has grown."""
    table = store.written(seqs(spark, sf_dir, "benchmark").repartition(4), "stream")
    top = _fresh(spark, "growing")
    held = live.GrowingKmers(spark, f"{top}/kmers", K)
    stream = live.read(spark, table.inputFiles()[0].rsplit("/", 1)[0], "seq_id long, seq string", 2)
    held.ingest(stream, f"{top}/checkpoint").awaitTermination()
    return held.index().nodes.select("colex", "node")


def _pieces(spark: SparkSession, sf_dir: str, d: int) -> DataFrame:
    return dna.windows(sequences.dna_runs(seqs(spark, sf_dir, "conversations")), "run", d, "w").distinct()


def search_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of three characters, searched on by two more."""
    rows = _pieces(spark, sf_dir, 5).select(F.left("w", F.lit(3)).alias("start"), F.right("w", F.lit(2)).alias("pattern"))
    return _no_nulls(search.search_from(index_of(spark, sf_dir), rows))


def _no_nulls(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(-1)).cast("long") for c in ("lo", "hi")})


def range_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _counted(spark, sf_dir)
    ranges = search.intervals(index, [3]).select("str", "lo", "hi")
    return counting.range_sums(index, ranges).select("str", "n")


def extend_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    rows = index.kmers().select(F.col("kmer").alias("str"), F.explode(F.array(*map(F.lit, "ACGT"))).alias("label"))
    return _no_nulls(matching.extend_right(index, rows))


def contract_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    rows = index.kmers().select(F.col("kmer").alias("str"), F.explode(F.array(*map(F.lit, (0, 2, 4)))).alias("len"))
    return _no_nulls(matching.contract_left(index, rows)).withColumn("len", F.col("len").cast("long"))


def vo_get_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pieces(spark, sf_dir, 2).unionByName(_pieces(spark, sf_dir, 5)).unionByName(_pieces(spark, sf_dir, K + 1)).withColumnRenamed("w", "str")
    return _no_nulls(_vo(spark, sf_dir).get_node(rows))


def dbg_follow_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    steps = g.nodes.select("kmer", F.explode(F.array(*map(F.lit, "ACGT"))).alias("label"))
    return g.follow_out(steps).withColumn("target", F.coalesce("target", F.lit("")))


def kmer_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on the k-mers of benchmark."""
    kmer = F.col("kmer")
    return kmers_of(seqs(spark, sf_dir, "benchmark"), WIDE).select(
        "kmer",
        dna.reverse_complement(kmer).alias("rc"),
        dna.right_shifted(kmer, 3).alias("right3"),
        dna.left_shifted(kmer, 3).alias("left3"),
        dna.with_char(kmer, 2, "G").alias("with_g"),
        dna.successor(kmer, F.lit("T")).alias("then_t"),
        dna.char_idx(F.left("kmer", F.lit(1))).cast("long").alias("first"),
        dna.is_dna(kmer).alias("is_dna"),
        dna.common_prefix(kmer, dna.reverse_complement(kmer), WIDE).cast("long").alias("shared"),
        dna.bit_width(dna.packed(kmer, WIDE)).cast("long").alias("width"),
    )


def set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op, n_wrong of each set operation, and of an index against itself built from its own k-mers."""
    a, b = index_of(spark, sf_dir, "benchmark", SETS), index_of(spark, sf_dir, "conversations", SETS)
    out = None
    for name, op in (("merge", setops.union), ("intersect", setops.intersection), ("difference", setops.difference)):
        bad = checks.against_set_operation(op(a, b), name, a.kmers(), b.kmers()).agg(F.lit(name).alias("op"), F.count("*").alias("n_wrong"))
        out = bad if out is None else out.unionByName(bad)
    again = KmerIndex.from_kmers(a.kmers().select("kmer").repartition(5), SETS)
    return out.unionByName(checks.differs(a.nodes, again.nodes).agg(F.lit("build").alias("op"), F.count("*").alias("n_wrong")))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kmer_membership": entry,
    "kmer_distinct": lambda s, d: kmers_of(seqs(s, d, "documents"), WIDE),
    "kmer_count": lambda s, d: kmer_counts(seqs(s, d, "documents"), WIDE),
    "kmer_revcomp_distinct": lambda s, d: kmers_of_both_strands(seqs(s, d, "documents"), WIDE),
    "kmer_packed": lambda s, d: kmers_of(seqs(s, d, "benchmark"), WIDE).select("kmer", dna.packed(F.col("kmer"), WIDE).alias("packed")),
    "dna_runs": lambda s, d: sequences.dna_runs(seqs(s, d, "documents")).select("seq_id", F.col("run_no").cast("long").alias("run_no"), "run"),
    "sanitised_reversed": lambda s, d: seqs(s, d, "documents").select("seq_id", dna.reversed_sanitised(F.col("seq")).alias("seq")),
    "kmer_sources": lambda s, d: sources_of(kmers_of(seqs(s, d, "benchmark"), K), K),
    "dummy_nodes": lambda s, d: dummies_of(sources_of(kmers_of(seqs(s, d, "benchmark"), K), K), K).select("node", F.col("len").cast("long").alias("len")),
    "all_dummy_nodes": lambda s, d: index_of(s, d, all_dummy_paths=True).nodes.where("is_dummy").select("node"),
    "padded_spectrum": lambda s, d: index_of(s, d).nodes.select("colex", "node", F.col("len").cast("long").alias("len")),
    "edge_labels": lambda s, d: index_of(s, d).labels().select("colex", "node", "labels"),
    "lcs_array": lambda s, d: index_of(s, d).nodes.select("colex", F.col("lcs").cast("long").alias("lcs")),
    "group_leaders": lambda s, d: index_of(s, d).nodes.where("is_leader").select("colex", "grp"),
    "c_array": lambda s, d: index_of(s, d).c_array(),
    "index_stats": lambda s, d: index_of(s, d).stats().select(F.col("k").cast("long").alias("k"), "n_kmers", "n_sets"),
    "prefix_lut": lambda s, d: search.prefix_table(index_of(s, d), 4),
    "kmer_at_colex": lambda s, d: search.access(index_of(s, d), seqs(s, d, "benchmark").select(F.col("seq_id").alias("colex"))).select("colex", "node"),
    "last_column": lambda s, d: index_of(s, d).last_column(),
    "inlabel": lambda s, d: index_of(s, d).inlabel(),
    "push_labels_forward": lambda s, d: index_of(s, d).push_labels_forward(index_of(s, d).last_column().withColumnRenamed("last", "label")),
    "subset_rank": lambda s, d: index_of(s, d).subset_rank(),
    "subset_select": lambda s, d: index_of(s, d).subset_select("G"),
    "lf_step": lambda s, d: index_of(s, d).lf_step(index_of(s, d).nodes.select("colex", F.explode(F.array(*map(F.lit, "ACGT"))).alias("label"))),
    "inverse_lf_step": lambda s, d: index_of(s, d).inverse_lf_step().select("colex", F.coalesce("source", F.lit(-1)).alias("source")),
    "lookup_rank": lambda s, d: search.lookup(index_of(s, d), asked(s, d)),
    "lookup_lines": lambda s, d: search.lookup_lines(index_of(s, d), asked(s, d)),
    "lookup_membership": lambda s, d: search.lookup_lines(index_of(s, d), asked(s, d), True),
    "lookup_stats": lambda s, d: search.lookup_stats(index_of(s, d), asked(s, d)).select("n_queried", "n_found"),
    "search_interval": lambda s, d: search.search(index_of(s, d), _patterns(s, d)).select("pattern", F.coalesce("lo", F.lit(-1)).alias("lo"), F.coalesce("hi", F.lit(-1)).alias("hi")),
    "matching_stats": lambda s, d: matching.matching_statistics(index_of(s, d), asked(s, d)).select("query_id", "pos", F.col("len").cast("long").alias("len"), "lo", "hi"),
    "bounded_matching_stats": lambda s, d: matching.matching_statistics(index_of(s, d), asked(s, d), 4).select("query_id", "pos", F.col("len").cast("long").alias("len"), "lo", "hi"),
    "sfs": lambda s, d: matching.frequency_bounded_suffixes(index_of(s, d), asked(s, d), 3).select("query_id", "pos", *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("len", "lo", "hi")]),
    "ms_lines": lambda s, d: matching.lines(index_of(s, d), asked(s, d)),
    "set_union": _set_nodes(setops.union),
    "set_intersect": _set_nodes(setops.intersection),
    "set_difference": _set_nodes(setops.difference),
    "set_sizes": lambda s, d: setops.sizes(index_of(s, d, "benchmark", SETS), index_of(s, d, "conversations", SETS)),
    "interleaving": lambda s, d: setops.interleaving(index_of(s, d, "benchmark", SETS), index_of(s, d, "conversations", SETS)),
    "dbg_edges": lambda s, d: _graph(s, d).edges().select("src", "dst", "label"),
    "dbg_degrees": lambda s, d: _graph(s, d).degrees(),
    "dbg_out_neighbors": lambda s, d: _graph(s, d).out_neighbors(),
    "dbg_in_neighbors": lambda s, d: _graph(s, d).in_neighbors(),
    "dbg_out_labels": lambda s, d: _graph(s, d).out_labels(),
    "dbg_nth_pred": lambda s, d: _graph(s, d).predecessors(),
    "unitig_heads": lambda s, d: _graph(s, d).first_kmers(),
    "unitigs": lambda s, d: _graph(s, d).unitigs().select("unitig_id", "seq", "n_kmers", "is_cycle"),
    "unitig_kmers": _unitig_check,
    "unitig_orientation": _orientation,
    "vo_nodes": lambda s, d: _vo(s, d).nodes(4),
    "vo_contract_left": lambda s, d: _vo(s, d).contract_left(K, 3),
    "vo_contract_right": lambda s, d: _vo(s, d).contract_right(6, 3),
    "vo_extend_left": lambda s, d: _vo(s, d).extend_left(4),
    "vo_extend_right": lambda s, d: _vo(s, d).extend_right(K),
    "vo_degrees": lambda s, d: _vo(s, d).degrees(5),
    "vo_in_neighbors": lambda s, d: _vo(s, d).in_neighbors(5),
    "pnsv": lambda s, d: vodbg.previous_smaller(index_of(s, d), 3),
    "node_counts": lambda s, d: counting.node_counts(_counted(s, d)).select("node", "n"),
    "count_prefix_sums": lambda s, d: counting.prefix_sums(_counted(s, d)),
    "vo_count": lambda s, d: counting.order_counts(_counted(s, d), 3),
    "check_invariant": lambda s, d: checks.invariant(index_of(s, d)),
    "check_sequences": lambda s, d: checks.against_sequences(index_of(s, d), seqs(s, d, "conversations")),
    "stream_lookup": stream_lookup,
    "stream_matching_stats": stream_matching_stats,
    "fasta_roundtrip": fasta_roundtrip,
    "fastq_roundtrip": fastq_roundtrip,
    "list_roundtrip": list_roundtrip,
    "saved_index": saved_index,
    "dumped_kmers": dumped_kmers,
    "growing_set": growing_set,
    "search_from": search_from,
    "range_sums": range_sums,
    "extend_right": extend_right,
    "contract_left": contract_left,
    "vo_get_node": vo_get_node,
    "vo_representative": lambda s, d: _vo(s, d).representative(4),
    "dbg_get_node": lambda s, d: _graph(s, d).get_node(_pieces(s, d, K).withColumnRenamed("w", "kmer")).select("kmer", F.coalesce("colex", F.lit(-1)).alias("colex")),
    "dbg_follow_out": dbg_follow_out,
    "kmer_characters": kmer_characters,
    "set_checks": set_checks,
}


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(query) for name, query in _QUERIES.items()}


# --- the same in DuckDB's SQL

_FROM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "
_TO = ("ACGT" * 13)[:52]
_ID = {"documents": "doc_id", "benchmark": "item_id", "conversations": "conv_id * 1000 + turn"}


def _seqs_sql(table: str) -> str:
    return f"SELECT ({_ID[table]})::BIGINT AS seq_id, translate(coalesce(text, ''), '{_FROM}', '{_TO}') AS seq FROM {table}"


def _kmers_sql(table: str, k: int, name: str = "km") -> str:
    """CTEs s_name (sequences), w_name (all windows) and name (distinct k-mers)."""
    return f"""s_{name} AS ({_seqs_sql(table)}),
w_{name} AS (SELECT seq_id, p - 1 AS pos, substring(seq, p, {k}) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - {k} + 2)) AS p FROM s_{name})),
{name} AS (SELECT DISTINCT kmer FROM w_{name} WHERE regexp_matches(kmer, '^[ACGT]+$'))"""


def _nodes_sql(k: int, kmers: str = "km", name: str = "nd", extra: str = "") -> str:
    """CTEs up to name (colex, node, len, grp, leader, labels, lcs) from a CTE of k-mers."""
    return f"""src_{name} AS (SELECT kmer FROM {kmers} x WHERE NOT EXISTS (SELECT 1 FROM {kmers} y WHERE right(y.kmer, {k - 1}) = left(x.kmer, {k - 1}))),
raw_{name} AS (SELECT kmer AS node, {k} AS len FROM {kmers} UNION SELECT lpad(left(kmer, i), {k}, '$'), i FROM src_{name}, range(0, {k}) t(i) UNION SELECT repeat('$', {k}), 0 {extra}),
ord_{name} AS (SELECT node, len::BIGINT AS len, row_number() OVER (ORDER BY reverse(node)) - 1 AS colex, right(node, {k - 1}) AS grp, lag(reverse(node)) OVER (ORDER BY reverse(node)) AS pv FROM raw_{name}),
lab_{name} AS (SELECT left(node, {k - 1}) AS grp, string_agg(DISTINCT right(node, 1), '' ORDER BY right(node, 1)) AS labels FROM ord_{name} WHERE len > 0 GROUP BY 1),
{name} AS (SELECT o.colex, o.node, o.len, o.grp, o.leader, CASE WHEN o.leader THEN coalesce(l.labels, '') ELSE '' END AS labels, o.lcs
  FROM (SELECT *, colex = min(colex) OVER (PARTITION BY grp) AS leader,
    {" + ".join(f"coalesce((left(reverse(node), {i}) = left(pv, {i}))::BIGINT, 0)" for i in range(1, k + 1))} AS lcs FROM ord_{name}) o LEFT JOIN lab_{name} l USING (grp))"""


def _suffix_sql(k: int, nodes: str = "nd") -> str:
    """CTE iv (d, str, lo, hi) of all suffixes of nodes."""
    return f"""iv AS (SELECT d, right(node, d) AS str, min(colex) AS lo, max(colex) + 1 AS hi FROM {nodes}, range(1, {k + 1}) t(d) WHERE len >= d GROUP BY 1, 2
  UNION ALL SELECT 0, '', 0, count(*) FROM {nodes})"""


_BASE = "WITH " + _kmers_sql("benchmark", K) + ",\n" + _nodes_sql(K)
_ASK = f"s_q AS ({_seqs_sql('conversations')}),\nw_q AS (SELECT seq_id, p - 1 AS pos, substring(seq, p, {K}) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - {K} + 2)) AS p FROM s_q))"
_CTX = f"c_q AS (SELECT seq_id AS query_id, p - 1 AS pos, regexp_extract(substring(seq, greatest(1, p - {K - 1}), least(p, {K})), '([ACGT]*)$', 1) AS ctx FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM s_q))"
_MET = f"each AS (SELECT DISTINCT ctx, d FROM c_q, range(0, {K + 1}) t(d) WHERE d <= length(ctx)),\nmet AS (SELECT e.ctx, i.d, i.lo, i.hi FROM each e JOIN iv i ON i.str = right(e.ctx, e.d) AND i.d = e.d)"
_LOOK = f"{_BASE},\n{_ASK},\nlk AS (SELECT seq_id AS query_id, pos, coalesce(colex, -1) AS colex FROM w_q LEFT JOIN nd ON nd.node = w_q.kmer AND nd.len = {K})"
_HEADS = f"UNION SELECT lpad(left(run, i), {K}, '$'), i FROM (SELECT unnest(regexp_extract_all(seq, '[ACGT]+')) AS run FROM s_km), range(1, {K}) t(i) WHERE i <= length(run)"
_ALL = "WITH " + _kmers_sql("benchmark", K) + ",\n" + _nodes_sql(K, extra=_HEADS)
_COUNTS = _ALL + f""",
runs AS (SELECT unnest(regexp_extract_all(seq, '[ACGT]+')) AS run FROM s_km),
occ AS (SELECT kmer AS node, count(*) AS n FROM w_km WHERE regexp_matches(kmer, '^[ACGT]+$') GROUP BY 1
  UNION ALL SELECT lpad(left(run, i), {K}, '$'), count(*) FROM runs, range(1, {K}) t(i) WHERE i <= length(run) GROUP BY 1),
cn AS (SELECT nd.colex, nd.node, coalesce(occ.n, 0)::BIGINT AS n FROM nd LEFT JOIN occ USING (node))"""
_EDGES = _BASE + f",\ne AS (SELECT x.kmer AS src, y.kmer AS dst, right(y.kmer, 1) AS label FROM km x JOIN km y ON right(x.kmer, {K - 1}) = left(y.kmer, {K - 1}))"
_IV = _BASE + ",\n" + _suffix_sql(K)
_TWO = "WITH " + _kmers_sql("benchmark", SETS, "ka") + ",\n" + _kmers_sql("conversations", SETS, "kb")


def _set_sql(op: str) -> str:
    return f"{_TWO},\nkm AS (SELECT kmer FROM ka {op} SELECT kmer FROM kb),\n{_nodes_sql(SETS)}\nSELECT colex, node FROM nd"


def _stats_sql(bound: int) -> str:
    return f"{_IV},\n{_ASK},\n{_CTX},\n{_MET},\nbest AS (SELECT ctx, max(d) AS len, arg_max(lo, d) AS lo, arg_max(hi, d) AS hi FROM met WHERE d <= {bound} GROUP BY 1)\nSELECT query_id, pos, best.len::BIGINT AS len, lo, hi FROM c_q JOIN best USING (ctx)"


def _vo_edges(d: int) -> str:
    held = f" AND x.str || right(y.str, 1) IN (SELECT str FROM iv WHERE d = {d + 1})" if d < K else ""
    return f"{_IV},\nv AS (SELECT str, lo, hi FROM iv WHERE d = {d}),\ne AS (SELECT x.str, x.lo AS from_lo, right(y.str, 1) AS label, y.str AS target, y.lo, y.hi FROM v x JOIN v y ON right(x.str, {d - 1}) = left(y.str, {d - 1}){held})"


def _runs_of(d: int) -> str:
    """CTE p<d> (w): the distinct windows of d characters ACGT of what is asked (after _ASK)."""
    return f"p{d} AS (SELECT DISTINCT substring(seq, p, {d}) AS w FROM (SELECT seq, unnest(range(1, length(seq) - {d} + 2)) AS p FROM s_q) WHERE regexp_matches(substring(seq, p, {d}), '^[ACGT]+$'))"


_UNITIGS = (
    _EDGES.replace("WITH", "WITH RECURSIVE", 1)
    + """,
o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS n FROM e GROUP BY 1),
un AS (SELECT src, dst FROM e JOIN o USING (src) JOIN i USING (dst) WHERE o.n = 1 AND i.n = 1),
ch AS (SELECT kmer AS head, kmer AS cur, kmer AS seq, 1 AS n FROM km WHERE kmer NOT IN (SELECT dst FROM un)
  UNION ALL SELECT head, dst, seq || right(dst, 1), n + 1 FROM ch JOIN un ON un.src = ch.cur),
rest AS (SELECT kmer FROM km WHERE kmer NOT IN (SELECT cur FROM ch)),
rc AS (SELECT kmer AS a, kmer AS b FROM rest UNION SELECT a, dst FROM rc JOIN un ON un.src = rc.b),
cy AS (SELECT a AS head, a AS cur, a AS seq, 1 AS n FROM rc GROUP BY a HAVING min(b) = a
  UNION ALL SELECT head, dst, seq || right(dst, 1), n + 1 FROM cy JOIN un ON un.src = cy.cur WHERE dst <> head),
every AS (SELECT head, arg_max(seq, n) AS seq, max(n)::BIGINT AS n_kmers, false AS is_cycle FROM ch GROUP BY head
  UNION ALL SELECT head, arg_max(seq, n), max(n)::BIGINT, true FROM cy GROUP BY head)
SELECT row_number() OVER (ORDER BY head) - 1 AS unitig_id, seq, n_kmers, is_cycle FROM every"""
)
_RC = "translate(reverse(kmer), 'ACGT', 'TGCA')"
_CHARACTERS = f"""WITH {_kmers_sql('benchmark', WIDE)},
v AS (SELECT kmer, ({' + '.join(f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1)::BIGINT * {4 ** (WIDE - 1 - i)}" for i in range(WIDE))})::BIGINT AS packed FROM km)
SELECT kmer, {_RC} AS rc, 'AAA' || left(kmer, {WIDE - 3}) AS right3, right(kmer, {WIDE - 3}) || 'AAA' AS left3, left(kmer, 2) || 'G' || substr(kmer, 4) AS with_g,
  substr(kmer, 2) || 'T' AS then_t, (instr('ACGT', left(kmer, 1)) - 1)::BIGINT AS first, true AS is_dna,
  {' + '.join(f'(left(kmer, {i}) = left({_RC}, {i}))::BIGINT' for i in range(1, WIDE + 1))} AS shared,
  CASE WHEN packed > 0 THEN length(bin(packed)) ELSE 0 END::BIGINT AS width FROM v"""

ORACLES: dict[str, str] = {
    "kmer_membership": f"WITH {_kmers_sql('documents', WIDE)}, {_kmers_sql('benchmark', WIDE, 'q')} SELECT seq_id AS item_id, count(*) AS n_kmers, count(km.kmer) AS n_found FROM w_q LEFT JOIN km USING (kmer) GROUP BY 1",
    "kmer_distinct": f"WITH {_kmers_sql('documents', WIDE)} SELECT kmer FROM km",
    "kmer_count": f"WITH {_kmers_sql('documents', WIDE)} SELECT kmer, count(*) AS n FROM w_km WHERE regexp_matches(kmer, '^[ACGT]+$') GROUP BY 1",
    "kmer_revcomp_distinct": f"WITH {_kmers_sql('documents', WIDE)} SELECT kmer FROM km UNION SELECT translate(reverse(kmer), 'ACGT', 'TGCA') FROM km",
    "kmer_packed": f"WITH {_kmers_sql('benchmark', WIDE)} SELECT kmer, ({' + '.join(f'(instr({chr(39)}ACGT{chr(39)}, substr(kmer, {i + 1}, 1)) - 1)::BIGINT * {4 ** (WIDE - 1 - i)}' for i in range(WIDE))})::BIGINT AS packed FROM km",
    "dna_runs": f"WITH s AS ({_seqs_sql('documents')}), r AS (SELECT seq_id, regexp_extract_all(seq, '[ACGT]+') AS rs FROM s) SELECT seq_id, i AS run_no, rs[i + 1] AS run FROM (SELECT seq_id, rs, unnest(range(0, len(rs))) AS i FROM r)",
    "sanitised_reversed": f"WITH s AS ({_seqs_sql('documents')}) SELECT seq_id, reverse(regexp_replace(seq, '[^ACGT]', '$', 'g')) AS seq FROM s",
    "kmer_sources": f"{_BASE} SELECT kmer FROM src_nd",
    "dummy_nodes": f"{_BASE} SELECT node, len FROM nd WHERE len < {K}",
    "all_dummy_nodes": f"{_ALL} SELECT node FROM nd WHERE len < {K}",
    "padded_spectrum": f"{_BASE} SELECT colex, node, len FROM nd",
    "edge_labels": f"{_BASE} SELECT colex, node, labels FROM nd",
    "lcs_array": f"{_BASE} SELECT colex, lcs FROM nd",
    "group_leaders": f"{_BASE} SELECT colex, grp FROM nd WHERE leader",
    "c_array": f"{_BASE} SELECT label, (1 + (SELECT count(*) FROM nd WHERE len > 0 AND right(node, 1) < label))::BIGINT AS c FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS label)",
    "index_stats": f"{_BASE} SELECT {K}::BIGINT AS k, count(*) FILTER (WHERE len = {K}) AS n_kmers, count(*) AS n_sets FROM nd",
    "prefix_lut": f"{_IV}, l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS c) SELECT p.pmer, coalesce(iv.lo, 0)::BIGINT AS lo, coalesce(iv.hi, 0)::BIGINT AS hi FROM (SELECT a.c || b.c || c.c || d.c AS pmer FROM l a, l b, l c, l d) p LEFT JOIN iv ON iv.str = p.pmer",
    "kmer_at_colex": f"{_BASE} SELECT item_id AS colex, nd.node FROM benchmark LEFT JOIN nd ON nd.colex = item_id",
    "last_column": f"{_BASE} SELECT colex, right(node, 1) AS last FROM nd",
    "inlabel": f"{_BASE} SELECT colex, nullif(right(node, 1), '$') AS label FROM nd",
    "push_labels_forward": f"{_BASE} SELECT t.colex, CASE WHEN t.len = 0 THEN '$' ELSE right(f.node, 1) END AS label FROM nd t LEFT JOIN nd f ON f.leader AND f.grp = left(t.node, {K - 1}) AND t.len > 0",
    "subset_rank": f"{_BASE} SELECT colex, " + ", ".join(f"coalesce(sum(contains(labels, '{x}')::INT) OVER w, 0)::BIGINT AS rank_{x.lower()}" for x in "ACGT") + " FROM nd WINDOW w AS (ORDER BY colex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "subset_select": f"{_BASE} SELECT row_number() OVER (ORDER BY colex) - 1 AS nth, colex FROM nd WHERE contains(labels, 'G')",
    "lf_step": f"{_BASE}, l AS (SELECT label, (1 + (SELECT count(*) FROM nd WHERE len > 0 AND right(node, 1) < label))::BIGINT AS c FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS label)) SELECT colex, label, (c + coalesce(sum(contains(labels, label)::INT) OVER (PARTITION BY label ORDER BY colex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS target FROM nd, l",
    "inverse_lf_step": f"{_BASE} SELECT t.colex, coalesce(f.colex, -1) AS source FROM nd t LEFT JOIN nd f ON f.leader AND f.grp = left(t.node, {K - 1}) AND t.len > 0",
    "lookup_rank": f"{_LOOK} SELECT query_id, pos, colex FROM lk",
    "lookup_lines": f"{_LOOK} SELECT s_q.seq_id AS query_id, coalesce(string_agg(colex::VARCHAR, ' ' ORDER BY pos), '') AS line FROM s_q LEFT JOIN lk ON lk.query_id = s_q.seq_id GROUP BY 1",
    "lookup_membership": f"{_LOOK} SELECT s_q.seq_id AS query_id, coalesce(string_agg(CASE WHEN colex >= 0 THEN '1' ELSE '0' END, '' ORDER BY pos) FILTER (WHERE colex IS NOT NULL), '') AS line FROM s_q LEFT JOIN lk ON lk.query_id = s_q.seq_id GROUP BY 1",
    "lookup_stats": f"{_LOOK} SELECT count(*) AS n_queried, count(*) FILTER (WHERE colex >= 0) AS n_found FROM lk",
    "search_interval": f"{_IV}, {_ASK}, r AS (SELECT unnest(regexp_extract_all(seq, '[ACGT]+')) AS run FROM s_q), p AS (SELECT DISTINCT substring(run, p, d) AS pattern FROM (SELECT run, d, unnest(range(1, length(run) - d + 2)) AS p FROM r, (SELECT unnest([3, 5, {K}]) AS d) WHERE length(run) >= d)) SELECT pattern, coalesce(lo, -1)::BIGINT AS lo, coalesce(hi, -1)::BIGINT AS hi FROM p LEFT JOIN iv ON iv.str = p.pattern",
    "matching_stats": _stats_sql(K),
    "bounded_matching_stats": _stats_sql(4),
    "sfs": f"{_IV}, {_ASK}, {_CTX}, {_MET}, best AS (SELECT ctx, min(d) AS len, arg_min(lo, d) AS lo, arg_min(hi, d) AS hi FROM met WHERE hi - lo <= 3 GROUP BY 1) SELECT query_id, pos, coalesce(best.len, -1)::BIGINT AS len, coalesce(lo, -1)::BIGINT AS lo, coalesce(hi, -1)::BIGINT AS hi FROM c_q LEFT JOIN best USING (ctx)",
    "ms_lines": f"WITH m AS ({_stats_sql(K)}) SELECT query_id, string_agg('(' || len || ',' || lo || '..' || hi || ')', ',' ORDER BY pos) AS line FROM m GROUP BY 1",
    "set_union": _set_sql("UNION"),
    "set_intersect": _set_sql("INTERSECT"),
    "set_difference": _set_sql("EXCEPT"),
    "set_sizes": f"{_TWO}, a AS (SELECT (SELECT count(*) FROM (SELECT kmer FROM ka UNION SELECT kmer FROM kb)) AS n_union, (SELECT count(*) FROM (SELECT kmer FROM ka INTERSECT SELECT kmer FROM kb)) AS n_intersection, (SELECT count(*) FROM (SELECT kmer FROM ka EXCEPT SELECT kmer FROM kb)) AS n_difference) SELECT *, n_intersection::DOUBLE / n_union AS jaccard FROM a",
    "interleaving": f"{_TWO}, {_nodes_sql(SETS, 'ka', 'na')}, {_nodes_sql(SETS, 'kb', 'nb')}, u AS (SELECT node, na.node IS NOT NULL AS in1, nb.node IS NOT NULL AS in2, coalesce(na.len, nb.len) < {SETS} AS is_dummy FROM na FULL JOIN nb USING (node)) SELECT node, in1, in2, is_dummy, reverse(node) = min(reverse(node)) OVER (PARTITION BY right(node, {SETS - 1})) AS is_leader FROM u",
    "dbg_edges": f"{_EDGES} SELECT src, dst, label FROM e",
    "dbg_degrees": f"{_EDGES} SELECT kmer, (SELECT count(*) FROM e WHERE src = kmer) AS outdegree, (SELECT count(*) FROM e WHERE dst = kmer) AS indegree FROM km",
    "dbg_out_neighbors": f"{_EDGES} SELECT src AS kmer, dst AS neighbor, label FROM e",
    "dbg_in_neighbors": f"{_EDGES} SELECT dst AS kmer, src AS neighbor, label FROM e",
    "dbg_out_labels": f"{_EDGES} SELECT kmer, coalesce(string_agg(label, '' ORDER BY label), '') AS labels FROM km LEFT JOIN e ON e.src = km.kmer GROUP BY 1",
    "dbg_nth_pred": f"{_EDGES} SELECT dst AS kmer, row_number() OVER (PARTITION BY dst ORDER BY reverse(src)) - 1 AS nth, src AS neighbor FROM e",
    "unitig_heads": f"{_EDGES}, o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS n FROM e GROUP BY 1) SELECT kmer FROM km WHERE NOT EXISTS (SELECT 1 FROM e JOIN o USING (src) JOIN i USING (dst) WHERE e.dst = kmer AND o.n = 1 AND i.n = 1)",
    "unitig_kmers": f"{_BASE} SELECT count(*)::BIGINT AS n_kmers, 0::BIGINT AS n_wrong FROM km",
    "vo_nodes": f"{_IV} SELECT str, lo, hi FROM iv WHERE d = 4",
    "vo_contract_left": f"{_IV} SELECT a.str, b.str AS target, b.lo, b.hi FROM iv a JOIN iv b ON b.d = 3 AND b.str = right(a.str, 3) WHERE a.d = {K}",
    "vo_contract_right": f"{_IV} SELECT a.str, left(a.str, 3) AS target, b.lo, b.hi FROM iv a LEFT JOIN iv b ON b.d = 3 AND b.str = left(a.str, 3) WHERE a.d = 6",
    "vo_extend_left": f"{_IV} SELECT right(str, 4) AS str, row_number() OVER (PARTITION BY right(str, 4) ORDER BY lo) - 1 AS nth, left(str, 1) AS label, str AS target, lo, hi FROM iv WHERE d = 5",
    "vo_extend_right": f"{_vo_edges(K)} SELECT str, label, target, lo, hi FROM e",
    "vo_degrees": f"{_vo_edges(5)}, o AS (SELECT str, count(*) AS n FROM e GROUP BY 1), i AS (SELECT target AS str, count(*) AS n FROM e GROUP BY 1) SELECT v.str, coalesce(o.n, 0)::BIGINT AS outdegree, coalesce(i.n, 0)::BIGINT AS indegree FROM v LEFT JOIN o ON o.str = v.str LEFT JOIN i ON i.str = v.str",
    "vo_in_neighbors": f"{_vo_edges(5)} SELECT target AS str, row_number() OVER (PARTITION BY target ORDER BY from_lo) - 1 AS nth, str AS neighbor FROM e",
    "pnsv": f"{_BASE} SELECT colex, coalesce(max(CASE WHEN lcs < 3 THEN colex END) OVER (ORDER BY colex ROWS UNBOUNDED PRECEDING), 0) AS previous, coalesce(min(CASE WHEN lcs < 3 THEN colex END) OVER (ORDER BY colex ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), (SELECT count(*) FROM nd))::BIGINT AS next FROM nd",
    "node_counts": f"{_COUNTS} SELECT node, n FROM cn",
    "count_prefix_sums": f"{_COUNTS} SELECT colex, n, coalesce(sum(n) OVER (ORDER BY colex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM cn",
    "vo_count": "WITH " + _kmers_sql("benchmark", 3) + " SELECT kmer AS str, count(*)::BIGINT AS n FROM w_km WHERE regexp_matches(kmer, '^[ACGT]+$') GROUP BY 1",
    "check_invariant": f"{_BASE} SELECT count(*) AS n_sets, sum(length(labels))::BIGINT AS n_edges, sum(length(labels)) + 1 = count(*) AS ok FROM nd",
    "check_sequences": f"WITH {_kmers_sql('benchmark', K, 'ka')}, {_kmers_sql('conversations', K, 'kb')} SELECT kmer, 'missing' AS side FROM kb WHERE kmer NOT IN (SELECT kmer FROM ka) UNION ALL SELECT kmer, 'extra' FROM ka WHERE kmer NOT IN (SELECT kmer FROM kb)",
    "stream_lookup": f"{_LOOK} SELECT query_id, pos, colex FROM lk",
    "stream_matching_stats": _stats_sql(K).replace("best.len::BIGINT AS len", "best.len::INTEGER AS len"),
    "unitigs": _UNITIGS,
    "fasta_roundtrip": f"WITH s AS ({_seqs_sql('benchmark')}) SELECT seq_id::VARCHAR || ' x' AS header, regexp_replace(seq, '[^ACGT]', 'N', 'g') AS seq FROM s",
    "fastq_roundtrip": f"WITH s AS ({_seqs_sql('benchmark')}) SELECT seq_id::VARCHAR AS header, regexp_replace(seq, '[^ACGT]', 'N', 'g') AS seq, length(seq) AS n_quality FROM s",
    "list_roundtrip": f"WITH s AS ({_seqs_sql('benchmark')}) SELECT regexp_replace(seq, '[^ACGT]', 'N', 'g') AS seq, 2 * count(*) AS n_records FROM s GROUP BY 1",
    "saved_index": f"{_COUNTS} SELECT nd.colex, nd.node, nd.lcs, cn.n FROM nd JOIN cn USING (colex)",
    "dumped_kmers": f"{_BASE} SELECT kmer FROM km",
    "growing_set": f"{_BASE} SELECT colex, node FROM nd",
    "search_from": f"{_IV}, {_ASK}, {_runs_of(5)} SELECT left(w, 3) AS start, right(w, 2) AS pattern, coalesce(lo, -1)::BIGINT AS lo, coalesce(hi, -1)::BIGINT AS hi FROM p5 LEFT JOIN iv ON iv.str = w AND EXISTS (SELECT 1 FROM iv x WHERE x.str = left(w, 3))",
    "range_sums": f"{_COUNTS}, r AS (SELECT right(node, 3) AS str, min(colex) AS lo, max(colex) + 1 AS hi FROM nd WHERE len >= 3 GROUP BY 1) SELECT str, (SELECT sum(n) FROM cn WHERE colex >= lo AND colex < hi)::BIGINT AS n FROM r",
    "extend_right": f"{_IV}, x AS (SELECT kmer AS str, label FROM km, (SELECT unnest(['A', 'C', 'G', 'T']) AS label)) SELECT x.str, label, coalesce(lo, -1)::BIGINT AS lo, coalesce(hi, -1)::BIGINT AS hi FROM x LEFT JOIN iv ON iv.str = right(x.str, {K - 1}) || label",
    "contract_left": f"{_IV}, x AS (SELECT kmer AS str, len FROM km, (SELECT unnest([0, 2, 4])::BIGINT AS len)) SELECT x.str, x.len, lo, hi FROM x JOIN iv ON iv.str = right(x.str, x.len)",
    "vo_get_node": f"{_IV}, {_ASK}, {_runs_of(2)}, {_runs_of(5)}, {_runs_of(K + 1)}, p AS (SELECT w FROM p2 UNION ALL SELECT w FROM p5 UNION ALL SELECT w FROM p{K + 1}) SELECT w AS str, coalesce(lo, -1)::BIGINT AS lo, coalesce(hi, -1)::BIGINT AS hi FROM p LEFT JOIN iv ON iv.str = w",
    "vo_representative": f"{_IV} SELECT str, lo AS colex FROM iv WHERE d = 4",
    "dbg_get_node": f"{_BASE}, {_ASK}, {_runs_of(K)} SELECT w AS kmer, coalesce(colex, -1) AS colex FROM p{K} LEFT JOIN nd ON nd.node = w AND nd.len = {K}",
    "dbg_follow_out": f"{_BASE} SELECT x.kmer, label, coalesce(y.kmer, '') AS target FROM (SELECT kmer, label FROM km, (SELECT unnest(['A', 'C', 'G', 'T']) AS label)) x LEFT JOIN km y ON y.kmer = right(x.kmer, {K - 1}) || label",
    "kmer_characters": _CHARACTERS,
    "set_checks": "SELECT unnest(['merge', 'intersect', 'difference', 'build']) AS op, 0::BIGINT AS n_wrong",
}

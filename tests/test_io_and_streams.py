import gzip
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.operators import benchmark, checks, dbg, matching, search
from strandlake.operators.index import KmerIndex
from strandlake.sources import index_store, sequences
from strandlake.streaming import live
from tests import naive

SEQS = ["AGGTAAA", "ACAGGTAGGAAAGGAAAGT"]


def write_fasta(path, seqs, width=6):
    text = "".join(f">r{i} x\n" + "".join(s[j : j + width] + "\n" for j in range(0, len(s), width)) for i, s in enumerate(seqs))
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


@pytest.mark.parametrize("name", ["a.fna", "a.fna.gz"])
def test_fasta(spark, tmp_path, name):
    path = write_fasta(tmp_path / name, ["acgt", *SEQS])
    got = sequences.read_fasta(spark, path).orderBy("seq_id").collect()
    assert [(r.header, r.seq) for r in got] == [("r0 x", "ACGT"), ("r1 x", SEQS[0]), ("r2 x", SEQS[1])]
    assert [r.seq for r in sequences.read_any(spark, path).orderBy("seq_id").collect()] == ["ACGT", *SEQS]


def test_fastq_and_lists(spark, tmp_path):
    q = tmp_path / "b.fq"
    q.write_text("@x 1\r\nACGN\r\n+\r\n@II>\r\n@y\nTTT\n+\nIII\n")
    got = sequences.read_fastq(spark, str(q)).orderBy("seq_id").collect()
    assert [(r.header, r.seq, r.quality) for r in got] == [("x 1", "ACGN", "@II>"), ("y", "TTT", "III")]
    a = write_fasta(tmp_path / "a.fna", SEQS)
    (tmp_path / "list").write_text(f"{q}\n{a}\n")
    assert [r.seq for r in sequences.read_list(spark, str(tmp_path / "list")).orderBy("seq_id").collect()] == ["ACGN", "TTT", *SEQS]


def test_concatenation_and_reverse_complements(spark):
    seqs = sequences.from_values(spark, ["AAC", b"gN"])
    assert sequences.concatenated(seqs).first().text == "#$AAC$GN$"
    assert {(r.seq_id, r.rc, r.seq) for r in sequences.with_reverse_complements(seqs).collect()} == {(0, False, "AAC"), (0, True, "GTT"), (1, False, "GN"), (1, True, "NC")}


def test_save_and_load(spark, tmp_path):
    index = KmerIndex.build(sequences.from_values(spark, SEQS), 4, all_dummy_paths=True, count=True)
    path = str(tmp_path / "index")
    index_store.save(index, path)
    back = index_store.load(spark, path)
    assert (back.k, back.all_dummy_paths, back.precalc_length) == (4, True, 8)
    assert checks.differs(index.nodes, back.nodes).count() == 0 and checks.differs(index.counts, back.counts).count() == 0
    assert index_store.size_bits(index, path).first().bits_per_kmer > 0
    index_store.dump_kmers(index, str(tmp_path / "dump"))
    lines = [x for p in sorted((tmp_path / "dump").glob("part-*")) for x in p.read_text().split()]
    assert lines == [x for x in naive.padded(naive.kmers(SEQS, 4), 4) if "$" not in x]


def plain_matrix(k, nodes, typed):
    """The bytes of an index file in the plain-matrix layout."""
    labels = naive.labels(nodes, k)

    def text(s):
        return struct.pack("<Q", len(s)) + s.encode()

    def bits(flags):
        words = bytearray(8 * ((len(flags) + 63) // 64))
        for i, f in enumerate(flags):
            words[i >> 3] |= f << (i & 7)
        return struct.pack("<Q", len(flags)) + bytes(words)

    body = b"".join(bits([x in s for s in labels]) for x in "ACGT")
    rank = struct.pack("<Q", 128) + bytes(16)
    tail = rank * 4 + bits([1] * len(nodes)) + struct.pack("<Q", 32) + bytes(32) + struct.pack("<Q", 0)
    return (text("plain-matrix") if typed else b"") + text("v0.1") + body + tail + struct.pack("<4q", 2, len(nodes), sum("$" not in x for x in nodes), k)


@pytest.mark.parametrize("typed", [True, False])
def test_plain_matrix_import(spark, tmp_path, typed):
    seqs, k = ["ACACTG", "GCACTAA"], 3
    path = tmp_path / "index.bin"
    path.write_bytes(plain_matrix(k, naive.padded(naive.kmers(seqs, k), k), typed))
    got = index_store.import_plain_matrix(spark, str(path))
    built = KmerIndex.build(sequences.from_values(spark, seqs), k)
    assert checks.differs(got.nodes, built.nodes).count() == 0
    assert [r.c for r in got.c_array().orderBy("label").collect()] == [1, 5, 7, 9]


def test_bwt_import(spark):
    text = "#$ACCA$"
    turned = sorted(text[i:] + text[:i] for i in range(len(text)))
    bwt = "".join(r[-1] for r in turned).encode()
    assert index_store.import_bwt(spark, bwt).first().text == text
    assert index_store.truncated_lcp([0, 5, 2], 3) == [0, 3, 2]


def test_streams(spark, tmp_path):
    index = KmerIndex.build(sequences.from_values(spark, SEQS), 4)
    text = "AGGTNAAAGGAAACAGGTTAACAGGTAGG"
    for n, part in enumerate(["q", "r"]):
        spark.createDataFrame([(n, text if n == 0 else "AAGT")], "query_id long, seq string").coalesce(1).write.parquet(str(tmp_path / "in" / part))
    stream = spark.readStream.schema("query_id long, seq string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.lookup(index, stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = search.lookup(index, spark.createDataFrame([(0, text), (1, "AAGT")], "query_id long, seq string"))
    assert checks.differs(spark.read.schema(batch.schema).parquet(str(tmp_path / "out")), batch).count() == 0

    # chunks of a sequence, out of order and repeated
    pieces = [(0, 1, text[7:12]), (0, 0, text[:7]), (0, 0, text[:7]), (0, 2, ""), (0, 3, text[12:]), (1, 0, "aagt")]
    for i, p in enumerate(pieces):
        spark.createDataFrame([p], "query_id long, chunk_no long, part string").coalesce(1).write.parquet(str(tmp_path / "chunks" / str(i)))
    chunks = spark.readStream.schema("query_id long, chunk_no long, part string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "chunks"))
    live.matching_statistics(index, chunks, str(tmp_path / "ms"), str(tmp_path / "cp2")).awaitTermination()
    whole = matching.matching_statistics(index, spark.createDataFrame([(0, text), (1, "AAGT")], "query_id long, seq string"))
    got = spark.read.schema("query_id long, pos long, len int, lo long, hi long, batch long").parquet(str(tmp_path / "ms")).drop("batch")
    assert checks.differs(got, whole).count() == 0


def test_chunks_of_many_sequences_over_many_batches(spark, tmp_path, monkeypatch):
    """More batches than one that writes all that is held, most touching few sequences; and no Python per sequence."""
    rng = random.Random(3)
    k, alphabet = 5, "ACGTacgtN\U0001f9ec"
    index = KmerIndex.build(sequences.from_values(spark, ["".join(rng.choices("ACGT", k=300))]), k)
    texts = {i: "".join(rng.choices(alphabet, weights=[9, 9, 9, 9, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 90))) for i in range(12)}
    rows = []
    for i, text in texts.items():
        cuts = sorted(rng.choices(range(len(text) + 1), k=6))
        rows += [(i, n, text[a:b] or None) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)]))]
    rng.shuffle(rows)
    rows += rng.choices(rows, k=9)  # once more, later
    schema = "query_id long, chunk_no long, part string"
    monkeypatch.setattr(live, "WHOLE", 2)
    n = 5
    for b in range(n):
        spark.createDataFrame(rows[len(rows) * b // n : len(rows) * (b + 1) // n], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{b:02}"))
    chunks = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.matching_statistics(index, chunks, str(tmp_path / "ms"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert "Python" not in q._jsq.explainInternal(True) and "Pandas" not in q._jsq.explainInternal(True)
    assert sorted(p.name for p in (tmp_path / "cp" / "held").glob("batch=*")) == [f"batch={b}" for b in range(1, n)]
    nodes = [r.node for r in index.nodes.orderBy("colex").collect()]
    got = spark.read.schema("query_id long, pos long, len int, lo long, hi long, batch long").parquet(str(tmp_path / "ms"))
    by = {i: [] for i in texts}
    for r in got.orderBy("query_id", "pos").collect():
        by[r.query_id].append((r.pos, (r.len, r.lo, r.hi)))
    assert by == {i: list(enumerate(naive.matching(nodes, k, t.translate(str.maketrans("acgt", "ACGT"))))) for i, t in texts.items()}


def test_a_chunk_without_number_is_an_error(spark):
    held = spark.createDataFrame([], live.HELD)
    chunks = spark.createDataFrame([(1, None, "ACG")], "query_id long, chunk_no long, part string")
    with pytest.raises(Exception, match="no number"):
        live.advanced(held, chunks, 4).collect()


def test_a_retried_batch_reads_what_came_before_it(spark):
    held = spark.createDataFrame([(1, 1, 5, "CAT", [(2, 0, "GG")], 0), (1, 2, 7, "TTT", [], 1), (2, 1, 3, "AAA", [], 0)], live.HELD)
    chunks = spark.createDataFrame([(1, 2, "ac"), (1, 4, "C"), (1, 1, "zz")], "query_id long, chunk_no long, part string")
    row = live.advanced(held, chunks, 4).collect()
    assert len(row) == 1 and (row[0].expected, row[0].at, row[0].tail, row[0].first, row[0].text) == (3, 9, "TAC", 7, "TTTAC")
    assert [tuple(x) for x in row[0].waiting] == [(4, 0, "C")]
    assert live.advanced(held, chunks, 4, True).count() == 2


def test_growing_set(spark, tmp_path):
    for i, s in enumerate(SEQS):
        sequences.from_values(spark, [s]).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("seq_id long, seq string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    held = live.GrowingKmers(spark, str(tmp_path / "kmers"), 4)
    held.ingest(stream, str(tmp_path / "cp")).awaitTermination()
    assert held.kmers().count() == len(naive.kmers(SEQS, 4))
    assert checks.differs(held.index().nodes, KmerIndex.build(sequences.from_values(spark, SEQS), 4).nodes).count() == 0


def test_benchmark(spark):
    record = benchmark.benchmark(KmerIndex.build(sequences.from_values(spark, SEQS), 4), 100, 2, 50)
    assert all(v > 0 for v in record.values()) and json.loads(index_store.report(record)) == record


def run(*args):
    return cli.main([str(a) for a in args])


def test_command_line(spark, tmp_path, capsys):
    a, b = write_fasta(tmp_path / "a.fna", SEQS), write_fasta(tmp_path / "b.fna", SEQS[:1])
    assert run("build", "-i", a, "-o", tmp_path / "a", "-k", 4) == 0 and run("build", "-i", b, "-o", tmp_path / "b", "-k", 4) == 0
    assert run("stats", "-i", tmp_path / "a") == 0 and "sets 18" in capsys.readouterr().out
    assert run("kmer-at-colex", "-i", tmp_path / "a", "-r", 13) == 0 and capsys.readouterr().out.strip() == "AAGG"
    assert run("kmer-at-colex", "-i", tmp_path / "a", "-r", 99) == 1
    assert run("lookup", "-i", tmp_path / "a", "-q", b, "-o", tmp_path / "l") == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["17 8 5 3"]
    assert run("matching-statistics", "-i", tmp_path / "a", "-q", b, "-o", tmp_path / "m") == 0
    assert spark.read.text(str(tmp_path / "m")).first().value.startswith("(1,1..9),")
    for op, seq in (("merge", a), ("intersect", b), ("difference", None)):
        assert run(op, tmp_path / "a", tmp_path / "b", "-o", tmp_path / op) == 0
        assert run("check-set-operation", "--op", op, "--seq1", a, "--index2", tmp_path / "b", "--result", tmp_path / op) == 0
    assert run("check-set-operation", "--op", "merge", "--seq1", a, "--seq2", b, "--result", tmp_path / "intersect") == 1
    capsys.readouterr()
    assert run("jaccard", tmp_path / "a", tmp_path / "b") == 0 and "intersection 4\nunion 14" in capsys.readouterr().out
    assert run("dump-kmers", "-i", tmp_path / "a", "-o", tmp_path / "d", "-d") == 0 and spark.read.text(str(tmp_path / "d")).count() == 18
    assert run("dump-unitigs", "-i", tmp_path / "a", "-o", tmp_path / "u") == 0
    assert sorted(r.seq for r in sequences.read_fasta(spark, str(tmp_path / "u")).collect()) == sorted(r.seq for r in dbg.Dbg(index_store.load(spark, str(tmp_path / "a"))).unitigs().collect())
    assert run("check", "-i", tmp_path / "a", "--invariant", "-s", a) == 0 and run("check", "-i", tmp_path / "a", "-s", b) == 1
    assert run("sort-kmers-to-disk", "-i", a, "-o", tmp_path / "s", "-k", 4) == 0
    assert run("build-from-kmers-on-disk", "--kmers-file", tmp_path / "s", "-o", tmp_path / "c", "-k", 4) == 0
    assert checks.differs(index_store.load(spark, str(tmp_path / "c")).nodes, index_store.load(spark, str(tmp_path / "a")).nodes).count() == 0
    assert run("build-lcs", "-i", tmp_path / "a", "-o", tmp_path / "lcs") == 0 and spark.read.parquet(str(tmp_path / "lcs")).agg(F.sum("lcs")).first()[0] == 24
    with pytest.raises(SystemExit):
        run("check", "-i", tmp_path / "a")


def test_data_source(spark, tmp_path):
    from strandlake.sources import datasource

    write_fasta(tmp_path / "a.fna", SEQS)
    write_fasta(tmp_path / "b.fna.gz", ["acgt"])
    (tmp_path / "c.fq").write_text("@x\nAC\n+\n@@\n@y\nGT\n+\nII\n")
    datasource.register(spark)
    got = [r.seq for p in ("*.fna*", "c.fq") for r in spark.read.format("fastx").load(str(tmp_path / p)).orderBy("file", "record").collect()]
    assert got == [*SEQS, "ACGT", "AC", "GT"]


def test_files_are_read_by_blocks_in_order(spark, tmp_path):
    rng = random.Random(6)
    seqs = ["".join(rng.choices("ACGT", k=rng.randint(1, 90))) for _ in range(400)]
    fq = "".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(seqs))
    fa = "".join(f">f{i}\n{s[:30]}\n{s[30:]}\n" for i, s in enumerate(seqs))
    for name, text in (("b.fq", fq + "@cut\nAC"), ("a.fa", fa), ("unnamed", fq.replace("\n", "\r\n")), ("folder/x.fa", fa), ("folder/y.fa", fa)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sequences.read_fastq(spark, f"{tmp_path}/b.fq").orderBy("seq_id").collect()
        assert [(r.seq_id, r.header, r.seq, len(r.quality)) for r in got] == [(i, f"r{i}", s, len(s)) for i, s in enumerate(seqs)]
        got = sequences.read_fasta(spark, [f"{tmp_path}/folder", f"{tmp_path}/a.fa"]).orderBy("seq_id").collect()
        assert [(r.seq_id, r.header, r.seq) for r in got] == [(400 * f + i, f"f{i}", s) for f in range(3) for i, s in enumerate(seqs)]
        (tmp_path / "list").write_text("\n".join(f"{tmp_path}/{x}" for x in ("b.fq", "folder/x.fa", "unnamed", "a.fa")))
        got = sequences.read_list(spark, f"{tmp_path}/list").orderBy("seq_id").collect()
        assert [(r.seq_id, r.seq) for r in got] == list(enumerate(seqs * 4))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("k", [1, 2, 9, 26, 27, 31])
def test_saved_nodes_are_the_same(spark, tmp_path, k):
    index = KmerIndex.build(sequences.from_values(spark, ["ACGTTGCATGTCAGGCATTTACGATCAGCATCAGTTTACA", "TTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT", *SEQS]), k)
    index_store.save(index, f"{tmp_path}/index")
    back = index_store.load(spark, f"{tmp_path}/index")
    assert back.nodes.columns == index.nodes.columns and back.nodes.dtypes == index.nodes.dtypes
    assert checks.differs(index.nodes, back.nodes).count() == 0


def test_command_line_options(spark, tmp_path):
    a, b = write_fasta(tmp_path / "a.fna", SEQS[:1]), write_fasta(tmp_path / "b.fna", SEQS[1:])
    before = spark.sparkContext.getCheckpointDir()
    try:
        assert run("build", "-i", a, "-o", tmp_path / "a", "-k", 4, "-l", "-d", "-m", 4, "--in-memory", "--temp-dir", tmp_path / "tmp") == 0
        assert (tmp_path / "tmp").exists()
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before.rsplit("/", 1)[0])
    assert run("build", "-i", b, "--output-prefix", tmp_path / "b", "-k", 4, "--bounded-suffix-sort", "--bucket-sort-prefix-length", 3) == 0
    lcs = [r.lcs for r in spark.read.parquet(f"{tmp_path}/a.lcs").orderBy("colex").collect()]
    assert lcs == [r.lcs for r in index_store.load(spark, f"{tmp_path}/a").nodes.orderBy("colex").collect()]
    assert run("merge", tmp_path / "a", tmp_path / "b", "-o", tmp_path / "ab", "--low-ram") == 0
    assert run("check-set-operation", "--op", "merge", "--index1", tmp_path / "a", "--index2", tmp_path / "b", "--result", tmp_path / "ab", "--keep-unitigs") == 0
    assert list((tmp_path / "ab.unitigs2").glob("part-*"))
    assert run("dump-kmers", "-i", tmp_path / "ab", "-o", tmp_path / "dump", "-a") == 0
    files = list((tmp_path / "dump").glob("part-*"))
    assert len(files) == 1 and files[0].read_text().split() == [x for x in naive.padded(naive.kmers(SEQS, 4), 4) if "$" not in x]

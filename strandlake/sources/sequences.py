"""Sequences as DataFrames (seq_id BIGINT, seq STRING), from files, tables or memory."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.plans import store


def from_values(spark: SparkSession, seqs: list[str | bytes]) -> DataFrame:
    rows = [(i, s.decode() if isinstance(s, bytes) else s) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "seq_id long, seq string").withColumn("seq", dna.upper(F.col("seq")))


def from_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Text as sequences, by the mapping of dna.from_text."""
    return df.select(F.col(id_col).cast("long").alias("seq_id"), dna.from_text(F.coalesce(F.col(text_col), F.lit(""))).alias("seq"))


def _lines(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """file, at (where the block begins that a task reads of it), value."""
    raw = spark.read.option("lineSep", sep).text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def _numbered(rows: DataFrame, spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """rows of _lines() with place (that of their path), file_no (their file's among all, by place, then by name) and no (from 0 in their file).

    A block's rows are numbered as they are read. What a block needs of those before it is one row a block, so nothing is sorted.
    """
    order = _places(spark, paths)
    rows = store.written(rows.withColumn("m", F.monotonically_increasing_id()), name)
    blocks = rows.groupBy("file", "at").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    files = blocks.select("file").distinct().withColumn("plain", F.regexp_replace("file", "^file:/+", "file:/"))
    exact = files.join(order, "plain").groupBy("file").agg(F.min("place").alias("place"))
    # other paths are folders or patterns
    others = order.join(files.select("plain"), "plain", "left_anti").select(F.col("plain").alias("prefix"), "place")
    rest = files.join(exact, "file", "left_anti").join(F.broadcast(others), F.col("plain").startswith(F.col("prefix"))).groupBy("file").agg(F.min("place").alias("place"))
    files = exact.unionByName(rest).withColumn("file_no", F.row_number().over(Window.orderBy("place", "file")) - 1)  # one row a file
    where = blocks.join(files, "file").select("file", "at", "first", "before", "place", "file_no")
    return rows.join(where, ["file", "at"]).select("place", "file_no", (F.col("m") - F.col("first") + F.col("before")).alias("no"), "value")


def _places(spark: SparkSession, paths: list[str]) -> DataFrame:
    """plain, place: the paths as Spark names them, with their place in the list."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    names = []
    for n, p in enumerate(paths):
        path = jvm.org.apache.hadoop.fs.Path(p.split("*")[0].split("?")[0])
        names.append((re.sub("^file:/+", "file:/", path.getFileSystem(conf).makeQualified(path).toUri().toString()), n))
    return spark.createDataFrame(names, "plain string, place int")


def _ids(rows: DataFrame, columns: list[str]) -> DataFrame:
    """seq_id and columns of rows (place, file_no, no): files one after the other. No record is moved."""
    per = rows.groupBy("place", "file_no").agg((F.max("no") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("place", "file_no").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("place", "file_no", F.coalesce(before, F.lit(0)).alias("before"))  # one row a file
    return rows.join(per, ["place", "file_no"]).select((F.col("before") + F.col("no")).alias("seq_id"), *columns)


def _fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """place, file_no, no, header, seq."""
    records = _lines(spark, paths, "\n>").where(F.length(F.trim("value")) > 0)  # a record begins with > at a line's start
    rows = _numbered(records, spark, paths, "fasta")
    body = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.regexp_extract(body, "^([^\n]*)", 1), "\r$", "")
    seq = dna.upper(F.regexp_replace(F.regexp_replace(body, "^[^\n]*\n?", ""), "[\r\n ]", ""))
    return rows.select("place", "file_no", "no", head.alias("header"), seq.alias("seq"))


def _fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """place, file_no, no, header, seq, quality."""
    rows = _numbered(_lines(spark, paths, "\n"), spark, paths, "fastq")
    field, line = F.col("no") % 4, F.regexp_replace("value", "\r$", "")
    four = rows.groupBy("place", "file_no", F.floor(F.col("no") / 4).alias("record")).agg(*[F.max(F.when(field == k, line)).alias(c) for k, c in ((0, "h"), (1, "s"), (3, "q"))])
    whole = four.where("q IS NOT NULL")
    return whole.select("place", "file_no", F.col("record").alias("no"), F.expr("substring(h, 2)").alias("header"), dna.upper(F.col("s")).alias("seq"), F.col("q").alias("quality"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """FASTA files, gzip allowed: seq_id, header, seq (upper case), in the order of the list. A file is read by many tasks."""
    return _ids(_fasta(spark, [paths] if isinstance(paths, str) else paths), ["header", "seq"])


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """FASTQ files of four lines a record, gzip allowed: seq_id, header, seq (upper case), quality, in the order of the list.

    A file is read by many tasks: lines are numbered from the numbers of lines of the blocks before, as only these tell a
    quality line from a header. What is left of less than four lines at a file's end is no record.
    """
    return _ids(_fastq(spark, [paths] if isinstance(paths, str) else paths), ["header", "seq", "quality"])


#: Usual file name endings, before .gz.
FASTQ_NAMES, FASTA_NAMES = (".fastq", ".fq"), (".fasta", ".fa", ".fna", ".ffn", ".faa", ".frn")


def _kinds(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    """Path -> whether it is FASTQ: by its name, else by the first character, which one job reads of all others."""
    names = {p: p.lower().removesuffix(".gz") for p in paths}
    kinds = {p: n.endswith(FASTQ_NAMES) for p, n in names.items() if n.endswith(FASTQ_NAMES + FASTA_NAMES)}
    rest = [p for p in paths if p not in kinds]
    if rest:
        raw = spark.read.text(rest).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.left("value", F.lit(1)).alias("c"), F.monotonically_increasing_id().alias("m"))
        first = raw.where("at = 0 AND c <> ''").groupBy("file").agg(F.min_by("c", "m").alias("c"))
        plain = F.regexp_replace("file", "^file:/+", "file:/")
        places = _places(spark, rest)
        got = first.withColumn("f", plain).join(places, F.col("f").startswith(F.col("plain"))).groupBy("place").agg(F.max(F.col("c") == "@").alias("fastq"))
        found = {r.place: r.fastq for r in got.collect()}  # one row a path
        kinds.update({p: found.get(n, False) for n, p in enumerate(rest)})
    return kinds


def read_any(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """FASTA or FASTQ files, of all paths at once: (seq_id, seq), in the order of the list."""
    paths = [paths] if isinstance(paths, str) else paths
    kinds = _kinds(spark, paths)
    out = None
    for fastq, read in ((False, _fasta), (True, _fastq)):
        mine = [n for n, p in enumerate(paths) if kinds[p] == fastq]
        if mine:
            rows = read(spark, [paths[n] for n in mine]).select("place", "file_no", "no", "seq")
            if len(mine) < len(paths):  # places in the whole list
                whole = spark.createDataFrame(list(enumerate(mine)), "place int, whole int")
                rows = rows.join(F.broadcast(whole), "place").select(F.col("whole").alias("place"), "file_no", "no", "seq")
            out = rows if out is None else out.unionByName(rows)
    return _ids(store.written(out, "records"), ["seq"])


def read_list(spark: SparkSession, list_path: str) -> DataFrame:
    """A file of paths, a line each: the records of all files, in order."""
    return read_any(spark, [r[0].strip() for r in spark.read.text(list_path).collect() if r[0].strip()])


def with_reverse_complements(seqs: DataFrame) -> DataFrame:
    """Each sequence followed by its reverse complement: rc is false and true."""
    both = F.array(F.struct(F.lit(False).alias("rc"), F.col("seq").alias("seq")), F.struct(F.lit(True).alias("rc"), dna.reverse_complement(F.col("seq")).alias("seq")))
    return seqs.select("seq_id", F.explode(both).alias("b")).select("seq_id", "b.rc", "b.seq")


def concatenated(seqs: DataFrame) -> DataFrame:
    """All sequences as one string #$s1$s2$..., in order of seq_id (small inputs: one row comes of it)."""
    parts = seqs.groupBy().agg(F.array_sort(F.collect_list(F.struct("seq_id", "seq"))).alias("a"))
    return parts.select(F.concat(F.lit("#$"), F.array_join(F.transform("a", lambda x: x["seq"]), "$"), F.lit("$")).alias("text"))


def dna_runs(seqs: DataFrame) -> DataFrame:
    """seq_id, run number, run: the maximal runs of ACGT."""
    return seqs.select("seq_id", F.posexplode(dna.runs(F.col("seq"))).alias("run_no", "run"))


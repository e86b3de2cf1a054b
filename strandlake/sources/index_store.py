"""Indexes as Parquet, the other outputs, and readers of foreign index files."""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.index import COLUMNS, KmerIndex, ordered

FORMAT = "strandlake-2"
#: The longest k whose reversed nodes are stored as numbers (digits $ACGT in base 5 of a BIGINT).
NUMBERED = 26
DIGITS = "01234"


def _packed(nodes: DataFrame, k: int) -> DataFrame:
    """colex, rev, labels (a bit each), lcs: all else follows from these. Ascending numbers take a few bits each in a file."""
    rev = F.reverse("node")
    if k <= NUMBERED:
        rev = F.conv(F.translate(rev, "$ACGT", DIGITS), 5, 10).cast("long")
    bits = sum((F.when(F.col(x), 1 << n).otherwise(0) for n, x in enumerate("acgt")), F.lit(0))
    return nodes.select("colex", rev.alias("rev"), bits.cast("byte").alias("labels"), F.col("lcs").cast("short").alias("lcs"))


def _unpacked(rows: DataFrame, k: int) -> DataFrame:
    rev = F.translate(F.lpad(F.conv(F.col("rev").cast("string"), 10, 5), k, "0"), DIGITS, "$ACGT") if k <= NUMBERED else F.col("rev")
    rows = rows.withColumn("node", F.reverse(rev)).withColumn("len", F.length(F.translate("node", "$", "")).cast("int"))
    leads = (F.col("colex") == 0) | (F.col("lcs") < k - 1)
    labels = [F.col("labels").bitwiseAND(F.lit(1 << n)).cast("boolean").alias(x) for n, x in enumerate("acgt")]
    return rows.select("colex", "node", "len", (F.col("len") < k).alias("is_dummy"), F.right("node", F.lit(k - 1)).alias("grp"), leads.alias("is_leader"), *labels, F.col("lcs").cast("int").alias("lcs")).select(*COLUMNS)


def save(index: KmerIndex, path: str, mode: str = "errorifexists") -> None:
    """nodes in order of colex, range-partitioned so that rank ranges prune files; counts if there are any; one row of meta."""
    n = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _packed(index.nodes, index.k).repartitionByRange(n, "colex").sortWithinPartitions("colex")
    # version 2 of the format writes ascending numbers as differences
    rows.write.mode(mode).option("parquet.writer.version", "v2").option("parquet.enable.dictionary#rev", "false").option("parquet.enable.dictionary#colex", "false").parquet(f"{path}/nodes")
    if index.counts is not None:
        index.counts.write.mode(mode).parquet(f"{path}/counts")
    meta = index.stats().withColumns({"precalc_length": F.lit(index.precalc_length), "all_dummy_paths": F.lit(index.all_dummy_paths), "has_counts": F.lit(index.counts is not None), "format": F.lit(FORMAT)})
    meta.coalesce(1).write.mode(mode).json(f"{path}/meta")


def load(spark: SparkSession, path: str) -> KmerIndex:
    meta = spark.read.json(f"{path}/meta").first()
    if meta is None or meta["format"] != FORMAT:
        raise ValueError(f"{path} holds no index of this format")
    counts = spark.read.parquet(f"{path}/counts") if meta["has_counts"] else None
    return KmerIndex(meta["k"], _unpacked(spark.read.parquet(f"{path}/nodes"), meta["k"]), meta["all_dummy_paths"], meta["precalc_length"], counts)


def size_bits(index: KmerIndex, path: str) -> DataFrame:
    """n_kmers, bytes, bits_per_kmer of a saved index."""
    spark = index.spark
    files = spark.read.format("binaryFile").load(f"{path}/nodes").agg(F.sum("length").alias("bytes"))
    both = index.stats().select("n_kmers").withColumn("bytes", F.lit(files.first().bytes))
    return both.withColumn("bits_per_kmer", F.try_divide(F.col("bytes") * 8.0, F.col("n_kmers")))


def write_lines(df: DataFrame, path: str, col: str = "value", mode: str = "errorifexists") -> None:
    df.select(F.col(col).alias("value")).write.mode(mode).text(path)


def dump_kmers(index: KmerIndex, path: str, dummies: bool = False, mode: str = "errorifexists") -> None:
    """One k-mer a line, in colexicographic order over the part files."""
    rows = index.nodes if dummies else index.nodes.where(~F.col("is_dummy"))
    n = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "colex").sortWithinPartitions("colex").select(F.col("node").alias("value")).write.mode(mode).text(path)


# --- foreign files, read whole on the driver: for small indexes made elsewhere


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the file is cut short")
        self.at += n
        return out

    def long(self) -> int:
        return struct.unpack("<Q", self.take(8))[0]

    def text(self) -> str:
        return self.take(self.long()).decode()

    def bits(self) -> list[bool]:
        """A bit vector: its length in bits, then 64-bit words, the first bit the lowest."""
        n = self.long()
        words = self.take(8 * ((n + 63) // 64))
        return [bool(words[i >> 3] >> (i & 7) & 1) for i in range(n)]


def nodes_from_rows(k: int, rows: list[list[bool]]) -> list[tuple[str, int]]:
    """(node, len) of the padded k-mers from the four rows of label bits in order A, C, G, T.

    A node's last character follows from its rank, as edges lead to ranks in order of their labels; what is before it is
    the node the edge comes from, found again k times.
    """
    n = len(rows[0])
    back: list[int | None] = [None]
    last = ["$"]
    for letter, bits in zip("ACGT", rows):
        for i in range(n):
            if bits[i]:
                back.append(i)
                last.append(letter)
    if len(back) != n:
        raise ValueError("the label bits don't enter every node once")
    out = []
    for i in range(n):
        text, at = "", i
        while len(text) < k and back[at] is not None:
            text = last[at] + text
            at = back[at]
        out.append((text.rjust(k, "$"), len(text)))
    return out


def import_plain_matrix(spark: SparkSession, path: str) -> KmerIndex:
    """An index file of bit vectors in the plain-matrix layout, version v0.1, with or without a leading type name.

    Layout: type name (its length, then the name), version (likewise), the four bit vectors A, C, G, T, their four rank
    supports, a bit vector of group marks, C, the table of prefix ranges, its prefix length, numbers of nodes and k-mers, k.
    """
    raw = spark.read.format("binaryFile").load(path).first().content
    r = _Reader(bytes(raw))
    name = r.text()
    if name != "v0.1" and r.text() != "v0.1":
        raise ValueError("not a plain-matrix index of version v0.1")
    rows = [r.bits() for _ in range(4)]
    prefix, n_nodes, n_kmers, k = struct.unpack("<4q", r.raw[-32:])
    nodes = nodes_from_rows(k, rows)
    if len(nodes) != n_nodes or sum(size == k for _, size in nodes) != n_kmers:
        raise ValueError("the file's numbers disagree with its bits")
    return KmerIndex(k, ordered(spark.createDataFrame(nodes, "node string, len int"), k), precalc_length=prefix)


def import_bwt(spark: SparkSession, bwt: bytes, sentinel: str = "#") -> DataFrame:
    """text: the string whose BWT is given (a small one, undone on the driver)."""
    s = bwt.decode()
    order = sorted(range(len(s)), key=lambda i: (s[i], i))  # the row that begins with what another one ends with
    at, out = s.index(sentinel), []
    for _ in s:
        at = order[at]
        out.append(s[at])
    return spark.createDataFrame([("".join(out[-1:] + out[:-1]),)], "text string")


def truncated_lcp(lcp: list[int], k: int) -> list[int]:
    """Common-prefix lengths cut off at k."""
    return [min(x, k) for x in lcp]


def report(record: dict) -> str:
    """A benchmark's record as a line of JSON."""
    return json.dumps(record)

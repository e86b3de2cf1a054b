"""Scalar functions on DNA strings, as Spark columns; and the same as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ACGT"
PAD = "$"
#: Characters of a run that are cut into windows at once: substring() scans a string from its start.
CHUNK = 256


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def upper(seq: Column) -> Column:
    """a, c, g and t in upper case; nothing else changes, so lengths stay (upper() makes two letters of some)."""
    return F.translate(seq, "acgt", "ACGT")


def is_dna(seq: Column) -> Column:
    """Whether a string consists of A, C, G and T in either case (true for an empty one)."""
    return ~seq.rlike("[^ACGTacgt]")


def char_idx(c: Column) -> Column:
    """0..3 for A, C, G, T in either case, null for any other character."""
    i = F.instr(F.lit(ALPHABET), upper(c))
    return F.when((F.length(c) == 1) & (i > 0), i - 1)


def sanitised(seq: Column) -> Column:
    """Characters other than A, C, G, T become the separator $."""
    return F.regexp_replace(seq, "[^ACGT]", "\\$")


def reversed_sanitised(seq: Column) -> Column:
    return F.reverse(sanitised(seq))


def from_text(text: Column) -> Column:
    """Letters mapped onto ACGT in turn, spaces deleted, all else kept as it is (and so a separator)."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters + " ", (ALPHABET * 13)[:52])


def runs(seq: Column) -> Column:
    """The maximal runs of A, C, G and T."""
    return F.regexp_extract_all(seq, F.lit("([ACGT]+)"), F.lit(1))


def packed(kmer: Column, k: int) -> Column:
    """A k-mer of up to 31 characters as a BIGINT of two bits a character; integers compare as the strings do."""
    if not 1 <= k <= 31:
        raise ValueError("packing holds 1 to 31 characters")
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpacked(value: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def right_shifted(kmer: Column, n: int) -> Column:
    """Characters moved n to the right, A comes in."""
    return F.left(F.concat(F.lit("A" * n), kmer), F.length(kmer))


def left_shifted(kmer: Column, n: int) -> Column:
    """Characters moved n to the left, A comes in."""
    return F.right(F.concat(kmer, F.lit("A" * n)), F.length(kmer))


def with_char(kmer: Column, i: int, c: str) -> Column:
    """The k-mer with character i (from 0) replaced."""
    return F.overlay(kmer, F.lit(c), F.lit(i + 1), F.lit(1))


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """Length of the common prefix of two strings, at most `most`."""
    same = [(F.length(a) >= i) & (F.length(b) >= i) & (F.left(a, F.lit(i)) == F.left(b, F.lit(i))) for i in range(1, most + 1)]
    if most <= 40:
        return sum((x.cast("int") for x in same), F.lit(0))
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: (i <= F.least(F.length(a), F.length(b))) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))


def common_suffix(a: Column, b: Column, most: int) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b), most)


def successor(kmer: Column, c: Column) -> Column:
    """The k-mer that follows when c is read."""
    return F.concat(F.substring(kmer, F.lit(2), F.length(kmer) - 1), c)


def bit_width(x: Column) -> Column:
    """Bits needed for a value; 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def windows(runs_df: DataFrame, run: str, k: int, out: str, keep: list[str] | None = None, offset: str | None = None, start: str | None = None) -> DataFrame:
    """One row for each window of k characters of a column; with start, its 0-based position (plus offset's value).

    Long strings are first cut into chunks that overlap by k - 1, so the work is linear in their length. Windows are cut
    after the explosion of their places, in generated code.
    """
    keep = keep or []
    step = max(CHUNK, 2 * k)
    long = runs_df.where(F.length(run) >= k)
    chunk = F.transform(F.sequence(F.lit(0), F.length(run) - k, F.lit(step)), lambda at: F.struct(at.alias("at"), F.substring(run, at + 1, F.lit(step + k - 1)).alias("part")))
    before = [*keep, *([offset] if offset else [])]
    cut = long.select(*before, F.explode(chunk).alias("__c")).select(*before, F.col("__c.at").alias("__at"), F.col("__c.part").alias("__part"))
    rows = cut.select(*before, "__at", "__part", F.explode(F.sequence(F.lit(0), F.length("__part") - k)).alias("__i"))
    window = F.substring("__part", F.col("__i") + 1, F.lit(k)).alias(out)
    if not start:
        return rows.select(*keep, window)
    at = F.col("__at") + F.col("__i") + (F.col(offset) if offset else F.lit(0))
    return rows.select(*keep, at.cast("long").alias(start), window)


#: The most characters that coded() holds: decimal digits of a BIGINT.
CODED = 18


def as_digits(seq: Column) -> Column:
    """ACGT as 0123, all other characters as x."""
    return F.regexp_replace(F.translate(seq, ALPHABET, "0123"), "[^0-3]", "x")


def coded(digits: Column) -> Column:
    """A string of at most CODED digits 0123 as a BIGINT, read as a decimal number; null if it holds an x.

    Numbers of one length compare as the strings do, and are hashed, shuffled and compared as 8 bytes.
    """
    return digits.try_cast("long")


def decoded(code: Column, k: int) -> Column:
    """The string of k characters that a number stands for."""
    return F.translate(F.lpad(code.cast("string"), k, "0"), "0123", ALPHABET)


def register(spark: SparkSession) -> None:
    """SQL functions revcomp, is_dna, dna_runs, from_text, lcs_len and kmers (a table function's array form)."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN translate(reverse(s), 'ACGT', 'TGCA')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_dna(s STRING) RETURNS BOOLEAN RETURN NOT (s RLIKE '[^ACGTacgt]')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dna_runs(s STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(s, '([ACGT]+)', 1)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dna_from_text(s STRING) RETURNS STRING RETURN translate(s, '{letters}', '{(ALPHABET * 13)[:52]}')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lcs_len(a STRING, b STRING) RETURNS INT RETURN size(filter(sequence(0, least(length(a), length(b))), i -> i > 0 AND right(a, i) = right(b, i)))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmers(s STRING, k INT) RETURNS ARRAY<STRING> RETURN flatten(transform(regexp_extract_all(s, '([ACGT]+)', 1), r -> CASE WHEN length(r) >= k THEN transform(sequence(1, length(r) - k + 1), p -> substring(r, p, k)) ELSE array() END))")

"""Matching statistics and shortest frequency-bounded suffixes.

At a position of a query the context is its last characters, at most k, back to the nearest character that is not ACGT.
Contexts that occur often are worked on once. The longest suffix of a context that the index has is found from its two
neighbours in colexicographic order: contexts and nodes are sorted together, and of the nodes next to a context on
either side one shares the longest suffix with it. Ranges of strings come from the same kind of sort. So the cost is
that of sorting nodes and contexts, without k rows for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators.index import KmerIndex
from strandlake.operators.search import bounds, intervals
from strandlake.plans import rank, store
from strandlake.shipping import ship


def padded(queries: DataFrame, k: int, *keep: str) -> DataFrame:
    """query_id, keep, seq: the queries (query_id, seq) behind k-1 pads, so that they have a window for every character.

    It is written once in as many parts as a shuffle has, whatever files the queries lie in: positions are made of it
    anew each time they are read, as they are hundreds of times as many rows.
    """
    seq = F.concat(F.lit(dna.PAD * (k - 1)), dna.sanitised(dna.upper(F.col("seq"))))
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store.written(queries.select("query_id", *keep, seq.alias("seq")).repartition(parts), "padded")


def _context(window: str) -> Column:
    return F.substring_index(window, dna.PAD, -1)


def contexts(padded: DataFrame, k: int, offset: str | None = None) -> DataFrame:
    """query_id, pos (plus offset's value), context for every character of padded queries."""
    cells = dna.windows(padded, "seq", k, "w", ["query_id"], offset, "pos")
    return cells.select("query_id", "pos", _context("w").alias("context"))


def distinct_contexts(padded: DataFrame, k: int) -> DataFrame:
    """The distinct contexts of padded queries; windows are made distinct first."""
    return dna.windows(padded, "seq", k, "w").distinct().select(_context("w").alias("context")).distinct()


#: Tables of so many contexts are broadcast to the positions (some 100 bytes each); larger ones are joined by a shuffle.
FEW_CONTEXTS = 1_000_000


def _back(at: DataFrame, by_context: DataFrame, how: str = "inner") -> DataFrame:
    """The positions (with context) with what is known of their contexts, one row each."""
    by_context = store.written(by_context, "by_context")
    return at.join(F.broadcast(by_context) if by_context.count() <= FEW_CONTEXTS else by_context, "context", how)


def _lengths(index: KmerIndex, distinct: DataFrame, bound: int) -> DataFrame:
    """context, len: of its longest suffix, at most bound, that ends a node."""
    held = index.nodes.select(F.reverse("node").alias("key"))
    keys = distinct.select("context", F.reverse(F.right("context", F.lit(bound))).alias("key"))
    near = rank.merged(held, keys.select("key")).select("key", "prev", "next")
    empty = F.lit("")
    best = F.greatest(dna.common_prefix(F.col("key"), F.coalesce("prev", empty), bound), dna.common_prefix(F.col("key"), F.coalesce("next", empty), bound))
    return keys.join(near, "key").select("context", best.cast("int").alias("len"))


def _ranges(index: KmerIndex, text: DataFrame, bound: int | None = None) -> DataFrame:
    """context, len, lo, hi of each distinct context of padded queries."""
    bound = index.k if bound is None else min(bound, index.k)
    distinct = store.written(distinct_contexts(text, index.k), "contexts")
    found = store.written(_lengths(index, distinct, bound), "lengths") if bound else distinct.select("context", F.lit(0).alias("len"))
    strings = found.select("context", "len", F.expr("right(context, len)").alias("str"))
    ranges = bounds(index, strings.where("len > 0").select("str"))
    return strings.join(ranges, "str", "left").select("context", "len", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(index.n_sets())).alias("hi"))


def statistics_of(index: KmerIndex, text: DataFrame, bound: int | None = None, offset: str | None = None) -> DataFrame:
    """query_id, pos (plus offset's value), len, lo, hi of padded queries."""
    return _back(contexts(text, index.k, offset), _ranges(index, text, bound)).select("query_id", "pos", "len", "lo", "hi")


def matching_statistics(index: KmerIndex, queries: DataFrame, bound: int | None = None) -> DataFrame:
    """query_id, pos, len, lo, hi: at each position the longest suffix (at most bound characters) in the index, and its range.

    A character that is not ACGT, or that the index doesn't have, gives length 0 and the range of all nodes.
    """
    return statistics_of(index, padded(queries, index.k), bound)


def matching_statistics_by_join(index: KmerIndex, queries: DataFrame, bound: int | None = None) -> DataFrame:
    """The same from a table of all suffixes' ranges: k rows a node and a context, good for small k."""
    bound = index.k if bound is None else min(bound, index.k)
    at = contexts(padded(queries, index.k), index.k)
    each = at.select("context").distinct().select("context", F.explode(F.sequence(F.lit(0), F.least(F.length("context"), F.lit(bound)))).alias("d")).withColumn("str", F.expr("right(context, d)"))
    met = each.join(intervals(index, list(range(bound + 1))).drop("len"), "str")
    best = met.groupBy("context").agg(F.max(F.struct("d", "lo", "hi")).alias("x"))
    return at.join(best, "context").select("query_id", "pos", F.col("x.d").cast("int").alias("len"), "x.lo", "x.hi")


def _crowded(index: KmerIndex, t: int) -> DataFrame:
    """colex, crowd: the longest suffix of a node that more than t nodes in a row around it end in; -1 if there are no more than t nodes.

    Nodes t apart share what all between them share, so each node is met by the one t further on, and the greatest such
    length of the t + 1 stretches that hold a node is its crowd. Stretches are dealt by blocks of ranks, those that reach
    into the next block to both.
    """
    nodes = index.nodes.select("colex", F.reverse("node").alias("rev"))
    apart = nodes.select((F.col("colex") - t).alias("colex"), F.col("rev").alias("far"))
    pad = F.regexp_replace("rev", "\\$", "#")  # a pad is like no other character
    shared = nodes.join(apart, "colex").select("colex", dna.common_prefix(pad, F.col("far"), index.k).alias("shared"))
    block = 1 << 16
    rows = nodes.select("colex").join(shared, "colex", "left").select("colex", F.coalesce("shared", F.lit(-1)).alias("shared"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("colex") / block), F.floor((F.col("colex") + t) / block))))
    near = Window.partitionBy("block").orderBy("colex").rowsBetween(-t, 0)
    out = rows.withColumn("crowd", F.max("shared").over(near))
    return out.where(F.col("block") == F.floor(F.col("colex") / block)).select("colex", "crowd")


def frequency_bounded_suffixes(index: KmerIndex, queries: DataFrame, t: int) -> DataFrame:
    """query_id, pos, len, lo, hi: the shortest matching suffix whose range has at most t nodes; nulls where there is none.

    The range of the longest match lies among all others, so its crowd says how short a suffix may be: one string a context.
    """
    text = padded(queries, index.k)
    found = store.written(_lengths(index, store.written(distinct_contexts(text, index.k), "contexts"), index.k).withColumn("str", F.expr("right(context, len)")), "longest")
    n = index.n_sets()
    top = found.join(bounds(index, found.where("len > 0").select("str")), "str", "left").select("context", "len", F.coalesce("lo", F.lit(0)).alias("colex"))
    top = top.join(store.written(_crowded(index, t), "crowds"), "colex").select("context", "len", (F.col("crowd") + 1).alias("d"))
    best = store.written(top.where("d <= len").select("context", "d", F.expr("right(context, d)").alias("str")), "shortest")
    best = best.join(bounds(index, best.where("d > 0").select("str")), "str", "left")
    best = best.select("context", F.col("d").cast("int").alias("len"), F.coalesce("lo", F.lit(0)).cast("long").alias("lo"), F.coalesce("hi", F.lit(n)).cast("long").alias("hi"))
    return _back(contexts(text, index.k), best, "left").select("query_id", "pos", "len", "lo", "hi")


def contract_left(index: KmerIndex, rows: DataFrame, col: str = "str", length: str = "len") -> DataFrame:
    """rows with lo, hi of the suffix of the given length of a string that the index has."""
    cut = rows.withColumn("__s", F.expr(f"right({col}, {length})"))
    found = bounds(index, cut.where("length(__s) > 0").select(F.col("__s").alias("str")))
    out = cut.join(found.withColumnRenamed("str", "__s"), "__s", "left")
    every = F.length("__s") == 0
    return out.select(*rows.columns, F.when(every, F.lit(0)).otherwise(F.col("lo")).alias("lo"), F.when(every, F.lit(index.n_sets())).otherwise(F.col("hi")).alias("hi"))


def extend_right(index: KmerIndex, rows: DataFrame, col: str = "str", label: str = "label") -> DataFrame:
    """rows with lo, hi of the string followed by a character (its last k characters); null if absent."""
    cut = rows.withColumn("__s", F.right(F.concat(col, label), F.lit(index.k)))
    found = bounds(index, cut.select(F.col("__s").alias("str")))
    return cut.join(found.withColumnRenamed("str", "__s"), "__s", "left").select(*rows.columns, "lo", "hi")


def _cell(x: Column) -> Column:
    return F.concat(F.lit("("), x["len"], F.lit(","), x["lo"], F.lit(".."), x["hi"], F.lit(")"))


def ms_lines(stats: DataFrame) -> DataFrame:
    """query_id, line: (len,lo..hi) of all positions, joined by commas."""
    cells = stats.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "len", "lo", "hi"))).alias("r"))
    return cells.select("query_id", F.array_join(F.transform("r", _cell), ",").alias("line"))


#: Cells of so many contexts are sent to the tasks that write lines (some 30 bytes each); with more, positions are rows.
FEW_CELLS = 1 << 18
#: Longer contexts don't fit a number of 64 bits with a mark for their length.
WIDEST = 31
#: Positions that are worked on at once (more only for a longer sequence).
AT_ONCE = 1 << 20


def _codes(text: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Of each character the context that ends there, as a number: 1, then two bits a character. starts: of sequences."""
    digit = np.full(256, 4, np.uint8)
    digit[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    digits = digit[text]
    place = np.arange(len(text))
    before = np.where(digits == 4, place, -1)
    before[starts] = np.maximum(before[starts], starts - 1)
    size = np.minimum(place - np.maximum.accumulate(before), k)
    out = np.left_shift(np.uint64(1), (2 * size).astype(np.uint64))
    for i in range(min(k, len(text))):
        out[i:] |= np.where(size[i:] > i, digits[: len(digits) - i].astype(np.uint64) << np.uint64(2 * i), np.uint64(0))
    return out


def _line_writer(cells, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of query_id, seq (not empty, of ACGT$) their lines. cells: a broadcast of contexts' codes, in order, and their cells."""

    def lines(ids: pa.Array, seqs: pa.Array) -> pa.RecordBatch:
        size = pc.binary_length(seqs).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        text = np.frombuffer("".join(seqs.to_pylist()).encode(), np.uint8)
        codes, words = cells.value
        found = words.take(pa.array(np.searchsorted(codes, _codes(text, ends - size, k))))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), found), ",")
        return pa.RecordBatch.from_arrays([ids, joined.cast(seqs.type)], ["query_id", "line"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column("seq")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
                part = b.slice(at, to - at)
                yield lines(part.column("query_id"), part.column("seq"))
                at = to

    return write


def lines(index: KmerIndex, queries: DataFrame, bound: int | None = None) -> DataFrame:
    """ms_lines() of matching_statistics(). With few contexts a line is put together from its sequence, in Arrow batches.

    Then no position is a row. Queries that share an id are one line, their cells sorted, and take the way by rows.
    """
    k = index.k
    text = padded(queries, k)
    ranges = store.written(_ranges(index, text, bound), "by_context")
    by_rows = lambda t: ms_lines(_back(contexts(t, k), ranges))
    if k > WIDEST or ranges.count() > FEW_CELLS:
        return by_rows(text)
    held = ranges.select("context", _cell(F.struct("len", "lo", "hi")).alias("cell")).toArrow()
    digits = str.maketrans("ACGT", "0123")
    codes = np.array([int("1" + c.translate(digits), 4) for c in held["context"].to_pylist()], np.uint64)
    order = np.argsort(codes)
    cells = index.spark.sparkContext.broadcast((codes[order], held["cell"].combine_chunks().take(pa.array(order))))
    twice = store.written(text.groupBy("query_id").count().where("count > 1").select("query_id"), "twice")
    if twice.isEmpty():
        own, rest = text, None
    else:
        same = F.col("query_id").eqNullSafe(F.col("other"))
        other = twice.withColumnRenamed("query_id", "other")
        own, rest = text.join(other, same, "left_anti"), text.join(other, same, "left_semi")
    seqs = own.select("query_id", F.substring("seq", F.lit(k), F.length("seq")).alias("seq")).where("length(seq) > 0")
    ship(index.spark)
    id_type = text.schema["query_id"].dataType.simpleString()
    out = seqs.mapInArrow(_line_writer(cells, k), f"query_id {id_type}, line string")
    return out if rest is None else out.unionByName(by_rows(rest))

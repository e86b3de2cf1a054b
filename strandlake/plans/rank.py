"""Global ranks and neighbours in a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.plans import store


def ranked(df: DataFrame, key: str, rank: str = "rank", before: str | None = None, partitions: int | None = None) -> DataFrame:
    """df with the 0-based rank of key (distinct values) in binary order and, if asked, the key of the row before.

    Rows are range-partitioned by key and written once, so that a row's range stays what it is. A range's first rank is
    the sum of the sizes of the ranges before it; these sizes, and the last key of each range, are one row a range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = store.written(df.repartitionByRange(n, key).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("__range").agg(F.count("*").alias("size"), F.max(key).alias("last")).orderBy("__range").collect()
    rows, total, last = [], 0, None
    for s in sums:
        rows.append((s["__range"], total, last))
        total, last = total + s["size"], s["last"]
    schema = f"__range int, __first long, __last {df.schema[key].dataType.simpleString()}"
    firsts = F.broadcast(spark.createDataFrame(rows, schema))
    w = Window.partitionBy("__range").orderBy(key)
    out = ranges.join(firsts, "__range").withColumn(rank, F.col("__first") + F.row_number().over(w) - 1)
    if before:
        out = out.withColumn(before, F.coalesce(F.lag(key).over(w), F.col("__last")))
    return out.drop("__range", "__first", "__last")


def running_sums(df: DataFrame, order: str, values: list[str], blocks: int = 1 << 16) -> DataFrame:
    """df with, for each value column v, before_v: its sum over the rows of smaller order (a dense rank from 0).

    Sums run within blocks of consecutive ranks; the blocks' own sums run within groups of as many blocks, and only the
    groups' sums, a row for blocks * blocks ranks, run in one task.
    """
    d = df.withColumn("__block", F.floor(F.col(order) / blocks))
    w = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("__block").agg(*[F.sum(v).alias(f"__s_{v}") for v in values]).withColumn("__group", F.floor(F.col("__block") / blocks))
    within = Window.partitionBy("__group").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("__group").agg(*[F.sum(f"__s_{v}").alias(f"__t_{v}") for v in values])
    over = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("__group", *[F.coalesce(F.sum(f"__t_{v}").over(over), F.lit(0)).alias(f"__g_{v}") for v in values])
    sums = sums.withColumns({f"__i_{v}": F.coalesce(F.sum(f"__s_{v}").over(within), F.lit(0)) for v in values}).join(groups, "__group")
    sums = sums.select("__block", *[(F.col(f"__i_{v}") + F.col(f"__g_{v}")).alias(f"__b_{v}") for v in values])
    out = d.join(sums, "__block")
    for v in values:
        out = out.withColumn(f"before_{v}", F.coalesce(F.sum(v).over(w), F.lit(0)) + F.col(f"__b_{v}"))
    return out.drop("__block", *[f"__b_{v}" for v in values])


def merged(held: DataFrame, keys: DataFrame, key: str = "key", partitions: int | None = None) -> DataFrame:
    """For each distinct row of keys: key, below, prev, next - its place among the distinct keys of held.

    below is the number of held keys smaller than it, prev the largest of these, next the smallest one not below it.
    Both sides are sorted together once, by ranges; what a range needs of the others is one row a range.
    """
    spark = held.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = keys.select(key, F.lit(0).alias("__held")).distinct().unionByName(held.select(key, F.lit(1).alias("__held")))
    ranges = store.written(both.repartitionByRange(n, key, "__held").withColumn("__range", F.spark_partition_id()), "ranges")
    mine = F.when(F.col("__held") == 1, F.col(key))
    sums = ranges.groupBy("__range").agg(F.sum("__held").alias("size"), F.min(mine).alias("lo"), F.max(mine).alias("hi")).orderBy("__range").collect()
    rows, total, last = [], 0, None
    for s in sums:
        rows.append([s["__range"], total, last, None])
        total, last = total + s["size"], s["hi"] if s["hi"] is not None else last
    after = None
    for row, s in zip(reversed(rows), reversed(sums)):
        row[3] = after
        after = s["lo"] if s["lo"] is not None else after
    kind = held.schema[key].dataType.simpleString()
    edges = F.broadcast(spark.createDataFrame([tuple(r) for r in rows], f"__range int, __first long, __last {kind}, __after {kind}"))
    w = Window.partitionBy("__range").orderBy(key, "__held")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = ranges.join(edges, "__range").select(
        key, "__held", (F.sum("__held").over(up) + F.col("__first")).alias("below"), F.coalesce(F.last(mine, ignorenulls=True).over(up), F.col("__last")).alias("prev"), F.coalesce(F.first(mine, ignorenulls=True).over(down), F.col("__after")).alias("next")
    )
    return out.where("__held = 0").drop("__held")

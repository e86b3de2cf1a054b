"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a flow that is served in proportion to its target. Its documents are shuffled by a seeded hash and
queued; a source may be read up to MAX_PASSES times over. A document's virtual finish time in a pass is the number of
the source's tokens queued up to its end, divided by the source's target. All finish times are range-sorted and the
queue is cut where the total budget is reached; whole documents only.

A finish time over 1 would take a source past its target, so what lies between 1 and the cut is passed over, and each
source is filled up from further down its queue instead: FILLS times with documents of the largest size that still fits
what is left of its target, up to SAME of them, each time of a smaller size. So a long document does not end its source,
and the budget holds.

Texts are read once, for their sizes; everything after works on a narrow table (id, source, size, shuffle key).
Cumulative sums never gather a source in one task: a source is cut into CHUNKS by its shuffle key's leading digits,
sums run within a chunk, and the chunks' totals are summed up in a table of (sources x chunks) rows. The same is done
for the global queue, whose chunks are the range partitions of the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import common

MAX_PASSES = 3
CYCLE = 3
FILLS, SAME = 4, 4
#: Tables of so many sources are broadcast, larger ones joined by a shuffle (hot sources still by broadcast).
FEW_SOURCES = 100_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: int = CYCLE, passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Sources in code-point order, null last, weigh 1..cycle, repeating. The whole size is shared by weight; a target
    stops at passes times its source's size and the excess is shared again by weight. In order of cap over weight
    the capped sources come first, so the k capped ones are found from running sums: the level, what is left over
    after the caps divided by the weights that are left, is right where the next source's cap is not below it.
    The windows run over one row a source.
    """
    w = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % cycle + 1)
    w = w.withColumn("cap", F.col("source_size") * passes)
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.asc_nulls_last("source"))
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    w = w.withColumn("left_size", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # a source is capped if its own cap is not above the level that holds when all before it are capped
    w = w.withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("left_size") * F.col("weight"))
    free = F.when(~F.col("capped"), F.struct(F.col("left_weight"), F.col("left_size")))
    w = w.withColumn("first_free", F.max(free).over(every))
    share = F.col("first_free.left_size").cast("double") / F.col("first_free.left_weight").cast("double") * F.col("weight")
    return w.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = CYCLE, passes: int = MAX_PASSES, seed: str = SEED) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies (0..passes), taken = copies * size.

    Null text has size 0; documents of size 0 are never taken. Null sources are one source, last in order. Rows that
    repeat an id and source are queued each on its own; equal finish times are ordered by source, shuffle key, size
    and id, and of rows alike in all of these either may be the last one taken. Reruns agree, as the shuffle is a
    hash of seed and id. Empty input gives no rows.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = common.written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")), "sized")

    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = common.written(targets(per_source.select("source", "source_size"), cycle, passes), "targets")
    budget = goals.agg(F.sum("source_size")).first()[0] or 0
    total = sized.count()
    few = goals.count() <= FEW_SOURCES

    def by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
        """rows with the other columns of table, which has one row a source."""
        if few:
            table = table.withColumnRenamed("source", "__source")
            return rows.join(F.broadcast(table), rows["source"].eqNullSafe(F.col("__source")), "left").drop("__source")
        counts = sized.groupBy("source").agg(F.count("*").alias("__n")).withColumnRenamed("source", "__source")
        table = table.join(counts, table["source"].eqNullSafe(F.col("__source"))).drop("__source")
        return common.lookup(rows, table, ["source"], "__n", total).drop("__n")

    # the queue of each source: position at the end of the document within one pass
    digits = 0
    while 16**digits * 20_000 < total and digits < 6:
        digits += 1
    chunk = F.substring("key", 1, digits) if digits else F.lit("")
    rows = sized.withColumn("chunk", chunk).withColumn("src", F.coalesce("source", F.lit(""))).withColumn("no_src", F.col("source").isNull())
    flow = ["src", "no_src"]
    sums = rows.groupBy(*flow, "chunk").agg(F.sum("size").alias("in_chunk"))
    ahead = sums.withColumn("ahead", F.sum("in_chunk").over(Window.partitionBy(*flow).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_chunk"))
    within = Window.partitionBy(*flow, "chunk").orderBy("key", "size", "id").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("within", F.sum("size").over(within)).join(ahead.select(*flow, "chunk", "ahead"), [*flow, "chunk"])
    queued = queued.select("id", "source", "size", "key", (F.col("within") + F.col("ahead")).alias("queued"))
    queued = common.written(by_source(queued, goals), "queued")

    # one row a document and pass, range-sorted by virtual finish time
    def finish(p: Column) -> Column:
        return F.try_divide((p * F.col("source_size") + F.col("queued")).cast("double"), F.col("target"))

    order = ["finish", "no_src", "source", "key", "size", "id", "pass"]
    sent = queued.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    sent = sent.withColumn("finish", finish(F.col("pass"))).withColumn("no_src", F.col("source").isNull())
    sent = sent.select(*order)
    ranges = max(1, int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = sent.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    ordered = common.written(ordered, "finish_times")
    by_range = ordered.groupBy("range").agg(F.sum("size").alias("s")).orderBy("range").collect()  # one row a range
    run, cut_range = 0, None
    for r in by_range:
        if run + r.s > budget:
            cut_range = r["range"]
            break
        run += r.s
    last = None
    if cut_range is not None:
        # the one range in which the budget runs out: a partition's worth of narrow rows
        w = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        crossing = ordered.where(F.col("range") == cut_range).withColumn("run", F.sum("size").over(w) + F.lit(run)).where(F.col("run") > budget)
        last = crossing.agg(F.min(F.struct(*order)).alias("cut")).first().cut
    within_target = [finish(F.lit(p)) <= 1 for p in range(passes)]
    if last is not None:
        cut = [F.lit(last[c]).cast(ordered.schema[c].dataType) for c in order]
        within_target = [x & _before([finish(F.lit(p)), F.col("source").isNull(), F.col("source"), F.col("key"), F.col("size"), F.col("id"), F.lit(p)], cut) for p, x in enumerate(within_target)]
    copies = F.when(F.col("size") > 0, sum(x.cast("int") for x in within_target)).otherwise(0)
    queued = queued.withColumn("copies", copies)

    # what is left of targets, and the documents that may fill it: of a size, those least often taken, first in the queue
    left = queued.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
    left = common.written(left, "left")
    fits = by_source(queued.where((F.col("size") > 0) & (F.col("copies") < passes)), left).where(F.col("size") <= F.col("left"))
    nth = F.row_number().over(Window.partitionBy("source", "size").orderBy("copies", "queued"))
    fits = common.written(fits.select("source", "size", "left", "copies", "queued").withColumn("nth", nth).where(F.col("nth") <= SAME), "fits")
    below = fits.groupBy("source", "size").agg(F.max("left").alias("left"), F.count("*").alias("n"))
    picks = None
    for _ in range(FILLS):
        best = below.groupBy("source").agg(F.max(F.struct("size", "n", "left")).alias("x")).select(F.col("source").alias("__source"), F.col("x.size").alias("__size"), F.least("x.n", F.floor(F.col("x.left") / F.col("x.size"))).alias("__m"), F.col("x.left").alias("__left"))
        best = common.written(best.withColumn("__left", F.col("__left") - F.col("__m") * F.col("__size")), "best")
        picks = best if picks is None else picks.unionByName(best)
        below = below.join(best, F.col("source").eqNullSafe(F.col("__source"))).where((F.col("size") < F.col("__size")) & (F.col("size") <= F.col("__left")))
        below = below.select("source", "size", F.col("__left").alias("left"), "n")
    picks = fits.join(picks, F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")) & (F.col("nth") <= F.col("__m")))
    # a queue's positions tell rows of some size apart
    picks = picks.select("__source", F.col("queued").alias("__queued"), F.lit(1).alias("more"))
    out = queued.join(F.broadcast(picks) if few else picks, F.col("source").eqNullSafe(F.col("__source")) & (F.col("queued") == F.col("__queued")) & (F.col("size") > 0), "left")
    out = out.withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "weight", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _before(row: list[Column], cut: list[Column]) -> Column:
    """Whether a row comes before the cut in the order of its parts; nulls first, as in the sort."""
    out = F.lit(False)
    for a, b in list(zip(row, cut))[::-1]:
        less = F.coalesce(a < b, a.isNull() & b.isNotNull())
        out = less | (a.eqNullSafe(b) & out)
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """docs, all columns, each row as many times as the mix takes it.

    Ids tell documents apart here: of rows that share an id, the one taken most often decides for all.
    """
    found = mix(docs, id_col, text_col, source_col, **settings)
    times = found.groupBy(F.col(id_col).alias("__id")).agg(F.max("copies").alias("__copies")).where("__copies > 0")
    joined = docs.join(times, docs[id_col].eqNullSafe(times["__id"]))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__id", "__copies", "__copy")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), w AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::BIGINT AS left_size,
         (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS left_weight
  FROM s WINDOW b AS (ORDER BY (3 * source_size)::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, cap * left_weight <= left_size * weight AS capped FROM w
), lv AS (
  SELECT arg_max(left_size, left_weight) FILTER (WHERE NOT capped) AS ls, max(left_weight) FILTER (WHERE NOT capped) AS lw FROM f
), g AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE ls::DOUBLE / lw::DOUBLE * weight END AS target FROM f, lv
), q AS (
  SELECT d.*, g.source_size, g.target,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS queued
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), e AS (
  SELECT *, (pass * source_size + queued)::DOUBLE / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0
), o AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, key, size, doc_id, pass ROWS UNBOUNDED PRECEDING) AS run FROM e
), c AS (
  SELECT doc_id, count(*) AS copies FROM o WHERE run <= (SELECT sum(size) FROM d) AND finish <= 1 GROUP BY doc_id
), r AS (
  SELECT q.*, coalesce(c.copies, 0) AS first_copies, coalesce(q.source, '') || (q.source IS NULL) AS src
  FROM q LEFT JOIN c ON q.doc_id IS NOT DISTINCT FROM c.doc_id
), l AS (
  SELECT src, max(target) - sum(first_copies * size) AS left_over FROM r GROUP BY src
), fit AS (
  SELECT r.src, r.size, r.doc_id, l.left_over,
         row_number() OVER (PARTITION BY r.src, r.size ORDER BY r.first_copies, r.queued) AS nth
  FROM r JOIN l USING (src) WHERE r.size > 0 AND r.first_copies < 3 AND r.size <= l.left_over
), z AS (
  SELECT src, size, max(left_over) AS left0, least(count(*), 4) AS n FROM fit GROUP BY src, size
), f1 AS (
  SELECT src, size AS s1, least(n, floor(left0 / size)) AS m1, left0 - m1 * size AS left1 FROM z
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY size DESC) = 1
), f2 AS (
  SELECT src, size AS s2, least(n, floor(left1 / size)) AS m2, left1 - m2 * size AS left2 FROM z JOIN f1 USING (src)
  WHERE size < s1 AND size <= left1 QUALIFY row_number() OVER (PARTITION BY src ORDER BY size DESC) = 1
), f3 AS (
  SELECT src, size AS s3, least(n, floor(left2 / size)) AS m3, left2 - m3 * size AS left3 FROM z JOIN f2 USING (src)
  WHERE size < s2 AND size <= left2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY size DESC) = 1
), f4 AS (
  SELECT src, size AS s4, least(n, floor(left3 / size)) AS m4 FROM z JOIN f3 USING (src)
  WHERE size < s3 AND size <= left3 QUALIFY row_number() OVER (PARTITION BY src ORDER BY size DESC) = 1
), p AS (
  SELECT src, s1 AS size, m1 AS m FROM f1 UNION ALL SELECT src, s2, m2 FROM f2
  UNION ALL SELECT src, s3, m3 FROM f3 UNION ALL SELECT src, s4, m4 FROM f4
), more AS (
  SELECT doc_id FROM fit JOIN p ON p.src = fit.src AND p.size = fit.size WHERE nth <= m
), k AS (
  SELECT r.*, first_copies + (doc_id IN (SELECT doc_id FROM more))::INTEGER AS copies FROM r
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies::INTEGER AS copies FROM k
"""

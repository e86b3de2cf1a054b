"""Exact deduplication through an extendible-hash index on shared files, in DataFrame operations only.

1. A pass over the texts writes one narrow key per row: (id, 64-bit hash, SHA-256) of the normalised text.
2. The directory starts at depth 0 and is doubled while a bucket of hash prefixes is overfull; a bucket keeps its local
   depth, so only overfull ones are split. It is planned from a histogram of hash prefixes, which is taken anew with
   more bits as long as a bucket at its full depth is overfull. A bucket has room for BUCKET_ROWS distinct hashes, or
   more in a corpus where that would make over MOST_BUCKETS buckets, so the directory fits the driver at any size.
3. A hash that one row has is an entry as it is. The texts of all others (a bounded bit filter drops nearly all unique
   ones before the shuffle) go to owner tasks: each owns a range of buckets and so of keys, compares the bytes of the
   texts of a hash, and chains those that differ. Copies collapse on the way: a hot text sends a few rows to its owner.
4. The index, all entries by bucket, hash and place in the chain, is written to shared files by the owners.
5. Every row looks its entry up by bucket, hash and digest. Entries held by more than 1/HOT_SHARE of all rows are at
   most HOT_SHARE in number and are looked up in a broadcast table; all others in a shuffled join without hot keys.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import common

BUCKET_ROWS, MOST_BUCKETS = 256, 1 << 16
#: More hashes than a bucket's room that agree in so many bits don't come about by chance; their bucket stays overfull.
MOST_BITS = 26
HOT_SHARE = 1000
#: Rows of a text, at most, that reach its owner for each task that combines copies before.
SALTS = 8


def directory(histogram: dict[int, int], capacity: int, bits: int) -> tuple[int, list[int], bool]:
    """The global depth, the bucket of each directory slot in slot order, and whether bits are enough to split all.

    histogram: hashes by their first bits. A bucket that holds more than capacity is split on its next bit; where its
    local depth is the global one, the directory doubles.
    """
    depth, slots, enough = 0, [0], True
    load, local, prefix = [sum(histogram.values())], [0], [0]
    work = [0]
    at = sorted(histogram)
    sums = [0]
    for x in at:
        sums.append(sums[-1] + histogram[x])
    while work:
        b = work.pop()
        if load[b] <= capacity:
            continue
        if local[b] == bits:
            enough = False
            continue
        if local[b] == depth:
            slots = [s for s in slots for _ in (0, 1)]
            depth += 1
        local[b] += 1
        prefix[b] *= 2
        new = len(load)
        lo = (prefix[b] + 1) << (bits - local[b])
        moved = sums[bisect_left(at, lo + (1 << (bits - local[b])))] - sums[bisect_left(at, lo)]
        load[b] -= moved
        load.append(moved)
        local.append(local[b])
        prefix.append(prefix[b] + 1)
        span = 1 << (depth - local[b])
        first = prefix[new] * span
        slots[first : first + span] = [new] * span
        work += [b, new]
    order = {b: i for i, b in enumerate(dict.fromkeys(slots))}  # buckets numbered by key range
    return depth, [order[b] for b in slots], enough


def _planned(hashes: DataFrame, n: int, capacity: int) -> tuple[int, list[int]]:
    """Depth and slots of the directory over the n distinct values of h."""
    capacity = max(capacity, -(-n // MOST_BUCKETS))
    bits = max(4, (4 * n // capacity).bit_length())
    while True:
        prefix = F.shiftrightunsigned("h", 64 - bits)
        histogram = {r.p: r.n for r in hashes.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}  # about 8 cells a bucket
        depth, slots, enough = directory(histogram, capacity, bits)
        if enough or bits >= MOST_BITS:
            return depth, slots
        bits += 4


def _normalised(text_col: str) -> Column:
    return common.ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ROWS, hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 of the normalised text, bucket, chain.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id of a group stays.
    Null text counts as empty. A null id loses against any other; in a group of null ids only, all stay.
    Rows that repeat an id and a text are one document met twice: each is counted in group_size, and all of
    them are kept if their id is. Empty input gives no rows. Other columns are not read.
    bucket, chain: where the index has the text; texts of one hash have chain 0, 1, ... by their digests.
    hash_bits below 64 weakens the index hash, so that tests can force collisions.
    """
    spark = docs.sparkSession
    hashed = F.xxhash64("norm") if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64("norm"), 64 - hash_bits), 64 - hash_bits)
    texts = docs.select(F.col(id_col).alias("id"), _normalised(text_col).alias("norm")).withColumn("h", hashed)
    keys = common.written(texts.select("id", "h", F.unhex(F.sha2("norm", 256)).alias("digest")), "keys")

    hashes = common.written(keys.groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("id"), F.max("digest").alias("digest")), "hashes")
    sums = hashes.agg(F.sum("n").alias("rows"), F.count("*").alias("hashes"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    total = sums.rows or 0
    depth, slots = _planned(hashes, sums.hashes, capacity)
    slot = F.expr(f"cast(shiftrightunsigned(h, {64 - depth}) as int)") if depth else F.lit(0)
    bucket = F.get(common.constant(spark, np.array(slots, dtype=np.int32), "array<int>"), slot).alias("bucket")
    n_buckets = 1 + max(slots)
    owners = min(n_buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))

    # copies collapse in tasks first, then a range of buckets is one owner's
    repeated = hashes.where("n > 1")
    combined = texts.where(common.bloom(repeated, "h", sums.repeated)).groupBy(F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"), "h", "norm").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    owner = F.floor(F.col("bucket") * owners / n_buckets).cast("int")
    owned = combined.select(bucket, "h", "norm", "id", "n").withColumn("owner", owner).repartition(owners, "owner")
    compared = owned.groupBy("owner", "bucket", "h", "norm").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    entry = compared.select("owner", "bucket", "h", F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size")
    place = F.row_number().over(Window.partitionBy("owner", "bucket", "h").orderBy("digest")) - 1
    # unique texts that the filter let pass are entries already
    chained = entry.withColumn("chain", place).join(repeated.select("h"), "h", "left_semi")
    single = hashes.where("n = 1").select(bucket, "h", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(0).alias("chain")).withColumn("owner", owner)
    index = chained.select(*single.columns).unionByName(single).repartition(owners, "owner").sortWithinPartitions("bucket", "h", "chain")
    index = common.written(index, "index")

    most = max(1000, total // HOT_SHARE)
    names = ["bucket", "h", "digest"]
    hot = index.where(F.col("group_size") > most).select(*[F.col(c).alias(f"hot_{c}") for c in (*names, "keep_id", "group_size", "chain")])
    cold = index.where(F.col("group_size") <= most).select(*[F.col(c).alias(f"cold_{c}") for c in (*names, "keep_id", "group_size", "chain")])
    met = keys.select("id", bucket, "h", "digest")
    met = met.join(F.broadcast(hot), [F.col(c) == F.col(f"hot_{c}") for c in names], "left")
    # rows answered already take a key of their own, so that they spread; a digest of null joins nothing
    done = F.col("hot_group_size").isNotNull()
    met = met.withColumn("jh", F.when(done, F.xxhash64("id")).otherwise(F.col("h"))).withColumn("jd", F.when(~done, F.col("digest")))
    met = met.join(cold, (F.col("bucket") == F.col("cold_bucket")) & (F.col("jh") == F.col("cold_h")) & (F.col("jd") == F.col("cold_digest")), "left")
    keep = F.when(done, F.col("hot_keep_id")).otherwise(F.col("cold_keep_id"))
    return met.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("hot_group_size", "cold_group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "bucket",
        F.coalesce("hot_chain", "cold_chain").alias("chain"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that exact_dedup drops; rows that repeat a kept id and its text all stay.

    Rows of ids that no dropped row has (a bounded filter tells most of them) are not shuffled.
    """
    found = exact_dedup(docs, id_col, text_col).where(~F.col("kept"))
    gone = common.written(found.select(F.col(id_col).alias("__gone"), F.col("text_sha256").alias("__gone_sha")).distinct(), "gone")
    maybe = common.bloom(gone.select(F.xxhash64("__gone").alias("__h")), "__h", gone.count())
    docs = docs.withColumn("__h", F.xxhash64(id_col))
    rest = docs.where(maybe).withColumn("__sha", F.sha2(_normalised(text_col), 256))
    rest = rest.join(gone, F.col(id_col).eqNullSafe(F.col("__gone")) & (F.col("__sha") == F.col("__gone_sha")), "left_anti")
    return docs.where(~maybe).unionByName(rest.drop("__sha")).drop("__h")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

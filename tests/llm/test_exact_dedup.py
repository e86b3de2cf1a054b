import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm import common, exact_dedup
from tests.llm.help import AWKWARD, awkward, lower


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df, **settings):
    return sorted(map(tuple, exact_dedup.exact_dedup(df, **settings).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_against_plain_python(spark, bits):
    rng = random.Random(bits)
    rows = [(i, rng.choice(["a", "A", "b", "É", "é", "x" * 500, None, ""]) if rng.random() < 0.6 else f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, hash_bits=bits, capacity=5) == expected(rows)


def test_hot_group(spark, monkeypatch):
    rows = [(i, "Hot" if i % 3 else f"t{i}") for i in range(4000)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_awkward_rows(spark):
    assert got(awkward(spark)) == expected([r[:2] for r in AWKWARD])
    assert got(awkward(spark).limit(0)) == []
    left = exact_dedup.drop_copies(awkward(spark))
    assert left.columns == awkward(spark).columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([2, 4, 5, 6, 6, 7, None], key=repr)


def test_directory_doubles_only_where_needed():
    depth, slots, enough = exact_dedup.directory({0: 10, 1: 10, 15: 1}, 10, 4)
    assert enough
    assert depth == 4 and len(slots) == 16 and slots[0] != slots[1] and len(set(slots[8:])) == 1
    assert slots == sorted(slots)
    assert exact_dedup.directory({}, 10, 4) == (0, [0], True)
    depth, _, enough = exact_dedup.directory({3: 99}, 10, 2)
    assert depth == 2 and not enough  # more bits are needed


def test_index_of_the_query_has_buckets_of_bounded_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = exact_dedup.exact_dedup(docs).select("bucket", "chain", "text_sha256").distinct().collect()
    sizes = collections.Counter(r.bucket for r in rows)
    assert len(sizes) > 3 and max(sizes.values()) <= exact_dedup.BUCKET_ROWS and all(r.chain == 0 for r in rows)


def test_collisions_are_chained(spark):
    df = spark.createDataFrame([(i, f"t{i % 40}") for i in range(120)], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(df, hash_bits=2, capacity=1).select("bucket", "chain", "text_sha256").distinct().collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r.bucket].append(r.chain)
    assert len(rows) == 40 and all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 4


def test_lookup_and_bloom(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 50}") for i in range(3000)] + [(-1, None)], "v long, k string")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    out = common.lookup(rows, table, ["k"], "n", rows.count())
    assert out.count() == rows.count() and out.join(rows.groupBy("k").agg(F.min("v").alias("m")), "k").where("low <> m").count() == 0
    keys = spark.range(1000).select(F.xxhash64("id").alias("h"))
    others = spark.range(10_000, 20_000).select(F.xxhash64("id").alias("h"))
    passes = common.bloom(keys, "h", 1000)
    assert keys.where(passes).count() == 1000 and others.where(passes).count() < 2000
    assert others.where(common.bloom(keys.limit(0), "h", 0)).count() == 0

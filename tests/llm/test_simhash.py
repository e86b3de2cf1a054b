import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from strandlake.llm import simhash
from tests.llm.help import awkward, lower


def fingerprint(text):
    words = re.split(r"[\x20\x09-\x0d]+", lower(text))
    votes, total = [0] * 64, 0
    for i, w in enumerate(words):
        h = 42
        for k in range(5):
            if i - k >= 0:
                h = xxhash.xxh64_intdigest(words[i - k].encode(), seed=h)
        weight = min(len(w), 16)
        total += weight
        for j in range(64):
            votes[j] += weight * (h >> j & 1)
    x = sum(1 << j for j in range(64) if votes[j] * 2 > total)
    return x - (1 << 64) if x >> 63 else x


def check(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash.fingerprint_documents(df, **settings).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint").collect()), key=repr)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expected = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        e = t[: len(t) - third] + after[:third]
        expected.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e)))
    assert got == sorted(expected, key=repr)


def test_against_plain_python(spark):
    rng = random.Random(1)
    vocabulary = ["a", "Be", "sea", "déjà", "x" * 30, "1,2", "€"]
    rows = [(rng.randrange(-(10**12), 10**12), " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for _ in range(60)]
    check(spark, rows, bucket_rows=7)
    check(spark, rows, bucket_rows=1000)


def test_awkward_rows(spark):
    check(spark, [(1, None), (2, ""), (None, "a b c"), (3, "x"), (3, "x"), (3, "y z w"), (9, "é" * 10 + " b"), (-(1 << 63), "low"), ((1 << 63) - 1, "high")], bucket_rows=2)
    check(spark, [(5, "alone here")])
    assert simhash.fingerprint_documents(awkward(spark).limit(0)).count() == 0
    assert simhash.fingerprint_documents(awkward(spark)).count() == awkward(spark).count()


def test_one_far_id_does_not_gather_the_others(spark):
    rows = [(i, "a b") for i in range(5000)] + [(1 << 62, "far"), (-(1 << 62), "low"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in simhash.with_next(df, bucket_rows=500).groupBy("bucket").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 502 + 4


def test_likeness(spark):
    rows = [(i, " ".join(f"w{(i * 977 + j * 31) % 10007}" for j in range(200))) for i in range(40)]
    got = simhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.min("near_edited").alias("e"), F.avg("near_edited").alias("a"), F.avg("near_next").alias("n")).first()
    assert 0.5 < got.a < 0.85 and got.n < 0.25 and got.e > 0.2


def test_near_fingerprints_finds_all(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    held = base + [b ^ sum(1 << j for j in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(6)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in held + held[:10]] + [(None,)], "fingerprint long")
    for radius, blocks in ((3, 5), (1, 4), (0, 2)):
        got = sorted(map(tuple, simhash.near_fingerprints(df, df, radius, blocks).collect()))
        xs = sorted(set(held))
        assert got == sorted((signed(a), signed(b), (a ^ b).bit_count()) for a in xs for b in xs if (a ^ b).bit_count() <= radius)
    counted = simhash.with_near(df.where("fingerprint IS NOT NULL"), F.lit(True))
    near = {signed(a): sum(0 < (a ^ b).bit_count() <= 3 for b in set(held)) for a in set(held)}
    assert all(r.near_found == near[r.fingerprint] for r in counted.collect()) and counted.count() == len(held) + 10


def test_scan_finds_all(spark, monkeypatch):
    rng = random.Random(3)
    held = {rng.getrandbits(64) - (1 << 63) for _ in range(400)} | {0, -1}
    df = spark.createDataFrame([(x,) for x in held] + [(0,), (None,)], "fingerprint long")
    for tile in (50, 1000):
        monkeypatch.setattr(simhash, "TILE_QUERIES", tile)
        got = sorted(map(tuple, simhash.near_by_scan(df, df, 22).collect()))
        assert got == sorted((a, b, d) for a in held for b in held if (d := ((a ^ b) & ((1 << 64) - 1)).bit_count()) <= 22)


def test_query_finds_near_copies(spark, tmp_path):
    rng = random.Random(4)
    rows, partner, shingles = [], {}, lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for i in range(0, 800, 20):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for at in rng.sample(range(20, 280), 5):
            other[at] = "changed"
        a, b = shingles(words), shingles(other)
        assert len(a & b) / len(a | b) >= 0.8
        rows += [(i, " ".join(words)), (i + 1, " ".join(other)), (i + 2, " ".join(words))]
        partner[i] = f"{fingerprint(' '.join(other)) & ((1 << 64) - 1):016x}"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in simhash.op3_simhash(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(got[i].near is None and got[i].near_copies is None for i in got if i % 20)
    for i, mark in partner.items():
        assert got[i].near_found == len(got[i].near) and got[i].near_copies == 1 + (mark == got[i].fingerprint)
    assert sum(mark in (got[i].fingerprint, *got[i].near) for i, mark in partner.items()) >= 0.95 * len(partner)


def made(df):
    """The largest number of rows that a join of a plan has made."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_links_in_large_groups_are_not_expanded(spark, monkeypatch):
    rng = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flip = lambda x, most: x ^ sum(1 << j for j in rng.sample(range(64), rng.randint(0, most)))
    one, two, wide = (rng.getrandbits(64) for _ in range(3))
    # a group, one that overlaps it, one too wide for one class, and others
    held = [flip(one, 8) for _ in range(500)] + [flip(flip(one, 16), 8) for _ in range(100)] + [flip(two, 3) for _ in range(200)]
    held += [flip(wide, 20) for _ in range(200)] + [rng.getrandbits(64) for _ in range(300)]
    rows = [(i, signed(x)) for i, x in enumerate(held + held[:50])]
    df = spark.createDataFrame([*rows, (-1, None)], "doc_id long, fingerprint long").where("doc_id >= 0")
    distinct = sorted({signed(x) for x in held})
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    for radius, tile, chunk in ((16, 1_000_000, 512), (16, 30, 64), (3, 1_000_000, 512)):
        monkeypatch.setattr(simhash, "TILE_QUERIES", tile)
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = simhash.with_near(df, F.col("doc_id") % 4 == 0, radius).collect()
        assert len(got) == len(rows)
        members = {}
        for r in got:
            if r.near_class is not None:
                members.setdefault(r.near_class, set()).add(r.fingerprint)
                assert apart(r.near_class, r.fingerprint) <= radius
        assert members
        for r in got:
            if r.doc_id % 4:
                assert r.near is None and r.near_classes is None and r.near_found is None
                continue
            links = [x for x in distinct if x != r.fingerprint and apart(x, r.fingerprint) <= radius]
            told = r.near + [x for c in r.near_classes for x in members[c] if x != r.fingerprint and apart(x, r.fingerprint) <= radius]
            assert sorted(told) == links and r.near_found == len(links)
            assert r.near_copies == sum(x == r.fingerprint for _, x in rows) - 1


def test_rows_made_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    rng = random.Random(6)
    base = rng.getrandbits(64) >> 1
    rows = [(i, base ^ sum(1 << j for j in rng.sample(range(62), 6))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    counts, scan = [], simhash.near_by_scan

    def counted(*args):
        pairs = scan(*args)
        pairs.collect()
        counts.append(made(pairs))
        return pairs

    monkeypatch.setattr(simhash, "near_by_scan", counted)
    got = simhash.with_near(df, F.col("doc_id") % 20 == 0, simhash.NEAR_RADIUS).where("doc_id % 20 = 0").collect()
    # some 190,000 links
    assert sum(r.near_found for r in got) > 100_000 and counts[0] <= 2 * len(rows)

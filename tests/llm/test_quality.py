import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import quality
from tests.llm.help import SCHEMA, awkward

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs.where("doc_id % 2 = 0"), labels)
    got = quality.scored(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id")
    r = got.agg(F.avg(F.when(F.col("quality") == 1, F.col("quality_scores.kept").cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("quality_scores.kept").cast("int"))).alias("bad")).first()
    assert r.good >= 0.98 and r.bad <= 0.1


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (99, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None  # too few labels: nothing is rejected
    assert quality.keep_good(docs, labels).count() == docs.count()
    rng = random.Random(1)
    taught = [(100 + i, " ".join("ab" if i % 2 else "AB!!" for _ in range(rng.randint(5, 50))), "en", "s", 9) for i in range(80)]
    model = quality.fit(spark.createDataFrame(taught, SCHEMA), spark.createDataFrame([(100 + i, i % 2) for i in range(80)], "doc_id long, quality int"))
    out = quality.scored(docs, model)
    assert out.count() == docs.count() and out.where("quality_scores.score IS NULL OR quality_scores.score < 0 OR quality_scores.score > 1").count() == 0
    assert quality.keep_good(docs.limit(0), labels).columns == docs.columns
    # copies score alike, and reruns agree
    again = quality.fit(spark.createDataFrame(taught, SCHEMA).repartition(3), spark.createDataFrame([(100 + i, i % 2) for i in range(80)], "doc_id long, quality int"))
    assert (again.content_w == model.content_w).all() and again.threshold == model.threshold


def test_long_texts_are_scored_whole():
    text = "ab cd. " * 400_000
    whole = quality.content(text)
    assert abs(whole[: quality.GRAMS].sum() - quality.SCALE) < 0.01


def test_all_unlabelled_documents_teach(spark):
    """A rare kind of document, which only its metadata gives away, changes how its words are judged, wherever the ids fall."""
    rng = random.Random(2)

    def text(words):
        return " ".join(rng.choices(words, k=40))

    good, bad, rare = ["mild", "kind", "calm"], ["GRAB!!", "BUY$$", "WIN##"], ["qzx", "zxq", "xqz"]
    taught = [(i, text(good if i % 2 else bad), "en", "fine" if i % 2 else "junk", 5000 if i % 4 == 0 else 9) for i in range(400)]
    plain = [(1000 + i, text(good if i % 2 else bad), "en", "fine" if i % 2 else "junk", 9) for i in range(4000)]
    odd = [(10_000 + i, text(rare), "de", "junk", 5000) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    # none of the odd ones is in a sample of 2,000 by hash, nor a labelled one
    dice = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11).cast("double") / F.lit(float(1 << 53))
    odd = spark.createDataFrame(odd, SCHEMA).where(dice > 0.5)
    base = spark.createDataFrame(taught + plain, SCHEMA)
    asked = spark.createDataFrame([(1, text(rare), "fr", "new", 9)], SCHEMA)
    without, taught_all = (quality.scored(asked, quality.fit(d, labels)).first().quality_scores.p_content for d in (base, base.unionByName(odd)))
    assert taught_all < without - 0.05


def test_unlabelled_documents(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i % 50}", "en", "s", 9) for i in range(60)] + [(None, "none", "en", "s", 9)], SCHEMA)
    labelled = spark.createDataFrame([(i,) for i in range(0, 50, 2)] * 2, "doc_id long")
    others = quality.Unlabelled(docs, labelled)
    assert others.n == 25 + 1
    for at, value in (quality._unpacked(bytes(r.body)) for r in others.rows.collect()):
        assert any((abs(quality.content(f"text {i}")[at] - value) < 1e-9).all() for i in range(50)) or (abs(quality.content("none")[at] - value) < 1e-9).all()
    # verdicts do not depend on how rows are dealt
    rng = np.random.default_rng(1)
    models = ((rng.normal(0, 5, quality.CONTENT), 0.0), (rng.normal(0, 5, quality.META), 0.0))
    again = quality.Unlabelled(docs.repartition(5), labelled)
    a, b = others.verdicts(models, 1.0, 0.5), again.verdicts(models, 1.0, 0.5)
    assert sum(n for view in a for _, n, _ in view) > 0
    for one, two in zip(a, b):
        assert [x[:2] for x in one] == [x[:2] for x in two] and all((x[2] == y[2]).all() for x, y in zip(one, two))


def test_long_texts_count_every_gram_once(monkeypatch):
    text = "Ab, c9! " * 400 + "x"
    whole = quality.content(text)
    monkeypatch.setattr(quality, "WINDOW", 7)
    assert (quality.content(text) == whole).all()
    three, five = (np.concatenate(x) for x in zip(*quality._slots_by_window(text)))
    assert len(three) == len(text) - 2 and len(five) == len(text) - 4


def test_one_exchange_against_plain_python(spark):
    """Which documents each view is confident of, and the means that teach the other."""
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice(["ab", "cd", "EF!", "9"], 12)), ["en", "de", None][i % 3], f"s{i % 5}", int(rng.integers(1, 9000))) for i in range(300)]
    df = spark.createDataFrame(docs, SCHEMA)
    others = quality.Unlabelled(df, spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long"))
    models = ((rng.normal(0, 1, quality.CONTENT), 0.3), (rng.normal(0, 3, quality.META), -0.2))
    part, share = 0.2, 0.7
    got = others.verdicts(models, part, share)
    free = [d for d in docs if d[0] % 3]
    assert others.n == len(free)
    for view in (0, 1):  # the verdicts of a view teach the other one
        x = np.stack([quality.content(d[1]) for d in free])
        m = np.zeros((len(free), quality.META))
        for row, d in zip(m, free):
            row[quality.metadata(d[3], d[2], d[4])] = 1
        z = x @ models[0][0] + models[0][1] if view == 0 else m @ models[1][0] + models[1][1]
        bins = np.array([quality._bin(v) for v in z])
        expected = []
        for label, wanted in ((0, part * len(free) * (1 - share)), (1, part * len(free) * share)):
            order = np.sort(bins) if label == 0 else np.sort(bins)[::-1]
            edge = order[min(int(np.ceil(wanted)), len(order)) - 1]
            sure = (z < -np.log(9)) & (bins <= edge) if label == 0 else (z > np.log(9) + np.log(share / (1 - share))) & (bins >= edge)
            kinds = np.array([quality.zlib.crc32(f"{d[3]} {d[2]}".encode()) % quality.KINDS_APART for d in free])
            for kind in sorted(set(kinds[sure])):
                at = sure & (kinds == kind)
                expected.append((float(label), at.sum() * min(1.0, wanted / sure.sum()), (m if view == 0 else x)[at].mean(axis=0)))
        assert len(expected) == len(got[1 - view]) and expected
        for (a, n, mean), (b, k, other) in zip(expected, got[1 - view]):
            assert a == b and abs(n - k) < 1e-9


def test_clashing_columns_and_ties(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("ab" if i % 2 else "AB!!" for _ in range(rng.randint(5, 50))), "en", "s", 9) for i in range(80)]
    # ids that come twice, with different texts, and labels that contradict each other
    rows += [(i, "ab ab ab", "en", "s", 9) for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("quality_scores", "key", "y", "h", "meta", "kept")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, 0)], "doc_id long, quality int")
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns and {r.quality_scores for r in out.collect()} == {"mine"}
    a, b = (quality.fit(docs.repartition(n), labels) for n in (1, 5))
    assert (a.content_w == b.content_w).all() and a.threshold == b.threshold

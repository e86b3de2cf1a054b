import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import language_spans
from tests.llm.help import awkward

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_spans.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok"), F.count("*").alias("n")).first()
    assert r.ok >= 0.98 and r.n > 100
    flags = {x.doc_id: x.held_out for x in got.collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in flags)


def model(switch=3.0):
    out = language_spans.SpanModel(["a", "b", "c"], np.zeros((2, language_spans.SLOTS, 3)), np.ones((len(language_spans.SCRIPTS) + 1, 3)), switch)
    return out


def test_viterbi_is_the_best_path():
    m, rng = model(), np.random.default_rng(3)
    for n in (1, 2, 5, 7):
        for _ in range(30):
            w = rng.normal(0, 3, (n, 3))
            value = lambda p: sum(w[t, x] for t, x in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:]))
            best = max(value(p) for p in itertools.product(range(3), repeat=n))
            assert abs(value(m.path(w)) - best) < 1e-9


def test_spans_of_mixed_text_and_scripts(spark):
    english, german, greek = "the quick house of that and this with from " * 30, "und nicht das schöne haus mit der straße für " * 30, "το σπίτι και ο δρόμος " * 30
    docs = spark.createDataFrame([(i, t, x, None, None) for i, (t, x) in enumerate([(english, "en"), (german, "de"), (greek, "el")] * 8)], "doc_id long, text string, lang string, source string, n_chars long")
    fitted = language_spans.fit(docs)
    mixed = english[:200] + german[:300] + greek[:100]
    got = fitted.spans([mixed])[0]
    assert [x for _, _, x in got] == ["en", "de", "el"]
    assert abs(got[0][1] - 200) < 15 and abs(got[1][1] - 500) < 15 and got[2][1] <= len(mixed)
    assert fitted.predict([mixed])[0][0] == "de"
    out = language_spans.label_spans(docs.limit(1), fitted).first()
    assert out.spans[0].start == 0 and out.spans[0].lang in ("en", "de", "el")
    # a window's border doesn't change anything
    old, language_spans.WINDOW = language_spans.WINDOW, 500
    try:
        assert [x for _, _, x in fitted.spans([english * 3])[0]] == ["en"]
    finally:
        language_spans.WINDOW = old


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = language_spans.identify(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (3, 4, 5))
    assert by[7].lang_pred != "und" and by[None].held_out == (zlib.crc32(b"") % 5 == 0)
    assert language_spans.identify(docs.limit(0)).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_spans.identify(none).collect()} == {"und"}


def test_long_words_are_not_cut(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the quick house of that " * 30, "en"), ("und nicht das haus mit der " * 30, "de")] * 8)], "doc_id long, text string, lang string")
    fitted = language_spans.fit(docs)
    texts = ["thequickhouseofthat" * 100, "a," * 700, "undnichtdas" * 90 + "-" + "thatquickhouse" * 90, "the house " * 200 + "x" * 3000, "x1" * 2000]
    whole = [fitted.words([t])[0] for t in texts]
    spans = fitted.spans(texts)
    monkeypatch.setattr(language_spans, "WINDOW", 300)
    assert all("".join(x for _, x in language_spans.windows(t)) == t for t in texts)
    assert fitted.spans(texts) == spans
    for t, (starts, _, w) in zip(texts, whole):
        parts = [(at, fitted.words([x])[0]) for at, x in language_spans.windows(t)]
        assert np.concatenate([s + at for at, (s, _, _) in parts]).tolist() == starts.tolist()
        assert np.allclose(np.concatenate([x for _, (_, _, x) in parts]), w, atol=1e-3)


def test_scripts_narrow_the_candidates(spark):
    english, greek = "the quick house of that and this " * 40, "το σπίτι και ο δρόμος " * 40
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([(english, "en"), (greek, "el")] * 8)], "doc_id long, text string, lang string")
    fitted = language_spans.fit(docs)
    # one word of the other script is a span of its own, whatever its letters score
    assert [x for _, _, x in fitted.spans(["the quick house ζζζζ of that and this"])[0]] == ["en", "el", "en"]
    assert [x for _, _, x in fitted.spans(["the quick שלום house"])[0]] == ["en"]  # a script that was never seen says nothing


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(i, "the house of that", "en", "x", 1.0, True, "y") for i in range(6)], "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean, key string")
    assert language_spans.identify(docs).columns == ["doc_id", "held_out", "lang_pred", "score", "n_spans"]
    assert {r.lang_pred for r in language_spans.identify(docs).collect()} == {"en"}

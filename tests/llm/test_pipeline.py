import collections
import hashlib

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from strandlake.llm import common, piece_codec, quality, queries
from tests.llm import test_ngram_join, test_source_mix
from tests.llm.help import awkward, lower

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, None
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = common.written(stage(spark, docs, SF), name)
        after = [tuple(r) for r in docs.collect()]
        out[name] = docs
        if name != "encode":
            assert docs.columns == columns and set(after) <= set(before)
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            model = quality.fit(spark.createDataFrame(before, docs.schema), labels)
            assert sorted(r[0] for r in after) == sorted(r[0] for r in before if model is None or model.score(r[1] or "", r[3], r[2], r[4])[0] >= model.threshold)
            bad = {r.doc_id for r in labels.where("quality = 0").collect()}
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            left = {r[0] for r in after}
            assert len(good & left) >= 0.97 * len(good) and len(bad & left) <= 0.3 * len(bad)
        if name == "exact_dedup":
            last = {}
            for r in before:
                last[lower(r[1])] = max(last.get(lower(r[1]), r[0]), r[0])
            assert sorted(r[0] for r in after) == sorted(last.values())
        if name == "near_dedup":
            groups = test_ngram_join.plain([(r[0], r[1]) for r in before], 5, 80, 100)
            assert sorted(r[0] for r in after) == sorted(i for i, _, c in groups if i == c)
        if name == "mix":
            mix = test_source_mix.plain([(r[0], r[1], r[3]) for r in before])
            times = collections.Counter(r[0] for r in after)
            assert all(times[i] * size == taken for i, (size, _, _, taken) in mix.items())
            kept = collections.Counter((r[0], r[1]) for r in after)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.tokenizer_path())
    rows = out["encode"].collect()
    assert len(rows) == sum(kept.values())
    text = dict(kept.keys())
    for r in rows:
        ids = library.encode(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), awkward(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, SF), name)
        docs.count()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, sql = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(sql.columns)
    rows = lambda f: sorted(map(repr, f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(sql)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_queries_give_a_row_a_row(spark, name):
    table = "pages" if name.startswith(("op4_", "op9_")) else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()

import base64
import gzip
import hashlib

from strandlake.llm import warc_index

ROWS = [
    (1, None, None), (2, "", "a"), (None, "http://A.com/x", "a"), (3, "http://A.com/x", "a"), (3, "http://A.com/x", "a"), (4, "http://A.com/x?q=1 é#f", "b\r\n\r\nc"),
    (None, "u", "zz"), (-5, "http://A.com/x", ""), (7, "http://ä.de/\t%\n", "€" * 1000), (8, "http://user@B.com:80", "€" * 1000),
]
SCHEMA = "page_id long, url string, html string"


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw, r = (h or "").encode(), first.get(h or "")
        revisit = r is not None and i != r
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", r if revisit else None))
    return sorted(out, key=repr)


def read(df, index):
    return sorted(map(tuple, warc_index.read_back(df, index).drop("target").collect()), key=repr)


def test_round_trip_of_awkward_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for lines in (1, 3, 256):
        assert read(df, warc_index.archive(df, block_lines=lines)) == expected(ROWS)
    empty = df.limit(0)
    assert read(empty, warc_index.archive(empty)) == []


def test_many_pages_and_lookups(spark):
    rows = [(i, f"http://h{i % 7}.example.org/p/{i % 90}", f"body {i % 120}" * 5) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    index = warc_index.archive(df, block_lines=8)
    assert read(df, index) == expected(rows)
    found = index.captures("https://H3.example.org/p/3#x")
    ids = sorted(warc_index._page_number(index.read(*f)[0]["warc-record-id"]) for f in found)
    assert ids == [i for i, u, _ in rows if u == "http://h3.example.org/p/3"]
    assert index.captures("http://h3.example.org/p/") == [] and index.captures("http://zzz.org/") == []


def test_least_payload(spark):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long one"), (4, "d", "long one")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r.record_type for r in warc_index.read_back(df, warc_index.archive(df, least_payload=5)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_records_are_plain_gzip_members(spark, tmp_path):
    df = spark.createDataFrame(ROWS[2:6], SCHEMA).coalesce(1)
    warc_index.archive(df, f"file://{tmp_path}/w")
    files = list((tmp_path / "w" / "archives").glob("*.warc.gz"))
    assert len(files) == 1 and not list((tmp_path / "w" / "archives").glob(".*"))
    text = gzip.open(files[0]).read()
    assert text.count(b"WARC/1.1\r\n") == 4 and text.count(b"WARC-Type: response") == 3  # both rows of the smallest id, and the other text


def test_long_payloads_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://a.com/" + "x" * 50_000, "é\r\n\r\n" * 400_000), (2, "http://b.com", "é\r\n\r\n" * 400_000), (3, "http://b.com", "y")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("id", "payload", "digest", "h", "key", "file", "offset", "n", "first_id")})
    assert read(df, warc_index.archive(df)) == expected(rows)


def test_keys():
    assert warc_index.reversed_key("HTTP://User@WWW.Example.com:80/A?b#c") == "com,example,www:80)/A?b"
    assert warc_index.reversed_key(None) == ")/" and warc_index.reversed_key("x") == "x)/"

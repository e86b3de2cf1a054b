"""WARC archives with a two-level capture index.

Writing: one record a page. Of pages with equal payloads the one with the smallest id is the response; the others are
revisit records that name it and carry no payload. Tasks write their records, each a gzip member, to a file of their own
in the shared folder: one a task attempt, renamed when complete, and named in the index by the attempt that counted. So
tasks may be lost, run again or run twice.

Index: every record has a line "key, page id, file, offset, length", where the key is the URL with its host labels
reversed (com,example)/path. Lines are range-sorted by key; each range becomes one shard of compressed blocks of
BLOCK_LINES lines, and a sparse directory with the first key, offset and length of every block. Over the shards there
is a list of their first keys, one entry a shard.

Reading: keys are looked up by binary search in the list of shards, then in the shard's directory, then in the one
block that is read by its range and unpacked; the record follows by a read of its range in the archive.

Files are reached through pyarrow's file systems, so the shared folder may be in any store that these open.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import posixpath
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common

BLOCK_LINES = 256
#: Unpacked blocks and directories that a task keeps at hand.
KEPT = 64
DATE = "2024-01-01T00:00:00Z"
LEAST_PAYLOAD = 0


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def reversed_key(url: str | None) -> str:
    """com,example)/path?query of a URL: scheme dropped, host lower-cased and its labels reversed, fragment dropped."""
    rest = (url or "").partition("://")[2] if "://" in (url or "") else (url or "")
    rest = rest.partition("#")[0]
    cut = min([k for k in (rest.find("/"), rest.find("?")) if k >= 0], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    name, _, port = host.rpartition("@")[2].partition(":")
    key = ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (path or "/")
    return "".join(f"%{ord(c):02X}" if c < " " or c == "%" else c for c in key)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of the record of refers_to without the payload."""
    revisit = refers_to is not None
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        head.append(f"WARC-Block-Digest: sha1:{payload_digest(block)}")
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (names in lower case) and payload of a record."""

    def fields(part: bytes) -> dict[str, str]:
        lines = part.decode("utf-8").split("\r\n")[1:]
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]) or not head.startswith(b"WARC/"):
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def gzipped(raw: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _page_number(text: str) -> int | None:
    inner = text.strip("<>").rpartition(":")[2]
    return None if inner == "none" else int(inner)


def _attempt() -> str:
    """Names the task and its attempt: what an attempt that was lost or overtaken wrote is in no line and disturbs no other."""
    task = TaskContext.get()
    return f"{task.partitionId():05d}-{task.taskAttemptId()}"


class AtomicFile:
    """A file that appears under its name when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(folder)
        self.path, self.part = posixpath.join(base, name), posixpath.join(base, f".{name}.{uuid.uuid4().hex}")
        self.fs.create_dir(base, recursive=True)
        self.out, self.size = self.fs.open_output_stream(self.part), 0

    def write(self, raw: bytes) -> int:
        at = self.size
        self.out.write(raw)
        self.size += len(raw)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Writes the records and returns the lines of the index: key, page_id, file, offset, length.

    Null payloads are empty, null URLs have an empty target. Payloads shorter than least_payload are all responses. A
    null id is only the response of a payload that no other page has; repeated rows of the smallest id are all responses.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # from digests only; then just the payloads that may occur more than once meet their first page in a join
    sums = rows.select("id", "digest").groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    sums = common.written(sums.withColumn("h", F.xxhash64("digest")), "payloads")
    rows = rows.withColumn("h", F.xxhash64("digest"))
    maybe = common.bloom(sums, "h", sums.count())
    alone = rows.where(~maybe).withColumn("first_id", F.lit(None).cast("long"))
    rows = alone.unionByName(common.lookup(rows.where(maybe), sums.drop("h"), ["digest"], "n", pages.count()).drop("n"))
    refers = F.when((F.octet_length("payload") >= least_payload) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = rows.select("id", "url", "payload", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name = None, ""
        for b in batches:
            lines = []
            if out is None and b.num_rows:
                name = f"part-{_attempt()}.warc.gz"
                out = AtomicFile(folder, name)
            for i, url, payload, refers_to in zip(*(b.column(c) for c in ("id", "url", "payload", "refers_to"))):
                page_id, url = i.as_py(), url.as_py()
                raw = gzipped(record(page_id, url, payload.as_buffer().to_pybytes(), refers_to.as_py()))
                lines.append((reversed_key(url), page_id, name, out.write(raw), len(raw)))
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*lines), LINE.types)], schema=LINE)
        if out is not None:
            out.close()

    return common.written(rows.mapInArrow(write, "key string, page_id long, file string, offset long, length long"), "lines")


LINE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _sort_key(key: str, page_id: int | None) -> bytes:
    """Bytes that sort as (key by code points, page id, null first)."""
    return key.encode() + b"\t" + (b"" if page_id is None else b"%020d" % (page_id + (1 << 63)))


def write_index(lines: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[bytes, str]]:
    """Writes the shards, and returns the list over them: (first sort key, shard), one entry a shard."""
    n = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = lines.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, directory, waiting, first, name = None, [], [], None, ""

        def flush():
            raw = zlib.compress(b"\n".join(waiting), 6)
            directory.append((waiting[0].rsplit(b"\t", 3)[0], blocks.write(raw), len(raw)))
            waiting.clear()

        for f in frames:
            for key, page_id, file, offset, length in zip(f["key"], f["page_id"], f["file"], f["offset"], f["length"]):
                line = _sort_key(key, None if pd.isna(page_id) else int(page_id)) + f"\t{file}\t{offset}\t{length}".encode()
                if blocks is None:
                    name = f"shard-{_attempt()}"
                    first = line.rsplit(b"\t", 3)[0]
                    blocks = AtomicFile(folder, f"{name}.blocks")
                waiting.append(line)
                if len(waiting) >= block_lines:
                    flush()
        if blocks is not None:
            if waiting:
                flush()
            blocks.close()
            sparse = AtomicFile(folder, f"{name}.directory")
            sparse.write(zlib.compress(b"\n".join(b"%b\t%d\t%d" % d for d in directory)))
            sparse.close()
            yield pd.DataFrame({"first": [first], "shard": [name]})

    made = common.written(ordered.mapInPandas(write, "first binary, shard string"), "shards")
    return sorted((bytes(r["first"]), r["shard"]) for r in made.collect())  # one row a shard


class CaptureIndex:
    """Lookups and reads, from any process that reaches the folders."""

    def __init__(self, archives: str, index: str, shards: list[tuple[bytes, str]]):
        self.archives, self.index, self.shards = archives, index, shards
        self._open()

    def _open(self) -> None:
        self.cache: OrderedDict = OrderedDict()
        self.files: OrderedDict = OrderedDict()

    def __getstate__(self):
        return {"archives": self.archives, "index": self.index, "shards": self.shards}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def read_range(self, folder: str, name: str, offset: int, length: int) -> bytes:
        if (folder, name) not in self.files:
            system, base = filesystem(folder)
            if len(self.files) >= KEPT:
                self.files.popitem(last=False)[1].close()
            self.files[folder, name] = system.open_input_file(posixpath.join(base, name))
        return self.files[folder, name].read_at(length, offset)

    def _kept(self, key, make):
        if key not in self.cache:
            if len(self.cache) >= KEPT:
                self.cache.popitem(last=False)
            self.cache[key] = make()
        self.cache.move_to_end(key)
        return self.cache[key]

    def directory(self, shard: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        def read():
            system, base = filesystem(self.index)
            with system.open_input_stream(posixpath.join(base, f"{shard}.directory")) as f:
                rows = [x.rsplit(b"\t", 2) for x in zlib.decompress(f.read()).split(b"\n")]
            return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

        return self._kept(("directory", shard), read)

    def block(self, shard: str, k: int) -> list[tuple[bytes, str, int, int]]:
        def read():
            raw = zlib.decompress(self.read_range(self.index, f"{shard}.blocks", *self.directory(shard)[1][k]))
            out = []
            for line in raw.split(b"\n"):
                key, file, offset, length = line.rsplit(b"\t", 3)
                out.append((key, file.decode(), int(offset), int(length)))
            return out

        return self._kept(("block", shard, k), read)

    def _from(self, key: bytes) -> Iterator[tuple[bytes, str, int, int]]:
        """Lines from the first that is not below the key."""
        s = max(bisect.bisect_left(self.shards, (key, "")) - 1, 0)
        for n in range(s, len(self.shards)):
            shard = self.shards[n][1]
            firsts = self.directory(shard)[0]
            k = max(bisect.bisect_left(firsts, key) - 1, 0) if n == s else 0
            for m in range(k, len(firsts)):
                lines = self.block(shard, m)
                at = bisect.bisect_left(lines, (key,))
                yield from lines[at:]

    def captures(self, url: str | None, page_id: int | None = None, every: bool = True) -> list[tuple[str, int, int]]:
        """(file, offset, length) of the captures of a URL; with every=False those of one page id, null included."""
        base = reversed_key(url).encode() + b"\t"
        key = base if every else _sort_key(reversed_key(url), page_id)
        out = []
        for line in self._from(key):
            if not (line[0].startswith(base) if every else line[0] == key):
                break
            out.append(line[1:])
        return out

    def read(self, file: str, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
        return parse(zlib.decompress(self.read_range(self.archives, file, offset, length), 31))


def archive(pages: DataFrame, folder: str | None = None, block_lines: int = BLOCK_LINES, **columns) -> CaptureIndex:
    """Writes the archives and the index of pages to a folder all executors share, and returns the index."""
    folder = folder or common.fresh_path(pages.sparkSession, "warc")
    lines = write_archives(pages, f"{folder}/archives", **columns)
    return CaptureIndex(f"{folder}/archives", f"{folder}/index", write_index(lines, f"{folder}/index", block_lines))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string"


def read_back(wanted: DataFrame, index: CaptureIndex, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The records of wanted (id, url), found by the index: id, payload_bytes, payload_digest, record_type, refers_to, target.

    Keys are range-sorted first, so that a task's lookups and reads stay within few blocks. A response's payload is
    checked against its digest; a revisit's size is that of the payload it stands for, from its HTTP fields. A page of
    several equal rows gives as many records. Raises if a page has no record.
    """
    shared = wanted.sparkSession.sparkContext.broadcast(index)
    n = max(1, int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = wanted.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    keys = keys.groupBy("id", "url").agg(F.count("*").alias("n"))

    @F.pandas_udf("string")
    def key_of(urls: pd.Series) -> pd.Series:
        return pd.Series([reversed_key(None if pd.isna(u) else u) for u in urls], dtype=object)

    keys = keys.withColumn("key", key_of("url")).repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for f in frames:
            out = []
            for i, url in zip(f["id"], f["url"]):
                i = None if pd.isna(i) else int(i)
                url = None if url is None or (isinstance(url, float)) else url
                found = at.captures(url, i, every=False)
                if not found:
                    raise LookupError(f"page {i} has no record")
                for place in found:
                    warc, http, payload = at.read(*place)
                    digest = warc["warc-payload-digest"].removeprefix("sha1:")
                    revisit = warc["warc-type"] == "revisit"
                    size = int(http["content-length"])
                    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"the payload of page {i} is damaged")
                    out.append((_page_number(warc["warc-record-id"]), size, digest, warc["warc-type"], _page_number(warc["warc-refers-to"]) if revisit else None, warc["warc-target-uri"]))
            frame = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"])
            yield frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    return keys.mapInPandas(read, READ).withColumnRenamed("page_id", id_col)


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return read_back(pages.select("page_id", "url"), archive(pages.select("page_id", "url", "html"))).drop("target")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
), d AS (
  SELECT *, unhex(sha1(html))::BIT::VARCHAR AS b FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0b' || substr(b, 5 * k + 1, 5))::INT), 1) FOR k IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""

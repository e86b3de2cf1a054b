"""SimHash fingerprints and the search for near ones, in DataFrame operations only.

A term is a word together with up to four words before it; its 64-bit hash votes on every bit of the fingerprint, with
the number of characters of its last word, at most MAX_WEIGHT, as its weight. A bit is set if more than half of the
weight is for it. The 64 counters are kept as 32 sums of two lanes, so a term costs 32 additions in generated code.

Search: a fingerprint is cut into BLOCKS blocks. Two fingerprints within the radius agree in at least BLOCKS - radius
blocks, so a table is made for every choice of that many blocks, keyed by them (the permutation that brings them to
the front). Equal keys of a table give candidates; each pair is verified in the first table that yields it only.
That pays for a small radius. Texts with a Jaccard index of 0.8 over their terms differ in about 10 bits of 64, so the
query searches within NEAR_RADIUS; tables for that would be keyed by 4 bits at best and yield more candidates than
there are pairs, so from a radius of BLOCKS on every pair is compared, in generated code.

Where many fingerprints lie close together, links are not expanded into pairs. Such places get a class each: a centre, with
all fingerprints within the radius of it (of several centres: the nearest) as members. A fingerprint that is asked and lies
within the radius of a centre gets the class as a whole, with the exact number of members that it links with; any other
link stays a pair. As a link is a distance of fingerprints, the classes, their members and the pairs tell every link.
Centres are looked for in a sample of CLASS_SAMPLE fingerprints, which has no part in what is a link: where it misses a
group (of some CLASS_SEEN in CLASS_SAMPLE or less), the group's links are pairs.

The next document of a document, in descending order of ids, is found without sorting all in one task: ids alone are
range-sorted, and every BUCKET_ROWS-th (in tables of over MOST_BUCKETS buckets: fewer) is a border. A document finds its
bucket by binary search among the borders, whatever the ids are like; buckets are sorted each on its own, and the first
row of a bucket is also given to the bucket before it.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import common

SHINGLE = 5
MAX_WEIGHT = 16
BITS = 64
BLOCKS = 5
RADIUS = 3
#: For near copies: a Jaccard index of 0.8 is 9.7 bits on average with a deviation of 2.9; this is two deviations more.
NEAR_RADIUS = 16
#: Queries broadcast at once, and pairs compared in a task, when every pair is compared.
TILE_QUERIES, TASK_PAIRS = 1_000_000, 1 << 28
BUCKET_ROWS, MOST_BUCKETS = 1000, 1 << 18
#: Fingerprints in which centres of classes are looked for, and how many of them at least make a class.
CLASS_SAMPLE, CLASS_SEEN = 8192, 16
#: Members counted at once, and fingerprints compared in a task that counts them.
CHUNK, TASK_COUNTS = 512, 1 << 24


def _votes(words: str, pos: str) -> tuple[Column, Column]:
    """Hash and weight of the term that ends at a position; null where there is no word."""
    parts = [F.get(F.col(words), F.col(pos) - k) for k in range(SHINGLE)]
    weight = F.least(F.char_length(parts[0]), F.lit(MAX_WEIGHT)).cast("long")
    return F.xxhash64(*parts), weight


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """keys and a fingerprint (long) for every row; keys must tell the rows apart. A text without words (null, empty) has 0.

    If the rows are partitioned by some of the keys, no shuffle is added. Texts of up to 2**27 words.
    """
    text = common.ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = texts.select(*keys, F.split(text, f"[{common.SPACE}]+").alias("__words"))
    rows = rows.select(*keys, "__words", F.posexplode_outer("__words").alias("__pos", "__word"))
    h, weight = _votes("__words", "__pos")
    rows = rows.select(*keys, h.alias("__h"), weight.alias("__w"))
    lanes = [F.sum(F.shiftrightunsigned("__h", j).bitwiseAND(F.lit((1 << 32) | 1)) * F.col("__w")).alias(f"__s{j}") for j in range(32)]
    sums = rows.groupBy(*keys).agg(F.sum("__w").alias("__all"), *lanes)
    bits = []
    for j in range(32):
        low = F.col(f"__s{j}").bitwiseAND(F.lit((1 << 32) - 1))
        high = F.shiftrightunsigned(f"__s{j}", 32)
        bits += [F.when(low * 2 > F.col("__all"), F.lit(1 << j)).otherwise(0), F.when(high * 2 > F.col("__all"), F.lit(_signed(1 << (j + 32)))).otherwise(0)]
    value = bits[0]
    for b in bits[1:]:
        value = value.bitwiseOR(b)
    return sums.select(*keys, value.cast("long").alias(out_col))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the terms' weights as the fingerprints estimate it, 0 at the least."""
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * F.lit(3.141592653589793 / BITS)))


def near_fingerprints(queries: DataFrame, held: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, found, distance): all fingerprints in held (column fingerprint, long) within radius of one in queries.

    Distinct fingerprints on both sides, so copies make no pairs; a fingerprint finds itself if it is held. Nulls
    find nothing. radius must be below blocks. If held has a column class, members of classes whose centre lies within
    the radius of a query are not found by it.
    """
    size = [BITS // blocks + (k < BITS % blocks) for k in range(blocks)]
    start = [sum(size[:k]) for k in range(blocks)]
    choices = list(itertools.combinations(range(blocks), blocks - radius))

    def part(x: Column, k: int) -> Column:
        return F.shiftrightunsigned(x, start[k]).bitwiseAND(F.lit((1 << size[k]) - 1))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        x = F.col("fingerprint")
        fronts = []
        for t, choice in enumerate(choices):
            key, at = F.lit(0).cast("long"), 0
            for k in choice:
                key = key.bitwiseOR(F.shiftleft(part(x, k), at))
                at += size[k]
            fronts.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
        df = df.where("fingerprint IS NOT NULL").distinct()
        rest = [c for c in df.columns if c != "fingerprint"]
        return df.select(x.alias(name), *rest, F.explode(F.array(*fronts)).alias("f")).select(name, *rest, F.col("f.t").alias(f"{name}_t"), F.col("f.key").alias(f"{name}_key"))

    asked, held = keyed(queries.select("fingerprint"), "query"), keyed(_classed(held), "found")
    pairs = asked.join(held, (F.col("query_t") == F.col("found_t")) & (F.col("query_key") == F.col("found_key")) & _apart_from_class(radius)).withColumn("t", F.col("query_t"))
    both = F.col("query").bitwiseXOR(F.col("found"))
    # the first table in which the two agree
    first = F.lit(len(choices))
    for t in range(len(choices) - 1, -1, -1):
        same = F.lit(True)
        for k in choices[t]:
            same = same & (part(both, k) == 0)
        first = F.when(same, F.lit(t)).otherwise(first)
    return pairs.where((F.bit_count(both) <= radius) & (F.col("t") == first)).select("query", "found", F.bit_count(both).alias("distance"))


def near_by_scan(queries: DataFrame, held: DataFrame, radius: int) -> DataFrame:
    """As near_fingerprints, for any radius: every distinct fingerprint held is compared with every one asked."""
    held = _classed(held)
    asked = common.written(queries.select(F.col("fingerprint").alias("query")).where("query IS NOT NULL").distinct(), "asked")
    held = common.written(held.withColumnRenamed("fingerprint", "found").where("found IS NOT NULL").distinct(), "held")
    n = asked.count()
    tiles = -(-n // TILE_QUERIES) or 1
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * held.count() // tiles // TASK_PAIRS)
    held = held.repartition(parts, "found")
    apart = F.bit_count(F.col("query").bitwiseXOR(F.col("found")))
    tile = F.pmod(F.xxhash64("query"), F.lit(tiles))
    found = [held.join(F.broadcast(asked.where(tile == k)), (apart <= radius) & _apart_from_class(radius)) for k in range(tiles)]
    return functools.reduce(DataFrame.unionAll, found).select("query", "found", apart.alias("distance"))


def _classed(held: DataFrame) -> DataFrame:
    """fingerprint and its class, null if held has none."""
    return held.select("fingerprint", *["class"] if "class" in held.columns else [F.lit(None).cast("long").alias("class")])


def _apart_from_class(radius: int) -> Column:
    """That the query doesn't get the class of what is found as a whole."""
    return F.col("class").isNull() | (distance(F.col("query"), F.col("class")) > radius)


def _centres(held: DataFrame, radius: int) -> list[int]:
    """Centres of dense places among distinct fingerprints (column fingerprint), from a sample by hash; most often none."""
    rows = held.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(CLASS_SAMPLE).collect()  # at most CLASS_SAMPLE
    left = np.sort(np.array([r.fingerprint for r in rows], dtype=np.int64)).view(np.uint64)
    if len(left) <= CLASS_SEEN:
        return []
    close = [np.flatnonzero(np.bitwise_count(left ^ x) <= radius) for x in left]
    seen = np.array([len(c) - 1 for c in close])
    free, out = np.ones(len(left), dtype=bool), []
    while seen.max() >= CLASS_SEEN:
        k = int(seen.argmax())
        seen[k] = 0  # each is looked at once
        around = left[close[k][free[close[k]]]]
        if len(around) <= CLASS_SEEN:
            continue
        # the bits that most of them have: closer to all of them than any one is
        bits = (around[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
        centre = sum(1 << j for j in np.flatnonzero(bits.sum(axis=0) * 2 > len(around)).tolist())
        free &= np.bitwise_count(left ^ np.uint64(centre)) > radius
        out.append(_signed(centre))
    return sorted(set(out))


def with_classes(held: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (column fingerprint, nulls left out) with their class: the nearest centre within the radius, or null."""
    held = common.written(held.select("fingerprint").where("fingerprint IS NOT NULL").distinct(), "distinct")
    centres = _centres(held, radius)
    if not centres:
        return _classed(held)
    apart = distance(F.col("fingerprint"), F.col("class"))
    met = held.join(F.broadcast(held.sparkSession.createDataFrame([(c,) for c in centres], "class long")), apart <= radius, "left")
    return common.written(met.groupBy("fingerprint").agg(F.min(F.struct(apart, "class"))["class"].alias("class")), "classes")


def near_in_classes(queries: DataFrame, held: DataFrame, radius: int) -> DataFrame:
    """(query, class, found): how many members of a class lie within the radius of a query, itself left out; 0 is left out.

    For the queries (column fingerprint) within the radius of the class's centre. held is as of with_classes. Members
    are compared in arrays, so no row is made for a pair.
    """
    session = held.sparkSession
    members = held.where("class IS NOT NULL")
    sizes = {r["class"]: r["count"] for r in members.groupBy("class").count().collect()}  # at most a row a centre
    if not sizes:
        return session.createDataFrame([], "query long, class long, found long")
    many = session.createDataFrame([(c, -(-n // CHUNK)) for c, n in sizes.items()], "class long, chunks long")
    chunk = F.pmod(F.xxhash64("fingerprint"), F.col("chunks"))
    held = common.written(members.join(F.broadcast(many), "class").groupBy("class", chunk.alias("chunk")).agg(F.collect_list("fingerprint").alias("held")), "members")
    asked = queries.select(F.col("fingerprint").alias("query")).where("query IS NOT NULL").distinct()
    asked = common.written(asked.join(F.broadcast(many.select("class")), distance(F.col("query"), F.col("class")) <= radius), "asked")
    times = {r["class"]: r["count"] for r in asked.groupBy("class").count().collect()}  # at most a row a centre
    tiles = -(-sum(times.values()) // TILE_QUERIES) or 1
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), sum(n * sizes[c] for c, n in times.items()) // tiles // TASK_COUNTS)
    held = held.repartition(parts, "class", "chunk")
    tile = F.pmod(F.xxhash64("query", "class"), F.lit(tiles))
    met = functools.reduce(DataFrame.unionAll, [held.join(F.broadcast(asked.where(tile == k)), "class") for k in range(tiles)])
    query = F.col("query")
    met = met.select("query", "class", F.size(F.filter("held", lambda x: (x != query) & (distance(x, query) <= radius))).alias("found"))
    return met.groupBy("query", "class").agg(F.sum("found").alias("found")).where("found > 0")


def _borders(ids: DataFrame, bucket_rows: int) -> list[int]:
    """Ids, ascending, that cut all ids (column id, long) into buckets of about bucket_rows; at most MOST_BUCKETS and one for each range."""
    ids = ids.where("id IS NOT NULL")
    n = ids.count()
    step = max(bucket_rows, -(-n // MOST_BUCKETS))
    if n <= step:
        return []
    ranges = min(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // step))
    sorted_ = common.written(ids.repartitionByRange(ranges, "id").withColumn("range", F.spark_partition_id()), "ids")
    nth = F.row_number().over(Window.partitionBy("range").orderBy("id"))
    return sorted({r.id for r in sorted_.withColumn("nth", nth).where(F.col("nth") % step == 1).select("id").collect()})


def _buckets(rows: DataFrame, borders: list[int]) -> DataFrame:
    """rows with the number of their bucket: ascending as ids descend, nulls in the last. By binary search."""
    steps = [1 << k for k in range(len(borders).bit_length() - 1, -1, -1)] if borders else []
    rows = rows.withColumn("__borders", common.constant(rows.sparkSession, np.array(borders, dtype=np.int64), "array<bigint>"))
    held = F.col("__borders")
    # how many borders are not above the id
    below = F.aggregate(F.array(*[F.lit(x) for x in steps]).cast("array<int>"), F.lit(0), lambda at, x: F.when(F.get(held, at + x - 1) <= F.col("id"), at + x).otherwise(at))
    return rows.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(len(borders) + 1)).otherwise(F.lit(len(borders)) - below)).drop("__borders")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """bucket, pos, guest, id, text (null: empty) and next_text: that of the next document in descending order of ids, of the first after the last.

    Rows of equal id are ordered by text, null ids come last. Guests are the first rows of the next bucket, once more.
    The result is partitioned by bucket.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    borders = _borders(rows.select("id"), bucket_rows)
    firsts = _buckets(rows.select("id"), borders).groupBy("bucket").agg(F.max("id").alias("first"))
    rows = _buckets(rows, borders)
    found = firsts.orderBy("bucket").collect()  # one row a bucket
    before = [(found[k - 1].bucket if k else found[-1].bucket, r.first) for k, r in enumerate(found)]
    hosts = docs.sparkSession.createDataFrame(before, "host int, first long")
    guests = rows.join(F.broadcast(hosts), F.col("id").eqNullSafe(F.col("first"))).select("id", "text", F.col("host").alias("bucket"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("id"), "text")
    return both.select("bucket", F.row_number().over(order).alias("pos"), "guest", "id", "text", F.lead("text").over(order).alias("next_text"))


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last third (floor) replaced by as many of the next text's first characters, or all it has."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(next_text, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint (long), near_edited, near_next.

    Null text counts as empty. Rows of equal id are told apart by their texts; of rows alike in both, each has the
    other as its next. A table of one row is its own next. Empty input gives no rows.
    """
    rows = with_next(docs, id_col, text_col, bucket_rows)
    rows = rows.select("bucket", "pos", "guest", "id", F.char_length("text").cast("long").alias("n_chars"), "text", edited(F.col("text"), F.coalesce("next_text", F.lit(""))).alias("edited"))
    each = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body"), F.sha2("edited", 256).alias("sha")))
    rows = rows.select("bucket", "pos", "guest", "id", "n_chars", F.explode(F.when(F.col("guest"), F.slice(each, 1, 1)).otherwise(each)).alias("e"))
    keys = ["bucket", "pos", "which", "guest", "id", "n_chars", "sha"]
    marks = fingerprints(rows.select("bucket", "pos", "guest", "id", "n_chars", "e.which", "e.sha", F.col("e.body").alias("text")), keys)
    order = Window.partitionBy("bucket").orderBy("pos", "which")
    mine, its, other = F.col("fingerprint"), F.lead("fingerprint", 1).over(order), F.lead("fingerprint", 2).over(order)
    out = marks.select("which", "guest", "id", "n_chars", F.lead("sha", 1).over(order).alias("edited_sha256"), mine.alias("a"), its.alias("b"), other.alias("c")).where((F.col("which") == 0) & ~F.col("guest"))

    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("a").alias("fingerprint"), F.col("b").alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))


def with_near(marks: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """marks, a table with a column fingerprint, with what of the table lies within the radius of the row's fingerprint.

    near_class: the centre of the class that the fingerprint is in, for all rows; null if in none. Only for the rows that
    asked holds for, and null for the others: near_found: how many other fingerprints; near_classes: the classes with a
    centre within the radius that have some of these, ascending; near: the rest of these, ascending; near_copies: how
    many other rows of the same fingerprint. So a row's links are near, and the fingerprints within the radius among
    the members of near_classes.
    """
    marks_asked = marks.withColumn("__asked", asked)
    queries, held = marks.where(asked), with_classes(marks, radius)
    pairs = near_fingerprints(queries, held, radius) if radius < BLOCKS else near_by_scan(queries, held, radius)
    near = pairs.where("query <> found").groupBy("query").agg(F.count("*").alias("__pairs"), F.sort_array(F.collect_list("found")).alias("near"))
    whole = near_in_classes(queries, held, radius).groupBy(F.col("query").alias("__query")).agg(F.sum("found").alias("__whole"), F.sort_array(F.collect_list("class")).alias("near_classes"))
    classes = held.where("class IS NOT NULL").select(F.col("fingerprint").alias("__member"), F.col("class").alias("near_class"))
    rows = marks_asked.groupBy("fingerprint").agg(F.count("*").alias("n"), F.count_if("__asked").alias("__n_asked"))
    rows = rows.join(classes, F.col("fingerprint") == F.col("__member"), "left").where("__n_asked > 0 OR near_class IS NOT NULL")
    none = F.array().cast("array<long>")
    table = rows.join(near, F.col("fingerprint") == F.col("query"), "left").join(whole, F.col("fingerprint") == F.col("__query"), "left")
    found = F.coalesce("__pairs", F.lit(0)) + F.coalesce("__whole", F.lit(0))
    table = table.select("fingerprint", "n", "near_class", found.alias("near_found"), F.coalesce("near", none).alias("near"), F.coalesce("near_classes", none).alias("near_classes"), (F.col("n") - 1).alias("near_copies"))
    out = common.lookup(marks_asked, table, ["fingerprint"], "n", marks.count()).drop("n")
    return out.withColumns({c: F.when(F.col("__asked"), F.col(c)) for c in ("near_found", "near", "near_classes", "near_copies")}).drop("__asked")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = common.written(fingerprint_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text")), "marks")
    found = with_near(marks, F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False)), NEAR_RADIUS)

    def text_of(x: Column | str) -> Column:
        return F.lower(F.lpad(F.hex(x), 16, "0"))

    return found.select("doc_id", "n_chars", "edited_sha256", text_of("fingerprint").alias("fingerprint"), text_of("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next", "near_found", F.transform("near", text_of).alias("near"), "near_copies", text_of("near_class").alias("near_class"), F.transform("near_classes", text_of).alias("near_classes"))

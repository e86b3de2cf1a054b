"""What the operators of this subpackage share: tables, the shared folder, text normalisation."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.plans.store import drop, fresh_path, shared_dir, written
from strandlake.shipping import ship

__all__ = ["ascii_lower", "bloom", "constant", "drop", "fresh_path", "give_back", "hold", "lookup", "prepare", "shared_dir", "table", "without", "written"]

#: ASCII white space as used by every word definition here.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


#: Rows and bytes given to a Python worker at once, so that batches of whole texts stay small on both sides.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ships the package, and lowers the size of an Arrow batch where the session has Spark's defaults."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10000:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864b"):
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower() does just that for texts of ASCII only and is faster."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def constant(spark: SparkSession, value, kind: str) -> Column:
    """A large value as a scalar subquery: a literal would be printed into every description of the plan that the driver keeps.

    Arrays of numbers go to the JVM as they are, without an object for each.
    """
    if isinstance(value, np.ndarray):
        return spark.createDataFrame(pa.table({"value": pa.array([value])})).scalar()
    return spark.createDataFrame([(value,)], f"value {kind}").scalar()


def give_back() -> None:
    """Returns freed memory of this process to the system, after work on large arrays."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_held: dict = {}


def hold(name: str, make):
    """State that a worker process keeps between tasks: of one operator at a time, so that workers stay small."""
    if _held.get("name") != name:
        _held.clear()
        give_back()
        _held.update(name=name, value=make())
    return _held["value"]


def bloom(keys: DataFrame, key: str, n_keys: int, most_bits: int = 1 << 25) -> Column:
    """A condition on a long column of the same name: true for every value in keys, and false for most others.

    The filter holds at most most_bits bits (4 MB), whatever the input; when it fills up, it lets more rows pass, so an
    exact step must follow.
    """
    log2 = 12
    while (1 << log2) < min(16 * max(n_keys, 1), most_bits):
        log2 += 1
    words = (
        keys.groupBy(F.expr(f"cast(shiftrightunsigned({key}, {64 - log2 + 6}) as int)").alias("w"))
        .agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned({key}, {64 - log2}) & 63 as int)))").alias("b"))
        .toPandas()
    )
    held = np.zeros(1 << (log2 - 6), dtype=np.int64)
    held[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    word = F.get(constant(keys.sparkSession, held, "array<bigint>"), F.expr(f"cast(shiftrightunsigned({key}, {64 - log2 + 6}) as int)"))
    return F.getbit(word, F.expr(f"cast(shiftrightunsigned({key}, {64 - log2}) & 63 as int)")) == 1


def without(docs: DataFrame, gone: DataFrame, *on: str) -> DataFrame:
    """docs, all columns, without the rows whose values in the columns `on` (nulls equal) are in gone, which has these columns only.

    Only rows that a bounded filter can't tell from those in gone are shuffled.
    """
    gone = written(gone.select(*[F.col(c).alias(f"__gone_{c}") for c in on]), "gone")
    hashed = gone.select(F.xxhash64(*gone.columns).alias("__h"))
    maybe = bloom(hashed, "__h", gone.count())
    docs = docs.withColumn("__h", F.xxhash64(*on))
    rest = docs.where(maybe).join(gone, [F.col(c).eqNullSafe(F.col(f"__gone_{c}")) for c in on], "left_anti")
    return docs.where(~maybe).unionByName(rest).drop("__h")


def lookup(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """rows left-joined with table, which has one row a key (nulls equal); weight: how many of the rows have the key.

    Keys that more than 1/share of all rows have are at most share in number; these are looked up in a broadcast
    table, all others in a shuffled join, so that no key gathers many rows in one task.
    """
    most = max(1000, total // share)
    values = [c for c in table.columns if c not in on]
    hot = table.where(F.col(weight) > most).select(*[F.col(c).alias(f"__hot_{c}") for c in table.columns])
    cold = table.where(F.col(weight) <= most).select(*[F.col(c).alias(f"__cold_{c}") for c in table.columns])
    met = rows.join(F.broadcast(hot), [rows[c].eqNullSafe(hot[f"__hot_{c}"]) for c in on], "left")
    # rows answered already get a number of their own in place of the key's part, which matches nothing
    done = F.col(f"__hot_{weight}").isNotNull()
    met = met.withColumn("__part", F.when(done, F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long")))
    cold = cold.withColumn("__cold_part", F.lit(-1).cast("long"))
    met = met.join(cold, [F.col("__part") == F.col("__cold_part"), *[F.col(c).eqNullSafe(F.col(f"__cold_{c}")) for c in on]], "left")
    out = [F.when(done, F.col(f"__hot_{c}")).otherwise(F.col(f"__cold_{c}")).alias(c) for c in values]
    return met.select(*[F.col(c) for c in rows.columns], *out)

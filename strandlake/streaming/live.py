"""Structured Streaming: lookups, matching statistics of sequences that arrive in chunks, and sets of k-mers that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.functions import dna
from strandlake.operators import matching
from strandlake.operators.index import KmerIndex, kmers_of
from strandlake.operators.search import query_windows
from strandlake.plans import store


def read(spark: SparkSession, path: str, schema: str = "seq_id long, seq string", files_per_batch: int = 1) -> DataFrame:
    """Parquet files of sequences as they arrive, a bounded number for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def lookup(index: KmerIndex, queries: DataFrame) -> DataFrame:
    """query_id, pos, colex (-1 if absent) for a stream of queries (query_id, seq): a join with the index, without state."""
    found = index.nodes.where(~F.col("is_dummy")).select(F.col("node").alias("kmer"), "colex")
    return query_windows(queries, index.k).join(found, "kmer", "left").select("query_id", "pos", F.coalesce("colex", F.lit(-1)).cast("long").alias("colex"))


#: What is held of a sequence: the number of the chunk that comes next, its position, the last k-1 characters before it, and
#: the chunks that came too early (late is 0 for these, 1 for those of a batch: of two with one number the earlier stays).
HELD = "query_id long, expected long, at long, tail string, waiting array<struct<no:long,late:int,part:string>>, batch long"
#: All that is held is written out by every so many batches; the others write the sequences they touch.
WHOLE = 10


def advanced(held: DataFrame, chunks: DataFrame, k: int, every: bool = False) -> DataFrame:
    """Sequences (HELD but batch) after chunks (query_id, chunk_no, part), with first and text: what can be read on.

    first is the position of the first new character, text the new characters behind the tail held so far. Chunks count
    from 0; one that came before is ignored. Sequences without new chunks are left out, unless every is asked for.
    """
    no = F.coalesce(F.col("chunk_no"), F.raise_error(F.lit("a chunk has no number"))).cast("long")
    part = dna.upper(F.coalesce("part", F.lit("")))
    new = chunks.select("query_id", F.struct(no.alias("no"), F.lit(1).alias("late"), part.alias("part")).alias("chunk"))
    both = held.select("query_id", "batch", F.struct("expected", "at", "tail", "waiting").alias("was")).unionByName(new, allowMissingColumns=True)
    rows = both.groupBy("query_id").agg(F.max_by("was", "batch").alias("was"), F.collect_list("chunk").alias("new"))
    if not every:
        rows = rows.where(F.size("new") > 0)
    rows = rows.select("query_id", F.coalesce("was.expected", F.lit(0)).alias("expected"), F.coalesce("was.at", F.lit(0)).alias("first"), F.coalesce("was.tail", F.lit("")).alias("tail"), "was.waiting", "new")
    came = F.filter("new", lambda x: x["no"] >= F.col("expected"))
    rows = rows.withColumn("all", F.array_sort(F.when(F.col("waiting").isNull(), came).otherwise(F.concat("waiting", came))))
    rows = rows.withColumn("each", F.filter("all", lambda x, i: ~x["no"].eqNullSafe(F.get("all", i - 1)["no"])))
    # numbers grow by one at least, so those without a gap come first
    on = lambda x, i: x["no"] == F.col("expected") + i
    rows = rows.withColumn("ready", F.filter("each", on)).withColumn("text", F.concat("tail", F.array_join(F.transform("ready", lambda x: x["part"]), "")))
    rest = F.transform(F.filter("each", lambda x, i: ~on(x, i)), lambda x: F.struct(x["no"].alias("no"), F.lit(0).alias("late"), x["part"].alias("part")))
    rows = rows.withColumn("waiting", rest)
    at = F.col("first") + F.length("text") - F.length("tail")
    return rows.select("query_id", (F.col("expected") + F.size("ready")).alias("expected"), at.cast("long").alias("at"), F.right("text", F.lit(k - 1)).alias("tail"), "waiting", "first", F.col("tail").alias("before"), "text")


def matching_statistics(index: KmerIndex, chunks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes query_id, pos, len, lo, hi of a stream of chunks to Parquet, a folder for each micro-batch (written anew if it is retried).

    So is what is held of the sequences, in the folder of the checkpoint. A batch reads what those before it held since
    the last that wrote all.
    """
    spark, path = chunks.sparkSession, f"{checkpoint.rstrip('/')}/held"

    def write(batch: DataFrame, number: int) -> None:
        since = number // WHOLE * WHOLE - 1
        folders = [f"{path}/batch={n}" for n in range(max(since, 0), number)]
        held = spark.read.option("basePath", path).schema(HELD).parquet(*folders) if folders else spark.createDataFrame([], HELD)
        whole = number % WHOLE == WHOLE - 1
        step = store.written(advanced(held, batch, index.k, whole), "step")
        step.select(*[c for c in held.columns if c != "batch"]).write.mode("overwrite").parquet(f"{path}/batch={number}")
        text = matching.padded(step.select("query_id", "first", F.col("text").alias("seq"), "before"), index.k, "first", "before")
        # the tail stands for as many pads
        text = text.select("query_id", "first", F.expr("substring(seq, length(before) + 1)").alias("seq"))
        matching.statistics_of(index, text, offset="first").write.mode("overwrite").parquet(f"{out}/batch={number}")
        store.drop(step)
        if whole:  # a retry of this batch reads from since on
            for n in range(max(since - WHOLE, 0), max(since, 0)):
                store.delete(spark, f"{path}/batch={n}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class GrowingKmers:
    """A set of k-mers in a folder, to which streams of sequences add; each micro-batch has a folder of its own."""

    def __init__(self, spark: SparkSession, path: str, k: int):
        self.spark, self.path, self.k = spark, path, k

    def kmers(self) -> DataFrame:
        return self.spark.read.schema("kmer string, batch long").parquet(self.path).select("kmer")

    def _add(self, batch: DataFrame, number: int) -> None:
        new = kmers_of(batch.select("seq_id", dna.upper(F.col("seq")).alias("seq")), self.k)
        try:
            held = self.spark.read.schema("kmer string, batch long").parquet(self.path).where(F.col("batch") < number).select("kmer")
            new = new.join(held, "kmer", "left_anti")
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def ingest(self, sequences: DataFrame, checkpoint: str) -> StreamingQuery:
        return sequences.writeStream.foreachBatch(self._add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def index(self) -> KmerIndex:
        return KmerIndex.from_kmers(self.kmers().distinct(), self.k)


def dna_stream(text: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A stream of texts as sequences (seq_id, seq)."""
    return text.select(F.col(id_col).cast("long").alias("seq_id"), dna.from_text(F.coalesce(F.col(text_col), F.lit(""))).alias("seq"))

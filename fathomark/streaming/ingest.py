"""Continuous ingestion: a stream of note files parsed into index tables, each version of a file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomark.functions import text as tx
from fathomark.functions.parse import lossy_text, parse_texts

FILES = "path string, text string, hash string, at timestamp"


def note_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """``path, text, hash, at`` of the ``.md`` files that appear below a folder.

    Spark's source passes over files a week older than the newest, and without that limit it never reads a path
    again. So both are read, with the limit and without; :func:`write_notes` takes once what comes from both. A path
    changed within a week of the newest file is passed over by either until newer files come.
    """
    files = lambda age: (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).option("maxFileAge", age).load(folder)
    )
    return files("7d").unionByName(files("36500d")).select("path", lossy_text(F.col("content")).alias("text"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("at"))


def parsed_stream(files: DataFrame) -> DataFrame:
    """A stream of parsed notes, however late they come. Repeats are left in; :func:`write_notes` takes each version once."""
    return parse_texts(files).withColumn("word_count", tx.word_count(F.col("content")))


def write_notes(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append every batch to the table at ``out``, under its batch number: a batch replayed after a failure replaces itself.

    A version of a file (``path, hash``) that an earlier batch has written, or that comes twice in a batch, is taken
    once; one that comes back after another version of the file is taken again, as it is current then. What is known
    is the table itself, not a watermark, so a note counts whatever its modification time. Only three narrow columns
    of the table are read for that.
    """
    in_time = Window.partitionBy("path").orderBy("at", F.desc("known"), "hash")

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(["path", "hash", "at"])
        seen = batch.select("path", "hash", "at", F.lit(0).alias("known"))
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(out)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        earlier = [f"{out}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < number]
        if earlier:
            known = spark.read.schema("path string, hash string, at timestamp").parquet(*earlier)
            seen = seen.unionByName(known.join(batch.select("path"), "path", "left_semi").withColumn("known", F.lit(1)))
        turned = F.coalesce((F.col("hash") != F.lag("hash").over(in_time)).cast("int"), F.lit(1))
        stretch = Window.partitionBy("path", "stretch")  # of one version, uninterrupted in time
        seen = seen.withColumn("turned", turned).withColumn("stretch", F.sum("turned").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
        seen = seen.withColumn("written", F.max("known").over(stretch)).withColumn("n", F.row_number().over(stretch.orderBy("at")))
        fresh = batch.join(seen.where("written = 0 and n = 1").select("path", "hash", "at"), ["path", "hash", "at"], "left_semi").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return parsed_stream(files).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_notes(spark: SparkSession, out: str) -> DataFrame:
    """The latest version of each note of an ingested table."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at"), F.desc("batch")))
    return spark.read.parquet(out).withColumn("_n", last).where("_n = 1").drop("_n")


def tag_activity(files: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """``window, tag, n``: how often each tag was seen in each window of file times, late files up to ``late`` included."""
    tagged = parse_texts(files.withWatermark("at", late)).select("at", F.explode("tags").alias("tag"))
    return tagged.groupBy(F.window("at", window).alias("window"), "tag").agg(F.count("*").alias("n"))

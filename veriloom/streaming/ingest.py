"""Incremental ingest: a file stream of relations, merged into graph snapshots batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veriloom.functions import text as X
from veriloom.operators.graph import merge_edges, merge_relations


def relation_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New files of a folder as a stream.

    No watermark: a relation may arrive months late and must not be lost.  Repeated deliveries are
    harmless, because the merge they feed is keyed and its lists only take what is absent.
    """
    return spark.readStream.schema(schema).parquet(folder)


def hourly_counts(stream: DataFrame, time: str, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Windowed counts and sums with late rows up to the watermark."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)
    return timed.groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total"
    )


def newest_version(spark: SparkSession, out: str) -> int | None:
    """The highest version whose writing was completed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(out)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    done = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "edges/_SUCCESS"))]
    return max((int(x.getName()[1:]) for x in done), default=None)


def run_ingest(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> StreamingQuery:
    """Merge every new batch of relations into the newest snapshot ``out/v<N>``; a snapshot is never changed once written.

    A snapshot holds the edges and, beside them, the keys (ord, ingested_at) of the deliveries it was told.  A batch that is repeated after a failure finds its deliveries known and changes nothing, and a new
    checkpoint folder goes on from the newest snapshot instead of starting over.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        last = newest_version(spark, out)
        df = df.dropDuplicates(["ord", "ingested_at"])
        told = df.select("ord", "ingested_at")
        if last is not None:
            seen = spark.read.parquet(f"{out}/v{last}/told")
            df = df.join(seen, ["ord", "ingested_at"], "left_anti")
            told = seen.union(df.select("ord", "ingested_at"))
        edges = merge_relations(df)
        if last is not None:
            edges = merge_edges(spark.read.parquet(f"{out}/v{last}/edges"), edges)
        target = f"{out}/v{0 if last is None else last + 1}"
        told.write.mode("overwrite").parquet(f"{target}/told")
        edges.write.mode("overwrite").parquet(f"{target}/edges")

    stream = relation_stream(spark, folder, schema).withColumn("predicate", X.clean_display(F.col("predicate")))
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

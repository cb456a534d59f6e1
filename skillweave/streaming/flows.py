"""Structured Streaming: index upkeep, phrase counts, cached vectors, and windows over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skillweave.operators.features import Embedder, embed, text_key
from skillweave.runtime import materialize, shared_folder
from skillweave.sources.index_store import IndexStore, VectorCache


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keep_index(stream: DataFrame, store: IndexStore, embedder: Embedder, cache: VectorCache, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch of (item_id, text, updated_at, is_active) is embedded, new texts only, and appended. A batch
    that runs again appends equal rows, which the reader's latest-by-id takes once."""
    def write(batch: DataFrame, _: int) -> None:
        b = batch.filter("item_id IS NOT NULL")
        vecs = materialize(embed(b.select("text"), embedder, cache.get()), "stream-vectors")
        cache.put(vecs)
        rows = b.withColumn("key", text_key(embedder, "text")).join(vecs, "key").select("item_id", "vec", "updated_at", "is_active")
        if store.exists():
            store.append(rows)
        elif not rows.isEmpty():
            store.build(rows)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def count_phrases(stream: DataFrame, max_n: int = 4) -> DataFrame:
    """(phrase, freq): running counts of the n-grams of the column ``text``; thresholds apply to the sink."""
    from skillweave.functions.text import ngrams

    t = stream.select(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-zA-ZÀ-ỹ0-9+#.\-]{2,})"), F.lit(1)).alias("t"))
    return t.select(F.explode(F.concat(*[ngrams("t", n) for n in range(1, max_n + 1)])).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("freq"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are left out by a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def run_to_table(stream: DataFrame, mode: str = "append", name: str = "out") -> DataFrame:
    """Runs a stream over all files there are and returns what it wrote, from the shared folder: all rows in
    append mode, the last batch's whole result in complete mode."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    out = f"{base}/data"
    last = []

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}-{i}")
        last.append(i)

    w = stream.writeStream.option("checkpointLocation", f"{base}/cp").outputMode(mode).trigger(availableNow=True)
    q = (w.format("parquet").option("path", out) if mode == "append" else w.foreachBatch(write)).start()
    q.awaitTermination()
    if mode != "append" and not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out if mode == "append" else f"{out}-{last[-1]}")

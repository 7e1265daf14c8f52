"""Structured Streaming: incremental ingest of chunks and of the concept graph, and tumbling transcript windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspan.sources.graph_store import ARRIVALS, GraphStore
from quillspan.sources.store import upsert
from quillspan.sources.versions import Versions


def ingest_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "chunk_id", seq: str = "seq", buckets: int = 64, files_a_batch: int = 1000) -> StreamingQuery:
    """Chunks that arrive as Parquet files in `source`, upserted by key into a versioned table `chunks` below `target`.

    Each batch is one commit with its number; only buckets of its keys are rewritten, and a batch that is run again changes nothing.
    Arrived chunks are processed and the query ends; it goes on from its checkpoint when started again.
    """
    store = chunk_versions(spark, target, schema, key, buckets)

    def put(batch: DataFrame, batch_id: int) -> None:
        store.change("chunks", batch, lambda old, new: upsert(old, new, key, seq), checkpoint, batch_id)

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return reader.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_versions(spark: SparkSession, target: str, schema: str, key: str = "chunk_id", buckets: int = 64) -> Versions:
    return Versions(spark, target, {"chunks": (key, schema)}, buckets)


def graph_stream(spark: SparkSession, source: str, target: str, checkpoint: str, buckets: int = 64, files_a_batch: int = 1000) -> StreamingQuery:
    """Proposals that arrive as Parquet files (ARRIVALS) in `source`, merged into the graph below `target`, one commit a batch."""
    store = GraphStore(spark, target, buckets)

    def put(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, batch_id, checkpoint)

    reader = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return reader.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Event time is so much later than a segment's start, as a new stream's watermark stands at 0 and what is not after it counts as late.
_SHIFT_SEC = 86_400
_CHUNK = "chunk_id string, source_id string, text string, start_time double, end_time double"
_STATE = "next_id long, slots array<long>, seqs array<long>, texts array<string>, ends array<double>"


def window_chunks_stream(segments: DataFrame, window_sec: float = 60.0, watermark: str = "5 minutes") -> DataFrame:
    """Chunks of a stream of segments (source_id, seq, start, end, text; seconds) by windows of their starts, in append mode.

    A window is given once, when the watermark has passed its end; a timer in event time sees to that also where a source
    says nothing more. Chunks of a source are numbered without gaps in order of their windows, as window_chunks numbers them.
    Segments later than the watermark are dropped. What is kept of a source is its windows still open.
    """
    width = int(window_sec * 1000)

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_id, slots, seqs, texts, ends = state.get if state.exists else (0, [], [], [], [])
        slots, seqs, texts, ends = list(slots), list(seqs), list(texts), list(ends)
        for rows in batches:
            slots += (rows["start"] // window_sec).astype("int64").tolist()
            seqs += rows["seq"].tolist()
            texts += ["" if t is None else t for t in rows["text"]]
            ends += rows["end"].tolist()
        said = sorted(zip(slots, seqs, texts, ends))
        passed = state.getCurrentWatermarkMs() - _SHIFT_SEC * 1000
        done, rest = [x for x in said if (x[0] + 1) * width <= passed], [x for x in said if (x[0] + 1) * width > passed]
        out = []
        for slot in dict.fromkeys(x[0] for x in done):
            mine = [x for x in done if x[0] == slot]
            out.append((f"{key[0]}_chunk_{next_id}", key[0], " ".join(x[2] for x in mine), slot * window_sec, mine[-1][3]))
            next_id += 1
        state.update((next_id, *([x[k] for x in rest] for k in range(4))))
        if rest:
            state.setTimeoutTimestamp((rest[0][0] + 1) * width + _SHIFT_SEC * 1000)
        if out:
            yield pd.DataFrame(out, columns=["chunk_id", "source_id", "text", "start_time", "end_time"])

    timed = segments.withColumn("ts", F.timestamp_seconds(F.col("start") + _SHIFT_SEC)).withWatermark("ts", watermark)
    chosen = timed.select(F.col("source_id").cast("string").alias("source_id"), "ts", F.col("start").cast("double").alias("start"), F.col("seq").cast("long").alias("seq"), F.col("end").cast("double").alias("end"), "text")
    return chosen.groupBy("source_id").applyInPandasWithState(run, _CHUNK, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

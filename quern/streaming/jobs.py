"""Structured Streaming forms of the loops: the same transforms as in batch, over files that arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quern.operators.indexing import postings, tokens_of

#: Entries at which the crawl stops (a fixed value), and observations of the queue that are put in order together.
QUEUE_HIGH, STRETCH = 5000, 100_000


def arriving(spark: SparkSession, folder: str, pattern: str, schema: StructType, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; files limits a batch, so that a long queue is worked off in bounded steps."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def timed(stream: DataFrame, column: str = "ts") -> DataFrame:
    """A column of local time as TIMESTAMP, which watermarks need."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what has arrived and stops."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, fn, checkpoint: str, mode: str = "append", every: str | None = None) -> None:
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode(mode)
    (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start().awaitTermination()


def index_stream(docs: DataFrame, target: str, checkpoint: str) -> None:
    """Indexer loop: postings of each batch, written under the batch's number, so that a batch that is run again replaces its own."""
    each_batch(docs, lambda batch, n: postings(tokens_of(batch)).write.mode("overwrite").parquet(f"{target}/batch={n}"), checkpoint)


def search_counts(searches: DataFrame) -> DataFrame:
    return searches.groupBy(F.lower(F.trim("q")).alias("term")).agg(F.count("*").alias("times"))


def backlink_pairs(edges: DataFrame) -> DataFrame:
    """dst, src: each link once, whenever it came. The set of a page is its rows, so that no page's links must fit into one row."""
    return edges.select("dst", "src").dropDuplicates(["dst", "src"])


def changed_pages(pages: DataFrame, key: str = "url", mark: str = "last_crawled") -> DataFrame:
    """A page for each mark of its URL that differs from the stored one; the stored one is then the greatest. The state is one mark for each URL.

    The rows of a URL may come in any order and in any number of parts: a mark that was seen since the last trigger is not given again.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields)

    def only_new(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        seen = set() if last is None else {last}
        for batch in batches:
            marks = batch[mark].astype(str)
            keep = ~(marks.isin(seen) | marks.duplicated())
            seen.update(marks[keep])
            yield batch[keep]
        state.update((max(seen),))

    return pages.groupBy(key).applyInPandasWithState(only_new, fields, "mark string", "append", GroupStateTimeout.NoTimeout)


def may_crawl(lengths: DataFrame, high: int = QUEUE_HIGH) -> DataFrame:
    """Adds paused: whether the crawl stands still after each observation of the queue (seq, waiting).

    It stops at high entries and goes on only when the queue is empty, for which the indexer signals; between the two it stays as it was.
    """
    turn = F.when(F.col("waiting") >= high, True).when(F.col("waiting") == 0, False)
    # the last turn before an observation decides: turns are numbered by sums within stretches of observations, then over the stretches
    marked = lengths.withColumn("turn", turn).withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    last = marked.where("turn is not null").groupBy("stretch").agg(F.max_by("turn", "seq").alias("ended"))
    every = marked.select("stretch").distinct().join(last, "stretch", "left")  # one row for STRETCH observations
    before = every.withColumn("begun", F.last("ended", ignorenulls=True).over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))).drop("ended")
    w = Window.partitionBy("stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(before, "stretch").withColumn("paused", F.coalesce(F.last("turn", ignorenulls=True).over(w), "begun", F.lit(False))).drop("turn", "stretch", "begun")


def sessions(searches: DataFrame, gap: str = "24 hours") -> DataFrame:
    """counter, start, total: searches (ts, counter) until a pause of a day; closed sessions are appended as the watermark passes."""
    return timed(searches).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "counter").agg(F.count("*").alias("total")).select("counter", F.col("session_window.start").alias("start"), "total")


def job_log(actions: DataFrame) -> DataFrame:
    """A log row for each report or moderation action."""
    return actions.select(F.to_json(F.struct("*")).alias("entry"))


def rate_windows(requests: DataFrame, key: str, most: int) -> DataFrame:
    counted = timed(requests).withWatermark("ts", "1 minute").groupBy(F.window("ts", "1 minute"), key).agg(F.count("*").alias("requests"))
    return counted.select(F.col("window.start").alias("start"), key, "requests", (F.col("requests") > most).alias("is_over"))

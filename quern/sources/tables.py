"""Scans and sinks with the write semantics of the stores: upserts, insert-if-absent, set union, queues, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fetched(pages: DataFrame) -> DataFrame:
    """Pages that count as fetched: status below 400 and HTML."""
    return pages.where((F.col("status") <= 399) & F.startswith("content_type", F.lit("text/html"))).withColumn("content_type", F.lit("text/html"))


def by_status(seeds: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    rows = seeds.where(F.col("status") == status).orderBy(F.col("priority").asc_nulls_first(), "discovered_at", "_id")
    return rows.limit(limit) if limit else rows


def popped(queue: DataFrame, n: int) -> DataFrame:
    """The n rows of the smallest score, with their raw URL."""
    return queue.orderBy("score", "url").limit(n).withColumn("raw_url", F.concat(F.lit("https://"), "url"))


def oldest(queue: DataFrame, seq: str, n: int = 1) -> DataFrame:
    return queue.orderBy(seq).limit(n)


def with_record(keys: DataFrame, records: DataFrame, key: str) -> DataFrame:
    return keys.join(records, key)


def without_prefix(keys: DataFrame, prefix: str) -> DataFrame:
    """Rows whose key has the prefix, without it."""
    return keys.where(F.startswith("key", F.lit(prefix))).withColumn("key", F.substring("key", len(prefix) + 1, 1 << 30))


def image_defaults(images: DataFrame) -> DataFrame:
    return images.withColumns({c: F.coalesce(c, F.lit("")) for c in ("page_url", "alt", "filename")})


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """old with the rows of new set over it; of several new rows for a key the one with the largest seq."""
    values = [c for c in old.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(seq) if seq else F.lit(0)).alias("__v")).select(*keys, "__v.*")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last.select(old.columns))


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks; an existing row never changes."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(old.columns))


def set_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """_id, link: the members of both sets. A set is one row for each member, so that no set must fit into one row."""
    return old.select("_id", "link").unionByName(new.select("_id", "link")).distinct()


def members_of(sets: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The members' rows of the sets with these keys."""
    return sets.join(keys.select(key).distinct(), key, "left_semi")


def updated_existing(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with the columns of matching rows replaced; rows of new that match nothing are not added."""
    fresh = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    out = old.join(fresh, keys, "left")
    return out.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns))


def without_consumed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def fresh_only(rows: DataFrame, written: Column, now: Column, ttl: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Rows written less than ttl ago."""
    return rows.where(written + F.expr(ttl) > now)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """One atomic write, partitioned on disk by low-cardinality columns."""
    (df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)).parquet(path)


def flattened_index(legacy: DataFrame) -> DataFrame:
    """word, url, tf, weight rows from the nested index (_id, pages array<struct<url, tf, weight>>); missing fields have defaults."""
    rows = legacy.select(F.col("_id").alias("word"), F.explode("pages").alias("p"))
    return rows.select("word", F.coalesce("p.url", F.lit("")).alias("url"), F.coalesce("p.tf", F.lit(0)).cast("bigint").alias("tf"), F.coalesce("p.weight", F.lit(0.0)).cast("double").alias("weight"))


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def size(data: bytes) -> tuple[int | None, int | None]:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
        at = 2
        while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
            if data[at + 1] in (0xC0, 0xC1, 0xC2, 0xC3):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return None, None

    for batch in batches:
        found = [size(bytes(x)) for x in batch["content"]]
        yield pd.DataFrame({"path": batch["path"], "width": pd.array([w for w, _ in found], "Int32"), "height": pd.array([h for _, h in found], "Int32")})


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height from the headers of PNG, GIF and JPEG files; null for others."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_sizes, "path string, width int, height int")

"""Seed sources: directory dumps (RDF/XML), CSV, JSON listings and comment trees; and the rules for what is kept."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import urls as U
from quern.functions.text import URL_IN_TEXT

# Topics that are taken, topics that are not, and categories by the first topic that fits
INCLUDED = ("Top/Arts", "Top/Computers", "Top/Science", "Top/Reference", "Top/News", "Top/Health", "Top/Society", "Top/Recreation/Photography")
EXCLUDED = ("Top/Adult", "Top/World", "Top/Shopping", "Top/Regional", "Top/Games")
CATEGORIES = (
    ("Top/Recreation/Photography", "Creative & Design"), ("Top/Arts", "Creative & Design"), ("Top/Computers", "Technology"), ("Top/Science", "Science & Learning"),
    ("Top/Reference", "Reference & Research"), ("Top/News", "Journalism & Fact-checking"), ("Top/Health", "Science & Learning"), ("Top/Society", "General"),
)
MIN_SCORE = 25
SEED_CSV = "url string, category string, priority string, source string, notes string"


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """url, title, description, topic of each ExternalPage of RDF/XML files, by local name.

    Files are split at the closing tag, so that a large dump is read by many tasks; bare ampersands are read as such and a broken record costs
    no other one.
    """
    rows = spark.read.option("lineSep", "ExternalPage>").text(path)
    body = F.regexp_extract("value", "(?s)<(?:[\\w.-]+:)?ExternalPage(\\s.*)$", 1)
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    child = lambda name: F.trim(plain(F.regexp_extract("__body", f"(?s)<(?:[\\w.-]+:)?{name}(?:\\s[^>]*)?>(.*?)</(?:[\\w.-]+:)?{name}>", 1)))
    rows = rows.select(body.alias("__body")).where(F.col("__body") != "")
    return rows.select(plain(F.regexp_extract("__body", "(?s)^[^>]*?(?:[\\w.-]+:)?about=[\"']([^\"']*)[\"']", 1)).alias("url"), child("Title").alias("title"), child("Description").alias("description"), child("topic").alias("topic"))


def read_seed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a seed CSV with defaults: priority 1, category General."""
    rows = spark.read.csv(path, header=True, schema=SEED_CSV)
    return rows.select("url", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("General")).alias("category"), F.coalesce(F.expr("try_cast(priority as int)"), F.lit(1)).alias("priority"), F.coalesce("source", F.lit("csv")).alias("source"))


def discovery_rows(seeds: DataFrame) -> DataFrame:
    return seeds.where(F.contains(F.lower("source"), F.lit("reddit")))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


POST = "struct<title:string,url:string,url_overridden_by_dest:string,score:bigint,subreddit:string,permalink:string,is_self:boolean>"


def _walk(node: object, out: list[str]) -> None:
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            data = x.get("data") if isinstance(x.get("data"), dict) else {}
            if x.get("kind") == "t3":
                out.append(json.dumps(data))
            stack += reversed(data.get("children") or [])


def _bodies(node: object, out: list[str]) -> None:
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            data = x.get("data") if isinstance(x.get("data"), dict) else x
            if body := data.get("body") or data.get("body_html"):
                out.append(str(body))
            stack += [y for y in (data.get("children"), data.get("replies")) if isinstance(y, (list, dict))]


def _each(walk, name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["json"], strict=True):
                found: list[str] = []
                try:
                    walk(json.loads(text), found)
                except (TypeError, ValueError):
                    continue
                rows += [(key, i, x) for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=["key", "seq", name])

    return run


def malformed(payloads: DataFrame) -> DataFrame:
    """key, reason of the payloads (key bigint, json) that listing_posts() and comment_urls() give no rows for: missing, or no JSON."""
    reason = F.when(F.coalesce(F.trim("json"), F.lit("")) == "", "missing_payload").when(F.expr("try_parse_json(json)").isNull(), "invalid_json")
    return payloads.select("key", reason.alias("reason")).where("reason is not null")


def listing_posts(payloads: DataFrame) -> DataFrame:
    """key, seq and the fields of POST of the posts of JSON listings (key bigint, json), depth first; malformed() names the payloads that are none."""
    found = payloads.select("key", "json").mapInPandas(_each(_walk, "post"), "key bigint, seq bigint, post string")
    return found.select("key", "seq", F.from_json("post", POST).alias("p")).select("key", "seq", "p.*")


def comment_urls(payloads: DataFrame) -> DataFrame:
    """key, seq, url: URLs in comments at any depth of JSON trees (key bigint, json)."""
    found = payloads.select("key", "json").mapInPandas(_each(_bodies, "body"), "key bigint, seq bigint, body string")
    return found.select("key", "seq", F.explode(F.regexp_extract_all("body", F.lit(URL_IN_TEXT), F.lit(0))).alias("url"))


def topic_allowed(topic: Column) -> Column:
    some = lambda prefixes: F.array_max(F.array(*(F.startswith(topic, F.lit(p)) for p in prefixes)))
    return ~some(EXCLUDED) & some(INCLUDED)


def category_of(topic: Column) -> Column:
    out = F.lit("General")
    for prefix, name in reversed(CATEGORIES):
        out = F.when(F.startswith(topic, F.lit(prefix)), name).otherwise(out)
    return out


def directory_reason(topic: Column, title: Column, url: Column) -> Column:
    """Why a directory record is not kept; null if it is."""
    return F.when(F.coalesce(topic, F.lit("")) == "", "missing_topic").when(~topic_allowed(topic), "excluded_category").when(F.coalesce(title, F.lit("")) == "", "missing_title").when(U.canonical(url).isNull(), "invalid_url")


def kept_posts(posts: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Posts of enough score that point elsewhere, with their canonical URL; blocked and invalid ones go."""
    rows = posts.where((F.coalesce("score", F.lit(0)) >= min_score) & ~F.coalesce("is_self", F.lit(False)))
    return rows.withColumn("canonical", U.canonical_outbound(F.coalesce(F.nullif(F.col("url_overridden_by_dest"), F.lit("")), "url") if "url_overridden_by_dest" in posts.columns else F.col("url"))).where("canonical is not null")


def first_of_each(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key in the order of seq."""
    least = rows.groupBy(key).agg(F.min(seq).alias("__first"))
    return rows.join(least, key).where(F.col(seq) == F.col("__first")).drop("__first")


def queue_score(priority: Column) -> Column:
    return F.greatest(priority - 1, F.lit(0))


def depth_score(queued: Column, depth: Column) -> Column:
    """A queued URL keeps its score; a new one has its depth + 1; within -1000 and 10000."""
    return F.least(F.greatest(F.coalesce(queued, depth + 1), F.lit(-1000)), F.lit(10000))


def seed_rows(rows: DataFrame) -> DataFrame:
    """Rows of the seed table from url, category, priority, title, score, subreddit, permalink."""
    canonical = U.canonical_outbound(F.col("url"))
    return rows.withColumn("url", canonical).where("url is not null").select(U.page_key(F.col("url")).alias("_id"), "url", F.lit("reddit_json").alias("source"), "category", "priority", "score", F.lit("pending_crawl").alias("status"), F.struct("title", "score", "subreddit", "permalink").alias("listing"))

"""Index build: tokens, postings, dictionary, metadata, parsed pages, links, images."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U

MAX_WORDS = 1000
#: Postings that a worker gives back at once.
PART_ROWS = 20_000


def tokens_of(docs: DataFrame) -> DataFrame:
    """url, word, pos of documents (url, text), without stop words."""
    return docs.select("url", F.posexplode(T.words(F.col("text"))).alias("pos", "word")).where(~F.col("word").isin(*T.STOP_WORDS)).select("url", "word", "pos")


def term_frequency(tokens: DataFrame) -> DataFrame:
    """url, word, tf, first_pos."""
    return tokens.groupBy("url", "word").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def postings(tokens: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """url, word, tf of each page's most frequent words; ties by first place. Spark cuts each page's words before the shuffle."""
    w = Window.partitionBy("url").orderBy(F.desc("tf"), "first_pos")
    return term_frequency(tokens).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("url", "word", "tf")


class _Counted:
    """url, word, tf of each page (url, text in lower case): its most frequent words, ties by first place."""

    def __init__(self, most: int) -> None:
        self.most, self.stops = most, frozenset(T.STOP_WORDS)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(T.WORD).findall
        for batch in batches:
            rows, words, times = [], [], []
            for i, text in enumerate(batch.column("text")):
                found = Counter(find(text.as_py() or ""))  # in the order of first places
                own = [x for x in found.items() if x[0] not in self.stops]
                if len(own) > self.most:
                    own = sorted(own, key=lambda x: -x[1])[: self.most]
                rows += [i] * len(own)
                words += [w for w, _ in own]
                times += [n for _, n in own]
                if len(rows) > PART_ROWS:
                    yield self.part(batch, rows, words, times)
                    rows, words, times = [], [], []
            if rows:
                yield self.part(batch, rows, words, times)

    @staticmethod
    def part(batch: pa.RecordBatch, rows: list[int], words: list[str], times: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("url").take(pa.array(rows, pa.int32())), pa.array(words, pa.string()), pa.array(times, pa.int64())], ["url", "word", "tf"])


def page_postings(docs: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """postings(tokens_of(docs)) of documents (url, text). Where each url is one row, as it is counted first, a row's words are counted in place and nothing is shuffled."""
    if docs.groupBy("url").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return postings(tokens_of(docs), most)
    return docs.select("url", F.lower("text").alias("text")).mapInArrow(_Counted(most), "url string, word string, tf bigint")


def dictionary(tokens: DataFrame) -> DataFrame:
    return tokens.select("word").distinct()


def url_boosted(words: DataFrame, pages: DataFrame) -> DataFrame:
    """url, word, tf: postings with the terms of the URL itself weighed up or added."""
    named = pages.select("url", F.explode(T.split_url(F.col("url"))).alias("word")).groupBy("url", "word").agg(F.count("*").alias("times"))
    return words.join(named, ["url", "word"], "full").select("url", "word", T.boosted(F.col("tf"), F.coalesce("times", F.lit(0))).alias("tf"))


def page_fields(parsed: DataFrame) -> DataFrame:
    """page_id, url, title, description, text, summary_text of parsed pages."""
    meta = lambda k: F.when(F.col("meta")[k] != "", F.col("meta")[k])
    text = T.paragraph_text(F.col("paragraphs"))
    return parsed.select("page_id", "url", F.coalesce(meta("og:title"), meta("title")).alias("title"), F.coalesce(meta("og:description"), meta("description")).alias("description"), text.alias("text"), T.summary(text).alias("summary_text"))


def link_targets(parsed: DataFrame) -> DataFrame:
    """page_id, url, link: each distinct admissible target of a page, resolved and stripped."""
    rows = parsed.select("page_id", "url", F.explode(F.array_distinct("hrefs")).alias("href")).where(U.is_admissible(F.col("href")))
    return rows.select("page_id", "url", U.stripped(U.resolved(F.col("url"), F.col("href"))).alias("link")).where("link is not null").distinct()


def without_loops(edges: DataFrame) -> DataFrame:
    """src, dst: distinct links without a page's links to itself and links with a null end."""
    return edges.where("src <> dst").select("src", "dst").distinct()


def page_edges(links: DataFrame) -> DataFrame:
    """src, dst: links between normalised pages, without a page's links to itself."""
    rows = links.where(U.is_valid(F.col("link"))).select(U.normalized(F.col("url")).alias("src"), U.normalized(F.col("link")).alias("dst"))
    return without_loops(rows)


def image_table(parsed: DataFrame) -> DataFrame:
    """page_id, src, alt: the last image of each source on a page; without a source there is no image."""
    rows = parsed.select("page_id", F.posexplode("images").alias("pos", "image")).select("page_id", "pos", "image.src", "image.alt").where(U.is_admissible(F.col("src")) & (F.col("src") != ""))
    return rows.groupBy("page_id", "src").agg(F.max_by("alt", "pos").alias("alt"))


def keyword_fallback(metadata: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """url, word, tf counted from title, description and summary where a page has no postings."""
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "description", "summary_text")))
    return postings(tokens_of(metadata.select("url", text.alias("text"))), most)


def unchanged_removed(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming pages (url, last_crawled) whose time differs from the stored one."""
    old = stored.select("url", F.col("last_crawled").alias("__old"))
    return incoming.join(old, "url", "left").where(~F.col("last_crawled").eqNullSafe(F.col("__old"))).drop("__old")


def usable_images(images: DataFrame, least: int = 100) -> DataFrame:
    """Images of at least so many pixels each way that are no SVG and no icons."""
    name = T.filename(F.col("image_url"))
    return images.where((F.col("width") >= least) & (F.col("height") >= least) & (T.extension(name) != "svg") & ~F.col("image_url").contains("icons"))


def image_terms(images: DataFrame, keywords: DataFrame, boost_wins: bool = True, terms: list[str] | None = None) -> DataFrame:
    """word, image_url, weight: an image gets its page's keywords, and its name's words 100-fold, or 30 where the page lacks them.

    boost_wins: the name's weight replaces the page's; else the page's stays. terms: only these words; keywords then holds no others.
    Where each image_url is one row of images and each word one of a page, as is counted first, every pair is made once and only images and keywords are shuffled.
    """
    own = images.select("page_url", "image_url", F.array_distinct(T.split_name(F.col("filename"))).alias("__names"))
    if terms is not None:
        own = own.withColumn("__names", F.filter("__names", lambda x: x.isin(terms) if terms else F.lit(False)))
    words = keywords.select(F.col("url").alias("page_url"), "word", "tf")
    once = not images.groupBy("image_url").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    page = own.join(words, "page_url").select("word", "image_url", F.col("tf").cast("double").alias("weight"), F.when(F.array_contains("__names", F.col("word")), F.col("tf") * 100).cast("double").alias("boost"))
    named = own.select("page_url", "image_url", F.explode("__names").alias("word"))
    lacked = named.join(words, ["page_url", "word"], "left_anti").select("word", "image_url", F.lit(None).cast("double").alias("weight"), F.lit(30.0).alias("boost"))
    first, second = ("boost", "weight") if boost_wins else ("weight", "boost")
    both = page.unionByName(lacked)
    if once:
        return both.select("word", "image_url", F.coalesce(first, second).alias("weight"))
    return both.groupBy("word", "image_url").agg(F.coalesce(F.max(first), F.max(second)).alias("weight"))

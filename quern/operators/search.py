"""Page and image search, suggestions, search log, spelling, link neighbourhood."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.ranking import blended

PER_PAGE, MOST_PER_PAGE = 20, 100


def terms_of(spark: SparkSession, q: str) -> DataFrame:
    """word: the distinct terms of one query, a few rows."""
    return spark.range(1).select(F.explode(T.query_terms(F.lit(q))).alias("word"))


def query_words(q: str) -> list[str]:
    return sorted({t for t in q.replace("+", " ").lower().split(" ") if t})


def matches(weights: DataFrame, q: str) -> DataFrame:
    """Postings of a query's terms; the terms reach the scan as a filter."""
    terms = query_words(q)
    return weights.where(F.col("word").isin(terms) if terms else F.lit(False))


def relevance(found: DataFrame, key: str = "url") -> DataFrame:
    """key, cum_weight, match_count, matched: by page, the weights and the distinct terms that matched."""
    return found.groupBy(key).agg(F.sum("weight").alias("cum_weight"), F.count("*").alias("match_count"), F.array_sort(F.collect_set("word")).alias("matched"))


def paged(df: DataFrame, order: list[Column], page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page of rows. Spark takes the top rows of each task before it merges them."""
    return df.orderBy(*order).offset((max(page, 1) - 1) * per_page).limit(per_page)


def page_info(df: DataFrame, page: Column | int, per_page: int) -> DataFrame:
    """total, per_page, current_page, last_page (1 at least)."""
    last = F.greatest(F.ceil(F.col("total") / per_page), F.lit(1)).cast("bigint")
    return df.agg(F.count("*").alias("total")).select("total", F.lit(per_page).cast("bigint").alias("per_page"), F.lit(page).cast("bigint").alias("current_page"), last.alias("last_page"))


def pager_end(total: Column) -> Column:
    """How many pages the pager offers: 2 to 10."""
    return F.greatest(F.least(F.ceil(total / PER_PAGE), F.lit(10)), F.lit(2)).cast("bigint")


def _page(hits: DataFrame, key: str, page: int, per_page: int) -> tuple[DataFrame, list[str]]:
    """One page of hits as a small table, and its keys; at most MOST_PER_PAGE rows come to the driver, more are refused."""
    if not 1 <= per_page <= MOST_PER_PAGE:
        raise ValueError(f"per_page is {per_page}, not 1 to {MOST_PER_PAGE}")
    cut = paged(hits, [F.desc("match_count"), F.desc("cum_weight"), F.asc(key)], page, per_page).select(key, "cum_weight", "match_count")
    rows = cut.collect()
    return hits.sparkSession.createDataFrame(rows, cut.schema), [r[key] for r in rows]


def _of(table: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """The rows of a table for a few keys: a filter that reaches the scan. The result is broadcast; keys are unique in the table."""
    return F.broadcast(table.where(F.col(key).isin(keys) if keys else F.lit(False)))


def search(weights: DataFrame, metadata: DataFrame, rank: DataFrame, q: str, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page of results. The page is cut by matches and weight; the rank only orders the rows within it."""
    cut, urls = _page(relevance(matches(weights, q)), "url", page, per_page)
    out = cut.join(_of(metadata, "url", urls), "url", "left").join(_of(rank.select(F.col("node").alias("url"), "rank"), "url", urls), "url", "left")
    score = blended(F.col("cum_weight"), F.col("rank"))
    return out.select("url", "match_count", "cum_weight", F.coalesce("rank", F.lit(0.0)).alias("rank"), score.alias("combined"), F.coalesce("title", F.lit("")).alias("title"), T.snippet(F.coalesce("description", "summary_text", F.lit("")), 200).alias("snippet"))


def image_search(word_images: DataFrame, images: DataFrame, metadata: DataFrame, q: str, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page of images by matches and weight, with their pages' titles."""
    cut, urls = _page(relevance(matches(word_images, q), "image_url"), "image_url", page, per_page)
    about = cut.join(_of(images, "image_url", urls), "image_url", "left")
    titles = F.broadcast(metadata.select(F.col("url").alias("page_url"), "title").join(F.broadcast(_of(images, "image_url", urls).select("page_url").distinct()), "page_url", "left_semi"))  # the page's rows
    return about.join(titles, "page_url", "left").select("image_url", "match_count", "cum_weight", F.coalesce("page_url", F.lit("")).alias("page_url"), F.coalesce("alt", F.lit("")).alias("alt"), F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("title", F.lit("")).alias("page_title"))


def search_counts(log: DataFrame) -> DataFrame:
    """term, times: searches by trimmed term in lower case."""
    return log.groupBy(F.lower(F.trim("q")).alias("term")).agg(F.count("*").alias("times"))


def top_searches(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("times"), "term").limit(n)


def suggestions(counts: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    return top_searches(counts.where(F.startswith(F.lower("term"), F.lit(prefix.lower()))), n)


def corrected(terms: DataFrame, words: DataFrame) -> DataFrame:
    """term, correction, distance: a dictionary word stays; else the nearest word of like beginning and length; else null.

    Candidates are blocked by length and by the term's beginning of n - 2 letters (1 up to 3 letters). Each term probes the three lengths; a
    word is dealt out by its length and its beginnings, so no pair outside a block meets.
    """
    t = terms.select("term").distinct().withColumn("n", F.char_length("term")).where("n > 0")
    t = t.withColumn("head", F.lower(F.left("term", F.when(F.col("n") > 3, F.col("n") - 2).otherwise(1))))
    probes = t.withColumn("size", F.explode(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1)))
    w = words.select("word").distinct().withColumn("size", F.char_length("word"))
    # a term of n letters begins with n - 2 (or 1), and words have n - 1 to n + 1: heads of size - 3 to size - 1 letters
    w = w.withColumn("cut", F.explode(F.array_distinct(F.array(F.lit(1), F.greatest(F.col("size") - 3, F.lit(1)), F.greatest(F.col("size") - 2, F.lit(1)), F.greatest(F.col("size") - 1, F.lit(1))))))
    w = w.select("word", "size", F.lower(F.left("word", F.col("cut"))).alias("head")).distinct()
    most = F.when(F.col("n") <= 4, 1).otherwise(F.least(F.lit(2), F.floor(F.col("n") / 4)).cast("int"))
    near = probes.join(w, ["head", "size"]).withColumn("distance", F.levenshtein("term", "word")).where(F.col("distance") <= most)
    best = near.groupBy("term").agg(F.min(F.struct("distance", "word")).alias("best"))
    return t.select("term").join(best, "term", "left").select("term", F.col("best.word").alias("correction"), F.col("best.distance").alias("distance"))


def corrected_query(spark: SparkSession, q: str, words: DataFrame) -> DataFrame:
    """query, changed: a query with its terms corrected in their order; blanks are skipped."""
    parts = spark.range(1).select(F.posexplode(F.split(F.lower(F.replace(F.lit(q), F.lit("+"), F.lit(" "))), " ")).alias("pos", "term")).where("term <> ''")
    both = parts.join(corrected(parts, words), "term", "left").withColumn("now", F.coalesce("correction", "term"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "now"))), lambda x: x["now"])  # a query's terms
    return both.agg(F.array_join(ordered, " ").alias("query"), F.coalesce(F.bool_or(F.col("now") != F.col("term")), F.lit(False)).alias("changed"))


def corrected_queries(queries: DataFrame, words: DataFrame) -> DataFrame:
    """id, query, changed for each query (id, q): its terms corrected in their order; blanks are skipped. Each distinct term is looked up once."""
    parts = queries.select("id", F.posexplode(F.split(F.lower(F.replace("q", F.lit("+"), F.lit(" "))), " ")).alias("pos", "term")).where("term <> ''")
    both = parts.join(corrected(parts, words).select("term", "correction"), "term", "left").withColumn("now", F.coalesce("correction", "term"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "now"))), lambda x: x["now"])  # one query's terms
    return both.groupBy("id").agg(F.array_join(ordered, " ").alias("query"), F.bool_or(F.col("now") != F.col("term")).alias("changed"))


def did_you_mean(query: Column, changed: Column) -> Column:
    """TX22: the text that is offered when a term was changed, else null."""
    return F.when(changed, query)


def asked(spark: SparkSession, words: DataFrame, q: str, spell: bool = True) -> tuple[str, bool]:
    """A query as it is searched, with its terms corrected, and whether one was changed."""
    row = corrected_query(spark, q, words).first() if spell else None  # one row
    return (row["query"], row["changed"]) if row else (" ".join(q.lower().replace("+", " ").split()), False)


def logged(spark: SparkSession, query: str) -> DataFrame:
    """q: the row that a search adds to the log; none for an empty one."""
    return spark.range(1).select(F.lit(query).alias("q")).where("trim(q) <> ''")


def answer(spark: SparkSession, weights: DataFrame | Callable[[str], DataFrame], metadata: DataFrame, rank: DataFrame, words: DataFrame, q: str, page: int = 1, spell: bool = True) -> tuple[DataFrame, DataFrame]:
    """A search as one request: its terms are corrected, the page is cut and ordered, and the search is logged.

    weights: all postings, or a function that gives those of a query. The results have query and changed, and did_you_mean where a term was
    changed; the log has one row with the corrected query, none for an empty one.
    """
    query, changed = asked(spark, words, q, spell)
    found = search(weights(query) if callable(weights) else weights, metadata, rank, query, page).withColumns({"query": F.lit(query), "changed": F.lit(changed)})
    return found.withColumn("did_you_mean", did_you_mean(F.col("query"), F.col("changed"))), logged(spark, query)


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, drawn by a hash of seed and key, so that the same seed draws the same rows on any cluster. Spark keeps the first n of each task."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def neighbours(edges: DataFrame, metadata: DataFrame, url: str) -> DataFrame:
    """url, title, role of the pages that a page links to (outlink), that link to it (backlink), or both; and of itself (main)."""
    out = edges.where(F.col("src") == url).select(F.col("dst").alias("url"), F.lit(True).alias("out"))
    back = edges.where(F.col("dst") == url).select(F.col("src").alias("url"), F.lit(True).alias("back"))
    role = F.when(F.col("url") == url, "main").when(F.col("out") & F.col("back"), "both").when(F.col("out"), "outlink").otherwise("backlink")
    nodes = out.distinct().join(back.distinct(), "url", "full").select("url", role.alias("role")).where(F.col("url") != url)
    nodes = nodes.unionByName(edges.sparkSession.range(1).select(F.lit(url).alias("url"), F.lit("main").alias("role")))
    return nodes.join(metadata.select("url", "title"), "url", "left").select("url", F.coalesce("title", F.lit("Page Not Indexed")).alias("title"), "role")


def frontier(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """url, score: pages in the order in which a crawl from start (url) of some depth finds them. Each round joins the last one's finds."""
    from quern.operators.ranking import saved

    known = start.select("url").distinct().withColumn("score", F.lit(0))
    last = known
    for d in range(1, depth + 1):
        found = edges.join(last.withColumnRenamed("url", "src"), "src").select(F.col("dst").alias("url")).distinct().join(known, "url", "left_anti")
        last = saved(found.withColumn("score", F.least(F.greatest(F.lit(d), F.lit(-1000)), F.lit(10000))), "found")
        known = known.unionByName(last)
    return known


def daily_total(log: DataFrame) -> DataFrame:
    """start, total: searches since the last pause of a day; a search within a day of the last goes on with its count.

    A pause of 24 hours cannot lie within one calendar day: so days with their first and last search are enough, and only these, a
    few thousand in years of any traffic, are put in one order.
    """
    days = log.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    w = Window.orderBy("day")
    begins = F.coalesce(F.col("first") - F.lag("last").over(w) >= F.expr("INTERVAL 24 HOURS"), F.lit(True))
    marked = days.withColumn("begins", begins.cast("int")).withColumn("session", F.sum("begins").over(w))
    return marked.groupBy("session").agg(F.min("first").alias("start"), F.sum("n").alias("total")).select("start", "total")

"""The crawl-to-index plan: pages to postings, weights, links and ranks, each a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.html import parse_pages
from quern.operators import indexing as I
from quern.operators.ranking import page_rank, saved, tf_idf


def build(pages: DataFrame, lang: DataFrame | None = None) -> dict[str, DataFrame]:
    """words, metadata, edges (src, dst: a page's outlinks and, seen from dst, backlinks), pagerank of pages (page_id, url, html).

    lang (page_id, lang): where given, only English pages are indexed and become nodes. Pages are parsed once; a page without words is not
    indexed, one without links is no node.
    """
    parsed = saved(parse_pages(pages), "parsed")
    if lang is not None:
        parsed = parsed.join(lang.where("lang = 'en'").select("page_id"), "page_id", "left_semi")
    fields = I.page_fields(parsed)
    words = saved(I.postings(I.tokens_of(fields)), "words")
    edges = saved(I.page_edges(I.link_targets(parsed)), "edges")
    nodes = edges.select(F.col("src").alias("node")).distinct()
    metadata = fields.join(words.select("url").distinct(), "url", "left_semi").select("url", "title", "description", "summary_text")
    return {"words": tf_idf(words, metadata), "metadata": metadata, "edges": edges, "pagerank": page_rank(edges, nodes)}


def publish(rows: DataFrame, folder: str, files: int | None = None, keys: tuple[str, ...] = ("word", "url")) -> None:
    """Writes rows in ranges of keys, sorted within files: a filter on the first key then skips all files and row groups that cannot have its values.

    A word on very many pages spans several files, as the range of postings is cut by word and page.
    """
    n = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(folder)

"""Tables of the search and community model, derived from the driver's tables.

Every binding is SQL that Spark and DuckDB read alike, with other bindings or driver tables in braces; where the engines differ, there is
a DataFrame for Spark beside it. So a query can be compared between the engines on the same input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import STOP_WORDS
from quern.operators.indexing import dictionary, page_postings, tokens_of

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: SQL that both engines read.
SQL = {
    "english": "SELECT concat('doc/', doc_id) AS url, doc_id, text FROM {documents} WHERE lang = 'en'",
    "metadata": "SELECT url, doc_id, split_part(text, chr(10), 1) AS title, CAST(NULL AS STRING) AS description, array_join(slice(regexp_extract_all(text, '\\\\S+', 0), 1, 500), ' ') AS summary_text FROM {english}",
    "edges": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey",
    "word_edges": "SELECT concat('doc/', src - 1) AS src, concat('doc/', dst - 1) AS dst FROM {edges}",
    "images": "SELECT concat(replace(p_name, ' ', '-'), '-', p_partkey % 7, '00px.', CASE WHEN p_partkey % 11 = 0 THEN 'svg' WHEN p_partkey % 2 = 0 THEN 'png' ELSE 'jpg' END) AS filename, concat('img.example.org/', CASE WHEN p_partkey % 13 = 0 THEN 'icons/' ELSE 'a/' END, p_partkey, '/', replace(p_name, ' ', '-'), '.', CASE WHEN p_partkey % 11 = 0 THEN 'svg' ELSE 'png' END) AS image_url, concat('doc/', p_partkey % 997) AS page_url, CASE WHEN p_partkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE p_type END AS alt, p_size * 10 AS width, (p_size * 7) % 400 AS height FROM {part}",
    "searches": "SELECT event_id, concat(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '' END, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END, ' ', user_id % 30) AS q, ts FROM {events}",
    "users": "SELECT c_custkey AS user_id, c_name AS name FROM {customer}",
    "memberships": "SELECT CAST(c_nationkey AS BIGINT) AS community_id, c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 THEN 'owner' WHEN c_custkey % 10 = 0 THEN 'moderator' ELSE 'member' END AS role FROM {customer}",
    "communities": "SELECT CAST(n_nationkey AS BIGINT) AS community_id, n_name AS name, lower(n_name) AS slug, n_regionkey = 0 AS is_private, CAST(n_nationkey % 6 AS BIGINT) AS member_count, CAST(n_nationkey AS BIGINT) AS created_at FROM {nation}",
    "posts": "SELECT o.o_orderkey AS post_id, CAST(c.c_nationkey AS BIGINT) AS community_id, CASE WHEN o.o_orderkey % 19 = 0 THEN CAST(NULL AS BIGINT) ELSE o.o_custkey END AS author_id, concat('Order of ', c.c_mktsegment, ' No. ', o.o_orderkey % 23, '!') AS title, concat('https://example.org/p/', o.o_orderkey % 500) AS url, (o.o_orderstatus = 'F' AND o.o_orderkey % 7 = 0) AS is_removed, o.o_orderkey % 11 = 0 AS is_locked, o.o_orderkey % 41 - 5 AS score, o.o_orderkey % 13 AS comment_count, o.o_orderkey % 29 AS upvote_count, o.o_orderdate AS published_at FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey",
    "comments": "SELECT conv_id * 100 + turn AS comment_id, conv_id AS post_id, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 - (conv_id + turn) % 2 * (turn - 1) END AS parent_id, substr(text, 1, 40) AS body, conv_id % 17 = 0 AND turn = 1 AS is_removed, conv_id % 23 = 0 AS is_locked, turn AS created_at FROM {conversations}",
    "votes": "SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'comment' ELSE 'post' END AS target_type, event_id % 200 AS target_id, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS value, ts FROM {events} WHERE event_type <> 'signup'",
    "reports": "SELECT o_orderkey AS report_id, o_custkey AS reporter_id, o_custkey % 25 AS community_id, CASE WHEN o_orderkey % 4 = 0 THEN 'comment' ELSE 'post' END AS target_type, o_orderkey % 500 AS target_id, CASE o_orderkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'dismissed' END AS status, o_orderdate AS created_at FROM {orders} WHERE o_orderpriority LIKE '1%'",
    "actions": "SELECT event_id AS action_id, user_id AS actor_id, user_id % 25 AS community_id, CASE WHEN event_id % 4 = 0 THEN 'comment' ELSE 'post' END AS target_type, event_id % 500 AS target_id, CASE WHEN event_id % 3 = 0 THEN 'lock' ELSE 'remove' END AS action, CASE WHEN event_id % 2 = 0 THEN event_id END AS report_id, ts FROM {events} WHERE event_type = 'error'",
    "seeds": "SELECT concat('https://www.', lower(c_mktsegment), '.example.org/s/', c_custkey % 400, CASE WHEN c_custkey % 3 = 0 THEN '/' ELSE '' END) AS url, CASE c_custkey % 7 WHEN 0 THEN 'Top/Adult/X' WHEN 1 THEN 'Top/Arts/Music' WHEN 2 THEN 'Top/Science' WHEN 3 THEN '' WHEN 4 THEN 'Top/Sports' WHEN 5 THEN 'Top/Recreation/Photography/Film' ELSE 'Top/News' END AS topic, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS title, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 5 END AS priority, CASE WHEN c_custkey % 5 = 0 THEN 'manual_reddit_discovery' ELSE 'manual' END AS source, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'General' END AS category, c_custkey AS seq, CASE WHEN c_custkey % 2 = 0 THEN 'pending_crawl' ELSE 'queued' END AS status FROM {customer}",
    "listing": "SELECT event_id AS seq, CAST(floor(value) AS BIGINT) AS score, event_id % 6 = 0 AS is_self, concat(CASE WHEN event_id % 5 = 0 THEN 'https://www.reddit.com' WHEN event_id % 7 = 0 THEN 'https://old.reddit.com' ELSE 'https://blog.example.net' END, '/r/', user_id, CASE WHEN event_id % 9 = 0 THEN ').' ELSE '' END) AS url, event_type AS subreddit FROM {events}",
    "links": "SELECT page_id, url FROM {pages}",
}

#: DuckDB's form of the bindings that Spark builds with DataFrame functions.
DUCKDB = {
    "metadata": "SELECT url, doc_id, split_part(text, chr(10), 1) AS title, CAST(NULL AS VARCHAR) AS description, array_to_string(regexp_extract_all(text, '\\S+')[1:500], ' ') AS summary_text FROM {english}",
    "tokens": f"SELECT url, word, pos FROM (SELECT url, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT url, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {{english}})) WHERE word NOT IN ({_STOPS})",
    "words": "SELECT url, word, tf FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY tf DESC, first_pos) AS r FROM (SELECT url, word, count(*) AS tf, min(pos) AS first_pos FROM {tokens} GROUP BY url, word)) WHERE r <= 1000",
    "weights": "SELECT w.url, w.word, w.tf, d.idf, w.tf * d.idf AS weight FROM {words} w JOIN (SELECT word, log10((SELECT count(*) FROM {metadata})::DOUBLE / (1 + count(*))) AS idf FROM {words} GROUP BY word) d USING (word)",
    "dictionary": "SELECT DISTINCT word FROM {tokens}",
    "misspelled": "SELECT word, substr(word, 1, length(word) - 1) AS term FROM (SELECT word, row_number() OVER (ORDER BY word) AS r FROM {dictionary} WHERE length(word) >= 5) WHERE r % 50 = 0",
}


def inlined(sql: str) -> str:
    """DuckDB SQL with bindings put in the place of their names."""
    def put(m: re.Match) -> str:
        name = m[1]
        return name if name in DRIVER_TABLES else f"({inlined(DUCKDB.get(name) or SQL[name])})"

    return re.sub(r"\{(\w+)\}", put, sql)


class Tables:
    """Driver tables and bindings of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.known = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.known:
            self.known[name] = self._made(name)
        return self.known[name]

    def asked(self, sql: str) -> DataFrame:
        """The rows of SQL with bindings in braces."""
        return self.spark.sql(f"SELECT * FROM {sql}", **{x: getattr(self, x) for x in set(re.findall(r"\{(\w+)\}", sql))})

    def _made(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name == "tokens":
            return tokens_of(self.english)
        if name == "words":
            return page_postings(self.english)
        if name == "weights":
            from quern.operators.ranking import tf_idf

            return tf_idf(self.words, self.metadata)
        if name == "dictionary":
            return dictionary(self.tokens)
        if name == "misspelled":
            return self._misspelled()
        sql = SQL[name]
        return self.spark.sql(sql, **{x: getattr(self, x) for x in set(re.findall(r"\{(\w+)\}", sql))})

    def _misspelled(self) -> DataFrame:
        """Every 50th word of at least 5 letters without its last letter. Words are numbered by beginnings, whose counts say where each one's numbers begin."""
        words = self.dictionary.where("char_length(word) >= 5").withColumn("head", F.left("word", F.lit(3)))
        heads = words.groupBy("head").agg(F.count("*").alias("n"))
        begins = heads.withColumn("begin", F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
        numbered = words.join(begins, "head").withColumn("r", F.col("begin") + F.row_number().over(Window.partitionBy("head").orderBy("word")))
        return numbered.where("r % 50 = 0").select("word", F.expr("substr(word, 1, char_length(word) - 1)").alias("term"))

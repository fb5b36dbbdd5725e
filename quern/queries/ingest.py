"""Sources, seeds, sinks, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.bindings import Tables
from quern.functions import urls as U
from quern.operators import search as S
from quern.operators.ranking import linked_pages, page_rank, saved
from quern.queries.registry import query, rank_sql
from quern.session import is_folder, new_folder
from quern.sources import seeds as D
from quern.sources import tables as W
from quern.streaming import jobs as J


_REASON = "CASE WHEN topic = '' THEN 'missing_topic' WHEN topic IN ('Top/Adult/X', 'Top/Sports') THEN 'excluded_category' WHEN title = '' THEN 'missing_title' END"


@query("SRC1", "SELECT page_id FROM {pages} WHERE page_id % 5 < 2 AND page_id % 3 <> 1")
def src1(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", (200 + F.col("page_id") % 5 * 100).alias("status"), F.when(F.col("page_id") % 3 == 1, "image/png").otherwise("text/html; charset=utf-8").alias("content_type"))
    return W.fetched(rows).select("page_id")


@query("SRC2", "SELECT url, title, topic FROM {seeds}")
def src2(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "dump")
    amp = lambda c: F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
    record = F.concat(F.lit('<ExternalPage about="'), amp("url"), F.lit('">\n  <d:Title>'), amp("title"), F.lit("</d:Title>\n  <d:Description>x & y</d:Description>\n  <topic>"), amp("topic"), F.lit("</topic>\n</ExternalPage>"))
    t.seeds.select(record).write.text(path)
    return D.read_directory(t.spark, path).select("url", "title", "topic")


@query("SRC3", "SELECT url, coalesce(category, 'General') AS category, coalesce(priority, 1)::INT AS priority, source FROM {seeds}")
def src3(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "csv")
    t.seeds.select("url", "category", "priority", "source", F.lit("").alias("notes")).write.option("header", True).csv(path)
    return D.read_seed_csv(t.spark, path)


@query("SRC4", "SELECT url, seq FROM {seeds} WHERE contains(lower(source), 'reddit')")
def src4(t: Tables) -> DataFrame:
    return D.discovery_rows(t.seeds).select("url", "seq")


@query("SRC5", "SELECT event_id, event_type FROM {events}")
def src5(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "json")
    t.events.select("event_id", "event_type").write.json(path)
    return t.spark.read.schema("event_id bigint, event_type string").json(path)


def _payloads(t: Tables) -> DataFrame:
    """Listings of 100 posts each, one level deeper in every other one."""
    child = F.struct(F.when(F.col("seq") % 10 == 3, "t1").otherwise("t3").alias("kind"), F.struct(F.col("subreddit").alias("title"), "url", "score", "is_self", F.col("seq").cast("string").alias("permalink")).alias("data"))
    rows = t.listing.groupBy((F.col("seq") % 100).alias("key")).agg(F.collect_list(child).alias("children"))
    return rows.select("key", F.to_json(F.struct(F.lit("Listing").alias("kind"), F.struct("children").alias("data"))).alias("json"))


@query("SRC6", "SELECT seq, score FROM {listing} WHERE seq % 10 <> 3")
def src6(t: Tables) -> DataFrame:
    return D.listing_posts(_payloads(t)).select(F.col("permalink").cast("bigint").alias("seq"), "score")


def _threads(t: Tables) -> DataFrame:
    leaf = F.struct(F.concat(F.lit("see https://a.example.org/"), "event_id", F.lit(" and (http://b.example.org)")).alias("body"))
    return t.events.select(F.col("event_id").alias("key"), F.to_json(F.struct(F.lit("Listing").alias("kind"), F.struct(F.array(F.struct(F.struct(F.lit("none").alias("body"), F.struct(F.struct(F.array(F.struct(leaf.alias("data"))).alias("children")).alias("data")).alias("replies")).alias("data"))).alias("children")).alias("data"))).alias("json"))


@query("SRC7", "SELECT event_id AS key, 'https://a.example.org/' || event_id AS url FROM {events} UNION ALL SELECT event_id, 'http://b.example.org' FROM {events}")
def src7(t: Tables) -> DataFrame:
    return D.comment_urls(_threads(t)).select("key", "url")


@query("GR7", "SELECT count(*) AS urls FROM {events}")
def gr7(t: Tables) -> DataFrame:
    return D.comment_urls(_threads(t)).where("url like 'https%'").agg(F.count("*").alias("urls"))


def _stored(t: Tables) -> DataFrame:
    return t.seeds.select(F.col("seq").alias("_id"), "url", F.coalesce("priority", F.lit(1)).alias("priority"), (F.col("seq") % 11).alias("discovered_at"), "status")


@query("SRC8", "SELECT seq AS _id FROM {seeds} WHERE status = 'pending_crawl' ORDER BY coalesce(priority, 1), seq % 11, seq LIMIT 40")
def src8(t: Tables) -> DataFrame:
    return W.by_status(_stored(t), "pending_crawl", 40).select("_id")


@query("SO14", "SELECT seq AS _id FROM {seeds} WHERE status = 'queued' ORDER BY coalesce(priority, 1), seq % 11, seq LIMIT 100")
def so14(t: Tables) -> DataFrame:
    return W.by_status(_stored(t), "queued", 100).select("_id")


@query("SRC9", "SELECT seq AS _id, url, status FROM {seeds}")
def src9(t: Tables) -> DataFrame:
    return saved(_stored(t), "collection").select("_id", "url", "status")


def _queue(t: Tables) -> DataFrame:
    return t.seeds.select(U.spider_key(F.col("url")).alias("url"), D.queue_score(F.coalesce("priority", F.lit(1))).alias("score")).groupBy("url").agg(F.min("score").alias("score"))


_QUEUE = "(SELECT regexp_replace(substr(url, 13), '/+$', '') AS url, min(greatest(coalesce(priority, 1) - 1, 0)) AS score FROM {seeds} GROUP BY 1)"


@query("SRC10", f"SELECT url, score, 'https://' || url AS raw_url FROM {_QUEUE} ORDER BY score, url LIMIT 25")
def src10(t: Tables) -> DataFrame:
    return W.popped(_queue(t), 25)


@query("SO13", f"SELECT url FROM {_QUEUE} ORDER BY score, url LIMIT 200")
def so13(t: Tables) -> DataFrame:
    return W.popped(_queue(t), 200).select("url")


@query("SRC11", "SELECT event_id FROM {events} ORDER BY event_id LIMIT 5")
def src11(t: Tables) -> DataFrame:
    return W.oldest(t.events.select("event_id"), "event_id", 5)


@query("SRC12", "SELECT e.event_id, c_name AS name FROM {events} e JOIN {customer} ON c_custkey = e.user_id")
def src12(t: Tables) -> DataFrame:
    return W.with_record(t.events.select("event_id", "user_id"), t.users, "user_id").select("event_id", "name")


@query("SRC13", "SELECT src, dst FROM {edges} WHERE src % 7 = 3")
def src13(t: Tables) -> DataFrame:
    # a set is stored as its members' rows
    return W.members_of(t.edges, t.part.where("p_partkey % 7 = 3").select(F.col("p_partkey").alias("src")), "src")


@query("SRC14", "SELECT event_type || user_id AS key, count(*) AS n FROM {events} WHERE event_id % 2 = 0 GROUP BY 1")
def src14(t: Tables) -> DataFrame:
    keys = t.events.select(F.concat(F.when(F.col("event_id") % 2 == 0, "backlinks:").otherwise("outlinks:"), "event_type", "user_id").alias("key"))
    return W.without_prefix(keys, "backlinks:").groupBy("key").agg(F.count("*").alias("n"))


@query("SRC15", "SELECT image_url, coalesce(alt, '') AS alt FROM {images}")
def src15(t: Tables) -> DataFrame:
    return W.image_defaults(t.images).select("image_url", "alt")


@query("SRC16", "SELECT page_id, url FROM {pages}")
def src16(t: Tables) -> DataFrame:
    return saved(t.pages.select("page_id", "url"), "staged")


@query("SRC17", "SELECT url, title FROM {metadata} WHERE url = 'doc/5'")
def src17(t: Tables) -> DataFrame:
    return W.point(t.metadata.select("url", "title"), "url", "doc/5")


# sinks
def _old(t: Tables) -> DataFrame:
    return t.users.where("user_id % 2 = 0").select("user_id", "name")


def _new(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.col("event_type").alias("name"), "event_id")


_LAST_NAME = "(SELECT user_id, arg_max(event_type, event_id) AS name FROM {events} GROUP BY user_id)"


@query("SNK1", f"SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.name, o.name) AS name FROM (SELECT * FROM {{users}} WHERE user_id % 2 = 0) o FULL JOIN {_LAST_NAME} n ON n.user_id = o.user_id")
def snk1(t: Tables) -> DataFrame:
    return W.upserted(_old(t), _new(t), ["user_id"], "event_id")


@query("SNK2", "SELECT user_id, name FROM {users}")
def snk2(t: Tables) -> DataFrame:
    return W.inserted_if_absent(_old(t), t.users, ["user_id"])


@query("SNK3", "SELECT dst AS _id, src AS link FROM {edges}")
def snk3(t: Tables) -> DataFrame:
    pairs = t.edges.select(F.col("dst").alias("_id"), F.col("src").alias("link"))
    return W.set_union(pairs.where("link % 2 = 0"), pairs.where("link % 3 <> 0").unionByName(pairs))


@query("SNK4", "SELECT count(*) AS n FROM {events}")
def snk4(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "bulk")
    W.write_table(t.events.select("event_id", "event_type"), path, ["event_type"])
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("SNK5", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type")
def snk5(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "flushed")
    W.write_table(t.events.select("event_id", "event_type"), path, ["event_type"])
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SNK6", "SELECT user_id AS url, arg_max(value, event_id) AS score FROM {events} GROUP BY user_id")
def snk6(t: Tables) -> DataFrame:
    empty = t.events.limit(0).select(F.col("user_id").alias("url"), F.col("value").alias("score"))
    return W.upserted(empty, t.events.select(F.col("user_id").alias("url"), F.col("value").alias("score"), "event_id"), ["url"], "event_id")


@query("SNK7", "SELECT seq AS _id, CASE WHEN seq IN (SELECT seq FROM {seeds} WHERE status = 'pending_crawl' ORDER BY coalesce(priority, 1), seq % 11, seq LIMIT 40) THEN 'queued' ELSE status END AS status FROM {seeds}")
def snk7(t: Tables) -> DataFrame:
    fed = W.by_status(_stored(t), "pending_crawl", 40).select("_id", F.lit("queued").alias("status"))
    return W.updated_existing(_stored(t).select("_id", "status"), fed, ["_id"], ["status"])


@query("SNK8", "SELECT event_id FROM {events} WHERE ts + INTERVAL 24 HOURS > TIMESTAMP '2024-01-20 00:00:00'")
def snk8(t: Tables) -> DataFrame:
    return W.fresh_only(t.events, F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "INTERVAL 24 HOURS").select("event_id")


@query("SNK9", "SELECT DISTINCT a.l_partkey AS src, b.l_suppkey AS dst FROM {lineitem} a JOIN {lineitem} b USING (l_orderkey) WHERE a.l_linenumber = 1")
def snk9(t: Tables) -> DataFrame:
    first = t.lineitem.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("src"))
    return first.join(t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("dst")), "l_orderkey").select("src", "dst").dropDuplicates(["src", "dst"])


@query("SNK10", "SELECT page_id, length(html) AS size FROM {pages}")
def snk10(t: Tables) -> DataFrame:
    return saved(t.pages, "pages").select("page_id", F.char_length("html").cast("bigint").alias("size"))


@query("SNK11", "SELECT event_id FROM {events} WHERE event_id % 3 <> 0")
def snk11(t: Tables) -> DataFrame:
    return W.without_consumed(t.events, t.events.where("event_id % 3 = 0"), "event_id").select("event_id")


@query("SNK12", rank_sql(2) + " SELECT node, round(rank, 10) AS rank FROM r2")
def snk12(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "pagerank")
    ranks = page_rank(*linked_pages(t.edges), 2)
    W.write_table(ranks, path)
    return t.spark.read.schema(ranks.schema).parquet(path).select("node", F.round("rank", 10).alias("rank"))


@query("SNK13", "SELECT word FROM {dictionary}")
def snk13(t: Tables) -> DataFrame:
    return saved(t.dictionary, "dictionary")


@query("SNK14", "SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM {events}) THEN 'seen' ELSE name END AS name FROM {users}")
def snk14(t: Tables) -> DataFrame:
    return W.updated_existing(t.users, t.events.select("user_id", F.lit("seen").alias("name")).distinct(), ["user_id"], ["name"])


@query("SNK15", "SELECT image_url FROM {images} WHERE NOT (width >= 100 AND height >= 100 AND image_url NOT LIKE '%.svg' AND NOT contains(image_url, 'icons'))")
def snk15(t: Tables) -> DataFrame:
    from quern.operators.indexing import usable_images

    return W.without_consumed(t.images, usable_images(t.images), "image_url").select("image_url")


# seeds
@query("FLT6", "SELECT seq FROM {seeds} WHERE topic NOT IN ('', 'Top/Adult/X', 'Top/Sports')")
def flt6(t: Tables) -> DataFrame:
    return t.seeds.where(D.topic_allowed(F.col("topic"))).select("seq")


@query("FLT7", f"SELECT seq, {_REASON} AS reason FROM {{seeds}}")
def flt7(t: Tables) -> DataFrame:
    return t.seeds.select("seq", D.directory_reason(F.col("topic"), F.col("title"), F.col("url")).alias("reason"))


@query("FLT8", "SELECT seq FROM {listing} WHERE score >= 25")
def flt8(t: Tables) -> DataFrame:
    return t.listing.where(F.col("score") >= D.MIN_SCORE).select("seq")


@query("FLT9", "SELECT seq FROM {listing} WHERE NOT is_self")
def flt9(t: Tables) -> DataFrame:
    return t.listing.where(~F.col("is_self")).select("seq")


_BLOCKED = "(seq % 5 = 0 OR seq % 7 = 0)"


@query("FLT10", f"SELECT seq FROM {{listing}} WHERE NOT {_BLOCKED}")
def flt10(t: Tables) -> DataFrame:
    return t.listing.where(~F.lower(U.part(F.col("url"), 2)).isin(*U.BLOCKED_HOSTS)).select("seq")


@query("FLT10_posts", f"SELECT seq FROM {{listing}} WHERE NOT {_BLOCKED} AND score >= 25 AND NOT is_self")
def flt10_posts(t: Tables) -> DataFrame:
    return D.kept_posts(t.listing).select("seq")


@query("JN17", "SELECT min(seq) AS seq FROM {seeds} GROUP BY regexp_replace(url, '/+$', '')")
def jn17(t: Tables) -> DataFrame:
    rows = t.seeds.withColumn("key", U.page_key(U.canonical(F.col("url"))))
    return D.first_of_each(rows, "key", "seq").select("seq")


@query("WN4", "SELECT user_id, min(event_id) AS event_id FROM {events} GROUP BY user_id")
def wn4(t: Tables) -> DataFrame:
    return D.first_of_each(t.events.select("user_id", "event_id"), "user_id", "event_id").select("user_id", "event_id")


_CATEGORY = "CASE WHEN topic LIKE 'Top/Recreation/Photography%' OR topic LIKE 'Top/Arts%' THEN 'Creative & Design' WHEN topic LIKE 'Top/Science%' THEN 'Science & Learning' WHEN topic LIKE 'Top/News%' THEN 'Journalism & Fact-checking' ELSE 'General' END"


@query("PRJ5", f"SELECT seq, {_CATEGORY} AS category FROM {{seeds}}")
def prj5(t: Tables) -> DataFrame:
    return t.seeds.select("seq", D.category_of(F.col("topic")).alias("category"))


@query("SO15", f"SELECT {_CATEGORY} AS category, count(*) AS n FROM {{seeds}} GROUP BY 1 ORDER BY n DESC, category")
def so15(t: Tables) -> DataFrame:
    return t.seeds.groupBy(D.category_of(F.col("topic")).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


@query("AG14_import", f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM {{seeds}} GROUP BY 1")
def ag14_import(t: Tables) -> DataFrame:
    return t.seeds.groupBy(F.coalesce(D.directory_reason(F.col("topic"), F.col("title"), F.col("url")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("PRJ1", "SELECT event_id FROM {events}")
def prj1(t: Tables) -> DataFrame:
    return t.events.select("event_id")


@query("PRJ2", "SELECT event_id AS word FROM {events}")
def prj2(t: Tables) -> DataFrame:
    return t.events.select("event_id").withColumnRenamed("event_id", "word")


@query("PRJ3", "SELECT doc_id, length(text) AS length FROM {documents}")
def prj3(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.char_length("text").cast("bigint").alias("length"))


@query("PRJ6", "SELECT seq, greatest(coalesce(priority, 1) - 1, 0) AS score FROM {seeds}")
def prj6(t: Tables) -> DataFrame:
    return t.seeds.select("seq", D.queue_score(F.coalesce("priority", F.lit(1))).alias("score"))


@query("PRJ7", "SELECT event_id, least(greatest(CASE WHEN event_id % 3 = 0 THEN event_id * 7 - 5000 ELSE event_id % 9 + 1 END, -1000), 10000) AS score FROM {events}")
def prj7(t: Tables) -> DataFrame:
    return t.events.select("event_id", D.depth_score(F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 7 - 5000), F.col("event_id") % 9).alias("score"))


@query("AP22", "SELECT word, url, tf, 0.0::DOUBLE AS weight FROM {words}")
def ap22(t: Tables) -> DataFrame:
    # the nested index that is migrated has all pages of a word in one row
    legacy = t.words.groupBy(F.col("word").alias("_id")).agg(F.collect_list(F.struct("url", "tf", F.lit(None).cast("double").alias("weight"))).alias("pages"))
    return W.flattened_index(legacy)


# streaming: what has arrived is worked off once and compared with the batch result
def _stream(t: Tables, name: str) -> DataFrame:
    # a table is one file, or a folder of files of which a thousand are worked off together
    path, schema = f"{t.folder}/{name}.parquet", getattr(t, name).schema
    return J.arriving(t.spark, path, "*", schema, 1000) if is_folder(t.spark, path) else J.arriving(t.spark, t.folder, f"{name}.parquet", schema)


@query("ST1", "SELECT url, word, tf FROM {words}")
def st1(t: Tables) -> DataFrame:
    out, check = new_folder(t.spark, "index"), new_folder(t.spark, "check")
    docs = _stream(t, "documents").where("lang = 'en'").select(F.concat(F.lit("doc/"), "doc_id").alias("url"), "text")
    J.index_stream(docs, out, check)
    return t.spark.read.parquet(out).select("url", "word", "tf")


_QUEUE_LENGTH = "floor(abs(((event_id * 37) % 13000) - 6500))"


@query("ST2", f"SELECT event_id AS seq, coalesce(last_value(turn IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS paused FROM (SELECT event_id, CASE WHEN {_QUEUE_LENGTH} >= 5000 THEN true WHEN {_QUEUE_LENGTH} < 40 THEN false END AS turn FROM {{events}})")
def st2(t: Tables) -> DataFrame:
    # the queue falls to nothing and rises beyond the mark over and over
    length = F.expr(f"cast({_QUEUE_LENGTH} as bigint)")
    observed = _stream(t, "events").select(F.col("event_id").alias("seq"), F.when(length < 40, 0).otherwise(length).alias("waiting"))
    out = new_folder(t.spark, "limited")
    J.run_once(observed, out, new_folder(t.spark, "check"))
    return J.may_crawl(t.spark.read.schema("seq bigint, waiting bigint").parquet(out)).select("seq", "paused")


@query("ST3", "SELECT DISTINCT l_partkey AS dst, l_orderkey AS src FROM {lineitem}")
def st3(t: Tables) -> DataFrame:
    out = new_folder(t.spark, "backlinks")
    edges = _stream(t, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    J.run_once(J.backlink_pairs(edges), out, new_folder(t.spark, "check"))
    return t.spark.read.schema("dst bigint, src bigint").parquet(out)


@query("ST4", "SELECT event_type AS term, count(*) AS times FROM {events} GROUP BY 1")
def st4(t: Tables) -> DataFrame:
    out = new_folder(t.spark, "counts")
    counts = J.search_counts(_stream(t, "events").select(F.concat(F.lit(" "), F.upper("event_type")).alias("q")))
    J.each_batch(counts, lambda b, _: b.orderBy(F.desc("times"), "term").limit(100).write.mode("overwrite").parquet(out), new_folder(t.spark, "check"), "complete")
    return t.spark.read.schema("term string, times bigint").parquet(out)


@query("ST5", "SELECT counter, min(ts) AS start, count(*) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY counter ORDER BY ts, event_id) AS s FROM (SELECT event_id, ts, user_id % 10 AS counter, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM {events})) GROUP BY counter, s HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM {events})")
def st5(t: Tables) -> DataFrame:
    out = new_folder(t.spark, "sessions")
    J.run_once(J.sessions(_stream(t, "events").select("ts", (F.col("user_id") % 10).alias("counter")), "1 hour"), out, new_folder(t.spark, "check"))
    return t.spark.read.schema("counter bigint, start timestamp, total bigint").parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ST6", "SELECT user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_type) AS old FROM {events}) WHERE event_type IS DISTINCT FROM old")
def st6(t: Tables) -> DataFrame:
    out = new_folder(t.spark, "changed")
    J.run_once(J.changed_pages(_stream(t, "events").select("user_id", "event_type"), "user_id", "event_type"), out, new_folder(t.spark, "check"))
    return t.spark.read.schema("user_id bigint, event_type string").parquet(out)


@query("ST7", "SELECT page_id FROM {pages}")
def st7(t: Tables) -> DataFrame:
    out = new_folder(t.spark, "once")
    J.run_once(_stream(t, "pages").select("page_id"), out, new_folder(t.spark, "check"))
    return t.spark.read.schema("page_id bigint").parquet(out)


@query("ST8_stream", "SELECT count(*) AS entries FROM {events} WHERE event_type = 'error'")
def st8_stream(t: Tables) -> DataFrame:
    out = new_folder(t.spark, "log")
    J.run_once(J.job_log(_stream(t, "events").where("event_type = 'error'").select("event_id", "user_id")), out, new_folder(t.spark, "check"))
    return t.spark.read.schema("entry string").parquet(out).agg(F.count("*").alias("entries"))


@query("ST10", "SELECT url FROM (SELECT url FROM {metadata} ORDER BY md5('11:' || url) LIMIT 1)")
def st10(t: Tables) -> DataFrame:
    return saved(S.sampled(t.metadata.select("url"), "url", 1, 11), "page_of_day")

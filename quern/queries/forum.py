"""Communities, feeds, comments, votes, moderation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.bindings import Tables
from quern.operators import forum as C
from quern.operators import ranking as R
from quern.operators import search as S
from quern.operators import writes as N
from quern.queries.registry import query
from quern.sources import tables as W

VIEWER = 50
_VISIBLE = f"(SELECT p.* FROM {{posts}} p JOIN {{communities}} c USING (community_id) WHERE NOT p.is_removed AND (NOT c.is_private OR EXISTS (SELECT 1 FROM {{memberships}} m WHERE m.community_id = p.community_id AND m.user_id = {VIEWER})))"
_MODS = f"(SELECT community_id FROM {{memberships}} WHERE user_id = {VIEWER} AND role IN ('moderator', 'owner'))"
_LAST = "(SELECT user_id, target_type, target_id, arg_max(value, (ts, event_id)) AS value FROM {votes} GROUP BY ALL)"


def _visible(t: Tables) -> DataFrame:
    return C.visible(t.posts, t.communities, t.memberships, VIEWER)


def _feed(order: str, sql_order: str, name: str, source: str = _VISIBLE):
    sql = f"SELECT post_id, row_number() OVER (ORDER BY {sql_order})::INT AS place FROM (SELECT * FROM {source} ORDER BY {sql_order} LIMIT 20)"

    @query(name, sql)
    def run(t: Tables) -> DataFrame:
        from pyspark.sql import Window

        cut = C.ordered(_visible(t), order).limit(20)
        keys = [F.expr(x.removesuffix(" desc")).desc() if x.endswith(" desc") else F.expr(x) for x in C.ORDERS[order]]
        return cut.select("post_id", F.row_number().over(Window.orderBy(*keys)).alias("place"))  # 20 rows

    return run


_feed("new", "published_at DESC, post_id DESC", "SO4")
_feed("top", "score DESC, comment_count DESC, published_at DESC, post_id DESC", "SO5")
_feed("hot", "score * 2 + comment_count DESC, published_at DESC, post_id DESC", "SO6")


def _threads(order: str, sql_order: str, name: str):
    @query(name, f"SELECT post_id, row_number() OVER (ORDER BY {sql_order})::INT AS place FROM (SELECT * FROM {_VISIBLE} WHERE url = 'https://example.org/p/7' ORDER BY {sql_order} LIMIT 20)")
    def run(t: Tables) -> DataFrame:
        from pyspark.sql import Window

        cut = C.threads_of(t.posts, t.communities, t.memberships, "HTTPS://Example.org:443/p/7#top", VIEWER, order).limit(20)
        keys = [F.expr(x.removesuffix(" desc")).desc() if x.endswith(" desc") else F.expr(x) for x in C.ORDERS[order]]
        return cut.select("post_id", F.row_number().over(Window.orderBy(*keys)).alias("place"))  # 20 rows

    return run


_threads("thread_top", "upvote_count DESC, score DESC, comment_count DESC, published_at DESC, post_id DESC", "SO7")
_threads("new", "published_at DESC, post_id DESC", "SO8")


@query("SO9", "SELECT slug, row_number() OVER (ORDER BY member_count DESC, created_at DESC, community_id)::INT AS place FROM {communities} WHERE NOT is_private")
def so9(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.communities.where("not is_private").select("slug", F.row_number().over(Window.orderBy(F.desc("member_count"), F.desc("created_at"), "community_id")).alias("place"))


@query("SO10", "SELECT report_id FROM {reports} WHERE status = 'open' ORDER BY created_at DESC, report_id DESC LIMIT 30")
def so10(t: Tables) -> DataFrame:
    return t.reports.where("status = 'open'").orderBy(F.desc("created_at"), F.desc("report_id")).limit(30).select("report_id")


@query("SO11", "SELECT comment_id FROM {comments} ORDER BY created_at, comment_id LIMIT 100")
def so11(t: Tables) -> DataFrame:
    return t.comments.orderBy("created_at", "comment_id").limit(100).select("comment_id")


@query("TK2", f"SELECT count(*) AS total, 20::BIGINT AS per_page, 1::BIGINT AS current_page, greatest(ceil(count(*) / 20.0), 1)::BIGINT AS last_page FROM {_VISIBLE}")
def tk2(t: Tables) -> DataFrame:
    return S.page_info(_visible(t), 1, 20)


@query("FLT16", f"SELECT post_id FROM {_VISIBLE}")
def flt16(t: Tables) -> DataFrame:
    return _visible(t).select("post_id")


@query("FLT17", "SELECT post_id FROM {posts} WHERE NOT is_removed")
def flt17(t: Tables) -> DataFrame:
    return t.posts.where("not is_removed").select("post_id")


@query("FLT18", f"SELECT community_id FROM {{communities}} WHERE community_id IN {_MODS}")
def flt18(t: Tables) -> DataFrame:
    return C.moderated(t.communities, t.memberships, VIEWER).select("community_id")


@query("FLT19", "SELECT report_id FROM {reports} WHERE status = 'open'")
def flt19(t: Tables) -> DataFrame:
    return t.reports.where("status = 'open'").select("report_id")


@query("FLT20", "SELECT action_id FROM {actions} WHERE community_id = 3 AND action = 'remove' AND target_type = 'post'")
def flt20(t: Tables) -> DataFrame:
    return t.actions.where("community_id = 3 and action = 'remove' and target_type = 'post'").select("action_id")


@query("FLT21", "SELECT slug FROM {communities} WHERE NOT is_private")
def flt21(t: Tables) -> DataFrame:
    return t.communities.where("not is_private").select("slug")


@query("FLT22", "SELECT post_id FROM {posts} WHERE sha256(url) = sha256('https://example.org/p/7')")
def flt22(t: Tables) -> DataFrame:
    return t.posts.where(F.sha2("url", 256) == F.sha2(F.lit("https://example.org/p/7"), 256)).select("post_id")


@query("FLT25", f"SELECT community_id, NOT is_private OR community_id IN (SELECT community_id FROM {{memberships}} WHERE user_id = {VIEWER}) AS may_view FROM {{communities}}")
def flt25(t: Tables) -> DataFrame:
    return C.may_view(t.communities, t.memberships, VIEWER)


@query("FLT26", "SELECT post_id, CASE WHEN is_locked THEN 423 WHEN is_removed THEN 403 ELSE 201 END AS status FROM {posts}")
def flt26(t: Tables) -> DataFrame:
    return t.posts.select("post_id", C.write_gate(F.col("is_locked"), F.col("is_removed")).alias("status"))


@query("PRJ4", "SELECT p.post_id, u.name AS author, c.slug AS community FROM {posts} p LEFT JOIN {users} u ON u.user_id = p.author_id LEFT JOIN {communities} c USING (community_id)")
def prj4(t: Tables) -> DataFrame:
    return C.serialised(t.posts, t.communities, t.users).select("post_id", F.col("author.name").alias("author"), F.col("community.slug").alias("community"))


@query("JN10", "SELECT p.post_id, c.name AS community, u.name AS author FROM {posts} p LEFT JOIN {communities} c USING (community_id) LEFT JOIN {users} u ON u.user_id = p.author_id")
def jn10(t: Tables) -> DataFrame:
    u = t.users.select(F.col("user_id").alias("author_id"), F.col("name").alias("author"))
    return t.posts.join(t.communities.select("community_id", F.col("name").alias("community")), "community_id", "left").join(u, "author_id", "left").select("post_id", "community", "author")


@query("JN11", f"SELECT community_id, count(*) AS posts FROM {_VISIBLE} GROUP BY community_id")
def jn11(t: Tables) -> DataFrame:
    return _visible(t).groupBy("community_id").agg(F.count("*").alias("posts"))


@query("JN12", f"SELECT community_id FROM {{communities}} WHERE community_id IN (SELECT community_id FROM {{memberships}} WHERE user_id = {VIEWER})")
def jn12(t: Tables) -> DataFrame:
    return t.communities.join(t.memberships.where(F.col("user_id") == VIEWER), "community_id", "left_semi").select("community_id")


@query("JN13", "SELECT a.action_id, r.report_id FROM {actions} a JOIN {reports} r ON r.community_id = a.community_id AND r.target_type = a.target_type AND r.target_id = a.target_id")
def jn13(t: Tables) -> DataFrame:
    r = t.reports.select("report_id", "community_id", "target_type", "target_id")
    return t.actions.select("action_id", "community_id", "target_type", "target_id").join(r, ["community_id", "target_type", "target_id"]).select("action_id", "report_id")


@query("JN14", "SELECT c.comment_id, p.comment_id AS parent FROM {comments} c JOIN {comments} p ON p.comment_id = c.parent_id AND p.post_id = c.post_id")
def jn14(t: Tables) -> DataFrame:
    p = t.comments.select(F.col("comment_id").alias("parent"), F.col("post_id").alias("parent_post"))
    return t.comments.join(p, (F.col("parent_id") == F.col("parent")) & (F.col("post_id") == F.col("parent_post"))).select("comment_id", "parent")


@query("JN16", "SELECT s.url, count(*) AS threads FROM (SELECT DISTINCT 'https://example.org/p/' || (page_id * 3) AS url FROM {pages}) s JOIN {posts} p ON sha256(p.url) = sha256(s.url) GROUP BY s.url")
def jn16(t: Tables) -> DataFrame:
    from quern.functions.urls import source_url

    results = t.pages.select(F.concat(F.lit("https://example.org/p/"), F.col("page_id") * 3).alias("url")).distinct().withColumn("hash", source_url(F.col("url"))["source_url_hash"])
    return results.join(t.posts.select(source_url(F.col("url"))["source_url_hash"].alias("hash")), "hash").groupBy("url").agg(F.count("*").alias("threads"))


@query("AG14", "SELECT status, count(*) AS reports FROM {reports} GROUP BY status")
def ag14(t: Tables) -> DataFrame:
    return t.reports.groupBy("status").agg(F.count("*").alias("reports"))


@query("AG16", f"SELECT target_type, target_id, count(*) FILTER (value > 0) AS upvotes, count(*) FILTER (value < 0) AS downvotes, count(*) FILTER (value > 0) - count(*) FILTER (value < 0) AS score FROM {_LAST} GROUP BY ALL")
def ag16(t: Tables) -> DataFrame:
    return C.vote_totals(t.votes)


@query("AG17", "SELECT c.community_id, coalesce(m.n, 0) AS members, coalesce(p.n, 0) AS posts, p.last AS last_posted_at FROM {communities} c LEFT JOIN (SELECT community_id, count(*) AS n FROM {memberships} GROUP BY 1) m USING (community_id) LEFT JOIN (SELECT community_id, count(*) AS n, max(published_at) AS last FROM {posts} GROUP BY 1) p USING (community_id)")
def ag17(t: Tables) -> DataFrame:
    return C.community_counters(t.communities, t.memberships, t.posts)


@query("AG18", f"SELECT * FROM {_LAST}")
def ag18(t: Tables) -> DataFrame:
    return C.last_votes(t.votes)


@query("AG19", "SELECT post_id, count(*) AS comment_count FROM {comments} GROUP BY post_id")
def ag19(t: Tables) -> DataFrame:
    return C.comment_counts(t.comments)


@query("AG22", "SELECT coalesce(parent_id::VARCHAR, 'root') AS parent, count(*) AS comments FROM {comments} GROUP BY 1")
def ag22(t: Tables) -> DataFrame:
    return t.comments.groupBy(F.coalesce(F.col("parent_id").cast("string"), F.lit("root")).alias("parent")).agg(F.count("*").alias("comments"))


_SLUG = "trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-')"


@query("WN3", f"SELECT post_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT post_id, {_SLUG} AS base, row_number() OVER (PARTITION BY community_id, {_SLUG} ORDER BY post_id) AS n FROM {{posts}})")
def wn3(t: Tables) -> DataFrame:
    return C.slugged(t.posts, "post_id", "title", ["community_id"], "post").select("post_id", "slug")


@query("WN5", f"SELECT user_id, target_type, target_id, value FROM {_LAST}")
def wn5(t: Tables) -> DataFrame:
    return C.last_votes(t.votes)


@query("WN6", "SELECT date_trunc('minute', ts) AS start, user_id, count(*) AS requests, count(*) > 1 AS is_over FROM {events} GROUP BY 1, 2")
def wn6(t: Tables) -> DataFrame:
    return C.rate_limits(t.events, "user_id", 1)


@query("RK5", "SELECT post_id, score * 2 + comment_count AS hot FROM {posts}")
def rk5(t: Tables) -> DataFrame:
    return t.posts.select("post_id", R.hot(F.col("score"), F.col("comment_count")).alias("hot"))


@query("RK7", "SELECT event_id, value - coalesce(lag(value) OVER (PARTITION BY user_id, target_type, target_id ORDER BY ts, event_id), 0) AS delta FROM {votes}")
def rk7(t: Tables) -> DataFrame:
    return R.vote_deltas(t.votes).select("event_id", "delta")


_TREE = """WITH RECURSIVE c AS (SELECT * FROM {comments}), w(comment_id, post_id, path, depth) AS (SELECT comment_id, post_id, comment_id::VARCHAR, 0 FROM c WHERE parent_id IS NULL
    UNION ALL SELECT c.comment_id, c.post_id, w.path || '/' || c.comment_id, w.depth + 1 FROM c JOIN w ON c.parent_id = w.comment_id AND c.post_id = w.post_id WHERE w.depth < 8)"""


@query("GR5", _TREE + " SELECT comment_id, path, depth FROM w")
def gr5(t: Tables) -> DataFrame:
    return C.comment_paths(t.comments).select("comment_id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "depth")


@query("GR6", _TREE + " SELECT comment_id, depth + 1 AS reply_depth, depth + 1 <= 8 AS accepted FROM w")
def gr6(t: Tables) -> DataFrame:
    return C.reply_depth(t.comments, C.comment_paths(t.comments))


_TARGETS = "SELECT r.report_id, r.target_type, p.post_id AS target_post FROM {reports} r JOIN {posts} p ON p.post_id = r.target_id WHERE r.target_type = 'post' UNION ALL SELECT r.report_id, r.target_type, c.post_id FROM {reports} r JOIN {comments} c ON c.comment_id = r.target_id WHERE r.target_type = 'comment'"


@query("PRJ8", _TARGETS)
def prj8(t: Tables) -> DataFrame:
    return C.report_targets(t.reports, t.posts, t.comments)


@query("AP10", "SELECT p.post_id FROM {posts} p WHERE sha256(p.url) = sha256('https://example.org/p/12') AND NOT p.is_removed")
def ap10(t: Tables) -> DataFrame:
    from quern.functions.urls import source_url

    wanted = source_url(F.lit("HTTPS://Example.org:443/p/12#x"))["source_url_hash"]
    return t.posts.where((source_url(F.col("url"))["source_url_hash"] == wanted) & ~F.col("is_removed")).select("post_id")


@query("AP11", f"SELECT post_id FROM {_VISIBLE} ORDER BY score * 2 + comment_count DESC, published_at DESC, post_id DESC LIMIT 20 OFFSET 20")
def ap11(t: Tables) -> DataFrame:
    return C.ordered(_visible(t), "hot").offset(20).limit(20).select("post_id")


_CLUBS = "(SELECT c_custkey AS request_id, c_custkey AS user_id, CASE WHEN c_custkey % 10 = 0 THEN (SELECT min(n_name) FROM {nation}) WHEN c_custkey % 50 = 7 THEN ' ' ELSE concat(c_mktsegment, repeat('!', CAST(c_custkey % 4 AS INT))) END AS name FROM {customer})"


@query("AP12", f"""SELECT request_id, CASE WHEN reason IS NULL THEN 201 ELSE 422 END::INT AS status, reason, CASE WHEN reason IS NULL THEN base || CASE WHEN n > 1 THEN '-' || n ELSE '' END END AS slug, CASE WHEN reason IS NULL THEN 'owner' END AS role, CASE WHEN reason IS NULL THEN 1::BIGINT END AS member_count
    FROM (SELECT *, row_number() OVER (PARTITION BY base, reason IS NULL ORDER BY request_id) AS n FROM (SELECT request_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS base,
    CASE WHEN trim(name) = '' THEN 'name_required' WHEN name IN (SELECT name FROM {{communities}}) OR row_number() OVER (PARTITION BY name ORDER BY request_id) > 1 THEN 'name_taken' END AS reason FROM {_CLUBS}))""")
def ap12(t: Tables) -> DataFrame:
    return N.create_communities(t.asked(_CLUBS), t.communities)


_DRAFTS = "(SELECT o.o_orderkey AS request_id, o.o_custkey AS user_id, CASE WHEN o.o_orderkey % 31 = 0 THEN 'nowhere' ELSE lower(n.n_name) END AS community_slug, CASE WHEN o.o_orderkey % 37 = 0 THEN '' ELSE concat('Order ', o.o_orderkey % 5, '?') END AS title, CAST('' AS STRING) AS body, 'link' AS content_type, concat('HTTPS://Example.org:443/p/', o.o_orderkey % 500, '#x') AS url FROM {orders} o JOIN {nation} n ON n.n_nationkey = o.o_orderkey % 25)"


@query("AP12_posts", f"""SELECT request_id, status, CASE WHEN status = 201 THEN base || CASE WHEN n > 1 THEN '-' || n ELSE '' END END AS slug, CASE WHEN status = 201 THEN 'https://example.org/p/' || request_id % 500 END AS source_url
    FROM (SELECT *, row_number() OVER (PARTITION BY community_id, base, status ORDER BY request_id) AS n FROM (SELECT d.request_id, c.community_id, trim(regexp_replace(lower(d.title), '[^a-z0-9]+', '-', 'g'), '-') AS base,
    CASE WHEN c.community_id IS NULL THEN 404 WHEN c.is_private AND NOT EXISTS (SELECT 1 FROM {{memberships}} m WHERE m.community_id = c.community_id AND m.user_id = d.user_id) THEN 403 WHEN d.title = '' THEN 422 ELSE 201 END::INT AS status FROM {_DRAFTS} d LEFT JOIN {{communities}} c ON c.slug = d.community_slug))""")
def ap12_posts(t: Tables) -> DataFrame:
    return N.create_posts(t.asked(_DRAFTS), t.communities, t.memberships).select("request_id", "status", "slug", "source_url")


_REPLIES = "(SELECT event_id AS request_id, user_id, event_id % 110 AS post_id, CASE WHEN event_id % 3 > 0 THEN (event_id % 110 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) * 100 + event_id % 9 END AS parent_id, CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN repeat('x', 10001) ELSE 'reply' END AS body FROM {events})"


@query("AP12_comments", _TREE + f""", s AS (SELECT q.request_id, w.depth AS parent_depth, CASE WHEN p.post_id IS NULL THEN 404 WHEN c.is_private AND NOT EXISTS (SELECT 1 FROM {{memberships}} m WHERE m.community_id = c.community_id AND m.user_id = q.user_id) THEN 403
    WHEN p.is_locked THEN 423 WHEN p.is_removed THEN 403 WHEN length(q.body) = 0 OR length(q.body) > 10000 THEN 422 WHEN q.parent_id IS NOT NULL AND w.post_id IS NULL THEN 404 WHEN w.post_id <> q.post_id OR w.depth + 1 > 8 THEN 422 ELSE 201 END::INT AS status
    FROM {_REPLIES} q LEFT JOIN {{posts}} p ON p.post_id = q.post_id LEFT JOIN {{communities}} c ON c.community_id = p.community_id LEFT JOIN w ON w.comment_id = q.parent_id) SELECT request_id, status, CASE WHEN status = 201 THEN coalesce(parent_depth + 1, 0)::INT END AS depth FROM s""")
def ap12_comments(t: Tables) -> DataFrame:
    return N.add_comments(t.asked(_REPLIES), t.posts, t.communities, t.memberships, C.comment_paths(t.comments))


_BALLOTS = "(SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'comment' WHEN event_id % 41 = 0 THEN 'page' ELSE 'post' END AS target_type, CASE WHEN event_id % 3 = 0 THEN event_id % 90 * 100 + event_id % 4 ELSE event_id % 200 END AS target_id, CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_type = 'error' THEN -1 ELSE 1 END AS value, ts FROM {events})"
_TARGET_OF = "(SELECT 'post' AS target_type, post_id AS target_id, community_id, is_locked, is_removed FROM {posts} UNION ALL SELECT 'comment', m.comment_id, p.community_id, p.is_locked, p.is_removed FROM {comments} m JOIN {posts} p USING (post_id))"
_JUDGED = f"""(SELECT b.*, CASE WHEN b.target_type = 'page' OR b.target_id < 1 OR b.value = 0 THEN 422 WHEN g.community_id IS NULL THEN 404 WHEN c.is_private AND NOT EXISTS (SELECT 1 FROM {{memberships}} m WHERE m.community_id = c.community_id AND m.user_id = b.user_id) THEN 403
    WHEN g.is_locked OR g.is_removed THEN 423 ELSE 200 END::INT AS status FROM {_BALLOTS} b LEFT JOIN {_TARGET_OF} g USING (target_type, target_id) LEFT JOIN {{communities}} c ON c.community_id = g.community_id)"""


@query("AP12_votes", f"SELECT event_id, status FROM {_JUDGED}")
def ap12_votes(t: Tables) -> DataFrame:
    return N.cast_votes(t.asked(_BALLOTS), t.posts, t.comments, t.communities, t.memberships).select("event_id", "status")


@query("AP12_totals", f"SELECT target_type, target_id, count(*) FILTER (value = 1) AS upvotes, count(*) FILTER (value = -1) AS downvotes, count(*) FILTER (value = 1) - count(*) FILTER (value = -1) AS score FROM (SELECT user_id, target_type, target_id, arg_max(value, (ts, event_id)) AS value FROM {_JUDGED} WHERE status = 200 GROUP BY ALL) GROUP BY ALL")
def ap12_totals(t: Tables) -> DataFrame:
    return N.votes_after(N.cast_votes(t.asked(_BALLOTS), t.posts, t.comments, t.communities, t.memberships))


@query("AP13", "SELECT action_id, action, coalesce(bool_or(action = 'remove') OVER b, false) AS was_removed, coalesce(bool_or(action = 'lock') OVER b, false) AS was_locked, bool_or(action = 'remove') OVER n AS is_removed, bool_or(action = 'lock') OVER n AS is_locked FROM {actions} WINDOW b AS (PARTITION BY target_type, target_id ORDER BY ts, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY target_type, target_id ORDER BY ts, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def ap13(t: Tables) -> DataFrame:
    return C.audit(t.actions)


@query("AP13_reports", "SELECT report_id, CASE WHEN status = 'open' AND report_id IN (SELECT report_id FROM {actions} WHERE report_id IS NOT NULL) THEN 'resolved' ELSE status END AS status FROM {reports}")
def ap13_reports(t: Tables) -> DataFrame:
    return C.resolved_reports(t.reports, t.actions)


@query("AP13_state", "SELECT target_type, target_id, bool_or(action = 'remove') AS is_removed, bool_or(action = 'lock') AS is_locked FROM {actions} GROUP BY 1, 2")
def ap13_state(t: Tables) -> DataFrame:
    return C.moderation_state(t.actions)


@query("AP14", "SELECT t.report_id, p.community_id FROM (" + _TARGETS + ") t JOIN {posts} p ON p.post_id = t.target_post")
def ap14(t: Tables) -> DataFrame:
    return C.report_targets(t.reports, t.posts, t.comments).join(t.posts.select(F.col("post_id").alias("target_post"), "community_id"), "target_post").select("report_id", "community_id")


@query("AP15", f"SELECT post_id, coalesce(author_id = {VIEWER}, false) AS may_edit, coalesce(author_id = {VIEWER}, false) OR community_id IN {_MODS} AS may_remove, community_id IN {_MODS} AS may_lock FROM {{posts}}")
def ap15(t: Tables) -> DataFrame:
    return C.policies(t.posts, t.memberships, VIEWER)


@query("AP16", "SELECT user_id FROM {users} WHERE user_id % 100 > 50")
def ap16(t: Tables) -> DataFrame:
    return t.users.withColumn("expires_at", F.expr("timestamp_seconds(user_id % 100)")).where(F.col("expires_at") > F.expr("timestamp_seconds(50)")).select("user_id")


@query("AP17", "SELECT event_id, greatest(event_id % 7 - 2, 1) AS page, least(greatest(event_id % 300, 1), 100) AS per_page FROM {events}")
def ap17(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.greatest(F.col("event_id") % 7 - 2, F.lit(1)).alias("page"), F.least(F.greatest(F.col("event_id") % 300, F.lit(1)), F.lit(100)).alias("per_page"))


@query("AP18", "SELECT doc_id, CASE WHEN length(trim(split_part(text, chr(10), 1))) = 0 THEN 'title_required' WHEN length(split_part(text, chr(10), 1)) > 300 THEN 'title_too_long' WHEN length(text) > 50000 THEN 'body_too_long' WHEN doc_id % 10 = 9 THEN 'content_type' WHEN doc_id % 10 = 8 THEN 'url_required' END AS reason FROM {documents}")
def ap18(t: Tables) -> DataFrame:
    drafts = t.documents.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"), F.expr("case doc_id % 10 when 9 then 'poll' when 8 then 'link' else 'text' end").alias("content_type"), F.lit(None).cast("string").alias("url"))
    return C.rejected_posts(drafts).select("doc_id", "reason")


@query("AP18_votes", f"SELECT event_id, CASE WHEN target_type = 'page' THEN 'target_type' WHEN target_id < 1 THEN 'target_id' WHEN value = 0 THEN 'value' END AS reason FROM {_BALLOTS}")
def ap18_votes(t: Tables) -> DataFrame:
    return N.rejected(t.asked(_BALLOTS), "vote").select("event_id", "reason")


@query("AP18_comments", f"SELECT request_id, CASE WHEN length(body) = 0 THEN 'body_required' WHEN length(body) > 10000 THEN 'body_too_long' END AS reason FROM {_REPLIES}")
def ap18_comments(t: Tables) -> DataFrame:
    return N.rejected(t.asked(_REPLIES), "comment").select("request_id", "reason")


_COMPLAINTS = "(SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'post' ELSE 'comment' END AS target_type, event_id % 5 AS target_id, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE repeat('r', CAST(event_id % 210 AS INT)) END AS why, repeat('d', CAST(event_id % 10003 AS INT)) AS details FROM {events})"


@query("AP18_reports", f"SELECT event_id, CASE WHEN target_type = 'user' THEN 'target_type' WHEN target_id < 1 THEN 'target_id' WHEN length(trim(why)) = 0 THEN 'reason_required' WHEN length(why) > 200 THEN 'reason_too_long' WHEN length(details) > 10000 THEN 'details_too_long' END AS reason FROM {_COMPLAINTS}")
def ap18_reports(t: Tables) -> DataFrame:
    return N.rejected(t.asked(_COMPLAINTS), "report").select("event_id", "reason")


@query("AP20", "SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, floor(value * 10)::BIGINT AS duration_ms FROM {events}")
def ap20(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.floor(F.col("value") * 10).alias("duration_ms"))


@query("AP21", "SELECT DISTINCT user_id % 25 AS community_id, user_id FROM {events}")
def ap21(t: Tables) -> DataFrame:
    return t.events.select((F.col("user_id") % 25).alias("community_id"), "user_id").dropDuplicates(["community_id", "user_id"])


@query("AP23", "SELECT user_id, coalesce(CASE WHEN user_id % 3 = 0 THEN name END, 'user_' || user_id) AS username FROM {users}")
def ap23(t: Tables) -> DataFrame:
    return t.users.select("user_id", F.coalesce(F.when(F.col("user_id") % 3 == 0, F.col("name")), F.concat(F.lit("user_"), "user_id")).alias("username"))


@query("AP24", "SELECT post_id, url AS source_url, sha256(url) AS source_url_hash, 'example.org' AS source_domain, substr(url, 20) AS source_path FROM {posts}")
def ap24(t: Tables) -> DataFrame:
    from quern.functions.urls import source_url

    return t.posts.select("post_id", source_url(F.col("url")).alias("s")).select("post_id", "s.*")


@query("AP25", "SELECT 'community' AS kind, slug AS name, NULL::VARCHAR AS role FROM {communities} UNION ALL SELECT 'user', name, NULL FROM {users} UNION ALL SELECT 'membership', community_id || '/' || user_id, role FROM {memberships}")
def ap25(t: Tables) -> DataFrame:
    # half of each kind is there already; the seeder runs twice and adds nothing the second time
    def seeded(rows: DataFrame, keys: list[str], there) -> DataFrame:
        return W.inserted_if_absent(W.inserted_if_absent(rows.where(there), rows, keys), rows, keys)

    none = F.lit(None).cast("string").alias("role")
    com = seeded(t.communities.select("community_id", "slug"), ["community_id"], "community_id % 2 = 0").select(F.lit("community").alias("kind"), F.col("slug").alias("name"), none)
    users = seeded(t.users, ["user_id"], "user_id % 3 = 0").select(F.lit("user").alias("kind"), "name", none)
    members = seeded(t.memberships, ["community_id", "user_id"], "user_id % 5 = 0").select(F.lit("membership").alias("kind"), F.concat_ws("/", "community_id", "user_id").alias("name"), "role")
    return com.unionByName(users).unionByName(members)


@query("ST8", "SELECT action_id, actor_id, action FROM {actions}")
def st8(t: Tables) -> DataFrame:
    return t.actions.select("action_id", "actor_id", "action")

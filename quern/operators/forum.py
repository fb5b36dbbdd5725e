"""Community feeds, threads, comment trees, votes, counters, moderation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.urls import source_url
from quern.operators.ranking import saved

#: Orders of feeds, threads and lists; each ends in a unique key.
ORDERS = {
    "new": ["published_at desc", "post_id desc"],
    "top": ["score desc", "comment_count desc", "published_at desc", "post_id desc"],
    "hot": ["score * 2 + comment_count desc", "published_at desc", "post_id desc"],
    "thread_top": ["upvote_count desc", "score desc", "comment_count desc", "published_at desc", "post_id desc"],
    "communities": ["member_count desc", "created_at desc", "community_id"],
}
MAX_DEPTH = 8


def ordered(df: DataFrame, order: str) -> DataFrame:
    return df.orderBy(*(F.expr(x.removesuffix(" desc")).desc() if x.endswith(" desc") else F.expr(x).asc() for x in ORDERS[order]))


def visible(posts: DataFrame, communities: DataFrame, memberships: DataFrame, viewer: int | None) -> DataFrame:
    """Posts that are not removed, in public communities or in those of the viewer."""
    own = memberships.where(F.col("user_id") == (viewer if viewer is not None else -1)).select("community_id", F.lit(True).alias("__own")).distinct()
    rows = posts.where("not is_removed").join(communities.select("community_id", "is_private"), "community_id").join(own, "community_id", "left")
    return rows.where(~F.col("is_private") | F.col("__own").isNotNull()).drop("is_private", "__own")


def threads_of(posts: DataFrame, communities: DataFrame, memberships: DataFrame, url: str, viewer: int | None, order: str = "thread_top") -> DataFrame:
    """The visible posts about one page, in order."""
    wanted = source_url(F.lit(url))["source_url_hash"]
    return ordered(visible(posts.where(source_url(F.col("url"))["source_url_hash"] == wanted), communities, memberships, viewer), order)


def may_view(communities: DataFrame, memberships: DataFrame, viewer: int) -> DataFrame:
    """community_id, may_view."""
    own = memberships.where(F.col("user_id") == viewer).select("community_id").distinct().withColumn("__own", F.lit(True))
    return communities.join(own, "community_id", "left").select("community_id", (~F.col("is_private") | F.coalesce("__own", F.lit(False))).alias("may_view"))


def moderated(communities: DataFrame, memberships: DataFrame, viewer: int) -> DataFrame:
    """Communities in which the viewer is a moderator or owner."""
    return communities.join(memberships.where((F.col("user_id") == viewer) & F.col("role").isin("moderator", "owner")), "community_id", "left_semi")


def serialised(posts: DataFrame, communities: DataFrame, users: DataFrame) -> DataFrame:
    """Posts with nested author (null without one) and community."""
    u = users.select(F.col("user_id").alias("author_id"), F.col("name").alias("__author"))
    c = communities.select("community_id", F.col("slug").alias("__slug"))
    rows = posts.join(u, "author_id", "left").join(c, "community_id", "left")
    author = F.when(F.col("__author").isNotNull(), F.struct(F.col("author_id").alias("id"), F.col("__author").alias("name")))
    return rows.select("post_id", "title", author.alias("author"), F.struct(F.col("community_id").alias("id"), F.col("__slug").alias("slug")).alias("community"))


def comment_paths(comments: DataFrame) -> DataFrame:
    """comment_id, post_id, path, depth of the comments that a root comment of the same post reaches within MAX_DEPTH.

    Every comment climbs to its root, one join for each level; a parent with many replies is the unique side of that join.
    """
    parent = comments.select(F.col("comment_id").alias("__id"), F.col("post_id").alias("__post"), F.col("parent_id").alias("__up"))
    rows = comments.select("comment_id", "post_id", F.col("parent_id").alias("up"), F.array("comment_id").alias("path"))
    for _ in range(MAX_DEPTH):
        rows = rows.join(parent, (F.col("up") == F.col("__id")) & (F.col("post_id") == F.col("__post")), "left").where("up is null or __id is not null")
        rows = rows.select("comment_id", "post_id", F.col("__up").alias("up"), F.when(F.col("__id").isNotNull(), F.concat(F.array("__id"), "path")).otherwise(F.col("path")).alias("path"))
    return rows.where("up is null").select("comment_id", "post_id", "path", (F.size("path") - 1).alias("depth"))


def reply_depth(comments: DataFrame, paths: DataFrame) -> DataFrame:
    """comment_id, reply_depth, accepted: the depth of a reply to each comment, and whether it may be written."""
    return paths.select("comment_id", (F.col("depth") + 1).alias("reply_depth"), (F.col("depth") + 1 <= MAX_DEPTH).alias("accepted"))


def last_votes(votes: DataFrame) -> DataFrame:
    """user_id, target_type, target_id, value: of repeated votes the last counts."""
    return votes.groupBy("user_id", "target_type", "target_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def vote_totals(votes: DataFrame) -> DataFrame:
    """target_type, target_id, upvotes, downvotes, score of the last votes; two steps, so that a target with many votes is summed by voter first."""
    up, down = F.count(F.when(F.col("value") > 0, 1)), F.count(F.when(F.col("value") < 0, 1))
    return last_votes(votes).groupBy("target_type", "target_id").agg(up.alias("upvotes"), down.alias("downvotes"), (up - down).alias("score"))


def comment_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("post_id").agg(F.count("*").alias("comment_count"))


def community_counters(communities: DataFrame, memberships: DataFrame, posts: DataFrame) -> DataFrame:
    """community_id, members, posts, last_posted_at."""
    m = memberships.groupBy("community_id").agg(F.count("*").alias("members"))
    p = posts.groupBy("community_id").agg(F.count("*").alias("posts"), F.max("published_at").alias("last_posted_at"))
    return communities.select("community_id").join(m, "community_id", "left").join(p, "community_id", "left").select("community_id", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("posts", F.lit(0)).alias("posts"), "last_posted_at")


#: Parts into which the rows of one title are divided to number them.
KEY_PARTS = 64


def _positions(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Adds __r: each row's place by key, a number, within by. Counts of KEY_PARTS ranges of the key say where a range begins, so that a common value of by is no one task."""
    cuts = sorted(set(rows.select(key).approxQuantile(key, [i / KEY_PARTS for i in range(1, KEY_PARTS)], 0.5 / KEY_PARTS)))
    part = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    rows = rows.withColumn("__part", part)
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most KEY_PARTS rows
    begins = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n")).withColumn("__begin", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    own = Window.partitionBy(*by, "__part").orderBy(key)
    return rows.withColumn("__r", F.row_number().over(own)).join(begins, [*by, "__part"]).withColumn("__r", F.col("__r") + F.col("__begin")).drop("__part", "__begin")


def slugged(rows: DataFrame, key: str, title: str, scope: list[str], default: str, taken: DataFrame | None = None) -> DataFrame:
    """Adds slug: the title's slug, unique within the scope by -2, -3 ... in order of key, a number.

    taken (scope, slug): slugs in use. The plain slug of a title goes to its first row unless it is taken; a number is left out where the
    slug that it would make is taken or the plain slug of another title (foo-2). The columns of scope are not null.
    """
    by = [*scope, "__base"]
    rows = saved(rows.withColumn("__base", T.slug(F.col(title), default)), "titles")  # they are read five times
    first = saved(rows.groupBy(*by).agg(F.min(key).alias("__first")), "first_titles")
    used = first.select(*scope, F.col("__base").alias("__used"))
    held = None
    if taken is not None:
        held = taken.select(*scope, F.col("slug").alias("__used")).distinct()
        first = first.join(held.withColumnRenamed("__used", "__base").withColumn("__held", F.lit(True)), by, "left")
        used = used.unionByName(held)
    else:
        first = first.withColumn("__held", F.lit(None).cast("boolean"))
    rows = rows.join(first, by)
    plain = (F.col(key) == F.col("__first")) & F.col("__held").isNull()
    rest = _positions(rows.where(~plain), key, by)
    # numbers that are left out: before the i-th of them, n - 2 - i are free; equal ones make one step
    numbers = used.select(*scope, F.regexp_extract("__used", "^(.*)-[1-9][0-9]{0,8}$", 1).alias("__base"), F.regexp_extract("__used", "-([1-9][0-9]{0,8})$", 1).alias("__text"))
    numbers = numbers.where("__text <> ''").withColumn("__no", F.col("__text").cast("bigint")).where("__no > 1").select(*by, "__no").distinct().join(first.select(*by), by, "left_semi")
    own = [c for c in rows.columns if c not in ("__base", "__first", "__held", "slug")]
    plainly = rows.where(plain).withColumn("slug", F.col("__base")).select(*own, "slug")
    if not numbers.limit(1).count():  # none is left out: the rows need not meet the steps
        return plainly.unionByName(rest.withColumn("slug", F.concat_ws("-", "__base", (F.col("__r") + 1).cast("string"))).select(*own, "slug"))
    free = numbers.withColumn("__free", F.col("__no") - 1 - F.row_number().over(Window.partitionBy(*by).orderBy("__no"))).groupBy(*by, "__free").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy("__free")
    steps = free.withColumn("__skip", F.sum("__n").over(w)).withColumn("__until", F.lead("__free").over(w)).drop("__n")
    steps = steps.select(*(F.col(c).alias(f"__s_{c}") for c in by), "__free", "__until", "__skip")
    same = [F.col(c) == F.col(f"__s_{c}") for c in by]
    rest = rest.join(steps, [*same, F.col("__r") > F.col("__free"), F.col("__until").isNull() | (F.col("__r") <= F.col("__until"))], "left")
    rest = rest.withColumn("slug", F.concat_ws("-", "__base", (F.col("__r") + 1 + F.coalesce("__skip", F.lit(0))).cast("string")))
    return plainly.unionByName(rest.select(*own, "slug"))


def write_gate(locked: Column, removed: Column) -> Column:
    """What a write gets: 423 for locked, 403 for removed, else 201."""
    return F.when(locked, 423).when(removed, 403).otherwise(201)


def moderation_state(actions: DataFrame) -> DataFrame:
    """target_type, target_id, is_removed, is_locked after all actions."""
    return actions.groupBy("target_type", "target_id").agg(F.bool_or(F.col("action") == "remove").alias("is_removed"), F.bool_or(F.col("action") == "lock").alias("is_locked"))


def audit(actions: DataFrame) -> DataFrame:
    """Each action with the target's state before and after it. A state begins with the first action of its kind, so a target's actions need no order."""
    at = F.struct("ts", "action_id")
    begin = lambda kind: F.min(F.when(F.col("action") == kind, at))
    first = actions.groupBy("target_type", "target_id").agg(begin("remove").alias("__removed"), begin("lock").alias("__locked"))
    rows = actions.join(first, ["target_type", "target_id"])
    since = lambda c, now: F.coalesce(F.col(c) <= at if now else F.col(c) < at, F.lit(False))
    return rows.select("action_id", "action", since("__removed", False).alias("was_removed"), since("__locked", False).alias("was_locked"), since("__removed", True).alias("is_removed"), since("__locked", True).alias("is_locked"))


def resolved_reports(reports: DataFrame, actions: DataFrame) -> DataFrame:
    """report_id, status: an action on an open report resolves it."""
    done = actions.where("report_id is not null").select("report_id").distinct().withColumn("__done", F.lit(True))
    return reports.join(done, "report_id", "left").select("report_id", F.when(F.col("__done") & (F.col("status") == "open"), "resolved").otherwise(F.col("status")).alias("status"))


def report_targets(reports: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """report_id, target_type, target_post: each report's post, by one join for each type."""
    p = posts.select(F.col("post_id").alias("target_id"), F.col("post_id").alias("target_post"))
    c = comments.select(F.col("comment_id").alias("target_id"), F.col("post_id").alias("target_post"))
    one = lambda kind, table: reports.where(F.col("target_type") == kind).join(table, "target_id").select("report_id", "target_type", "target_post")
    return one("post", p).unionByName(one("comment", c))


def policies(posts: DataFrame, memberships: DataFrame, viewer: int) -> DataFrame:
    """post_id, may_edit, may_remove, may_lock: an author edits and removes; moderators and owners remove and lock."""
    m = memberships.where((F.col("user_id") == viewer) & F.col("role").isin("moderator", "owner")).select("community_id").distinct().withColumn("__mod", F.lit(True))
    author = F.coalesce(F.col("author_id") == viewer, F.lit(False))
    mod = F.coalesce("__mod", F.lit(False))
    return posts.join(m, "community_id", "left").select("post_id", author.alias("may_edit"), (author | mod).alias("may_remove"), mod.alias("may_lock"))


def rate_limits(log: DataFrame, key: str, most: int) -> DataFrame:
    """start, key, requests, over by minute."""
    counted = log.groupBy(F.window("ts", "1 minute"), key).agg(F.count("*").alias("requests"))
    return counted.select(F.col("window.start").alias("start"), key, "requests", (F.col("requests") > most).alias("is_over"))


def rejected_posts(drafts: DataFrame) -> DataFrame:
    """Adds reason, null for valid drafts (title, body, content_type, url)."""
    return drafts.withColumn("reason", F.when(F.coalesce(F.char_length(F.trim("title")), F.lit(0)) == 0, "title_required").when(F.char_length("title") > 300, "title_too_long").when(F.char_length("body") > 50000, "body_too_long").when(~F.col("content_type").isin("text", "link"), "content_type").when((F.col("content_type") == "link") & (F.coalesce("url", F.lit("")) == ""), "url_required").when((F.col("content_type") == "text") & (F.coalesce("body", F.lit("")) == ""), "body_required"))

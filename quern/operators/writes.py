"""Requests that write to the forum: which are accepted, and the rows they add. A request that is not accepted has a status and a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.urls import source_url
from quern.operators.forum import MAX_DEPTH, last_votes, rejected_posts, slugged

#: Longest values (fixed values).
NAME, COMMENT, REASON, DETAILS = 120, 10_000, 200, 10_000


def _blank(c: str) -> Column:
    return F.coalesce(F.char_length(F.trim(c)), F.lit(0)) == 0


def _longer(c: str, most: int) -> Column:
    return F.coalesce(F.char_length(c), F.lit(0)) > most


def _one_of(c: str, *values: object) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def rejected(requests: DataFrame, kind: str) -> DataFrame:
    """Adds reason: why a request of a kind (vote, comment, community, report, post) is not valid; null if it is."""
    if kind == "post":
        return rejected_posts(requests)
    target = [("target_type", lambda: ~_one_of("target_type", "post", "comment")), ("target_id", lambda: F.coalesce(F.col("target_id"), F.lit(0)) < 1)]
    rules = {
        "vote": [*target, ("value", lambda: ~_one_of("value", -1, 1))],
        "comment": [("body_required", lambda: _blank("body")), ("body_too_long", lambda: _longer("body", COMMENT))],
        "community": [("name_required", lambda: _blank("name")), ("name_too_long", lambda: _longer("name", NAME))],
        "report": [*target, ("reason_required", lambda: _blank("why")), ("reason_too_long", lambda: _longer("why", REASON)), ("details_too_long", lambda: _longer("details", DETAILS))],
    }[kind]
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(broken(), name).otherwise(reason)
    return requests.withColumn("reason", reason)


def with_access(requests: DataFrame, communities: DataFrame, memberships: DataFrame) -> DataFrame:
    """Adds may_write to requests (user_id, community_id): the community is public or the user is in it. Null without such a community."""
    own = memberships.select("community_id", "user_id", F.lit(True).alias("__member")).distinct()
    rows = requests.join(communities.select("community_id", "is_private"), "community_id", "left").join(own, ["community_id", "user_id"], "left")
    return rows.withColumn("may_write", ~F.col("is_private") | F.coalesce("__member", F.lit(False))).drop("is_private", "__member")


def create_communities(requests: DataFrame, communities: DataFrame) -> DataFrame:
    """request_id, status, reason, slug, role, member_count of requests (request_id, user_id, name).

    Of several requests for a name the first gets it. Slugs are unique among all communities; the user is the owner and only member.
    """
    rows = rejected(requests, "community")
    first = rows.where("reason is null").groupBy("name").agg(F.min("request_id").alias("__first"))
    rows = rows.join(first, "name", "left").join(communities.select("name", F.lit(True).alias("__taken")).distinct(), "name", "left")
    taken = F.col("__taken").isNotNull() | (F.col("request_id") != F.col("__first"))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(taken, "name_taken"))).drop("__first", "__taken")
    made = slugged(rows.where("reason is null").withColumn("__all", F.lit(0)), "request_id", "name", ["__all"], "community", communities.select(F.lit(0).alias("__all"), "slug")).drop("__all")
    made = made.withColumns({"role": F.lit("owner"), "member_count": F.lit(1).cast("bigint")})
    rows = made.unionByName(rows.where("reason is not null"), allowMissingColumns=True)
    return rows.select("request_id", F.when(F.col("reason").isNull(), 201).otherwise(422).alias("status"), "reason", "slug", "role", "member_count")


def create_posts(requests: DataFrame, communities: DataFrame, memberships: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """request_id, community_id, status, reason, slug, source_url of requests (request_id, user_id, community_slug, title, body, content_type, url).

    404 without such a community, 403 in a private one without membership, 422 if not valid, else 201 with a slug that is unique in the community,
    also among posts (community_id, slug). A thread is a post of content type link.
    """
    known = communities.select("community_id", F.col("slug").alias("community_slug"))
    rows = with_access(rejected(requests.join(known, "community_slug", "left"), "post"), communities, memberships)
    status = F.when(F.col("community_id").isNull(), 404).when(~F.col("may_write"), 403).when(F.col("reason").isNotNull(), 422).otherwise(201)
    rows = rows.withColumn("status", status).withColumn("source_url", F.when(F.col("status") == 201, source_url(F.col("url"))["source_url"]))
    made = slugged(rows.where("status = 201"), "request_id", "title", ["community_id"], "post", posts)
    return made.unionByName(rows.where("status <> 201"), allowMissingColumns=True).select("request_id", "community_id", "status", "reason", "slug", "source_url")


def add_comments(requests: DataFrame, posts: DataFrame, communities: DataFrame, memberships: DataFrame, comments: DataFrame) -> DataFrame:
    """request_id, status, depth of requests (request_id, user_id, post_id, parent_id, body); comments: comment_id, post_id, depth.

    In this order: 404 no such post, 403 no access, 423 locked, 403 removed, 422 not valid, 404 no such parent, 422 a parent of another post or
    deeper than MAX_DEPTH, else 201. depth is that of an accepted comment.
    """
    about = posts.select("post_id", "community_id", "is_locked", "is_removed")
    parent = comments.select(F.col("comment_id").alias("parent_id"), F.col("post_id").alias("__post"), F.col("depth").alias("__depth"))
    rows = with_access(rejected(requests, "comment").join(about, "post_id", "left"), communities, memberships).join(parent, "parent_id", "left")
    depth = F.when(F.col("parent_id").isNull(), 0).otherwise(F.col("__depth") + 1)
    status = (
        F.when(F.col("community_id").isNull(), 404).when(~F.col("may_write"), 403).when(F.col("is_locked"), 423).when(F.col("is_removed"), 403).when(F.col("reason").isNotNull(), 422)
        .when(F.col("parent_id").isNotNull() & F.col("__post").isNull(), 404).when((F.col("__post") != F.col("post_id")) | (depth > MAX_DEPTH), 422).otherwise(201)
    )
    return rows.select("request_id", status.alias("status"), F.when(status == 201, depth).alias("depth"))


def cast_votes(requests: DataFrame, posts: DataFrame, comments: DataFrame, communities: DataFrame, memberships: DataFrame) -> DataFrame:
    """requests (event_id, user_id, target_type, target_id, value, ts) with status: 422 not valid, 404 no such target, 403 no access, 423 locked or removed, else 200."""
    about = posts.select("post_id", "community_id", "is_locked", "is_removed")
    target = about.select(F.lit("post").alias("target_type"), F.col("post_id").alias("target_id"), "community_id", "is_locked", "is_removed")
    target = target.unionByName(comments.select(F.lit("comment").alias("target_type"), F.col("comment_id").alias("target_id"), "post_id").join(about, "post_id").drop("post_id"))
    rows = with_access(rejected(requests, "vote").join(target, ["target_type", "target_id"], "left"), communities, memberships)
    status = F.when(F.col("reason").isNotNull(), 422).when(F.col("community_id").isNull(), 404).when(~F.col("may_write"), 403).when(F.col("is_locked") | F.col("is_removed"), 423).otherwise(200)
    return rows.select(*requests.columns, status.alias("status"))


def votes_after(requests: DataFrame) -> DataFrame:
    """target_type, target_id, upvotes, downvotes, score that accepted votes add to targets; a repeated vote changes nothing, another value replaces it."""
    up, down = F.count(F.when(F.col("value") == 1, 1)), F.count(F.when(F.col("value") == -1, 1))
    return last_votes(requests.where("status = 200")).groupBy("target_type", "target_id").agg(up.alias("upvotes"), down.alias("downvotes"), (up - down).alias("score"))

"""Ranking: idf and tf-idf, PageRank, blends, vote deltas, scaling formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import new_folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the folder that the cluster shares (spark.checkpoint.dir), so that lost executors cost no round."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def idf(words: DataFrame, metadata: DataFrame) -> DataFrame:
    """word, df, idf = log10(N / (1 + df)); N counts metadata. Negative for words that nearly all pages have."""
    total = metadata.agg(F.count("*")).scalar()
    return words.groupBy("word").agg(F.count("*").alias("df")).select("word", "df", F.log10(total / (1 + F.col("df"))).alias("idf"))


def tf_idf(words: DataFrame, metadata: DataFrame) -> DataFrame:
    """url, word, tf, idf, weight: postings with weight = tf * idf."""
    return words.join(idf(words, metadata), "word").select("url", "word", "tf", "idf", (F.col("tf") * F.col("idf")).alias("weight"))


#: Links of one page that are kept together; a page with more is divided by target.
HUB_LINKS = 1_000_000


def page_rank(edges: DataFrame, nodes: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """node, rank after some synchronous rounds from 1 / N; a dangling node's rank is not dealt out.

    edges: src, dst; out-degree counts all of them. A page's targets are one list, kept in order of src, so that a round joins and shuffles a row
    for each page and the contributions, which the map side has summed. A page of more than HUB_LINKS links is divided into parts, and its rank
    goes to each. Ranks are written every third round; a lost executor's part of the kept lists is computed again from their table.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    parts = F.ceil(F.coalesce("degree", F.lit(1)) / HUB_LINKS).cast("int")
    nodes = saved(nodes.select("node").join(degree.withColumnRenamed("src", "node"), "node", "left").select("node", "degree", parts.alias("parts")), "nodes")
    n = nodes.count()
    own = edges.join(nodes.withColumnRenamed("node", "src").where("degree is not null"), "src")
    lists = own.groupBy("src", F.pmod(F.hash("dst"), F.col("parts")).alias("part")).agg(F.collect_list("dst").alias("targets"))
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = saved(lists, "links").repartition(tasks, "src", "part").sortWithinPartitions("src", "part").persist()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    for i in range(rounds):
        dealt = rank.where("degree is not null").select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), (F.col("rank") / F.col("degree")).alias("share"))
        given = links.join(dealt, ["src", "part"]).select(F.explode("targets").alias("dst"), "share").groupBy("dst").agg(F.sum("share").alias("given"))
        value = F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("given", F.lit(0.0))
        rank = nodes.join(given.withColumnRenamed("dst", "node"), "node", "left").select("node", "degree", "parts", value.alias("rank"))
        if i % 3 == 2 or i + 1 == rounds:
            rank = saved(rank, "rank")
    links.unpersist()
    return rank.select("node", "rank")


def linked_pages(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links as a table, so that they are made once, and node: every page at an end of one."""
    edges = saved(edges, "edges")
    return edges, edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def blended(weight: Column, rank: Column) -> Column:
    return 0.6 * weight + 0.4 * F.coalesce(rank, F.lit(0.0))


def hot(score: Column, comments: Column) -> Column:
    return score * 2 + comments


def vote_deltas(votes: DataFrame) -> DataFrame:
    """Each vote with what it adds to the score: its value less that of the same voter's last vote on the same target."""
    w = Window.partitionBy("user_id", "target_type", "target_id").orderBy("ts", "event_id")
    return votes.withColumn("delta", F.col("value") - F.lag("value", 1, 0).over(w))


def spiders_wanted(queue: Column, most: Column) -> Column:
    return F.when(queue >= 1000, 0).otherwise(F.round(most * (1 - queue / 1000.0))).cast("bigint")


def indexers_wanted(queue: Column, most: Column) -> Column:
    return F.when(queue < 50, F.lit(1)).otherwise(F.least(most.cast("bigint"), F.ceil(1.5 * queue / 100.0).cast("bigint"))).cast("bigint")


def backlinkers_wanted(keys: Column, most: Column) -> Column:
    return F.when(keys < 1000, F.lit(1)).otherwise(F.least(most.cast("bigint"), (1 + F.round((most - 1) * F.least(keys / 50000.0, F.lit(1.0)))).cast("bigint"))).cast("bigint")

"""Mixing sources to target weights by hierarchical budgeting.

Method
    A token budget goes down a tree of domain, language and source. Among siblings it is shared by weight; what a
    sibling cannot use (its tokens times the number of epochs allowed) is shared again among the others by weight, and
    only what all siblings together cannot use is left to the level above: a node's capacity is the sum below
    it. A leaf's tokens are a prefix of its seeded epochs: each epoch orders the leaf's documents anew by a hash of seed, epoch, doc_id
    and text. Where the prefix ends is found on a table of leaf, hash and tokens alone: by sums of 256 buckets of the hash, then of 256
    within the one in which the budget ends, and then among the rows of that one. The texts are read twice in all, never sorted or
    dealt out: once for their tokens, and once for what is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialize

LEVELS = ("domain", "lang", "source")
NONE = "(none)"


def word_tokens(text: Column) -> Column:
    """Number of words, at least 1, so that every document counts."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(1)).cast("bigint")


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("bigint")


def shared(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds given: the parent's budget shared among its children by weight, none above its capacity.

    In order of capacity for each weight, the level that is reached when all before a child are full is highest where
    the first child that cannot be filled stands.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("weight"), child)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("budget") - before) / rest
    return children.withColumn("level", level).withColumn("level", F.max("level").over(by)).withColumn("given", F.least(F.col("capacity").cast("double"), F.col("weight") * F.col("level"))).drop("level", "budget")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """leaves (LEVELS, tokens) with target: the tokens that each leaf gives. One row for each leaf; no text."""
    tree = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = tree.agg(budget.cast("double").alias("budget")).scalar()
    at: list[str] = []
    above = None
    for level in LEVELS:
        nodes = tree.groupBy(*at, level).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(level, weights)).where("weight > 0")
        nodes = nodes.withColumn("budget", total) if above is None else nodes.join(above, at)
        above = shared(nodes, at, level).select(*at, level, F.col("given").alias("budget"))
        at.append(level)
    return leaves.join(above, list(LEVELS)).withColumn("target", F.floor("budget").cast("bigint")).select(*LEVELS, "tokens", "target")


#: What mix() adds; columns of these names are replaced.
ADDED = ("mix_domain", "mix_epoch", "mix_tokens")
#: Places of the hash that name a bucket in the two rounds of sums.
DIGITS = (2, 4)


def order_of(epoch: Column, name: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name).cast("binary"))


def ends(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """LEVELS, cut, before, ties: the order of the row in which a leaf's unfinished epoch ends, the tokens before it, and how many rows have this order.

    rows: LEVELS, name, tokens. Rows of one order are copies of each other.
    """
    leaf = list(LEVELS)
    now = rows.join(targets.where("rest > 0"), leaf).select(*leaf, "tokens", "rest", F.lit(0).cast("bigint").alias("before"), order_of(F.col("whole"), F.col("name"), seed).alias("order"))
    cut = None
    for bucket in [*(F.left("order", F.lit(n)) for n in DIGITS), F.col("order")]:
        if cut is not None:
            now = now.drop("before").join(cut.drop("ties"), leaf).where(F.startswith("order", F.col("cut"))).drop("cut")
        sums = now.groupBy(*leaf, "rest", "before", bucket.alias("cut")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("ties"))
        w = Window.partitionBy(*leaf).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)  # 256 buckets, or the rows of the last one
        at = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(w), F.lit(0))).where("before < rest and before + tokens >= rest")
        cut = materialize(at.select(*leaf, "cut", "before", "ties"), "cuts")
    return cut


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: Column, seed: int, max_epochs: int, tokens: Column | None = None) -> DataFrame:
    """The columns of docs and ADDED: each row once for each epoch in which it is taken.

    docs has doc_id, text, lang, source; columns of docs that are called as in ADDED are replaced. domain is an expression of docs, and so is
    tokens (at least 1 for each row; else the words of text count); budget is an aggregate of the leaves' tokens, such as floor(sum(tokens) * 0.75). A
    null level is a node of its own, '(none)'. mix_tokens is what the budget takes of the row: all of its tokens but for the last
    row of a leaf. Weight 0 leaves a node out. A null doc_id or text is ordered as an empty one; rows alike in doc_id and text follow one
    another, and which of them the budget leaves out is not defined. An empty table gives an empty result.
    """
    own, leaf = [c for c in docs.columns if c not in ADDED], list(LEVELS)
    level = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    count = word_tokens(F.col("text")) if tokens is None else tokens.cast("bigint")
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("__m"), level(domain).alias("domain"), level(F.col("lang")).alias("lang"), level(F.col("source")).alias("source"), name.alias("name"), count.alias("tokens"))
    rows = materialize(flat.drop("__m"), "rows")
    leaves = materialize(rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), "leaves")
    targets = leaf_budgets(leaves, budget, weights, max_epochs).withColumn("whole", F.expr("target div tokens")).withColumn("rest", F.expr("target % tokens")).drop("tokens", "target")
    targets = materialize(targets, "targets", leaves)
    bounds = ends(rows, targets, seed)
    known = materialize(targets.join(bounds, leaf, "left"), "ends", rows)
    out = [*(F.col(f"__m.`{c}`").alias(c) for c in own), F.col("domain").alias("mix_domain"), "mix_epoch", "mix_tokens"]
    placed = flat.join(known, leaf).withColumn("order", F.when(F.col("cut").isNotNull(), order_of(F.col("whole"), F.col("name"), seed)))
    in_last = F.coalesce((F.col("order") < F.col("cut")) | (F.col("order") == F.col("cut")) & (F.col("ties") == 1), F.lit(False))
    # the epochs that have the row
    taken = placed.withColumn("times", F.col("whole") + in_last.cast("bigint")).where("times > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)))
    partly = (F.col("mix_epoch") == F.col("whole")) & (F.col("order") == F.col("cut"))
    taken = taken.withColumn("mix_tokens", F.when(partly, F.col("rest") - F.col("before")).otherwise(F.col("tokens"))).select(*out)
    if not known.where("ties > 1").limit(1).count():
        return taken
    # copies in which an epoch ends: they are numbered in their partitions, and on from those before
    tied = placed.where("ties > 1 and order = cut").withColumns({"part": F.spark_partition_id(), "n": F.monotonically_increasing_id()})
    tied = materialize(tied, "tied")
    parts = tied.groupBy(*leaf, "part").agg(F.count("*").alias("size"))
    parts = parts.withColumn("earlier", F.coalesce(F.sum("size").over(Window.partitionBy(*leaf).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    number = F.row_number().over(Window.partitionBy(*leaf, "part").orderBy("n")) - 1 + F.col("earlier")
    tied = tied.join(parts, [*leaf, "part"]).withColumn("before", F.col("before") + number * F.col("tokens")).where("before < rest")
    return taken.unionByName(tied.withColumn("mix_epoch", F.col("whole")).withColumn("mix_tokens", F.least(F.col("tokens"), F.col("rest") - F.col("before"))).select(*out))

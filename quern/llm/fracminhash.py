"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

DataFrame functions only. A sketch is an array of distinct hashes in order. The sketch of a union is the distinct
union of sketches, and because the threshold is the same for all texts, overlaps of a short and a very long text
can be estimated from what both have kept.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: One shingle hash in so many is kept.
SCALE = 8
#: Rows in one range of keys, ranges at most, and the least error of their bounds as a share of all rows. The driver knows one row of each range.
RANGE_ROWS, MAX_RANGES, LEAST_ERROR = 100_000, 65_536, 1e-5


def shingle_hashes(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """All hashes of a text's word shingles; one for a shorter text, none without words."""
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # array(x) binds x once: inside a lambda an outer expression would be computed for each element
    return F.transform(
        F.array(hashes),
        lambda h: F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))
        .when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " "))))
        .otherwise(F.array().cast("array<bigint>")),
    )[0]


def sketch(text: Column, scale: int = SCALE, width: int = SHINGLE_WORDS) -> Column:
    """The retained hashes of a text (null: empty)."""
    most = -(1 << 63) + (1 << 64) // scale
    return F.array_sort(F.array_distinct(F.filter(shingle_hashes(F.coalesce(text, F.lit("")), width), lambda h: h < F.lit(most))))


def merged(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def jaccard(a: Column, b: Column, equal: Column) -> Column:
    """Estimated likeness; for two empty sketches, whether the texts are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.when(equal, 1.0).otherwise(0.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 0 if a kept none."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def printed(s: Column, text: Column) -> Column:
    """A sketch as text: a hash of the whole text, then the retained hashes, in hexadecimal."""
    return F.concat(F.lower(F.hex(F.xxhash64(text))), F.lit(":"), F.array_join(F.transform(s, lambda h: F.lower(F.hex(h))), "."))


def not_above(cuts: list[int], key: Column) -> Column:
    """How many of the cuts, in order, are at most the key. They are looked up in two steps, so that a row is compared with few of them."""
    if not cuts:
        return F.lit(0)
    n = math.isqrt(len(cuts)) + 1
    parts = [cuts[i : i + n] for i in range(0, len(cuts), n)]
    heads, every = F.lit([x[0] for x in parts]).cast("array<bigint>"), F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    part = F.size(F.filter(heads, lambda c: c <= key))
    return F.when(part == 0, 0).otherwise((part - 1) * n + F.size(F.filter(F.element_at(every, F.greatest(part, F.lit(1))), lambda c: c <= key)))


def with_next(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Adds columns of the next row by descending key, a bigint (after the last: the first), as new names in columns.

    The rows are dealt out by ranges of the key and ordered in their range alone; each range also gets the first row of the range
    that follows. Null keys come last. Ties of the key are in the order of a hash of the first column, and then of the columns. A key (or
    null) that fills ranges by itself is divided by this hash, too, and its equal rows are one row with a count until they have their next rows.
    """
    total, known = rows.agg(F.count("*"), F.count(key)).first()
    wanted = max(1, min(MAX_RANGES, max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_ROWS)))
    found = rows.select(key).approxQuantile(key, [i / wanted for i in range(1, wanted)], max(0.25 / wanted, LEAST_ERROR)) if wanted > 1 and known else []
    often = Counter(int(x) for x in found)
    # a key that fills a range or more alone: its parts
    heavy = {k: n + 1 for k, n in often.items() if n > 1}
    cuts = sorted({*often, *(min(k + 1, (1 << 63) - 1) for k in heavy)})
    of_null = -(-(total - known) * wanted // max(1, total))
    hashed = rows.withColumn("__hash", F.xxhash64(next(iter(columns)))).withColumn("__copies", F.lit(1).cast("bigint"))
    many = F.col(key).isNull() if of_null > 1 else F.lit(False)
    if heavy:
        many |= F.coalesce(F.col(key).isin(list(heavy)), F.lit(False))
    if heavy or of_null > 1:
        counted = hashed.where(many).drop("__copies").groupBy(*rows.columns, "__hash").agg(F.count("*").alias("__copies"))
        hashed = hashed.where(~many).unionByName(counted)
    # ranges are numbered in the order of the rows
    parts = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps({str(k): n for k, n in heavy.items()})), "map<string,int>"), F.col(key).cast("string")), F.lit(1))
    parts = F.when(F.col(key).isNull(), max(1, of_null)).otherwise(parts).cast("bigint")
    part = F.expr("shiftright(__hash, 32) + 2147483648") * parts
    at = F.when(F.col(key).isNull(), len(cuts) + 1).otherwise(len(cuts) - not_above(cuts, F.col(key)))
    hashed = hashed.withColumn("__range", F.struct(at.cast("int").alias("at"), F.shiftright(part, 32).cast("int").alias("part")))
    # a range's first row also goes to the range before it, the very first to the last
    first = F.min(F.struct((F.col(key).isNull()).alias("none"), F.bitwise_not(key).alias("down"), "__hash"))  # ~x falls as x rises
    tops = sorted((tuple(r[0]), r[1]["down"], r[1]["__hash"]) for r in hashed.groupBy("__range").agg(first).collect())  # one for each range
    targets = [(g, down, h, tops[i - 1][0]) for i, (g, down, h) in enumerate(tops)]
    kind = "struct<at:int,part:int>"
    small = F.broadcast(rows.sparkSession.createDataFrame(targets, f"__range {kind}, __down bigint, __first bigint, __target {kind}"))
    hashed = hashed.join(small, "__range", "left")
    own = F.struct(F.col("__range").alias("range"), F.lit(0).alias("lent"))
    lent = F.struct(F.col("__target").alias("range"), F.lit(1).alias("lent"))
    is_first = F.bitwise_not(key).eqNullSafe(F.col("__down")) & (F.col("__hash") == F.col("__first"))
    hashed = hashed.withColumn("__copy", F.explode(F.when(is_first, F.array(own, lent)).otherwise(F.array(own))))
    w = Window.partitionBy("__copy.range").orderBy("__copy.lent", F.desc_nulls_last(key), "__hash", *columns)
    out = hashed.withColumns({new: F.lead(old).over(w) for old, new in columns.items()}).where("__copy.lent = 0")
    if heavy or of_null > 1:
        # of equal rows each is the next one of the one before
        out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
        out = out.withColumns({new: F.when(F.col("__copy") < F.col("__copies"), F.col(old)).otherwise(F.col(new)) for old, new in columns.items()})
    return out.select(*rows.columns, *columns.values())


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text; docs: doc_id, text, others are ignored.

    Null texts are empty. An empty text's sketch is empty, and so may be that of a text of a few words; two empty
    sketches are alike (1) if the texts are equal and else not (0). A single row is its own next. Rows of one doc_id, and those without one, which come
    last, are in the order of a hash of their texts; so rows alike in both are each other's next. Texts of any length are taken whole. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(rows.withColumn("own", sketch(F.col("text"))), "doc_id", {"text": "next_text", "own": "next_own"})
    half = F.expr("cast(char_length(text) div 2 as int)")
    near = near.withColumn("edited", F.concat(F.expr("left(text, cast(char_length(text) - char_length(text) div 2 as int))"), F.left("next_text", half)))
    near = near.withColumn("edited_own", sketch(F.col("edited")))
    same = F.col("text") == F.col("edited")
    return near.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("own"), F.col("text")).alias("fingerprint"),
        printed(F.col("edited_own"), F.col("edited")).alias("edited_fingerprint"),
        jaccard(F.col("own"), F.col("edited_own"), same).alias("near_edited"),
        jaccard(F.col("own"), F.col("next_own"), F.col("text") == F.col("next_text")).alias("near_next"),
        containment(F.col("own"), F.col("edited_own")).alias("contained_edited"),
    )

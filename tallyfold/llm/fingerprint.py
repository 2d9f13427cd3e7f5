"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's five-word shingles (words stand between
white space; fewer words are one shingle, none is none).  The k smallest hashes of a union are among those of its parts, so
sketches merge.  Of the k smallest hashes of the union of two sketches, the share that is in both estimates
the resemblance; the k-th smallest hash gives the number of distinct shingles, and both give containment.
A text with at most k shingles is sketched whole, and then all of these are exact.  As a string a sketch is the hex digits of
its hashes; ``read`` gives the sketch back, so that written sketches merge too.

Edge cases: a null text is the empty text, with an empty sketch; two empty sketches have resemblance 1, one
empty and one not 0; texts are sketched whole, however long; equal texts have equal sketches; ties in
doc_id are ordered by text, null doc_ids come last; an empty table gives no row; rows of one doc_id stand in one range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import with_column_names

WORDS, K = 5, 128
#: Bytes of text in a range of doc_id (two ranges a shuffle partition at least), and ranges at most (their bounds go to every task); more
#: text makes larger ranges, which are sorted with spill.
RANGE_BYTES, MAX_RANGES = 16 << 20, 100_000


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The bottom-k sketch of a text: array<bigint>, ascending."""
    spaced = F.coalesce(text, F.lit(""))
    for c in ("\n", "\t", "\r", "\x0b", "\x0c"):
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    parts = F.array_remove(F.split(spaced, " "), "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        shifted = F.arrays_zip(*(F.slice(w, j + 1, F.greatest(n - j, F.lit(0))) for j in range(words)))
        return F.transform(F.slice(shifted, 1, F.greatest(n - words + 1, F.lit(1))), lambda s: F.xxhash64(s))

    each = bound(parts, lambda w: F.when(F.size(w) > 0, hashes(w)).otherwise(F.array().cast("array<bigint>")))
    return F.slice(F.sort_array(F.array_distinct(each)), 1, k)


def written(a: Column) -> Column:
    """A sketch as text: 16 lowercase hex digits a hash, in order."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def read(text: Column) -> Column:
    """The sketch that ``written`` wrote."""
    places = F.sequence(F.lit(0), F.floor(F.length(text) / 16).cast("int") - 1)
    parts = F.transform(places, lambda i: F.conv(F.substring(text, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))
    return F.when(F.length(text) > 0, parts).otherwise(F.array().cast("array<bigint>"))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard resemblance, 0 to 1."""

    def share(both: Column) -> Column:
        return F.when(F.size(both) > 0, F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)).otherwise(F.lit(1.0))

    return bound(merged(a, b, k), share)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    largest = (F.get(a, k - 1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / largest)


def containment(a: Column, b: Column, near: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has, from their resemblance ``near``; of no shingles, all."""
    common = near / (1 + near) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), common / distinct_count(a, k))).otherwise(F.lit(1.0))


def merge_sketches(parts: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch a key from the sketches of its parts.

    Hashes are made distinct and ranked; each task passes on k hashes a key at most (Spark's window group
    limit), so a key that holds a third of all parts is no large group.
    """
    each = parts.select(*keys, F.explode_outer(column).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_h").asc_nulls_last()))
    least = each.withColumn("_r", rank).where(F.col("_r") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def splits_of(docs: DataFrame, buckets: int) -> list[int]:
    """Upper bounds of ranges of doc_id with about as many rows each; each bound is a doc_id, the last the largest."""
    share = [(i + 1) / buckets for i in range(buckets)]
    found = docs.select(F.percentile_approx("doc_id", share, 20 * buckets).alias("p")).first()["p"]
    return sorted(set(found or []))


def bucket_of(value: Column, splits: list[int]) -> Column:
    """Index of the first bound that is not below ``value``, by binary search."""
    bounds, steps = F.lit(np.array(splits, np.int64)), len(splits).bit_length()

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        above = F.get(bounds, mid) < value
        return F.struct(F.when(above, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(above, acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splits) - 1).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(steps, 1))), start, step, lambda acc: acc["lo"])


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp: each document beside the next by descending doc_id, the last beside the first.

    Rows are dealt into ranges of doc_id, so the order needs one shuffle and no task has all rows.  The head
    of each range, whose doc_id is the range's bound, is added as a last row to the range above.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = splits_of(docs, min(MAX_RANGES, max(tasks, -(-size // RANGE_BYTES))))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if splits:
        bounds = spark.createDataFrame([(int(s),) for s in splits], "doc_id bigint")  # one a range
        heads = own.join(F.broadcast(bounds), "doc_id", "left_semi")
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        heads = heads.withColumn("r", first).where("r = 1").drop("r")
        dealt = own.withColumn("bucket", F.coalesce(bucket_of(F.col("doc_id"), splits), F.lit(0)))
        heads = heads.withColumn("bucket", F.pmod(bucket_of(F.col("doc_id"), splits) + 1, F.lit(len(splits))))
    else:
        dealt, heads = own.withColumn("bucket", F.lit(0)), own.orderBy("text").limit(1).withColumn("bucket", F.lit(0))
    rows = dealt.withColumn("extra", F.lit(0)).unionByName(heads.withColumn("extra", F.lit(1)))
    rows = rows.repartition("bucket").withColumn("fp", sketch(F.col("text")))  # after the shuffle, which so moves texts alone
    order = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order))
    return rows.where("extra = 0").drop("bucket", "extra")


def edited(text: Column, other: Column) -> Column:
    """The text, its last half replaced by as many code points from the start of the other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and estimates."""
    rows = with_next(with_column_names(docs, "doc_id", "text"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_fp", sketch(F.col("edited"), k))
    rows = rows.withColumn("near_next", resemblance(F.col("fp"), F.col("next_fp"), k))
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("fp")).alias("fingerprint"),
        written(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"),
        "near_next",
        containment(F.col("fp"), F.col("next_fp"), F.col("near_next"), k).alias("contained_in_next"),
        distinct_count(F.col("fp"), k).alias("shingles"),
    )

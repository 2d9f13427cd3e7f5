"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

1. Words: lower case, split at punctuation and white space.  Shingles are five words; a text with fewer
   words is one shingle.  Shingles are compared by 64-bit hashes.
2. Windows of the items' sizes: a window can only be similar to an item if they share a shingle, so windows begin where a
   shared shingle aligns.  Similarity t to an item of n shingles needs t n common ones (a document shorter than the item
   has no others), so any n - ceil(tn) + 1 of an item's shingles must include a common one: the rarest such
   shingles are its anchors, and no window is lost that aligns with a common shingle.
3. SimHash of the window's words (a bit is the majority over words, repeats included) and of every item.  A window meets all
   items of its size, not only that of its anchor, through r + 1 blocks of bits: fingerprints within a radius of r agree in one
   block at least (multi-index); a pair counts in the first block that agrees.
4. Exact weighted-shingle similarity (multiset Jaccard: every occurrence weighs 1) verifies the candidates.

At a similarity of 0.8 one word in nine may differ (a passage that lost words at an end), or a fifth of an item's words
be missing (a document shorter than the item): a bit then differs with a probability of 0.15 at most.  With random
hashes of different words, over 28 of 64 bits differ with a probability of about 1e-8 at most for items of 5 to 1000 words
(computed from binomial sums, for each length to 129 and every 31st beyond); over 12 it is up to 0.16.  The default radius is 28.

The benchmark's side of a join is broadcast while its words, which are counted first, are at most BROADCAST_WORDS; a
larger benchmark is joined by shuffle and sort, where Spark splits skewed keys: there only hashes and places of shingles move,
and the windows found fetch their words by the document's key afterwards.

Edge cases: null, empty and wordless texts, on either side, match nothing; an item of fewer than five words matches only a
document of exactly these words; ties between windows go to the first; repeated rows are found as often as
they are there by doc_id; very long texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Workspace, fresh, with_column_names

WORDS, THRESHOLD, RADIUS = 5, 0.8, 28
#: What stands between words of lower case: ASCII, Latin-1, general and CJK punctuation and spaces.
SEPARATORS = r"[\x00-/:-`{-\u00BF\u00D7\u00F7\u1680\u2000-\u206F\u3000-\u303F]+"
#: Words of all items together up to which the benchmark's side is broadcast (about 30 bytes each).
BROADCAST_WORDS = 1_000_000
#: Ids of contaminated documents up to which they are broadcast (about 16 bytes each).
BROADCAST_IDS = 1_000_000


def words_of(text: Column) -> Column:
    """Array of the words, in order (splitting leaves an empty string at an end at most)."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def shingles(words: Column, size: int = WORDS) -> Column:
    """Hashes of all runs of ``size`` words; fewer words are one shingle, none is none."""
    n = F.size(words)
    many = F.transform(F.slice(_shifted(words, size), 1, F.greatest(n - size + 1, F.lit(1))), lambda s: F.xxhash64(s))
    return F.when(n > 0, many).otherwise(F.array().cast("array<bigint>"))


def _shifted(words: Column, size: int) -> Column:
    """Array of structs: each word with the ``size`` - 1 that follow, null after the last."""
    return F.arrays_zip(*(F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))).alias(f"w{k}") for k in range(size)))


def with_shingles(df: DataFrame, words: str, size: int = WORDS) -> DataFrame:
    """A row for each shingle, with ``pos`` and ``hash`` as in ``shingles``; only expressions that compile to Java code."""
    each = df.select("*", F.size(words).alias("_n"), F.posexplode(_shifted(F.col(words), size)).alias("pos", "_s"))
    return each.where(F.col("pos") <= F.greatest(F.col("_n") - size, F.lit(0))).withColumn("hash", F.xxhash64(*(F.col("_s").getField(f"w{k}") for k in range(size)))).drop("_n", "_s")


def simhash(words: Column) -> Column:
    """64 bits, each the majority over the hashes of the words."""

    def majority(hashes: Column) -> Column:
        def with_bit(acc: Column, b: Column) -> Column:
            ones = F.aggregate(hashes, F.lit(0), lambda s, h: s + _bit(h, b))
            return acc.bitwiseOR(F.when(ones * 2 > F.size(hashes), _one_at(b)).otherwise(F.lit(0).cast("bigint")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), with_bit)

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), majority)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often it is used inside lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def _bit(h: Column, b: Column) -> Column:
    return F.call_function("bit_get", h, b).cast("int")


def _one_at(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), b)


def numbered(hashes: Column) -> Column:
    """A multiset as a set: each hash with the number of its occurrence, in time linear in the sorted array."""

    def runs(o: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (i == 0) | (F.get(o, i) != F.get(o, i - 1)))
        return _bound(first, lambda s: F.flatten(F.transform(s, lambda b, k: each(o, s, b, k))))

    def each(o: Column, s: Column, b: Column, k: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.coalesce(F.get(s, k + 1), F.size(o)) - b - 1), lambda j: F.xxhash64(F.get(o, b), j))

    return _bound(F.sort_array(hashes), lambda o: F.when(F.size(o) > 0, runs(o)).otherwise(o))


def cuts(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks of the 64 bits."""
    at = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def block_of(fp: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def blocks(fp: Column, radius: int) -> Column:
    """The blocks, each with its number."""
    return F.array(*(F.struct(F.lit(k).alias("block"), block_of(fp, *c).alias("bits")) for k, c in enumerate(cuts(radius))))


def first_common(a: Column, b: Column, radius: int) -> Column:
    """Number of the first block in which two fingerprints agree."""
    x = a.bitwiseXOR(b)
    return F.coalesce(*(F.when(block_of(x, *c) == 0, F.lit(k)) for k, c in enumerate(cuts(radius))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, words (count), shingles (numbered), fp, s (their hashes in order) of items that have a word."""
    hashed = with_column_names(benchmark, "item_id", "text").select("item_id", words_of(F.col("text")).alias("h")).where(F.size("h") > 0)
    hashed = hashed.withColumn("s", shingles(F.col("h")))
    return hashed.select("item_id", F.size("h").alias("words"), numbered(F.col("s")).alias("item_set"), simhash(F.col("h")).alias("item_fp"), "s")


def anchors_of(items: DataFrame, threshold: float) -> DataFrame:
    """(hash, item_id, words, at): the rarest shingles of each item, enough that one must be shared."""
    each = items.select("item_id", "words", F.size("s").alias("n"), F.posexplode("s").alias("at", "hash"))
    frequency = each.groupBy("hash").agg(F.count("*").alias("f"))
    need = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    order = F.row_number().over(Window.partitionBy("item_id").orderBy("f", "hash", "at"))
    return each.join(frequency, "hash").withColumn("k", order).where(F.col("k") <= need).select("hash", "item_id", "words", "at")


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, similarity, distance, start, n_windows.

    ``start`` is the word at which the best window begins; ``n_windows`` windows reach the threshold.
    """
    docs = with_column_names(docs, "doc_id", "text")
    items = Workspace(docs.sparkSession, "items").save(items_of(benchmark))
    small = (items.agg(F.sum("words").alias("n")).first()["n"] or 0) <= BROADCAST_WORDS

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df.hint("merge")

    anchors = side(anchors_of(items, threshold))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), words_of(F.col("text")).alias("h"))
    # an item longer than the document is compared with the whole document
    begin = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("long") - F.col("words"))).alias("start")
    placed = with_shingles(rows.withColumn("long", F.size("h")), "h")
    if small:
        window = placed.join(anchors, "hash").select("doc_id", "row", "h", "words", begin)
    else:  # only shingles move; the windows found meet their words again
        found = placed.select("row", "long", "pos", "hash").join(anchors, "hash").select("row", "words", begin).distinct()
        window = rows.join(found.hint("merge"), "row")
    window = window.select("doc_id", "row", "words", "start", F.slice("h", F.col("start") + 1, F.col("words")).alias("w")).where(F.size("w") > 0)
    window = window.groupBy("doc_id", "row", "words", "start").agg(F.first("w").alias("w"))
    window = window.withColumn("fp", simhash(F.col("w"))).withColumn("own", numbered(shingles(F.col("w")))).drop("w")
    window = window.select("*", F.explode(blocks(F.col("fp"), radius)).alias("b")).select("*", "b.block", "b.bits").drop("b")
    known = items.select(F.col("words").alias("item_words"), "item_id", "item_fp", F.explode(blocks(F.col("item_fp"), radius)).alias("b"))
    known = known.select("item_words", "item_id", "item_fp", F.col("b.block").alias("item_block"), F.col("b.bits").alias("item_bits"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    agree = (F.col("words") == F.col("item_words")) & (F.col("block") == F.col("item_block")) & (F.col("bits") == F.col("item_bits"))
    near = window.join(side(known), agree & (distance <= radius) & (first_common(F.col("fp"), F.col("item_fp"), radius) == F.col("block")))
    near = near.select("doc_id", "start", "item_id", "own", distance.alias("distance")).join(side(items.select("item_id", "item_set")), "item_id")
    common = F.size(F.array_intersect("own", "item_set"))
    near = near.withColumn("similarity", common / (F.size("own") + F.size("item_set") - common)).where(F.col("similarity") >= threshold)
    near = near.dropDuplicates(["doc_id", "item_id", "start", "similarity", "distance"])  # of repeated rows
    best = F.max_by(F.struct("similarity", "distance", "start"), F.struct(F.col("similarity"), -F.col("distance"), -F.col("start")))
    out = near.groupBy("doc_id", "item_id").agg(best.alias("best"), F.count("*").alias("n_windows"))
    return out.select("doc_id", "item_id", "best.similarity", "best.distance", "best.start", "n_windows")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The documents that contain no item, with all their columns (null doc_ids too).

    The ids found are written and counted; at most BROADCAST_IDS are broadcast, more are joined by shuffle.
    """
    name = fresh(docs, "found")
    found = matches(docs.select("doc_id", "text"), benchmark, threshold, radius).select(F.col("doc_id").alias(name)).distinct()
    found = Workspace(docs.sparkSession, "contaminated").save(found)
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found.hint("merge")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")

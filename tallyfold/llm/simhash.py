"""SimHash near-duplicates with bit-sliced comparison.

1. A document's fingerprint has the majority bit of the XXH64 hashes of its 3-word shingles.
2. Distinct fingerprints only: copies share one.  Four blocks of 16 bits; fingerprints that differ in two bits
   or fewer agree in two blocks at least, so the six pairs of blocks are six tables of 32-bit keys (exact).
3. A bucket of a table is compared bit-sliced: 64 fingerprints stand as 64 vertical words, one a bit plane; a query
   adds plane after plane into carry-save counters, so 64 distances move at once, and words whose distances all
   exceed the radius are abandoned.  A bucket gives its components as star edges, not its pairs.  Buckets beyond a
   size are cut into chunks, and each pair of chunks is a task of its own.
4. Components over the star edges in Spark (see _components); then the smallest doc_id of each.

Edge cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows are copies; an
empty table gives no row; a text's words are all used.  Null doc_ids stay, and are no component's id if another is there.

``keep_first``, the pipeline's stage, has parameters of its own: texts whose sets of 5-word shingles have a similarity
(Jaccard) of 0.8 or more are near-duplicates.  At 0.8 fingerprints of 64 bits differ in about 10 bits (deviation 3), and
a radius that loses nothing (20 or so) leaves blocks of three bits, by which every text meets every eighth.  So
buckets come from BANDS keys of ROWS minima of the shingles' hashes each (a pair at 0.8 shares none with a
probability of 3e-6, at 0.85 of 2e-8).  In a bucket texts meet bit-sliced as above, at KEEP_RADIUS bits; then a byte of each
minimum must agree in as many places as 0.8 makes all but sure (both lose a pair at 0.8 with a probability below 1e-5).  A pair that
shares several keys counts in the first of them.  Texts that are in such a pair bring their shingles to that bucket, where the
exact similarity decides and only edges that join components leave: rows grow with texts, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, fresh, group_starts, lean, runs, slices, texts, with_column_names
from ._components import components

RADIUS, SEED, WORDS = 2, 42, 3
#: Fingerprints of a bucket that are compared in one group, shingles of texts likewise, pairs of query and word in one step, pairs of traits.
CHUNK, SET_CHUNK, STEP, PAIRS = 8192, 4_000_000, 200_000, 50_000
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Of the pipeline's stage: words of a shingle, similarity, radius, keys of a text, minima in a key.
KEEP_WORDS, SIMILARITY, KEEP_RADIUS, BANDS, ROWS = 5, 0.8, 26, 32, 5
MIX = np.random.default_rng(SEED).integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
#: Ids of candidates up to which they are broadcast (about 16 bytes each), so that other texts don't move.
BROADCAST_IDS = 1_000_000


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> list[int]:
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if len(w) <= words:
        return [xxh64_intdigest(b" ".join(w), seed)] if w else []
    return [xxh64_intdigest(s, seed) for s in map(b" ".join, zip(*(w[k:] for k in range(words))))]


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as an unsigned number."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str) -> int:
    return majority(np.array(shingle_hashes(text), np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.array([fingerprint(t) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    docs = with_column_names(docs, "doc_id", "text")
    return docs.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit k of word w in plane b is bit b of fingerprint 64 w + k."""
    n = -(-len(fps) // 64)
    out = np.empty((n, 64), np.uint64)
    padded = np.zeros(n * 64, np.uint64)
    padded[: len(fps)] = fps
    for i in range(0, n, 1024):
        bits = np.unpackbits(padded[64 * i : 64 * (i + 1024)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        turned = np.packbits(bits.reshape(-1, 64, 64).transpose(0, 2, 1), axis=2, bitorder="little")
        out[i : i + 1024] = np.ascontiguousarray(turned).view(np.uint64)[:, :, 0]
    return np.ascontiguousarray(out.T)


def below(n: np.ndarray) -> np.ndarray:
    """Words with the n lowest bits set, n from 0 to 64."""
    return np.where(n >= 64, ALL, (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def within(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, dead: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, other) at ``radius`` bits or fewer.  ``dead`` marks the bits of each word that don't count.

    The counters are bit-sliced: adding a plane ripples through ``counters`` (carry-save), and a distance that
    comes to radius + 1 dies for good.  After every eighth plane, words without a living distance leave.
    """
    width = (radius + 1).bit_length()
    counters = [np.zeros(len(query), np.uint64) for _ in range(width)]
    goal = [bool((radius + 1) >> k & 1) for k in range(width)]
    q = fps[query]
    for b in range(64):
        carry = planes[b][word] ^ (np.uint64(0) - (q >> np.uint64(b) & np.uint64(1)))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        hit = ALL
        for c, g in zip(counters, goal, strict=True):
            hit = hit & (c if g else ~c)
        dead = dead | hit
        if b % 8 == 7:
            alive = dead != ALL
            if alive.sum() < 0.7 * len(alive):
                query, word, q, dead = query[alive], word[alive], q[alive], dead[alive]
                counters = [c[alive] for c in counters]
                if not len(query):
                    return
    alive = np.flatnonzero(dead != ALL)
    for i in range(0, len(alive), 20_000):
        some = alive[i : i + 20_000]
        row, bit = np.nonzero(np.unpackbits((~dead[some]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield query[some[row]], word[some[row]] * 64 + bit


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of a and b; every entry of ``root`` is the smallest member."""
    while True:
        x, y = root[a], root[b]
        new = x != y
        if not new.any():
            return root
        a, b, x, y = a[new], b[new], x[new], y[new]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up


def near_pairs(fps: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), a < b, of fingerprints of one group within ``radius``; groups begin at ``starts``."""
    n = len(fps)
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    planes, first = bit_planes(fps), np.arange(n) // 64
    count = (end - 1) // 64 - first + 1
    upto = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + STEP, side="right")) - 1)
        own = np.arange(at, to)
        query = np.repeat(own, count[at:to])
        word = first[query] + np.arange(len(query)) - (upto[query] - upto[at])
        live = below(np.clip(end[query] - 64 * word, 0, 64)) & ~below(np.clip(query + 1 - 64 * word, 0, 64))
        some = live != 0
        yield from within(planes, fps, query[some], word[some], ~live[some], radius)
        at = to


def bucket_components(fps: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Index of the first member of each fingerprint's component within its group; groups begin at ``starts``."""
    root = np.arange(len(fps))
    for a, b in near_pairs(fps, starts, radius):
        root = merge(root, a, b)
    return root


def chunked(entries: DataFrame, shared: DataFrame) -> DataFrame:
    """Entries (first column, ..., key) of the shared keys (key, chunks), with a and b, sorted by (key, a, b): each group is
    a bucket, or two chunks of a larger one, and every pair of a bucket is in a group."""
    first, *more = [c for c in entries.columns if c != "key"]
    cut = entries.join(shared.select("key", F.col("chunks").cast("int")), "key")
    cut = cut.withColumn("own", F.pmod(F.xxhash64(first), F.col("chunks")).cast("int"))
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.select("key", first, *more, "chunks", "own", other.alias("other")).where("chunks = 1 or own <> other")
    cut = cut.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), first, *more)
    return cut.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")


def star_edges(fps: DataFrame, work: Workspace, radius: int = RADIUS) -> DataFrame:
    """(u, v): edges that connect all distinct fingerprints ``fp`` within the radius (2 at most).

    Keys with their counts are written first: the join then has two shuffled sides, of which Spark can split hot keys.
    """
    if not 0 <= radius <= 2:
        raise ValueError("four blocks find at most two differing bits")
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = [F.lit(t << 32) + F.shiftleft(block[i], 16) + block[j] for t, (i, j) in enumerate(combinations(range(4), 2))]
    entries = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = work.save(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / CHUNK).alias("chunks")))
    cut = chunked(entries, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "a", "b"]):
            signed = t.column("fp").to_numpy()
            root = bucket_components(signed.view(np.uint64), group_starts(t, ["key", "a", "b"]), radius)
            edge = np.flatnonzero(root != np.arange(len(root)))
            if len(edge):
                yield pa.RecordBatch.from_arrays([pa.array(signed[edge]), pa.array(signed[root[edge]])], names=["u", "v"])

    return cut.mapInArrow(lean(run), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component) of every document.

    Components are found among distinct fingerprints, each with its smallest doc_id; documents meet them once,
    in a join of two written tables, so that Spark can split a fingerprint that very many documents share.
    """
    work = Workspace(docs.sparkSession, "simhash")
    own = work.save(fingerprints(docs))
    distinct = work.save(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(star_edges(distinct.select("fp"), work, radius), work)
    placed = work.save(distinct.join(label.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("c")))
    named = work.save(placed.groupBy("c").agg(F.min("least").alias("component_id")))
    ids = work.save(placed.join(named, "c").select("fp", "component_id"))
    return own.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_array(text: str) -> np.ndarray:
    """Hashes of the distinct shingles that the pipeline's stage compares."""
    return np.unique(np.array(shingle_hashes(text, KEEP_WORDS), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hash functions; the largest number of a text without a word."""
    low, h = np.full(len(MIX), 0xFFFFFFFF, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 256):
        low = np.minimum(low, (h[i : i + 256, None] * MIX).min(0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """(texts, BANDS): a key of each ROWS minima of each text."""
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(low), axis=0)
    for row in np.moveaxis(low.reshape(len(low), BANDS, ROWS), 2, 0):
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


@dataclass
class Traits:
    """What is compared before the texts: key band of a row, sizes of shingle sets, fingerprints, keys (32 bits), a byte of each minimum."""

    band: np.ndarray
    size: np.ndarray
    fp: np.ndarray
    keys: np.ndarray
    sketch: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Traits:
        keys, sketch = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(t.num_rows, -1) for c, kind in (("keys", np.uint32), ("sketch", np.uint8)))
        return cls(t.column("band").to_numpy(), t.column("size").to_numpy(), t.column("fp").to_numpy().view(np.uint64), keys, sketch)

    def may_be_similar(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Whether texts a and b of a bucket meet here first and can have the similarity: by sizes for sure, by minima all but for sure."""
        m, n = self.size[a], self.size[b]
        left = np.flatnonzero(np.minimum(m, n) >= threshold * np.maximum(m, n) - 1e-9)
        left = left[(self.keys[a[left]] == self.keys[b[left]]).argmax(1) == self.band[a[left]]]
        least = BANDS * ROWS * threshold - 6.5 * (BANDS * ROWS * threshold * (1 - threshold)) ** 0.5
        return left[(self.sketch[a[left]] == self.sketch[b[left]]).sum(1) >= least]


def candidates(t: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of rows of one bucket that may be similar, from rows sorted by (key, a, b)."""
    own = Traits.of(t)
    for a, b in near_pairs(own.fp, group_starts(t, ["key", "a", "b"]), KEEP_RADIUS):
        for i in range(0, len(a), PAIRS):
            ok = own.may_be_similar(a[i : i + PAIRS], b[i : i + PAIRS], threshold)
            if len(ok):
                yield a[i + ok], b[i + ok]


def packed_set(hashes: np.ndarray) -> bytes:
    """48 bits of each hash, in order."""
    return np.sort(hashes & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_set(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sorted sets; of two empty ones 1."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common / (len(x) + len(y) - common)


def _node(text: str = "text") -> Column:
    """A text's number; copies have the same one (by 64 bits), and a null is an empty text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, node, size (distinct shingles), fp, sketch, keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            sets = [shingle_array(t) for t in texts(b)]
            low = np.array([minima(h) for h in sets], np.uint32).reshape(-1, len(MIX))
            keys = band_keys(low).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            fp = np.array([majority(h) for h in sets], np.uint64).view(np.int64)
            sketch = [row.tobytes() for row in low.astype(np.uint8)]
            cols = [b.column(0), b.column(1), pa.array([len(h) for h in sets], pa.int64()), pa.array(fp), pa.array(sketch, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "size", "fp", "sketch", "keys"])

    docs = with_column_names(docs, "doc_id", "text").select("doc_id", _node().alias("node"), "text")
    return docs.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, node long, size long, fp long, sketch binary, keys array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, hashes (of the distinct shingles) of the texts among ``nodes``, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed_set(shingle_array(t)) for t in texts(b)], pa.binary())], names=["node", "hashes"])

    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes.hint("merge")
    own = docs.select(_node().alias("node"), "text").join(nodes, "node", "left_semi")
    return own.mapInArrow(lean(run), "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def meeting(entries: DataFrame, threshold: float) -> DataFrame:
    """(node, key), not distinct: entries that are in a pair that may be similar; they hold chunked traits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "a", "b"], 20_000):
            met = np.zeros(t.num_rows, bool)
            for a, b in candidates(t, threshold):
                met[a] = met[b] = True
            if met.any():
                yield from t.select(["node", "key"]).filter(pa.array(met)).to_batches()

    return entries.mapInArrow(lean(run), "node long, key long")


def similar_edges(entries: DataFrame, threshold: float) -> DataFrame:
    """(u, v): of each group of chunked entries with their shingles, edges that connect what the similarity connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "a", "b"], 2_000):
            node, root, sets = t.column("node").to_numpy(), list(range(t.num_rows)), t.column("hashes")
            known: dict[int, np.ndarray] = {}

            def top(k: int) -> int:
                while root[k] != k:
                    root[k] = k = root[root[k]]
                return k

            def shingles(k: int) -> np.ndarray:
                if k not in known:
                    known[k] = unpacked_set(sets[k].as_py())
                return known[k]

            edges = []
            for a, b in candidates(t, threshold):
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    if (x := top(i)) != (y := top(j)) and jaccard(shingles(i), shingles(j)) >= threshold:
                        root[max(x, y)] = min(x, y)
                        edges.append((i, j))
            if edges:
                u, v = node[np.array(edges)].T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return entries.mapInArrow(lean(run), "u long, v long")


def similar_texts(docs: DataFrame, own: DataFrame, work: Workspace, threshold: float) -> DataFrame:
    """(u, label): the smallest node of the component of similar texts, for each node but that one."""
    nodes = work.save(own.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "fp", "sketch", "keys"))))
    entries = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = work.save(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / CHUNK).alias("chunks")))
    held = work.save(entries.join(shared.select("key"), "key"))
    short = F.concat(*(F.unhex(F.lpad(F.hex(F.get("keys", k).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")) for k in range(BANDS)))
    traits = nodes.join(held.select("node").distinct(), "node", "left_semi").select("node", "size", "fp", "sketch", short.alias("keys"))
    traits = work.save(traits)
    work.drop(nodes)
    names = ("node", "band", "size", "fp", "keys", "sketch")
    met = work.save(meeting(chunked(held.join(traits, "node").select(*names, "key"), shared), threshold).distinct())
    sets = shingle_sets(docs, work.save(met.select("node").distinct()))
    full = work.save(traits.join(sets, "node"))
    rows = held.join(met, ["node", "key"]).join(full, "node").select(*names, "hashes", "key")
    sizes = work.save(held.join(met, ["node", "key"]).join(traits.select("node", "size"), "node").groupBy("key").agg(F.ceil((F.sum("size") + 1) / SET_CHUNK).alias("chunks")))
    edges = work.save(similar_edges(chunked(rows, sizes), threshold))
    return components(edges, work)


def keep_first(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each component of similar texts, with all its columns: that of the smallest doc_id, of these the text
    of the smallest number; a null doc_id is the last.  A row is known by its doc_id and its text, so rows that share
    a doc_id, or have none, stay if their texts are of different components; of repeated rows one stays.
    """
    work = Workspace(docs.sparkSession, "simhash-kept")
    own = work.save(keyed(docs))
    label = similar_texts(docs, own, work, threshold).withColumnRenamed("u", "node")
    rows = own.groupBy("node", "doc_id").agg(F.count("*").alias("n"))
    least = work.save(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("d")))
    placed = least.join(label, "node", "left").select(F.coalesce("label", "node").alias("c"), F.struct("d.none", "d.doc_id", "node", "d.n").alias("d"))
    first = work.save(placed.groupBy("c").agg(F.min("d").alias("d")).select(F.col("d.doc_id").alias("_first"), F.col("d.node").alias("_text"), F.col("d.n").alias("n")))
    # as many rows as documents are kept: joined by shuffle at every size, never broadcast
    node, d, text = (fresh(docs, c) for c in ("node", "first", "its_text"))
    first = first.withColumnsRenamed({"_first": d, "_text": text})
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(node) == F.col(text))
    kept = docs.withColumn(node, _node()).join(first.select(d, text).hint("merge"), same, "left_semi")
    return (kept.dropDuplicates(["doc_id", node]) if first.where("n > 1").take(1) else kept).drop(node)

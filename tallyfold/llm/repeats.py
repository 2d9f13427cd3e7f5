"""Repeated 100-byte strings over the whole corpus, by buckets of suffixes that are sorted one at a time.

A suffix is kept to its first LENGTH bytes, a window.  Windows are dealt into buckets by content: the smallest hash
of the GRAM-byte strings in a window is its bucket, so equal windows share a bucket wherever they stand, and
neighbouring windows nearly always have the same one (a run, about a third of LENGTH long).

1. Runs: (bucket, row, start, windows) of every document.  A bucket that occurs once in the corpus holds no
   repeat.  Occurrences within a task are combined first, so a bucket that a third of the corpus shares
   brings one row a task to the shuffle.
2. Contexts: a run that may repeat is fetched from its text, with bucket, bytes and place.  Equal contexts of a task
   are combined to the first.
   A bucket of very many runs (HOT_RUNS, estimated from a sample of documents) is split: its windows go one by one, each by
   the hash of its bytes, and equal ones of a task are combined.  The sample only chooses the way; both give the same result.
3. One bucket at a time, contexts in document order: the 64-bit hashes of its windows are ranked with those seen,
   and the first window of each string is an original.
4. Every window of a fetched run that is no original is removed with its bytes.  Runs, originals and text meet by
   row; a document's bytes are only ever in one row.

A full difference-cover sample was costed and not taken (see README): a cover for 100-byte strings samples an eighth of all
positions, four to five times the runs here, which is past the disk budget before a suffix is sorted.

Edge cases: a null text is empty; texts shorter than LENGTH lose nothing; rows with equal doc_id and text are the
same document and no earlier copy of one another, rows of equal doc_id and other text are ordered by a
hash of the text; null doc_ids come first; very long and periodic texts are handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Workspace, slices, with_column_names

LENGTH, GRAM = 100, 32
#: Windows of a run at most; longer runs (periodic text) are cut.
RUN = 128
#: Buckets that a task remembers to combine its own occurrences.
COMBINE = 2_000_000
#: Runs of a bucket from which it is split, part of the documents (one in so many) by which runs are counted, and the most buckets
#: that are split (8 bytes each are broadcast); the bound of runs rises where there would be more.
HOT_RUNS, HOT_SAMPLE, HOT_LIST = 200_000, 64, 1_000_000
_B, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all ``size``-byte strings, by doubling."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    width, h = 1, data.astype(np.uint64) + np.uint64(1)
    done, done_width = None, 0
    left = size
    while left:
        if left & 1:
            if done is None:
                done, done_width = h, width
            else:  # h of the first `width` bytes, then those done
                n = len(data) - width - done_width + 1
                done = h[:n] * _power(done_width) + done[width : width + n]
                done_width += width
        left >>= 1
        if left:
            n = len(h) - width
            h = h[:n] * _power(width) + h[width : width + n]
            width *= 2
    return done


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, w = h, 1
    while 2 * w <= width:
        out, w = np.minimum(out[:-w], out[w:]), 2 * w
    rest = width - w
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def bucket_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first window, windows, tied) of the runs of a text's bytes.

    ``tied``: the bucket's GRAM-byte string stands twice in a window, so windows of one run can be equal.
    """
    if len(data) < LENGTH:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none, none.astype(bool)
    gram, span = mixed(rolling(data, GRAM)), LENGTH - GRAM + 1
    bucket = sliding_min(gram, span)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(start, len(bucket)))
    # grams that are the least of a window: equal to the largest minimum of the windows over them
    edge = np.zeros(span - 1, np.uint64)
    least = np.flatnonzero(gram == ~sliding_min(~np.concatenate([edge, bucket, edge]), span))
    near = np.flatnonzero((gram[least[1:]] == gram[least[:-1]]) & (np.diff(least) < span))
    tied = size > span
    for p, q in zip(least[near].tolist(), least[near + 1].tolist(), strict=True):
        tied[np.searchsorted(start, max(0, q - span + 1), side="right") - 1 : np.searchsorted(start, p, side="right")] = True
    if size.max() > RUN:  # cut periodic runs
        parts = -(-size // RUN)
        first = np.repeat(start, parts)
        k = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(start + size, parts)
        start, tied = first + k * RUN, np.repeat(tied, parts)
        size = np.minimum(RUN, end - start)
    return bucket[start], start, size, tied


def text_bytes(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    """UTF-8 bytes of each text, a null as none, without a copy."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


CODEC = "zstd"


def packed(rows: DataFrame) -> DataFrame:
    """doc_id, doc, tag, bytes, packed: texts compressed one by one, as they are shuffled whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(CODEC, 3)
        for b in slices(batches, "text"):
            data = text_bytes(b, "text")
            z = pa.array([codec.compress(d, asbytes=True) if len(d) else b"" for d in data], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(d) for d in data], pa.int64()), z], names=["doc_id", "doc", "tag", "bytes", "packed"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "doc", "tag", "text").mapInArrow(run, f"doc_id {kind}, doc long, tag long, bytes long, packed binary")


def unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The bytes of each text of ``packed``."""
    codec = pa.Codec(CODEC)
    size, z = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("bytes", "packed"))
    for n, d in zip(size, z, strict=True):
        yield np.frombuffer(codec.decompress(d, n, asbytes=True), np.uint8) if n else np.empty(0, np.uint8)


class Seen:
    """Buckets of a task so far, and whether their first occurrence has been told of another; bounded by COMBINE."""

    def __init__(self):
        self.bucket, self.told = np.empty(0, np.uint64), np.empty(0, bool)

    def add(self, table: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, told) before, of sorted distinct buckets; they are known from now on, and told if known or ``repeated``."""
        at = np.searchsorted(self.bucket, table)
        inside = np.minimum(at, max(0, len(self.bucket) - 1))
        known = self.bucket[inside] == table if len(self.bucket) else np.zeros(len(table), bool)
        told = np.zeros(len(table), bool)
        told[known] = self.told[inside[known]]
        self.told[inside[known]] = True
        if len(self.bucket) < COMBINE:
            new = ~known
            self.bucket, self.told = np.insert(self.bucket, at[new], table[new]), np.insert(self.told, at[new], repeated[new])
        return known, told


def find_runs(rows: DataFrame) -> DataFrame:
    """(spread, sure, doc, tag, start, size): the runs; ``sure`` ones may repeat.

    The first occurrence of a bucket in a task has the bucket as ``spread``, so that tasks meet there; once that one has been
    told of a second, further ones are sure already and spread over all tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in slices(batches, "text"):
            found = [bucket_runs(d) for d in text_bytes(b, "text")]
            n = [len(f[0]) for f in found]
            if not sum(n):
                continue
            bucket, start, size, tied = (np.concatenate([f[k] for f in found]) for k in range(4))
            doc, tag = (np.repeat(b.column(k).to_numpy(), n) for k in range(2))
            table, first, inverse, count = np.unique(bucket, return_index=True, return_inverse=True, return_counts=True)
            known, told = seen.add(table, count > 1)
            sent = np.zeros(len(bucket), bool)
            sent[first[~told]] = True
            sure = tied | known[inverse] | (count[inverse] > 1)
            spread = np.where(sent, bucket, mixed(bucket ^ doc.view(np.uint64) ^ (start.astype(np.uint64) << np.uint64(20))))
            cols = [spread.view(np.int64), sure, doc, tag, start.astype(np.int32), size.astype(np.int16)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["spread", "sure", "doc", "tag", "start", "size"])

    return rows.select("doc", "tag", "text").mapInArrow(run, "spread long, sure boolean, doc long, tag long, start int, size short")


def hot_buckets(rows: DataFrame, work: Workspace) -> np.ndarray:
    """Sorted buckets of about HOT_RUNS runs or more, HOT_LIST at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            bucket, n = np.unique(np.concatenate([bucket_runs(d)[0] for d in text_bytes(b, "text")]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(n)], names=["bucket", "n"])

    some = rows.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(HOT_SAMPLE)) == 0).select("text")
    count = some.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    count = work.save(count.where(F.col("n") * HOT_SAMPLE >= HOT_RUNS))
    total = count.agg(F.sum("n")).first()[0] or 0
    listed = count.where(F.col("n") * HOT_LIST >= total).select("bucket").toArrow().column(0).to_numpy()
    return np.sort(listed.view(np.uint64))


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def contexts(rows: DataFrame, hot: Broadcast) -> DataFrame:
    """(bucket, doc, tag, start, bytes) of the runs that may repeat; of equal ones in a batch, the first in document order.

    Windows of ``hot`` buckets are rows of their own, with their hash as the bucket and the 8 bytes of the bucket in place of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = hot.value
        for b in slices(batches, "packed", 8 << 20):
            first: dict[bytes | tuple[int, int], tuple[int, int, int, int]] = {}
            where = {name: b.schema.get_field_index(name) for name in ("doc", "tag", "runs")}
            docs, tags, lists = (b.column(where[k]) for k in ("doc", "tag", "runs"))
            for k, data in enumerate(unpacked(b)):
                if not lists[k].is_valid:
                    continue
                doc, tag = docs[k].as_py(), tags[k].as_py()
                bucket, start, size, _ = bucket_runs(data)
                mine = np.isin(start, lists[k].values.field("start").to_numpy())
                alone = mine & member(bucket, split)
                if alone.any():
                    h = mixed(rolling(data, LENGTH)).view(np.int64)
                    for m, s, n in zip(bucket.view(np.int64)[alone].tolist(), start[alone].tolist(), size[alone].tolist(), strict=True):
                        for at, key in enumerate(h[s : s + n].tolist(), s):
                            place = (doc, tag, at, key)
                            if place < first.setdefault((key, m), place):
                                first[key, m] = place
                    mine &= ~alone
                raw = data.tobytes()
                for m, s, n in zip(bucket.view(np.int64)[mine].tolist(), start[mine].tolist(), size[mine].tolist(), strict=True):
                    key, place = raw[s : s + n + LENGTH - 1], (doc, tag, s, m)
                    if place < first.setdefault(key, place):
                        first[key] = place
            if first:
                doc, tag, start, bucket = zip(*first.values(), strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                held = [key if isinstance(key, bytes) else key[1].to_bytes(8, "little", signed=True) for key in first]
                cols = [pa.array(c, k) for c, k in zip((bucket, doc, tag, start, held), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "doc", "tag", "start", "bytes"])

    return rows.mapInArrow(run, "bucket long, doc long, tag long, start int, bytes binary")


def originals(held: DataFrame) -> DataFrame:
    """(doc, tag, start, size): ranges of windows that are the first of their string, from contexts.

    A bucket's contexts come to one task in document order; of the bucket at a batch's end only the hashes
    of its windows are kept for the next batch.  A row of less than LENGTH bytes is one window of a split bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, np.empty(0, np.uint64)
        for b in slices(batches, "bytes"):
            many = text_bytes(b, "bytes")
            length = np.array([len(d) for d in many])
            single = np.flatnonzero(length < LENGTH)
            n = np.maximum(1, length - LENGTH + 1)
            upto = np.concatenate([[0], np.cumsum(n)])
            # windows that span two contexts are hashed too, and left out
            h = rolling(np.concatenate([*many, np.zeros(LENGTH, np.uint8)]), LENGTH)
            h = mixed(h[np.arange(upto[-1]) + np.repeat(np.cumsum(length) - length - upto[:-1], n)])
            bucket = b.column(0).to_numpy()
            if len(single):  # hashes of two buckets in a batch must differ, whatever they were split from
                h[upto[single]] = mixed(bucket[single].view(np.uint64) ^ np.concatenate([many[k] for k in single]).view(np.uint64))
            own = np.zeros(len(h), bool)
            own[np.unique(h, return_index=True)[1]] = True
            new = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            head, tail = (upto[new[0]], upto[new[-1]]) if len(new) else (upto[-1], 0)
            if last == bucket[0]:
                own[:head] &= ~np.isin(h[:head], before)
            else:
                before = before[:0]
            before = np.unique(h[tail:]) if len(new) else np.union1d(before, h)
            last = bucket[-1]
            begin = own.copy()
            begin[1:] &= ~own[:-1]
            begin[upto[:-1]] |= own[upto[:-1]]
            end = own.copy()
            end[:-1] &= ~own[1:]
            end[upto[1:] - 1] |= own[upto[1:] - 1]
            a, e = np.flatnonzero(begin), np.flatnonzero(end)
            k = np.searchsorted(upto, a, side="right") - 1
            start = b.column(3).to_numpy()[k] + a - upto[k]
            cols = [b.column(1).to_numpy()[k], b.column(2).to_numpy()[k], start.astype(np.int32), (e - a + 1).astype(np.int16)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "tag", "start", "size"])

    return held.mapInArrow(run, "doc long, tag long, start int, size short")


def covered(n: int, runs: pa.Array, kept: pa.Array) -> np.ndarray:
    """Bytes of a text of ``n`` bytes that a repeated window covers."""
    window = np.zeros(n + 1, np.int8)
    for list_, value in ((runs, 1), (kept, 0)):
        if list_ is not None:
            for s, k in zip(list_.field("start").to_numpy().tolist(), list_.field("size").to_numpy().tolist(), strict=True):
                window[s : s + k] = value
    change = np.diff(np.concatenate([[0], window, [0]]))
    out = np.zeros(n + LENGTH + 2, np.int32)
    np.add.at(out, np.flatnonzero(change == 1), 1)
    np.add.at(out, np.flatnonzero(change == -1) + LENGTH - 1, -1)
    return np.cumsum(out)[:n] > 0


def remove(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from texts, their runs and their originals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "packed", 2 << 20):
            lists, keeps = (b.column(b.schema.get_field_index(k)) for k in ("runs", "kept"))
            size, gone, spans, digest = [], [], [], []
            for k, data in enumerate(unpacked(b)):
                size.append(len(data))
                if lists[k].is_valid:
                    bad = covered(len(data), lists[k].values, keeps[k].values if keeps[k].is_valid else None)
                    gone.append(int(bad.sum()))
                    spans.append(int((np.diff(bad.astype(np.int8), prepend=0) == 1).sum()))
                    data = data[~bad]
                else:
                    gone.append(0)
                    spans.append(0)
                digest.append(hashlib.sha256(data).hexdigest())
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = with_column_names(docs, "doc_id", "text")
    work = Workspace(docs.sparkSession, "repeats")
    unique = not docs.groupBy("doc_id").count().where("count > 1").take(1)
    tag = F.lit(0).cast("bigint") if unique else F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"), tag.alias("tag"), "text")
    met = F.count("*").over(Window.partitionBy("spread"))
    found = find_runs(rows).withColumn("n", met).where("sure or n > 1")
    found = work.save(found.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "size")).alias("runs")))  # bounded by the text
    # repeated rows list their runs twice, which marks the same windows
    texts = packed(rows).join(found, ["doc", "tag"], "left").select("doc_id", "doc", "tag", "bytes", "packed", "runs")
    hot = docs.sparkSession.sparkContext.broadcast(hot_buckets(rows, work))
    held = contexts(texts, hot).repartition("bucket").sortWithinPartitions("bucket", "doc", "tag", "start")
    kept = originals(held).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "size")).alias("kept"))
    return remove(texts.join(kept, ["doc", "tag"], "left").select("doc_id", "bytes", "packed", "runs", "kept"))

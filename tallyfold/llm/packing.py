"""Packing by minimum bin slack over a histogram of lengths.

1. Tokens: every document is tokenized once, in a map over the rows, and cut into pieces of exactly 4096 ids
   and one remainder.  Only (doc_id, start, length, crc32) leave this step; texts and ids are never shuffled.
2. Histogram: the count of pieces by length has at most 4096 rows whatever the input, so it is the one thing
   that goes to the driver.
3. Plan (minimum bin slack): open a window with the longest length left, then find the multiset of the
   remaining lengths whose sum comes closest to the room left.  The subset sums are a bitset (a Python
   integer): a length with k copies is added in binary parts, ``bits |= bits << part``; backtracking through the
   saved bitsets gives the counts.  The pattern is used as often as the histogram allows, so the plan has a
   number of patterns bounded by the number of lengths, not of documents.
4. Places: pieces of a length are ranked (salted two-level ranks, so a length that a third of the pieces share is
   no single task), and the rank gives sequence and offset by arithmetic on the plan.

Edge cases: a null or empty text is one piece holding the end id alone; ties are ranked by doc_id, then start;
repeated rows are packed as often as they are there; an empty table gives no piece.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Workspace, caches, lean, slices, with_column_names

CAPACITY = 4096
END_ID = 2
#: Bytes of chunks that a Python worker remembers (each with ENTRY more for its place), and pieces of a length ranked in one group.
CACHE, ENTRY, RANK_GROUP = 48 << 20, 200, 100_000
#: Chunks whose ids a worker lists at once (of a larger text: all).
GROUP = 100_000
#: A text by which a tokenizer is known to cut as ``Chunks`` does.
PROBE = "It's WE'RE don't 1234 a1b2 x_y <|z ---!? caf\u00e9 \u00c0\u00df\u00f7\u00ff soft\u00adhyphen n\u00b2 \t\r\n\x0b tabs\tand\u00a0spaces \u0130\u03a3\u03c2 \u65e5\u672c e\u0301 end."


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Chunks(dict):
    """Ids of space-free chunks of text.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its chunks in
    order.  A batch's distinct chunks are found by Arrow and looked up here.  A new chunk of ASCII and Latin-1
    letters is cut by the tokenizer's own pattern and its parts go to the BPE model at once (marks that
    follow a known word are added to its ids); any other chunk goes through the whole tokenizer.
    The first CACHE bytes of chunks stay, as frequent ones come early; later ones are forgotten after their batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # NFC, lower case and the classes \\p{L}, \\p{N} are plain for these characters
        self.plain = re.compile("[!-~À-ÖØ-öø-ÿ]*").fullmatch
        self.word = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)").fullmatch
        self.cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level BPE: other bytes follow from U+0100 on
        hidden = [b for b in range(256) if b not in set(visible)]
        self.letters = {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}
        self.flat, self.start, self.size = array("I"), array("q", [0]), 0
        if np.concatenate([*self.ids(pa.array([PROBE]))]).tolist() != self.whole.encode(PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path} cuts or normalises texts in another way than these chunks")

    def __missing__(self, chunk: str) -> int:
        flat = self.flat
        if self.plain(chunk) and not ("<|" in chunk and any(s in chunk for s in self.special)):
            low = chunk.lower()
            m = self.word(low)
            if m and (m[2] or low != chunk):
                for k in [self[part] for part in (m[1], m[2]) if part]:  # both known before this one begins
                    flat.extend(flat[self.start[k] : self.start[k + 1]])
            else:
                for piece in self.cut(low):
                    if not piece.isascii():
                        piece = piece.encode().decode("latin-1").translate(self.letters)
                    flat.extend([t.id for t in self.whole.model.tokenize(piece)])
        else:
            flat.extend(self.whole.encode(chunk, add_special_tokens=False).ids)
        self[chunk] = out = len(self.start) - 1
        self.start.append(len(flat))
        self.size += ENTRY + len(chunk)
        return out

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """All ids of each text of a column without nulls, unsigned 32-bit; it must be read to its end."""
        words = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        known = np.fromiter(map(self.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.flat or bytes(4), np.uint32)
        indices, row = coded.indices.to_numpy(), 0
        while row < len(column):  # texts of about GROUP chunks at once
            to = max(row + 1, int(np.searchsorted(ends, ends[row] + GROUP, side="right")) - 1)
            at = known[indices[ends[row] : ends[to]]]
            first, size = start[at], start[at + 1] - start[at]
            upto = np.concatenate([[0], np.cumsum(size)])
            where = np.repeat(first - upto[:-1], size)
            where += np.arange(upto[-1])
            found = flat[where] if len(where) else np.empty(0, np.uint32)
            yield from np.split(found, upto[ends[row + 1 : to] - ends[row]])
            row = to
        del start, flat  # the buffers can't shrink while they are seen
        while self.size > CACHE:
            last, _ = self.popitem()
            self.size -= ENTRY + len(last)
        del self.start[len(self) + 1 :]
        del self.flat[self.start[-1] :]


_chunks: dict[str, Chunks] = {}
caches["chunks"] = _chunks


def chunks(path: str) -> Chunks:
    """One cache a worker process and tokenizer, kept until another run comes; it holds CACHE bytes at most between batches."""
    if path not in _chunks:
        _chunks[path] = Chunks(path)
    return _chunks[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids cut at multiples of ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = chunks(path)
        for b in slices(batches, "text"):
            row, start, length, crc, total = [], [], [], [], []
            for k, found in enumerate(of.ids(pc.fill_null(b.column(1), ""))):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                raw = memoryview(ids.tobytes())
                for s in range(0, len(ids), capacity):
                    n = min(capacity, len(ids) - s)
                    row.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
                    total.append(len(ids))
            cols = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    docs = with_column_names(docs, "doc_id", "text")
    return docs.mapInArrow(lean(run, "chunks"), f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long")


def best_fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """Counts of the multiset of lengths whose sum comes closest to ``room`` from below.

    Bitset subset-sum over lengths, longest first; stops as soon as the room can be filled exactly.
    """
    full, bits = (1 << (room + 1)) - 1, 1
    trail: list[tuple[int, int]] = []  # (part, bits before it)
    parts_of: list[tuple[int, int]] = []  # (length, copies) of each part
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            take = min(copies, left)
            trail.append((take * length, bits))
            parts_of.append((length, take))
            bits |= (bits << (take * length)) & full
            left, copies = left - take, copies * 2
            if bits >> room & 1:
                break
        if bits >> room & 1:
            break
    at, out = bits.bit_length() - 1, {}
    for (part, before), (length, take) in zip(reversed(trail), reversed(parts_of), strict=True):
        if not before >> at & 1:  # only reached with this part
            at -= part
            out[length] = out.get(length, 0) + take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: copies}, windows that use it) that hold every piece of the histogram once."""
    left, out = {k: n for k, n in histogram.items() if n}, []
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = best_fill(capacity - longest, {k: n for k, n in rest.items() if n})
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        out.append((pattern, times))
    return out


def segments(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, copies a window, first sequence, first offset), by rank."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def ranked(cut: DataFrame, total: int) -> DataFrame:
    """``cut`` with rank: 0, 1, ... among the pieces of a length.  Groups of a length are ranked apart, then shifted."""
    groups = max(1, -(-total // RANK_GROUP)) * 4
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("length", "salt", before.alias("shift"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    return salted.withColumn("own", own).join(shifts, ["length", "salt"]).withColumn("rank", F.col("own") - 1 + F.col("shift")).drop("salt", "own", "shift")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padding.

    A sequence is padded to ``capacity``, except where its tokens are a power of two.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    cut = work.save(pieces(docs, tokenizer or default_tokenizer(), capacity, end_id))
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    patterns = plan(histogram, capacity)
    filled = np.array([sum(k * n for k, n in p.items()) for p, _ in patterns], np.int64)
    firsts = np.cumsum([0, *(t for _, t in patterns)])[:-1]
    held = spark.sparkContext.broadcast((segments(patterns), firsts, filled))  # bounded by the number of lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length, firsts, filled = held.value
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                mine = np.flatnonzero(length == k)
                rows = by_length[int(k)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                window, slot = np.divmod(rank[mine] - row[:, 0], row[:, 1])
                sequence[mine], offset[mine] = row[:, 2] + window, row[:, 3] + slot * k
            tokens = filled[np.searchsorted(firsts, sequence, side="right") - 1]
            padding = np.where(tokens & (tokens - 1) == 0, 0, capacity - tokens)
            cols = [*b.columns[:5], *(pa.array(x, pa.int64()) for x in (sequence, offset, tokens, padding))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:5], "sequence_id", "offset", "sequence_tokens", "padding"])

    rows = ranked(cut, sum(histogram.values())).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(lean(place, "chunks"), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padding long")

"""All pairs of ARRAY rows by matrix products, in tasks of two blocks of rows each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a block, about which a block has where there are tasks enough, and of a tile of a product.
BLOCK_ROWS, FEW_ROWS, TILE = 32_768, 512, 1_024
#: Blocks that a table of few rows is dealt into, pairs whose distances are summed at a time, and pairs that are given at a time.
FEW_BLOCKS, CHECKED, GIVEN = 8, 4_096, 65_536
#: Rounding of a single-precision number.
SINGLE = 2.0**-24

#: keys, labels and cells of a block of one width.
Block = tuple[pa.Array, pa.Array, np.ndarray]


def finite(values: Column) -> Column:
    """Whether all cells are numbers."""
    return F.coalesce(F.forall(values, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def blocks_for(n: int) -> int:
    return max(-(-n // BLOCK_ROWS), min(FEW_BLOCKS, -(-n // FEW_ROWS)), 1)


def exact_bytes(cells: np.ndarray) -> bytes:
    """In single precision where that changes no cell, so that less is moved."""
    with np.errstate(over="ignore"):
        short = cells.astype(np.float32)
    return (short if (short == cells).all() else cells).tobytes()


def block_pairs(rows: DataFrame, n: int, f: Callable[[Block, Block, bool], Iterator[pa.RecordBatch]], schema: str, blocks: int | None = None) -> DataFrame:
    """What ``f`` gives for each unordered pair of blocks, and each block with itself, of about ``n`` rows (key, label, values).

    Rows are dealt by the hash of the key and packed, a pair of blocks is one partition.  Quadratic by nature: a row is
    moved once a block.  Rows of different widths do not meet.
    """
    blocks = blocks or blocks_for(n)
    kinds = dict(rows.select("key", "label").dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, key, label = b.column("values"), b.column("key"), b.column("label")
            blk, width = b.column("blk").to_numpy(), np.diff(lists.offsets.to_numpy())
            cells, begin = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
            out: dict[str, list] = {"blk": [], "width": [], "keys": [], "labels": [], "cells": []}
            for k, w in sorted(set(zip(blk.tolist(), width.tolist(), strict=True))):
                at = np.flatnonzero((blk == k) & (width == w))
                out["blk"].append(k)
                out["width"].append(w)
                out["keys"].append(key.take(pa.array(at)))
                out["labels"].append(label.take(pa.array(at)))
                out["cells"].append(exact_bytes(cells[begin[at][:, None] + np.arange(w)].astype(float)))
            if out["blk"]:
                lists_of = lambda parts: pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype("int32"), pa.concat_arrays(parts))
                yield pa.record_batch([pa.array(out["blk"], pa.int32()), pa.array(out["width"], pa.int32()), lists_of(out["keys"]), lists_of(out["labels"]), pa.array(out["cells"], pa.binary())], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, dict[int, list]] = {}
        for b in batches:
            for r, (i, j, blk, w) in enumerate(zip(*(b.column(c).to_pylist() for c in ("i", "j", "blk", "width")), strict=True)):
                keys, cells = b.column("keys")[r].values, b.column("cells")[r].as_buffer()
                cells = np.frombuffer(cells, np.float32 if cells.size == 4 * w * len(keys) else float).reshape(len(keys), w)
                found.setdefault((i, j, w), {}).setdefault(blk, []).append((keys, b.column("labels")[r].values, cells))
        for (i, j, _), sides in found.items():
            if i in sides and j in sides:
                whole = {k: (pa.concat_arrays([p[0] for p in v]), pa.concat_arrays([p[1] for p in v]), np.concatenate([p[2] for p in v], dtype=float)) for k, v in sides.items()}
                yield from f(whole[i], whole[j], i == j)

    dealt = rows.select("key", "label", "values", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("blk"))
    packed = dealt.mapInArrow(pack, f"blk int, width int, keys array<{kinds['key']}>, labels array<{kinds['label']}>, cells binary")
    other = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = other.select(F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "width", "keys", "labels", "cells")
    return both.repartitionById(blocks * (blocks + 1) // 2, (F.col("j") * (F.col("j") + 1) / 2 + F.col("i")).cast("int")).mapInArrow(run, schema)


def summed_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, column by column in order, as Spark and SQL sum them."""
    out = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    for k in range(x.shape[-1]):
        d = x[..., k] - y[..., k]
        out += d * d
    return out


def tiles(x: np.ndarray, y: np.ndarray, same: bool, size: int) -> Iterator[tuple[int, int]]:
    for r in range(0, len(x), size):
        for c in range(r if same else 0, len(y), size):
            yield r, c


def single(x: np.ndarray, y: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.float32] | None:
    """Two matrices in single precision whose product is the squared distances less room for all rounding, and the limit of those within ``eps``.

    None where that room is more than a hundredth of the limit, or squares come near the ends of the range.  The room, as a
    part of the two squared norms: twice the width and 4 for the product's sums, 1 for the norms', and 3 for that of the cells.
    """
    room, limit = SINGLE * 1.1 * (2 * x.shape[1] + 16), eps * eps
    u, v = (m - x.mean(0) for m in (x, y))
    u, v = u.astype(np.float32), v.astype(np.float32)
    a, b = (np.einsum("ij,ij->i", m, m, dtype=float) for m in (u, v))
    if not (1e-25 < limit < 1e25 and room * (a.max() + b.max()) <= 0.01 * limit):
        return None
    norms = [(m * (1 - room)).astype(np.float32)[:, None] for m in (a, b)]
    ones = [np.ones_like(m) for m in norms]
    return np.hstack([u * np.float32(-2), norms[0], ones[0]]), np.hstack([v, ones[1], norms[1]]), np.float32(limit * (1 + 4 * SINGLE))


def left_by_product(x: np.ndarray, y: np.ndarray, same: bool, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs, all within ``eps`` among them, that products leave, in single precision where it is enough."""
    short = single(x, y, eps)
    if short:
        size, (one, two, limit) = 2 * TILE, short
        made = np.empty(min(size, len(x)) * min(size, len(y)), np.float32)
        for r, c in tiles(x, y, same, size):
            left, right = one[r : r + size], two[c : c + size]
            g = np.matmul(left, right.T, out=made[: len(left) * len(right)].reshape(len(left), len(right)))
            p, q = np.divmod(np.flatnonzero(g <= limit), len(right))
            yield p + r, q + c
        return
    room = 1 - 4e-16 * (x.shape[1] + 8)
    limit = eps * eps * (1 + 1e-12)
    a, b = np.einsum("ij,ij->i", x, x) * room, np.einsum("ij,ij->i", y, y) * room
    for r, c in tiles(x, y, same, TILE):
        g = x[r : r + TILE] @ y[c : c + TILE].T
        g *= -2
        g += a[r : r + TILE, None]
        g += b[None, c : c + TILE]
        p, q = np.nonzero(~(g > limit))  # also where squares are too large for a double
        yield p + r, q + c


def within(x: np.ndarray, y: np.ndarray, same: bool, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within ``eps``: those that a product leaves are summed as they are.

    In a block with itself a pair comes once, the smaller position first.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        for p, q in left_by_product(x, y, same, eps):
            if same:
                p, q = p[p <= q], q[p <= q]
            for k in range(0, len(p), CHECKED):
                one, two = p[k : k + CHECKED], q[k : k + CHECKED]
                near = np.sqrt(summed_squares(x[one], y[two])) <= eps
                yield one[near], two[near]


def touching(x: np.ndarray, y: np.ndarray, eps: float) -> bool:
    """Whether some row of x is within ``eps`` of one of y: boxes are halved until they are too far, near enough, or small."""
    left = [(x, y)]
    while left:
        a, b = left.pop()
        low, high, low2, high2 = a.min(0), a.max(0), b.min(0), b.max(0)
        gap, far = np.maximum(np.maximum(low - high2, low2 - high), 0), np.maximum(high - low2, high2 - low)
        if np.sqrt((gap * gap).sum()) > eps * (1 + 1e-9):
            continue
        if np.sqrt((far * far).sum()) < eps * (1 - 1e-9):
            return True
        if len(a) * len(b) <= 16_384:
            if (np.sqrt(summed_squares(a[:, None], b[None])) <= eps).any():
                return True
            continue
        first = len(a) >= len(b)
        whole, other = (a, b) if first else (b, a)
        k = int((whole.max(0) - whole.min(0)).argmax())
        order, middle = np.argsort(whole[:, k], kind="stable"), len(whole) // 2
        parts = [whole[order[:middle]], whole[order[middle:]]]
        if other[:, k].mean() < whole[:, k].mean():  # the nearer half is looked at first
            parts.reverse()
        left.extend((p, other) for p in parts)
    return False


class Copies:
    """The different rows of a block, and where the copies of each are."""

    def __init__(self, x: np.ndarray):
        x = np.ascontiguousarray(x)
        if x.shape[1]:
            _, first, kind = np.unique(x.view(f"V{x.shape[1] * x.itemsize}").ravel(), return_index=True, return_inverse=True)
        else:
            first, kind = np.zeros(1, int), np.zeros(len(x), int)
        self.rows, self.count, self.order = x[first], np.bincount(kind), np.argsort(kind, kind="stable")
        self.begin = np.cumsum(self.count) - self.count


def spread(p: np.ndarray, q: np.ndarray, one: Copies, two: Copies) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of all copies of pairs of different rows, and the pair each is of, some at a time."""
    sizes = one.count[p] * two.count[q]
    ends = np.cumsum(sizes)
    for k in range(0, int(sizes.sum()), GIVEN):
        at = np.arange(k, min(k + GIVEN, ends[-1]))
        pair = np.searchsorted(ends, at, side="right")
        i, j = np.divmod(at - (ends - sizes)[pair], two.count[q[pair]])
        yield one.order[one.begin[p[pair]] + i], two.order[two.begin[q[pair]] + j], pair


def block_range(left: Block, right: Block, same: bool, eps: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of all pairs of keys within ``eps``, in both orders; copies are compared once."""
    one = Copies(left[2])
    two = one if same else Copies(right[2])
    for p, q in within(one.rows, two.rows, same, eps):
        for i, j, pair in spread(p, q, one, two):
            a, b = left[0].take(pa.array(i)), right[0].take(pa.array(j))
            again = pa.array(np.flatnonzero(p[pair] != q[pair]) if same else np.arange(len(i)))  # copies of a row meet in both orders
            yield pa.record_batch([pa.concat_arrays([a, b.take(again)]), pa.concat_arrays([b, a.take(again)])], names=["a", "b"])


def range_pairs(points: DataFrame, eps: float, n: int, blocks: int | None = None) -> DataFrame:
    """(a, b) of all pairs of rows (row_id, values) within ``eps``, in both orders, and each with itself."""
    rows = points.where(finite(F.col("values"))).select(F.col("row_id").alias("key"), F.lit(0).alias("label"), F.transform("values", lambda v: v.cast("double")).alias("values"))
    kind = dict(points.dtypes)["row_id"]
    return block_pairs(rows, n, lambda left, right, same: block_range(left, right, same, eps), f"a {kind}, b {kind}", blocks)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances by a product; those so small that its rounding could show are summed as they are."""
    a, b = np.einsum("ij,ij->i", x, x)[:, None], np.einsum("ij,ij->i", y, y)[None]
    g = x @ y.T
    g *= -2
    g += a
    g += b
    p, q = np.nonzero(~(g > 1e-6 * (a + b)))
    for k in range(0, len(p), CHECKED):
        g[p[k : k + CHECKED], q[k : k + CHECKED]] = summed_squares(x[p[k : k + CHECKED]], y[q[k : k + CHECKED]])
    return np.sqrt(g, out=g)


def label_sums(rows: DataFrame, n: int, blocks: int | None = None) -> DataFrame:
    """(key, label, label2, s): parts of each row's sum of distances to the rows of each label; a row (key, label, values) is at 0 from itself."""
    kinds = dict(rows.select("key", "label").dtypes)

    def sums(d: np.ndarray, codes: np.ndarray, known: int) -> np.ndarray:
        """Sums of columns by code."""
        order = np.argsort(codes, kind="stable")
        begin = np.searchsorted(codes[order], np.arange(known))
        full = begin < np.append(begin[1:], len(order))
        out = np.zeros((len(d), known))
        out[:, full] = np.add.reduceat(d[:, order], begin[full], axis=1)
        return out

    def table(keys: pa.Array, labels: pa.Array, known: pa.Array, s: np.ndarray) -> pa.RecordBatch:
        row = pa.array(np.repeat(np.arange(len(keys)), len(known)))
        return pa.record_batch([keys.take(row), labels.take(row), known.take(pa.array(np.tile(np.arange(len(known)), len(keys)))), pa.array(s.ravel())], names=["key", "label", "label2", "s"])

    def run(left: Block, right: Block, same: bool) -> Iterator[pa.RecordBatch]:
        centre = left[2].mean(0)
        x, y = left[2] - centre, right[2] - centre
        two = right[1].dictionary_encode()
        codes = two.indices.to_numpy()
        for r in range(0, len(x), TILE):
            total = np.zeros((len(x[r : r + TILE]), len(two.dictionary)))
            for c in range(0, len(y), TILE):
                d = distances(x[r : r + TILE], y[c : c + TILE])
                total += sums(d, codes[c : c + TILE], len(two.dictionary))
            yield table(left[0][r : r + TILE], left[1][r : r + TILE], two.dictionary, total)
        if not same:
            one = left[1].dictionary_encode()
            codes = one.indices.to_numpy()
            for c in range(0, len(y), TILE):
                total = np.zeros((len(y[c : c + TILE]), len(one.dictionary)))
                for r in range(0, len(x), TILE):
                    total += sums(distances(y[c : c + TILE], x[r : r + TILE]), codes[r : r + TILE], len(one.dictionary))
                yield table(right[0][c : c + TILE], right[1][c : c + TILE], one.dictionary, total)

    return block_pairs(rows, n, run, f"key {kinds['key']}, label {kinds['label']}, label2 {kinds['label']}, s double", blocks)

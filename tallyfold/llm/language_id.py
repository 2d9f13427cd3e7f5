"""Language identification with interpolated Kneser-Ney character models.

Words (runs of letters and marks, lower case) are padded with a boundary sign; a model of order 5 is
trained per language on a bounded sample of labelled rows.  Probabilities of an n-gram for all languages stand side by
side: a sorted array of n-gram hashes per order, found by binary search, with one row of log-probabilities each, and one
of context hashes with log back-off weights.  A text's language has the lowest cross-entropy a character (its
end signs included); a calibrated limit on that cross-entropy, by language and length, rejects what fits none.

A text is scored whole: the distinct words of a batch are scored once and summed by document.  The score is the share of the
best language among all (over 50 characters at most), and falls with the excess of a rejected text's cross-entropy over its limit.

Edge cases: a null text, or one without letters (marks alone are none), is ``und`` with score 0 and rejected; ties go to the
language that sorts first; repeated rows get equal results; without any labelled row everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import lean, position, slices, with_column_names

ORDER = 5
#: Bound of the sample: documents a language, of which each fifth calibrates.
DOCS_PER_LANG = 400
#: Scores (of a character in a language) that are held at once.
CELLS = 1_000_000
UNDETERMINED = "und"
BOUNDARY = 0x20
#: Natural log-probability of a character that no language has seen, and deviations that the limit allows.
UNSEEN, DEVIATIONS = -np.log(1e5), 8.0
_B = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row of each word, distinct words, index of each word in them); a word has a letter."""
    low = pc.utf8_lower(pc.fill_null(column, ""))
    parts = pc.split_pattern_regex(low, r"[^\pL\pM]+")
    row = pc.list_parent_indices(parts).to_numpy()
    coded = parts.flatten().dictionary_encode()
    at = coded.indices.to_numpy()
    letter = pc.match_substring_regex(coded.dictionary, r"\pL").to_numpy(zero_copy_only=False)
    if not letter.all():  # the empty string, and marks alone
        keep = letter[at]
        row, at = row[keep], (np.cumsum(letter) - 1)[at[keep]]
    return row, coded.dictionary.filter(pa.array(letter)), at


class Grams:
    """Hashes of all n-grams of padded words: ``h[n]`` at each character, valid where ``depth`` + 1 >= n."""

    def __init__(self, words: list[str], order: int = ORDER):
        sign = chr(BOUNDARY)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), size)
        self.depth = np.arange(self.start[-1]) - np.repeat(self.start[:-1], size)
        self._hash(sign + (sign + sign).join(words) + sign if words else "", order)

    @classmethod
    def part(cls, padded: str, begin: int, end: int, order: int = ORDER) -> Grams:
        """Of the characters from ``begin`` to ``end`` of one padded word, with all that their n-grams reach back to."""
        out, back = cls.__new__(cls), max(0, begin - order)
        out.depth = np.arange(back, end)
        out._hash(padded[back:end], order)
        out.depth[: begin - back] = -1  # known, but not to be scored here
        return out

    def _hash(self, whole: str, order: int) -> None:
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.h = [np.zeros(len(cp), np.uint64)]
        for _ in range(order):
            last = self.h[-1]
            before = np.concatenate([[np.uint64(0)], last[:-1]]) if len(last) else last
            self.h.append((before ^ (before >> np.uint64(31))) * _B + (cp + np.uint64(1)) * _M)

    def context(self, n: int) -> np.ndarray:
        """Hash of the n - 1 characters before each character."""
        h = self.h[n - 1]
        return np.concatenate([[np.uint64(0)], h[:-1]]) if len(h) else h


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each key in a sorted array."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def count_by(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    table, at = np.unique(keys, return_inverse=True)
    return table, np.bincount(at, weights, len(table))


def one_model(words: list[str], counts: np.ndarray, order: int, discount: float = 0.75):
    """Per order: (n-gram hashes, probabilities) and (context hashes, back-off weights) of one language.

    The highest order uses counts; lower orders use continuation counts (distinct characters to the left),
    except n-grams at the start of a word, which nothing precedes.
    """
    g = Grams(words, order)
    weight = counts[g.word].astype(float)
    grams, contexts, below = [None], [None], None
    for n in range(1, order + 1):
        use = (g.depth >= max(1, n - 1)) & (g.depth + 1 >= n)
        key, ctx = g.h[n][use], g.context(n)[use]
        if n == order:
            amount = weight[use]
        else:
            longer = g.h[n + 1][use]
            inner = g.depth[use] + 1 > n
            _, first = np.unique(longer, return_index=True)
            distinct = np.zeros(len(key))
            distinct[first] = 1
            amount = np.where(inner, distinct, weight[use])
        table, total = count_by(key, amount)
        _, where = np.unique(key, return_index=True)
        ctx_of, lower_of = ctx[where], (g.h[n - 1][use][where] if n > 1 else None)
        ctx_table, ctx_total = count_by(ctx_of, total)
        _, kinds = count_by(ctx_of, np.minimum(total, discount))
        back = kinds / np.maximum(ctx_total, 1e-300)
        at, _ = find(ctx_table, ctx_of)
        own = np.maximum(total - discount, 0) / ctx_total[at]
        if n == 1:
            low = np.full(len(table), np.exp(UNSEEN))
        else:
            k, ok = find(below[0], lower_of)
            low = np.where(ok, below[1][k], np.exp(UNSEEN))
        p = own + back[at] * low
        grams.append((table, np.log(p)))
        contexts.append((ctx_table, np.log(np.maximum(back, 1e-9))))
        below = (table, p)
    return grams, contexts


@dataclass
class Model:
    """Languages, by order (sorted hashes, log-probabilities a language) and the same of contexts; limits."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray] | None]
    contexts: list[tuple[np.ndarray, np.ndarray] | None]
    mean: np.ndarray | None = None
    sd: np.ndarray | None = None

    @property
    def order(self) -> int:
        return len(self.grams) - 1

    def char_scores(self, g: Grams) -> np.ndarray:
        """Log-probability a language of each character (0 of those that are not predicted)."""
        out = np.zeros((len(g.depth), len(self.langs)), np.float32)
        todo = np.flatnonzero(g.depth > 0)
        for n in range(self.order, 0, -1):
            ready = g.depth[todo] + 1 >= n
            now = todo[ready]
            at, ok = find(self.grams[n][0], g.h[n][now])
            out[now[ok]] += self.grams[n][1][at[ok]]
            missed = now[~ok]
            k, known = find(self.contexts[n][0], g.context(n)[missed])
            out[missed[known]] += self.contexts[n][1][k[known]]
            todo = np.concatenate([todo[~ready], missed])
        out[todo] += np.float32(UNSEEN)
        return out

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability a language, characters predicted) of each word."""
        if not words:
            return np.zeros((0, len(self.langs))), np.zeros(0, np.int64)
        g = Grams(words, self.order)
        return np.add.reduceat(self.char_scores(g), g.start[:-1], axis=0, dtype=np.float64), np.diff(g.start) - 1

    def long_word_score(self, word: str, step: int) -> tuple[np.ndarray, np.ndarray]:
        """``word_scores`` of one word, ``step`` characters at a time."""
        padded = f"{chr(BOUNDARY)}{word}{chr(BOUNDARY)}"
        score = sum(self.char_scores(Grams.part(padded, k, min(k + step, len(padded)), self.order)).sum(0, np.float64) for k in range(0, len(padded), step))
        return score[None], np.array([len(padded) - 1])

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy a language, characters) of each text; 0 characters where it has no letter.

        Distinct words are scored once, CELLS scores of a character at a time, whatever their number and length.
        """
        row, words, at = words_of(column)
        by_word = np.argsort(at, kind="stable")
        row, at = row[by_word], at[by_word]
        most = max(1000, CELLS // len(self.langs))
        upto = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False) + 2)])
        n, total, a = np.zeros(len(column)), np.zeros((len(column), len(self.langs))), 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + most, side="right")) - 1)
            some = words.slice(a, b - a).to_pylist()
            score, size = self.long_word_score(some[0], most) if len(some) == 1 and len(some[0]) > most else self.word_scores(some)
            i, j = np.searchsorted(at, [a, b])
            own, k = row[i:j], at[i:j] - a
            n += np.bincount(own, size[k], len(column))
            for x in range(len(self.langs)):
                total[:, x] += np.bincount(own, score[k, x], len(column))
            a = b
        return -total / np.maximum(n, 1)[:, None], n.astype(np.int64)

    def limit(self, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.mean[lang] + DEVIATIONS * np.sqrt(self.sd[lang] ** 2 + 4.0 / np.maximum(n, 1))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        if not self.langs:
            none = np.zeros(len(column))
            return [UNDETERMINED] * len(column), none, none, none == 0
        h, n = self.entropies(column)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        spread = np.exp(-(h - low[:, None]) * np.minimum(n, 50)[:, None])
        limit = self.limit(best, n)
        score = np.where(n > 0, np.exp(np.minimum(0, limit - low)) / spread.sum(1), 0.0)
        lang = [self.langs[k] if m else UNDETERMINED for k, m in zip(best, n, strict=True)]
        return lang, score, np.where(n > 0, low, 0.0), (n == 0) | (low > limit)


def train(samples: dict[str, list[str]], order: int = ORDER) -> Model:
    """One model a language from its texts; each fifth text is kept to calibrate the rejection."""
    samples = {k: v for k, v in sorted(samples.items()) if any(map(str.strip, v))}
    models, rest = {}, {}
    for lang, own in samples.items():
        learn = [t for i, t in enumerate(own) if i % 5 != 4] or own
        rest[lang] = [t for i, t in enumerate(own) if i % 5 == 4] or own
        _, words, at = words_of(pa.array(learn, pa.string()))
        if len(at):
            models[lang] = one_model(words.to_pylist(), np.bincount(at, minlength=len(words)), order)
    langs = sorted(models)
    grams, contexts = [None], [None]
    for n in range(1, order + 1 if langs else 1):
        table = np.unique(np.concatenate([models[x][0][n][0] for x in langs]))
        ctx = np.unique(np.concatenate([models[x][1][n][0] for x in langs]))
        value, back = np.full((len(table), len(langs)), np.nan, np.float32), np.zeros((len(ctx), len(langs)), np.float32)
        for k, x in enumerate(langs):
            value[find(table, models[x][0][n][0])[0], k] = models[x][0][n][1]
            back[find(ctx, models[x][1][n][0])[0], k] = models[x][1][n][1]
        grams.append((table, value))
        contexts.append((ctx, back))
    out = Model(langs, grams, contexts)
    _complete(out, models, samples)
    if langs:
        stats = []
        for k, x in enumerate(langs):
            h, n = out.entropies(pa.array(rest[x], pa.string()))
            own = h[n > 0, k]
            stats.append((own.mean(), own.std()) if len(own) else (2.0, 1.0))
        out.mean, out.sd = np.array(stats).T
        out.sd = np.maximum(out.sd, 0.05)
    return out


def _complete(model: Model, models: dict, samples: dict[str, list[str]]) -> None:
    """Fill in, by back-off, what a language gives to the n-grams that only another one has seen."""
    if not model.langs:
        return
    words = sorted({w for own in samples.values() for w in words_of(pa.array(own, pa.string()))[1].to_pylist()})
    g = Grams(words, model.order)
    for n in range(1, model.order + 1):
        use = np.flatnonzero((g.depth >= 1) & (g.depth + 1 >= n))
        at, ok = find(model.grams[n][0], g.h[n][use])
        first = np.unique(at[ok], return_index=True)[1]
        use, at = use[ok][first], at[ok][first]
        table, value = model.grams[n]
        if n == 1:
            low = np.full((len(use), len(model.langs)), UNSEEN, np.float32)
        else:
            k, has = find(model.grams[n - 1][0], g.h[n - 1][use])
            low = np.where(has[:, None], model.grams[n - 1][1][k], np.float32(UNSEEN))
        k, has = find(model.contexts[n][0], g.context(n)[use])
        low = low + np.where(has[:, None], model.contexts[n][1][k], np.float32(0))
        value[at] = np.where(np.isnan(value[at]), low, value[at])
        np.nan_to_num(value, copy=False, nan=float(UNSEEN))


def sample(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> dict[str, list[str]]:
    """At most ``per_lang`` whole texts of each language, those of the lowest hash of doc_id.

    Only rows whose hash is in the lowest 4 ``per_lang`` / n of its range are ranked, n a language's documents: about 4
    ``per_lang`` rows a language at any size of the corpus, among which the first ``per_lang`` stand.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequent = known.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language
    low = F.xxhash64("doc_id").cast("double") <= F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(4.0 * per_lang) / F.col("n")) - F.lit(2.0**63)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").join(F.broadcast(frequent), "lang").where(low)
    chosen = chosen.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang).select("doc_id").distinct()  # per_lang rows a language at most
    rows = known.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text", F.xxhash64("doc_id").alias("h")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        if len(own := out.setdefault(r["lang"], [])) < per_lang:
            own.append(r["text"])
    return dict(list(out.items()))


def identify(docs: DataFrame, per_lang: int = DOCS_PER_LANG, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of every document; predictions need no shuffle."""
    docs = with_column_names(docs, "doc_id", "text", "lang")
    held = docs.sparkSession.sparkContext.broadcast(train(sample(docs, per_lang), order))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in slices(batches, "text"):
            lang, score, low, bad = model.predict(b.column(2))
            cols = [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64()), pa.array(bad, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame, per_lang: int = DOCS_PER_LANG, order: int = ORDER) -> DataFrame:
    """The documents that the model does not reject, with all their columns; ``lang`` becomes the prediction."""
    held = docs.sparkSession.sparkContext.broadcast(train(sample(docs.select("doc_id", "text", "lang"), per_lang), order))
    text, lang = (position(docs, c) for c in ("text", "lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in slices(batches, "text"):
            found, _, _, bad = model.predict(b.column(text))
            b = b.set_column(lang, b.schema.field(lang), pa.array(found, b.schema.field(lang).type))
            yield b.filter(pa.array(~bad))

    return docs.mapInArrow(lean(run), docs.schema)

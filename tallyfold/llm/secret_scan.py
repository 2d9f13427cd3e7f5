"""Secret scans: named patterns plus sliding-window Shannon entropy per character class.

Base spans: assignments to secret-like names, access keys and long hex strings, each kind leftmost and
non-overlapping.  Entropy spans: maximal runs of key characters are candidates; each is classed (hex, base36,
base64) by the characters it has, and its windows' Shannon entropy is kept by incremental counts: as the window moves, one
count falls and one grows, and only those two terms change.  A candidate whose best window reaches its
class's threshold is a span of kind ``entropy`` unless the allow-list knows it (paths, hosts, UUIDs, words, examples).
A UUID at its beginning, and a part between separators that names itself an example, are left out and the rest is judged.

Spans are in code points, end exclusive.  Edge cases: a null or empty text has no span; very long texts
are scanned whole, in one pass per pattern; repeated rows have equal spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import lean, position, slices, with_column_names

ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
#: Text without a match of these has no span of the kind; Arrow checks a whole column at once.
HINTS = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}", "entropy": "[A-Za-z0-9+/_=-]{20}"}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character that a window must reach, by class; random windows of 20 have about 3.3, 3.9 and 4.1.
THRESHOLD = {"hex": 3.0, "base36": 3.5, "base64": 3.7}
#: UUIDs at the beginning, each up to a separator or the end.
UUIDS = re.compile(r"(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![0-9A-Za-z])[+/_=-]*)+")
EXAMPLE = re.compile(r"(?i:example|sample|dummy|placeholder|changeme|xxxx)")
PART = re.compile(r"[^+/_=-]+")
ALLOW = (
    re.compile(r"[0-9_=+/-]+\Z"),  # numbers and rules
    re.compile(r"(?:[a-z]|[A-Z](?=[a-z])|(?<=[a-z])[_/-])+[0-9]{0,4}\Z"),  # words, paths, camel case; one way to match only
)
#: A part of words; a candidate without digits that has no other part is no key.
NAME = re.compile(r"(?:[a-z]|[A-Z](?=[a-z]))+\Z|[A-Z]+\Z")
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def window_entropy(s: str, width: int = WINDOW) -> float:
    """The largest Shannon entropy of a window, by incremental counts; a shorter string is one window."""
    width = min(width, len(s))
    if not width:
        return 0.0
    term = _TERM if width <= WINDOW else [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    count = Counter(s[:width])
    total = sum(term[c] for c in count.values())
    least = total
    for i in range(width, len(s)):
        new, old = s[i], s[i - width]
        if new != old:
            c = count[new]
            total += term[c + 1] - term[c]
            count[new] = c + 1
            c = count[old]
            total += term[c - 1] - term[c]
            count[old] = c - 1
            least = min(least, total)
    return math.log2(width) - least / width


def character_class(s: str) -> str | None:
    """hex, base36 or base64 for strings that mix letters and digits, or letters of both cases; else None."""
    digit, lower, upper = any("0" <= c <= "9" for c in s), any("a" <= c <= "z" for c in s), any("A" <= c <= "Z" for c in s)
    if not (lower and upper) and not (digit and (lower or upper)):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    if lower and upper:
        return "base64"
    return "base36"


def stretches(s: str) -> list[str]:
    """A candidate without UUIDs at its beginning, cut where a part is an example; a window long at least."""
    if m := UUIDS.match(s):
        s = s[m.end() :]
    out, at = [], 0
    if EXAMPLE.search(s):
        for p in PART.finditer(s):
            if EXAMPLE.search(p[0]):
                out.append(s[at : p.start()])
                at = p.end()
    out.append(s[at:])
    return [x for x in out if len(x) >= WINDOW]


def is_key(s: str) -> bool:
    kind = character_class(s)
    if not kind or any(a.match(s) for a in ALLOW):
        return False
    if not any("0" <= c <= "9" for c in s) and all(NAME.match(p) for p in PART.findall(s)):
        return False
    return window_entropy(s) >= THRESHOLD[kind]


def entropy_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if any(map(is_key, stretches(m[0])))]


def base_spans(text: str, kinds: tuple[str, ...] = KINDS[:3]) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind.  A run of hex digits is one match, so asking for 24 at once gives the same ones."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS[:3]}
    if "assign" in kinds:
        out["assign"] = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "access" in kinds:
        out["access"] = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if "hex" in kinds:
        out["hex"] = [m.span() for m in LONG_HEX.finditer(text)]
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    rows = sorted((s, KINDS.index(k), e) for k, of in spans.items() for s, e in of)
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)


def scan_batch(column: pa.Array) -> list[dict[str, list[tuple[int, int]]]]:
    """Spans of every text; only rows with a hint of a kind are searched for it."""
    column = pc.fill_null(column, "")
    hint = {k: pc.match_substring_regex(column, p).to_pylist() for k, p in HINTS.items()}
    out = []
    for i in range(len(column)):
        kinds = tuple(k for k in KINDS if hint[k][i])
        text = column[i].as_py() if kinds else ""
        spans = base_spans(text, kinds)
        spans["entropy"] = entropy_spans(text) if "entropy" in kinds else []
        out.append(spans)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = scan_batch(b.column(1))
            base = [joined({k: s[k] for k in KINDS[:3]}) for s in found]
            cols = [b.column(0), *(pa.array([len(s[k]) for s in found], pa.int64()) for k in KINDS[:3])]
            cols.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()))
            cols.append(pa.array([joined(s) for s in found], pa.string()))
            cols.append(pa.array([len(s["entropy"]) for s in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    docs = with_column_names(docs, "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(lean(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


MASK = "[SECRET]"


def masked(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with the union of all spans masked, overlapping ones once."""
    out, at = [], 0
    for s, e in sorted(x for of in spans.values() for x in of):
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with secrets masked in ``text``; all rows and other columns stay, n_chars (if there) follows."""

    k, n = (position(docs, c) if c in map(str.lower, docs.columns) else -1 for c in ("text", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            column = b.column(k)
            out = [None if t is None else masked(t, s) for t, s in zip(column.to_pylist(), scan_batch(column), strict=True)]
            b = b.set_column(k, b.schema.field(k), pa.array(out, b.schema.field(k).type))
            if n >= 0:
                f = b.schema.field(n)
                b = b.set_column(n, f, pa.array([None if t is None else len(t) for t in out], f.type))
            yield b

    return docs.mapInArrow(lean(run), docs.schema)

"""Each operator against brute force on small inputs, and on nulls, empty and repeated rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfold.llm import decontaminate, fingerprint, html_extract, language_id, license_scan, packing, repeats, secret_scan, simhash, url_filter
from tallyfold.llm._common import lean

EDGE = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "same text here"), (6, "same text here"), (6, "same text here"), (None, "no id at all"), (7, "Ünï — 日本 " * 50)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def edge(spark):
    from pyspark.sql import functions as F

    return docs(spark, EDGE).withColumn("lang", F.lit("en")).withColumn("key", F.lit(1)).withColumn("fp", F.lit(2))


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def test_edge_rows(spark, edge):
    empty, benchmark = edge.limit(0), spark.createDataFrame([(1, "same text here"), (2, None), (3, "")], "item_id long, text string")
    assert license_scan.scan(edge).count() == secret_scan.scan(edge).count() == 9
    assert {r["lang_pred"] for r in language_id.identify(edge).where("doc_id < 4").collect()} == {"und"}
    assert {r["lang_pred"] for r in language_id.identify(edge.where("doc_id < 4")).collect()} == {"und"}
    assert fingerprint.fingerprint_documents(edge).count() == simhash.near_duplicates(edge).count() == repeats.remove_repeats(edge).where("n_removed = 0 or doc_id = 7").count() == 9
    assert packing.pack(edge).count() == 9
    assert sorted(r["doc_id"] for r in decontaminate.matches(edge, benchmark).collect()) == [5, 6]
    assert decontaminate.clean(edge, benchmark).count() == 6
    for f in (license_scan.scan, secret_scan.scan, language_id.identify, fingerprint.fingerprint_documents, simhash.near_duplicates, repeats.remove_repeats, packing.pack, simhash.keep_first):
        assert f(empty).count() == 0
    assert decontaminate.matches(empty, benchmark).count() == decontaminate.matches(edge, benchmark.limit(0)).count() == 0
    kept = sorted(r["doc_id"] for r in simhash.keep_first(edge.where("doc_id is not null")).collect())
    assert kept == [1, 4, 5, 7]


def test_license_bounds():
    m, rng = license_scan.Matcher(), random.Random(1)

    def dice(a, b):
        x, y = (Counter(license_scan.bigrams(re.findall("[a-z0-9]+", s.lower()))) for s in (a, b))
        return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))

    for _ in range(300):
        w = rng.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w)), rng.choice(["the", "zz", "License"]))
        text = " ".join(w[rng.randrange(3) :])
        best = max(dice(text, t) for _, t in license_scan.TEMPLATES)
        assert (m.best(text) or (0,))[0] == pytest.approx(best if best >= 0.8 else 0)


def test_decontamination(spark):
    items = [(k, " ".join(words(n, k))) for k, n in enumerate((6, 20, 60, 120))]
    rows = []
    for k, (_, text) in enumerate(items):
        w = text.split()
        rows += [(10 * k, " ".join(words(50, 90 + k) + w + words(30, 80 + k))), (10 * k + 1, ("x. " + text.upper().replace(" ", ", ")))]
        changed = w[:]
        changed[len(w) // 2] = "changed"
        rows += [(10 * k + 2, " ".join(words(40, 70 + k) + changed)), (10 * k + 3, " ".join(words(200, 60 + k)))]

    def brute():
        for d, t in rows:
            v = re.findall("[a-z0-9]+", t.lower())
            for i, b in items:
                w = b.split()
                want, best = Counter(zip(*(w[k:] for k in range(5)))), 0
                for s in range(max(1, len(v) - len(w) + 1)):
                    own = Counter(zip(*(v[s : s + len(w)][k:] for k in range(5))))
                    best = max(best, sum((own & want).values()) / max(1, sum((own | want).values())))
                if best >= 0.8:
                    yield d, i, round(best, 6)

    got = decontaminate.matches(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], round(r["similarity"], 6)) for r in got) == sorted(brute())
    assert len(got) >= 9


def test_clean_joins_alike_beyond_the_broadcast_bound(monkeypatch, spark, edge):
    benchmark = spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    small = sorted(decontaminate.clean(edge, benchmark).collect(), key=str)
    monkeypatch.setattr(decontaminate, "BROADCAST_IDS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    large = decontaminate.clean(edge, benchmark)
    assert sorted(large.collect(), key=str) == small and len(small) == 6
    assert "SortMergeJoin" in large._jdf.queryExecution().sparkPlan().toString()


def test_url_filter(spark):
    urls = ["http://a.com/x", "https://B.example.com/en/1?q", "https://www.example.com/en/", "http://x.net/fr/a#b", "http://x.net", None, "no scheme", "http://spam.org/p", "http://com", "http://fan.org/?/en/", "s://good.org#/x"]
    html = ['<a href="http://spam.org/">', "", None, "", "", "", "", '<a href="http://x.net/fr/">', "", "<a href='http://x.net/q'>", ""]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1] == ("b.example.com", "/en/1", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("net/fr/", "block")
    assert got[4] == ("x.net", "", None, "block")  # its host is a blocked seed
    assert got[5] == got[6] == ("", "", None, "allow") and got[8] == ("com", "", None, "allow")
    assert got[9] == ("fan.org", "/", None, "block") and got[10] == ("good.org", "", None, "allow")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_language_model_is_interpolated_kneser_ney():
    """Against counts in dictionaries: each order's probabilities, and their sum over 100,000 characters."""
    known, order, discount = {"then": 3, "the": 2, "that": 1, "hat": 1, "aaa": 2}, 3, 0.75
    padded = {f" {w} ": n for w, n in known.items()}
    counts = Counter()
    for n in range(1, order + 1):
        left = {}
        for w, times in padded.items():
            for i in range(1, len(w)):
                if i + 1 >= n:
                    g = w[i + 1 - n : i + 1]
                    if n == order or i + 1 == n:  # counts: the highest order, and at the start of a word
                        counts[n, g] += times
                    else:
                        left.setdefault(g, set()).add(w[i - n : i + 1])
        for g, before in left.items():
            counts[n, g] += len(before)

    def p(n, context, c):
        if not n:
            return 1e-5
        own = {g: k for (m, g), k in counts.items() if m == n and g[:-1] == context}
        if not own:
            return p(n - 1, context[1:], c)
        total = sum(own.values())
        back = sum(min(k, discount) for k in own.values()) / total
        return max(own.get(context + c, 0) - discount, 0) / total + back * p(n - 1, context[1:], c)

    once = language_id.one_model(list(known), np.array(list(known.values())), order)
    m = language_id.Model(["x"], [None] + [(t, v[:, None].astype(np.float32)) for t, v in once[0][1:]], [None] + [(t, v[:, None].astype(np.float32)) for t, v in once[1][1:]])
    for word in ("the", "tha", "zzz", "nehta", "aaaa", "h", "hatthen"):
        w = f" {word} "
        want = sum(math.log(p(min(order, i + 1), w[max(0, i + 1 - order) : i], w[i])) for i in range(1, len(w)))
        assert m.word_scores([word])[0][0, 0] == pytest.approx(want, rel=1e-6)
        assert m.long_word_score(word, 2)[0][0, 0] == pytest.approx(want, rel=1e-6)
    letters = {c for w in padded for c in w}
    for context in ("th", "ha", " t", "zz"):
        assert sum(p(3, context, c) for c in letters) + (1e5 - len(letters)) * p(3, context, "\0") == pytest.approx(1, rel=1e-9)


def test_language_of_texts(monkeypatch):
    a, b = ["the cat and the other thing there"] * 10, ["der und die nicht eine schule ich"] * 10
    m = language_id.train({"en": a, "de": b})
    lang, score, _, bad = m.predict(pa.array(["the other cat", "nicht die schule", "", None, "12"]))
    assert lang == ["en", "de", "und", "und", "und"] and list(bad[2:]) == [True] * 3 and (score[:2] > 0.9).all()
    far = m.predict(pa.array(["漢字仮名交じり文" * 30, "\u0301\u0300 \u0301", "the other cat " * 50 + "\u0301"]))
    assert far[0][1:] == ["und", "en"] and list(far[3]) == [True, True, False] and far[1][0] < 0.5 and far[1][1] == 0
    column = pa.array(["the other cat " * 9, "nicht" * 4000, None])
    whole = m.entropies(column)
    monkeypatch.setattr(language_id, "CELLS", 10)
    for x, y in zip(whole, m.entropies(column), strict=True):
        assert np.allclose(x, y, rtol=1e-5)


def test_fingerprint(spark):
    rows = [(i, " ".join(words(n, i))) for i, n in enumerate((0, 3, 5, 40, 300, 300, 900))] + [(9, " ".join(words(300, 4)))]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs(spark, rows).repartition(3)).collect()}
    order = sorted(rows, reverse=True)

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        for name, other in (("near_edited", e), ("near_next", u)):
            a, b = shingles(t), shingles(other)
            assert got[i][name] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.15)
        assert got[i]["shingles"] == pytest.approx(len(shingles(t)), rel=0.35)
    assert got[4]["fingerprint"] == got[9]["fingerprint"]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    rows = [(i, " ".join(words(n, i))) for i, n in enumerate((1, 10, 500, 2500, 4000, 700, 700, 30))] + [(50, "It'S Ünï\t12 ß <|endoftext|> ΑΣ. — 日本 x\x1cy"), (51, None)]
    got = packing.pack(docs(spark, rows)).collect()
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in {r["sequence_id"] for r in got}:
        end = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 4096
    rng = random.Random(2)
    for _ in range(200):
        counts, room = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}, rng.randrange(1, 90)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        fill = packing.best_fill(room, counts)
        assert sum(k * n for k, n in fill.items()) == max(s for s in sums if s <= room) and all(n <= counts[k] for k, n in fill.items())


def test_simhash(spark):
    base = words(120, 1)
    rows = [(i, " ".join(base[: 120 - i % 3] if i % 2 else words(60, i))) for i in range(40)] + [(99, "A b C"), (98, "a B c"), (97, None), (96, "")]

    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f, root = {i: fp(t) for i, t in rows}, {}
    for i in sorted(f):
        todo, found = [i], set()
        while todo:
            x = todo.pop()
            if x not in found:
                found.add(x)
                todo += [y for y in f if (f[x] ^ f[y]).bit_count() <= 2]
        root[i] = min(found)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: (f"{f[i]:016x}", root[i]) for i in f}


def test_bit_slices_and_chunked_buckets(monkeypatch, spark):
    rng = np.random.default_rng(3)
    fps = np.unique(np.array([int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in rng.integers(0, 2**62, 40) for _ in range(8)], np.uint64))
    starts = np.array([0, 7, 150])
    root = simhash.bucket_components(fps, starts)
    for a, e in zip(starts, [*starts[1:], len(fps)], strict=True):
        want = np.arange(len(fps))
        for _ in range(12):
            for i in range(a, e):
                for j in range(a, e):
                    if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2:
                        want[i] = min(want[i], want[j])
        assert (root[a:e] == want[a:e]).all()
    monkeypatch.setattr(simhash, "CHUNK", 50)
    ball = spark.createDataFrame([(int(1 << a | 1 << b),) for a in range(20) for b in range(20, 40)], "fp long")
    from tallyfold.llm._common import Workspace
    from tallyfold.llm._components import components

    label = components(simhash.star_edges(ball.distinct(), work := Workspace(spark, "test")), work).select("label").distinct()
    assert label.count() == 1


def test_secrets():
    t = "x PassWord = 'hunter22' token:abc api-key=1 apikey = zzzzzz AKIA" + "A1" * 9 + " é " + "0123456789abcdef" * 2 + " aB3$"
    found = secret_scan.scan_batch(pa.array([t, None]))
    a, k, h = found[0]["assign"], found[0]["access"], found[0]["hex"]
    assert [t[s:e] for s, e in a] == ["PassWord = 'hunter22", "apikey = zzzzzz"]
    assert [len(t[s:e]) for s, e in k] == [22] and [t[s:e] for s, e in h] == ["0123456789abcdef" * 2]
    assert secret_scan.joined(found[1]) == ""
    key = "q9Zx2LmN7pRt5VwY1kBc8Df"
    assert secret_scan.entropy_spans(f"id {key} ok") == [(3, 3 + len(key))]
    for clean in ("aReallyLongCamelCaseIdentifierName", "path/to/some/long/file", "00000000000000000000001", "EXAMPLEkey9Zx2LmN7pRt5VwY", "8d1e2f3a-1b2c-4d5e-8f90-123456789abc"):
        assert secret_scan.entropy_spans(clean) == []
    rng = random.Random(4)
    for _ in range(50):
        s = "".join(rng.choice("abcdef01") for _ in range(rng.randrange(1, 60)))
        w = min(20, len(s))
        want = max(-sum(c / w * np.log2(c / w) for c in Counter(s[i : i + w]).values()) for i in range(len(s) - w + 1))
        assert secret_scan.window_entropy(s) == pytest.approx(want, abs=1e-9)
    assert secret_scan.masked("a secret=abcdef b", {"assign": [(2, 15)], "hex": [(9, 15)]}) == "a [SECRET] b"


@pytest.mark.parametrize("hot", [repeats.HOT_RUNS, 1])
def test_repeats(spark, monkeypatch, hot):
    """With whole buckets, and with every bucket split."""
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    monkeypatch.setattr(repeats, "HOT_SAMPLE", 1 if hot == 1 else repeats.HOT_SAMPLE)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [text(n) for n in (99, 100, 150, 400)]
    rows = [(i * 3 % 64, "".join(rng.choice([text(rng.randrange(1, 150)), rng.choice(shared), "ab" * rng.randrange(1, 150)]) for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, rows[0][1]), (203, rows[1][1] * 3)]
    seen, want = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        bad = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                bad[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        spans = sum(1 for i in range(len(b)) if bad[i] and not (i and bad[i - 1]))
        want.append((d, len(b), sum(bad), spans, hashlib.sha256(bytes(x for x, y in zip(b, bad, strict=True) if not y)).hexdigest()))
    assert sorted(map(tuple, repeats.remove_repeats(docs(spark, rows).repartition(5)).collect())) == sorted(want)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy, now.</div>%s<div class="comments"><p>First! I do not agree, at all.</p></div><footer>&copy; x</footer>"""


def test_html():
    body = "<h1>A &amp; B</h1><p><b>One,\n two.<br>Three<p>Four <i>f</i>ive.</p>"
    want = "A & B\n\nOne, two. Three\n\nFour five."
    assert html_extract.extract(PAGE % f"<article>{body}</article>") == want
    assert html_extract.extract(PAGE % f'<div class="story-body">{body}</div>') == want
    long = "".join(f"<p>This is a sentence of some length, with marks, number {k}.</p>" for k in range(5))
    assert html_extract.extract(PAGE % f"<div><div>{long}</div><span>x</span></div>").count("sentence") == 5
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<script>x") == ""
    assert html_extract.extract("just text &lt;3 ") == "just text <3"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(words(40, 77))
    rows = [(i, f"the quick brown fox number {i} " + " ".join(words(60, i)), "en", "s", 1) for i in range(30)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, "some words before " + item, "en", "s", 1), (102, "123 456", "en", "s", 1), (103, "my password = hunter2222 is here with " + " ".join(words(50, 3000)), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {*range(30), 103}


def test_html_ratios_select_the_article():
    long = "A long sentence, with marks; and more of it. " * 4
    comment = f"<article><p>Comment: {long}</p></article><article class='comment'><p>Reply: {long}</p></article>"
    page = f"<body><div><p>Short note.</p></div><article><h1>T</h1><p>{long}</p><p>Be.</p>{comment}</article></body>"
    assert html_extract.extract(page) == f"T\n\n{long.strip()}\n\nBe."
    # no element says that it is the article: the ratios find it
    assert html_extract.extract(f"<body><div class='x'><ul><li>a</li><li>b</li></ul></div><section><h1>T</h1><p>{long}</p></section></body>") == f"T\n\n{long.strip()}"


def test_language_sample_is_the_lowest_hashes(spark):
    rows = [(k, f"text {k}", "en" if k % 3 else "de") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.sample(docs, per_lang=50)
    known = docs.where(~language_id.held_out(F.col("doc_id"))).select("text", "lang", F.xxhash64("doc_id").alias("h")).collect()
    want = {x: [r["text"] for r in sorted((r for r in known if r["lang"] == x), key=lambda r: r["h"])[:50]] for x in ("de", "en")}
    assert got == want


def test_a_run_begins_without_the_caches_of_others():
    of = packing.chunks(packing.default_tokenizer())
    list(of.ids(pa.array(["some words"])))
    assert list(lean(iter, "chunks")(iter([1]))) == [1]
    assert packing.chunks(packing.default_tokenizer()) is of
    assert list(lean(iter)(iter([1]))) == [1]
    assert packing.chunks(packing.default_tokenizer()) is not of

"""Queries of this subpackage against their SQL, and operators 1 and 3 on texts and links that the tables don't have."""

import duckdb
import pytest

from tallyfold.llm import license_scan, queries, url_filter

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA), c.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


def test_notices_over_lines_and_inside_them(spark):
    by_name = {}
    for name, text in license_scan.TEMPLATES:
        by_name.setdefault(name, []).append(text)
    rows, want = [], {}
    for k, (name, texts) in enumerate(by_name.items()):
        w = max(texts, key=len).split()
        wrapped = "\n * ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))
        rows += [(10 * k, f"/* Copyright 2020 Some One\n * {wrapped}\n */\nint main() {{ return 0; }}\n" + "x = y + z;\n" * 40)]
        rows += [(10 * k + 1, "some words of a file before it, and then " + " ".join(w) + " which is followed by others " * 5)]
        want |= {10 * k: name, 10 * k + 1: name}
    rows += [(990, "Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0."), (991, "This package is released under the MIT License, see LICENSE for details.")]
    rows += [(992, "We talk about the general public and a license to fish. " * 30), (993, None), (994, "")]
    want |= {990: "Apache-2.0", 991: "MIT", 992: None, 993: None, 994: None}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert {d: (want[d] if r["licenses"] and want[d] and want[d] in r["licenses"].split(",") else r["license"]) for d, r in got.items()} == want
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    assert plain((r["doc_id"], r["license"], r["dice"], r["n_licenses"], r["licenses"]) for r in got.values()) == plain(c.sql(queries.license_sql()).fetchall())


def test_propagation_against_sql_and_at_two_sizes(spark):
    def page(host, links, path="/p"):
        return f"http://{host}{path}", "".join(f"<a href='{x}'>" for x in links)

    base = [page("bad.net", [], "/fr/x"), page("good.com", ["http://mid.org/", "//far.org/a"], "/"), page("one.org", ["//bad.net/"]), page("two.org", ["http://one.org", "http://mid.org"])]
    base += [page("mid.org", ["http://bad.net/q"]), page("far.org", ["http://two.org/"]), page("lone.org", []), page("three.org", ["http://two.org/", "http://three.org/"])]
    base += [page(f"hub{k}.org", ["http://bad.net/"]) for k in range(40)]
    c = duckdb.connect()
    seen = []
    for copies in (1, 30):
        rows = [(k, u.replace(".", f"-{i}.", 1), h.replace(".org", f"-{i}.org").replace(".net", f"-{i}.net").replace(f"-{i}-{i}", f"-{i}")) for i in range(copies) for k, (u, h) in enumerate(base)]
        rows = [(len(base) * j + k, u, h) for j, (k, u, h) in enumerate(rows)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = url_filter.filter_urls(pages)
        c.register("pages", pages.toPandas())
        want = c.sql(queries.url_sql())
        assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())
        seen.append({r["host"].replace("-0", ""): r["verdict"] for r in got.where("host like '%-0.%'").collect()})
    assert seen[0] == seen[1]
    assert seen[0]["hub7.org"] == seen[0]["three.org"] == "block"
    assert {seen[0][h] for h in ("lone.org", "one.org", "two.org", "mid.org")} == {"allow"}  # good.com trusts the last three

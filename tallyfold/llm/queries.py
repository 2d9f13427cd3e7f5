"""The registered queries of this subpackage, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, html_extract, language_id, license_scan, packing, repeats, secret_scan, simhash, url_filter
from ._common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    own = (
        op1_license_scan,
        op2_decontamination,
        op3_url_filter,
        op4_language_id,
        op5_fingerprints,
        op6_packing,
        op7_simhash_dedup,
        op8_secret_scan,
        op9_suffix_dedup,
        op10_html_extraction,
    )
    return {f.__name__: f for f in own}


def license_sql() -> str:
    """Lines, whole texts and windows at anchors against the templates, by word bigrams."""
    rows = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(license_scan.TEMPLATES))
    marks = ", ".join(f"({k}, {at}, '{gram}')" for k, at, gram in license_scan.anchors())
    t = license_scan.THRESHOLD
    grams = "CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END"
    return f"""
WITH templates(k, name, body) AS (VALUES {rows}), anchors(k, place, gram) AS (VALUES {marks}),
tw AS (SELECT k, name, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM templates),
tg AS (SELECT k, name, len(g) AS n, g FROM (SELECT k, name, {grams} AS g FROM tw)),
tc AS (SELECT k, gram, count(*) AS c FROM (SELECT k, unnest(g) AS gram FROM tg) GROUP BY ALL),
ids AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT rid, string_split(text, chr(10)) AS l, text FROM ids),
segments AS (SELECT rid, unnest(CASE WHEN len(l) = 1 THEN l ELSE list_append(l, text) END) AS s FROM lines),
numbered AS (SELECT row_number() OVER () AS sid, rid, regexp_extract_all(lower(s), '[a-z0-9]+') AS w FROM segments),
sg AS (SELECT sid, rid, {grams} AS g FROM numbered WHERE len(w) > 0),
sized AS (SELECT sid, rid, len(g) AS n, g FROM sg WHERE len(g) <= (SELECT max(n) FROM tg) * (2 - {t}) / {t} + 1),
sc AS (SELECT sid, gram, count(*) AS c FROM (SELECT sid, unnest(g) AS gram FROM sized) GROUP BY ALL),
common AS (SELECT sc.sid, tc.k, sum(least(sc.c, tc.c)) AS c FROM sc JOIN tc USING (gram) GROUP BY ALL),
scored AS (SELECT s.rid, tg.k, tg.name, CAST(2 * common.c AS DOUBLE) / (s.n + tg.n) AS dice FROM common JOIN sized s USING (sid) JOIN tg USING (k)),
whole AS (SELECT rid, {grams} AS g FROM (SELECT rid, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM ids)),
placed AS (SELECT rid, unnest(g) AS gram, generate_subscripts(g, 1) - 1 AS p, len(g) AS m FROM whole WHERE len(g) > 0),
wins AS (SELECT DISTINCT rid, k, greatest(0, least(p - place, m - n)) AS b, n FROM placed JOIN anchors USING (gram) JOIN tg USING (k) WHERE n <= m),
wc AS (SELECT rid, k, b, n, gram, count(*) AS c FROM (SELECT rid, k, b, n, unnest(g[b + 1 : b + n]) AS gram FROM wins JOIN whole USING (rid)) GROUP BY ALL),
ws AS (SELECT rid, k, b, n, sum(least(wc.c, tc.c)) AS c FROM wc JOIN tc USING (k, gram) GROUP BY ALL),
hits AS (SELECT rid, k, name, dice FROM scored WHERE dice >= {t} UNION ALL SELECT rid, k, name, CAST(2 * c AS DOUBLE) / (2 * ws.n) FROM ws JOIN tg USING (k) WHERE CAST(2 * c AS DOUBLE) / (2 * ws.n) >= {t}),
byd AS (SELECT rid, arg_min(name, (-dice, k)) AS license, max(dice) AS dice, count(DISTINCT name) AS n_licenses, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM hits GROUP BY rid)
SELECT ids.doc_id, byd.license, coalesce(byd.dice, 0.0) AS dice, coalesce(byd.n_licenses, 0) AS n_licenses, byd.licenses FROM ids LEFT JOIN byd USING (rid)"""


def url_sql(damping: float = 0.85, steps: int = 57) -> str:
    """Rules by longest match; trust and distrust as sums over paths of as many steps as the tolerance can ask for."""

    def host(url: str) -> str:
        return f"CASE WHEN strpos({url}, '://') > 0 THEN translate(regexp_extract(substr({url}, strpos({url}, '://') + 3), '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') ELSE '' END"

    path = "CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    rules = ", ".join(f"({k}, '{r.verdict}', '{r.host}', '{r.path}', '{r.text}')" for k, r in enumerate(url_filter.RULES))
    link = url_filter.LINK.replace("'", "''")

    def rank(name: str, seed: str, src: str, dst: str) -> str:
        return f"""flow_{name} AS (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS share FROM edges),
step_{name}(k, host, mass) AS (SELECT 0, host, 1.0::DOUBLE FROM seeds WHERE {seed} UNION ALL
  SELECT k + 1, dst, {damping} * sum(mass * share) FROM step_{name} JOIN flow_{name} ON host = src WHERE k < {steps} GROUP BY k, dst),
{name} AS (SELECT host, {1 - damping} * sum(mass) AS rank FROM step_{name} GROUP BY host)"""

    return f"""
WITH RECURSIVE rules(k, verdict, rhost, rpath, rule) AS (VALUES {rules}),
own AS (SELECT row_number() OVER () AS rid, page_id, html, {host("url")} AS host, {path} AS path FROM pages),
named AS (SELECT rid, page_id, html, coalesce(host, '') AS host, coalesce(path, '') AS path FROM own),
fits AS (SELECT rid, rule, verdict FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, k) = 1),
judged AS (SELECT named.*, rule, verdict FROM named LEFT JOIN fits USING (rid)),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS url FROM judged WHERE host <> ''),
full_links AS (SELECT src, CASE WHEN starts_with(url, '//') THEN 'x:' || url ELSE url END AS url FROM links),
each AS (SELECT src, {host("url")} AS dst FROM full_links),
edges AS (SELECT src, dst, count(*) AS n FROM each WHERE dst <> '' AND dst <> src GROUP BY src, dst),
seeds AS (SELECT host, bool_or(verdict = 'block') AS b, bool_or(verdict = 'allow') AS a FROM judged WHERE host <> '' AND verdict IS NOT NULL GROUP BY host),
{rank("trust", "a AND NOT b", "src", "dst")},
{rank("distrust", "b", "dst", "src")},
bad AS (SELECT d.host FROM distrust d LEFT JOIN trust t USING (host) WHERE d.rank > coalesce(t.rank, 0))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_sql(), "op3_url_filter": url_sql()}

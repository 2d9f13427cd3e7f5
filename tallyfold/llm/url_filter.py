"""URL filters: explicit host and path rules, then link-graph propagation of trust and distrust.

Trust is a personalised PageRank from trusted seed hosts along host links; distrust is one from blocked
seed hosts along reversed links (a host that links to a blocked one is suspect).  Both run in Spark over
the aggregated host edges.  Every seed begins with 1, whatever the number of seeds, so that a host's values depend on what links
to it and from it alone; a host is blocked when its distrust exceeds ``ratio`` times its trust.  What seeds pass on is followed
step by step until no host gets ``tolerance`` any more (after k steps none gets more than damping ** k of all seeds around it).

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule, is in no graph and
is allowed.  Null html has no links.  Repeated rows are judged alike (their links count again, ties of rules go to the first),
empty tables give empty results, other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, with_column_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host/path`` with the verdict allow or block; it fits the host, its subdomains and longer paths."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: A link to a host: with a scheme, or with that of its page.
LINK = r"(?i)href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"
#: Rules are compiled into one expression, so their number is bounded.
MAX_RULES = 1000
#: Steps that are always enough: at a damping of 0.85 less than 1e-14 of a seed is left.
MAX_STEPS = 200


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; ties go to the rule given first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted.  Relative links stay on their host."""
    links = F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))
    each = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(links).alias("url"))
    whole = F.when(F.col("url").startswith("//"), F.concat(F.lit("x:"), "url")).otherwise(F.col("url"))
    each = each.select("src", host_of(whole).alias("dst"))
    return each.where((F.col("dst") != "") & (F.col("dst") != F.col("src"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_pagerank(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float, work: Workspace) -> DataFrame:
    """(host, rank) of the hosts that a seed reaches: rank = (1-d) * (seed + d * flow(seed) + d^2 * flow(flow(seed)) + ...).

    ``seeds`` has (host, ``mass``), ``edges`` (src, dst, n); a host's mass flows over its edges in proportion to n, and
    stays nowhere if it has none.  Each step joins and aggregates by host, combined before the shuffle, and is written to the
    shared folder; one number a step comes to the driver.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    flow = work.save(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    now = work.save(seeds.select("host", F.col("mass").cast("double").alias("mass")))
    rank = now
    for _ in range(MAX_STEPS):
        step = flow.join(now.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host"))
        now = work.save(step.agg((damping * F.sum(F.col("mass") * F.col("share"))).alias("mass")))
        if not (most := now.agg(F.max("mass").alias("m")).first()["m"]):
            break
        rank = work.save(rank.unionByName(now).groupBy("host").agg(F.sum("mass").alias("mass")))
        if most < tolerance:
            break
    return rank.groupBy("host").agg(((1 - damping) * F.sum("mass")).alias("rank"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, tolerance: float = 1e-4, ratio: float = 1.0) -> DataFrame:
    """Judge every page: page_id, host, path, rule, verdict, trust, distrust.

    Seeds: hosts with a page that an allow (trusted) or block rule fits, 1 each; a host with both is a blocked seed only.
    A page without a rule takes its host's verdict: block when distrust > ``ratio`` * trust, else allow.
    """
    pages = with_column_names(pages, "page_id", "url", "html")
    url = F.col("url")
    judged = pages.select("page_id", "html", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    judged = judged.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    work = Workspace(pages.sparkSession, "urls")
    edges = work.save(host_edges(judged))
    blocked, allowed = ((F.col("hit.verdict") == v).cast("int") for v in ("block", "allow"))
    seeds = work.save(judged.where("host <> '' and hit is not null").groupBy("host").agg(F.max(blocked).alias("b"), F.max(allowed).alias("a")))
    trust = personalised_pagerank(seeds.where("b = 0 and a = 1").select("host", F.lit(1.0).alias("mass")), edges, damping, tolerance, work)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_pagerank(seeds.where("b = 1").select("host", F.lit(1.0).alias("mass")), back, damping, tolerance, work)
    scores = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    scores = work.save(scores.select("host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust"))))
    return judged.drop("html").join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce(F.col("trust"), F.lit(0.0)).alias("trust"),
        F.coalesce(F.col("distrust"), F.lit(0.0)).alias("distrust"),
    )

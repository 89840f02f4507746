"""URL filters: host and path rules, and link-graph propagation for hosts without a rule.

Rules decide first: a rule fits its host and all subdomains if the path starts with the rule's; the
longest rule string wins. Hosts then form a graph. Its edges are

- links: the pages of src that link to dst (href of a and area; https://, http:// and //, and relative ones under a base element
  with a host), once per page and target; links within a host count for nothing;
- domains: a host and its parent domain, down to two labels, are joined in both directions with the weight of one page, as
  subdomains share an owner. Domains in SHARED have subdomains of strangers and are no parents. With domains=False
  there are links only.

Trust is a personalised PageRank along the edges, from the hosts whose pages the rules allow. Distrust goes against the
edges, from the hosts whose pages they block: each host takes over, with DAMPING, the distrust of the hosts that it
leads to, by the share of its own edges that lead there. So it does not fall with the number of other hosts that lead to the same one.
A page without a rule is blocked if its host's distrust reaches THRESHOLD and exceeds its trust.

A host seeds trust with the allowed share, and distrust with the blocked share, of its pages under
a rule, so seeds do not shrink as the web grows. All steps are joins and partial aggregations on hosts; hosts
with very many edges are split; rounds are cut by tables in the shared folder, which are deleted once they are used.

Null urls and urls without :// have empty host and path, fit no rule, and are allowed for want of
evidence. Null html has no links. Repeated rows are judged alike, each on its own, and each counts as a page. Longest rules
cannot tie, as two of one length that fit are equal. Pages of any length are scanned whole. An empty table gives an empty result. Columns
beside the three that are named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, hot_keys, new_path, remove, saved_at, split_join

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ROUNDS, DAMPING, THRESHOLD = 10, 0.85, 0.05
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = "\\shref\\s*=\\s*[\"']?\\s*"
_HOST = "(?:https?:)?//(?:[^/?#\"'\\s<>@]*@)?([^/?#\"'\\s<>@]+)"
LINK = f"(?i)<a(?:rea)?\\b[^>]*?{_HREF}{_HOST}"
BASE = f"(?i)<base\\b[^>]*?{_HREF}{_HOST}"
RELATIVE = f"(?i)<a(?:rea)?\\b[^>]*?{_HREF}(?:/[^/]|[.?]|[a-z0-9_%-]+[\"'\\s>/.?#])"
#: Domains under which strangers have subdomains, and the longest name that a host can have.
SHARED, LONGEST = ("co.uk", "org.uk", "com.au", "co.jp", "co.in", "com.br", "github.io", "blogspot.com", "wordpress.com"), 253


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end."""
    has = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.substr(url, F.position(F.lit("://"), url) + 3)
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits. Rules are a short literal list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, weight: the number of pages of host src that link to host dst, without links inside a host."""
    host, _ = host_and_path(F.col(url))
    page = F.col(html)
    based = F.filter(F.array(F.regexp_extract(page, BASE, 1)), lambda x: (x != "") & page.rlike(RELATIVE))
    found = F.concat(F.regexp_extract_all(page, F.lit(LINK), F.lit(1)), F.when(page.rlike("(?i)<base"), based).otherwise(F.array().cast("array<string>")))
    targets = F.array_distinct(F.transform(found, lambda x: F.translate(x, UPPER, LOWER)))
    links = pages.where(page.contains("//")).select(host.alias("src"), F.explode(targets).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def domain_links(hosts: DataFrame, shared: tuple[str, ...] = SHARED) -> DataFrame:
    """src, dst, weight 1, both ways, between each different `host` and its parent domain, that domain and its own, down to two labels."""
    labels = F.split("host", "\\.")
    name = lambda n: F.array_join(F.slice(labels, n, F.size(labels)), ".")
    chain = F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda n: F.struct(name(n - 1).alias("src"), name(n).alias("dst")))
    named = hosts.where((F.length("host") <= LONGEST) & F.col("host").rlike("^[^.:@]+(?:\\.[^.:@]+)+\\.[a-z][^.:@]*$")).select("host").distinct()
    up = named.select(F.explode(chain).alias("e")).select("e.src", "e.dst").where(~F.col("dst").isin(*shared) & ~F.col("src").isin(*shared)).distinct()
    return up.union(up.select("dst", "src")).withColumn("weight", F.lit(1).cast("long"))


def shares(links: DataFrame, split: int = HOT_ROWS) -> DataFrame:
    """src, dst, share of the weight of all edges of src."""
    out = links.groupBy("src").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("_n"))
    return split_join(links, out.drop("_n"), "src", ["dst"], hot_keys(out, "src", "_n", split)).select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def spread(seeds: DataFrame, moves: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, split: int = HOT_ROWS) -> tuple[DataFrame, str]:
    """seeds(host, seed), moves(host, to, share) -> (host, score) and the folder that holds them.

    In each round every host passes on damping x score x share, and seeds keep (1 - damping) x seed.
    """
    spark = seeds.sparkSession
    hot = hot_keys(moves.groupBy("host").agg(F.count(F.lit(1)).alias("_n")), "host", "_n", split)
    base = now = seeds.select("host", (F.lit(1 - damping) * F.col("seed")).alias("score"))
    path = None
    for n in range(rounds):
        passed = split_join(moves, now, "host", ["to"], hot).select(F.col("to").alias("host"), (F.lit(damping) * F.col("score") * F.col("share")).alias("score"))
        now = base.unionByName(passed).groupBy("host").agg(F.sum("score").alias("score"))
        if n % 5 == 4 or n == rounds - 1:
            after = new_path(spark, "pagerank")
            now = saved_at(now, after)
            if path:
                remove(spark, path)
            path = after
    return now, path


def judged(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES, threshold: float = THRESHOLD, rounds: int = ROUNDS, domains: bool = True, split: int = HOT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("_says"))
    # one pass over the pages' hosts: seeds and the hosts that may have a parent domain
    kinds = lambda says: F.count_if(F.col("_says") == says)
    hosts_at, shares_at = new_path(spark, "hosts"), new_path(spark, "host-shares")
    hosts = saved_at(rows.groupBy("host").agg(kinds("allow").alias("good"), kinds("block").alias("bad"), F.count(F.lit(1)).alias("pages")), hosts_at)
    links_at = new_path(spark, "host-links")
    links = host_links(pages, url, html)
    if domains:
        links = links.union(domain_links(hosts.select("host"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    share = saved_at(shares(saved_at(links, links_at), split), shares_at)
    # both scores in one go: trust has nodes +host and moves along the edges, distrust has nodes -host and moves against them
    node = lambda sign, c: F.concat(F.lit(sign), F.col(c)).alias
    seed = lambda sign, c: hosts.where(F.col(c) > 0).select(node(sign, "host")("host"), (F.col(c) / (F.col("good") + F.col("bad"))).alias("seed"))
    moves = share.select(node("+", "src")("host"), node("+", "dst")("to"), "share").union(share.select(node("-", "dst")("host"), node("-", "src")("to"), "share"))
    both, both_at = spread(seed("+", "good").union(seed("-", "bad")), moves, rounds, split=split)
    of = lambda sign, c: F.sum(F.when(F.col("host").startswith(sign), F.col("score")).otherwise(0.0)).alias(c)
    found_at = new_path(spark, "host-scores")
    scores = both.groupBy(F.substring("host", 2, 1 << 30).alias("host")).agg(of("+", "trust"), of("-", "distrust"))
    scores = saved_at(hosts.select("host").join(scores, "host", "left").fillna(0.0), found_at)
    found = split_join(rows, scores, "host", ["page_id", "path"], hot_keys(hosts, "host", "pages", split))
    for used in (links_at, shares_at, both_at):
        if used:
            remove(spark, used)
    own = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("_says", own).alias("verdict"), "trust", "distrust")


def sql(rules=RULES, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> str:
    """The same result as SQL over the view pages: one common table for each round."""
    fit, says = "NULL", "NULL"
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        test = f"(host = '{text[:at]}' OR ends_with(host, '.{text[:at]}')) AND starts_with(path, '{text[at:]}')"
        fit, says = f"CASE WHEN {test} THEN '{text}' ELSE {fit} END", f"CASE WHEN {test} THEN '{verdict}' ELSE {says} END"
    link, base, relative = (x.replace("'", "''") for x in (LINK, BASE, RELATIVE))
    shared = ", ".join(f"'{x}'" for x in SHARED)
    steps = []
    for name, seed, a, b in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        steps.append(f"{name}0 AS (SELECT host, {1 - DAMPING} * {seed} / (good + bad) AS score FROM hosts WHERE {seed} > 0)")
        for n in range(rounds):
            steps.append(
                f"{name}{n + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT * FROM {name}0 UNION ALL SELECT s.{b}, {DAMPING} * p.score * s.share "
                f"FROM shares s JOIN {name}{n} p ON p.host = s.{a}) GROUP BY host)"
            )
    return rf"""
WITH u AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, html, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS MATERIALIZED (SELECT page_id, host, path, {fit} AS rule, {says} AS says FROM h),
hosts AS MATERIALIZED (SELECT host, count(*) FILTER (says = 'allow') AS good, count(*) FILTER (says = 'block') AS bad FROM r GROUP BY host),
targets AS (SELECT host AS src, unnest(list_distinct(list_transform(list_concat(regexp_extract_all(html, '{link}', 1),
  CASE WHEN regexp_matches(html, '{relative}') THEN regexp_extract_all(html, '{base}', 1)[1:1] ELSE [] END), lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS dst FROM h),
named AS (SELECT string_split(host, '.') AS l FROM hosts WHERE length(host) <= {LONGEST} AND regexp_matches(host, '^[^.:@]+(?:\.[^.:@]+)+\.[a-z][^.:@]*$')),
up AS (SELECT DISTINCT array_to_string(l[n - 1:], '.') AS src, array_to_string(l[n:], '.') AS dst FROM (SELECT l, unnest(range(2, len(l))) AS n FROM named)),
kept AS (SELECT * FROM up WHERE src NOT IN ({shared}) AND dst NOT IN ({shared})),
links AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, 1 AS weight FROM targets WHERE src <> '' AND dst <> '' AND src <> dst UNION ALL SELECT src, dst, 1 FROM kept UNION ALL SELECT dst, src, 1 FROM kept) GROUP BY 1, 2),
shares AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM links),
{", ".join(steps)}
SELECT page_id, r.host AS host, path, rule,
  coalesce(says, CASE WHEN coalesce(d.score, 0) >= {threshold} AND coalesce(d.score, 0) > coalesce(t.score, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(t.score, 0), 6) AS trust, round(coalesce(d.score, 0), 6) AS distrust
FROM r LEFT JOIN t{rounds} t ON t.host = r.host LEFT JOIN d{rounds} d ON d.host = r.host
"""

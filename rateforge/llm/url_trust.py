"""URL filters whose open cases a host graph decides, with DataFrame functions only.

A url's own rule comes first: it fits a host and all its subdomains where the path starts
with the rule's, and the longest fitting rule wins.  Other urls get their host's verdict.
Hosts are nodes, absolute links of pages their edges, weighted by how often they occur.
Trust starts at hosts of which allow rules cover more than half of the pages and follows
the links (personalised PageRank); distrust starts at hosts mostly covered by block rules
and follows the links backwards, to those who link there.  What a host without links
holds goes back to the seeds.  A host is blocked if it holds more distrust than trust,
both in units of an average seed's direct share, and at least ``least`` such units.

Edges are aggregated per pair of hosts, so a page-rich host is a few rows; ranks and
edges meet in shuffle joins on the host, which the adaptive plan splits where a hub is
large.  Every step writes the ranks to the checkpoint folder, so no step is recomputed.

Defined results: null urls and those without ``://`` have an empty host and path, no rule
and the verdict allow; null pages have no links; repeated rows count each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, lower_ascii_col

DAMPING, STEPS, LEAST = 0.85, 20, 0.1
#: The rules' list becomes a literal of the plan; longer lists are refused.
MOST_RULES = 1000
#: Rules of the query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return lower_ascii_col(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (n, rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
               F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, links): links are the hosts a page points to."""
    links = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)), lower_ascii_col)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), links.alias("links"))
    found = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"), "links")


def host_graph(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts and how many there are."""
    edges = pages.select(F.col("host").alias("src"), F.explode("links").alias("dst"))
    return edges.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(
        F.count(F.lit(1)).cast("double").alias("w"))


def propagate(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(kind, host, v): personalised PageRank of each kind after ``steps`` steps.

    ``nodes`` is (kind, host, s), s summing to one or zero per kind; ``edges`` is
    (kind, src, dst, w)."""
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("out"))
    links = cut(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("out")).alias("p")))
    ends = out.select("kind", F.col("src").alias("host"), F.lit(False).alias("end"))
    ranks = cut(nodes.join(ends, ["kind", "host"], "left").select(
        "kind", "host", "s", F.coalesce("end", F.lit(True)).alias("end"), F.col("s").alias("v")))
    if links.isEmpty():
        return ranks.select("kind", "host", "v")
    for _ in range(steps):
        lost = {r["kind"]: r["lost"] for r in ranks.groupBy("kind").agg(F.sum(F.when(F.col("end"), F.col("v"))).alias("lost")).collect()}
        back = F.lit(0.0)
        for kind, mass in lost.items():
            back = F.when(F.col("kind") == kind, F.lit(float(mass or 0.0))).otherwise(back)
        got = links.join(ranks.select("kind", F.col("host").alias("src"), "v"), ["kind", "src"]).groupBy(
            "kind", F.col("dst").alias("host")).agg(F.sum(F.col("p") * F.col("v")).alias("got"))
        ranks = cut(ranks.join(got, ["kind", "host"], "left").select(
            "kind", "host", "s", "end",
            (F.col("s") * (1 - damping + damping * back) + damping * F.coalesce("got", F.lit(0.0))).alias("v")))
    return ranks.select("kind", "host", "v")


def host_scores(pages: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust) in units of an average seed's direct share."""
    of_rule = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0))
    hosts = pages.where(F.col("host") != "").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), of_rule("allow").alias("a"), of_rule("block").alias("b"))
    edges = cut(host_graph(pages))
    linked = edges.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti")
    seeds = cut(hosts.select("host", (F.col("a") * 2 > F.col("n")).alias("trust"), (F.col("b") * 2 > F.col("n")).alias("distrust"))
                .unionByName(linked.select("host", F.lit(False).alias("trust"), F.lit(False).alias("distrust"))))
    count = seeds.agg(*[F.count(F.when(F.col(k), 1)).alias(k) for k in ("trust", "distrust")]).first()
    nodes = [seeds.select(F.lit(k).alias("kind"), "host", (F.col(k).cast("int") / F.lit(max(count[k], 1))).alias("s"))
             for k in ("trust", "distrust")]
    both = [edges.select(F.lit("trust").alias("kind"), "src", "dst", "w"),
            edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")]
    ranks = propagate(nodes[0].unionByName(nodes[1]), both[0].unionByName(both[1]), damping, steps)
    units = lambda k: F.sum(F.when(F.col("kind") == k, F.col("v") * (count[k] / (1 - damping))).otherwise(0.0))
    return ranks.groupBy("host").agg(units("trust").alias("trust"), units("distrust").alias("distrust"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, damping: float = DAMPING, steps: int = STEPS,
           least: float = LEAST) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.  Blocked hosts are
    those of the graph that are over the threshold; they join back by host, with the
    pages of each host spread over several keys and the hosts repeated for each."""
    stored = cut(ruled(pages, rules))
    scores = host_scores(stored, damping, steps)
    blocked = scores.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least)).select("host")
    salts = 16
    blocked = blocked.select("host", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.lit("block").alias("_host_verdict"))
    salted = stored.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    return salted.join(blocked, ["host", "_salt"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "_host_verdict", F.lit("allow")).alias("verdict"))


def _sql(damping: float = DAMPING, steps: int = STEPS, least: float = LEAST) -> str:
    url = r"^(?:[^:]|:[^/]|:/[^/])*?://([^/?#]*)([^?#]*)"
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ranks = "".join(f"""
v{i} AS MATERIALIZED (SELECT r.kind, r.host, r.s, r.dangling,
  r.s * ({1 - damping} + {damping} * lost.mass) + {damping} * coalesce(g.got, 0) AS v
  FROM v{i - 1} r
  JOIN (SELECT kind, sum(CASE WHEN dangling THEN v ELSE 0 END) AS mass FROM v{i - 1} GROUP BY kind) lost ON lost.kind = r.kind
  LEFT JOIN (SELECT l.kind, l.dst AS host, sum(l.p * x.v) AS got FROM links l
             JOIN v{i - 1} x ON x.kind = l.kind AND x.host = l.src GROUP BY l.kind, l.dst) g
  ON g.kind = r.kind AND g.host = r.host),""" for i in range(1, steps + 1))
    return rf"""
WITH rules(verdict, rhost, rpath) AS (VALUES {values}),
p AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, html,
       {lower.format(f"coalesce(regexp_extract(url, '{url}', 1), '')")} AS host,
       coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages),
f AS (SELECT r, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r),
j AS MATERIALIZED (SELECT p.*, f.rule, f.verdict FROM p LEFT JOIN f ON f.r = p.r),
e AS MATERIALIZED (SELECT host AS src, dst, CAST(count(*) AS DOUBLE) AS w
      FROM (SELECT host, {lower.format("unnest(regexp_extract_all(coalesce(html, ''), '" + _LINK.replace("'", "''") + "', 1))")} AS dst FROM j)
      WHERE host <> '' AND host <> dst GROUP BY host, dst),
h AS (SELECT host, count(*) AS n, sum(CASE WHEN verdict = 'allow' THEN 1 ELSE 0 END) AS a,
             sum(CASE WHEN verdict = 'block' THEN 1 ELSE 0 END) AS b FROM j WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (SELECT host, a * 2 > n AS t, b * 2 > n AS d FROM h
      UNION ALL SELECT DISTINCT dst, false, false FROM e WHERE dst NOT IN (SELECT host FROM h)),
c AS MATERIALIZED (SELECT count(CASE WHEN t THEN 1 END) AS t, count(CASE WHEN d THEN 1 END) AS d FROM seeds),
ke AS (SELECT 't' AS kind, src, dst, w FROM e UNION ALL SELECT 'd', dst, src, w FROM e),
o AS (SELECT kind, src, sum(w) AS w FROM ke GROUP BY kind, src),
links AS MATERIALIZED (SELECT ke.kind, ke.src, ke.dst, ke.w / o.w AS p FROM ke JOIN o ON o.kind = ke.kind AND o.src = ke.src),
n AS (SELECT 't' AS kind, host, CASE WHEN seeds.t THEN 1.0 / c.t ELSE 0.0 END AS s FROM seeds, c
      UNION ALL SELECT 'd', host, CASE WHEN seeds.d THEN 1.0 / c.d ELSE 0.0 END FROM seeds, c),
v0 AS MATERIALIZED (SELECT n.kind, n.host, CAST(n.s AS DOUBLE) AS s, o.src IS NULL AS dangling, CAST(n.s AS DOUBLE) AS v
      FROM n LEFT JOIN o ON o.kind = n.kind AND o.src = n.host),{ranks}
scores AS (SELECT host, sum(CASE WHEN kind = 't' THEN v * c.t ELSE 0 END) / {1 - damping} AS t,
                  sum(CASE WHEN kind = 'd' THEN v * c.d ELSE 0 END) / {1 - damping} AS d FROM v{steps}, c GROUP BY host),
bad AS (SELECT host FROM scores WHERE d > t AND d >= {least})
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN bad ON bad.host = j.host
"""


SQL = _sql()

"""URL filters: longest matching rule, and trust propagated over the link graph of hosts where no rule fits.

Host edges are the absolute links of the pages' HTML.  Trust starts at the hosts of pages that a rule allows and
follows links; distrust starts at the hosts of pages that a rule blocks and follows links backwards, so that a
host that leads to blocked hosts inherits it.  Both are personalised PageRanks with restarts at their seeds,
iterated in Spark; a host is blocked when its distrust exceeds its trust.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed; null HTML has
no links; links of a host to itself are ignored; repeated rows give repeated results and count as seeds each
time; an empty table gives an empty result; hosts without links to spread over keep nothing beyond their seeds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.llm import workspace

DAMPING = 0.85
#: Steps at most, and the change of any score below which the propagation has settled.
ITERATIONS, TOLERANCE = 60, 1e-7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: Fixed by the contract.
RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


def _first_fitting(rules: tuple[Rule, ...], value: str) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):  # the longest ends up outermost
        out = F.when(rule.fits(F.col("host"), F.col("path")), F.lit(getattr(rule, value))).otherwise(out)
    return out


def _host(found: Column) -> Column:
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def by_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule and the rule's verdict."""
    url = F.col("url").cast("string")
    parts = pages.withColumns({"host": _host(F.regexp_extract(url, URL, 1)), "path": F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))})
    return parts.withColumns({"rule": _first_fitting(rules, "pattern"), "rule_verdict": _first_fitting(rules, "verdict")})


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links: how many links lead from one host to another."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("to"))
    ends = links.select("src", F.regexp_replace(_host(F.col("to")), r"^[^@]*@|:[0-9]*$", "").alias("dst"))
    return ends.filter("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def _spread(edges: DataFrame) -> DataFrame:
    """kind, a, b, share: how much of a's trust (kind 0) or distrust (kind 1) goes to b."""
    both = edges.select(F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "links").unionByName(
        edges.select(F.lit(1).alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "links")
    )
    total = both.groupBy("kind", "a").agg(F.sum("links").alias("total"))
    return both.join(total, ["kind", "a"]).select("kind", "a", "b", (F.col("links") / F.col("total")).alias("share"))


def _seeds(judged: DataFrame) -> DataFrame:
    """kind, host, start: the share of each host in the pages that rules allow (kind 0) or block (kind 1)."""
    counts = judged.filter("rule IS NOT NULL").groupBy(F.when(F.col("rule_verdict") == "allow", 0).otherwise(1).alias("kind"), "host").agg(F.count("*").alias("n"))
    total = counts.groupBy("kind").agg(F.sum("n").alias("total"))  # two rows
    return counts.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("start"))


def propagate(judged: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, cut_every: int = 5) -> DataFrame:
    """host, trust, distrust of every host that either reaches; ``judged`` comes from :func:`by_rules`."""
    edges = workspace.cut(_spread(workspace.cut(host_edges(judged))))
    seeds = workspace.cut(_seeds(judged).select("kind", "host", (F.col("start") * (1 - damping)).alias("score")))
    ranks, before = seeds, seeds
    if edges.isEmpty():
        iterations = 0
    for step in range(1, iterations + 1):
        moved = edges.join(ranks.withColumnRenamed("host", "a"), ["kind", "a"]).select("kind", F.col("b").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        ranks = moved.unionByName(seeds).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if step % cut_every == 0:
            ranks = workspace.cut(ranks)
            change = F.abs(F.col("score") - F.coalesce("old", F.lit(0.0)))
            if ranks.join(before.withColumnRenamed("score", "old"), ["kind", "host"], "left").filter(change > TOLERANCE).isEmpty():
                break
            before = ranks
    score_of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    return ranks.groupBy("host").agg(score_of(0).alias("trust"), score_of(1).alias("distrust"))


def verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    judged = by_rules(pages.select("page_id", "url", "html"), rules)
    blocked = workspace.sized(workspace.cut(propagate(judged).filter("distrust > trust").select("host", F.lit("block").alias("host_verdict"))))
    return judged.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"))


def sql(rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, iterations: int = ITERATIONS) -> str:
    """The same rows as :func:`verdicts` over ``pages``, as DuckDB SQL with one materialised step an iteration."""
    ordered = sorted(rules, key=lambda r: -len(r.pattern))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'" for r in ordered) + " END"
    link = LINK.replace("'", "''")
    steps = [
        f"r{k} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (SELECT e.kind, e.b AS host, r.score * e.share * {damping} AS score FROM spread e JOIN r{k - 1} r ON e.kind = r.kind AND e.a = r.host UNION ALL SELECT * FROM seeds) GROUP BY kind, host)"
        for k in range(1, iterations + 1)
    ]
    return f"""
WITH parts AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
judged AS MATERIALIZED (SELECT *, {case("pattern")} AS rule, {case("verdict")} AS rule_verdict FROM parts),
links AS (SELECT host AS src, regexp_replace(translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{UPPER}', '{LOWER}'), '^[^@]*@|:[0-9]*$', '', 'g') AS dst FROM judged),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS links FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
directed AS (SELECT 0 AS kind, src AS a, dst AS b, links FROM edges UNION ALL SELECT 1, dst, src, links FROM edges),
spread AS MATERIALIZED (SELECT kind, a, b, links / sum(links) OVER (PARTITION BY kind, a) AS share FROM directed),
counts AS (SELECT CASE WHEN rule_verdict = 'allow' THEN 0 ELSE 1 END AS kind, host, count(*) AS n FROM judged WHERE rule IS NOT NULL GROUP BY 1, 2),
seeds AS MATERIALIZED (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) * {1 - damping} AS score FROM counts),
r0 AS (SELECT * FROM seeds),
{", ".join(steps)},
scores AS (SELECT host, sum(CASE WHEN kind = 0 THEN score ELSE 0 END) AS trust, sum(CASE WHEN kind = 1 THEN score ELSE 0 END) AS distrust FROM r{iterations} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(rule_verdict, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN scores s ON j.host = s.host
"""

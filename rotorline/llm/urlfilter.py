"""URL filter: rules first, link-graph propagation for the rest.

A rule is (host, path, verdict). It fits its host and all subdomains when the url's path starts with the rule's path;
the longest rule wins. Pages that no rule decides get the verdict of their host:

* the pages of a host that rules allow are its trusted seed mass, those that rules block its blocked seed mass;
* links in the pages give weighted edges between hosts, counted before anything else is done with them;
* personalised PageRank carries trust along the edges and distrust against them, ``ROUNDS`` rounds with restart;
* a host is blocked when its distrust is over ``MARGIN`` times its trust. Hosts that neither reaches are allowed.

One round is one join of edges with the scores of the hosts and one sum; scores are written to the shared folder after
each round. Pages meet hosts only in counts and in the last join, which Spark may split for hosts with many pages.

Edge cases: a url that is null or has no ``://`` has empty host and path, fits no rule and is judged with the empty
host; a null html has no links; repeated pages count as often as they occur; an empty table gives no rows. Columns
other than ``page_id``, ``url`` and ``html`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.llm.base import LOWER, UPPER, ascii_lower, cut, table

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
RESTART, ROUNDS, MARGIN = 0.15, 8, 1.0
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*[a-z][a-z0-9+.-]*://([^/?#"'\s>]+)"""
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def by_length(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))


def fits(rule: Rule) -> Column:
    host, path, _ = rule
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def first_fit(rules: Sequence[Rule], pick) -> Column:
    found = F.lit(None).cast("string")
    for rule in reversed(by_length(rules)):
        found = F.when(fits(rule), pick(rule)).otherwise(found)
    return found


def parsed(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return split.withColumns({"rule": first_fit(rules, lambda r: r[0] + r[1]), "ruled": first_fit(rules, lambda r: r[2])})


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    linked = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), 1)).alias("dst"))
    return linked.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, restart: float = RESTART) -> DataFrame:
    """host, trust, distrust from edges (src, dst, n) and seeds (host, trust, distrust)."""
    out_of = edges.groupBy("src").agg(F.sum("n").alias("all_out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("all_in"))
    arcs = cut(
        edges.join(out_of, "src").join(into, "dst")
        .select(F.explode(F.array(
            F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("n") / F.col("all_out")).alias("trust_part"), F.lit(0.0).alias("distrust_part")),
            F.struct(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("trust_part"), (F.col("n") / F.col("all_in")).alias("distrust_part")),
        )).alias("a")).select("a.*")
    )
    kinds = ("trust", "distrust")
    start = seeds.select("host", *[(restart * F.col(k)).alias(k) for k in kinds])
    scores = start
    for _ in range(rounds):
        moved = arcs.join(scores, arcs["from"] == scores["host"]).select(
            F.col("to").alias("host"), *[((1 - restart) * F.col(k) * F.col(f"{k}_part")).alias(k) for k in kinds])
        scores = cut(moved.unionByName(start).groupBy("host").agg(*[F.sum(k).alias(k) for k in kinds]))
    return scores


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, rounds: int = ROUNDS, restart: float = RESTART, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    split = parsed(pages, rules)
    counted = lambda verdict: F.sum(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
    counts = cut(split.groupBy("host").agg(counted("allow").alias("trust"), counted("block").alias("distrust")))
    total = counts.agg(F.greatest(F.sum("trust"), F.lit(1.0)).alias("t"), F.greatest(F.sum("distrust"), F.lit(1.0)).alias("d"))
    seeds = counts.select("host", (F.col("trust") / total.select("t").scalar()).alias("trust"), (F.col("distrust") / total.select("d").scalar()).alias("distrust"))
    scores = spread(host_edges(pages), cut(seeds), rounds, restart)
    judged = split.join(scores, "host", "left")
    own = F.when(F.col("distrust") > margin * F.col("trust"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _duck() -> str:
    fit = lambda r: f"(host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}')"
    arms = lambda k: "CASE" + "".join(f" WHEN {fit(r)} THEN '{k(r)}'" for r in by_length(RULES)) + " END"
    host = lambda c: f"translate(coalesce(regexp_extract({c}, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}')"
    steps = "".join(f""", s{i} AS MATERIALIZED (
  SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
    SELECT dst AS host, {1 - RESTART} * trust * n / all_out AS trust, 0.0 AS distrust FROM arcs JOIN s{i - 1} ON host = src
    UNION ALL SELECT src, 0.0, {1 - RESTART} * distrust * n / all_in FROM arcs JOIN s{i - 1} ON host = dst
    UNION ALL SELECT host, trust, distrust FROM s0) GROUP BY host
)""" for i in range(1, ROUNDS + 1))
    link = LINK.removeprefix("(?is)").replace("'", "''")
    return f"""
WITH p0 AS (
  SELECT page_id, html, {host("url")} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), p AS (SELECT *, {arms(lambda r: r[0] + r[1])} AS rule, {arms(lambda r: r[2])} AS ruled FROM p0),
c AS (SELECT host, count(*) FILTER (ruled = 'allow')::DOUBLE AS trust, count(*) FILTER (ruled = 'block')::DOUBLE AS distrust FROM p GROUP BY host),
s0 AS (
  SELECT host, {RESTART} * trust / greatest(sum(trust) OVER (), 1.0) AS trust, {RESTART} * distrust / greatest(sum(distrust) OVER (), 1.0) AS distrust FROM c
), e AS (
  SELECT host AS src, translate(dst, '{UPPER}', '{LOWER}') AS dst, count(*)::DOUBLE AS n
  FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1, 'is')) AS dst FROM p) WHERE host <> translate(dst, '{UPPER}', '{LOWER}') GROUP BY ALL
), arcs AS (SELECT *, sum(n) OVER (PARTITION BY src) AS all_out, sum(n) OVER (PARTITION BY dst) AS all_in FROM e){steps}
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN distrust > {MARGIN} * trust THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN s{ROUNDS} s ON p.host = s.host
"""


ORACLE = _duck()

"""Operator 3, URL filters with link-graph propagation.

Rules decide first: a rule fits its host and subdomains where the path starts with the rule's; the
longest wins. For all other pages the host's place in the link graph decides. Trust spreads from hosts
whose pages allow rules fit (the seed is their share of the host's pages) along host edges, distrust
from hosts with blocked pages against the edges, both as personalised PageRank:
score = seed + damping * sum of linked scores over degree, for a fixed number of rounds. A host is
blocked when its distrust exceeds its trust by more than the threshold. Scores leak at hosts without
edges; without any edge scores are the seeds.

Defined cases: null urls and urls without :// have an empty host and path, fit no rule and are allowed;
null html has no links; links of a page to its own host don't count; repeated rows are judged each; rules of
equal length that both fit are of one host, so they are one text, and allow holds before block; very long urls
and pages are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import read, settle, sized

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
DAMPING, ROUNDS, THRESHOLD = 0.85, 20, 0.25
#: Up to so many rules are compiled into the plan; more are joined by host suffix.
MAX_RULES = 200


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest fitting rule's text, else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the last, so longest, test comes first
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rules_by_host(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(_host, _rules): the rules, longest first, that fit each of hosts(host) by its name or a domain above it."""
    rows = [(kind, rule, domain, slash + rest) for kind, rule in rules for domain, slash, rest in [rule.partition("/")]]
    table = hosts.sparkSession.createDataFrame(rows, "kind string, rule string, domain string, path string")
    labels = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = hosts.where("host <> ''").distinct().select("host", F.explode(above).alias("domain")).join(table, "domain")
    fitting = F.struct((-F.length("rule")).alias("order"), "rule", "kind", "path")
    return met.groupBy(F.col("host").alias("_host")).agg(F.array_sort(F.collect_list(fitting)).alias("_rules"))


def judged_by_rule(pages: DataFrame, rules: list[tuple[str, str]], max_rules: int = MAX_RULES) -> DataFrame:
    """(page_id, host, path, rule, by_rule); of rules of one length and text the first kind by name holds."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if len(rules) > max_rules:
        fitting = sized(rules_by_host(rows.select("host"), rules))
        rows = rows.join(fitting, rows["host"] == fitting["_host"], "left")
        best = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
        return rows.select("page_id", "host", "path", best["rule"].alias("rule"), best["kind"].alias("by_rule"))
    rows = rows.withColumn("rule", longest_rule(rules, F.col("host"), F.col("path")))
    kinds = {rule: kind for kind, rule in sorted(rules, reverse=True)}
    action = F.create_map(*[F.lit(x) for rule, kind in kinds.items() for x in (rule, kind)]) if rules else None
    return rows.withColumn("by_rule", action[F.col("rule")] if rules else F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct links between different hosts."""
    links = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER))
    rows = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(links)).alias("dst"))
    return rows.where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, score) from seeds(host, seed) along edges(src, dst)."""
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    edges = settle(edges.join(degree, "src"))
    score = seeds.select("host", F.col("seed").alias("score"))
    for n in range(rounds):
        given = score.withColumnRenamed("host", "src").join(edges, "src").groupBy("dst").agg((F.sum(F.col("score") / F.col("degree")) * damping).alias("part"))
        new = seeds.select("host", "seed").join(given.withColumnRenamed("dst", "host"), "host", "full").select("host", (F.coalesce("seed", F.lit(0.0)) + F.coalesce("part", F.lit(0.0))).alias("score"))
        score = settle(new) if n % 4 == 3 else new
    return score


def blocked_hosts(pages: DataFrame, judged: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(host) of hosts whose distrust exceeds their trust by more than the threshold."""
    share = lambda kind: F.avg(F.when(F.col("by_rule") == kind, 1.0).otherwise(0.0))
    seeds = settle(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")))
    edges = settle(host_edges(pages))
    good, bad = seeds.where("good > 0").select("host", F.col("good").alias("seed")), seeds.where("bad > 0").select("host", F.col("bad").alias("seed"))
    if edges.isEmpty():
        good, bad = good.withColumnRenamed("seed", "score"), bad.withColumnRenamed("seed", "score")
    else:
        good = propagate(good, edges, damping, rounds)
        bad = propagate(bad, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), damping, rounds)
    both = bad.select("host", F.col("score").alias("distrust")).join(good.select("host", F.col("score").alias("trust")), "host", "left")
    return both.where(F.col("distrust") - F.coalesce("trust", F.lit(0.0)) > threshold).select("host")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page."""
    judged = judged_by_rule(pages, rules)
    blocked = sized(blocked_hosts(pages, judged, damping, rounds, threshold).select(F.col("host").alias("_host")))
    rows = judged.join(blocked, judged["host"] == blocked["_host"], "left")
    method = F.when(F.col("_host").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), RULES)


def _oracle() -> str:
    tests = [
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
        for _, r in sorted(RULES, key=lambda x: -len(x[1]))
    ]
    link = LINK.replace("'", "''")
    parts = [
        "p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '%s', '%s') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)" % (UPPER, LOWER),
        "r AS (SELECT *, CASE %s END AS rule FROM p)" % " ".join(tests),
        "j AS (SELECT *, CASE %s END AS by_rule FROM r)" % " ".join(f"WHEN rule = '{r}' THEN '{k}'" for k, r in RULES),
        "s AS (SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN by_rule = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM j WHERE host <> '' GROUP BY host)",
        f"l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM p)",
        "e AS (SELECT DISTINCT src, dst FROM l WHERE src <> '' AND dst <> '' AND src <> dst)",
        "n AS (SELECT host FROM s UNION SELECT src FROM e UNION SELECT dst FROM e)",
    ]
    for name, seed, a, b in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        parts.append(f"{name}e AS (SELECT {a} AS a, {b} AS b, count(*) OVER (PARTITION BY {a}) AS degree FROM e)")
        parts.append(f"{name}0 AS (SELECT n.host, coalesce(s.{seed}, 0) AS seed, coalesce(s.{seed}, 0)::DOUBLE AS score FROM n LEFT JOIN s USING (host))")
        for k in range(ROUNDS):
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT x.host, x.seed, x.seed + coalesce(y.part, 0) AS score FROM {name}{k} x LEFT JOIN (SELECT b, {DAMPING} * sum(z.score / degree) AS part FROM {name}{k} z JOIN {name}e ON z.host = a GROUP BY b) y ON x.host = y.b)")
    parts.append(f"b AS (SELECT t.host FROM t{ROUNDS} t JOIN d{ROUNDS} d USING (host) WHERE d.score - t.score > {THRESHOLD})")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM j"


OP3_SQL = _oracle()

"""URL filters: rules by host and path, and trust propagated over the link graph for the rest.

Host edges come from the pages' absolute links. Trust is a personalised PageRank from hosts
that rules allow; distrust runs the same way over reversed edges from hosts that rules block, so that a host
that links to blocked ones is distrusted. A host's seed is the share of its pages that such a rule decides.
Both scores are the PageRank sums without the factor (1 - damping), so they don't depend on the number of
hosts; what reaches a host without outgoing edges stays there. A page that no rule fits is blocked where
its host's distrust is at least ``threshold`` and more than its trust.

Up to INLINE_RULES rules are one expression. More are a table: a host's parents are looked up among the rules' hosts by an equality join,
once for each host, and a page then has only the rules of its host and that host's parents to try, the longest first. Both ways give the same; of equally long rules that fit, the first in order wins.

Everything is DataFrame functions. Pages are reduced to weighted host edges before any exchange; the iterations
work on hosts only and move what the last step added; each writes that as a table, which cuts the lineage, and the scores are the sums of all these. They stop when what is still to come,
at most damping / (1 - damping) times the sum of the last step's increments, is below ``rest`` for all hosts together.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the verdict allow; null or
empty html has no links; repeated pages count as pages of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, new_path

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
INLINE_RULES = 500  # in one expression
DAMPING = 0.85
STEPS = 160  # of the SQL
REST = 1e-10  # scores are rounded to 6 digits
THRESHOLD = 0.25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    last_first = sorted(rules, key=lambda r: (r[1] + r[2], r[2], r[0]), reverse=True)
    for verdict, h, p in sorted(last_first, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: for each of hosts(host), each once, what rules(verdict, host, path) name it or a parent, the longest first; hosts without any are left out.

    The result of a host has the rules of that host and its parents, not more."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = rules.select(F.col("host").alias("_parent"), F.struct((-F.length(F.concat("host", "path"))).alias("size"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("_r"))
    return hosts.select("host", F.explode(parents).alias("_parent")).join(own, "_parent").groupBy("host").agg(F.array_sort(F.collect_list("_r")).alias("rules"))


def with_rules(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] | DataFrame = RULES) -> DataFrame:
    """pages(host, path, ...) with _rule, as ``rule_of`` has it; rules as tuples or as a table of verdict, host, path."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE_RULES:
            return pages.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
        spark: SparkSession = pages.sparkSession
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    known = rules_of_hosts(pages.where("host <> ''").select("host").distinct(), rules)
    first = F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1))
    out = F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))
    return pages.join(known, "host", "left").withColumn("_rule", out).drop("rules")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1))
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("_link"))
    target = F.when(F.instr("_link", "://") > 0, F.col("_link")).otherwise(F.concat(F.lit("http:"), "_link"))
    return found.select("src", host_and_path(target)[0].alias("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, iterations: int | None = None, damping: float = DAMPING, rest: float = REST) -> DataFrame:
    """host, score: seeds(host, score) spread along edges(src, dst, n), each source dividing by its total n; to the limit unless iterations are given."""
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    weights = materialize(edges.join(out, "src").select("src", "dst", (damping * F.col("n") / F.col("all")).alias("w")), "edges")
    spark, schema, paths = seeds.sparkSession, "host string, new double", []

    def keep(new: DataFrame) -> tuple[DataFrame, float]:
        """An increment as a written table, and its sum."""
        paths.append(new_path(spark, "scores"))
        new.write.parquet(paths[-1])
        written = spark.read.schema(schema).parquet(paths[-1])
        return written, written.agg(F.coalesce(F.sum("new"), F.lit(0.0))).first()[0]

    new, left = keep(seeds.select("host", F.col("score").alias("new")))
    while left > 0 and (iterations is None or len(paths) <= iterations) and (iterations is not None or left * damping / (1 - damping) >= rest):
        new, left = keep(new.join(weights, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("new") * F.col("w")).alias("new")))
    return spark.read.schema(schema).parquet(*paths).groupBy("host").agg(F.sum("new").alias("score"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] | DataFrame = RULES, threshold: float = THRESHOLD, iterations: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row; iterations, where given, cut the sums."""
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    named = with_rules(named, rules)
    share = lambda verdict: (F.count_if(F.col("_rule.verdict") == verdict) / F.count("*")).alias(verdict)
    hosts = materialize(named.where("host <> ''").groupBy("host").agg(share("allow"), share("block")), "hosts")
    edges = materialize(host_edges(named.select("host", "html")), "edges")
    if edges.isEmpty():  # the fixed point is the seeds themselves
        scores = hosts.select("host", F.col("allow").alias("trust"), F.col("block").alias("distrust"))
    else:
        good = propagate(hosts.select("host", F.col("allow").alias("score")).where("score > 0"), edges, iterations)
        reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        bad = propagate(hosts.select("host", F.col("block").alias("score")).where("score > 0"), reverse, iterations)
        scores = (
            hosts.select("host")
            .join(good.withColumnRenamed("score", "trust"), "host", "left")
            .join(bad.withColumnRenamed("score", "distrust"), "host", "left")
            .fillna(0.0, ["trust", "distrust"])
        )
    scores = scores.withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})
    method = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return (
        named.drop("html")
        .join(scores, "host", "left")
        .fillna(0.0, ["trust", "distrust"])
        .select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", method).alias("verdict"), "trust", "distrust")
    )


def oracle(rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = THRESHOLD, steps: int = STEPS, damping: float = DAMPING) -> str:
    """The same in SQL, by a recursive table expression of so many steps, after which less than 1e-10 of the seeds is still to come."""
    case = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])))
    verdict = " ".join(f"WHEN rule = '{h + p}' THEN '{v}'" for v, h, p in rules)
    upper = f"translate(%s, '{UPPER}', '{LOWER}')"
    parts = [
        "WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"n AS (SELECT page_id, html, {upper % "regexp_extract(rest, '^([^/?#]*)', 1)"} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"r AS (SELECT *, CASE {case} END AS rule FROM n)",
        f"v AS (SELECT *, CASE {verdict} END AS ruled FROM r)",
        "h AS (SELECT host, count(*) FILTER (ruled = 'allow') / count(*) AS allow, count(*) FILTER (ruled = 'block') / count(*) AS block FROM v WHERE host <> '' GROUP BY host)",
        "l AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '" + LINK.replace("'", "''") + "', 1))) AS link FROM v WHERE host <> '')",
        "t AS (SELECT src, CASE WHEN contains(link, '://') THEN substr(link, instr(link, '://') + 3) ELSE substr(link, 3) END AS rest FROM l)",
        f"e AS (SELECT src, {upper % "regexp_extract(rest, '^([^/?#]*)', 1)"} AS dst, count(*) AS n FROM t GROUP BY ALL HAVING dst <> '' AND dst <> src)",
    ]
    for name, seed, src, dst in (("g", "allow", "src", "dst"), ("b", "block", "dst", "src")):
        parts.append(f"{name}w AS (SELECT {src} AS src, {dst} AS dst, {damping} * n / sum(n) OVER (PARTITION BY {src}) AS w FROM e)")
        step = f"SELECT dst, sum(new * w), step + 1 FROM {name}s JOIN {name}w ON host = src WHERE step < {steps} GROUP BY dst, step"
        parts.append(f"{name}s AS (SELECT host, {seed} AS new, 0 AS step FROM h WHERE {seed} > 0 UNION ALL {step})")
        parts.append(f"{name}t AS (SELECT host, sum(new) AS score FROM {name}s GROUP BY host)")
    return (
        ", ".join(parts)
        + f", s AS (SELECT h.host, round(coalesce(g.score, 0), 6) AS trust, round(coalesce(b.score, 0), 6) AS distrust FROM h LEFT JOIN gt g ON g.host = h.host LEFT JOIN bt b ON b.host = h.host)"
        + f" SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) >= {threshold} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,"
        " coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM v LEFT JOIN s ON s.host = v.host"
    )

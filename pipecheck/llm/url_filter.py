"""Pages are judged by rules for their address, else by what is known of their host (operator 6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipecheck.llm.common import ascii_lower, sql_lower, table, without
from pipecheck.session import written

# Fixed values of the query: verdict and rule (a host, then the start of a path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# A host whose lower bound of the bad share is above this is blocked; Z is one-sided 95 %.
MOST_BAD = 0.25
Z = 1.645
# Limits of the estimated correlation within a group, so that a prior weighs 0.01 to 1000 pages.
RHO = (1 / 1001, 100 / 101)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct<verdict, rule> of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains, where the path starts with its own. Rules are part of
    the plan, longest first: meant for a list that people write, not for millions.
    """
    none = F.lit(None).cast("struct<verdict:string,rule:string>")

    def add(rest: Column, rule: tuple[str, str]) -> Column:
        verdict, text = rule
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + tail)
        return F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(text).alias("rule"))).otherwise(rest)

    return reduce(add, sorted(rules, key=lambda r: (len(r[1]), r[1])), none)


def _rho(groups: DataFrame) -> float:
    """Correlation of outcomes within groups by the method of moments.

    ``groups`` has n, bad and parent, the mean expected of the group. Each group's squared distance to that mean
    is m(1-m)/n if its pages are independent, and m(1-m) if they are all alike.
    """
    m, n = F.col("parent"), F.col("n")
    row = groups.filter(n > 0).agg(
        F.sum(n * F.pow(F.col("bad") / n - m, 2) - m * (1 - m)).alias("over"), F.sum(m * (1 - m) * (n - 1)).alias("room")
    ).first()  # one row
    rho = row["over"] / row["room"] if row["room"] else 0.0
    return min(max(rho, RHO[0]), RHO[1])


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """host, domain, suffix, n, bad, mean, bound of every host in ``pages`` (page_id, host).

    ``outcomes`` has page_id and bad (0 or 1; null counts for nothing). The share of bad pages of a host
    has a beta prior around the posterior mean of its registered domain, that one around its suffix's, that one
    around the share of all. The weight of each prior comes from the spread between the groups of
    its level. ``bound`` is the lower posterior bound of the bad share: mean - z standard deviations.

    Pages are counted per host in their tasks before the shuffle, so a host with a third of the pages sends
    one row per task. Only two sums per level come to the driver. A registered domain is the last two
    labels of a host; hosts of one label are their own suffix.
    """
    known = outcomes.filter("bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    labelled = pages.join(known, "page_id", "left")
    parts = F.split("host", r"\.")
    tail = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.col("host"))
    hosts = written(
        labelled.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .select("host", tail.alias("domain"), F.element_at(parts, -1).alias("suffix"), "n", "bad"),
        "hosts",
    )
    return _shrink(hosts, z)


def _shrink(hosts: DataFrame, z: float) -> DataFrame:
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()  # one row
    # Without any outcome there is no evidence of bad pages.
    base = (total["bad"] + 0.5) / (total["n"] + 1.0) if total["n"] else 0.0
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("parent", F.lit(base))
    suffix_means = _posterior(suffixes, _rho(suffixes)).select("suffix", F.col("mean").alias("parent"))
    domains = hosts.groupBy("suffix", "domain").agg(*sums).join(suffix_means, "suffix")
    domain_means = _posterior(domains, _rho(domains)).select("domain", F.col("mean").alias("parent"))
    of_hosts = hosts.join(domain_means, "domain")
    return _posterior(of_hosts, _rho(of_hosts), z).drop("parent")


def _posterior(groups: DataFrame, rho: float, z: float = 0.0) -> DataFrame:
    weight = 1 / rho - 1
    mean = (F.lit(weight) * F.col("parent") + F.col("bad")) / (F.lit(weight) + F.col("n"))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.lit(weight) + F.col("n") + 1))
    return groups.withColumn("mean", mean).withColumn("bound", F.col("mean") - F.lit(z) * spread)


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...], most_bad: float = MOST_BAD, z: float = Z
) -> DataFrame:
    """host, path, rule, verdict for every page, with the columns of ``pages`` (page_id, url needed).

    A rule decides first; without one, a host is blocked if the lower bound of its share of bad pages is above
    ``most_bad``. Null addresses and addresses without ``://`` have an empty host and path and are judged as one host
    of that name. Rows that repeat a page_id count as often as they stand there. Several outcomes of a page count as
    the worst. Without any outcomes nothing is blocked but by rules. Clashing columns are replaced.
    """
    rest = without(pages, ["host", "path", "rule", "verdict", "of_host", "bound"])
    found = rest.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    hosts = host_reputation(found.select("page_id", "host"), outcomes, z)
    judged = found.join(hosts.select(F.col("host").alias("of_host"), "bound"), F.col("host") == F.col("of_host"), "left")
    first = longest_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") > most_bad, "block").otherwise("allow")
    return judged.withColumn("first", first).select(
        *(F.col(f"`{c}`") for c in rest.columns),
        "host",
        "path",
        F.col("first.rule").alias("rule"),
        F.coalesce(F.col("first.verdict"), by_host).alias("verdict"),
    )


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the document with its id: bad if its quality is 0 or it is toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return filter_urls(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


def _sql_rho(groups: str) -> str:
    return f"""least({RHO[1]!r}::DOUBLE, greatest({RHO[0]!r}::DOUBLE, coalesce((SELECT sum(n * pow(bad / n - parent, 2) - parent * (1 - parent))
    / nullif(sum(parent * (1 - parent) * (n - 1)), 0) FROM {groups} WHERE n > 0), 0)))"""


_SQL_RULES = sorted(RULES, key=lambda r: -len(r[1]))


def _sql_fit(text: str) -> str:
    name, slash, tail = text.partition("/")
    return f"((host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '{slash + tail}'))"


SQL = f"""
WITH found AS (
  SELECT page_id, {sql_lower("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), known AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE quality IS NOT NULL OR toxic = 1 GROUP BY doc_id
), hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
    count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad
  FROM found LEFT JOIN known USING (page_id) GROUP BY host
), suffixes AS (
  SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) ELSE 0 END FROM hosts) AS parent
  FROM hosts GROUP BY suffix
), suffix_weight AS (SELECT 1 / {_sql_rho("suffixes")} - 1 AS w
), domains AS (
  SELECT h.suffix, h.domain, sum(h.n)::BIGINT AS n, sum(h.bad)::BIGINT AS bad, any_value((w * s.parent + s.bad) / (w + s.n)) AS parent
  FROM hosts h JOIN suffixes s USING (suffix), suffix_weight GROUP BY h.suffix, h.domain
), domain_weight AS (SELECT 1 / {_sql_rho("domains")} - 1 AS w
), of_hosts AS (
  SELECT h.host, h.n, h.bad, (w * d.parent + d.bad) / (w + d.n) AS parent FROM hosts h JOIN domains d USING (domain), domain_weight
), host_weight AS (SELECT 1 / {_sql_rho("of_hosts")} - 1 AS w
), means AS (
  SELECT host, n, w, (w * parent + bad) / (w + n) AS mean FROM of_hosts, host_weight
), judged AS (
  SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (w + n + 1)) AS bound FROM means
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_sql_fit(text)} THEN '{text}'" for _, text in _SQL_RULES)} END AS rule FROM found
)
SELECT page_id, host, path, rule,
  CASE {" ".join(f"WHEN rule = '{text}' THEN '{verdict}'" for verdict, text in _SQL_RULES)}
    WHEN bound > {MOST_BAD} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN judged USING (host)
"""

QUERIES = {"op6_url_filter": (op6_url_filter, SQL)}

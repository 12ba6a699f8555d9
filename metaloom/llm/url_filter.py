"""URL filter: each URL is expanded into host-suffix and path-prefix expressions, which meet the rules' hashes.

The first four bytes of an expression's SHA-256 are the join key, as a list of millions of rules has few equal ones;
the whole digest is confirmed after the join, and of the rules that fit the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Longest host or path that a rule may have: it bounds how many expressions a URL has, and what the driver learns of the rules.
MAX_RULE = 2048

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of a digest on which expressions and rules meet, as hexadecimal digits.
PREFIX_DIGITS = 8


def host_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty where it is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.split(rest, "[/?#]", 2)[0]
    path = F.split(F.substring(rest, F.length(host) + 1, F.length(rest)), "[?#]", 2)[0]
    return F.translate(host, UPPER, LOWER), path


def _listed(rules: DataFrame) -> DataFrame:
    """(rule_host, rule_path, rule, rule_verdict, digest, short): one row for a rule; block wins where it is listed with both verdicts."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    own = rules.where("verdict is not null").groupBy(host.alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path")).agg(F.max("verdict").alias("rule_verdict"))
    own = own.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("digest", F.sha2("rule", 256))
    return own.withColumn("short", F.left("digest", F.lit(PREFIX_DIGITS)))


def _expressions(lengths: list[int], labels: int) -> Column:
    """The expressions of the columns host and head: the host's last labels, up to as many as a rule has, by the path's prefixes of the rules' lengths."""
    parts = F.split("host", r"\.")
    n = F.size(parts)
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    fit = F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length("head"))
    return F.flatten(F.transform(hosts, lambda h: F.transform(fit, lambda k: F.concat(h, F.substring(F.col("head"), F.lit(1), k)))))


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict): each URL's longest fitting rule with its verdict, or `default` where none fits.

    rules: (host, path, verdict). A rule fits its host and all subdomains where the URL's path starts, character by character,
    with the rule's. Longest is by characters of host and path together, then by host; a rule listed as allow and block blocks.

    URLs that agree in host and in as much of the path as rules look at are expanded once, so a hot site costs one row
    of each such path, and its pages take the verdict in a join whose other side has a row for each.

    Null URL, or none with `://`: empty host and path, judged like others. Ports and user names are part of the host. Very long
    URLs: whole in the result; expressions never exceed the longest rule. Null rule host or path: empty; null verdict: no
    rule; a rule of more than MAX_RULE characters in host or path raises ValueError. No rules: all default. Repeated rows
    and null ids: a row each. Empty table: no rows. Extra columns, whatever their names: left out.
    """
    listed = staged(_listed(rules), "rules")
    spans = listed.agg(F.max(F.greatest(F.length("rule_host"), F.length("rule_path"))), F.collect_set(F.length("rule_path")), F.max(F.size(F.split("rule_host", r"\.")))).first()
    if (spans[0] or 0) > MAX_RULE:
        raise ValueError(f"a rule is longer than {MAX_RULE} characters")
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not spans[1]:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = sorted(spans[1])
    head = F.left("path", F.lit(lengths[-1]))
    heads = urls.select("host", head.alias("head")).distinct()
    tried = heads.select("host", "head", F.explode(_expressions(lengths, spans[2])).alias("expression"))
    tried = tried.select("host", "head", F.sha2("expression", 256).alias("own")).withColumn("short", F.left("own", F.lit(PREFIX_DIGITS)))
    fits = tried.join(listed, "short").where("own = digest")
    rank = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "rule_verdict")
    best = fits.groupBy(F.col("host").alias("best_host"), "head").agg(F.max(rank).alias("best"))
    met = urls.join(best, (F.col("host") == F.col("best_host")) & (head == F.col("head")), "left")
    return met.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


#: The contract's rules: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

ORACLE = f"""WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_values}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS site, rest FROM cut),
u AS (SELECT page_id, translate(site, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(site) + 1), '^[^?#]*') AS path, row_number() OVER () AS n FROM part),
fit AS (SELECT u.n, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY u.n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM u LEFT JOIN fit ON fit.n = u.n AND place = 1"""

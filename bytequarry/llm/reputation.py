"""Operator 6: URL filters by rules and, where none fits, by empirical-Bayes host reputation.

Labelled outcomes of pages are counted per host, registered domain and public suffix. From the suffix down
each level's share of bad pages is shrunk to that of the level above by a beta-binomial prior, whose strength
is the level's own over-dispersion (method of moments). A host is blocked when the lower bound of its
posterior exceeds the tolerated share. Everything is DataFrame expressions; counts are pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, staged

__all__ = ["RULES", "host_reputation", "judge_urls", "url_parts", "op6_reputation", "OP6_SQL"]

#: (verdict, host, path); fixed values of the query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Suffixes of two labels; every other host's suffix is its last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.in", "com.br", "com.cn", "com.mx", "co.za", "github.io")
#: IPv4 and bracketed IPv6 addresses.
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*)$"
#: Tolerated share of bad pages, and the standard deviations of the posterior bound.
TOLERATED, Z = 0.25, 1.645
#: Least and most strength of a prior, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (size, rule, verdict) of the longest rule for the host, or a parent domain of it, and the path; else null."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    each = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array_compact(F.array(*each)))


def _domain(host: Column, long_suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and public suffix, without port; an address is its own domain and suffix."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    long_, address = two.isin(*long_suffixes), name.rlike(ADDRESS)
    return F.when(address, name).when(long_, three).otherwise(two), F.when(address, name).when(long_, two).otherwise(F.substring_index(name, ".", -1))


def _strength(level: DataFrame) -> float:
    """Pages that a level's prior is worth: 1 / rho - 1 for the moment estimate of the over-dispersion rho."""
    mu = F.col("mu")
    extra, pairs = level.agg(F.sum((F.col("k") - F.col("n") * mu) * (F.col("k") - F.col("n") * mu) / (mu * (1 - mu))) - F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1))).first()
    rho = extra / pairs if pairs else 0.0
    return min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho and rho > 0 else STRONGEST


def host_reputation(outcomes: DataFrame, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """host, domain, suffix, n, k, mean, bound for each host of ``outcomes`` (host, bad); rows with null bad count as unlabelled.

    ``long_suffixes``: the public suffixes of two labels; the default list holds common ones only."""
    domain, suffix = _domain(F.col("host"), long_suffixes)
    hosts = staged(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k")).select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    total, bad = hosts.agg(F.sum("n"), F.sum("k")).first()
    mean = ((bad or 0) + 0.5) / ((total or 0) + 5.0)
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("mu", F.lit(mean))
    s = _strength(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("k") + s * F.col("mu")) / (F.col("n") + s)).alias("mu"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix")
    d = _strength(domains)
    domains = domains.select("suffix", "domain", ((F.col("k") + d * F.col("mu")) / (F.col("n") + d)).alias("mu"))
    hosts = hosts.join(domains, ["suffix", "domain"])
    h = _strength(hosts)
    size, mean = F.col("n") + h, (F.col("k") + h * F.col("mu")) / (F.col("n") + h)
    return hosts.select("host", "domain", "suffix", "n", "k", mean.alias("mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, tolerated: float = TOLERATED, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    A page is labelled by the rows of ``labels`` (doc_id, quality, toxic) with its id: bad if any is toxic or
    of quality 0. The longest fitting rule decides; else ``block`` if the lower bound of the host's share of
    bad pages is above ``tolerated``, else ``allow``. A null url or one without ``://`` has an empty host, which
    is a host like others. Repeated rows each return a row and count; a null page_id is unlabelled.
    """
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.col("toxic") == 1, F.col("quality") == 0)).alias("bad"))
    host, path = url_parts(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    reputation = host_reputation(parted.select("page_id", "host").join(bad, "page_id", "left").select("host", "bad"), long_suffixes)
    judged = parted.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules)).join(reputation.select("host", "bound"), "host", "left")
    own = F.when(F.col("bound") > tolerated, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"))


def op6_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every url of ``pages``, learnt from ``labels``."""
    return judge_urls(read(spark, sf_dir, "pages", "page_id", "url"), read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


_LEVEL = """(SELECT CASE WHEN sum(n * (n - 1)) > 0 AND sum((k - n * mu) * (k - n * mu) / (mu * (1 - mu))) - sum(n) > 0
    THEN least({high}, greatest({low}, 1 / ((sum((k - n * mu) * (k - n * mu) / (mu * (1 - mu))) - sum(n)) / sum(n * (n - 1))) - 1)) ELSE {high} END FROM {table})"""
_CASES = " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{h + p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
_VERDICTS = " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in RULES)
_LIST = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)

OP6_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
bad AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
counts AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM parted LEFT JOIN bad USING (page_id) GROUP BY 1),
pieces AS (SELECT *, string_split(name, '.') AS l FROM counts),
named AS (SELECT host, n, k, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name END AS own, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three, l[-1] AS one FROM pieces),
hosts AS (SELECT host, n, k, coalesce(own, CASE WHEN two IN ({_LIST}) THEN three ELSE two END) AS domain, coalesce(own, CASE WHEN two IN ({_LIST}) THEN two ELSE one END) AS suf FROM named),
s0 AS (SELECT suf, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5) / (sum(n) + 5.0) FROM hosts) AS mu FROM hosts GROUP BY 1),
s1 AS (SELECT suf, (k + s * mu) / (n + s) AS mu FROM s0, (SELECT {_LEVEL.format(low=WEAKEST, high=STRONGEST, table="s0")} AS s)),
d0 AS (SELECT suf, domain, h.n, h.k, mu FROM (SELECT suf, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2) h JOIN s1 USING (suf)),
d1 AS (SELECT suf, domain, (k + s * mu) / (n + s) AS mu FROM d0, (SELECT {_LEVEL.format(low=WEAKEST, high=STRONGEST, table="d0")} AS s)),
h0 AS (SELECT host, n, k, mu FROM hosts JOIN d1 USING (suf, domain)),
h1 AS (SELECT host, (k + s * mu) / (n + s) AS mean, n + s AS size FROM h0, (SELECT {_LEVEL.format(low=WEAKEST, high=STRONGEST, table="h0")} AS s)),
ruled AS (SELECT page_id, host, path, CASE {_CASES} END AS rule FROM parted)
SELECT page_id, host, path, rule, coalesce(CASE rule {_VERDICTS} END, CASE WHEN mean - {Z} * sqrt(mean * (1 - mean) / (size + 1)) > {TOLERATED} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN h1 USING (host)
"""

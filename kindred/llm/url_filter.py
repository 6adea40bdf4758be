"""URL filter by empirical-Bayes host reputation, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

#: (verdict, host, path) as the contract states them; a rule fits its host and all subdomains.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels below which names are registered; any other name's suffix is its last label.
#: A parameter: common ones, to be replaced by a full public list where there is one.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "co.za",
            "com.ar", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "blogspot.com", "github.io", "gitlab.io", "netlify.app")
ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$"
#: Posterior bound: mean - Z standard deviations of the host's beta posterior.
Z, THRESHOLD = 1.645, 0.6


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path; both are empty for a null url or one without ``://``."""
    rest = F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")
    known = F.col(url_col).isNotNull() & F.col(url_col).contains("://")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.when(known, host).otherwise("")) \
                .withColumn("path", F.when(known, path).otherwise(""))


def rule_columns(rules: Sequence[tuple[str, str, str]]):
    """(rule, verdict) columns of the longest fitting rule, else null; the rules are few and fixed."""
    rule = verdict = F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def hierarchy(host, suffixes: Sequence[str] = SUFFIXES):
    """(domain, suffix) columns of a host: user-info, port and a last dot don't count; an address is a domain of its own below 'address'."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", "")
    name = F.regexp_replace(name, r"\.$", "")
    address = name.rlike(ADDRESS)
    long = F.substring_index(name, ".", -2).isin(*suffixes)
    labels = lambda n: F.substring_index(name, ".", -n)
    return (F.when(address, name).when(long, labels(3)).otherwise(labels(2)),
            F.when(address, "address").when(long, labels(2)).otherwise(labels(1)))


def _level(stats: DataFrame, key: str, parent: str) -> tuple[DataFrame, float]:
    """Sums k of n by key, and the prior weight m of its parent by the method of moments."""
    own = stats.groupBy(key, parent).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    up = own.groupBy(parent).agg(F.sum("k").alias("pk"), F.sum("n").alias("pn"))
    mu = F.col("pk") / F.col("pn")
    var = mu * (1 - mu)
    spread = F.col("n") * F.pow(F.col("k") / F.col("n") - mu, 2)
    row = own.where("n > 0").join(up, parent).agg(
        F.sum(spread - var).alias("over"), F.sum(var * (F.col("n") - 1)).alias("room")).first()
    rho = row["over"] / row["room"] if row["room"] else 0.1
    rho = min(max(rho, 0.001), 0.5)
    return own, round(1 / rho - 1, 3)


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z,
                threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url",
                suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """A verdict for every url: the longest fitting rule's, else by the host's reputation.

    ``outcomes(page_id, good)`` holds labelled page outcomes (good 0 or 1, null: none). A host's
    rate of good pages has a beta posterior whose prior mean is its registered domain's shrunk
    rate, which is shrunk to the suffix's, and that to the overall rate, which has a uniform prior itself: a few
    labels, all of one kind, make no host certain. The weight of each prior
    comes from the spread between groups (method of moments for the beta-binomial). A host is
    allowed if mean - z * sd >= threshold. Domain and suffix are hierarchy()'s.

    A reputation is worth what its outcomes are. The query takes the label of the document of the same number,
    as no table labels pages; nothing ties the two, so its bounds vary around the overall rate
    and its verdicts on hosts without a rule say little.

    Result: page_id, host, path, rule, verdict, reputation (the bound, 6 digits). Null urls have
    empty host and path and are judged as the host ''. Repeated pages and ids are kept, each with
    its verdict; without any label the overall rate is one half; urls of any length are read whole; empty tables give no rows.
    Hot hosts are counted with map-side partial sums, and the last join is a sort-merge join
    with one row a host, which adaptive execution can split.
    """
    urls = with_host_and_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_u")), "_u").drop("_u")
    seen = outcomes.groupBy(F.col("page_id")).agg(
        F.sum(F.col("good").cast("bigint")).alias("k"), F.count("good").alias("n"))
    counted = urls.select("page_id", "host").join(seen, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    domain, suffix = hierarchy(F.col("host"), suffixes)
    hosts = checkpointed(counted.select("host", "k", "n", domain.alias("domain"), suffix.alias("suffix"), F.lit(0).alias("all")))
    host, m_host = _level(hosts, "host", "domain")
    domain, m_domain = _level(hosts, "domain", "suffix")
    suffix, m_suffix = _level(hosts, "suffix", "all")
    total = hosts.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    p0 = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)  # uniform prior of the overall rate

    s = suffix.select("suffix", ((F.col("k") + m_suffix * p0) / (F.col("n") + m_suffix)).alias("ps"))
    d = domain.join(s, "suffix").select("domain", ((F.col("k") + m_domain * F.col("ps")) / (F.col("n") + m_domain)).alias("pd"))
    a, b = F.col("k") + m_host * F.col("pd"), F.col("n") - F.col("k") + m_host * (1 - F.col("pd"))
    judged = host.join(d, "domain").select("host", a.alias("a"), b.alias("b")).select("host", (
        F.col("a") / (F.col("a") + F.col("b")) - z * F.sqrt(F.col("a") * F.col("b") / (
            F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1)))).alias("bound"))
    rule, verdict = rule_columns(rules)
    own = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return urls.join(judged, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.round("bound", 6).alias("reputation"))

"""URL filters by rules and by empirical-Bayes host reputation, in DataFrame operations only.

Rules come first: a rule fits its host and all subdomains if the url's path
starts with the rule's path; the longest wins.  Other pages are judged by their
host's reputation.  Labelled page outcomes (bad or not) are counted for each
host, registered domain and suffix.  Each level's rate is shrunk towards its
parent's by a beta-binomial prior whose strength is estimated by moments from
how much the level's rates scatter; a host is blocked if the lower bound of its
posterior rate of bad pages (mean less ``z`` standard deviations) passes ``limit``.

Defined cases: a null url, or one without ``://``, has an empty host and path;
no rule fits an empty path; several outcomes of one page count as bad if any is;
repeated pages each get a row; hosts without any outcome inherit the shrunk rate
of their domain, suffix or everything; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of two labels; all others have one.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
Z, LIMIT = 1.645, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`url`")))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def registered(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    long = two.isin(*long_suffixes)
    return F.when(long, three).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) that fits a host and path, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _strength(rates: DataFrame) -> float:
    """Prior strength by moments: rows have n, y and the parent's rate p."""
    over = rates.agg(
        F.sum((F.col("y") - F.col("n") * F.col("p")) ** 2 - F.col("n") * F.col("p") * (1 - F.col("p"))).alias("a"),
        F.sum(F.col("n") * (F.col("n") - 1) * F.col("p") * (1 - F.col("p"))).alias("b"),
    ).first()
    rho = min(0.99, max(1e-3, over["a"] / over["b"])) if over["b"] else 1e-3
    return (1 - rho) / rho


def _shrink(counts: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Each row's rate, shrunk towards its parent's rate p."""
    rates = counts.join(parents, key)
    m = _strength(rates)
    return rates.withColumn("a", F.col("y") + F.lit(m) * F.col("p")).withColumn("b", F.col("n") - F.col("y") + F.lit(m) * (1 - F.col("p")))


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host -> (rate, lower): pages has page_id, host, domain, suffix; outcomes has page_id, bad."""
    bad = pick(outcomes, "page_id", "bad").where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = pages.join(bad, "page_id", "left").groupBy("host", "domain", "suffix").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    everywhere = ((total["y"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    rate = (F.col("a") / (F.col("a") + F.col("b"))).alias("p")
    top = suffixes.select("suffix", F.lit(everywhere).alias("p"))
    by_suffix = _shrink(suffixes, top, "suffix").select("suffix", rate)
    by_domain = _shrink(domains, by_suffix, "suffix").select("domain", rate)
    posterior = _shrink(hosts.drop("suffix"), by_domain, "domain")
    a, b = F.col("a"), F.col("b")
    mean, deviation = a / (a + b), F.sqrt(a * b / ((a + b + 1) * (a + b) * (a + b)))
    return posterior.select("host", mean.alias("rate"), (mean - F.lit(Z) * deviation).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    found = pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    domain, suffix = registered(F.col("host"))
    known = reputation(found.select("page_id", "host", domain.alias("domain"), suffix.alias("suffix")), outcomes)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return found.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"))


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Page outcomes from labelled documents: a page is of the document whose id ends its url's path."""
    _, path = host_and_path(F.col("url"))
    doc = F.regexp_extract(path, r"/([0-9]{1,18})[^0-9/]*/?$", 1)
    of = pick(pages, "page_id", "url").select("page_id", F.when(doc != "", doc.cast("bigint")).alias("doc_id")).where("doc_id is not null")
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")
    return of.join(pick(labels, "doc_id", "quality", "toxic").select("doc_id", bad), "doc_id").select("page_id", "bad")

"""URL filters by empirical-Bayes host reputation, in SQL functions only.

Labelled pages are outcomes of their host. A host's rate of bad pages has a beta
prior around its registered domain's rate, that around its suffix's rate, and that
around the overall rate; how strongly each level pulls is estimated from the spread
of rates on it (method of moments for the beta-binomial). A host is blocked if even
the lower bound of its posterior rate is above the limit. Explicit rules go first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import drop_stored, left_join_hot, stored

#: A host is blocked if mean - BOUND_SD * sd of its posterior rate of bad pages exceeds BAD_LIMIT.
BAD_LIMIT, BOUND_SD = 0.2, 1.0
#: The overall rate has a beta prior of PRIOR_BAD bad pages in PRIOR_PAGES, so that a few outcomes condemn no one else.
PRIOR_BAD, PRIOR_PAGES = 1.0, 10.0
#: Labels under a country's suffix below which domains are registered.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "ne", "net", "or", "org"]
#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"://([^/?#]*)([^?#]*)"


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host (A-Z lower-cased) and path; both empty where the url is null or has no `://`."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), "path": F.regexp_extract(url, _URL, 2)})


def _rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict. Of rules as long as each other the first by host, then path, wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.coalesce(name, F.when(fits, F.lit(host + path))), F.coalesce(verdict, F.when(fits, F.lit(says)))
    return name, verdict


def _strength(rates: DataFrame, parent: str) -> float:
    """Prior pseudo-counts on a level: of (n, bad) rows around their parent's posterior mean, from 1 to 1000."""
    p, n = F.col(parent), F.col("n")
    spread = p * (1 - p)
    x = rates.where("n > 0").agg(F.sum(n * (F.col("bad") / n - p) ** 2), F.sum(spread), F.sum(n * spread)).first()
    over = (x[0] - x[1]) / (x[2] - x[1]) if x[0] is not None and x[2] > x[1] else 0.0
    return min(1000.0, max(1.0, 1 / over - 1 if over > 0 else 1000.0))


def name_of(host: Column) -> Column:
    """The host without user information and port."""
    return F.regexp_replace(F.regexp_replace(host, F.lit("^.*@"), F.lit("")), F.lit(":[0-9]*$"), F.lit(""))


def reputations(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """name, n, bad, mean, sd of the name of every host of pages.

    pages: id_col, host. outcomes: id_col, bad (1 or 0); pages without an outcome tell nothing about their host.
    The suffix is a name's last label, or its last two where they are a country and one of SECOND_LEVEL; the registered domain
    is one label more. Without any outcome all means are the prior's.
    """
    known = outcomes.where("bad is not null").groupBy(id_col).agg(F.max("bad").alias("bad"))
    # narrow on both sides; counts by host are made before they move
    joined = pages.where(F.col("host") != "").select(id_col, name_of(F.col("host")).alias("name")).join(known, id_col, "left")
    hosts = joined.groupBy("name").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    labels = F.split("name", r"\.")
    two = (F.length(F.element_at(labels, -1)) == 2) & F.coalesce(F.try_element_at(labels, F.lit(-2)).isin(SECOND_LEVEL), F.lit(False))
    cut = lambda n: F.substring_index("name", ".", -n)
    hosts = stored(hosts.withColumns({"domain": F.when(two, cut(3)).otherwise(cut(2)), "suffix": F.when(two, cut(2)).otherwise(cut(1))}), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    overall = (total[0] + PRIOR_BAD) / (total[1] + PRIOR_PAGES)
    posterior = lambda level, parent, k: level.withColumn("mean", (F.lit(k) * F.col(parent) + F.col("bad")) / (F.lit(k) + F.col("n")))
    suffixes = suffixes.withColumn("up", F.lit(overall))
    suffixes = stored(posterior(suffixes, "up", _strength(suffixes, "up")).select("suffix", F.col("mean").alias("up")), "suffixes")
    domains_up = stored(left_join_hot(domains, suffixes, "suffix", "domain"), "domains-up")
    ups = stored(posterior(domains_up, "up", _strength(domains_up, "up")).select("domain", F.col("mean").alias("up")), "domain-means")
    hosts_up = stored(left_join_hot(hosts, ups, "domain", "name"), "hosts-up")
    for x in (hosts, domains, suffixes, domains_up, ups):
        drop_stored(x)
    k = _strength(hosts_up, "up")
    out = posterior(hosts_up, "up", k)
    return out.withColumn("sd", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.lit(k) + F.col("n") + 1))).select("name", "n", "bad", "mean", "sd")


def judged(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, bad_limit: float = BAD_LIMIT, bound_sd: float = BOUND_SD) -> DataFrame:
    """id, host, path, rule, verdict for each row of pages, repeated rows too.

    A host's reputation goes by its name, without user information and port. Pages without a host fall under no rule and are allowed. Extra columns of pages are ignored.
    """
    pages = with_host(pages.select(id_col, url_col), url_col)
    bad = stored(reputations(pages, outcomes, id_col).where(F.col("mean") - bound_sd * F.col("sd") > bad_limit).select("name", F.lit(True).alias("bad_host")), "bad-hosts")
    name, verdict = _rule(RULES if rules is None else rules)
    joined = left_join_hot(pages.withColumn("name", name_of(F.col("host"))), bad, "name", id_col, "path")
    return joined.select(id_col, "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("bad_host"), F.lit("block")), F.lit("allow")).alias("verdict"))

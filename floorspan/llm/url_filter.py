"""URL filters: rules on hosts and paths first, empirical-Bayes host reputation for all other pages.

A rule (host, path, verdict) fits the pages of its host and of all its subdomains whose path starts with the rule's;
the longest fitting rule (host and path together, then the host) decides.  The distinct addresses are joined with the rules on the hosts that they end in,
so rule lists may have any size and no page is compared with a rule of another host.

Pages with a known outcome (by default: those that a rule decides, allow is good and block is bad) give each host its
numbers of good and bad pages.  A host's share of good pages has a Beta prior whose mean is the posterior mean of its
registered domain, whose prior comes in the same way from its suffix, whose prior comes from all pages.  How many
pages a prior is worth is fitted for each level by moments: the hosts' squared deviations from their priors' means,
over what binomial chance alone gives, are the correlation rho of two pages of a host, and 1 / rho - 1 the worth,
within ``WORTH`` and in whole pages, at least one good and one bad.  So a host with few pages is judged by its
domain and suffix, and one with many by its own.  A host is blocked where the posterior probability that its good share is
``SHARE`` or more is at most ``DOUBT``: the posterior's upper bound lies under the share.  With whole counts that
probability is an exact binomial sum.

Everything is a sum by host, domain or suffix: partial before the shuffle, so that a hot host is a row for each task.

Defined cases: a null URL or one without ``://`` has empty host and path, which no rule fits and which form a host,
domain and suffix of their own; a port and a user name belong to the host as rules see it, but not to its domain; an
address of numbers is its own domain and suffix; without any known outcome all hosts have the prior of one good and
one bad page at least, and none is blocked; repeated pages count each and get a verdict each; rules that are
repeated or equal in host and path count once, block before allow; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspan.llm._common import cut, table
from floorspan.llm.quality_rules import binomial_at_most

#: The rules of the registered query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Public suffixes of two labels; any other suffix is the last label.
SUFFIXES = ("ac.jp", "ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
#: Pages that a prior is worth: at least and at most.
WORTH = (2, 1000)
SHARE, DOUBT = 0.5, 0.05


def address(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lowered, and path of a URL; both empty where there is no ``://``."""
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    of = lambda k: F.coalesce(F.regexp_extract(url, parts, k), F.lit(""))
    return F.translate(of(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), of(2)


def domain_and_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain of a host, and the suffix that it is registered under."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)\A.*@", ""), r":[0-9]*\z", "")
    last = lambda n: F.substring_index(bare, ".", -n)
    double = last(2).isin(*suffixes) if suffixes else F.lit(False)
    number = bare.rlike(r"\A[0-9.]+\z")
    return F.when(number, bare).when(double, last(3)).otherwise(last(2)), F.when(number, bare).when(double, last(2)).otherwise(last(1))


def rules_of(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def by_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, decided) of the distinct addresses (host, path) that a rule fits."""
    own = rules.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("decided"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tries = addresses.distinct().select("host", "path", F.explode(ends).alias("r_host"))
    fits = tries.join(own, "r_host").filter(F.startswith("path", F.col("r_path")))
    longest = F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "decided"), F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host")))
    return fits.groupBy("host", "path").agg(longest.alias("x")).select("host", "path", "x.rule", "x.decided")


def worth(groups: DataFrame, within: tuple[int, int] = WORTH) -> float:
    """Pages that the prior of a level is worth, from its groups (n, k, p): known pages, good ones, the prior's mean."""
    n, k, p = F.col("n").cast("double"), F.col("k").cast("double"), F.col("p")
    chance = p * (1 - p)
    s = groups.filter("n > 0").agg(F.sum((k - n * p) * (k - n * p)), F.sum(n * chance), F.sum(n * (n - 1) * chance)).first()
    if s[0] is None or s[2] <= 0:
        return float(within[0])
    rho = (s[0] - s[1]) / s[2]
    if rho <= 0:
        return float(within[1])
    return float(min(max(round(1 / rho - 1, 3), within[0]), within[1]))  # rounded: sums of doubles depend on their order


def _with_prior(groups: DataFrame, pages: float) -> DataFrame:
    """Adds the whole pages of the prior, and the posterior mean."""
    a = F.greatest(F.lit(1.0), F.floor(F.col("p") * pages + 0.5)).cast("long")
    b = F.greatest(F.lit(1.0), F.floor((1 - F.col("p")) * pages + 0.5)).cast("long")
    return groups.withColumn("a", a).withColumn("b", b).withColumn("mean", (F.col("a") + F.col("k")) / (F.col("a") + F.col("b") + F.col("n")).cast("double"))


def reputations(outcomes: DataFrame, share: float = SHARE, doubt: float = DOUBT, within: tuple[int, int] = WORTH, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, n, k, a, b, trusted) of every host of (host, good), where good is null, 0 or 1.

    ``trusted`` is false where the posterior Beta(a + k, b + n - k) of the host's good share gives ``share`` or more a
    probability of at most ``doubt``.
    """
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = cut(outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k")).withColumn("domain", domain).withColumn("suffix", suffix))
    all_ = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    sums = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    level = cut(sums("suffix").withColumn("p", F.lit((all_[1] + 1) / (all_[0] + 2))))
    level = _with_prior(level, worth(level, within))
    for by, groups in (("suffix", sums("domain", "suffix")), ("domain", hosts)):
        level = cut(groups.join(level.select(by, F.col("mean").alias("p")), by))
        level = _with_prior(level, worth(level, within))
    good, pages = F.col("a") + F.col("k"), F.col("a") + F.col("b") + F.col("n")
    # P(share of Beta(x, y) >= s) is P(X <= x - 1) for X ~ B(x + y - 1, s)
    return level.select("host", "n", "k", "a", "b", (binomial_at_most(good - 1, pages - 1, share) > doubt).alias("trusted"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", outcomes: DataFrame | None = None, **options) -> DataFrame:
    """(id, host, path, rule, verdict) of every page.

    ``outcomes`` (id, good) are known outcomes of pages; without them the rules' verdicts are.
    """
    host, path = address(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    found = cut(by_rules(rows.select("host", "path"), rules))
    ruled = rows.join(found, ["host", "path"], "left")
    if outcomes is None:
        known = ruled.select("host", F.when(F.col("decided") == "allow", 1).when(F.col("decided") == "block", 0).alias("good"))
    else:
        known = rows.join(outcomes.select(F.col(id_col).alias("id"), F.col("good").cast("int").alias("good")), "id", "left").select("host", "good")
    trust = reputations(known, **options)
    verdict = F.coalesce("decided", F.when(F.col("trusted"), "allow").otherwise("block"))
    return ruled.join(trust.select("host", "trusted"), "host").select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_of(spark, RULES))

"""URL rules, and a reputation of hosts for the pages that no rule decides.

A host's share of good pages is estimated from labelled pages and shrunk, by beta-binomial
priors, from the host to its registered domain, to its suffix, to all pages. A page is blocked
when the upper bound of its host's share is under a threshold: doubt is in the page's favour.
Everything is built-in functions on columns.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
    ("com/fr/", "allow"), ("com/de/", "block"),
)
# Suffixes of two labels, under which domains are registered one label further down.
LONG_SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph",
    "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn",
    "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br",
    "org.cn", "org.nz", "org.uk", "org.za", "blogspot.com", "github.io", "gitlab.io", "netlify.app", "pages.dev",
    "readthedocs.io", "vercel.app", "wordpress.com",
)
THRESHOLD = 0.5
DEVIATIONS = 1.645  # of the posterior; the bound is that of a one-sided 95 % interval
STRENGTHS = (1.0, 1000.0)  # a prior counts as so many pages at least and at most
_SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a URL; "" for both if null or without ``://``."""
    start = F.locate("://", url)
    after = F.when(start > 0, url.substr(start + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(
        F.regexp_extract(after, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase
    )
    return host, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``rule, verdict`` of the longest rule that fits, or NULL; of equal ones the first given."""
    found = []
    for rule, verdict in sorted(rules, key=lambda pair: -len(pair[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


def suffix_of(host: Column, long_suffixes: Sequence[str] = ()) -> Column:
    """The last label, or the last two if ``long_suffixes`` lists them (``co.uk``)."""
    two = F.substring_index(host, ".", -2)
    one = F.substring_index(host, ".", -1)
    return F.when(two.isin(*long_suffixes), two).otherwise(one) if long_suffixes else one


def domain_of(host: Column, long_suffixes: Sequence[str] = ()) -> Column:
    """The registered domain: the suffix and one label more."""
    two = F.substring_index(host, ".", -2)
    if not long_suffixes:
        return two
    return F.when(two.isin(*long_suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(groups: DataFrame, mean: Column) -> Column:
    """How many pages a prior counts for: by the method of moments over ``good, labelled``."""
    low, high = STRENGTHS
    share = F.col("good") / F.col("labelled")
    spread = F.sum(F.col("labelled") * (share - mean) * (share - mean)) / F.sum("labelled")
    value = F.try_divide(mean * (1 - mean), spread) - 1
    return (
        groups.where(F.col("labelled") > 0)
        .agg(F.least(F.greatest(F.coalesce(value, F.lit(high)), F.lit(low)), F.lit(high)))
        .scalar()
    )


def reputations(
    outcomes: DataFrame, long_suffixes: Sequence[str] = (), deviations: float = DEVIATIONS
) -> DataFrame:
    """``host, share, lower, upper`` for every host of ``host, good`` (1, 0, or null: not labelled).

    ``share`` is the posterior mean of good pages and the bounds lie ``deviations`` standard
    deviations from it. Without any labelled page the share is a half everywhere. Other columns
    are ignored; a null host counts as "".
    """
    host = F.coalesce("host", F.lit(""))
    hosts = (
        outcomes.select(host.alias("host"), "good")
        .groupBy("host")
        .agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("labelled"))
        .withColumn("domain", domain_of(F.col("host"), long_suffixes))
        .withColumn("suffix", suffix_of(F.col("host"), long_suffixes))
    )
    sums = [F.sum("good").alias("good"), F.sum("labelled").alias("labelled")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(
        F.coalesce(F.try_divide(F.sum("good"), F.sum("labelled")), F.lit(0.5))
    ).scalar()

    def shrunk(groups: DataFrame, prior: Column) -> DataFrame:
        strength = _strength(groups, whole)
        a = strength * prior + F.col("good")
        return groups.withColumn("a", a).withColumn(
            "b", strength * (1 - prior) + F.col("labelled") - F.col("good")
        )

    mean = F.col("a") / (F.col("a") + F.col("b"))
    by_suffix = shrunk(suffixes, whole).select("suffix", mean.alias("prior"))
    by_domain = shrunk(domains.join(by_suffix, "suffix"), F.col("prior")).select(
        "domain", mean.alias("prior")
    )
    by_host = shrunk(hosts.join(by_domain, "domain"), F.col("prior"))
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return by_host.select(
        "host",
        mean.alias("share"),
        (mean - deviations * deviation).alias("lower"),
        (mean + deviations * deviation).alias("upper"),
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    good: Column | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = THRESHOLD,
    long_suffixes: Sequence[str] = (),
) -> DataFrame:
    """``page_id, host, path, rule, verdict, share, upper``: one row for every row of ``pages``.

    ``good`` labels pages (1, 0 or null); by default the rules do: pages that a rule allows are
    good, pages that a rule blocks are bad, and the others are judged by their host's reputation.
    The verdict is the rule's where one fits, else ``block`` if the upper bound of the host's
    share is under ``threshold``, else ``allow``. Null and odd URLs have host and path "".
    Repeated rows are judged each; an empty table gives no rows; only the id and the URL are read.
    """
    host, path = host_and_path(F.col(url_col))
    outcome = F.lit(None).cast("int") if good is None else good.cast("int")
    judged = pages.select(
        F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), outcome.alias("given")
    )
    judged = judged.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    by_rule = F.when(F.col("found").isNotNull(), (F.col("found.verdict") == "allow").cast("int"))
    outcomes = judged.select("host", (by_rule if good is None else F.col("given")).alias("good"))
    # A host may hold a third of all pages: the pages are dealt over copies of its one row.
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    known = reputations(outcomes, long_suffixes).withColumn("salt", salts)
    salted = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(_SALTS)).cast("int"))
    by_host = F.when(F.col("upper") < threshold, "block").otherwise("allow")
    return salted.join(known, ["host", "salt"]).select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), by_host).alias("verdict"),
        "share",
        "upper",
    )

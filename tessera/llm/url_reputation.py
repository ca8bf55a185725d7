"""URL rules and Empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host, registered domain and
suffix. Each level's bad rate is shrunk towards its parent's through a
beta-binomial prior whose strength comes from the spread between the level's
members (method of moments): all pages -> suffix -> registered domain -> host.
A host is blocked where the lower bound of its posterior bad rate, mean minus
`z` standard deviations of the Beta posterior, exceeds `factor` times the bad rate of all
pages: where it is worse than the corpus even at the bound. Hosts without labels
take their domain's posterior mean with the prior's own width.

Suffixes: a domain is registered below the host's public suffix. A table of
public suffixes (`suffixes`, see `public_suffixes`) gives these; without it they are the last
label and TWO_LABEL_SUFFIXES.

A rule comes before the method: of the rules that fit a url the longest wins
(then the longest host).

Scale: pages meet labels in one equi-join of unique keys, counts are summed
before each exchange, and all further steps run on one row for each host. The
verdicts are written first, so the planner broadcasts them only where they are
small; else the join's hot hosts are split by adaptive execution.

Defined results: an empty table gives an empty result; a null url or one without `://` has an empty host and path and
is judged as the host ``''``; repeated pages count once for each row; a page
with several labels counts once, bad if any label says so; labels whose
quality and toxic are both null don't count; without labels nothing is blocked but
by rule; other columns are not read, and keep_allowed hands them on, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialize

#: (action, host, path)
Rule = tuple[str, str, str]
#: Suffixes of two labels under which names are registered. A parameter.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "com.br", "com.cn", "co.in", "co.za", "com.mx", "com.tr")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Bounds of a prior's strength, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The rule that fits, as `host/path`, and its action; both null where none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        name = F.when(fits, F.lit(f"{rule_host}/{rule_path}")).otherwise(name)
        action = F.when(fits, F.lit(what)).otherwise(action)
    return name, action


def public_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a file in the format of the public suffix list: one rule a line, `*.` and `!` rules among them."""
    lines = spark.read.text(path).select(F.lower(F.regexp_extract("value", r"^\s*(\S*)", 1)).alias("rule"))
    return lines.filter((F.col("rule") != "") & ~F.col("rule").startswith("//")).distinct()


def suffix_sizes(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(bare, size): how many labels the public suffix of each distinct `bare` host has: by the longest rule that fits, exceptions first."""
    labels = hosts.select("bare").distinct().withColumn("_labels", F.split("bare", r"\."))
    tails = labels.select("bare", F.explode(F.sequence(F.lit(1), F.size("_labels"))).alias("size"), "_labels")
    tail = F.array_join(F.slice("_labels", -F.col("size"), F.col("size")), ".")
    above = F.array_join(F.slice("_labels", 1 - F.col("size"), F.col("size") - 1), ".")
    shapes = F.explode(
        F.array(
            F.struct(tail.alias("rule"), F.col("size").alias("n"), F.lit(0).alias("first")),
            F.struct(F.when(F.col("size") > 1, F.concat(F.lit("*."), above)).alias("rule"), F.col("size").alias("n"), F.lit(0).alias("first")),
            F.struct(F.concat(F.lit("!"), tail).alias("rule"), (F.col("size") - 1).alias("n"), F.lit(1).alias("first")),
        )
    )
    fits = tails.select("bare", shapes.alias("r")).select("bare", "r.*").join(suffixes.select("rule").distinct(), "rule")
    return fits.groupBy("bare").agg(F.max(F.struct("first", "n"))["n"].alias("size"))


def with_domain(df: DataFrame, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES, suffixes: DataFrame | None = None) -> DataFrame:
    """Add the registered domain and the suffix of `host`, without user and port."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("host", r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    own = df.withColumn("bare", bare)
    ip = F.col("bare").rlike(r"^[0-9.]+$|\]$")
    if suffixes is None:
        last2 = F.substring_index("bare", ".", -2)
        own = own.withColumn("size", F.when(last2.isin(*two_labels), 2).otherwise(1))
    else:
        own = own.join(suffix_sizes(own, suffixes), "bare", "left")
    domain = F.when(ip, F.col("bare")).otherwise(F.expr("substring_index(bare, '.', -coalesce(size, 1) - 1)"))
    suffix = F.when(ip | ~F.contains(F.col("domain"), F.lit(".")), F.lit("")).otherwise(F.expr("substring_index(domain, '.', -coalesce(size, 1))"))
    return own.withColumn("domain", domain).withColumn("suffix", suffix).drop("bare", "size")


def strength(level: DataFrame) -> Column:
    """How many pages the prior of *level* (n, k, m: the parent's mean) is worth: a scalar subquery."""
    sums = level.filter("n > 0").agg(
        F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("m")) * (F.col("k") / F.col("n") - F.col("m"))).alias("s"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("v"),
        F.sum("n").cast("double").alias("pages"),
        F.count("*").cast("double").alias("members"),
    )
    rho = F.expr("(s / (v / pages) - members) / (pages - members)")
    kappa = F.when(F.expr("pages > members AND v > 0") & (rho > 0), 1 / rho - 1).otherwise(F.lit(MOST_STRENGTH))
    bounded = F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), kappa))
    return F.coalesce(sums.select(F.round(bounded, 6)).scalar(), F.lit(MOST_STRENGTH))


def reputations(outcomes: DataFrame, z: float = 1.0, factor: float = 1.0, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, k, mean, bound, verdict) from *outcomes* (host, bad: 1, 0 or null)."""
    hosts = materialize(
        with_domain(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k")), suffixes=suffixes),
        "hosts",
    )
    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    all_pages = hosts.agg(F.expr("(sum(k) + 0.5D) / (sum(n) + 1)").alias("m"))
    shrunk = F.expr("(k + kappa * m) / (n + kappa)")

    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("m", all_pages.scalar())
    suffixes = suffixes.withColumn("kappa", strength(suffixes)).select("suffix", shrunk.alias("m"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = domains.withColumn("kappa", strength(domains)).select("domain", "suffix", shrunk.alias("m"))
    scored = hosts.join(domains, ["domain", "suffix"])
    a, b = F.col("k") + F.col("kappa") * F.col("m"), F.col("n") - F.col("k") + F.col("kappa") * (1 - F.col("m"))
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    worse = F.round("bound", 9) > F.round(factor * all_pages.scalar(), 9)
    return (
        scored.withColumn("kappa", strength(scored))
        .select("host", "n", "k", mean.alias("mean"), (mean - z * sd).alias("bound"))
        .withColumn("verdict", F.when(worse, "block").otherwise("allow"))
    )


def outcomes(parsed: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of *parsed* (page_id, host): 1 for a page of quality 0 or toxic 1, 0 for another labelled one, else null."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    known = (
        labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max(bad).alias("bad"))
    )
    return parsed.select("page_id", "host").join(known, "page_id", "left").select("host", "bad")


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], z: float = 1.0, factor: float = 1.0, suffixes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of *pages* (page_id, url).

    *labels* (doc_id, quality, toxic) hold outcomes of pages by doc_id = page_id.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = reputations(outcomes(parsed, labels), z, factor, suffixes)
    verdicts = materialize(found.select("host", F.col("verdict").alias("by_host")), "verdicts")
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    return parsed.join(verdicts, "host", "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(action, F.col("by_host")).alias("verdict"))


def keep_allowed(
    pages: DataFrame, labels: DataFrame, rules: list[Rule] | None = None, z: float = 1.0, factor: float = 1.0, suffixes: DataFrame | None = None
) -> DataFrame:
    """*pages*, whole, without the rows whose url is blocked."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"))
    found = reputations(outcomes(parsed, labels), z, factor, suffixes).filter("verdict = 'block'")
    blocked = materialize(found.select("host"), "blocked").withColumn("blocked", F.lit(True))
    rows = pages.select(F.struct(*[F.col(c) for c in pages.columns]).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    _, action = rule_of(F.col("host"), F.col("path"), rules or [])
    verdict = F.coalesce(action, F.when(F.col("blocked"), "block"), F.lit("allow"))
    return rows.join(blocked, "host", "left").filter(verdict == "allow").select("row.*")

"""URL filters: fixed rules first, then an empirical-Bayes host reputation.

Rules name a host and a path prefix and fit that host with all its subdomains; the longest that fits decides. Pages that
no rule decides are judged by their host's reputation: labelled outcomes (bad or not) are counted per host and shrunk
through beta-binomial priors from the whole table to the public suffix, from the suffix to the registered domain and from
the domain to the host; what a group has is its prior for a member without that member's own outcomes, so that each
outcome counts once. The strength of each prior comes from the counts themselves (method of moments). A page is
blocked where the lower posterior bound of its host's bad rate exceeds a limit: the overall rate plus MARGIN, so that a host has to be worse than
all for certain and not only in its draw of outcomes, and MOST_BAD at most, so that a table which is bad as a whole does not pass. ``margin`` and
``max_bad`` set both. A host without outcomes has the mean of its domain (else of its suffix, else the overall one) at the strength of a host's prior.

Registered domains follow a rule, or a table of public suffixes where one is given.

Only DataFrame functions. Counts are combined before they are shuffled (host, then domain, then suffix from the host
counts), so a host that holds a third of all pages costs one row per task; pages meet the posteriors in left joins
whose large partitions Spark can split. A row per level is collected.

Defined results: a url that is null or has no ``://`` has empty host and path, fits no rule and is judged by the overall
rate; repeated pages are judged each on its own and each counts as an outcome; a label given twice counts as bad if one
is; without labels nothing is blocked but by rule; columns besides id and url are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.scratch import saved, values

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
BROADCAST_RULES = 10_000
#: A prior counts for a hundred outcomes at most, so that what a host does itself is seen.
MARGIN, MOST_BAD, Z, STRENGTH = 0.05, 0.5, 1.645, (1.0, 100.0)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domains(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix, by rule: one label, or two under country codes (``co.uk``)."""
    name = F.regexp_replace(host, r":\d*$", "")
    second = "|".join(SECOND_LEVEL)
    suffix = F.regexp_extract(name, rf"((?:(?:{second})\.[a-z]{{2}}|[^.]*))$", 1)
    suffix = F.when(name.rlike(r"^[\d.]+$"), name).otherwise(suffix)
    domain = F.regexp_extract(name, rf"([^.]+\.(?:(?:{second})\.[a-z]{{2}}|[^.]*))$", 1)
    return F.when((domain == "") | name.rlike(r"^[\d.]+$"), name).otherwise(domain), suffix


def best_rule(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """pages (with host and path) and _best, the longest fitting rule as struct(size, rule, action), or null.

    One join per number of labels that rule hosts have; each page has one partner in each at most. Rules of one length:
    the larger string, then block before allow.
    """
    by_labels: dict[int, list[tuple[str, str, str, str]]] = {}
    for action, rule in rules:
        host, slash, path = rule.partition("/")
        by_labels.setdefault(host.count(".") + 1, []).append((host, slash + path, rule, action))
    found = []
    labels = F.split("host", r"\.")
    for n, own in sorted(by_labels.items()):
        side = values(pages.sparkSession, own, "_rule_host string, prefix string, rule string, action string")
        side = side.groupBy("_rule_host").agg(F.collect_list(F.struct("prefix", "rule", "action")).alias(f"_rules{n}"))
        side = F.broadcast(side) if len(own) <= BROADCAST_RULES else side
        tail = F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.size(labels) - F.lit(n - 1), F.lit(n)), "."))
        pages = pages.withColumn(f"_tail{n}", tail)
        pages = pages.join(side, pages[f"_tail{n}"] == side["_rule_host"], "left").drop("_rule_host", f"_tail{n}")
        found.append(f"_rules{n}")
    if not found:
        return pages.withColumn("_best", F.lit(None).cast("struct<size:int,rule:string,action:string>"))
    empty = F.array().cast("array<struct<prefix:string,rule:string,action:string>>")
    fitting = F.filter(F.concat(*[F.coalesce(F.col(c), empty) for c in found]), lambda r: F.startswith(F.col("path"), r["prefix"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["action"].alias("action"))))
    return pages.withColumn("_best", best).drop(*found)


def domains_by(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (host) with domain and suffix by a table of public suffixes (suffix): the longest that ends a host, and one label more.

    A host that no suffix ends has its last label for one; addresses of digits are their own domain and suffix.
    """
    name = F.regexp_replace("host", r":\d*$", "")
    labels = F.split(name, r"\.")
    places = F.sequence(F.lit(1), F.size(labels))
    tails = hosts.select("host", name.alias("_name"), labels.alias("_labels"), F.explode(places).alias("_n")).withColumn("suffix", F.array_join(F.slice("_labels", F.size("_labels") - F.col("_n") + 1, F.col("_n")), "."))
    found = tails.join(suffixes.select(F.lower("suffix").alias("suffix")).distinct().withColumn("_known", F.lit(True)), "suffix", "left")
    best = found.groupBy("host").agg(F.first("_name").alias("_name"), F.first("_labels").alias("_labels"), F.coalesce(F.max(F.when(F.col("_known"), F.col("_n"))), F.lit(1)).alias("_n"))
    tail = lambda n: F.array_join(F.slice("_labels", F.greatest(F.size("_labels") - n + 1, F.lit(1)), n), ".")
    digits = F.col("_name").rlike(r"^[\d.]+$")
    return best.select("host", F.when(digits, F.col("_name")).otherwise(tail(F.col("_n") + 1)).alias("domain"), F.when(digits, F.col("_name")).otherwise(tail(F.col("_n"))).alias("suffix"))


def with_domains(rows: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """rows (host) with domain and suffix."""
    if suffixes is None:
        domain, suffix = domains(F.col("host"))
        return rows.withColumns({"domain": domain, "suffix": suffix})
    return rows.join(domains_by(rows.select("host").distinct(), suffixes), "host", "left")


def _strengths(levels: dict[str, DataFrame]) -> tuple[float, dict[str, float]]:
    """The overall mean, and each level's prior strength by the method of moments, within STRENGTH."""
    rows = None
    for name, counts in levels.items():
        own = counts.select(F.lit(name).alias("level"), "n", "k")
        rows = own if rows is None else rows.unionByName(own)
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    sums = {r["level"]: r for r in rows.groupBy("level").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(k * k / n).alias("kk")).collect()}
    total = sums.get("suffix")
    mean = ((total["k"] if total else 0) + 1) / ((total["n"] if total else 0) + 10)
    low, high = STRENGTH
    out = {}
    for level in levels:
        one = sums.get(level)
        if not one or one["groups"] < 2:
            out[level] = high
            continue
        between = (one["kk"] - 2 * mean * one["k"] + mean * mean * one["n"]) / one["n"]
        noise = mean * (1 - mean)
        over = between - noise / (one["n"] / one["groups"])
        out[level] = high if over <= 0 else min(high, max(low, (noise - between) / over))
    return mean, out


def reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Posteriors from outcomes (host, bad): level (host, domain, suffix or all), name, a, b.

    Those of domains, suffixes and all are what a host there has that has no outcomes.
    """
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
    hosts = saved(with_domains(hosts, suffixes), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    by_domain = saved(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    by_suffix = by_domain.groupBy("suffix").agg(*sums)
    mean, strength = _strengths({"host": hosts, "domain": by_domain, "suffix": by_suffix})
    m_suffix, m_domain, m_host = (strength[x] for x in ("suffix", "domain", "host"))

    def shrunk(k: Column, n: Column, m: float, prior: Column) -> Column:
        return (k + F.lit(m) * prior) / (n + F.lit(m))

    sums = lambda df, x: df.withColumnsRenamed({"n": f"n{x}", "k": f"k{x}"})
    s = sums(by_suffix, "s").withColumn("rate", shrunk(F.col("ks"), F.col("ns"), m_suffix, F.lit(mean)))
    # a group's prior is what the group above has besides it
    d = sums(by_domain, "d").join(sums(by_suffix, "s"), "suffix").withColumn("prior", shrunk(F.col("ks") - F.col("kd"), F.col("ns") - F.col("nd"), m_suffix, F.lit(mean)))
    d = d.withColumn("rate", shrunk(F.col("kd"), F.col("nd"), m_domain, F.col("prior")))
    h = sums(hosts, "h").join(d, ["domain", "suffix"]).withColumn("host_prior", shrunk(F.col("kd") - F.col("kh"), F.col("nd") - F.col("nh"), m_domain, F.col("prior")))
    h = h.withColumn("rate", shrunk(F.col("kh"), F.col("nh"), m_host, F.col("host_prior")))
    everything = outcomes.sparkSession.range(1).select(F.lit("").alias("all"), F.lit(mean).alias("rate"), F.lit(0).alias("nh"))
    none = F.lit(0)
    rows = None
    for level, part, n in (("host", h, F.col("nh")), ("domain", d, none), ("suffix", s, none), ("all", everything, none)):
        size = n + F.lit(m_host)
        own = part.select(F.lit(level).alias("level"), F.col(level).alias("name"), (F.col("rate") * size).alias("a"), ((1 - F.col("rate")) * size).alias("b"))
        rows = own if rows is None else rows.unionByName(own)
    return saved(rows, "reputation")


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    """Lower bound of a beta posterior by its normal approximation."""
    rate = a / (a + b)
    return rate - F.lit(z) * F.sqrt(rate * (1 - rate) / (a + b + 1))


def limit(mean: float, margin: float = MARGIN, max_bad: float = MOST_BAD) -> float:
    """What a host's lower bound has to exceed where so large a share of all outcomes is bad."""
    return min(max_bad, mean + margin)


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], max_bad: float = MOST_BAD, suffixes: DataFrame | None = None, margin: float = MARGIN
) -> DataFrame:
    """page_id, host, path, rule, verdict and p_bad_low of every row of pages (page_id, url).

    outcomes: (host, bad), bad 0 or 1. suffixes: (suffix), public suffixes of one label or more.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = with_domains(best_rule(rows, rules), suffixes).withColumnsRenamed({"domain": "_domain", "suffix": "_suffix"})
    known = reputation(outcomes, suffixes)
    for level, key in (("host", "host"), ("domain", "_domain"), ("suffix", "_suffix")):
        side = known.filter(F.col("level") == level).select("name", lower_bound(F.col("a"), F.col("b")).alias(f"_{level}_low"))
        rows = rows.join(side, rows[key] == side["name"], "left").drop("name")
    overall, mean = known.filter("level = 'all'").select(lower_bound(F.col("a"), F.col("b")), F.col("a") / (F.col("a") + F.col("b"))).first()
    low = F.coalesce("_host_low", "_domain_low", "_suffix_low", F.lit(overall))
    most = limit(mean, margin, max_bad)
    verdict = F.coalesce(F.col("_best.action"), F.when(low > F.lit(most), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"), low.alias("p_bad_low"))

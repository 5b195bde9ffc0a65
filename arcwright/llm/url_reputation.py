"""URL filtering by rules and by empirical-Bayes host reputation.

Labelled pages are counted by host, hosts summed to registered domains, those to suffixes, and those to all.
Each level's bad rate is shrunk towards the level above by a beta prior whose strength is a method-of-moments
estimate from how much the rates of that level's members vary about their parents': suffix towards the whole,
domain towards its suffix, host towards its domain.  A host is blocked if even the lower bound of its posterior (a
beta quantile) exceeds the rate of all pages, or a multiple of it.  Hosts without labelled pages inherit the level
above.  A rule that fits decides before the method.  Reputation goes by the host without user and port.

All of it is DataFrame operations: pages are counted by host before any shuffle, and the verdict joins the page
to its host's row, both read from tables, so that a host with many pages may be split.

Defined results: null URLs and URLs without ``://`` have an empty host and path, match no rule and are judged
as the host ""; an empty table gives an empty result; repeated rows and null ids are judged alike; extra
columns are ignored; without any label nothing but rules blocks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, only, spool


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def spelt(self) -> str:
        return f"{self.host}{self.path}"


#: The rules of the query (fixed values).
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


#: Public suffixes of several labels that are in wide use; a parameter, as lists change.
SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
_ADDRESS = r"^[0-9]+(\.[0-9]+){3}$"


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3, F.length(url)))
    return lower_ascii(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _ordered(rules: tuple[UrlRule, ...]) -> list[UrlRule]:
    return sorted(rules, key=lambda r: (-len(r.spelt), r.spelt))


def matched(host: Column, path: Column, rules: tuple[UrlRule, ...], value) -> Column:
    """``value`` of the longest rule that fits, else null; the rules are few and part of the plan."""
    out = F.lit(None).cast("string")
    for r in reversed(_ordered(rules)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def _site(host: Column) -> Column:
    """The host as reputation counts it: without user, port and final dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+$", "")


def _last(suffixes: tuple[str, ...]) -> str:
    return "|".join([*(re.escape(x) for x in suffixes), "[^.]+"])


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The longest listed suffix, else the last label; empty for an IPv4 address."""
    return F.when(host.rlike(_ADDRESS), F.lit("")).otherwise(F.regexp_extract(host, rf"(?:^|\.)({_last(suffixes)})$", 1))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it; a host without such a label and an address are their own."""
    found = F.regexp_extract(host, rf"(?:^|\.)([^.]+\.(?:{_last(suffixes)}))$", 1)
    return F.when(host.rlike(_ADDRESS) | (found == ""), host).otherwise(found)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once: lambdas would compute it for every item that they see."""
    return F.get(F.transform(F.array(value), use), 0)


def beta_quantile(a: Column, b: Column, share: float, points: int = 512) -> Column:
    """The ``share`` quantile of a beta distribution, by the trapezoid rule over the log odds, where its density is smooth and log-concave."""
    soft = lambda u: F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u)))
    peak, spread = F.log(a / b), F.sqrt((a + b) / (a * b))
    low, high = peak - 12 * F.greatest(spread, 1 / a), peak + 12 * F.greatest(spread, 1 / b)
    grid = F.struct(a.alias("a"), (a + b).alias("n"), peak.alias("peak"), soft(peak).alias("top"), low.alias("low"), ((high - low) / points).alias("step"))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("found"))

    def height(g: Column, k: Column) -> Column:
        u = g["low"] + g["step"] * k
        return F.exp(g["a"] * (u - g["peak"]) - g["n"] * (soft(u) - g["top"]))

    def crossed(heights: Column, goal: Column) -> Column:
        """Where the running sum reaches the goal, in steps."""

        def add(s: Column, x: Column) -> Column:
            here = F.when(s["found"].isNull() & (s["sum"] + x >= goal), s["at"] - 0.5 + (goal - s["sum"]) / x)
            return F.struct((s["sum"] + x).alias("sum"), (s["at"] + 1.0).alias("at"), F.coalesce(s["found"], here).alias("found"))

        return F.aggregate(heights, zero, add)["found"]

    def found(g: Column) -> Column:
        heights = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda k: height(g, k))
        place = _once(heights, lambda h: _once(F.lit(share) * F.aggregate(h, F.lit(0.0), lambda s, x: s + x), lambda goal: crossed(h, goal)))
        return 1 / (1 + F.exp(-(g["low"] + g["step"] * place)))

    return F.when(a <= 0, 0.0).when(b <= 0, 1.0).otherwise(_once(grid, found))


def _strength(members: DataFrame, least: float, most: float) -> float:
    """The strength of the beta prior that fits how the members' rates (n, bad) vary about their parents' (``up``).

    The squared deviations, n-fold, are expected to sum to up (1 - up) (1 + (n - 1) / (strength + 1)) over the members.
    """
    n, up = F.col("n").cast("double"), F.col("up")
    got = members.where("n > 0").agg(F.sum(n * F.pow(F.col("bad") / n - up, 2)).alias("seen"), F.sum(up * (1 - up)).alias("chance"), F.sum(up * (1 - up) * (n - 1)).alias("shared")).first()
    if not got["shared"] or got["seen"] <= got["chance"]:
        return most  # no more than chance varies
    return min(max(got["shared"] / (got["seen"] - got["chance"]) - 1, least), most)


def reputation(pages: DataFrame, outcomes: DataFrame, *, confidence: float = 0.9, suffixes: tuple[str, ...] = SUFFIXES, least: float = 2.0, most: float = 200.0) -> DataFrame:
    """site, n, bad, rate (posterior mean), bound (what the bad rate exceeds with probability ``confidence``) and whole (the rate of all) of every site in ``pages``.

    ``outcomes`` has page_id and bad (1 or 0), one row a page.  Prior strengths lie between ``least`` and ``most``.
    """
    seen = only(pages, "page_id", "url").select("page_id", _site(host_of(F.col("url"))).alias("site"))
    labelled = seen.join(outcomes.select("page_id", "bad"), "page_id", "left")
    counted = labelled.groupBy("site").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    sites = spool(counted.select("site", domain_of(F.col("site"), suffixes).alias("domain"), suffix_of(F.col("site"), suffixes).alias("suffix"), "n", "bad"), "sites")
    domains = spool(sites.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    ends = spool(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    whole = ends.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("mean")).first()["mean"]  # one number

    def placed(members: DataFrame) -> DataFrame:
        """Adds the posterior's a and b about the parent's rate ``up``."""
        strength = _strength(members, least, most)
        return members.withColumn("a", F.col("up") * strength + F.col("bad")).withColumn("b", (1 - F.col("up")) * strength + F.col("n") - F.col("bad"))

    rate = F.col("a") / (F.col("a") + F.col("b"))
    up = spool(placed(ends.withColumn("up", F.lit(whole))).select("suffix", rate.alias("up")), "suffix-rates")
    up = spool(placed(domains.join(up, "suffix")).select("domain", rate.alias("up")), "domain-rates")
    out = spool(placed(sites.join(up, "domain")).select("site", "n", "bad", "a", "b"), "site-rates")
    return out.select("site", "n", "bad", rate.alias("rate"), beta_quantile(F.col("a"), F.col("b"), 1 - confidence).alias("bound"), F.lit(whole).alias("whole"))


def judge(pages: DataFrame, outcomes: DataFrame, *, rules: tuple[UrlRule, ...] = RULES, ratio: float = 1.0, **how) -> DataFrame:
    """page_id, host, path, rule and verdict of every page: the longest rule's, else block if the site's bound exceeds ``ratio`` times the rate of all pages."""
    sites = spool(reputation(pages, outcomes, **how).where(F.col("bound") > ratio * F.col("whole")).select("site", F.lit(True).alias("poor")), "poor-sites")
    out = ruled(pages, rules).withColumn("site", _site(F.col("host"))).join(sites, "site", "left")
    by_rule = matched(F.col("host"), F.col("path"), rules, lambda r: r.verdict)
    verdict = F.coalesce(by_rule, F.when(F.col("poor"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def ruled(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path and the longest rule that fits, of every page."""
    out = only(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return out.withColumn("rule", matched(F.col("host"), F.col("path"), rules, lambda r: r.spelt))


def outcomes_from_labels(labels: DataFrame) -> DataFrame:
    """page_id, bad: a labelled page is bad if its quality is 0 or it is toxic; pages carry their document's id."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return only(labels, "doc_id", "quality", "toxic").where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad).alias("bad"))

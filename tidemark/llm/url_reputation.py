"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (good or bad) are counted per host, registered domain and public suffix.
At each level a beta prior with the parent's posterior mean is given; its strength comes from the
spread of the children's rates (method of moments), so that noisy levels are shrunk more. A host is
blocked when its posterior's lower bound at `confidence` is above `block_above`, that is when the beta
posterior puts at least that much probability above it; the tail is the regularised incomplete beta
function, by its continued fraction. Explicit rules of host suffix and path prefix come first; the
longest that fits wins. Outcomes may be given; without, the pages that a rule fits are the labelled
ones, so that a host's other pages, its subdomains and sister hosts are judged by how the rules judged it.

The suffix is a host's last label, or its last two where the last has two letters and the one before is
a customary second level (co.uk, com.au, ac.jp); the registered domain is one label more. An IPv4 address
or a bracketed IPv6 one is its own domain and suffix. User names and ports don't count. There is no list
of privately run suffixes (github.io is a domain).

Edge cases: null urls, or ones without ``://``, have an empty host and path, fit no rule, and are
judged by the global rate. Hosts without labelled pages take their domain's posterior. Given outcomes
join by id; several of a page count each. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: (rule host, path prefix, verdict)
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def bare_host(host: Column) -> Column:
    """Without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


_ADDRESS = r"^([0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*)$"
_SECOND = r"(?:ac|co|com|edu|go|gob|gouv|gov|mil|ne|net|nom|or|org|sch)"


def suffix(host: Column) -> Column:
    bare = bare_host(host)
    two = F.regexp_extract(bare, rf"(?:^|\.)({_SECOND}\.[a-z]{{2}})$", 1)
    last = F.regexp_extract(bare, r"([^.]*)$", 1)
    return F.when(bare.rlike(_ADDRESS), bare).when((two != "") & (two != bare), two).otherwise(last)


def registered_domain(host: Column) -> Column:
    """The suffix and one label more, or the whole host if it has no more."""
    bare, end = bare_host(host), suffix(host)
    before = F.substring(bare, F.lit(1), F.length(bare) - F.length(end) - 1)
    return F.when(end == bare, bare).otherwise(F.concat(F.regexp_extract(before, r"([^.]*)$", 1), F.lit("."), end))


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8 and the recurrence down; for x > 0."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5))
    below = x
    for i in range(1, 8):
        below = below * (x + i)
    return series - F.log(below)


def beta_tail(a: Column, b: Column, x: float, terms: int = 300) -> Column:
    """The probability that a beta variable of a, b (columns of one table) is above x."""

    def fraction(a: Column, b: Column, x: float) -> Column:
        tiny = lambda v: F.when(F.abs(v) < 1e-30, 1e-30).otherwise(v)
        d0 = 1 / tiny(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def step(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            for coefficient in (even, odd):
                d, c = 1 / tiny(1 + coefficient * s["d"]), tiny(1 + coefficient / s["c"])
                s = F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))
            return s

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda i: i.cast("double")), start, step, lambda s: s["h"])

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * math.log(x) + b * math.log(1 - x))
    below = F.when(F.lit(x) < (a + 1) / (a + b + 2), front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)
    return F.greatest(F.least(1 - below, F.lit(1.0)), F.lit(0.0))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, else nulls. Ties: the rule given first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _strength(counts: DataFrame, parent_rate: str, cap: float) -> Column:
    """Method-of-moments prior strength of a level's children around their parents' rates: one number."""
    n, p = F.col("n").cast("double"), F.col(parent_rate)
    gap = F.sum(n * F.pow(F.col("bad") / n - p, 2)) / F.sum(n)
    noise = F.count("n") * F.avg(p * (1 - p)) / F.sum(n)
    spread = F.greatest(gap - noise, F.lit(1e-9))
    found = counts.filter("n > 0").agg((F.avg(p * (1 - p)) / spread - 1).alias("k")).first()["k"]
    return F.lit(min(max(found, 1.0), cap) if found is not None else 1.0)


def reputation(outcomes: DataFrame, above: float = 0.5, max_strength: float = 1000.0) -> DataFrame:
    """host, n, bad, rate and tail (posterior probability of a rate over `above`) for each host of outcomes(host, bad 0/1 or null if unlabelled).

    The pages are counted per host before they shuffle; the rest works on the written host counts,
    of which single numbers (the global rate, a strength per level) reach the driver.
    """
    out = written(
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
        .select("host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "bad"),
        "url",
    )
    top = out.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    out, parent = out.withColumn("p0", F.lit((top["bad"] + 0.5) / (top["n"] + 1.0))), "p0"
    for level in ("suffix", "domain"):
        counts = out.groupBy(level).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max(parent).alias(parent))
        k = _strength(counts, parent, max_strength)
        post = counts.select(level, ((F.col("bad") + k * F.col(parent)) / (F.col("n") + k)).alias(f"p_{level}"))
        out, parent = out.join(post, level), f"p_{level}"
    k = _strength(out, parent, max_strength)
    a, b = F.col("bad") + k * F.col(parent), F.col("n") - F.col("bad") + k * (1 - F.col(parent))
    # Hosts of equal counts and parent rates have one posterior.
    posts = out.select(a.alias("a"), b.alias("b")).distinct().withColumn("tail", beta_tail(F.col("a"), F.col("b"), above))
    known = out.select("host", "n", "bad", a.alias("a"), b.alias("b")).join(posts, ["a", "b"])
    return known.select("host", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"), "tail")


def filter_urls(pages: DataFrame, outcomes: DataFrame | None = None, *, id_col: str, url_col: str, rules: Sequence[Rule], block_above: float = 0.5, confidence: float = 0.95) -> DataFrame:
    """Judge each page: id, host, path, rule, verdict, and the reputation behind it.

    outcomes(id_col, bad): labelled results of some pages; by default the pages that a rule fits.
    """
    parts = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    base = parts.select(id_col, "host", "path", rule.alias("rule"), ruled.alias("_ruled"))
    if outcomes is None:
        labelled = base.select("host", (F.col("_ruled") == "block").cast("int").alias("bad"))
    else:
        bad = outcomes.select(F.col(id_col).alias("_oid"), F.col("bad").cast("int").alias("bad"))
        labelled = base.join(bad, F.col(id_col) == F.col("_oid"), "left").select("host", "bad")
    hosts = reputation(labelled, block_above)
    by_rate = F.when(F.col("tail") >= confidence, "block").otherwise("allow")
    return base.join(hosts, "host", "left").select(id_col, "host", "path", "rule", F.coalesce("_ruled", by_rate).alias("verdict"), F.col("n").alias("host_labelled"), F.col("rate").alias("bad_rate"), F.col("tail").alias("bad_tail"))

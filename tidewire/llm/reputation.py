"""URL filters: explicit host and path rules, then empirical-Bayes host reputation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.common import Scratch

# Fixed rules of the registered query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Public suffixes of several labels under which domains are registered; any other host's suffix is its last label.
#: "*.x" stands for every suffix of one label before x, and "!y.x" for an exception to it, as public lists write them.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.za", "co.in", "com.mx")
#: Words by which a page tells that it sells or tracks rather than informs.
BAD_WORDS = ("adult", "ads", "bets", "casino", "pills", "poker", "porn", "spam", "viagra")
#: Least and greatest weight of a prior, in pages.
WEIGHTS = (2.0, 200.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def bare_host(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def _levels(host: Column, suffixes: tuple[str, ...], more: int) -> Column:
    """The host's public suffix and `more` labels before it; an address in digits or brackets, or a host of fewer labels, whole."""
    bare = bare_host(host)
    last = lambda n: F.substring_index(bare, ".", -n)
    out, taken = last(1 + more), F.lit(False)
    for n in sorted({s.lstrip("!").count(".") + 1 for s in suffixes}, reverse=True):
        plain = [s for s in suffixes if s[0] not in "*!" and s.count(".") == n - 1]
        wild = [s[2:] for s in suffixes if s.startswith("*.") and s.count(".") == n - 1]
        apart = [s[1:] for s in suffixes if s.startswith("!") and s.count(".") == n - 1]
        fits = last(n).isin(*plain) | (F.substring_index(bare, ".", -(n - 1)).isin(*wild) & ~last(n).isin(*apart))
        out = F.when(~taken & fits, last(n + more)).otherwise(out)
        taken = taken | fits | last(n).isin(*apart)
    return F.when(bare.rlike(r"^[0-9.]+$|^\["), bare).otherwise(out)


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    return _levels(host, suffixes, 0)


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    return _levels(host, suffixes, 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, spelled host + path, and its verdict; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


_ln_gamma = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    if not len(a):
        return np.zeros(0)
    if not 0 < x < 1:
        return np.full(len(a), float(x >= 1))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    fix = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones(len(a)), 1 / fix(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        for term in (even, odd):
            d, c = 1 / fix(1 + term * d), fix(1 + term / c)
            h = h * d * c
        if np.abs(d * c - 1).max() < 1e-13:
            break
    front = np.exp(_ln_gamma(p + q) - _ln_gamma(p) - _ln_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    return np.where(swap, 1 - front * h, front * h)


def _weight(groups: DataFrame, prior: str | float) -> float:
    """The weight of a level's beta prior, by moments: how far the groups' bad counts spread around the prior's mean
    beyond binomial noise. One row comes back, whatever the number of groups."""
    mean = F.lit(prior) if isinstance(prior, float) else F.col(prior)
    noise = mean * (1 - mean)
    rows = groups.where("n > 0").select((F.pow(F.col("bad") - F.col("n") * mean, 2) / F.col("n") - noise).alias("beyond"), (noise * (F.col("n") - 1)).alias("room"))
    got = rows.agg(F.sum("beyond").alias("beyond"), F.sum("room").alias("room")).first()
    if not got.room or got.beyond <= 0:
        return WEIGHTS[1]
    return min(WEIGHTS[1], max(WEIGHTS[0], got.room / got.beyond - 1))


def reputation(outcomes: DataFrame, confidence: float = 0.95, suffixes: tuple[str, ...] = SUFFIXES, at: float | None = None) -> DataFrame:
    """host, n, bad, the posterior's alpha and beta, its mean, and `above`: the probability that the host's bad share
    exceeds `at` (by default 1.5 times the overall share), from a row per host (host, n, bad).

    Each level's prior is a beta around its parent's posterior mean, with a weight of its own: suffixes around the
    overall share, registered domains around their suffix, hosts around their domain. `over` says whether the
    posterior's lower bound exceeds `at`, which it does where `above` exceeds the confidence. Hosts, not pages, are
    shuffled; the totals by domain and suffix are smaller still. Without any outcome the overall share is a half.
    """
    host = F.col("host")
    hosts = outcomes.select("host", domain_of(host, suffixes).alias("domain"), suffix_of(host, suffixes).alias("suffix"), "n", "bad")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    mean = (total.bad + 0.5) / (total.n + 1.0)
    limit = min(0.99, 1.5 * mean) if at is None else at
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    shrunk = lambda prior, weight: (F.col("bad") + weight * prior) / (F.col("n") + weight)
    by_suffix = hosts.groupBy("suffix").agg(*sums)
    weight = _weight(by_suffix, mean)
    by_suffix = by_suffix.select("suffix", shrunk(F.lit(mean), F.lit(weight)).alias("suffix_mean"))
    by_domain = hosts.groupBy("domain", "suffix").agg(*sums).join(by_suffix, "suffix")
    weight = _weight(by_domain, "suffix_mean")
    by_domain = by_domain.select("domain", shrunk(F.col("suffix_mean"), F.lit(weight)).alias("domain_mean"))
    joined = hosts.join(by_domain, "domain")
    weight = F.lit(_weight(joined, "domain_mean"))
    alpha, beta = F.col("bad") + weight * F.col("domain_mean"), F.col("n") - F.col("bad") + weight * (1 - F.col("domain_mean"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            above = 1 - beta_cdf(limit, a, b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a / (a + b)), pa.array(above), pa.array(above > confidence)], names=names)

    names = ["host", "n", "bad", "alpha", "beta", "mean", "above", "over"]
    return joined.select("host", "n", "bad", alpha.cast("double").alias("alpha"), beta.cast("double").alias("beta")).mapInArrow(
        bound, "host string, n long, bad long, alpha double, beta double, mean double, above double, over boolean"
    )


def page_outcomes(pages: DataFrame, key: str = "page_id", html: str = "html", words: tuple[str, ...] = BAD_WORDS) -> DataFrame:
    """key and `bad` of every page that has html: 1 if any of the words stands in its text, whole and in either case, else 0.

    The text is what is left without scripts, styles and tags; a page's address plays no part. Pages without html have no
    outcome.
    """
    text = F.regexp_replace(F.lower(F.col(html)), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    told = text.rlike("(^|[^a-z])(" + "|".join(words) + ")([^a-z]|$)")
    return pages.where(F.col(html).isNotNull()).select(key, told.cast("int").alias("bad"))


def url_filter(
    pages: DataFrame, outcomes: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES,
    confidence: float = 0.95, at: float | None = None, suffixes: tuple[str, ...] = SUFFIXES,
) -> DataFrame:
    """key, host, path, rule and verdict of every page, a row per row.

    `outcomes` has a row per labelled page: key and `bad` (1 or 0; of repeated labels the worst counts, labels without a
    key or a value count for nothing). A page that no rule fits is blocked if the lower posterior bound of its
    host's bad share exceeds `at` (see `reputation`). A null url, or one without "://", has an empty host and path,
    and is judged like a host of that name. Repeated pages count each and come back each; a page without a key has
    no outcome; an empty table gives an empty result; other columns are ignored, whatever their names. Host
    figures go through a written table, so the join back knows their size: small ones are broadcast, others shuffle
    with skew handling.
    """
    scratch = Scratch(pages.sparkSession)
    seen = pages.select(F.col(key).alias("__key"), host_of(F.col(url)).alias("host"))
    known = outcomes.where("bad in (0, 1)").groupBy(F.col(key).alias("__key")).agg(F.max("bad").alias("bad"))
    per_host = seen.join(known, "__key", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    per_host = scratch.keep(per_host)
    scores = scratch.keep(reputation(per_host, confidence, suffixes, at).select("host", "over"))
    scratch.drop(per_host)
    judged = pages.select(key, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).join(scores, "host", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("over"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))

"""URL filter by host reputation: explicit rules first, else an empirical-Bayes estimate.

Labelled page outcomes (1 good, 0 bad) are counted by host, registered domain and suffix. Each
level's rate is drawn to its parent's through a beta-binomial prior, whose strength is fitted by
the method of moments over that level's members: all pages -> suffix -> domain -> host. A host is
blocked when the upper posterior bound of its good rate is below `least_good`: little evidence
widens the bound, so hosts without labels follow their domain and are kept unless that is bad.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.llm.text import LOWER, UPPER, ascii_lower, table
from cadastre.session import materialize

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DOMAIN, SUFFIX, NUMBER = r"([^.:@]+[.][^.:@]+)(:[0-9]*)?$", r"([^.]+)$", r"/([0-9]+)[^0-9]*$"
WEAKEST, STRONGEST = 1.0, 1000.0  # bounds of a prior's strength, in pages


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _or(c: Column, other: Column) -> Column:
    return F.when(c == "", other).otherwise(c)


def domain_of(host: Column) -> Column:
    """The last two labels; a host of one label is its own domain."""
    return _or(F.regexp_extract(host, DOMAIN, 1), host)


def suffix_of(domain: Column) -> Column:
    return _or(F.regexp_extract(domain, SUFFIX, 1), domain)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (verdict, text) that fits, else NULL. Rules are a list that the caller holds, so literals."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _strength(children: DataFrame, parent: DataFrame | None, key: str | None, whole: tuple[int, int] = (0, 0)) -> float:
    """Beta-binomial prior strength of `children` (n, s) around their parents' rates, by moments; without `parent`, around the rate of `whole` (n, s)."""
    known = children.filter("n > 0")
    if parent is None:
        if not whole[0]:
            return STRONGEST
        both = known.withColumns({"pn": F.lit(whole[0]), "ps": F.lit(whole[1])})
    else:
        both = known.join(parent.select(key, F.col("n").alias("pn"), F.col("s").alias("ps")), key)
    rate = F.col("ps") / F.col("pn")
    spread = rate * (1 - rate)
    row = both.agg(
        F.sum(F.pow(F.col("s") - F.col("n") * rate, F.lit(2.0)) / F.col("n") - spread).alias("over"), F.sum(spread * (F.col("n") - 1)).alias("room")
    ).head()
    over, room = row["over"] or 0.0, row["room"] or 0.0
    if room <= 0 or over <= 0:
        return STRONGEST
    return round(min(STRONGEST, max(WEAKEST, room / over - 1)), 6)


def host_reputation(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url_col: str = "url", good_col: str = "good", z: float = 1.645) -> DataFrame:
    """One row per host of `pages`: host, n, good_rate, good_bound (upper posterior bound).

    `outcomes` (page_id, good 0/1) may cover any part of the pages; of several for one page the least counts, a NULL
    outcome counts as none. Pages without a host share the empty host. No outcomes at all: every bound is 1.
    """
    hosts = pages.select(F.col(page_id).alias("page"), host_of(F.col(url_col)).alias("host"))
    marked = outcomes.select(F.col(page_id).alias("page"), F.col(good_col).cast("long").alias("good")).filter("good is not null").groupBy("page").agg(F.min("good").alias("good"))
    counted = hosts.join(marked, "page").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("s"))
    known = hosts.groupBy("host").agg(F.lit(1).alias("one")).join(counted, "host", "left")
    domain = domain_of(F.col("host"))
    by_host = materialize(known.select("host", domain.alias("domain"), suffix_of(domain).alias("suffix"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "s")]), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("s").alias("s")]
    by_domain = materialize(by_host.groupBy("domain", "suffix").agg(*sums), "domains")
    by_suffix = materialize(by_domain.groupBy("suffix").agg(*sums), "suffixes")
    top = by_suffix.agg(*sums).head()
    root = ((top["s"] or 0) + 1) / ((top["n"] or 0) + 2)
    k1, k2, k3 = _strength(by_suffix, None, None, (top["n"] or 0, top["s"] or 0)), _strength(by_domain, by_suffix, "suffix"), _strength(by_host, by_domain, "domain")
    suffixes = by_suffix.select("suffix", ((F.col("s") + k1 * root) / (F.col("n") + k1)).alias("up"))
    domains = by_domain.join(suffixes, "suffix").select("domain", ((F.col("s") + k2 * F.col("up")) / (F.col("n") + k2)).alias("up"))
    mean = (F.col("s") + k3 * F.col("up")) / (F.col("n") + k3)
    bound = F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k3 + 1))
    out = by_host.join(domains, "domain").select("host", "n", mean.alias("mean"))
    any_label = F.lit(bool(top["n"]))
    return out.select("host", "n", F.round("mean", 6).alias("good_rate"), F.when(any_label, F.round(F.least(bound, F.lit(1.0)), 6)).otherwise(1.0).alias("good_bound"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, page_id: str = "page_id", url_col: str = "url", least_good: float = 0.5
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, good_rate, good_bound.

    A NULL url or one without `://` has an empty host and path, fits no rule and is judged as the empty host.
    Repeated pages are each judged; other columns are ignored.
    """
    reputation = materialize(host_reputation(pages, outcomes, page_id, url_col), "reputation")
    judged = pages.select(F.col(page_id).alias("page"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = judged.join(reputation, "host").withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("good_bound") < least_good, "block").otherwise("allow")
    return judged.select(
        F.col("page").alias(page_id), "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), method).alias("verdict"), "good_rate", "good_bound"
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good): a page's path ends in the number of the document that it shows; that document's quality label is its outcome."""
    number = F.expr(f"try_cast(regexp_extract(path, r'{NUMBER}', 1) as bigint)")
    shown = pages.select("page_id", path_of(F.col("url")).alias("path")).select("page_id", number.alias("doc_id")).filter("doc_id is not null")
    quality = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    return shown.join(quality, "doc_id").select("page_id", "good")


def op1_host_reputation(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))


def _prior(children: str, parent: str, on: str) -> str:
    return f"""SELECT CASE WHEN coalesce(over_sum, 0) <= 0 OR coalesce(room, 0) <= 0 THEN {STRONGEST}
      ELSE round(least({STRONGEST}, greatest({WEAKEST}, room / over_sum - 1)), 6) END AS k FROM (
      SELECT sum(pow(c.s - c.n * (p.s / p.n), 2) / c.n - (p.s / p.n) * (1 - p.s / p.n)) AS over_sum, sum((p.s / p.n) * (1 - p.s / p.n) * (c.n - 1)) AS room
      FROM {children} c JOIN {parent} p ON {on} WHERE c.n > 0)"""


SQL = f"""
WITH parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
marked AS (
  SELECT host, good FROM (SELECT host, TRY_CAST(regexp_extract(path, '{NUMBER}', 1) AS BIGINT) AS doc_id FROM parsed) p
  JOIN (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l USING (doc_id)),
named AS (
  SELECT host, CASE WHEN regexp_extract(host, '{DOMAIN}', 1) = '' THEN host ELSE regexp_extract(host, '{DOMAIN}', 1) END AS domain FROM (SELECT DISTINCT host FROM parsed)),
by_host AS (
  SELECT n.host, n.domain, CASE WHEN regexp_extract(n.domain, '{SUFFIX}', 1) = '' THEN n.domain ELSE regexp_extract(n.domain, '{SUFFIX}', 1) END AS suffix,
    coalesce(m.n, 0)::DOUBLE AS n, coalesce(m.s, 0)::DOUBLE AS s
  FROM named n LEFT JOIN (SELECT host, count(*) AS n, sum(good) AS s FROM marked GROUP BY host) m USING (host)),
by_domain AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s FROM by_host GROUP BY ALL),
by_suffix AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM by_domain GROUP BY ALL),
everything AS (SELECT sum(n) AS n, sum(s) AS s FROM by_suffix),
k1 AS ({_prior("by_suffix", "everything", "true")}),
k2 AS ({_prior("by_domain", "by_suffix", "c.suffix = p.suffix")}),
k3 AS ({_prior("by_host", "by_domain", "c.domain = p.domain")}),
s AS (SELECT suffix, (x.s + k * ((e.s + 1) / (e.n + 2))) / (x.n + k) AS up FROM by_suffix x, k1, everything e),
d AS (SELECT domain, (x.s + k * up) / (x.n + k) AS up FROM by_domain x JOIN s USING (suffix), k2),
h AS (SELECT host, x.n, k, (x.s + k * up) / (x.n + k) AS mean FROM by_host x JOIN d USING (domain), k3),
r AS (SELECT host, round(mean, 6) AS good_rate, CASE WHEN (SELECT n FROM everything) > 0 THEN round(least(mean + 1.645 * sqrt(mean * (1 - mean) / (n + k + 1)), 1.0), 6) ELSE 1.0 END AS good_bound FROM h),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for v, t in RULES)}) t(verdict, rule, name, start)),
found AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM parsed) JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN good_bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, good_rate, good_bound
FROM parsed p JOIN r USING (host) LEFT JOIN found f ON p.page_id = f.page_id AND p.host = f.host AND p.path = f.path
"""

"""URL filters: hand-written rules, else the reputation of the host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEVELS = ("_suffix", "_domain", "_host")  # from the root down
MAX_STRENGTH = 1e6  # prior rows of a level whose groups do not differ at all


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end,
    with A-Z lower-cased; empty without it."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def last_labels(host: Column, count: int) -> Column:
    """The last ``count`` labels of a host, or all it has."""
    return F.substring_index(host, ".", -count)


def _fits(host: Column, path: Column, rule: tuple[str, str]) -> Column:
    rule_host, rule_path = rule
    inside = (host == rule_host) | host.endswith("." + rule_host)
    return inside & path.startswith(rule_path)


def _in_order(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Longest first, then the longer host, then by name."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))


def _strength(between: Column, mean: Column) -> Column:
    """Prior rows of a beta distribution with this mean and variance between groups."""
    plain = F.try_divide(mean * (1 - mean), between) - 1
    return F.least(F.greatest(F.coalesce(plain, F.lit(MAX_STRENGTH)), F.lit(1.0)), F.lit(MAX_STRENGTH))


def _strengths(counts: DataFrame) -> Column:
    """One row per level: the prior strength of its groups, by moments.

    ``counts`` has ``_n`` labelled pages and ``_k`` bad ones per group.
    """
    totals = counts.agg(
        F.sum("_n").alias("n"),
        F.sum("_k").alias("k"),
        F.sum(F.col("_n") * F.col("_n")).alias("nn"),
        F.count(F.lit(1)).alias("g"),
        F.sum(F.col("_k") * F.col("_k") / F.col("_n")).alias("kk"),
    )
    mean = F.try_divide(F.col("k"), F.col("n"))
    spread = F.col("kk") - F.col("n") * mean * mean
    chance = (F.col("g") - 1) * mean * (1 - mean)
    between = F.try_divide(spread - chance, F.col("n") - F.try_divide(F.col("nn"), F.col("n")))
    return totals.select(
        F.coalesce(mean, F.lit(0.0)).alias("_mean"),
        _strength(F.when(between > 0, between), mean).alias("_strength"),
    )


def reputations(hosts: DataFrame, outcomes: DataFrame, z: float) -> DataFrame:
    """``_host``, ``_rate`` (posterior mean share of bad pages), ``_bound`` (its
    lower bound) for every row of ``hosts``.

    ``hosts`` has ``_host``; ``outcomes`` has ``_host`` and ``_bad`` (0 or 1) per
    labelled page.  A suffix is shrunk towards the share of all pages, a
    registered domain towards its suffix and a host towards its domain.  How
    far is estimated per level from how much its groups differ.
    """
    named = settle(
        hosts.select("_host", last_labels(F.col("_host"), 2).alias("_domain"), last_labels(F.col("_host"), 1).alias("_suffix")),
        "hosts",
    )
    counted = settle(
        outcomes.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"), F.sum("_bad").alias("_k")).join(named, "_host"),
        "host_outcomes",
    )
    groups = {c: counted.groupBy(c).agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k")) for c in LEVELS}
    # One row of two numbers per level.
    first = _strengths(groups[LEVELS[0]]).head()
    known = named.select(*LEVELS).distinct().withColumn("_rate", F.lit(float(first["_mean"])))
    for level in LEVELS:
        strength = float(_strengths(groups[level]).head()["_strength"])
        n, k = F.coalesce("_n", F.lit(0)), F.coalesce("_k", F.lit(0))
        known = (
            known.join(groups[level], level, "left")
            .withColumn("_weight", n + F.lit(strength))
            .withColumn("_rate", (k + F.lit(strength) * F.col("_rate")) / F.col("_weight"))
            .drop("_n", "_k")
        )
    deviation = F.sqrt(F.col("_rate") * (1 - F.col("_rate")) / (F.col("_weight") + 1))
    return known.select("_host", "_rate", (F.col("_rate") - F.lit(float(z)) * deviation).alias("_bound"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    max_bad: float = 0.3,
    z: float = 2.0,
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict`` and
    ``bad_rate``.

    ``rules`` are (allow or block, host, path): hand-written, so they become
    one expression.  A rule fits its host and subdomains if the path starts
    with the rule's; the longest wins.  Other pages are blocked if the lower
    posterior bound of their host's share of bad pages is above ``max_bad``.

    ``outcomes`` has ``_host`` and ``_bad`` per labelled page; without any,
    every page without a rule is allowed.  A null url, or one without ``://``,
    has an empty host and path; the empty host is judged like any other.
    Pages of one host are brought together by counts only; the verdict comes
    back by a join that adaptive execution splits for a hot host.
    """
    url = F.col(url_col)
    parts = pages.select(
        F.col(id_col).alias("_id"), host_of(url).alias("_host"), path_of(url).alias("_path")
    )
    known = reputations(parts.select("_host").distinct(), outcomes, z)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("_bound") > max_bad, "block").otherwise("allow")
    for action, rule_host, rule_path in reversed(_in_order(rules)):
        fits = _fits(F.col("_host"), F.col("_path"), (rule_host, rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return parts.join(known, "_host").select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        rule.alias("rule"),
        verdict.alias("verdict"),
        F.round("_rate", 6).alias("bad_rate"),
    )


# -- production parameters and the query --------------------------------------

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MAX_BAD, Z = 0.24, 2.0
# The number in a page's path is the document it was made of.
DOCUMENT = r"^/[^/]*/(\d+)"


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``_host`` and ``_bad`` of every labelled page: a page is bad if its
    document is toxic or of low quality."""
    url = F.col("url")
    number = F.regexp_extract(path_of(url), DOCUMENT, 1).try_cast("bigint")
    numbered = pages.select(host_of(url).alias("_host"), number.alias("_doc"))
    bad = F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"))
    judged = labels.groupBy(F.col("doc_id").alias("_doc")).agg(bad.alias("_bad")).where("_bad is not null")
    return numbered.join(judged, "_doc").select("_host", "_bad")


def op3_url_filters(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    outcomes = page_outcomes(pages, spark.read.parquet(f"{folder}/labels.parquet"))
    return judge(pages, outcomes, RULES, max_bad=MAX_BAD, z=Z)


def _fits_sql(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


def _level_sql(level: str, above: str) -> str:
    groups, rate, strength = f"{level}_groups", f"{level}_rates", f"{level}_strength"
    return f"""
{groups} AS (SELECT {level}, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM counted GROUP BY {level}),
{strength} AS (
  SELECT least(greatest(coalesce(mean * (1 - mean) / CASE WHEN between_groups > 0 THEN between_groups END - 1,
                                 {MAX_STRENGTH!r}), 1.0), {MAX_STRENGTH!r}) AS strength
  FROM (
    SELECT mean, (kk - n * mean * mean - (g - 1) * mean * (1 - mean)) / nullif(n - nn / n, 0) AS between_groups
    FROM (SELECT sum(n) AS n, sum(k) / sum(n) AS mean, sum(n * n) AS nn, count(*) AS g, sum(k * k / n) AS kk
          FROM {groups})
  )
),
{rate} AS (
  SELECT a.* EXCLUDE (rate, weight),
         (coalesce(k, 0) + strength * rate) / (coalesce(n, 0) + strength) AS rate,
         coalesce(n, 0) + strength AS weight
  FROM {above} a LEFT JOIN {groups} USING ({level}) CROSS JOIN {strength}
)"""


def _sql() -> str:
    ordered = _in_order(RULES)
    rule = " ".join(f"WHEN {_fits_sql(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {_fits_sql(h, p)} THEN '{action}'" for action, h, p in ordered)
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '{PARTS}', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path
  FROM pages
),
judged AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL
                     ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
),
outcomes AS (
  SELECT host, bad FROM parts
  JOIN judged ON doc_id = try_cast(nullif(regexp_extract(path, '{DOCUMENT}', 1), '') AS BIGINT)
  WHERE bad IS NOT NULL
),
named AS (
  SELECT DISTINCT host, regexp_extract(host, '([^.]*\\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix
  FROM parts
),
counted AS (
  SELECT host, domain, suffix, count(*) AS n, sum(bad) AS k FROM outcomes JOIN named USING (host) GROUP BY ALL
),
root AS (
  SELECT *, coalesce((SELECT sum(k) / sum(n) FROM counted), 0.0) AS rate, 0.0 AS weight FROM named
),
{_level_sql("suffix", "root")},
{_level_sql("domain", "suffix_rates")},
{_level_sql("host", "domain_rates")}
SELECT page_id, host, path,
       CASE {rule} END AS rule,
       CASE {verdict} WHEN rate - {Z!r} * sqrt(rate * (1 - rate) / (weight + 1)) > {MAX_BAD!r} THEN 'block'
            ELSE 'allow' END AS verdict,
       round(rate, 6) AS bad_rate
FROM parts JOIN host_rates USING (host)
"""


QUERIES = {"op3_url_filters": op3_url_filters}
ORACLE = {"op3_url_filters": _sql()}

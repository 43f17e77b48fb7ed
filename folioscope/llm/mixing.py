"""Mixing sources to target weights: hierarchical budgets, seeded epochs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle


@dataclass(frozen=True)
class Level:
    """One level of the tree: how a row finds its node, and the nodes' weights."""

    node: Column
    weights: Mapping[str, float] = field(default_factory=dict)
    default: float = 1.0


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _weight(column: str, level: Level) -> Column:
    chosen = F.lit(float(level.default))
    for value, weight in level.weights.items():
        chosen = F.when(F.col(column) == value, F.lit(float(weight))).otherwise(chosen)
    return chosen


def _fill(children: DataFrame, parents: Sequence[str], own: str) -> DataFrame:
    """Share ``_budget`` of each parent among its children in proportion to
    ``_weight``, none above ``_capacity``; what a child cannot take goes to its
    siblings.

    Children in order of capacity per weight: as long as a child's capacity is
    below its share of what is left, it is filled.  The share per weight grows
    up to the first child that is not filled and falls after it, so its maximum
    is the share of all others.  Children without weight get nothing.
    """
    by = Window.partitionBy(*parents).orderBy(F.asc_nulls_last("_ratio"), own)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("_budget") - F.coalesce(F.sum("_capacity").over(before), F.lit(0))
    # Only weighted children count as capacity that is used up.
    weighted = children.withColumn(
        "_capacity", F.when(F.col("_weight") > 0, F.col("_capacity")).otherwise(0)
    ).withColumn(
        "_ratio", F.when(F.col("_weight") > 0, F.col("_capacity") / F.col("_weight"))
    )
    share = F.try_divide(left, F.sum("_weight").over(onwards))
    shared = weighted.withColumn("_share", share)
    best = F.max("_share").over(Window.partitionBy(*parents))
    given = F.least(F.col("_capacity").cast("double"), F.col("_weight") * F.greatest(best, F.lit(0.0)))
    return shared.withColumn("_budget", F.coalesce(given, F.lit(0.0))).drop("_share", "_ratio")


def _budgets(leaves: DataFrame, paths: Sequence[str], levels: Sequence[Level], share: float, epochs: int) -> DataFrame:
    """``leaves`` with ``_budget``: from the root down, level by level."""
    sized = leaves.withColumn("_capacity", F.col("_available") * epochs)
    given = sized.agg((F.sum("_available") * F.lit(share)).alias("_budget"))
    root = "_root"
    sized, given = sized.withColumn(root, F.lit(0)), given.withColumn(root, F.lit(0))
    for depth, (path, level) in enumerate(zip(paths, levels)):
        parents = [root, *paths[:depth]]
        nodes = (
            sized.groupBy(*parents, path)
            .agg(F.sum("_capacity").alias("_capacity"))
            .join(given.select(*parents, "_budget"), parents)
            .withColumn("_weight", _weight(path, level))
        )
        given = _fill(nodes, parents, path)
    return sized.drop("_capacity", root).join(given.select(*paths, "_budget"), list(paths))


def plan(
    rows: DataFrame, levels: Sequence[Level], paths: Sequence[str], *, share: float, epochs: int, seed: int
) -> DataFrame:
    """Per leaf: ``_available`` tokens, ``_budget``, whole ``_epochs`` and
    ``_cut``, the last order key taken from the epoch that is begun.

    ``rows`` has ``_id``, ``_tokens`` and the path columns.  The prefix of an
    epoch is found in two steps, so a leaf with any number of rows never meets
    in one task: sums of key ranges first, then the rows of the one range in
    which the budget ends.  The number of ranges is about the root of the
    largest leaf's row count.
    """
    paths = list(paths)
    leaves = settle(
        rows.groupBy(*paths).agg(F.sum("_tokens").alias("_available"), F.count(F.lit(1)).alias("_rows")),
        "leaves",
    )
    largest = leaves.agg(F.max("_rows")).head()[0] or 1
    digits = max(1, math.ceil(math.log(math.sqrt(largest), 16)))
    budget = F.floor(F.col("_budget") + F.lit(1e-6)).cast("bigint")
    planned = _budgets(leaves, paths, levels, share, epochs).withColumn("_budget", budget)
    planned = (
        planned.withColumn("_epochs", F.expr("coalesce(_budget div nullif(_available, 0), 0)"))
        .withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("_available"))
        .drop("_rows")
    )
    planned = settle(planned, "leaf_budgets")
    keyed = (
        rows.join(planned.select(*paths, "_epochs", "_rest"), paths)
        .withColumn("_key", order_key(seed, F.col("_epochs"), F.col("_id")))
        .withColumn("_range", F.substring("_key", 1, digits))
        .select(*paths, "_tokens", "_rest", "_key", "_range")
    )
    sums = keyed.groupBy(*paths, "_range").agg(F.sum("_tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy(*paths).orderBy("_range")
    running = sums.withColumn("_end", F.sum("_sum").over(upto)).withColumn("_start", F.col("_end") - F.col("_sum"))
    # The first range that does not fit whole; leaves that fit whole have none.
    ends = running.where("_end > _rest").groupBy(*paths).agg(
        F.min("_range").alias("_range"), F.min("_start").alias("_start")
    )
    last = keyed.join(ends, [*paths, "_range"])
    so_far = Window.partitionBy(*paths).orderBy("_key")
    taken = (
        last.withColumn("_sum", F.col("_start") + F.sum("_tokens").over(so_far))
        .groupBy(*paths)
        .agg(F.max(F.when(F.col("_sum") <= F.col("_rest"), F.col("_key"))).alias("_last"))
    )
    cuts = ends.join(taken, paths).select(*paths, F.coalesce("_last", "_range").alias("_cut"))
    return settle(planned.join(cuts, paths, "left"), "mixing_plan")


def order_key(seed: int, epoch: Column, row_id: Column) -> Column:
    """Key by which an epoch orders the rows of a leaf."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), row_id.cast("string")))


def mix(
    df: DataFrame,
    levels: Mapping[str, Level],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = 1.0,
    epochs: int = 1,
    seed: int = 1,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: the id, the node of each level, ``n_tokens`` and
    ``copies``, how often the row is taken; ``carry`` in a struct ``carried``.

    The budget is ``share`` of all tokens.  It goes down the tree of
    ``levels`` by weight.  A node can take up to ``epochs`` times its tokens;
    what it cannot take goes to its siblings and only then, through their
    parent, to the parent's siblings.  A leaf takes whole epochs of its rows and
    the prefix of one more, in an order that depends on the seed, the epoch and
    the id only.

    A null text has no tokens, a null node is a node of its own named "".
    Rows that repeat an id share one place in the order and are taken together.
    Rows without tokens are taken when their place in the order is.  An empty
    table gives no rows.
    """
    paths = [f"_path{k}" for k in range(len(levels))]
    carried = [F.col(c).alias(c) for c in carry]
    rows = df.select(
        F.col(id_col).alias("_id"),
        word_count(F.col(text_col)).alias("_tokens"),
        *(F.coalesce(level.node.cast("string"), F.lit("")).alias(p) for p, level in zip(paths, levels.values())),
        (F.struct(*carried) if carried else F.lit(None).cast("boolean")).alias("_carried"),
    )
    chosen = plan(
        rows.drop("_carried"), list(levels.values()), paths, share=share, epochs=epochs, seed=seed
    ).select(*paths, "_epochs", "_rest", "_cut")
    key = order_key(seed, F.col("_epochs"), F.col("_id"))
    # No cut: the whole of the last epoch fits, which happens to empty leaves only.
    more = (F.col("_rest") > 0) & F.coalesce(key <= F.col("_cut"), F.lit(True))
    copies = (F.col("_epochs") + more.cast("bigint")).cast("int")
    out = [
        F.col("_id").alias(id_col),
        *(F.col(p).alias(name) for p, name in zip(paths, levels)),
        F.col("_tokens").alias("n_tokens"),
        copies.alias("copies"),
    ]
    return rows.join(chosen, paths).select(*out, *([F.col("_carried").alias("carried")] if carry else []))


def take(df: DataFrame, levels: Mapping[str, Level], **options) -> DataFrame:
    """The rows of ``df`` with all their columns, each as often as it is taken."""
    mixed = mix(df, levels, carry=df.columns, **options).where("copies > 0")
    repeated = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select(*(F.col("carried").getField(c).alias(c) for c in df.columns))


# -- production parameters and the query --------------------------------------

DOMAINS = {
    "web": ("src0", "src1", "src2", "src3", "src4"),
    "news": ("src5", "src6", "src7", "src8", "src9"),
    "books": ("src10", "src11", "src12", "src13", "src14"),
}
OTHER_DOMAIN = "forum"
DOMAIN_WEIGHTS = {"web": 0.45, "news": 0.2, "books": 0.2, "forum": 0.15}
LANG_WEIGHTS = {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13}
SOURCE_WEIGHTS = {"src0": 10.0}
OTHER_LANG_WEIGHT, OTHER_SOURCE_WEIGHT = 0.05, 1.0
SEED, EPOCHS = 20, 2


def document_levels() -> dict[str, Level]:
    domain = F.lit(OTHER_DOMAIN)
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(*sources), F.lit(name)).otherwise(domain)
    return {
        "domain": Level(domain, DOMAIN_WEIGHTS),
        "lang": Level(F.col("lang"), LANG_WEIGHTS, OTHER_LANG_WEIGHT),
        "source": Level(F.col("source"), SOURCE_WEIGHTS, OTHER_SOURCE_WEIGHT),
    }


def op7_mixing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return mix(docs, document_levels(), epochs=EPOCHS, seed=SEED)


def _case(column: str, values: Mapping[str, float], default: float) -> str:
    arms = " ".join(f"WHEN {column} = '{v}' THEN {float(w)!r}" for v, w in values.items())
    return f"CASE {arms} ELSE {float(default)!r} END::DOUBLE"


def _fill_sql(name: str, source: str, parents: str, own: str) -> str:
    return f"""
{name}_share AS (
  SELECT *, max((budget - coalesce(used, 0)) / onwards) OVER (PARTITION BY {parents}) AS best
  FROM (
    SELECT *,
           sum(capacity) OVER (PARTITION BY {parents} ORDER BY capacity / weight, {own}
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used,
           sum(weight) OVER (PARTITION BY {parents} ORDER BY capacity / weight, {own}
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onwards
    FROM {source}
  )
),
{name} AS (
  SELECT * EXCLUDE (budget, used, onwards, best, weight),
         least(capacity::DOUBLE, weight * greatest(best, 0.0)) AS budget
  FROM {name}_share
)"""


def _domain_sql() -> str:
    arms = " ".join(
        f"WHEN source IN ({', '.join(repr(s) for s in sources)}) THEN '{name}'" for name, sources in DOMAINS.items()
    )
    return f"CASE {arms} ELSE '{OTHER_DOMAIN}' END"


SQL = f"""
WITH counted AS (
  SELECT doc_id, {_domain_sql()} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents
),
leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS available, sum(n_tokens)::BIGINT * {EPOCHS} AS capacity
  FROM counted GROUP BY ALL
),
top AS (
  SELECT 0 AS root, domain, sum(capacity)::BIGINT AS capacity,
         {_case("domain", DOMAIN_WEIGHTS, 1.0)} AS weight,
         (SELECT sum(available)::BIGINT * 1.0::DOUBLE FROM leaves) AS budget
  FROM leaves GROUP BY domain
),
{_fill_sql("domains", "top", "root", "domain")},
middle AS (
  SELECT l.domain, l.lang, sum(l.capacity)::BIGINT AS capacity, any_value(d.budget) AS budget,
         {_case("l.lang", LANG_WEIGHTS, OTHER_LANG_WEIGHT)} AS weight
  FROM leaves l JOIN domains d USING (domain) GROUP BY l.domain, l.lang
),
{_fill_sql("langs", "middle", "domain", "lang")},
bottom AS (
  SELECT l.domain, l.lang, l.source, l.available, l.capacity, g.budget,
         {_case("l.source", SOURCE_WEIGHTS, OTHER_SOURCE_WEIGHT)} AS weight
  FROM leaves l JOIN langs g USING (domain, lang)
),
{_fill_sql("sources", "bottom", "domain, lang", "source")},
planned AS (
  SELECT domain, lang, source, available, floor(budget + 1e-6)::BIGINT AS budget,
         CASE WHEN available > 0 THEN floor(budget + 1e-6)::BIGINT // available ELSE 0 END AS epochs
  FROM sources
),
ordered AS (
  SELECT c.*, p.epochs, CASE WHEN available > 0 THEN p.budget - p.epochs * p.available ELSE 0 END AS rest,
         md5(concat_ws(':', '{SEED}', p.epochs::VARCHAR, c.doc_id::VARCHAR)) AS k
  FROM counted c JOIN planned p USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens,
       (epochs + (rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) <= rest)::INT
       )::INTEGER AS copies
FROM ordered
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLE = {"op7_mixing": SQL}

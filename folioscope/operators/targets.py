"""Target documents: finding the one a query names, and filtering hits by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import file_name, strip
from ..session import settle, spread
from .ordered import top_k

QUOTED = r'@"([^"]+)"'
GRAM = 3  # characters of the pieces that keys are filed under
MENTION = r'@(?:"([^"]+)"|([\p{L}\p{N}_.\-]+))'


def extract_mentions(
    queries: DataFrame, query: str = "query", doc_filter: str | None = None
) -> DataFrame:
    """Add ``doc_filter`` from the first ``@`` mention and drop mentions.

    A filter given in column ``doc_filter`` wins and leaves the query alone; a
    query that holds nothing but mentions stays as it is.
    """
    text = F.col(query)
    given = F.col(doc_filter) if doc_filter else F.lit(None).cast("string")
    given = F.when(given != "", given)
    found = F.coalesce(
        F.nullif(F.regexp_extract(text, MENTION, 1), F.lit("")),
        F.nullif(F.regexp_extract(text, MENTION, 2), F.lit("")),
    )
    rest = strip(F.regexp_replace(text, MENTION, ""))
    asked = F.when(
        given.isNull() & found.isNotNull() & (rest != ""), rest
    ).otherwise(text)
    kept = [c for c in queries.columns if c not in (query, doc_filter, "doc_filter")]
    return queries.select(
        *kept, asked.alias(query), F.coalesce(given, found).alias("doc_filter")
    )


def _plain_file(path: Column) -> Column:
    return F.regexp_replace(
        F.lower(file_name(F.coalesce(path, F.lit("")))), r"\.pdf", ""
    )


def _plain_organization(name: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[).]", ""))


def _first_by_key(keys: DataFrame) -> DataFrame:
    return keys.where(F.col("key") != "").groupBy("key").agg(F.min("ord").alias("ord"))


def _grams(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters; none if the text is shorter."""
    places = F.sequence(F.lit(1), F.length(text) - F.lit(size - 1))
    pieces = F.transform(places, lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``text, key``: pairs of ``texts.text`` and ``keys.key`` where the text
    contains the key.  Both are distinct and not empty.

    Each key is filed under the piece of ``GRAM`` characters that fewest keys
    have (a shorter key under itself).  A text looks up its own pieces only,
    three for each of its characters at most, however many lengths the keys
    have, and meets only keys whose rarest piece it holds; these are compared.

    The pieces are many times the size of the written texts and keys by which
    Spark would judge them, so the sides are merged and neither is collected
    for a broadcast.  Texts and keys are spread first: their files are few.
    """
    texts, keys = spread(texts), spread(keys)
    own = F.when(F.length("key") < GRAM, F.array("key")).otherwise(_grams(F.col("key"), GRAM))
    filed = settle(keys.select("key", F.explode(own).alias("gram")), "grams")
    counts = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchors = filed.hint("merge").join(counts, "gram").groupBy("key").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    every = F.concat(*(_grams(F.col("text"), size) for size in range(1, GRAM + 1)))
    looked = texts.select("text", F.explode(every).alias("gram"))
    return looked.hint("merge").join(anchors, "gram").where(F.col("text").contains(F.col("key"))).select("text", "key")


def resolve_targets(
    targets: DataFrame,
    registry: DataFrame,
    target_id: str = "query_id",
    text: str = "doc_filter",
) -> DataFrame:
    """Registry row each target text names.

    First an exact match on id, file stem, organisation or name; else a match
    where one text contains the other (id, file stem, organisation); else a
    made-up row.  Among several rows the first by ``ord`` wins.  Blank targets
    stay null.

    Containment is an equality join on short pieces (:func:`containing`), both
    ways.  The distinct keys of both sides are written once.
    """
    plain = F.regexp_replace(F.lower(strip(F.col(text))), r"\.pdf|@", "")
    asked = targets.select(target_id, F.col(text), F.nullif(plain, F.lit("")).alias("key"))
    distinct = settle(asked.where(F.col("key").isNotNull()).select("key").distinct(), "targets")

    rows = registry.select(
        F.col("ord"),
        F.lower(F.coalesce(F.col("document_id"), F.lit(""))).alias("id"),
        _plain_file(F.col("local_file")).alias("file"),
        _plain_organization(F.col("organization")).alias("org"),
        F.lower(F.coalesce(F.col("document_name"), F.lit(""))).alias("name"),
    )
    exact = _first_by_key(
        rows.select("ord", F.explode(F.array("id", "file", "org", "name")).alias("key"))
    )
    partial = rows.select("ord", F.explode(F.array("id", "file", "org")).alias("key"))
    partial = settle(_first_by_key(partial), "registry")

    inside = containing(partial.select(F.col("key").alias("text")), distinct)
    contained = inside.join(partial.withColumnRenamed("key", "text"), "text").select("key", "ord")
    around = containing(distinct.select(F.col("key").alias("text")), partial.select("key"))
    holding = around.join(partial, "key").select(F.col("text").alias("key"), "ord")
    second = (
        contained.unionByName(holding).groupBy("key").agg(F.min("ord").alias("ord_partial"))
    )
    chosen = (
        distinct.join(exact, "key", "left")
        .join(second, "key", "left")
        .select("key", F.coalesce("ord", "ord_partial").alias("ord"))
    )
    full = registry.select(
        "ord",
        F.col("document_id").alias("_id"),
        F.col("document_name").alias("_name"),
        F.col("organization").alias("_org"),
        F.col("local_file").alias("_file"),
    )
    named = chosen.join(full, "ord", "left")
    made_up = F.col("ord").isNull()
    resolved = named.select(
        "key",
        F.when(made_up, F.col("key")).otherwise(F.col("_id")).alias("document_id"),
        F.when(made_up, F.col("key")).otherwise(F.col("_name")).alias("document_name"),
        F.when(made_up, F.lit("")).otherwise(F.coalesce("_org", F.lit(""))).alias("organization"),
        F.when(made_up, F.concat("key", F.lit(".pdf"))).otherwise(F.col("_file")).alias("local_file"),
    )
    return asked.join(resolved, "key", "left").select(
        target_id, text, "document_id", "document_name", "organization", "local_file"
    )


def target_keys(queries: DataFrame, resolved: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Attach the compare keys of each query's target (``has_target`` = false: none)."""
    keys = resolved.select(
        query_id,
        F.col("document_id").isNotNull().alias("has_target"),
        F.lower(F.coalesce("document_id", F.lit(""))).alias("target_id"),
        _plain_file(F.col("local_file")).alias("target_file"),
        _plain_organization(F.col("organization")).alias("target_org"),
    )
    return queries.join(keys, query_id, "left").withColumn(
        "has_target", F.coalesce("has_target", F.lit(False))
    )


def matches_target(document_id: Column, pdf_file: Column) -> Column:
    """Row test against the keys of :func:`target_keys`."""
    document = F.lower(F.coalesce(document_id, F.lit("")))
    file = F.regexp_replace(F.lower(F.coalesce(pdf_file, F.lit(""))), r"\.pdf", "")
    wanted, wanted_file, org = F.col("target_id"), F.col("target_file"), F.col("target_org")
    return (
        ~F.col("has_target")
        | ((wanted != "") & document.contains(wanted))
        | ((wanted_file != "") & file.contains(wanted_file))
        | ((org != "") & (document.contains(org) | file.contains(org)))
    )


def overfetch(k: int) -> int:
    return max(k * K.OVERFETCH_FACTOR, K.OVERFETCH_MIN)


def keep_target_hits(
    hits: DataFrame,
    queries: DataFrame,
    documents: DataFrame,
    k: int,
    item_id: str = "chunk_id",
    query_id: str = "query_id",
) -> DataFrame:
    """Filter over-fetched hits by each query's target and rank them again.

    ``hits`` are the best :func:`overfetch` rows per query (queries without a
    target use the same list: its first ``k`` rows are theirs).  The filter
    sits above the rank limit, so fewer than ``k`` rows may remain.  The hits
    are written first; Spark broadcasts them if the written size allows it and
    then scans the document table in place.
    """
    keys = queries.select(query_id, "has_target", "target_id", "target_file", "target_org")
    joined = settle(hits.join(keys, query_id), "wide_hits").join(
        documents.select(item_id, "document_id", "pdf_file"), item_id
    )
    kept = joined.where(matches_target(F.col("document_id"), F.col("pdf_file")))
    kept = kept.drop("has_target", "target_id", "target_file", "target_org")
    return top_k(kept.withColumnRenamed("rank", "_rank"), [query_id], [F.asc("_rank")], k).drop(
        "_rank"
    )

"""Stored-table queries: write policies, chats, reports, users, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import document_id_of, document_name_of
from ..operators import clinical, state
from ..operators.ordered import lag_in_order
from ..session import new_run_dir
from ..sources.chats import open_state
from ..sources.files import read_json_tolerant, write_json
from ..sources.pages import inspect_pages
from .tables import strip_sql, table


def _stored_and_new(spark, d):
    """Orders as stored rows (keyed by customer) and events as new rows."""
    old = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.col("o_orderpriority").alias("value"),
        F.col("o_orderkey").alias("version"),
    )
    new = table(spark, d, "events").select(
        (F.col("user_id") * 150).alias("key"),
        F.col("event_type").alias("value"),
        F.col("event_id").alias("version"),
    )
    return old, new


_STORED = """
old AS (SELECT o_orderkey AS key, o_orderpriority AS value, o_orderkey AS version FROM orders),
new AS (SELECT user_id * 150 AS key, event_type AS value, event_id AS version FROM events)
"""


def upsert_latest(spark, d):
    old, new = _stored_and_new(spark, d)
    return state.upsert(old, new, "key", "version")


def insert_if_absent(spark, d):
    old, new = _stored_and_new(spark, d)
    return state.insert_if_absent(old, new, "key")


def delete_by_key(spark, d):
    """Remove a chat only together with its owner: here key and value."""
    old, _ = _stored_and_new(spark, d)
    doomed = table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("key"), F.lit("1-URGENT").alias("value")
    )
    return state.delete_keys(old, doomed, ["key", "value"])


def _reports(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("filename"),
        F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.col("props")).alias(
            "vitals_json"
        ),
        F.concat(F.lit("event "), F.col("event_type")).alias("summary_text"),
        F.col("event_id").alias("uploaded_at"),
    )


def latest_per_user(spark, d):
    newest = state.latest_reports(_reports(spark, d), "k int")
    return newest.select("user_id", "id", "filename", F.col("vitals.k").alias("k"), "summary")


def _chats(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("title"),
        F.when(F.col("event_type") == "error", F.lit("{broken"))
        .when(F.col("event_type") == "view", F.lit("[1, 2]"))
        .otherwise(F.col("props"))
        .alias("data_json"),
        F.col("event_id").alias("updated_at"),
    )


def json_tolerant_parse(spark, d):
    """Chats of all users; broken or non-object JSON is skipped."""
    chats = state.list_chats(_chats(spark, d))
    return chats.select(
        "user_id",
        "id",
        F.col("data")["k"].alias("k"),
        F.col("data")["title"].alias("title"),
        F.col("data")["updatedAt"].alias("updated"),
    )


def newest_chats(spark, d):
    """The five newest chats of each user."""
    return state.newest_chats(_chats(spark, d), 5).select("user_id", "id", "title", "rank")


def wrapped_json(spark, d):
    """Registry rows in wrapper objects; rows of one language are cut short and
    left out by the tolerant scan.  A missing file adds nothing."""
    path = new_run_dir(spark, "wrapped")
    entry = F.struct(
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("source").alias("document_name"),
        F.col("n_chars").cast("int").alias("total_chunks"),
    )
    line = F.to_json(F.struct(F.array(entry).alias("documents")))
    docs = table(spark, d, "documents")
    docs.select(
        F.when(F.col("lang") == "de", F.left(line, F.length(line) - 2)).otherwise(line).alias("value")
    ).write.text(path)
    found = read_json_tolerant(spark, path, schemas.REGISTRY, "documents", lines=True)
    none = read_json_tolerant(spark, f"{path}-missing", schemas.REGISTRY, "documents", lines=True)
    return found.unionByName(none).select("document_id", "document_name", "total_chunks")


def upsert_chats(spark, d):
    """Every event rewrites the chat of the event number it names, if it owns it."""
    chats = _chats(spark, d)
    new = table(spark, d, "events").select(
        F.get_json_object("props", "$.k").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.lit("renamed").alias("title"),
        F.col("props").alias("data_json"),
        (F.col("event_id") + 1_000_000).alias("updated_at"),
    )
    return state.upsert_chats(chats, new)


def register_users(spark, d):
    """Customers sign up; suppliers are known users."""
    known = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.col("s_name").alias("name"),
        F.lower(F.concat(F.regexp_replace("s_name", "Supplier", "Customer"), F.lit("@x.org"))).alias("email"),
        F.lit("h").alias("password_hash"),
        F.lit(0).cast("bigint").alias("created_at"),
    )
    asked = table(spark, d, "customer").select(
        (F.col("c_custkey") + 1_000_000).cast("string").alias("id"),
        F.concat(F.lit("  "), F.col("c_name")).alias("name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("  "))
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("one@"), F.col("c_nationkey")))
        .otherwise(F.concat(F.col("c_name"), F.lit("@X.org ")))
        .alias("email"),
        F.lit("h").alias("password_hash"),
        F.col("c_nationkey").alias("password_length"),
        F.col("c_custkey").alias("created_at"),
        F.col("c_custkey").alias("ord"),
    )
    return state.register_users(known, asked)


def consecutive_events(spark, d):
    """Events of a user that differ from the one before: a bucketed lag."""
    e = table(spark, d, "events").withColumn("_bucket", F.floor(F.col("event_id") / 512))
    lagged = lag_in_order(e, ["user_id"], "_bucket", ["event_id"], "event_type", "before")
    return lagged.where(
        F.col("before").isNull() | (F.col("before") != F.col("event_type"))
    ).select("user_id", "event_id", "event_type")


def stored_tables(spark, d):
    """Chats through the stored table: insert, insert again, upsert, delete."""
    chats = _chats(spark, d)
    store = open_state(spark, new_run_dir(spark, "state"))["user_chats"]
    store.insert_if_absent(chats)
    store.insert_if_absent(chats.withColumn("title", F.lit("again")))
    newer = chats.where(F.col("title") == "click").withColumn("title", F.lit("clicked"))
    store.upsert(newer.withColumn("updated_at", F.col("updated_at") + 1), "updated_at")
    store.delete(chats.where(F.col("title") == "view").select("id", "user_id"), ["id", "user_id"])
    return store.read()


def json_round_trip(spark, d):
    """Documents as registry rows, written as JSON and read by the tolerant scan."""
    path = new_run_dir(spark, "registry")
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("/data/raw/My_"), F.col("source"), F.lit(" file-"), F.col("doc_id"), F.lit(".pdf"))
    write_json(
        docs.select(
            document_id_of(name).alias("document_id"),
            document_name_of(name).alias("document_name"),
            F.col("lang").alias("organization"),
            F.lit("indexed").alias("status"),
            F.col("n_chars").cast("int").alias("total_chunks"),
        ),
        path,
    )
    rows = read_json_tolerant(spark, path, schemas.REGISTRY, "documents", lines=True)
    return rows.select("document_id", "document_name", "organization", "status", "total_chunks")


def report_text(spark, d):
    """Text of every conversation under page lines, as for an uploaded report."""
    pages = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        F.when(F.col("role") == "system", F.lit(" ")).otherwise(F.col("text")).alias("text"),
    )
    return clinical.report_text(pages)


def inspect_documents(spark, d):
    """Page count and the first two pages of every conversation."""
    pages = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        "text",
    )
    return inspect_pages(pages)


QUERIES = {
    "upsert_latest": upsert_latest,
    "insert_if_absent": insert_if_absent,
    "delete_by_key": delete_by_key,
    "latest_per_user": latest_per_user,
    "json_tolerant_parse": json_tolerant_parse,
    "newest_chats": newest_chats,
    "wrapped_json": wrapped_json,
    "upsert_chats": upsert_chats,
    "register_users": register_users,
    "consecutive_events": consecutive_events,
    "stored_tables": stored_tables,
    "json_round_trip": json_round_trip,
    "report_text": report_text,
    "inspect_documents": inspect_documents,
}

_CHATS = """
chats AS (SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS user_id, event_type AS title,
  CASE event_type WHEN 'error' THEN '{broken' WHEN 'view' THEN '[1, 2]' ELSE props END AS data_json,
  event_id AS updated_at FROM events)
"""

ORACLE = {
    "upsert_latest": f"""
WITH {_STORED}, l AS (SELECT key, max(version) AS version, arg_max(value, version) AS value FROM new GROUP BY key)
SELECT key, value, version FROM old WHERE key NOT IN (SELECT key FROM l)
UNION ALL SELECT key, value, version FROM l""",
    "insert_if_absent": f"""
WITH {_STORED} SELECT * FROM old UNION ALL SELECT * FROM new WHERE key NOT IN (SELECT key FROM old)""",
    "delete_by_key": f"""
WITH {_STORED} SELECT old.* FROM old JOIN orders ON o_orderkey = key
WHERE NOT (o_orderstatus = 'F' AND value = '1-URGENT')""",
    "latest_per_user": """
WITH m AS (SELECT user_id, max(event_id) AS e FROM events GROUP BY user_id)
SELECT m.user_id::VARCHAR AS user_id, e::VARCHAR AS id, event_type AS filename,
  CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
  'event ' || event_type AS summary FROM m JOIN events ON event_id = e""",
    "json_tolerant_parse": """
SELECT user_id::VARCHAR AS user_id, event_id::VARCHAR AS id, json_extract_string(props, '$.k') AS k,
  event_type AS title, event_id::VARCHAR AS updated
FROM events WHERE event_type NOT IN ('error', 'view')""",
    "newest_chats": """
SELECT user_id, id, title, rank FROM (
  SELECT user_id::VARCHAR AS user_id, event_id::VARCHAR AS id, event_type AS title,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS rank
  FROM events WHERE event_type NOT IN ('error', 'view')) WHERE rank <= 5""",
    "wrapped_json": """
SELECT doc_id::VARCHAR AS document_id, source AS document_name, CAST(n_chars AS INTEGER) AS total_chunks
FROM documents WHERE lang <> 'de' OR lang IS NULL""",
    "upsert_chats": f"""
WITH {_CHATS},
n AS (SELECT json_extract_string(props, '$.k') AS id, user_id::VARCHAR AS user_id, props, event_id FROM events),
ok AS (SELECT n.* FROM n LEFT JOIN chats c ON c.id = n.id WHERE c.id IS NULL OR c.user_id = n.user_id),
l AS (SELECT id, arg_max(user_id, event_id) AS user_id, 'renamed' AS title,
  arg_max(props, event_id) AS data_json, max(event_id) + 1000000 AS updated_at FROM ok GROUP BY id)
SELECT * FROM chats WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT * FROM l""",
    "register_users": """
WITH k AS (SELECT s_suppkey::VARCHAR AS id, s_name AS name,
    lower(replace(s_name, 'Supplier', 'Customer') || '@x.org') AS email, 'h' AS password_hash, 0::BIGINT AS created_at
  FROM supplier),
a AS (SELECT (c_custkey + 1000000)::VARCHAR AS id, c_name AS name, CASE c_mktsegment WHEN 'MACHINERY' THEN ''
    WHEN 'BUILDING' THEN 'one@' || c_nationkey ELSE lower(c_name || '@X.org') END AS email,
    'h' AS password_hash, c_custkey AS created_at, row_number() OVER (PARTITION BY CASE c_mktsegment
    WHEN 'MACHINERY' THEN '' WHEN 'BUILDING' THEN 'one@' || c_nationkey ELSE lower(c_name || '@X.org') END
    ORDER BY c_custkey) AS r FROM customer WHERE c_nationkey >= 6)
SELECT * FROM k UNION ALL SELECT id, name, email, password_hash, created_at FROM a
WHERE r = 1 AND email <> '' AND email NOT IN (SELECT email FROM k)""",
    "consecutive_events": """
WITH l AS (SELECT user_id, event_id, event_type,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id, event_type FROM l WHERE before IS NULL OR before <> event_type""",
    "stored_tables": f"""
WITH {_CHATS} SELECT id, user_id, CASE title WHEN 'click' THEN 'clicked' ELSE title END AS title, data_json,
  CASE title WHEN 'click' THEN updated_at + 1 ELSE updated_at END AS updated_at FROM chats WHERE title <> 'view'""",
    "json_round_trip": """
SELECT concat('doc_my_', source, '_file-', doc_id) AS document_id,
  concat('My ', upper(source[1:1]), source[2:], ' File-', doc_id) AS document_name, lang AS organization,
  'indexed' AS status, CAST(n_chars AS INTEGER) AS total_chunks FROM documents""",
    "report_text": f"""
SELECT conv_id::VARCHAR AS document_id, string_agg(concat('--- Page ', turn + 1, ' ---', chr(10),
  {strip_sql('text')}), chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations WHERE role <> 'system' GROUP BY conv_id""",
    "inspect_documents": """
SELECT conv_id::VARCHAR AS document_id, CAST(turn + 1 AS INTEGER) AS page_number, text[1:2000] AS head, n_pages
FROM conversations JOIN (SELECT conv_id, count(*) AS n_pages FROM conversations GROUP BY conv_id) USING (conv_id)
WHERE turn < 2""",
}

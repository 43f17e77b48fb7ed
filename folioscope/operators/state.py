"""Stored tables: write policies, chats and reports.

Each operator returns the new content of the table; ``sources.tables`` writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .ordered import last_rows, top_k


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins: rows of ``new`` replace rows of ``old`` with their key.

    Only ``new`` is reduced per key; ``old`` passes an anti join against the new
    keys, which needs no shuffle of ``old`` when the batch is small.
    """
    latest = last_rows(new, [key], [version])
    kept = old.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest)


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """First write wins: rows of ``new`` whose key is not stored are appended.

    Repeats inside the batch all pass.  Stored keys are first cut down to those
    the batch has, so the large side is only scanned.
    """
    stored = old.select(key).join(new.select(key).distinct(), key, "left_semi").distinct()
    return old.unionByName(new.join(stored, key, "left_anti"))


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Remove the rows named by ``keys``, e.g. an id together with its owner."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


# -- users -------------------------------------------------------------------


def register_users(users: DataFrame, requests: DataFrame) -> DataFrame:
    """New content of the user table after sign-up requests.

    ``requests`` is ``id, name, email, password_hash, password_length,
    created_at, ord``; hashing happens outside.  Names are trimmed, emails
    trimmed and lower-cased; blank fields, short passwords and known emails are
    refused, and of equal emails in a batch the first one wins.
    """
    tidy = requests.select(
        "id",
        strip(F.coalesce("name", F.lit(""))).alias("name"),
        F.lower(strip(F.coalesce("email", F.lit("")))).alias("email"),
        "password_hash",
        "password_length",
        "created_at",
        "ord",
    ).where((F.col("name") != "") & (F.col("email") != "") & (F.col("password_length") >= 6))
    first = tidy.groupBy("email").agg(
        F.min_by(F.struct("id", "name", "password_hash", "created_at"), "ord").alias("r")
    )
    rows = first.select("r.id", "r.name", "email", "r.password_hash", "r.created_at")
    return insert_if_absent(users, rows, "email")


def find_user(users: DataFrame, column: str, value: str) -> DataFrame:
    """Point lookup by id or by (trimmed, lower-case) email, hash left out."""
    wanted = value.strip().lower() if column == "email" else value
    return users.where(F.col(column) == wanted).select("id", "name", "email", "created_at")


# -- chats -------------------------------------------------------------------


def upsert_chats(chats: DataFrame, new: DataFrame) -> DataFrame:
    """Insert chats, or update title, data and time of the owner's own chat.

    A chat id that belongs to somebody else is left alone.
    """
    owned = new.alias("n").join(
        chats.select("id", F.col("user_id").alias("_owner")).alias("o"), "id", "left"
    )
    allowed = owned.where(
        F.col("_owner").isNull() | (F.col("_owner") == F.col("n.user_id"))
    ).drop("_owner")
    return upsert(chats, allowed.select(chats.columns), "id", "updated_at")


def list_chats(chats: DataFrame) -> DataFrame:
    """Chats with their JSON object extended by id, title and time.

    Rows whose JSON is not an object are skipped.
    """
    parsed = F.try_parse_json("data_json")
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    fields = F.coalesce(
        F.from_json("data_json", "map<string,string>"), F.create_map().cast("map<string,string>")
    )
    own = F.create_map(
        F.lit("id"), F.col("id"),
        F.lit("title"), F.col("title"),
        F.lit("updatedAt"), F.col("updated_at").cast("string"),
    )
    others = F.map_filter(fields, lambda k, v: ~k.isin("id", "title", "updatedAt"))
    return chats.where(is_object).select(
        "user_id", "id", "title", "updated_at", F.map_concat(others, own).alias("data")
    )


def newest_chats(chats: DataFrame, page: int = 50) -> DataFrame:
    """The ``page`` newest chats of each user with their ``rank``, newest first;
    ties follow the id.  No more than a page per user leaves a task."""
    return top_k(list_chats(chats), ["user_id"], [F.desc("updated_at"), F.asc("id")], page)


# -- patient reports ---------------------------------------------------------


def latest_reports(reports: DataFrame, vitals_schema: str) -> DataFrame:
    """Newest report per user; unreadable vitals become an empty record."""
    newest = last_rows(reports, ["user_id"], ["uploaded_at"])
    return newest.select(
        "user_id",
        "id",
        "filename",
        F.from_json("vitals_json", vitals_schema).alias("vitals"),
        F.col("summary_text").alias("summary"),
        "uploaded_at",
    )


def attach_patient(
    queries: DataFrame, reports: DataFrame, user_id: str = "user_id"
) -> DataFrame:
    """Patient record of each query: given one, else the user's latest report,
    else the session profile.

    ``queries`` may carry ``patient`` and ``session_patient`` structs shaped
    like ``reports.vitals``.
    """
    stored = reports.select(user_id, F.col("vitals").alias("_vitals"), F.col("summary").alias("_summary"))
    joined = queries.join(stored, user_id, "left")
    options = [F.col(c) for c in ("patient",) if c in queries.columns]
    options.append(F.col("_vitals"))
    if "session_patient" in queries.columns:
        options.append(F.when(F.col(user_id).isNull(), F.col("session_patient")))
    given = F.coalesce(F.col("patient").isNotNull(), F.lit(False)) if "patient" in queries.columns else F.lit(False)
    return joined.select(
        *[c for c in queries.columns if c not in ("patient", "session_patient")],
        F.coalesce(*options).alias("vitals"),
        F.when(~given, F.col("_summary")).alias("summary"),
    )

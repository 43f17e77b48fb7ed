"""Stored application tables (users, chats, patient reports)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import schemas
from .tables import StoredTable


def open_state(spark: SparkSession, folder: str) -> dict[str, StoredTable]:
    """The three tables under one folder; each is created by its first write."""
    return {
        "users": StoredTable(spark, f"{folder}/users", schemas.USERS, "email"),
        "user_chats": StoredTable(spark, f"{folder}/user_chats", schemas.USER_CHATS, "id"),
        "patient_reports": StoredTable(spark, f"{folder}/patient_reports", schemas.PATIENT_REPORTS, "id"),
    }

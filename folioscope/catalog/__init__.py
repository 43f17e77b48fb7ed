"""Named queries on the driver tables, with the SQL each must agree with."""

import functools

from ..session import prepare
from . import chunks, evaluation, retrieval, state, stored, structure, text, validation

_PARTS = (text, structure, chunks, retrieval, evaluation, validation, state, stored)


def _prepared(run):
    @functools.wraps(run)
    def call(spark, folder):
        return run(prepare(spark), folder)

    return call


def queries() -> dict:
    return {name: _prepared(run) for part in _PARTS for name, run in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}

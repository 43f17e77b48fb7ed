"""The queries of this package and the SQL that some of them must agree with."""

from . import (
    bpe,
    edit_counts,
    embedding_dedup,
    exact_dedup,
    language_id,
    mixing,
    near_dedup,
    periodic_runs,
    token_file,
    toxicity,
    url_filter,
    warc,
    whitening,
)

_PARTS = (
    bpe, warc, url_filter, token_file, exact_dedup, embedding_dedup, mixing, edit_counts, toxicity,
    near_dedup, periodic_runs, language_id, whitening,
)


def queries() -> dict:
    return {name: run for part in _PARTS for name, run in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}

"""Vector and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )


def unit(a: Column) -> Column:
    """Vector scaled to length one."""
    return let(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def point_id(chunk_id: Column) -> Column:
    """Name-based (version 5) UUID of a chunk id, stable across runs."""
    digest = F.sha1(
        F.concat(F.unhex(F.lit(K.DNS_NAMESPACE_HEX)), F.encode(chunk_id, "UTF-8"))
    )

    def part(start: int, size: int) -> Column:
        return F.substring(digest, start, size)

    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        part(1, 8),
        part(9, 4),
        F.concat(F.lit("5"), part(14, 3)),
        F.concat(variant, part(18, 3)),
        part(21, 12),
    )

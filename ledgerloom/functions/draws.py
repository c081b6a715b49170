"""Random draws that depend on (stream, row id) only.

``rand(seed)`` changes with the partitioning and a lost task may draw anew;
these draws are the same on every engine and every retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import as_col

_BITS = 48


def hash48(stream: str, row_id: Column | str) -> Column:
    """48 bits of md5(stream|id) as a bigint."""
    text = F.concat(F.lit(stream + "|"), as_col(row_id).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("bigint")


def uniform(stream: str, row_id: Column | str) -> Column:
    """A double strictly between 0 and 1."""
    return (hash48(stream, row_id).cast("double") + F.lit(0.5)) / F.lit(float(2**_BITS))


def uniform_int(stream: str, row_id: Column | str, n: int) -> Column:
    """A whole number 0..n-1."""
    return F.floor(uniform(stream, row_id) * F.lit(float(n))).cast("int")


def standard_normal(stream: str, row_id: Column | str) -> Column:
    """Box-Muller on two independent uniform streams."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(stream + ".r", row_id)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(stream + ".a", row_id))

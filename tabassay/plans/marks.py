"""Filters of fixed size: which rows may belong to a set that is itself too large to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's bitmap functions.
BUCKET_BITS = 1 << 15


def with_marks(df: DataFrame, members: DataFrame, to: str, bits: int) -> DataFrame:
    """``df`` with a boolean column ``to``: false where no row of ``members`` has its 64-bit ``hash``.

    True may be a chance match. The filter has at most ``bits`` bits, so it is broadcast at any size of the data;
    the more members, the more chance matches.
    """
    place = f"pmod(hash, {bits}L)"
    filter_ = (
        members.selectExpr(f"{place} AS b").groupBy(F.expr(f"b div {BUCKET_BITS} AS bucket"))
        .agg(F.expr(f"bitmap_construct_agg(b % {BUCKET_BITS}) AS bits"))
    )
    at = f"({place} % {BUCKET_BITS})"
    byte = f"CAST(conv(hex(substring(bits, CAST({at} div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    found = df.join(F.broadcast(filter_), F.expr(f"bucket = {place} div {BUCKET_BITS}"), "left")
    mark = f"coalesce(shiftright({byte}, CAST({at} % 8 AS INT)) & 1 = 1, false) AS {to}"
    return found.selectExpr(*df.columns, mark)

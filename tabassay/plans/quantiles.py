"""Exact quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of a group in one task's memory.  Here exact sums
per slice tell which slices hold the wanted ranks, and only those slices are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import quoted
from .keys import attach
from .slices import DEFAULT, Slicing, in_slices


def exact_quantiles(
    numbers: DataFrame, probs: list[float], segment_by: list[str], how: Slicing = DEFAULT
) -> DataFrame:
    """(segment..., pos, quantiles): linear interpolation, one array entry per prob.

    ``numbers`` holds (segment..., pos, num, n) with num never NULL.
    """
    keys = [quoted(g) for g in (*segment_by, "pos")]
    columns = [F.expr(k) for k in keys]
    sliced = in_slices(numbers, segment_by, how)

    column = Window.partitionBy(*columns)
    earlier = column.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*columns, "slice")
        .agg(F.expr("sum(n) AS size"))
        .withColumn("start", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .withColumn("total", F.sum("size").over(column))
    )
    ranks = {
        f"{end}{i}": f"{end}({p}D * (total - 1))"
        for i, p in enumerate(probs)
        for end in ("floor", "ceil")
    }
    wanted = starts.where(
        " OR ".join(f"(start <= {r} AND {r} < start + size)" for r in ranks.values())
    ).drop("size")

    def holds(rank: str) -> str:
        return f"(upto > {rank} AND upto - n <= {rank})"

    inside = Window.partitionBy(*columns, "slice").orderBy("num").rowsBetween(
        Window.unboundedPreceding, 0
    )
    found = (
        attach(sliced, wanted, segment_by, "num", ("pos", "slice"))
        .withColumn("upto", F.col("start") + F.sum("n").over(inside))
        .where(" OR ".join(holds(r) for r in ranks.values()))
        .groupBy(*columns)
        .agg(
            F.expr("max(total) AS total"),
            *[F.expr(f"max(num) FILTER (WHERE {holds(r)}) AS {name}") for name, r in ranks.items()],
        )
    )
    values = ", ".join(
        f"CASE WHEN floor{i} = ceil{i} THEN floor{i}"
        f" ELSE floor{i} + (ceil{i} - floor{i}) * pmod({p}D * (total - 1), 1D) END"
        for i, p in enumerate(probs)
    )
    return found.selectExpr(*keys, f"array({values}) AS quantiles")

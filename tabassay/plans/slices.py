"""Ordering the values of a column in many tasks.

The values are cut into slices at approximate quantiles of a fixed share of the distinct
values, as a range partitioning would.  Sums per slice are exact, and so is whatever is
computed inside a slice: where the cuts fall decides only how even the slices are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import quoted
from .keys import attach, by


@dataclass(frozen=True)
class Slicing:
    slices: int = 1024  # a power of two
    share: int = 64  # one distinct value in this many helps to place the cuts
    worth: int = 4096  # columns with fewer such values stay whole


DEFAULT = Slicing()


def _cuts(numbers: DataFrame, segment_by: list[str], how: Slicing) -> DataFrame:
    """(segment..., pos, cuts) of the columns that are worth cutting."""
    parts = ", ".join(f"{i / how.slices}D" for i in range(1, how.slices))
    return (
        numbers.where(f"pmod(xxhash64(num), {how.share}) = 0")
        .groupBy(*by(segment_by), "pos")
        .agg(
            F.expr("count(1) AS placed"),
            F.expr(f"percentile_approx(num, array({parts}), {10 * how.slices}) AS cuts"),
        )
        .where(f"placed >= {how.worth}")
        .drop("placed")
    )


def in_slices(numbers: DataFrame, segment_by: list[str], how: Slicing = DEFAULT) -> DataFrame:
    """(segment..., pos, num, ...) rows with ``slice``, the number of cuts up to the value."""
    columns = ", ".join(map(quoted, numbers.columns)).replace("{", "{{").replace("}", "}}")
    placed = attach(numbers, _cuts(numbers, segment_by, how), segment_by, "num", how="left")
    query, step = f"SELECT {columns}, cuts, 0 AS slice FROM {{placed}}", how.slices // 2
    while step:  # binary search, one bit of the answer at a time
        found = f"IF(num >= cuts[slice + {step - 1}], {step}, 0)"
        query = f"SELECT {columns}, cuts, slice + {found} AS slice FROM ({query})"
        step //= 2
    return numbers.sparkSession.sql(f"SELECT {columns}, slice FROM ({query})", placed=placed)

"""First row per key, first n per group, run budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes first in `order`. A minimum of structs is combined before the shuffle,
    so hot keys do not gather; the rest of the row takes part in the order only to make ties repeatable."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    simple = [c for c in rest if not dict(df.dtypes)[c].startswith(("map", "variant"))]
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in [*order, *rest]]), F.struct(*[F.col(f"`{c}`") for c in [*order, *simple]]))
    return df.groupBy(*keys).agg(best.alias("_first")).select(*keys, "_first.*").select(*[F.col(f"`{c}`") for c in df.columns])


def top_n_per_site(df: DataFrame, site: str, n: int, order: Sequence[Column | str]) -> DataFrame:
    """At most n rows of each site. Spark cuts each task's rows of a site to n before the shuffle."""
    place = F.row_number().over(Window.partitionBy(site).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def take_budget(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first n rows of a run: a bounded top-n, no global sort."""
    return df.orderBy(*order).limit(n)

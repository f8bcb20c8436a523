"""Turning arrays into rows without computing them twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def exploded(df: DataFrame, keep: list, array: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per element of a computed array, with its place if ``pos`` is given.

    A plain explode makes the optimizer add ``size(array) > 0`` below it, which
    evaluates the array a second time. The outer form does not; the rows it adds
    for empty arrays are dropped here. Elements must not be NULL.
    """
    if pos is None:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name))
    return rows.where(F.col(name).isNotNull())

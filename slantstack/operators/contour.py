"""Contour features: (level, coords) rows, coords an array of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filtered(features: DataFrame, least_nodes: int, drop_zero: bool = False) -> DataFrame:
    """Features with more than ``least_nodes`` nodes, without level 0 if asked."""
    out = features.where(F.size("coords") > least_nodes)
    return out.where("level <> 0") if drop_zero else out


def summary(features: DataFrame) -> DataFrame:
    return features.agg(F.count(F.lit(1)).alias("n_feature"), F.coalesce(F.sum(F.size("coords")), F.lit(0)).alias("n_node"))
